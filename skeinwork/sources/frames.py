"""Event frames: binary frames of a repository feed (two values: header and body), and JSON frames of a light feed."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.functions.cbor import decode, decode_at, encode, to_plain

KINDS = {"#commit", "#sync", "#identity", "#account", "#info", "#labels"}
FRAME = "kind string, seq bigint, body string, error string, message string"


def decode_frame(data: bytes) -> tuple[str | None, int, str | None, str | None, str | None]:
    """(kind, seq, body as JSON, error, message) of one frame."""
    try:
        head, at = decode_at(data, 0)
        if not isinstance(head, dict) or not isinstance(head.get("op"), int):
            raise ValueError("bad header")
        raw = data[at:]
        if head["op"] == -1:
            body = decode(raw)
            return None, 0, None, "StreamError", f"{body.get('error', '')}: {body.get('message', '')}"
        kind = head.get("t", "")
        if head["op"] != 1 or kind not in KINDS:
            return kind, best_effort_seq(raw), None, "UnknownFrameError", f"op {head['op']}, type {kind}"
        body = decode(raw)
        return kind, body.get("seq", 0) if isinstance(body, dict) else 0, json.dumps(to_plain(body), ensure_ascii=False, separators=(",", ":")), None, None
    except (ValueError, AttributeError, UnicodeDecodeError) as why:
        return None, 0, None, "DecodeError", str(why)


def best_effort_seq(raw: bytes) -> int:
    """The sequence number of a body that is not understood, 0 where there is none."""
    try:
        body, _ = decode_at(raw, 0)
        seq = body.get("seq", 0) if isinstance(body, dict) else 0
        return seq if isinstance(seq, int) and not isinstance(seq, bool) else 0
    except (ValueError, UnicodeDecodeError):
        return 0


def encode_frame(kind: str, body: dict) -> bytes:
    return encode({"op": 1, "t": kind}) + encode(body)


def decode_frames(frames: DataFrame, frame: str = "frame", key: str = "event_id") -> DataFrame:
    """``key`` and the decoded parts of binary frames; errors stay as rows."""
    kind = frames.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [decode_frame(x or b"") for x in batch.column(1).to_pylist()]
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], [key, "kind", "seq", "body", "error", "message"])

    return frames.select(key, frame).mapInArrow(run, f"{key} {kind}, {FRAME}")


# --- label frames -----------------------------------------------------------------------------------------

LABEL = "seq bigint, kind string, place int, src string, uri string, cid string, val string, neg boolean, cts string, error string, message string"
_TEXTS = ("src", "uri", "cid", "val", "cts")


def _label(value: object) -> list:
    """The fields of one label in the order of ``LABEL``; src, uri, val and cts must be there."""
    if not isinstance(value, dict) or any(not isinstance(value.get(n), str) for n in _TEXTS if n != "cid" or "cid" in value):
        raise ValueError("not a label")
    neg = value.get("neg")
    if neg is not None and not isinstance(neg, bool):
        raise ValueError("not a label")
    return [value["src"], value["uri"], value.get("cid"), value["val"], bool(neg), value["cts"]]


def decode_label_frame(data: bytes) -> list[list]:
    """Rows of ``LABEL``: a row for each label of a frame, or one that says what else it is."""

    def other(seq: int, kind: str | None, error: str | None, message: str | None) -> list[list]:
        return [[seq, kind, None, *[None] * 6, error, message]]

    try:
        head, at = decode_at(data, 0)
        if not isinstance(head, dict) or not isinstance(head.get("op"), int):
            raise ValueError("bad header")
        kind, raw = head.get("t", ""), data[at:]
        if head["op"] == 1 and kind not in ("#labels", "#info") or head["op"] not in (1, -1):
            return other(best_effort_seq(raw), kind, "UnknownFrameError", f"op {head['op']}, type {kind}")
        body = decode(raw)
        if not isinstance(body, dict):
            raise ValueError("not a map")
        if head["op"] == -1:
            return other(0, None, "StreamError", f"{body.get('error', '')}: {body.get('message', '')}")
        if kind == "#info":
            return other(0, kind, None, f"{body.get('name', '')}: {body.get('message', '')}")
        seq, labels = body.get("seq", 0), body.get("labels")
        if not isinstance(labels, list) or not isinstance(seq, int):
            raise ValueError("no labels")
        return [[seq, kind, k, *_label(x), None, None] for k, x in enumerate(labels)]
    except (ValueError, UnicodeDecodeError) as why:
        return other(0, None, "DecodeError", str(why))


def decode_label_frames(frames: DataFrame, frame: str = "frame", key: str = "event_id") -> DataFrame:
    """``key`` and the rows of binary label frames; errors stay as rows."""
    kind = frames.schema[key].dataType.simpleString()
    kinds = [pa.int64(), pa.string(), pa.int32(), *[pa.string()] * 4, pa.bool_(), *[pa.string()] * 3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in LABEL.split(", ")]
        for batch in batches:
            found = [(k, row) for k, x in enumerate(batch.column(1).to_pylist()) for row in decode_label_frame(x or b"")]
            keys = batch.column(0).take(pa.array([k for k, _ in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, *(pa.array([r[i] for _, r in found], t) for i, t in enumerate(kinds))], [key, *names])

    return frames.select(key, frame).mapInArrow(run, f"{key} {kind}, {LABEL}")


# --- JSON frames, in built-in functions ------------------------------------------------------------------

JSON_FRAME = (
    "did string, time_us bigint, kind string, error string, message string, commit struct<rev:string,operation:string,collection:string,rkey:string,cid:string,record:string>, "
    "account struct<seq:bigint,did:string,active:boolean,status:string>, identity struct<seq:bigint,did:string,handle:string>"
)


def parse_json(frame: Column) -> Column:
    return F.from_json(frame, JSON_FRAME)


def decode_json(frames: DataFrame, frame: str = "frame") -> DataFrame:
    """The frames with ``f`` (all parts), ``seq`` and ``error_code``; an unknown kind has its time as seq."""
    parsed = frames.withColumn("f", parse_json(F.col(frame)))
    code = (
        F.when(F.coalesce("f.error", F.lit("")) != "", "JetstreamError")
        .when(F.coalesce("f.kind", F.lit("")) == "", "DecodeError")
        .when(~F.col("f.kind").isin("commit", "account", "identity"), "UnknownFrameError")
    )
    seq = F.when(F.col("f.kind") == "account", F.col("f.account.seq")).when(F.col("f.kind") == "identity", F.col("f.identity.seq")).when(code == "UnknownFrameError", F.col("f.time_us"))
    return parsed.select("*", code.alias("error_code"), F.coalesce(seq, F.lit(0)).alias("seq"))


def json_ops(decoded: DataFrame, cid_valid: Column) -> DataFrame:
    """An operation for each commit frame; a wrong content id is an error beside the operation."""
    commits = decoded.where("error_code IS NULL AND f.kind = 'commit'")
    given = F.coalesce(F.col("f.commit.cid"), F.lit("")) != ""
    return commits.select(
        "event_id",
        F.col("f.did").alias("repo"),
        F.col("f.commit.rev").alias("rev"),
        F.col("f.commit.operation").alias("action"),
        F.col("f.commit.collection").alias("collection"),
        F.col("f.commit.rkey").alias("rkey"),
        F.when(given & cid_valid, F.col("f.commit.cid")).alias("cid"),
        F.when(given & ~cid_valid, "bad cid").alias("error"),
    )

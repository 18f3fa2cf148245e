"""Queries over binary records: their kind at a glance, and typed rows by collection."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.functions import cbor
from skeinwork.operators import lexicon, typed
from skeinwork.plans.registry import query
from skeinwork.plans.views import V_OPS, table, v_ops


def _record(name: str, properties: dict) -> dict:
    return {"lexicon": 1, "id": name, "defs": {"main": {"type": "record", "key": "any", "record": {"type": "object", "properties": properties}}}}


_SUBJECT = {"type": "object", "properties": {"uri": {"type": "string"}, "cid": {"type": "string"}}}
#: Two packages of schemas, tried one after the other.
CHAIN = [
    lexicon.catalogue([_record("app.bsky.feed.post", {"text": {"type": "string"}, "level": {"type": "integer"}, "langs": {"type": "array", "items": {"type": "string"}}, "raw": {"type": "bytes"}, "embed": {"type": "unknown"}}), _record("app.bsky.actor.profile", {"name": {"type": "string"}})]),
    lexicon.catalogue([_record("app.bsky.feed.like", {"subject": _SUBJECT, "link": {"type": "cid-link"}, "on": {"type": "boolean"}}), _record("app.bsky.actor.profile", {"name": {"type": "integer"}})]),
]
_LINK = "bafyreibml4midgt7ojq7dnabnku5ikzro4erfvdux6mmiqeat7pci2gy4u"


def _value(collection: str, seq: int) -> dict:
    base: dict = {"$type": collection} if seq % 7 else {}
    if collection == "app.bsky.feed.post":
        return base | {"text": f"é{seq}", "level": "x" if seq % 11 == 0 else seq, "langs": ["a"] * (seq % 3), "raw": bytes([seq % 256, 1]), "embed": {"z": seq, "other": [None, True]}, "zzz": {"unread": [1.5]}}
    if collection == "app.bsky.feed.like":
        return base | {"subject": {"uri": f"at://{seq}", "cid": _LINK, "more": 1}, "link": cbor.Link.parse(_LINK), "on": seq % 2 == 0}
    return base | {"name": f"n{seq}"}


def _coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, collection, data): every operation's record in binary; deletions have none, some are cut, some no map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = []
            for seq, action, collection in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                made = cbor.encode(_value(collection, seq))
                made = made[:-1] if seq % 13 == 5 else cbor.encode([1]) if seq % 13 == 6 else made + b"\0" if seq % 13 == 7 else made
                data.append(None if action == "delete" else made)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(data, pa.binary())], ["seq", "collection", "data"])

    return v_ops(spark, sf_dir).select("seq", "action", "collection").mapInArrow(run, "seq bigint, collection string, data binary")


# the kind is the last key of short records, so that cutting them cuts it
_CUT = "seq % 13 = 5 AND (seq % 7 = 0 OR collection NOT IN ('app.bsky.feed.post', 'app.bsky.feed.like'))"


@query(f"WITH {V_OPS} SELECT seq, CASE WHEN seq % 13 <> 6 AND seq % 7 <> 0 AND NOT ({_CUT}) THEN collection END AS kind, CASE WHEN seq % 13 = 6 THEN 'not a map' WHEN {_CUT} THEN 'unexpected end' END AS error FROM ops WHERE action <> 'delete'")
def g04_peek_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of every binary record; one that is cut after its kind still tells it."""
    return typed.peeked(_coded(spark, sf_dir).where("data IS NOT NULL"), ["seq"])


_BAD = "CASE WHEN action = 'delete' THEN NULL WHEN collection IN ('app.bsky.graph.follow', 'app.bsky.feed.repost') THEN 'unknown collection' WHEN seq % 13 = 6 THEN 'not a map' WHEN seq % 13 = 5 THEN 'unexpected end' WHEN collection = 'app.bsky.feed.post' AND seq % 11 = 0 THEN 'not bigint' WHEN seq % 13 = 7 THEN 'trailing bytes' END"


@query(f"""WITH {V_OPS}, x AS (SELECT *, {_BAD} AS error FROM ops), t AS (SELECT *, error IS NULL AND action <> 'delete' AND collection = 'app.bsky.feed.post' AS post, error IS NULL AND action <> 'delete' AND collection = 'app.bsky.feed.like' AS liked, error IS NULL AND action <> 'delete' AND collection = 'app.bsky.actor.profile' AS profile FROM x)
SELECT seq, error, CASE WHEN post THEN 'é' || seq END AS text, CASE WHEN post THEN seq END AS level, CASE WHEN post THEN CAST(seq % 3 AS INTEGER) END AS n_langs, CASE WHEN post THEN seq % 256 END AS first_byte, CASE WHEN post THEN '{{"z":' || seq || ',"other":[null,true]}}' END AS embed,
 CASE WHEN liked THEN 'at://' || seq END AS uri, CASE WHEN liked THEN '{_LINK}' END AS link, CASE WHEN liked THEN seq % 2 = 0 END AS "on", CASE WHEN profile THEN 'n' || seq END AS name FROM t""")
def g12_typed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every operation's record as typed columns of its collection, by the first package that has it."""
    found = typed.typed(_coded(spark, sf_dir), CHAIN, {"post": "app.bsky.feed.post", "liked": "app.bsky.feed.like", "profile": "app.bsky.actor.profile"}, ["seq"])
    first = F.conv(F.hex(F.substring("post.raw", 1, 1)), 16, 10).cast("long")
    return found.select("seq", "error", "post.text", "post.level", F.when(F.col("post.langs").isNotNull(), F.size("post.langs")).alias("n_langs"), first.alias("first_byte"), "post.embed", F.col("liked.subject.uri").alias("uri"), "liked.link", "liked.on", "profile.name")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def g11_records_of_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records counted by a field that is read alone, the rest skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([cbor.encode({"props": p, "n": n, "nested": {"kind": "none"}, "kind": t}) for n, t, p in rows], pa.binary())], ["data"])

    coded = table(spark, sf_dir, "events").select("event_id", "event_type", "props").mapInArrow(run, "data binary")
    kinds = typed.peeked(coded.withColumn("id", F.monotonically_increasing_id()), ["id"], field="kind")
    return kinds.groupBy(F.col("kind").alias("event_type")).agg(F.count("*").alias("n"))

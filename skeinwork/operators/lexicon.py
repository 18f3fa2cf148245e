"""Record schemas: a catalogue of definitions, reference checks, record validation and Spark types."""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinwork.functions import datetimes, identifiers
from skeinwork.functions.cids import CID_PATTERN
from skeinwork.session import stored

#: The grammar of each format that is one, and its most bytes.
_GRAMMARS = {
    "did": (identifiers.DID, 2048), "handle": (identifiers.HANDLE, 253), "nsid": (identifiers.NSID, 317), "record-key": (identifiers.RECORD_KEY, 512),
    "tid": (identifiers.TID, 13), "uri": (identifiers.URI, 8192), "language": (identifiers.LANGUAGE, 1 << 20), "cid": (CID_PATTERN, 59), "datetime": (datetimes.SCHEMA, 64),
}
_COMPILED = {k: (re.compile(rf"\A{v}\Z", re.A), most) for k, (v, most) in _GRAMMARS.items()}


def _fits(name: str, v: str) -> bool:
    grammar, most = _COMPILED[name]
    return len(v.encode()) <= most and grammar.match(v) is not None


def _identifier(v: str) -> bool:
    return _fits("did" if v.startswith("did:") else "handle", v)


def _cid(v: str) -> bool:
    """Version 1, a codec of records or of raw bytes, SHA-256, and no bits left over."""
    if not _fits("cid", v):
        return False
    data = base64.b32decode(v[1:].upper() + "=" * (-len(v[1:]) % 8))
    return data[:4] in (b"\x01\x71\x12\x20", b"\x01\x55\x12\x20") and base64.b32encode(data).decode().rstrip("=").lower() == v[1:]


def _at_uri(v: str) -> bool:
    if not v.startswith("at://") or len(v.encode()) > 8192 or "?" in v or "#" in v:
        return False
    parts = v[5:].split("/")
    checks = _identifier, lambda x: _fits("nsid", x), _record_key
    return len(parts) <= 3 and all(check(x) for check, x in zip(checks, parts, strict=False))


def _record_key(v: str) -> bool:
    return v not in (".", "..") and _fits("record-key", v)


def _bytes(text: object) -> bytes | None:
    """The bytes of base 64 with or without its padding; null for anything else."""
    if not isinstance(text, str):
        return None
    try:
        return base64.b64decode(text if text.endswith("=") else text + "=" * (-len(text) % 4), validate=True)
    except ValueError:
        return None


def _is_blob(v: object) -> bool:
    if not isinstance(v, dict) or v.get("$type") != "blob" or not isinstance(v.get("mimeType"), str):
        return False
    size, ref = v.get("size"), v.get("ref")
    return isinstance(size, int | float) and not isinstance(size, bool) and isinstance(ref, dict) and isinstance(ref.get("$link"), str)


#: What each format asks for beside its grammar.
_CHECKS = {name: partial(_fits, name) for name in _GRAMMARS} | {
    "at-identifier": _identifier,
    "at-uri": _at_uri,
    "cid": _cid,
    "datetime": lambda v: _fits("datetime", v) and not v.endswith("-00:00"),
    "record-key": _record_key,
}


def catalogue(documents: list[dict]) -> dict[str, dict]:
    """``nsid#def`` → definition; a second document of one name is an error."""
    out: dict[str, dict] = {}
    seen: set[str] = set()
    for d in documents:
        if d.get("lexicon") != 1 or not d.get("id") or not d.get("defs"):
            raise ValueError("not a schema document")
        if d["id"] in seen:
            raise ValueError(f"{d['id']} is given twice")
        seen.add(d["id"])
        out |= {f"{d['id']}#{name}": definition for name, definition in d["defs"].items()}
    return out


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")


def read_catalogue(spark: SparkSession, path: str) -> dict[str, dict]:
    """The schema documents below a path; there are some hundreds, and each is small."""
    return catalogue([json.loads(r[0]) for r in _files(spark, path).toLocalIterator()])


def full_ref(ref: str, nsid: str) -> str:
    """``#local``, ``nsid`` and ``nsid#def`` as ``nsid#def``."""
    return f"{nsid}{ref}" if ref.startswith("#") else ref if "#" in ref else f"{ref}#main"


def _refs(definition: object) -> Iterator[str]:
    if isinstance(definition, dict):
        if isinstance(definition.get("ref"), str):
            yield definition["ref"]
        if definition.get("type") == "union":
            yield from definition.get("refs", [])
        for v in definition.values():
            yield from _refs(v)
    elif isinstance(definition, list):
        for v in definition:
            yield from _refs(v)


def unresolved(known: dict[str, dict]) -> list[str]:
    """References that no definition answers, sorted."""
    return sorted({r for name, d in known.items() for ref in _refs(d) if (r := full_ref(ref, name.split("#")[0])) not in known})


# --- a folder of schemas as tables ------------------------------------------------------------------------

_DEFINED = "id string, name string, definition string, refs array<string>, error string"


def _defined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "name", "definition", "refs", "error"]
    for batch in batches:
        out: list[tuple] = []
        for text in batch.column(0).to_pylist():
            try:
                d = json.loads(text)
                if not isinstance(d, dict) or d.get("lexicon") != 1 or not isinstance(d.get("id"), str) or not isinstance(d.get("defs"), dict) or not d["id"] or not d["defs"]:
                    raise ValueError("not a schema document")
                out += [(d["id"], f"{d['id']}#{name}", json.dumps(x), sorted({full_ref(r, d["id"]) for r in _refs(x)}), None) for name, x in d["defs"].items()]
            except (ValueError, RecursionError):
                out.append((None, None, None, [], "not a schema document"))
        kinds = pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string()
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)


def definitions(documents: DataFrame, text: str = "value") -> DataFrame:
    """(id, name, definition, refs, error) of schema documents as JSON, a row for each definition."""
    return documents.select(text).mapInArrow(_defined, _DEFINED)


def read_definitions(spark: SparkSession, path: str) -> DataFrame:
    """``definitions`` of all files below a path."""
    return definitions(_files(spark, path))


def duplicates(defined: DataFrame) -> DataFrame:
    """(id, n) of documents that are given more than once: a definition's name that comes twice tells."""
    twice = defined.where("name IS NOT NULL").groupBy("id", "name").agg(F.count("*").alias("n"))
    return twice.groupBy("id").agg(F.max("n").alias("n")).where("n > 1")


def references(defined: DataFrame) -> DataFrame:
    """(name, ref): the edges between definitions."""
    return defined.select("name", F.explode("refs").alias("ref")).distinct()


def loose(defined: DataFrame) -> DataFrame:
    """(name, ref) where no definition answers the reference."""
    return references(defined).join(defined.select(F.col("name").alias("ref")).distinct(), "ref", "left_anti").select("name", "ref")


def closure(edges: DataFrame) -> DataFrame:
    """(name, ref): all that a definition refers to, directly or through others; a definition in a circle has itself.

    Each round joins what is known with itself, so that circles and chains of any length take as many rounds as the
    length has binary digits.
    """
    known = stored(edges.select("name", "ref").distinct(), "edges")
    while True:
        through = known.join(known.select(F.col("name").alias("ref"), F.col("ref").alias("end")), "ref").select("name", F.col("end").alias("ref"))
        grown = stored(known.unionAll(through).distinct(), "edges")
        if grown.count() == known.count():
            return grown
        known = grown


def spark_type(known: dict[str, dict], definition: dict, nsid: str, depth: int = 8) -> T.DataType:
    """The Spark type of a definition; unions, unknowns and deep recursion stay JSON text."""
    kind = definition.get("type")
    if kind == "record":
        return spark_type(known, definition["record"], nsid, depth)
    if kind == "ref" and depth:
        ref = full_ref(definition["ref"], nsid)
        return spark_type(known, known[ref], ref.split("#")[0], depth - 1) if ref in known else T.StringType()
    if kind == "object":
        return T.StructType([T.StructField(k, spark_type(known, v, nsid, depth)) for k, v in definition.get("properties", {}).items()])
    if kind == "array":
        return T.ArrayType(spark_type(known, definition["items"], nsid, depth))
    if kind == "blob":
        return T.StructType([T.StructField("ref", T.StringType()), T.StructField("mimeType", T.StringType()), T.StructField("size", T.LongType())])
    return {"integer": T.LongType(), "boolean": T.BooleanType(), "bytes": T.BinaryType()}.get(kind, T.StringType())


def violations(known: dict[str, dict], nsid: str, record: object) -> list[tuple[str, str]]:
    """(path, message) of everything in a record that its schema doesn't allow."""
    main = known.get(f"{nsid}#main")
    if main is None or main.get("type") != "record":
        return [("", "no such record schema")]
    if not isinstance(record, dict):
        return [("", "not an object")]
    out: list[tuple[str, str]] = []
    if record.get("$type", nsid) != nsid:
        out.append(("$type", "is another collection's"))
    _object(known, nsid, "", main["record"], record, out)
    return out


def _object(known, nsid, path, definition, value, out) -> None:
    nullable = definition.get("nullable", [])
    for key in definition.get("required", []):
        if key not in value:
            out.append((f"{path}{key}", "is required"))
        elif value[key] is None and key not in nullable:
            out.append((f"{path}{key}", "may not be null"))
    for key, field in definition.get("properties", {}).items():
        if key in value and not (value[key] is None and key in nullable):
            _value(known, nsid, f"{path}{key}", field, value[key], out)


def _value(known, nsid, path, f, v, out) -> None:
    kind = f.get("type")
    say = lambda text: out.append((path, text))
    if kind == "ref":
        ref = full_ref(f["ref"], nsid)
        return _value(known, ref.split("#")[0], path, known[ref], v, out) if ref in known else say("refers to nothing")
    if kind == "union":
        if not isinstance(v, dict) or not isinstance(v.get("$type"), str):
            return say("has no $type")
        ref = full_ref(v["$type"], nsid)
        if ref in {full_ref(r, nsid) for r in f.get("refs", [])}:
            return _value(known, ref.split("#")[0], path, known[ref], v, out) if ref in known else None
        return say("is no member of the union") if f.get("closed") else None
    if kind == "object" or kind == "unknown" or kind == "record":
        if not isinstance(v, dict):
            return say("is not an object")
        return _object(known, nsid, f"{path}/", f["record"] if kind == "record" else f, v, out) if kind != "unknown" else None
    if kind == "array":
        if not isinstance(v, list):
            return say("is not an array")
        if f.get("minLength", 0) and len(v) < f["minLength"] or f.get("maxLength", 0) and len(v) > f["maxLength"]:
            say("has a wrong number of items")
        for i, item in enumerate(v):
            _value(known, nsid, f"{path}/{i}", f["items"], item, out)
        return None
    if kind == "integer":
        if isinstance(v, float) and v.is_integer() and -(2.0**63) <= v < 2.0**63:
            v = int(v)
        if not isinstance(v, int) or isinstance(v, bool):
            return say("is not an integer")
        if "const" in f and v != (f["const"] if isinstance(f["const"], int) else 0):
            say("is not the constant")
        if f.get("minimum") is not None and v < f["minimum"] or f.get("maximum") is not None and v > f["maximum"]:
            say("is out of range")
        return say("is not in the list") if f.get("enum") and v not in f["enum"] else None
    if kind == "boolean":
        if not isinstance(v, bool):
            return say("is not a boolean")
        return say("is not the constant") if isinstance(f.get("const"), bool) and v != f["const"] else None
    if kind == "bytes":
        raw = _bytes(v.get("$bytes")) if isinstance(v, dict) else None
        if raw is None:
            return say("is not bytes")
        size = len(raw)
        return say("has a wrong size") if f.get("minLength", 0) and size < f["minLength"] or f.get("maxLength", 0) and size > f["maxLength"] else None
    if kind == "cid-link":
        link = v.get("$link") if isinstance(v, dict) else None
        return None if isinstance(link, str) and _cid(link) else say("is not a link")
    if kind == "blob":
        if not _is_blob(v):
            return say("is not a blob")
        accept = f.get("accept")
        if accept and not any(a in ("*/*", v["mimeType"]) or a.endswith("/*") and v["mimeType"].startswith(a[:-1]) for a in accept):
            say("has a type that is not accepted")
        return say("is too large") if f.get("maxSize", 0) and v["size"] > f["maxSize"] else None
    if not isinstance(v, str):
        return say("is not text")
    if isinstance(f.get("const"), str) and v != f["const"]:
        say("is not the constant")
    if f.get("enum") and v not in f["enum"]:
        say("is not in the list")
    size = len(v.encode())
    if f.get("minLength", 0) and size < f["minLength"] or f.get("maxLength", 0) and size > f["maxLength"]:
        say("has a wrong length")
    if f.get("minGraphemes", 0) or f.get("maxGraphemes", 0):
        n = len(regex.findall(r"\X", v))
        if f.get("minGraphemes", 0) and n < f["minGraphemes"] or f.get("maxGraphemes", 0) and n > f["maxGraphemes"]:
            say("has a wrong number of characters")
    check = _CHECKS.get(f.get("format", ""))
    return say(f"is no {f['format']}") if check and not check(v) else None


def validate(records: DataFrame, known: dict[str, dict], keys: list[str], collection: str = "collection", record: str = "record") -> DataFrame:
    """``keys`` and ``violations``, an array of (path, message), of JSON records."""
    shape = ", ".join(f"`{k}` {records.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("path", pa.string()), ("message", pa.string())]))
        for batch in batches:
            found = []
            for nsid, text in zip(batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1).to_pylist(), strict=True):
                try:
                    wrong = violations(known, nsid, json.loads(text))
                except (TypeError, ValueError):
                    wrong = [("", "not JSON")]
                except RecursionError:
                    wrong = [("", "is too deep")]
                found.append([{"path": p, "message": m} for p, m in wrong])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(found, kind)], [*keys, "violations"])

    return records.select(*keys, F.col(collection), F.col(record)).mapInArrow(run, f"{shape}, violations array<struct<path:string,message:string>>")

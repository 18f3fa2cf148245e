"""Binary records by collection: what kind a record is without decoding it, and typed rows of each collection.

A chain of schema catalogues is tried in order; the first that has the collection decodes the record into the Spark
type that its schema compiles to. A typed DataFrame has one struct column for each collection asked for, of which a row
has at most one, so that later steps read the columns of their collection alone.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from skeinwork.functions.cbor import Link, decode_at, fields_at, peek_text, skipped, to_plain
from skeinwork.operators.lexicon import spark_type

Catalogue = dict[str, dict]


def peeked(rows: DataFrame, keys: list[str], data: str = "data", field: str = "$type") -> DataFrame:
    """``keys``, ``kind`` (the text under ``field`` of each record) and ``error``; the rest of a record is skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, errors = [], []
            for x in batch.column(len(keys)).to_pylist():
                kind = error = None
                try:
                    kind = peek_text(x or b"", field)
                except ValueError as why:
                    error = str(why)
                kinds.append(kind)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(kinds, pa.string()), pa.array(errors, pa.string())], [*keys, "kind", "error"])

    shape = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.select(*keys, data).mapInArrow(run, f"{shape}, kind string, error string")


def _cast(value: object, kind: T.DataType) -> object:
    """A decoded value as its column has it; what doesn't fit is an error."""
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        if not isinstance(value, dict):
            raise ValueError("not an object")
        return {f.name: _cast(value.get(f.name), f.dataType) for f in kind.fields}
    if isinstance(kind, T.ArrayType):
        if not isinstance(value, list):
            raise ValueError("not an array")
        return [_cast(v, kind.elementType) for v in value]
    if isinstance(kind, T.StringType):
        return value if isinstance(value, str) else str(value) if isinstance(value, Link) else json.dumps(to_plain(value), ensure_ascii=False, separators=(",", ":"))
    wanted = {T.LongType: int, T.BooleanType: bool, T.BinaryType: bytes}[type(kind)]
    if type(value) is not wanted:
        raise ValueError(f"not {kind.simpleString()}")
    return value


def decoded(data: bytes, kind: T.StructType) -> dict:
    """The fields of a record that its type has; others are skipped, and bytes after the record are an error."""
    wanted, out = {f.name: f.dataType for f in kind.fields}, {}
    for name, at in fields_at(data):
        if name in wanted:
            out[name] = _cast(decode_at(data, at)[0], wanted[name])
    if skipped(data, 0) != len(data):
        raise ValueError("trailing bytes")
    return out


def chained(chain: list[Catalogue], collection: str) -> T.StructType | None:
    """The type of a collection's records by the first catalogue that has it."""
    for known in chain:
        main = known.get(f"{collection}#main")
        if main is not None and main.get("type") == "record":
            return spark_type(known, main, collection)
    return None


def typed(rows: DataFrame, chain: list[Catalogue], collections: dict[str, str], keys: list[str], collection: str = "collection", data: str = "data") -> DataFrame:
    """``keys``, a struct for each of ``collections`` (column name to collection), and ``error``.

    A row without data (a deletion) has neither struct nor error; a collection that no catalogue has is the error
    ``unknown collection``, and one that isn't asked for is left undecoded.
    """
    types = {c: chained(chain, c) for c in collections.values()}
    missing = sorted(c for c, t in types.items() if t is None)
    if missing:
        raise ValueError(f"no schema for {', '.join(missing)}")
    all_known = {name.removesuffix("#main") for known in chain for name, d in known.items() if name.endswith("#main") and d.get("type") == "record"}
    arrow = {c: to_arrow_type(t) for c, t in types.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            found: dict[str, list] = {c: [None] * n for c in types}
            errors: list[str | None] = [None] * n
            for i, (name, x) in enumerate(zip(batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1).to_pylist(), strict=True)):
                if x is None:
                    continue
                if name not in all_known:
                    errors[i] = "unknown collection"
                elif name in types:
                    try:
                        found[name][i] = decoded(x, types[name])
                    except ValueError as why:
                        errors[i] = str(why)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *(pa.array(found[c], arrow[c]) for c in collections.values()), pa.array(errors, pa.string())], [*keys, *collections, "error"])

    shape = T.StructType([*(rows.schema[k] for k in keys), *(T.StructField(name, types[c]) for name, c in collections.items()), T.StructField("error", T.StringType())])
    return rows.select(*keys, F.col(collection), F.col(data)).mapInArrow(run, shape)

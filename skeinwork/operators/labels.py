"""Labels: rows (src, uri, val, neg, cts) that say something of a subject, or take it back."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.functions.cbor import encode

VERSION = 1
#: The fields of a label that are signed.
FIELDS = ("src", "uri", "cid", "val", "neg", "cts", "exp", "ver")


def exploded(frames: DataFrame, labels: str = "labels") -> DataFrame:
    """A row for each label of each frame, with its ``place`` in it."""
    return frames.select(F.posexplode(labels).alias("place", "l")).select("l.*", "place")


def current(labels: DataFrame) -> DataFrame:
    """(src, uri, val, cts): the labels in force, those whose newest row isn't a negation."""
    newest = labels.groupBy("src", "uri", "val").agg(F.max(F.struct("cts", "neg")).alias("l"))
    return newest.where("NOT l.neg").select("src", "uri", "val", "l.cts")


def made(src: Column, uri: Column, val: Column, negated: Column, us: Column) -> Column:
    """A new label of a time in microseconds, to the second; ``neg`` is set for a negation only."""
    cts = F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.timestamp_micros(us).cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.struct(src.alias("src"), uri.alias("uri"), val.alias("val"), F.when(negated, True).alias("neg"), F.lit(VERSION).alias("ver"), cts.alias("cts"))


def content(label: dict) -> bytes:
    """What a label's signature covers: its fields that are set, without type and signature."""
    return encode({k: v for k, v in label.items() if k in FIELDS and v is not None})


def signable(rows: DataFrame, key: str, label: str = "label") -> DataFrame:
    """(key, content): the bytes to sign or to verify of each label, a struct."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [None if x is None else content(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], [key, "content"])

    return rows.select(key, label).mapInArrow(run, f"{key} {kind}, content binary")

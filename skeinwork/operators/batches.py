"""Batches of a stream as it arrives: of a size, of a time, and cut before every error.

Where a batch ends depends on where it began, and so on all before it. But a batch is short: from every event, the
begin of the next batch is known from the few events after it. Ranges of the stream turn these steps into one table
each (which place of the range's first events leads to which place of the next range), and tables of neighbouring
ranges are joined to tables of twice as many ranges, until each range knows where it is entered. No task sees the stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skeinwork.session import stored

SIZE, SPAN_US = 50, 500_000


def numbered(events: DataFrame, order: list[str], width: int) -> DataFrame:
    """``_nth``, the place of every event in the stream from 0; ranges of the first column are ranked apart."""
    ranged = events.withColumn("_span", F.floor(F.col(order[0]) / width))
    counts = ranged.groupBy("_span").agg(F.count("*").alias("_n"))
    starts = counts.select("_span", F.coalesce(F.sum("_n").over(W.orderBy("_span").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    ranked = ranged.withColumn("_in", F.row_number().over(W.partitionBy("_span").orderBy(*order)) - 1)
    return ranked.join(starts, "_span").withColumn("_nth", F.col("_start") + F.col("_in")).drop("_span", "_start", "_in")


def following(times: np.ndarray, errors: np.ndarray, size: int, span: int) -> np.ndarray:
    """For each event, where the batch after the one that it begins begins; an error is alone."""
    n = len(times)
    at = np.arange(n)
    after = np.minimum(at + size, np.searchsorted(times, times + span, "left"))
    bad = np.append(np.flatnonzero(errors), n + size)
    after = np.minimum(after, bad[np.searchsorted(bad, at)])
    return np.where(errors, at + 1, np.maximum(after, at + 1))


def timed_batches(events: DataFrame, error: str, time: str = "us", seq: str = "seq", size: int = SIZE, span: int = SPAN_US, width: int = 1 << 32, length: int = 1 << 16) -> DataFrame:
    """``events`` with ``batch``, the place of the batch's first event in the stream.

    Events arrive in the order of (``time``, ``seq``). A batch ends with ``size`` events, before the first event that
    comes ``span`` or more after its first, and before an event whose column ``error`` is true, which is a batch of its
    own. Ranges of ``width`` microseconds are ranked apart; a task steps through ``length`` events.
    """
    if length <= size:
        raise ValueError("a range must be longer than a batch")
    placed = stored(numbered(events, [time, seq], width), "placed")
    own = F.floor(F.col("_nth") / length)
    # the first events of a range are also seen by the range before, whose last batches reach into it
    seen = placed.select(F.col("_nth").alias("nth"), F.col(time).alias("t"), F.coalesce(F.col(error), F.lit(False)).alias("bad"), F.explode(F.when((F.col("_nth") % length < size) & (own > 0), F.array(own - 1, own)).otherwise(F.array(own))).alias("range"))

    def steps(group: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
        group = group.sort_by("nth")
        nth = group.column("nth").to_numpy()
        after = following(group.column("t").to_numpy(), group.column("bad").to_numpy(), size, span)
        return int(group.column("range")[0].as_py()), nth, after

    def table_of(group: pa.Table) -> pa.Table:
        """Where the range is left, for each of the places where it may be entered."""
        number, nth, after = steps(group)
        n = int((nth // length == number).sum())
        out = np.arange(n + size)
        for k in range(n - 1, -1, -1):
            out[k] = out[after[k]] if after[k] < n else after[k]
        entries = np.arange(min(size, n))
        exits = out[entries] - n if n == length else np.zeros(len(entries), np.int64)
        return pa.table({"range": pa.array([number] * len(entries), pa.int64()), "entry": pa.array(entries, pa.int64()), "leave": pa.array(exits, pa.int64())})

    tables = stored(seen.groupBy("range").applyInArrow(table_of, "range bigint, entry bigint, leave bigint"), "steps")
    last = tables.agg(F.max("range")).first()[0] or 0
    # `whole` leads from the entry of the range `reach` before, or of the stream, to where a range is left
    whole, reach = tables, 1
    while reach <= last:
        earlier = whole.select((F.col("range") + reach).alias("range"), F.col("entry").alias("_entry"), F.col("leave").alias("entry"))
        joined = earlier.join(whole, ["range", "entry"]).select("range", F.col("_entry").alias("entry"), "leave")
        whole = stored(joined.unionByName(whole.where(F.col("range") < reach)), "steps")
        reach *= 2
    entered = whole.where("entry = 0").select((F.col("range") + 1).alias("range"), F.col("leave").alias("entry"))

    def batches_of(group: pa.Table, entry: pa.Table) -> pa.Table:
        names = ["_nth", "batch"]
        if not group.num_rows:
            return pa.table([pa.array([], pa.int64())] * 2, names=names)
        number, nth, after = steps(group)
        n, k = int((nth // length == number).sum()), int(entry.column("entry")[0].as_py()) if entry.num_rows else 0
        begins = []
        while k < n:
            begins.append(k)
            k = int(after[k])
        begins = np.array(begins, np.int64)
        members = np.arange(begins[0] if len(begins) else n, min(k, len(nth)))
        found = begins[np.searchsorted(begins, members, "right") - 1] if len(begins) else begins
        return pa.table([pa.array(nth[members]), pa.array(nth[found])], names=names)

    said = seen.groupBy("range").cogroup(entered.groupBy("range")).applyInArrow(batches_of, "_nth bigint, batch bigint")
    return placed.join(said, "_nth").drop("_nth")

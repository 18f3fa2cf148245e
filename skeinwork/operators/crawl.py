"""Crawling a directory of repositories: reconciling a listing with a state table, batching, retries and rate limits."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Retries of either kind, status codes worth another try, and the resync limit (per minute, at once).
MAX_TRANSIENT, MAX_RATE_LIMITED = 3, 20
TRANSIENT_CODES, RATE_LIMITED = [429, 500, 502, 503, 504], 429
TRANSIENT_NAMES = ["connection reset", "connection refused", "unexpected end", "timeout"]
RESYNC_PER_MINUTE, RESYNC_BURST = 5, 5


def reconcile(listing: DataFrame, state: DataFrame) -> DataFrame:
    """(did, active, state, action, dispatch) of every listed repository.

    An unknown one is discovered, a known one whose activity differs is updated; an active one that isn't complete is
    dispatched. ``state`` has (did, state, active).
    """
    held = state.select("did", "state", F.col("active").alias("was_active"))
    joined = listing.join(held, "did", "left")
    unknown = F.coalesce("state", F.lit("")) == ""
    action = F.when(unknown, "discover").when(~F.col("was_active").eqNullSafe(F.col("active")), "update")
    dispatch = F.col("active") & (F.coalesce("state", F.lit("")) != "complete")
    return joined.select(*listing.columns, F.coalesce("state", F.lit("")).alias("state"), action.alias("action"), dispatch.alias("dispatch"))


def merged_state(listing: DataFrame, state: DataFrame) -> DataFrame:
    """(did, state, active) after a listing was reconciled; repositories that aren't listed keep their rows."""
    new = listing.select("did", F.col("active").alias("now_active"))
    joined = state.join(new, "did", "full_outer")
    known = F.when(F.coalesce("state", F.lit("")) == "", "discovered").otherwise(F.col("state"))
    return joined.select("did", known.alias("state"), F.coalesce("now_active", "active").alias("active"))


def page_batches(listing: DataFrame, page: int = 100, batch: int = 250, place: str = "place") -> DataFrame:
    """``page`` and ``batch`` numbers from places that count from 1: a batch ends with the page that fills it.

    All pages but the last are full, so the batches follow from the place alone.
    """
    pages = -(-batch // page)
    return listing.withColumn("page", F.floor((F.col(place) - 1) / page)).withColumn("batch", F.floor((F.col(place) - 1) / (page * pages)))


def is_transient(status: Column, error: Column) -> Column:
    """Whether a failure is worth another try: a status code of the list, else a broken or late connection."""
    return F.coalesce(F.when(status.isNotNull(), status.isin(TRANSIENT_CODES)).otherwise(error.isin(TRANSIENT_NAMES)), F.lit(False))


def is_retryable(error: Column, reason: Column, cause: Column) -> Column:
    """Whether a failed resync may run again: not where the same answer would come back."""
    final = (reason == "account_inactive") | cause.isin("SignatureError", "RevRegressionError")
    return F.coalesce(F.when(error == "ResyncRateLimited", True).when(error == "ResyncFailed", ~F.coalesce(final, F.lit(False))), F.lit(False))


def retried(attempts: DataFrame, key: str = "did", order: str = "attempt") -> DataFrame:
    """(key, outcome, attempts) from a log of attempts with ``status`` and ``error`` (both null: it went well).

    Rate limits and other transient failures have budgets of their own; what comes after the attempt that settles a
    key never happens. A key that nothing settles is ``retrying``.
    """
    own = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    limited = F.coalesce(F.col("status") == RATE_LIMITED, F.lit(False))
    well = F.col("status").isNull() & F.col("error").isNull()
    transient = is_transient(F.col("status"), F.col("error")) & ~limited
    counted = attempts.withColumns({"_limited": F.count_if(limited).over(own), "_transient": F.count_if(transient).over(own), "_nth": F.row_number().over(W.partitionBy(key).orderBy(order))})
    settled = (
        F.when(well, "complete")
        .when(F.coalesce(F.col("error") == "download timeout", F.lit(False)), "failed")
        .when(limited, F.when(F.col("_limited") > MAX_RATE_LIMITED, "failed"))
        .when(~transient | (F.col("_transient") > MAX_TRANSIENT), "failed")
    )
    said = counted.withColumn("_settled", settled)
    first = F.min_by(F.struct("_settled", "_nth"), F.when(F.col("_settled").isNotNull(), F.col("_nth")))
    out = said.groupBy(key).agg(first.alias("f"), F.max("_nth").alias("_all"))
    return out.select(key, F.coalesce("f._settled", F.lit("retrying")).alias("outcome"), F.coalesce("f._nth", "_all").cast("long").alias("attempts"))


def allowed(requests: DataFrame, per_minute: float = RESYNC_PER_MINUTE, burst: int = RESYNC_BURST, key: str = "repo", order: str = "us") -> DataFrame:
    """(seq, key, allowed): a token bucket for each key, filled by time, emptied by what it allows.

    A fold in order; it runs over partitions sorted by key and time and holds one key's state at a time.
    """
    kind = requests.schema[key].dataType.simpleString()
    every = 60_000_000 / per_minute

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at, tokens = None, 0, float(burst)
        for batch in batches:
            said = []
            for k, now in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k != last:
                    last, at, tokens = k, now, float(burst)
                tokens, at = min(float(burst), tokens + (now - at) / every), now
                said.append(tokens >= 1)
                tokens -= tokens >= 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(said, pa.bool_())], ["seq", key, "allowed"])

    ordered = requests.select("seq", key, order).repartition(key).sortWithinPartitions(key, order, "seq")
    return ordered.mapInArrow(run, f"seq bigint, {key} {kind}, allowed boolean")


def spread(jobs: DataFrame, parts: int, seed: int = 1) -> DataFrame:
    """Jobs dealt out at random, so that no task gets all of one host's."""
    return jobs.repartition(parts, F.xxhash64(F.lit(seed), *jobs.columns))

"""Order-sensitive operators on event streams, in batch form: windows partitioned by repository.

Only the gap check is about the whole stream's order; it runs over ranges of the sequence, so no task sees it all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Limits of a commit.
MAX_BYTES, MAX_OPS, VERSION = 2_000_000, 200, 3
TOLERANCE = 300_000_000


def gaps(events: DataFrame, seq: str = "seq", start: int | None = None, width: int = 1 << 20, order: str | None = None) -> DataFrame:
    """(expected, got) where a number comes that is more than one above the number before it; ``start`` is the last
    number seen before the first.

    ``order`` is the column of arrival, by default the number itself. After a number that goes back, the next ones are
    held against it. Ranges of ``width`` of the order are looked at apart, then each range's first number against the
    last one of the range before, over one row for each range.
    """
    at = order or seq
    rows = events.select(F.col(at).alias("_at"), F.col(seq).alias("_n"), F.floor(F.col(at) / width).alias("span")).where("_at IS NOT NULL AND _n IS NOT NULL")
    inside = rows.withColumn("last", F.lag("_n").over(W.partitionBy("span").orderBy("_at", "_n")))
    place = F.struct("_at", "_n")
    edges = rows.groupBy("span").agg(F.min_by("_n", place).alias("first"), F.max_by("_n", place).alias("end"))
    before = F.coalesce(F.lag("end").over(W.orderBy("span")), F.lit(start).cast("long"))
    joins = edges.select(before.alias("last"), F.col("first").alias("_n"))
    every = inside.select("last", "_n").unionByName(joins).where("last IS NOT NULL")
    return every.where(F.col("_n") > F.col("last") + 1).select((F.col("last") + 1).alias("expected"), F.col("_n").alias("got"))


def _before(key: str, order: str) -> W:
    return W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)


def drop_replays(events: DataFrame, key: str = "repo", order: str = "seq", version: str = "rev") -> DataFrame:
    """The events whose version is above every earlier one of their key."""
    best = F.max(version).over(_before(key, order))
    return events.withColumn("_best", best).where(F.col("_best").isNull() | (F.col(version) > F.col("_best"))).drop("_best")


def rev_regressions(commits: DataFrame) -> DataFrame:
    """Commits with an older rev than the one before, or the same rev with other data."""
    own = W.partitionBy("repo").orderBy("seq")
    seen = commits.withColumns({"last_rev": F.lag("rev").over(own), "last_cid": F.lag("cid").over(own)})
    return seen.where((F.col("rev") < F.col("last_rev")) | ((F.col("rev") == F.col("last_rev")) & ~F.col("cid").eqNullSafe(F.col("last_cid"))))


def chain_breaks(commits: DataFrame) -> DataFrame:
    """Commits whose ``prev_data`` is not the data of the commit before; a first commit breaks nothing."""
    last = F.lag("data").over(W.partitionBy("repo").orderBy("seq"))
    return commits.withColumn("last_data", last).where("last_data IS NOT NULL AND NOT (prev_data <=> last_data)")


def latest_hosting(accounts: DataFrame) -> DataFrame:
    """(did, active, status, seq): the newest account event of each, replays and all."""
    return accounts.groupBy("did").agg(F.max_by(F.struct("active", "status"), "seq").alias("a"), F.max("seq").alias("seq")).select("did", "a.*", "seq")


def hosting_gate(events: DataFrame, hosting: DataFrame) -> DataFrame:
    """The events of accounts that are not known to be inactive."""
    return events.join(hosting.where("NOT active").select(F.col("did").alias("repo")), "repo", "left_anti")


def next_tids(times: DataFrame, key: str = "repo", order: str = "seq", us: str = "us") -> DataFrame:
    """Strictly increasing microseconds in order: max(now, last + 1), at most 2^53 - 1.

    With the rank r of a row the fold is r + the running maximum of (us - r).
    """
    own = W.partitionBy(key).orderBy(order)
    rank = F.row_number().over(own)
    run = F.max(F.col("_lead")).over(own.rowsBetween(W.unboundedPreceding, 0))
    return times.withColumn("_rank", rank).withColumn("_lead", F.col(us) - F.col("_rank")).withColumn("tick", F.least(run + F.col("_rank"), F.lit((1 << 53) - 1))).drop("_rank", "_lead")


def low_water(events: DataFrame) -> DataFrame:
    """One row: the cursor that is safe to keep, from rows (seq, done): before the first unfinished, else the last."""
    return events.agg(F.coalesce(F.min(F.when(~F.col("done"), F.col("seq"))) - 1, F.max("seq")).alias("cursor"))


def micro_batches(events: DataFrame, size: int = 50, order: str = "seq", key: str | None = None, width: int = 1 << 20) -> DataFrame:
    """``batch`` numbers of ``size`` events each in order, whatever numbers are missing; within each ``key`` where given,
    else over the stream.

    Without a key, events are ranked within ranges of ``width`` of the order, and each range starts where the ranges
    before it end, which takes one row for each range and no task that sees the stream.
    """
    if key is not None:
        return events.withColumn("batch", F.floor((F.row_number().over(W.partitionBy(key).orderBy(order)) - 1) / size))
    ranged = events.withColumn("_span", F.floor(F.col(order) / width))
    counts = ranged.groupBy("_span").agg(F.count("*").alias("_n"))
    starts = counts.select("_span", F.coalesce(F.sum("_n").over(W.orderBy("_span").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    ranked = ranged.withColumn("_nth", F.row_number().over(W.partitionBy("_span").orderBy(order)) - 1)
    placed = ranked.join(starts, ranked["_span"].eqNullSafe(starts["_span"])).drop("_span")
    return placed.withColumn("batch", F.floor((F.col("_start") + F.col("_nth")) / size)).drop("_start", "_nth")


def newest_of_key(events: DataFrame, most: int, key: str = "repo", order: str = "seq") -> DataFrame:
    """The newest ``most`` events of each key: a full queue drops its oldest."""
    nth = F.row_number().over(W.partitionBy(key).orderBy(F.col(order).desc()))
    return events.withColumn("_nth", nth).where(F.col("_nth") <= most).drop("_nth")


def key_order(events: DataFrame, key: str = "repo", order: str = "seq") -> DataFrame:
    """Events of a key in one partition and in order."""
    return events.repartition(key).sortWithinPartitions(key, order)


def cursor(seq: Column, time_us: Column) -> Column:
    """An event's cursor: its sequence number, else its time."""
    return F.coalesce(F.nullif(seq, F.lit(0)), time_us)


# --- stateless gates of a commit -------------------------------------------------------------------------


def future_rev(rev_us: Column, now_us: Column, tolerance: int = TOLERANCE) -> Column:
    """Whether a rev lies further ahead than the tolerance; negative tolerances switch the gate off."""
    return F.lit(tolerance >= 0) & F.coalesce(rev_us > now_us + tolerance, F.lit(False))


def size_error(n_bytes: Column, n_ops: Column) -> Column:
    return F.when(n_bytes > MAX_BYTES, "blocks").when(n_ops > MAX_OPS, "ops")


def legacy_shape(prev_data: Column, ops: Column) -> Column:
    """No previous data, at least one op, and no update or delete that names what it replaces."""
    named = F.exists(ops, lambda o: o["action"].isin("update", "delete") & o["prev"].isNotNull())
    return prev_data.isNull() & (F.size(ops) > 0) & ~named


def field_mismatch(version: Column, repo: Column, did: Column, rev: Column, inner_rev: Column) -> Column:
    """The first field in which envelope and signed commit differ."""
    return F.when(version != VERSION, "version").when(~repo.eqNullSafe(did), "did").when(~rev.eqNullSafe(inner_rev), "rev")


def outcome_counts(events: DataFrame, outcome: str = "outcome") -> DataFrame:
    return events.groupBy(outcome).agg(F.count("*").alias("n"))


# --- syncs and resyncs -----------------------------------------------------------------------------------


def sync_outcomes(syncs: DataFrame, state: DataFrame) -> DataFrame:
    """(seq, repo, outcome) of sync events (seq, repo, rev, data): replayed, unchanged, or in need of a resync.

    ``state`` has (repo, rev, data); a repository without state is fetched.
    """
    held = state.select("repo", F.col("rev").alias("held_rev"), F.col("data").alias("held_data"))
    said = F.when(F.col("rev") <= F.col("held_rev"), "replayed").when(F.col("data") == F.col("held_data"), "unchanged").otherwise("resync")
    return syncs.join(held, "repo", "left").select("seq", "repo", said.alias("outcome"))


def resync_ops(wanted: DataFrame, records: DataFrame) -> DataFrame:
    """(seq, repo, action, path, cid, n_ops): all records of each wanted repository (seq, repo); an empty one gives a
    marker row without a path, as it still replaces what was known."""
    joined = wanted.select("seq", "repo").join(records.select("repo", F.col("key").alias("path"), "cid"), "repo", "left")
    count = wanted.select("repo").distinct().join(records, "repo", "left").groupBy("repo").agg(F.count("cid").alias("n_ops"))
    return joined.join(count, "repo").select("seq", "repo", F.lit("resync").alias("action"), "path", "cid", "n_ops")


def dropped(events: DataFrame, most: int, key: str = "repo", order: str = "seq") -> DataFrame:
    """(key, n_dropped, last): how many events a full queue of each key drops, and the newest of them."""
    nth = F.row_number().over(W.partitionBy(key).orderBy(F.col(order).desc()))
    gone = events.withColumn("_nth", nth).where(F.col("_nth") > most)
    return gone.groupBy(key).agg(F.count("*").alias("n_dropped"), F.max(order).alias("last"))


def in_flight(events: DataFrame) -> DataFrame:
    """One row: the least unfinished number of rows (seq, done), 0 where all are finished."""
    return events.agg(F.coalesce(F.min(F.when(~F.col("done"), F.col("seq"))), F.lit(0)).alias("low"))

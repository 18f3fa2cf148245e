"""Mixing sources to target weights. JVM only.

Sizes are words. Sources in code-point order, null last, take the weights in turn and share ``budget``
times all words; no source may exceed ``cap`` times its own size, and what it can't take is shared by
weight among the others until none is above its cap. A document is taken floor(rate) times, and once more
where its hash-seeded uniform number lies below the rate's fraction. Null or empty texts have size 0; rows
that repeat draw alike; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skeinwork.llm.common import staged, word_count

#: The weights that sources take in turn.
WEIGHTS = [5, 2, 1]
SEED = 17
#: Sources up to this number are broadcast; a source is a name and a number.
BROADCAST_SOURCES = 10_000


def uniform(doc_id: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) that depends on the id alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def targets(sizes: DataFrame, weights: list[int] = WEIGHTS, budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """From rows (source, size): a row for each source with source_size and target.

    A source is at its cap where the level that all smaller cap-to-weight ratios leave is above its own
    ratio, so one running sum over the sources in that order settles every round of resharing. The windows
    run over one row for each source.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1))
    limit = F.lit(cap) * F.col("source_size")
    by_ratio = W.orderBy((limit / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, after, everything = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(0, W.unboundedFollowing), by_ratio.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.lit(budget) * F.sum("source_size").over(everything) - F.coalesce(F.lit(cap) * F.sum("source_size").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levelled = per.withColumns({"level": level, "limit": limit}).withColumn("capped", F.col("level") * F.col("weight") > F.col("limit"))
    # the level of the first source below its cap holds for all that follow
    rest = F.min_by(F.when(~F.col("capped"), F.col("level")), F.when(~F.col("capped"), F.struct(F.col("limit") / F.col("weight"), F.coalesce("source", F.lit("\U0010ffff"))))).over(W.partitionBy())
    return levelled.withColumn("rest", rest).select("source", "source_size", F.when(F.col("capped"), F.col("limit")).otherwise(F.col("rest") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """A row for each document: doc_id, source, size, source_size, target, copies, taken."""
    sized = docs.select("doc_id", "source", word_count(F.col(text)).alias("size"))
    per = targets(sized.select("source", "size"), **options).withColumnRenamed("source", "_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # a row for each source; Spark broadcasts it only while it measures small
    joined = sized.join(per, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    copies = F.floor(rate) + (uniform(F.col("doc_id")) < rate - F.floor(rate)).cast("long")
    return joined.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))


def emit(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The mix itself: every row of ``docs`` once for each copy taken, with ``copy`` (from 1) added."""
    sized = docs.withColumn("_size", word_count(F.col(text)))
    per = staged(targets(sized.select("source", F.col("_size").alias("size")), **options), "targets")
    per = per.select(F.col("source").alias("_source"), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("_rate"))
    if per.count() <= BROADCAST_SOURCES:
        per = F.broadcast(per)
    joined = docs.join(per, F.col("source").eqNullSafe(F.col("_source")))
    copies = F.floor("_rate") + (uniform(F.col("doc_id")) < F.col("_rate") - F.floor("_rate")).cast("long")
    taken = joined.withColumn("_copies", copies).where("_copies > 0")
    return taken.select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), "_copies")).alias("copy"))


ORACLE_TAIL = r"""
, per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source)
, weighed AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM per)
, ratio AS (SELECT *, 2.0::DOUBLE * source_size AS lim, 2.0::DOUBLE * source_size / weight AS r FROM weighed)
, levelled AS (SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT)
    - 2.0::DOUBLE * CAST(coalesce(sum(source_size) OVER (ORDER BY r, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT))
    / CAST(sum(weight) OVER (ORDER BY r, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level FROM ratio)
, flagged AS (SELECT *, level * weight > lim AS capped FROM levelled)
, rest AS (SELECT level AS rest FROM flagged WHERE NOT capped ORDER BY r, source NULLS LAST LIMIT 1)
, goal AS (SELECT source, source_size, CASE WHEN capped THEN lim ELSE (SELECT rest FROM rest) * weight END AS target FROM flagged)
, drawn AS (SELECT s.doc_id, s.size, g.source_size, g.target,
    CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0 END AS rate,
    CAST('0x' || substr(md5('17:' || coalesce(CAST(s.doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE AS u
    FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM drawn
"""
ORACLE_SIZES = r"SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM "
ORACLE_SQL = f"WITH sized AS ({ORACLE_SIZES} documents){ORACLE_TAIL}"

"""Repository jobs end to end: what was downloaded is checked, handed over, and settled once in a table of states.

A job's attempts come as rows, with the archive that was downloaded or with what the server said. An archive that
breaks off or lacks blocks is a transfer that ended early, and worth another try; a wrong signature or another
repository's commit is final. What settles a job goes to the state table with its host, error and attempts.

The state table is a folder of versions. A run writes the next version from the newest whole one; Spark marks a version
as whole when all of it is written, so a run that dies leaves no trace, and a run that is done again finds its version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skeinwork.functions import curves
from skeinwork.operators import crawl
from skeinwork.session import stored
from skeinwork.sources import repositories

STATE = "did string, state string, host string, error string, attempts bigint, rev string"
#: Fixed value: what a transfer that ended early is called.
ENDED = "unexpected end"


def _wrong() -> Column:
    cut = F.col("broken").contains("cut off") | F.col("broken").contains("unexpected end")
    lacking = (F.coalesce("missing_nodes", F.lit(0)) + F.coalesce("missing_records", F.lit(0))) > 0
    return F.when(cut, ENDED).when(F.col("broken").isNotNull(), "bad archive").when(lacking, ENDED).when(~F.col("own"), "field").when(~F.coalesce("valid", F.lit(False)), "signature")


def checked(attempts: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, did, attempt, host, status, error, rev) of attempts (did, attempt, host, status, error, archive), with the
    errors that their archives show, and the records (path, key, cid, data) of whole ones.

    ``keys`` has (repo, keys). An attempt without archive, status and error is a transfer that ended before it began.
    """
    named = attempts.withColumn("path", F.concat_ws("#", "did", "attempt"))
    went = F.col("archive").isNotNull() & F.col("status").isNull() & F.col("error").isNull()
    loaded, blocks = repositories.opened(named.where(went), "archive", "path")
    blocks = stored(blocks, "blocks")
    found = stored(repositories.walked(loaded.where("error IS NULL"), blocks), "walked")
    said = loaded.select("path", F.col("error").alias("broken"), F.col("did").alias("named"), "rev", "content", "signature")
    rows = named.withColumn("went", went).drop("archive").join(said, "path", "left").join(keys.withColumnRenamed("repo", "did"), "did", "left")
    rows = stored(rows, "loaded")
    signed = curves.verified(rows.where("content IS NOT NULL"), ["path"], "keys")
    full = rows.join(signed, "path", "left").join(repositories.completeness(found, blocks), "path", "left").withColumn("own", F.col("named").eqNullSafe(F.col("did")))
    error = F.when(F.col("went"), _wrong()).otherwise(F.coalesce("error", F.when(F.col("status").isNull(), ENDED)))
    return full.select("path", "did", "attempt", "host", "status", error.alias("error"), "rev"), repositories.records(found, blocks).where("error IS NULL").drop("error")


def settled(attempts: DataFrame) -> DataFrame:
    """(did, state, host, error, attempts, rev, path): the attempt that settles each job, or its last so far."""
    nth = F.row_number().over(W.partitionBy("did").orderBy("attempt")).cast("long")
    outcome = crawl.retried(attempts)
    rows = attempts.withColumn("attempts", nth).join(outcome, ["did", "attempts"])
    error = F.coalesce("error", F.concat(F.lit("status "), F.col("status").cast("string")))
    done = F.col("outcome") == "complete"
    return rows.select("did", F.col("outcome").alias("state"), "host", error.alias("error"), "attempts", F.when(done, F.col("rev")).alias("rev"), "path")


# --- the state table -----------------------------------------------------------------------------------------


def versions(spark: SparkSession, folder: str) -> list[tuple[int, str]]:
    """(version, run) of all whole versions, in order."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        return []
    out = []
    for f in files.listStatus(at):
        name = f.getPath().getName()
        if name.startswith("version=") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS")):
            number, run = name.removeprefix("version=").split("-", 1)
            out.append((int(number), run))
    return sorted(out)


def states(spark: SparkSession, folder: str) -> DataFrame:
    """The newest whole version of the state table."""
    whole = versions(spark, folder)
    if not whole:
        return spark.createDataFrame([], STATE)
    number, run = whole[-1]
    return spark.read.schema(STATE).parquet(f"{folder}/version={number}-{run}")


def merged(spark: SparkSession, folder: str, outcomes: DataFrame, run: str) -> DataFrame:
    """The states with a run's ``outcomes`` in place of what was known, written once for each ``run``; complete jobs stay
    as they are."""
    whole = versions(spark, folder)
    if all(name != run for _, name in whole):
        names = [c.split()[0] for c in STATE.split(", ")]
        known, new = F.struct(*(f"k.{c}" for c in names)), F.struct(*(f"n.{c}" for c in names))
        joined = states(spark, folder).alias("k").join(outcomes.alias("n"), F.col("k.did") == F.col("n.did"), "full_outer")
        kept = F.when((F.col("k.state") == "complete") | F.col("n.did").isNull(), known).otherwise(new)
        number = whole[-1][0] + 1 if whole else 1
        joined.select(kept.alias("s")).select("s.*").write.mode("overwrite").parquet(f"{folder}/version={number}-{run}")
    return states(spark, folder)

"""Operations of all kinds of events as one table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.functions.identifiers import op_fields_error

COLUMNS = ["seq", "repo", "rev", "action", "collection", "rkey", "cid"]


def operations(commits: DataFrame | None = None, verified: DataFrame | None = None, looked_at: DataFrame | None = None, light: DataFrame | None = None, resyncs: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """(kind, ``COLUMNS``, error) of commits' ops, verified ops, a light feed's ops and resyncs' records.

    Every input has ``COLUMNS``, and ``error`` where it may have one. An event that a verifier looked at (``looked_at``
    has its seq) has its verified ops alone, which may be none. With ``strict`` an op with a field that breaks its
    syntax is replaced by the name of the field; ops that have an error already keep it.
    """
    if commits is not None and looked_at is not None:
        commits = commits.join(looked_at.select("seq").distinct(), "seq", "left_anti")
    found = None
    for kind, rows in (("commit", commits), ("verified", verified), ("light", light), ("resync", resyncs)):
        if rows is None:
            continue
        error = F.col("error") if "error" in rows.columns else F.lit(None).cast("string")
        shaped = rows.select(F.lit(kind).alias("kind"), *COLUMNS, error.alias("error"))
        found = shaped if found is None else found.unionByName(shaped)
    if not strict:
        return found
    wrong = F.when(F.col("error").isNull(), op_fields_error(F.col("repo"), F.col("collection"), F.col("rkey"), F.col("rev")))
    checked = found.withColumn("_wrong", wrong)
    blank = {c: F.when(F.col("_wrong").isNull(), F.col(c)).alias(c) for c in COLUMNS[1:]}
    return checked.select("kind", "seq", *blank.values(), F.coalesce("error", "_wrong").alias("error"))

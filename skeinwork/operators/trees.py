"""Repositories as flat maps: a row (repo, key, cid) for each record, so that tree operators are joins and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def walk(records: DataFrame) -> DataFrame:
    """The records of every repository in key order, within sorted partitions."""
    return records.repartition("repo").sortWithinPartitions("repo", "key")


def diff(old: DataFrame, new: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., key, action, old_cid, new_cid): what changed from ``old`` to ``new``; equal keys give no row."""
    keys = [*(by or ["repo"]), "key"]
    joined = old.withColumnRenamed("cid", "old_cid").join(new.withColumnRenamed("cid", "new_cid"), keys, "full_outer")
    action = F.when(F.col("old_cid").isNull(), "create").when(F.col("new_cid").isNull(), "delete").otherwise("update")
    return joined.where("NOT (old_cid <=> new_cid)").select(*keys, action.alias("action"), "old_cid", "new_cid")


def apply_ops(records: DataFrame, ops: DataFrame) -> DataFrame:
    """The records after the ops (repo, key, seq, action, cid): the last op of a key wins, deletes remove it."""
    last = ops.groupBy("repo", "key").agg(F.max_by(F.struct("action", "cid"), "seq").alias("op"))
    joined = records.join(last, ["repo", "key"], "full_outer")
    cid = F.when(F.col("op").isNull(), F.col("cid")).when(F.col("op.action") != "delete", F.col("op.cid"))
    return joined.select("repo", "key", cid.alias("cid")).where("cid IS NOT NULL")


def remove(records: DataFrame, gone: DataFrame) -> DataFrame:
    """The records without the keys in ``gone``; missing keys are no error."""
    return records.join(gone.select("repo", "key"), ["repo", "key"], "left_anti")


def invert(records: DataFrame, ops: DataFrame) -> DataFrame:
    """The records before the ops (repo, key, seq, action, cid, prev): of each key, the first op is undone last."""
    first = ops.groupBy("repo", "key").agg(F.min_by(F.struct("action", "prev"), "seq").alias("op"))
    undone = first.select("repo", "key", F.lit(0).alias("seq"), F.when(F.col("op.action") == "create", "delete").otherwise("create").alias("action"), F.col("op.prev").alias("cid"))
    return apply_ops(records, undone)


def get(records: DataFrame, keys: DataFrame) -> DataFrame:
    """(repo, key, cid) of the asked keys; cid is null where a key is absent."""
    return keys.select("repo", "key").join(records, ["repo", "key"], "left")


def read_records(records: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each record with its block's ``data``, and an error where the block is missing."""
    joined = records.join(blocks.select("cid", "data"), "cid", "left")
    return joined.withColumn("error", F.when(F.col("data").isNull(), F.concat(F.lit("missing block "), "cid")))


def missing_blocks(referenced: DataFrame, blocks: DataFrame) -> DataFrame:
    """(repo, cid) that are referenced but not stored."""
    return referenced.select("repo", "cid").distinct().join(blocks.select("repo", "cid"), ["repo", "cid"], "left_anti")


def put_blocks(blocks: DataFrame, more: DataFrame) -> DataFrame:
    """The store with more blocks; a content id is stored once."""
    return blocks.unionByName(more).dropDuplicates(["cid"])


def corrupt_blocks(blocks: DataFrame, computed: F.Column) -> DataFrame:
    """The blocks whose claimed ``cid`` is not the computed one."""
    return blocks.where(~F.col("cid").eqNullSafe(computed))


def latest_commit(commits: DataFrame) -> DataFrame:
    """(repo, rev, cid) of the newest commit of each repository."""
    return commits.groupBy("repo").agg(F.max("rev").alias("rev"), F.max_by("cid", "rev").alias("cid"))


def duplicate_paths(ops: DataFrame) -> DataFrame:
    """(repo, commit, path): the path that repeats first within a commit; ops have (repo, commit, place, path)."""
    nth = F.row_number().over(W.partitionBy("repo", "commit", "path").orderBy("place"))
    again = ops.withColumn("nth", nth).where("nth = 2")
    return again.groupBy("repo", "commit").agg(F.min_by("path", "place").alias("path"))


def op_cid_mismatch(ops: DataFrame, records: DataFrame) -> DataFrame:
    """(repo, commit, path, reason): the first op of each commit that the state after it does not bear out."""
    state = records.select("repo", F.col("key").alias("path"), F.col("cid").alias("held"))
    joined = ops.join(state, ["repo", "path"], "left")
    deletes = F.col("action") == "delete"
    reason = (
        F.when(deletes & F.col("held").isNotNull(), "delete_path_present")
        .when(deletes & F.col("cid").isNotNull(), "delete_unexpected_cid")
        .when(~deletes & F.col("cid").isNull(), F.concat("action", F.lit("_missing_cid")))
        .when(~deletes & ~F.col("cid").eqNullSafe(F.col("held")), F.concat("action", F.lit("_cid_mismatch")))
    )
    wrong = joined.withColumn("reason", reason).where("reason IS NOT NULL")
    return wrong.groupBy("repo", "commit").agg(F.min_by(F.struct("path", "reason"), "place").alias("w")).select("repo", "commit", "w.*")

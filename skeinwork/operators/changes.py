"""Ops on a stored Merkle tree: only the nodes that they touch are read, and only changed nodes are made.

From the root down, a round for each layer, every op follows the child that its key falls into; a key that goes also
takes the children on both its sides, as their edges meet when it is gone. What is read gives keys; children that no
op came to stay closed subtrees. The layers are then built from these keys and subtrees alone, so that the work is that
of the ops and their paths, whatever the size of the tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.operators import merkle
from skeinwork.session import stored

#: Parts into which the ops of one node are dealt; each part reads the node by itself.
PARTS = 16
_ROW = "repo string, node string, level int, entries array<struct<key:string,cid:string>>, children array<struct<after:string,cid:string>>, child string, lo string, hi string, key string, gone boolean"
_KINDS = pa.schema([("repo", pa.string()), ("node", pa.string()), ("level", pa.int32()), ("entries", pa.list_(pa.struct([("key", pa.string()), ("cid", pa.string())]))), ("children", pa.list_(pa.struct([("after", pa.string()), ("cid", pa.string())]))), *((n, pa.string()) for n in ("child", "lo", "hi", "key")), ("gone", pa.bool_())])


def followed(keys: list[str], lo: str | None, hi: str | None, key: str, gone: bool) -> list[int]:
    """The gaps between a node's keys that an op goes into; gap k is before key k. ``lo`` and ``hi`` bound the node."""
    at = sum(k < key for k in keys)
    if at < len(keys) and keys[at] == key:
        return [at, at + 1] if gone else []
    return [0] if key == lo else [len(keys)] if key == hi else [at]


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            entries, left = merkle.decode_node(row["data"])
            keys, below = [k for k, *_ in entries], [left, *(c for *_, c in entries)]
            level = merkle.level_of(keys[0]) if keys else row["level"]
            bounds = [row["lo"], *keys, row["hi"]]
            children = [{"after": bounds[k] or "", "cid": c} for k, c in enumerate(below) if c]
            out.append({"repo": row["repo"], "node": row["node"], "level": level, "entries": [{"key": k, "cid": c} for k, c, _ in entries], "children": children})
            for op in row["ops"]:
                for gap in followed(keys, row["lo"], row["hi"], op["key"], op["gone"]):
                    if below[gap]:
                        out.append({"repo": row["repo"], "level": level - 1, "child": below[gap], "lo": bounds[gap], "hi": bounds[gap + 1], **op})
        yield pa.RecordBatch.from_pylist(out, _KINDS)


def touched(blocks: DataFrame, heads: DataFrame, ops: DataFrame) -> DataFrame:
    """(repo, node, level, entries, children) of the nodes that ``ops`` (repo, key, cid; null for a key that goes) have
    to read in the trees of ``heads`` (repo, root); a node that ``blocks`` lack is an error."""
    start = ops.join(heads, "repo").select("repo", F.col("root").alias("node"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("lo"), F.lit(None).cast("string").alias("hi"), "key", F.col("cid").isNull().alias("gone"))
    held = blocks.select("repo", F.col("cid").alias("node"), "data")
    found, frontier = None, stored(start, "frontier")
    while not frontier.isEmpty():
        part = F.pmod(F.xxhash64("key"), F.lit(PARTS)).alias("part")
        asked = frontier.groupBy("repo", "node", "level", "lo", "hi", part).agg(F.collect_set(F.struct("key", "gone")).alias("ops"))
        read = asked.join(held, ["repo", "node"], "left").withColumn("data", F.coalesce("data", F.raise_error(F.concat(F.lit("missing node "), "node")).cast("binary")))
        said = stored(read.select("repo", "node", "level", "lo", "hi", "ops", "data").mapInArrow(_opened, _ROW), "opened")
        nodes = said.where("node IS NOT NULL").select("repo", "node", "level", "entries", "children").dropDuplicates(["repo", "node"])
        found = nodes if found is None else found.unionAll(nodes)
        frontier = said.where("child IS NOT NULL").select("repo", F.col("child").alias("node"), "level", "lo", "hi", "key", "gone")
    if found is None:
        found = start.select("repo", "node", "level", F.lit(None).cast("array<struct<key:string,cid:string>>").alias("entries"), F.lit(None).cast("array<struct<after:string,cid:string>>").alias("children"))
    return found


def changed(blocks: DataFrame, heads: DataFrame, ops: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(repo, root) after the ops, (repo, cid, data) of the nodes that weren't there before, and the nodes that were read.

    Repositories without ops keep their root; one that loses its last key has the root of an empty tree, and one without
    a head begins as an empty tree.
    """
    ops = stored(ops.select("repo", "key", "cid"), "ops")
    read = stored(touched(blocks, heads, ops), "touched")
    entry = read.select("repo", "level", F.explode("entries").alias("e")).select("repo", F.col("e.key").alias("key"), F.col("e.cid").alias("was"))
    now = entry.join(ops.withColumn("op", F.lit(True)), ["repo", "key"], "full_outer")
    keys = stored(now.select("repo", "key", F.when(F.col("op"), F.col("cid")).otherwise(F.col("was")).alias("cid")).where("cid IS NOT NULL"), "kept")
    below = read.select("repo", (F.col("level") - 1).alias("level"), F.explode("children").alias("c")).select("repo", "level", "c.after", "c.cid")
    closed = stored(below.join(read.select("repo", F.col("node").alias("cid")), ["repo", "cid"], "left_anti"), "closed")
    tops, nodes = merkle.tree_of(keys, closed)
    new = nodes.join(read.select("repo", F.col("node").alias("cid")), ["repo", "cid"], "left_anti")
    empty = merkle.encode_node([], None)
    emptied = ops.select("repo").distinct().join(tops.select("repo"), "repo", "left_anti")
    root = F.lit(str(merkle.cid_of(empty)))
    kept = heads.join(ops.select("repo").distinct(), "repo", "left_anti").select("repo", "root")
    after = tops.unionByName(emptied.select("repo", root.alias("root"))).unionByName(kept)
    return after, new.unionByName(emptied.select("repo", root.alias("cid"), F.lit(empty).alias("data"))), read

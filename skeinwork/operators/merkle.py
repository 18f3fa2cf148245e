"""Merkle search trees of flat repositories, built a layer at a time.

The tree depends only on the set of (key, cid): a key stands in the layer that its hash gives, a node holds the
keys of its layer between two keys of higher layers, and every run of keys without a key in a layer still has a node
there that holds only its child. So each layer is one grouping, written to the shared folder as the next one reads it,
and a node is small however large its repository.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skeinwork.functions.cbor import Link, decode, encode, head
from skeinwork.functions.cids import key_height
from skeinwork.session import stored

#: Nodes and keys of trees that a Python worker keeps: commits of a repository share most of them.
KEPT_NODES, KEPT_KEYS = 4096, 1 << 16


def cid_of(data: bytes, codec: int = 0x71) -> Link:
    return Link(bytes([1, codec, 0x12, 0x20]) + hashlib.sha256(data).digest())


def encode_node(entries: list[tuple[str, str, str | None]], left: str | None) -> bytes:
    """A node's bytes from its sorted (key, cid, right child) entries and its left child."""
    return _node_bytes(tuple(entries), left)


@lru_cache(KEPT_NODES)
def _node_bytes(entries: tuple[tuple[str, str, str | None], ...], left: str | None) -> bytes:
    rows, last = [], b""
    for key, cid, right in entries:
        raw = key.encode()
        shared = next((i for i, (a, b) in enumerate(zip(raw, last, strict=False)) if a != b), min(len(raw), len(last)))
        rows.append(b"\xa4\x61k" + encode(raw[shared:]) + b"\x61p" + encode(shared) + b"\x61t" + _link(right) + b"\x61v" + _link(cid))
        last = raw
    return b"\xa2\x61e" + head(4, len(rows)) + b"".join(rows) + b"\x61l" + _link(left)


def _link(cid: str | None) -> bytes:
    return encode(Link.parse(cid)) if cid else b"\xf6"


def decode_node(data: bytes) -> tuple[list[tuple[str, str, str | None]], str | None]:
    """The entries and the left child of a node; wrong shapes, prefixes and orders are errors."""
    entries, left = _node_parts(bytes(data))
    return list(entries), left


@lru_cache(KEPT_NODES)
def _node_parts(data: bytes) -> tuple[tuple[tuple[str, str, str | None], ...], str | None]:
    node = decode(data)
    if not isinstance(node, dict) or set(node) != {"e", "l"} or not isinstance(node["e"], list) or len(node["e"]) > 10_000:
        raise ValueError("not a tree node")
    out, last = [], b""
    for e in node["e"]:
        if not isinstance(e, dict) or set(e) != {"k", "p", "t", "v"} or not 0 <= e["p"] <= len(last):
            raise ValueError("not a tree entry")
        raw = last[: e["p"]] + e["k"]
        if raw <= last or len(raw) > 1024:
            raise ValueError("keys out of order or too long")
        out.append((raw.decode(), str(e["v"]), str(e["t"]) if e["t"] else None))
        last = raw
    return tuple(out), str(node["l"]) if node["l"] else None


# --- the part of a tree that a commit's archive holds -----------------------------------------------------


@dataclass(frozen=True)
class Item:
    """A key of a tree with its content id, or, without a key, a subtree whose blocks aren't at hand."""

    key: str | None
    cid: str
    level: int


@lru_cache(KEPT_KEYS)
def level_of(key: str) -> int:
    """The layer of a key, as ``key_height``."""
    return (256 - int.from_bytes(hashlib.sha256(key.encode()).digest(), "big").bit_length()) // 2


def unfolded(blocks: dict[str, bytes], cid: str, level: int | None = None) -> list[Item]:
    """The items below a node, in order; a missing root is an error, any other missing node an item of its own."""
    if cid not in blocks:
        if level is None:
            raise ValueError("the root's block is missing")
        return [Item(None, cid, level)]
    rows, left = decode_node(blocks[cid])
    level = level_of(rows[0][0]) if rows else level
    if level is None and left:
        raise ValueError("a root without keys")
    out = unfolded(blocks, left, level - 1) if left else []
    for key, value, right in rows:
        out.append(Item(key, value, level))
        out += unfolded(blocks, right, level - 1) if right else []
    return out


def folded(items: list[Item], blocks: dict[str, bytes] | None = None) -> str:
    """The root of sorted items; new nodes go to ``blocks``. Subtrees that would have to be opened are an error."""

    def node(run: list[Item], level: int) -> str | None:
        if not run:
            return None
        if len(run) == 1 and run[0].key is None and run[0].level == level:
            return run[0].cid
        if any(i.key is None and i.level >= level for i in run):
            raise ValueError("a needed block is missing")
        at = [k for k, i in enumerate(run) if i.key is not None and i.level == level]
        ends = [*at[1:], len(run)]
        below = [node(run[k + 1 : end], level - 1) for k, end in zip(at, ends, strict=True)] if at else []
        return kept([(run[k].key, run[k].cid, child) for k, child in zip(at, below, strict=True)], node(run[: at[0]] if at else run, level - 1))

    def kept(entries: list[tuple[str, str, str | None]], left: str | None) -> str:
        data = encode_node(entries, left)
        cid = str(cid_of(data))
        if blocks is not None:
            blocks[cid] = data
        return cid

    if items and all(i.key is None for i in items):
        raise ValueError("a needed block is missing")
    return node(items, max(i.level for i in items)) if items else kept([], None)


def place_of(items: list[Item], key: str) -> tuple[int, bool]:
    """Where a key stands or would stand, and whether it is there; in a missing subtree is an error."""
    at = 0
    for k, item in enumerate(items):
        if item.key == key:
            return k, True
        if item.key is not None and item.key < key:
            at = k + 1
    if at < len(items) and items[at].key is None:
        raise ValueError("a needed block is missing")
    return at, False


def inverted(items: list[Item], ops: list[dict]) -> str:
    """The root before ``ops`` (action, path, cid, prev) made the tree what it is."""
    items = list(items)
    for op in ops:
        at, there = place_of(items, op["path"])
        if op["action"] == "create":
            del items[at : at + there]
        elif op["action"] in ("update", "delete") and op["prev"]:
            items[at : at + there] = [Item(op["path"], str(Link.parse(op["prev"])), level_of(op["path"]))]
        else:
            raise ValueError("an op without prev or of an unknown kind")
    return folded(items)


def op_error(items: list[Item], ops: list[dict]) -> str | None:
    """The first op that the tree contradicts."""
    for op in ops:
        try:
            at, there = place_of(items, op["path"])
        except ValueError:
            at, there = -1, op["action"] == "delete"
        if op["action"] == "delete":
            if there or op["cid"]:
                return "delete_path_present" if there else "delete_unexpected_cid"
        elif op["action"] not in ("create", "update"):
            return "unknown_action"
        elif not op["cid"]:
            return f"{op['action']}_missing_cid"
        elif not there or items[at].cid != op["cid"]:
            return f"{op['action']}_cid_mismatch"
    return None


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cids, blobs = [], []
        for entries, children in zip(batch.column("entries").to_pylist(), batch.column("children").to_pylist(), strict=True):
            below = {c["run"]: c["cid"] for c in children}
            if len(below) < len(children):
                raise ValueError("two subtrees in one place: a block between them wasn't read")
            entries = sorted(entries, key=lambda e: e["key"].encode())
            left = below.get(entries[0]["sub"]) if entries else next(iter(below.values()))
            data = encode_node([(e["key"], e["cid"], below.get(e["sub"] + 1)) for e in entries], left)
            cids.append(str(cid_of(data)))
            blobs.append(data)
        yield pa.RecordBatch.from_arrays([batch.column("repo"), batch.column("run"), batch.column("runs"), pa.array(cids, pa.string()), pa.array(blobs, pa.binary())], ["repo", "run", "runs", "cid", "data"])


def layers(records: DataFrame, subtrees: DataFrame | None = None) -> tuple[list[DataFrame], DataFrame]:
    """The nodes of each layer (repo, run, runs, cid, data), and (repo, top) of every repository.

    ``subtrees`` (repo, after, cid, level) are nodes that stay as they are, each with all below it; ``after`` is the
    last key before it, empty where there is none.
    """
    tall = records.select("repo", "key", F.lit(0).alias("place"), "cid", key_height(F.col("key")).alias("height"), F.lit(None).cast("int").alias("level"))
    most = tall.agg(F.max("height")).first()[0]
    if most is None:
        return [], tall.groupBy("repo").agg(F.max("height").alias("top"))
    if subtrees is not None:
        tall = tall.unionAll(subtrees.select("repo", "after", F.lit(1), "cid", F.lit(None).cast("int"), F.col("level").cast("int")))
    before = W.partitionBy("repo").orderBy("key", "place").rowsBetween(W.unboundedPreceding, -1)
    # runs[L]: how many keys of layers above L - 1 come before; it numbers the runs of layer L - 1
    runs = F.array(*(F.coalesce(F.sum((F.col("height") >= level).cast("long")).over(before), F.lit(0)) for level in range(most + 2)))
    placed = stored(tall.withColumn("runs", runs), "keys")
    tops = placed.groupBy("repo").agg(F.max("height").alias("top"))
    no_entry, no_child = F.lit(None).cast("struct<sub:bigint,key:string,cid:string>").alias("entry"), F.lit(None).cast("struct<run:bigint,cid:string>").alias("child")
    out: list[DataFrame] = []
    for level in range(most + 1):
        run = F.col("runs")[level + 1].alias("run")
        entry = F.struct(F.col("runs")[level].alias("sub"), "key", "cid")
        own = placed.where(F.col("height") == level).select("repo", run, "runs", entry.alias("entry"), no_child)
        if subtrees is not None:
            own = own.unionByName(placed.where(F.col("level") == level - 1).select("repo", run, "runs", no_entry, F.struct(F.col("runs")[level].alias("run"), "cid").alias("child")))
        if out:
            lower = out[-1].join(tops.where(F.col("top") >= level), "repo")
            own = own.unionByName(lower.select("repo", run, "runs", no_entry, F.struct("run", "cid").alias("child")))
        nodes = own.groupBy("repo", "run").agg(F.min("runs").alias("runs"), F.collect_list("entry").alias("entries"), F.collect_list("child").alias("children"))
        out.append(stored(nodes.mapInArrow(_encoded, "repo string, run bigint, runs array<bigint>, cid string, data binary"), f"layer{level}"))
    return out, tops


def _tops(found: list[DataFrame], tops: DataFrame) -> DataFrame | None:
    out = None
    for level, nodes in enumerate(found):
        top = nodes.join(tops.where(F.col("top") == level), "repo").select("repo", F.col("cid").alias("root"))
        out = top if out is None else out.unionByName(top)
    return out


def roots(records: DataFrame) -> DataFrame:
    """(repo, root) from records (repo, key, cid)."""
    out = _tops(*layers(records))
    return out if out is not None else records.select("repo", F.lit("").alias("root")).limit(0)


def _blocks(found: list[DataFrame], like: DataFrame) -> DataFrame:
    out = like.select("repo", F.lit("").alias("cid"), F.lit(b"").alias("data")).limit(0)
    for nodes in found:
        out = out.unionByName(nodes.select("repo", "cid", "data"))
    return out.dropDuplicates(["repo", "cid"])


def node_blocks(records: DataFrame) -> DataFrame:
    """(repo, cid, data) of every node, each block once for a repository."""
    return _blocks(layers(records)[0], records)


def tree_of(records: DataFrame, subtrees: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(repo, root) and (repo, cid, data), from one building of the layers; subtrees stay closed, as in ``layers``."""
    found, tops = layers(records, subtrees)
    tops = _tops(found, tops)
    return tops if tops is not None else records.select("repo", F.lit("").alias("root")).limit(0), _blocks(found, records)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        repos, keys, cids = [], [], []
        for repo, data in zip(batch.column("repo").to_pylist(), batch.column("data").to_pylist(), strict=True):
            for key, cid, _ in decode_node(data)[0]:
                repos.append(repo)
                keys.append(key)
                cids.append(cid)
        yield pa.RecordBatch.from_arrays([pa.array(repos, pa.string()), pa.array(keys, pa.string()), pa.array(cids, pa.string())], ["repo", "key", "cid"])


def entries(blocks: DataFrame) -> DataFrame:
    """(repo, key, cid) of every entry in node blocks (repo, cid, data)."""
    return blocks.select("repo", "data").mapInArrow(_entries, "repo string, key string, cid string")

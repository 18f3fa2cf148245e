"""Repositories out of archives: the commit that an archive's root names, a walk over its tree, and its records.

Where blocks are rows, the walk goes down one layer of all repositories a round, each a join with the blocks by archive
and content id, so a tree of any size is read in as many rounds as it has layers. Where archives are at hand, the task
that has an archive's bytes walks it, and no block is sent or stored. What is missing comes as rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.functions.cbor import encode
from skeinwork.operators.merkle import decode_node
from skeinwork.session import stored
from skeinwork.sources import archives, commits

#: ``kind`` is ``node`` or ``record``; ``depth`` counts layers from the root, ``error`` says why a node wasn't read.
WALKED = "kind string, depth bigint, key string, cid string, error string"


def opened(files: DataFrame, data: str = "content", path: str = "path") -> tuple[DataFrame, DataFrame]:
    """(path, did, rev, version, root, content, signature, error) of every archive, and the blocks (path, cid, data).

    An archive that breaks off or lacks its commit is an error without a commit.
    """
    parsed = stored(archives.parse(files, data, path), "blocks")
    wrong = parsed.where("error IS NOT NULL").groupBy("path").agg(F.min("error").alias("broken"))
    roots = parsed.where("cid = root").groupBy("path").agg(F.min("data").alias("data"))
    all_ = parsed.select("path").distinct().join(roots, "path", "left").join(wrong, "path", "left")
    read = commits.decoded(all_.withColumn("data", F.when(F.col("broken").isNull(), F.coalesce("data", F.lit(b"")))), "path")
    named = read.join(wrong, "path", "left").withColumn("error", F.coalesce("broken", "error")).drop("broken")
    return stored(named, "commits"), parsed.where("cid IS NOT NULL").select("path", "cid", "data").dropDuplicates(["path", "cid"])


def _layer(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for path, cid, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    if data is None:
                        raise ValueError("missing block")
                    entries, left = decode_node(data)
                    rows.append((path, "node", depth, None, cid, None))
                    rows += [(path, "child", depth + 1, None, c, None) for c in (left, *(e[2] for e in entries)) if c]
                    rows += [(path, "record", depth, key, value, None) for key, value, _ in entries]
                except (ValueError, KeyError, TypeError, UnicodeDecodeError) as why:
                    rows.append((path, "node", depth, None, cid, str(why)))
            kinds = [batch.schema.field(0).type, pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["path", "kind", "depth", "key", "cid", "error"])

    return run


def walked(roots: DataFrame, blocks: DataFrame) -> DataFrame:
    """(path, kind, depth, key, cid, error): every node and record below the roots (path, root)."""
    kind = roots.schema["path"].dataType.simpleString()
    front = roots.where("root IS NOT NULL").select("path", F.col("root").alias("cid"))
    out, depth = None, 0
    while True:
        met = front.join(blocks, ["path", "cid"], "left").select("path", "cid", "data")
        layer = stored(met.mapInArrow(_layer(depth), f"path {kind}, {WALKED}"), "layer")
        own = layer.where("kind <> 'child'")
        out = own if out is None else out.unionByName(own)
        front = layer.where("kind = 'child'").select("path", "cid").distinct()
        if front.isEmpty():
            return out
        depth += 1


def records(found: DataFrame, blocks: DataFrame) -> DataFrame:
    """(path, key, cid, data, error) of all records of a walk; a record whose block isn't there says so."""
    own = found.where("kind = 'record'").select("path", "key", "cid")
    return own.join(blocks, ["path", "cid"], "left").select("path", "key", "cid", "data", F.when(F.col("data").isNull(), "missing block").alias("error"))


def completeness(found: DataFrame, blocks: DataFrame) -> DataFrame:
    """(path, n_records, missing_nodes, missing_records) of every repository that was walked."""
    joined = found.join(blocks.select("path", "cid", F.lit(True).alias("there")), ["path", "cid"], "left")
    record = F.col("kind") == "record"
    return joined.groupBy("path").agg(F.count_if(record).alias("n_records"), F.count_if(~record & F.col("error").isNotNull()).alias("missing_nodes"), F.count_if(record & F.col("there").isNull()).alias("missing_records"))


# --- archives at hand ------------------------------------------------------------------------------------

_COMMIT = "did string, rev string, version bigint, root string, content binary, signature binary"
_KINDS = pa.schema([("did", pa.string()), ("rev", pa.string()), ("version", pa.int64()), ("root", pa.string()), ("content", pa.binary()), ("signature", pa.binary()), ("kind", pa.string()), ("depth", pa.int64()), ("key", pa.string()), ("cid", pa.string()), ("data", pa.binary()), ("error", pa.string())])


def _opened(raw: bytes) -> tuple[tuple, str | None, dict[str, bytes], str | None]:
    """The columns of ``_COMMIT``, the commit's content id, all blocks, and what is wrong."""
    held: dict[str, bytes] = {}
    try:
        roots, at = archives.read_header(raw)
        held.update(archives.read_blocks(raw, at))
        commit, signature = commits.opened(held.get(roots[0], b""))
    except (ValueError, KeyError) as why:
        return (None,) * 6, None, held, str(why)
    return (commit["did"], commit["rev"], commit["version"], str(commit["data"]), encode(commit), signature), roots[0], held, None


def _walk(held: dict[str, bytes], root: str) -> Iterator[tuple]:
    """(kind, depth, key, cid, data, error) of the nodes and records below a root, by layers; a node once a layer, without data."""
    front, depth = [root], 0
    while front:
        below: dict[str, None] = {}
        for cid in front:
            try:
                if cid not in held:
                    raise ValueError("missing block")
                entries, left = decode_node(held[cid])
            except (ValueError, KeyError, TypeError) as why:
                yield "node", depth, None, cid, None, str(why)
                continue
            yield "node", depth, None, cid, None, None
            below.update(dict.fromkeys(c for c in (left, *(e[2] for e in entries)) if c))
            for key, value, _ in entries:
                yield "record", depth, key, value, held.get(value), None if value in held else "missing block"
        front, depth = list(below), depth + 1


def read(files: DataFrame, data: str = "content", path: str = "path") -> tuple[DataFrame, DataFrame]:
    """The commits (path, did, rev, version, root, content, signature, error) of archives, a path each, and what lies
    below them (path, kind, depth, key, cid, data, error); a record whose block isn't there says so."""
    named = files.schema[path].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [batch.schema.field(0).type, *_KINDS.types]

            def made(rows: list[tuple], kinds: list = kinds) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["path", *_KINDS.names])

            rows: list[tuple] = []
            size = 0
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                commit, _, held, wrong = _opened(content.as_py() or b"")
                rows.append((name, *commit, "commit", None, None, None, None, wrong))
                for row in _walk(held, commit[3]) if wrong is None else ():
                    rows.append((name, *(None,) * 6, *row))
                    size += len(row[4] or b"")
                    if len(rows) >= 4096 or size > archives.BYTES_AT_ONCE:
                        yield made(rows)
                        rows, size = [], 0
            yield made(rows)

    rows = files.select(F.col(path).alias("path"), F.col(data).alias("content")).mapInArrow(run, f"path {named}, {_COMMIT}, kind string, depth bigint, key string, cid string, data binary, error string")
    all_ = stored(rows, "read")
    below = all_.where("kind <> 'commit'").select("path", "kind", "depth", "key", "cid", "data", "error")
    return all_.where("kind = 'commit'").select("path", *(c.split()[0] for c in _COMMIT.split(", ")), "error"), below


def missing(below: DataFrame) -> DataFrame:
    """(path, n_records, missing_nodes, missing_records) of every repository that was ``read``."""
    record, wrong = F.col("kind") == "record", F.col("error").isNotNull()
    return below.groupBy("path").agg(F.count_if(record).alias("n_records"), F.count_if(~record & wrong).alias("missing_nodes"), F.count_if(record & wrong).alias("missing_records"))


def exported(files: DataFrame, data: str = "content", path: str = "path") -> DataFrame:
    """(path, archive, missing_nodes, missing_records): archives written anew in the order commit, nodes by layer, records
    by key. Those that lack blocks come without an archive, those without a commit not at all."""
    named = files.schema[path].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shape = pa.schema([("path", batch.schema.field(0).type), ("archive", pa.binary()), ("missing_nodes", pa.int64()), ("missing_records", pa.int64())])
            done: list[tuple] = []
            size = 0
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                commit, head, held, wrong = _opened(content.as_py() or b"")
                if wrong is not None:
                    continue
                found = list(_walk(held, commit[3]))
                nodes, records = (sum(row[0] == kind and row[5] is not None for row in found) for kind in ("node", "record"))
                archive = None
                if not nodes + records:
                    places = sorted((kind == "record", key.encode() if kind == "record" else b"%06d" % depth, cid) for kind, depth, key, cid, *_ in found)
                    archive = archives.write_archive([head], ((c, held[c]) for c in (head, *(c for *_, c in places))))
                done.append((name, archive, nodes, records))
                size += len(archive or b"")
                if size > archives.BYTES_AT_ONCE:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), shape.types, strict=True)], schema=shape)
                    done, size = [], 0
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), shape.types, strict=True)], schema=shape)

    return files.select(F.col(path).alias("path"), F.col(data).alias("content")).mapInArrow(run, f"path {named}, archive binary, missing_nodes bigint, missing_records bigint")


def loaded(files: DataFrame, data: str = "content", path: str = "path") -> DataFrame:
    """(path, did, rev, version, root, content, signature, error) of archives, as ``read`` has them, without a walk."""
    named = files.schema[path].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [*_KINDS.types[:6], pa.string()]
        for batch in batches:
            rows = [(*commit, wrong) for commit, _, _, wrong in (_opened(c.as_py() or b"") for c in batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["path", *_KINDS.names[:6], "error"])

    return files.select(F.col(path).alias("path"), F.col(data).alias("content")).mapInArrow(run, f"path {named}, {_COMMIT}, error string")

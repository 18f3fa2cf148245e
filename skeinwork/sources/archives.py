"""Block archives: a varint-framed header of roots, then varint-framed blocks, each a content id and its bytes.

Archives are read through Spark's own file reader, so any file system that Spark knows will do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.functions.cbor import MAX_SIZE, Link, decode, encode, read_varint, varint

#: Bytes after which a task hands on the blocks or archives that it has, beyond the one at hand.
BYTES_AT_ONCE = 4 << 20
BLOCKS = "root string, cid string, data binary, error string"


def header(roots: list[str]) -> bytes:
    data = encode({"roots": [Link.parse(r) for r in roots], "version": 1})
    return varint(len(data)) + data


def block(cid: str, data: bytes) -> bytes:
    raw = Link.parse(cid).raw
    return varint(len(raw) + len(data)) + raw + data


def write_archive(roots: list[str], blocks: Iterator[tuple[str, bytes]]) -> bytes:
    """An archive's bytes; a content id is written once."""
    out, seen = [header(roots)], set()
    for cid, data in blocks:
        if cid not in seen:
            seen.add(cid)
            out.append(block(cid, data))
    return b"".join(out)


def read_header(data: bytes) -> tuple[list[str], int]:
    """The roots, and where the blocks begin."""
    n, at = read_varint(data, 0)
    if not 0 < n <= MAX_SIZE or at + n > len(data):
        raise ValueError("bad header length")
    head = decode(data[at : at + n])
    if not isinstance(head, dict) or head.get("version") != 1 or not head.get("roots") or not all(isinstance(r, Link) for r in head["roots"]):
        raise ValueError("bad header")
    return [str(r) for r in head["roots"]], at + n


def read_blocks(data: bytes, at: int, most: int = MAX_SIZE) -> Iterator[tuple[str, bytes]]:
    """Each block after its content id is checked; a body that ends early or has more than ``most`` bytes is an error."""
    while at < len(data):
        n, at = read_varint(data, at)
        if not 36 <= n <= most + 36:
            raise ValueError("bad block length")
        if at + n > len(data):
            raise ValueError("archive cut off in a block")
        link = Link(data[at : at + 36])
        link.check()
        body = data[at + 36 : at + n]
        if hashlib.sha256(body).digest() != link.raw[4:]:
            raise ValueError("content differs from its id")
        yield str(link), body
        at += n


def parse(archives: DataFrame, data: str = "content", path: str = "path", most: int = MAX_SIZE) -> DataFrame:
    """(path, root, cid, data, error): a row for each block; an error ends an archive with a row that says why.

    Blocks of more than ``most`` bytes are errors; archives of one's own writing may hold larger ones.
    """
    named = archives.schema[path].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows: list[tuple] = []
                root = None
                try:
                    raw = content.as_py() or b""
                    roots, at = read_header(raw)
                    root = roots[0]
                    size = 0
                    for cid, body in read_blocks(raw, at, most):
                        rows.append((name, root, cid, body, None))
                        size += len(body)
                        if len(rows) == 4096 or size > BYTES_AT_ONCE:
                            yield _rows(rows, batch.schema.field(0).type)
                            rows, size = [], 0
                except (ValueError, KeyError) as why:
                    rows.append((name, root, None, None, str(why)))
                yield _rows(rows, batch.schema.field(0).type)

    return archives.select(F.col(path).alias("path"), F.col(data).alias("content")).mapInArrow(run, f"path {named}, {BLOCKS}")


def _rows(rows: list[tuple], path: pa.DataType) -> pa.RecordBatch:
    kinds = [path, pa.string(), pa.string(), pa.binary(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["path", "root", "cid", "data", "error"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of all archives below a path."""
    return parse(spark.read.format("binaryFile").option("pathGlobFilter", "*.car").option("recursiveFileLookup", "true").load(path))


def packed(rows: DataFrame, key: str = "repo") -> DataFrame:
    """(key, archive) from blocks (key, root, part, place, cid, data), written in the order of part, place and cid.

    A task holds one archive's bytes at a time, not its rows; a content id is written once. Null is a key like others.
    """
    kind = rows.schema[key].dataType.simpleString()

    def made(done: list[tuple], name: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], name), pa.array([d[1] for d in done], pa.binary())], [key, "archive"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, at, out, seen = False, None, bytearray(), set()
        for batch in batches:
            done: list[tuple] = []
            size = 0
            for name, root, cid, data in zip(*(batch.column(i) for i in (0, 1, 4, 5)), strict=True):
                name, cid = name.as_py(), cid.as_py()
                if not begun or name != at:
                    if begun:
                        done.append((at, bytes(out)))
                        size += len(out)
                    begun, at, out, seen = True, name, bytearray(header([root.as_py()])), set()
                    if size > BYTES_AT_ONCE:
                        yield made(done, batch.schema.field(0).type)
                        done, size = [], 0
                if cid not in seen:
                    seen.add(cid)
                    out += block(cid, data.as_py())
            yield made(done, batch.schema.field(0).type)
            last = batch.schema.field(0).type
        if begun:
            yield made([(at, bytes(out))], last)

    ordered = rows.select(key, "root", "part", "place", "cid", "data").repartition(key).sortWithinPartitions(key, "part", "place", "cid")
    return ordered.mapInArrow(run, f"{key} {kind}, archive binary")


def export(blocks: DataFrame, roots: DataFrame) -> DataFrame:
    """(repo, archive) from blocks (repo, cid, data) and roots (repo, root); the root's block comes first."""
    named = roots.select(F.col("repo").alias("_repo"), "root")
    rows = blocks.select("repo", "cid", "data").join(named, F.col("repo").eqNullSafe(F.col("_repo"))).drop("_repo")
    return packed(rows.withColumns({"part": (F.col("cid") != F.col("root")).cast("int"), "place": F.lit("")}))

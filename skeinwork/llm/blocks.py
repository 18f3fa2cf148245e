"""Documents in compressed blocks, and packed columns of numbers, for work that asks the same text several times.

A block is a run of documents as one compressed Arrow batch. Blocks are written once to a table that is bucketed by
block in the shared folder, so that answers can be brought to their blocks by shuffling the answers alone, and a task
that is run again reads the same block.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from skeinwork.llm.arrays import pieces
from skeinwork.llm.common import shared_dir

#: Text bytes in a block; a block holds at least one document, whatever its size.
BLOCK_BYTES = 8 << 20


def pack(values: np.ndarray) -> bytes:
    """Numbers compressed byte plane by byte plane."""
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes(), 1)


def unpack(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted numbers as compressed differences."""
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(data: bytes, kind: type) -> np.ndarray:
    return np.cumsum(unpack(data, kind), dtype=kind)


def pack_batch(batch: pa.RecordBatch) -> bytes:
    with pa.BufferOutputStream() as sink:
        with pa.ipc.new_stream(sink, batch.schema) as writer:
            writer.write_batch(batch)
        return zstandard.compress(sink.getvalue(), 3)


def opened(data: bytes) -> pa.RecordBatch:
    """The documents of a block."""
    return pa.ipc.open_stream(zstandard.decompress(data)).read_next_batch()


def blocks(docs: DataFrame, text: str = "_text", most: int = BLOCK_BYTES) -> DataFrame:
    """(block, size, data): runs of rows of about ``most`` bytes of text; blocks are numbered by task and place."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n = TaskContext.get().partitionId() << 33, 0
        for batch, size in gathered(batches, text, at, most):
            yield pa.RecordBatch.from_arrays([pa.array([base + n], pa.int64()), pa.array([size], pa.int64()), pa.array([pack_batch(batch)], pa.binary())], ["block", "size", "data"])
            n += 1

    return docs.mapInArrow(run, "block bigint, size bigint, data binary")


def gathered(batches: Iterator[pa.RecordBatch], text: str, at: int, most: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, int]]:
    """Runs of rows of about ``most`` bytes in the column ``text``, which is column ``at``, with their bytes."""
    held, size = [], 0
    for piece in pieces(batches, text, most // 4):
        held.append(piece)
        size += piece.column(at).nbytes
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0], size
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0], size


class Bucketed:
    """A DataFrame written to the shared folder in buckets of ``column``; ``drop`` forgets the table's name.

    Where a column's rows are together already, as the blocks of a task are, ``deal`` is not needed: they go to one file.
    """

    def __init__(self, df: DataFrame, column: str, label: str, deal: bool = True):
        self.spark: SparkSession = df.sparkSession
        self.name = f"skeinwork_{label}_{uuid.uuid4().hex}"
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        path = f"{shared_dir(self.spark)}/skeinwork/{self.name}"
        (df.repartition(n, column) if deal else df).write.format("parquet").option("path", path).bucketBy(n, column).saveAsTable(self.name)

    @property
    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

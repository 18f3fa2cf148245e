"""Archives of records with an index, as a Spark data source: ``spark.read.format("indexed_archives").load(path)``.

A segment is an archive of the blocks of a run of records; the index, a Parquet folder, tells for each record its
repository, collection, key and content id, and where its block lies. A read takes the filters that Spark pushes down
to the index: row groups whose bounds can't hold the rows asked for aren't read, and of a segment only the bytes of
matching records. Each partition is a row group of the index.

As a stream, the offset is the sequence number, so that Spark's checkpoint is the cursor: a later run with the same
checkpoint goes on behind the last record that was taken.

Paths may be any URI that pyarrow's file systems open.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute
import pyarrow.dataset as ds
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith
from pyspark.sql.types import StructType

from skeinwork.functions.cbor import Link, read_varint
from skeinwork.sources import archives

NAME = "indexed_archives"
RECORD = "seq bigint, repo string, collection string, rkey string, cid string, data binary"
_INDEX = "seq bigint, repo string, collection string, rkey string, cid string, file string, place bigint, size bigint"
_KEYS = ("seq", "repo", "collection", "rkey", "cid")
#: Records in a batch; bytes of a gap between two blocks that are read over rather than sought; bytes read at once.
ROWS, GAP, RUN = 4096, 1 << 16, 8 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def write(records: DataFrame, path: str, segments: int = 8) -> None:
    """Append records (seq, repo, path, cid, data) to the archives at ``path`` as ``segments`` segments of the sequence.

    Within a segment records lie by collection and repository. A segment has a name of its own for each attempt of its
    task, and only what the index names is ever read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = opened(path)
        out = None
        for batch in batches:
            rows = []
            for seq, repo, collection, rkey, cid, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    system.create_dir(f"{folder}/segments", recursive=True)
                    name = f"segments/{uuid.uuid4().hex}.car"
                    out = system.open_output_stream(f"{folder}/{name}")
                    head = archives.header([cid])
                    out.write(head)
                    place = len(head)
                held = archives.block(cid, data)
                out.write(held)
                rows.append((seq, repo, collection, rkey, cid, name, place, len(held)))
                place += len(held)
            kinds = pa.int64(), *[pa.string()] * 5, pa.int64(), pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [c.split()[0] for c in _INDEX.split(", ")])
        if out is not None:
            out.close()

    parts = F.split("path", "/")
    shaped = records.where("cid IS NOT NULL AND data IS NOT NULL AND seq IS NOT NULL").select("seq", "repo", parts[0].alias("collection"), parts[1].alias("rkey"), "cid", "data")
    ordered = shaped.repartitionByRange(segments, "seq").sortWithinPartitions("collection", "repo", "seq")
    ordered.mapInArrow(run, _INDEX).write.option("parquet.block.size", 1 << 20).mode("append").parquet(f"{path}/index")


@dataclass
class RowGroup(InputPartition):
    """A row group of the index."""

    file: str
    group: int


def _expression(f: Filter) -> ds.Expression | None:
    """A pushed filter on a key of the index; null for any other."""
    attribute = getattr(f, "attribute", None)
    if attribute is None or len(attribute) != 1 or attribute[0] not in _KEYS:
        return None
    field, value = ds.field(attribute[0]), getattr(f, "value", None)
    if value is None:
        return None
    if isinstance(f, In):
        return field.isin([v for v in value if v is not None])
    if isinstance(f, EqualTo):
        return field == value
    if isinstance(f, GreaterThan):
        return field > value
    if isinstance(f, GreaterThanOrEqual):
        return field >= value
    if isinstance(f, LessThan):
        return field < value
    if isinstance(f, LessThanOrEqual):
        return field <= value
    if isinstance(f, StringStartsWith):
        return (field >= value) & pa.compute.starts_with(field, value)
    return None


def _row_groups(path: str, wanted: ds.Expression | None) -> list[RowGroup]:
    system, folder = opened(f"{path}/index")
    index = ds.dataset(folder, filesystem=system, format="parquet")
    return [RowGroup(fragment.path, part.row_groups[0].id) for fragment in index.get_fragments(filter=wanted) for part in fragment.split_by_row_group(filter=wanted)]


class Blocks:
    """The records of a row group of the index that match; ``decoded`` counts the blocks that were looked at."""

    def __init__(self, path: str, wanted: ds.Expression | None):
        self.path, self.wanted, self.decoded = path, wanted, 0

    def read(self, part: RowGroup) -> Iterator[pa.RecordBatch]:
        system, folder = opened(self.path)
        fragment = ds.ParquetFileFormat().make_fragment(part.file, filesystem=system, row_groups=[part.group])
        rows = fragment.to_table(filter=self.wanted).sort_by([("file", "ascending"), ("place", "ascending")])
        for low in range(0, rows.num_rows, ROWS):
            batch = rows.slice(low, ROWS)
            data: list[bytes] = []
            for file, places in _runs(batch):
                with system.open_input_file(f"{folder}/{file}") as source:
                    begin = places[0][0]
                    held = source.read_at(places[-1][0] + places[-1][1] - begin, begin)
                data += [self._block(held[place - begin : place - begin + size], cid) for place, size, cid in places]
            table = batch.select(list(_KEYS)).append_column("data", pa.array(data, pa.binary())).combine_chunks()
            yield from table.to_batches()

    def _block(self, held: bytes, cid: str) -> bytes:
        self.decoded += 1
        n, at = read_varint(held, 0)
        link, body = Link(held[at : at + 36]), held[at + 36 : at + n]
        if str(link) != cid or hashlib.sha256(body).digest() != link.raw[4:]:
            raise ValueError(f"the index and the archive differ at {cid}")
        return body


def _runs(batch: pa.Table) -> Iterator[tuple[str, list[tuple[int, int, str]]]]:
    """Blocks of one file that lie close enough to be read at once."""
    run: list[tuple[int, int, str]] = []
    last = None
    for file, place, size, cid in zip(*(batch.column(c).to_pylist() for c in ("file", "place", "size", "cid")), strict=True):
        if run and (file != last or place - (run[-1][0] + run[-1][1]) > GAP or place + size - run[0][0] > RUN):
            yield last, run
            run = []
        run.append((place, size, cid))
        last = file
    if run:
        yield last, run


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.wanted = path, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802  the interface's name
        for f in filters:
            found = _expression(f)
            if found is None:
                yield f
            else:
                self.wanted = found if self.wanted is None else self.wanted & found

    def partitions(self) -> Sequence[InputPartition]:
        return _row_groups(self.path, self.wanted)

    def read(self, partition: RowGroup) -> Iterator[pa.RecordBatch]:
        return Blocks(self.path, self.wanted).read(partition)


class StreamReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path, self.between = path, (-1, -1)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"seq": -1}

    def latestOffset(self) -> dict:  # noqa: N802
        """The highest number that the bounds of the index's row groups tell."""
        system, folder = opened(f"{self.path}/index")
        last = -1
        for fragment in ds.dataset(folder, filesystem=system, format="parquet").get_fragments():
            for group in fragment.row_groups:
                last = max(last, (group.statistics or {}).get("seq", {"max": -1})["max"])
        return {"seq": last}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return [_Between(p.file, p.group, start["seq"], end["seq"]) for p in _row_groups(self.path, _between(start["seq"], end["seq"]))]

    def read(self, partition: _Between) -> Iterator[pa.RecordBatch]:
        return Blocks(self.path, _between(partition.after, partition.last)).read(partition)


@dataclass
class _Between(RowGroup):
    after: int
    last: int


def _between(after: int, last: int) -> ds.Expression:
    return (ds.field("seq") > after) & (ds.field("seq") <= last)


class IndexedArchives(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return RECORD

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"])

    def streamReader(self, schema: StructType) -> StreamReader:  # noqa: N802
        return StreamReader(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the format known to a session, whose filters are pushed to Python sources from then on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(IndexedArchives)

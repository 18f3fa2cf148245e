"""Archives leave a task by bytes, not by rows, and hold blocks of any size."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from skeinwork.operators.merkle import cid_of
from skeinwork.plans import catalogue
from skeinwork.sources import archives
from tests import oracle


class Rows:
    """Stands for a DataFrame; what would run in a task is called here."""

    def __init__(self, kind: str = "string"):
        self.schema = {n: self for n in ("repo", "path")}
        self.dataType, self.kind = self, kind

    def simpleString(self):  # noqa: N802
        return self.kind

    def where(self, *_):
        return self

    select = repartition = sortWithinPartitions = where

    def mapInArrow(self, run, _):  # noqa: N802
        return run


def test_whole_archives_in_batches_of_bounded_bytes(spark):
    texts = [b"%d" % n * 500_000 for n in range(100, 112)]
    cids = [str(cid_of(t)) for t in texts]
    names = ["r%02d" % n for n in range(12)]
    batch = pa.RecordBatch.from_pydict({"repo": names, "root": cids, "part": [0] * 12, "place": [""] * 12, "cid": cids, "data": texts})
    made = list(archives.packed(Rows(), "repo")(iter([batch])))
    assert [n for b in made for n in b.column(0).to_pylist()] == names
    assert max(b.nbytes for b in made) < 3 * archives.BYTES_AT_ONCE
    one = archives.write_archive([cids[0]], iter((str(cid_of(t)), t) for t in (bytes([n]) * 900_000 for n in range(20))))
    files = pa.RecordBatch.from_pydict({"path": ["a"], "content": pa.array([one], pa.binary())})
    read = list(archives.parse(Rows(), "content", "path")(iter([files])))
    assert sum(b.num_rows for b in read) == 20 and all(b.column(4).null_count == b.num_rows for b in read)
    assert max(b.nbytes for b in read) < 3 * archives.BYTES_AT_ONCE


@pytest.mark.parametrize("name", ["a06_car_roundtrip", "a02_truncated_archive"])
def test_archives_of_empty_and_long_texts_and_without_a_name(spark, tmp_path, name):
    texts = ["a", "", "long" * 300_000, "b", "", None, "c", "c", "d", "", "x" * ((1 << 20) + 1)]
    ids = [0, 1, 2, 100, 101, 102, None, None, 201, 301, 401]
    rows = {"doc_id": pa.array(ids, pa.int64()), "text": texts, "source": ["s"] * 6 + [None, "s", None, "s", None]}
    pq.write_table(pa.table(rows), tmp_path / "documents.parquet")
    oracle.check(catalogue.QUERIES[name](spark, str(tmp_path)), oracle.connection(str(tmp_path)), catalogue.ORACLES[name])


def test_blocks_beyond_the_limit_are_errors(spark):
    for size, most, errors in ((1 << 20, archives.MAX_SIZE, 0), ((1 << 20) + 1, archives.MAX_SIZE, 1), ((1 << 20) + 1, 1 << 31, 0), (0, archives.MAX_SIZE, 0)):
        cid = str(cid_of(b"z" * size))
        one = archives.write_archive([cid], iter([(cid, b"z" * size)]))
        files = pa.RecordBatch.from_pydict({"path": ["a"], "content": pa.array([one], pa.binary())})
        read = pa.Table.from_batches(archives.parse(Rows(), "content", "path", most)(iter([files])))
        assert read.num_rows - read.column("error").null_count == errors and read.num_rows == 1

"""Indexed archives: only what filters ask for is decoded, and what is written stays a readable archive."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringContains, StringStartsWith

from skeinwork.operators import merkle
from skeinwork.sources import archives, indexed


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('indexed')}"
    rows = [(n, f"r{n % 5}", f"c{n % 3}/k{n}", None if n % 10 == 9 else str(merkle.cid_of(str(n).encode(), 0x55)), str(n).encode()) for n in range(300)]
    indexed.write(spark.createDataFrame(rows, "seq long, repo string, path string, cid string, data binary"), path, 4)
    return path


def taken(folder, *filters):
    reader = indexed.Reader(folder)
    left = list(reader.pushFilters(list(filters)))
    blocks = indexed.Blocks(folder, reader.wanted)
    rows = [r for part in reader.partitions() for batch in blocks.read(part) for r in batch.to_pylist()]
    return rows, blocks.decoded, left


def test_filters_keep_blocks_from_being_decoded(folder):
    rows, decoded, left = taken(folder, EqualTo(("collection",), "c1"), EqualTo(("repo",), "r2"), StringContains(("rkey",), "7"))
    assert sorted(r["seq"] for r in rows) == [n for n in range(300) if n % 3 == 1 and n % 5 == 2 and n % 10 != 9]
    assert decoded == len(rows) == 20 and [type(f) for f in left] == [StringContains]
    rows, decoded, _ = taken(folder, In(("seq",), (3, 4, 9)), StringStartsWith(("collection",), "c"))
    assert sorted(r["seq"] for r in rows) == [3, 4] and decoded == 2
    assert taken(folder, GreaterThan(("seq",), 1000))[0] == []
    assert len(indexed.Reader(folder).partitions()) == 4
    reader = indexed.Reader(folder)
    list(reader.pushFilters([GreaterThan(("seq",), 290)]))
    assert len(reader.partitions()) == 1


def test_spark_pushes_its_filters(spark, folder):
    indexed.register(spark)
    found = spark.read.format(indexed.NAME).load(folder).where("collection = 'c0' AND seq < 30 AND rkey LIKE '%2'")
    assert sorted(r.seq for r in found.collect()) == [12]
    everything = spark.read.format(indexed.NAME).load(folder)
    assert everything.count() == 270
    assert {bytes(r.data) for r in everything.where("repo IN ('r1', 'r3')").collect()} == {str(n).encode() for n in range(300) if n % 5 in (1, 3) and n % 10 != 9}


def test_segments_are_archives(spark, folder):
    read = archives.read(spark, folder)
    assert read.where("error IS NOT NULL").count() == 0
    assert read.select(F.col("data").cast("string").cast("int").alias("n")).distinct().count() == 270


def test_a_block_that_differs_from_the_index_is_an_error(folder):
    blocks = indexed.Blocks(folder, None)
    with pytest.raises(ValueError):
        blocks._block(archives.block(str(merkle.cid_of(b"x", 0x55)), b"x"), str(merkle.cid_of(b"y", 0x55)))

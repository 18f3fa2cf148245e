"""Targets against resharing in rounds, copies against the rate."""

import random

import pytest
from pyspark.sql import functions as F

from skeinwork.llm import mixing as mx


def rounds(sizes: dict) -> dict:
    """Targets by resharing until none is above its cap."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: [5, 2, 1][i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not above:
            return target | share
        for s in above:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= above
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets_equal_rounds(spark, seed):
    draw = random.Random(seed)
    sizes = {f"s{i}": draw.choice([0, 1, 10, 1000, draw.randrange(5000)]) for i in range(draw.randint(1, 9))} | ({None: 700} if seed % 2 else {})
    rows = [(s, part) for s, n in sizes.items() for part in (n // 3, n - n // 3)]
    got = {r["source"]: r for r in mx.targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    want = rounds(sizes)
    assert {s: r["source_size"] for s, r in got.items()} == sizes
    for s in sizes:
        assert got[s]["target"] == pytest.approx(want[s]), s


def test_taken_comes_near_the_target_and_repeats(spark):
    draw = random.Random(3)
    rows = [(i, "w " * draw.randint(0, 60), draw.choice(["a", "b", "c", None])) for i in range(4000)] + [(9000, None, "a"), (9001, "", None), (9002, "x", "a"), (9002, "x", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "'x' AS target").repartition(5)
    mixed = mx.mix(docs)
    got = mixed.collect()
    assert len(got) == len(rows) and all(r["taken"] <= 2 * r["size"] for r in got)
    for s, target, taken in mixed.groupBy("source").agg(F.first("target"), F.sum("taken")).collect():
        assert taken == pytest.approx(target, rel=0.05), s
    assert sorted(map(repr, got)) == sorted(map(repr, mx.mix(docs.repartition(2)).collect()))
    emitted = mx.emit(docs)
    assert emitted.columns == [*docs.columns, "copy"]
    count = {r["doc_id"]: r["n"] for r in emitted.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    once = {r["doc_id"]: r["copies"] for r in got if r["copies"] and r["doc_id"] != 9002}
    count.pop(9002, None)
    assert count == once
    assert mx.mix(docs.limit(0)).count() == 0 and mx.emit(docs.limit(0)).count() == 0

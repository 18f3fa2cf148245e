"""Batches in time against stepping through the stream, whatever the length of the ranges."""

import random

import numpy as np
import pytest

from skeinwork.operators import batches


def stepped(rows: list[tuple[int, int, bool]], size: int, span: int) -> list[tuple[int, int]]:
    out, begin = [], None
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    for k, (seq, us, bad) in enumerate(rows):
        if begin is None or bad or k - begin == size or us >= rows[begin][1] + span:
            begin = k
        out.append((seq, begin))
        if bad:
            begin = None
    return sorted(out)


@pytest.mark.parametrize("seed", range(6))
def test_equals_stepping(spark, seed):
    draw = random.Random(seed)
    now, rows = 0, []
    for k in range(draw.choice([1, 40, 333])):
        now += draw.choice([0, 1, 5, 5, 20])
        rows.append((k, now, draw.random() < 0.05))
    size, span, length = draw.choice([(5, 30, 8), (7, 10, 50), (3, 1000, 4)])
    events = spark.createDataFrame(rows, "seq long, us long, failed boolean").repartition(3)
    found = batches.timed_batches(events, "failed", size=size, span=span, width=draw.choice([7, 10**6]), length=length)
    assert sorted((r.seq, r.batch) for r in found.collect()) == stepped(rows, size, span)


def test_nulls_empty_streams_and_short_ranges(spark):
    shape = "seq long, us long, failed boolean"
    found = batches.timed_batches(spark.createDataFrame([(1, 5, None), (2, 6, True)], shape), "failed")
    assert sorted((r.seq, r.batch) for r in found.collect()) == [(1, 0), (2, 1)]
    assert batches.timed_batches(spark.createDataFrame([], shape), "failed").count() == 0
    with pytest.raises(ValueError):
        batches.timed_batches(spark.createDataFrame([], shape), "failed", size=50, length=50)


def test_errors_cut():
    times, errors = np.arange(6) * 10, np.array([False, False, True, False, False, False])
    assert batches.following(times, errors, 3, 25).tolist() == [2, 2, 3, 6, 6, 6]

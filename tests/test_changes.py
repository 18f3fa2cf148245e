"""Ops on a stored tree against a tree built of all keys."""

import random

import pytest

from skeinwork.operators import changes, merkle

SHAPE = "repo string, key string, cid string"


def cid(n: object) -> str:
    return str(merkle.cid_of(str(n).encode()))


def both_ways(spark, old, ops):
    """What ``changed`` and a full building say."""
    held = spark.createDataFrame(old, SHAPE)
    heads, blocks = merkle.tree_of(held)
    roots, new, read = changes.changed(blocks, heads, spark.createDataFrame(ops, SHAPE))
    after = {(r, k): c for r, k, c in old} | {(r, k): c for r, k, c in ops}
    rows = [(r, k, c) for (r, k), c in after.items() if c]
    whole, nodes = merkle.tree_of(spark.createDataFrame(rows, SHAPE))
    before = {tuple(r) for r in blocks.select("repo", "cid").collect()}
    want = {tuple(r) for r in nodes.select("repo", "cid").collect()} - before
    made = {(r.repo, r.cid): bytes(r.data) for r in new.collect()}
    assert all(str(merkle.cid_of(data)) == c for (_, c), data in made.items())
    return {r.repo: r.root for r in roots.collect()}, {r.repo: r.root for r in whole.collect()}, set(made) - before, want, read.count(), len(before)


@pytest.mark.parametrize("seed", range(2))
def test_equals_a_full_building(spark, seed):
    draw = random.Random(seed)
    old = list({(f"r{draw.randrange(3)}", f"a.b/{draw.randrange(10**5):05d}"): None for _ in range(300)})
    old = [(r, k, cid(k)) for r, k in old]
    ops = {}
    for n in range([60, 3][seed]):
        r, k, _ = draw.choice(old)
        ops[(r, k)] = None if draw.random() < 0.6 else cid((n, k))
    for n in range([20, 0][seed]):
        ops[(f"r{draw.randrange(5)}", f"a.b/{draw.randrange(10**5):05d}x")] = cid(n)
    roots, whole, made, want, *_ = both_ways(spark, old, [(r, k, c) for (r, k), c in ops.items()])
    assert roots == whole and made == want


def test_the_highest_keys_go(spark):
    old = [("r", f"a.b/{k}", cid(k)) for k in range(200)]
    top = sorted({merkle.level_of(k) for _, k, _ in old})[-2]
    roots, whole, made, want, *_ = both_ways(spark, old, [(r, k, None) for r, k, _ in old if merkle.level_of(k) >= top])
    assert roots == whole and made == want


def test_a_few_ops_read_a_few_nodes(spark):
    old = [("r", f"a.b/{k}", cid(k)) for k in range(3000)]
    roots, whole, made, want, read, n = both_ways(spark, old, [("r", "a.b/17", None), ("r", "a.b/1700", cid("x")), ("r", "a.b/17x", cid("y"))])
    assert roots == whole and made == want
    assert read < 40 < n // 10


def test_emptied_untouched_and_new_repositories(spark):
    old = [("gone", "a.b/1", cid(1)), ("same", "a.b/1", cid(1))]
    roots, whole, *_ = both_ways(spark, old, [("gone", "a.b/1", None), ("new", "a.b/9", cid(9))])
    assert roots.pop("gone") == str(merkle.cid_of(merkle.encode_node([], None)))
    assert roots == whole


def test_ops_of_no_effect(spark):
    old = [("r", f"a.b/{k}", cid(k)) for k in range(50)]
    roots, whole, made, want, *_ = both_ways(spark, old, [("r", "a.b/none", None), ("r", "a.b/7", cid(7))])
    assert roots == whole and made == want == set()


def test_a_missing_node_is_an_error(spark):
    held = spark.createDataFrame([("r", f"a.b/{k}", cid(k)) for k in range(50)], SHAPE)
    heads, blocks = merkle.tree_of(held)
    with pytest.raises(Exception, match="missing node"):
        changes.touched(blocks.limit(0), heads, held.limit(1)).count()


def test_gaps_that_an_op_goes_into():
    keys = ["b", "d"]
    assert changes.followed(keys, None, None, "a", False) == [0]
    assert changes.followed(keys, None, None, "c", True) == [1]
    assert changes.followed(keys, None, None, "d", True) == [1, 2]
    assert changes.followed(keys, None, None, "d", False) == []
    assert changes.followed(keys, "a", "e", "a", True) == [0]
    assert changes.followed(keys, "a", "e", "e", True) == [2]
    assert changes.followed([], "a", "e", "e", True) == [0]

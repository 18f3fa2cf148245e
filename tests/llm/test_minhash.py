"""Classes against all pairs by brute force, sketches against the similarity that they estimate."""

import random
from collections import Counter

import numpy as np
import pytest

from skeinwork.llm import minhash as mh


def shingles(text: str) -> Counter:
    w = text.split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def near(a: Counter, b: Counter) -> float:
    common = a.keys() & b.keys()
    plain = len(common) / max(1, len(a.keys() | b.keys()))
    na, nb = sum(a.values()), sum(b.values())
    total = 0.0
    for i in common:
        p, q = a[i] / na, b[i] / nb
        total += 1 / sum(max(a[j] / na / p, b[j] / nb / q) for j in a.keys() | b.keys())
    return max(plain, total)


def corpus() -> list[tuple]:
    draw = random.Random(2)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 5)))
    rows = []
    for _ in range(25):
        base = [word() for _ in range(draw.randint(20, 120))]
        rows.append(" ".join(base))
        for _ in range(draw.randint(0, 4)):
            copy = list(base)
            for _ in range(draw.choice([0, 1, 2, 3, 6])):
                copy[draw.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    rows += ["", None, "  ", "a b", "a b", "a  b", rows[0], rows[0]]
    draw.shuffle(rows)
    return [(i * 2, t) for i, t in enumerate(rows)]


def test_classes_equal_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS key", "'x' AS label", "2 AS a").repartition(3)
    got = {r["doc_id"]: r for r in mh.classify(docs).collect()}
    words = {i: tuple((t or "").split()) for i, t in rows}
    sets = {i: shingles(t or "") for i, t in rows}
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in words:
        for j in words:
            if i < j and words[i] and words[j] and (words[i] == words[j] or near(sets[i], sets[j]) >= 0.8):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    assert {i: got[i]["class_id"] for i in words} == {i: find(i) for i in words}
    assert all(r["is_kept"] == (r["class_id"] == i) for i, r in got.items())
    kept = mh.keep_first(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i in words if find(i) == i}


def test_sketches_estimate_the_probability_jaccard():
    draw = np.random.default_rng(1)
    items = draw.integers(0, 2**63, 300).astype(np.uint64)
    a = np.concatenate([np.repeat(items[:200], draw.integers(1, 4, 200))])
    b = np.concatenate([np.repeat(items[60:300], draw.integers(1, 4, 240))])
    found, bounds = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
    sig = mh.signatures(found, bounds, 4000)
    row, item, count = mh.weighted(found, bounds)
    left, right = ((item[row == r], count[row == r].astype(float)) for r in (0, 1))
    true = mh.probability_jaccard(*left, *right)
    assert (sig[0] == sig[1]).mean() == pytest.approx(true, abs=0.03)
    assert true == pytest.approx(sum(1 / sum(max(dict(zip(*left)).get(j, 0) / left[1].sum() / p, dict(zip(*right)).get(j, 0) / right[1].sum() / q) for j in set(left[0]) | set(right[0])) for i in set(left[0]) & set(right[0]) for p, q in [(dict(zip(*left))[i] / left[1].sum(), dict(zip(*right))[i] / right[1].sum())]))


def test_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (1, "x y z u v w")], "doc_id long, text string")
    got = mh.classify(docs).collect()
    assert len(got) == 4 and all(r["class_id"] in (1, None) for r in got)
    assert mh.classify(docs.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["id"]: r["label"] for r in mh.components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_copies_near_their_base_and_not_each_other(spark):
    draw = random.Random(5)
    rows = []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(300)]
        texts = [base]
        for _ in range(200):
            copy = list(base)
            for at in draw.sample(range(5, 295), 6):
                copy[at] = f"x{draw.random()}"
            texts.append(copy)
        rows += [(g, " ".join(t)) for t in texts]
    draw.shuffle(rows)
    sets = [frozenset(shingles(t)) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):  # sets of one size without repeats: both similarities are the same
            if rows[i][0] == rows[j][0] and label[i] != label[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    assert len(set(label)) < 60
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in mh.classify(docs).collect()}
    assert got == dict(enumerate(label))


def test_pairs_that_differ_by_a_repeated_line(spark):
    rows = []
    for g in range(12):
        base = " ".join(f"g{g}w{i}" for i in range(200))
        rows += [(2 * g, base), (2 * g + 1, base + "\n" + "all rights are reserved by the owner here\n" * 50)]
    sets = [shingles(t) for _, t in rows[:2]]
    assert len(sets[0].keys() & sets[1].keys()) >= 0.8 * len(sets[0].keys() | sets[1].keys())
    got = {r["doc_id"]: r["class_id"] for r in mh.classify(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i // 2 * 2 for i, _ in rows}


def grown(draw, size: int, edits: range, repeat: int = 0, words: int = 200) -> list[str]:
    base = [f"w{i}" for i in range(words)]
    texts = []
    for k in range(size):
        copy = list(base)
        for at in draw.sample(range(5, words - 5), draw.choice(edits)):
            copy[at] = f"x{draw.random()}"
        texts.append(" ".join(copy) + " all rights are reserved by the owner" * (repeat if k % 3 == 0 else 0))
    return texts


def test_rows_of_a_crowd_do_not_grow_with_its_square(spark, monkeypatch):
    draw, made = random.Random(9), []
    texts = grown(draw, 500, range(4, 6))
    sets = [frozenset(shingles(t)) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    assert len(set(label)) > 50  # most pairs lie between 0.6 and 0.8
    verify = mh.verify
    monkeypatch.setattr(mh, "verify", lambda pairs, *rest: made.append(pairs.count()) or verify(pairs, *rest))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in mh.classify(docs).collect()}
    assert got == dict(enumerate(label))
    assert sum(made) < 25 * len(texts)  # of 124 750 pairs


def test_joining_links_the_classes_of_all_pairs():
    draw = random.Random(3)
    texts = grown(draw, 36, range(1, 4), 3, 50) + ["", "a b c", "a b c d e f g"]
    sets = [shingles(t) for t in texts]
    numbers: dict[tuple, int] = {}
    found = [sorted((numbers.setdefault(k, len(numbers)), c) for k, c in s.items()) for s in sets]
    bounds = np.cumsum([0, *(len(f) for f in found)])
    items, counts = (np.array([p[k] for f in found for p in f]) for k in (0, 1))
    start = np.array([i // 2 if i < 8 else i for i in range(len(texts))])
    for left, right in ((range(len(texts)), range(len(texts))), (range(0, 16), range(16, len(texts)))):
        links = mh.joining(start, np.array(left), np.array(right), items.astype(np.uint64), counts, bounds)
        want, got = start.copy(), start.copy()
        for i in left:
            for j in right:
                if i != j and want[i] != want[j] and near(sets[i], sets[j]) >= 0.8:
                    want[want == want[j]] = want[i]
        for i, j, value in links:
            assert value >= 0.8 and near(sets[i], sets[j]) >= 0.8
            got[got == got[j]] = got[i]
        parts = lambda x: {tuple(np.flatnonzero(x == c)) for c in set(x.tolist())}
        assert parts(got) == parts(want) and len(links) < len(texts)

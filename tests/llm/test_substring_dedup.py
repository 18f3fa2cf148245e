"""Against brute force over all 50-byte strings."""

import hashlib
import random

import numpy as np
import pytest

from skeinwork.llm import substring_dedup as sd


def brute(rows: list[tuple]) -> dict:
    """doc_id → (n_bytes, n_removed, n_spans, kept_sha256) for distinct ids."""
    seen: set[bytes] = set()
    out = {}
    for doc_id, text in sorted(((i, t) for i, t in rows if i is not None), key=lambda r: r[0]):
        data = (text or "").encode()
        gone, own = bytearray(len(data)), set()
        for k in range(len(data) - 49):
            s = data[k : k + 50]
            own.add(s)
            if s in seen:
                gone[k : k + 50] = b"\1" * 50
        seen |= own
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[doc_id] = len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()
    return out


def texts() -> list[tuple]:
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abcdeñé") for _ in range(draw.randint(1, 7)))
    passages = [" ".join(word() for _ in range(draw.randint(8, 60))) for _ in range(12)]
    rows = []
    for i in range(120):
        parts = [draw.choice(passages) if draw.random() < 0.4 else " ".join(word() for _ in range(draw.randint(1, 40))) for _ in range(draw.randint(1, 5))]
        text = " ".join(parts)
        cut = draw.randint(0, len(text))
        rows.append((i * 3, text[:cut] + draw.choice(["", "#"]) + text[cut:]))
    rows += [(500, None), (501, ""), (502, "x" * 49), (503, "y" * 50), (504, "y" * 50), (505, "z" * 300), (506, "z" * 200), (507, "ab" * 100), (508, "ba" * 100), (509, rows[0][1]), (None, rows[0][1])]
    return rows


def test_equals_brute_force(spark):
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS h", "1 AS a").repartition(5)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in sd.dedupe(docs).collect()}
    want = brute(rows)
    whole = rows[0][1].encode()
    assert got.pop(None) == (len(whole), 0, 0, hashlib.sha256(whole).hexdigest())
    assert got == want


@pytest.mark.parametrize("hot", [0, 1])
def test_hot_anchors_change_nothing(spark, hot):
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in sd.dedupe(docs, hot=hot).collect() if r["doc_id"] is not None}
    assert got == brute(rows)


def test_repeated_rows_and_a_text_longer_than_a_window(spark):
    draw = random.Random(9)
    long = "".join(draw.choice("abcdefgh \n") for _ in range(3 * sd.WINDOW + 77))
    inner = long[sd.WINDOW - 200 : sd.WINDOW + 300]
    rows = [(1, inner), (2, long), (2, long), (3, long[: 2 * sd.WINDOW]), (3, "tail " + inner), (4, long)]
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"]) for r in sd.dedupe(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    n = len(long)
    assert got == [(1, 500, 0, 0), (2, n, 500, 1), (2, n, 500, 1), (3, 505, 500, 1), (3, 2 * sd.WINDOW, 2 * sd.WINDOW, 1), (4, n, n, 1)]


def test_ids_that_are_words(spark):
    rows = [("b", "x" * 80), ("é", "x" * 60 + "y"), ("a", "x" * 50), ("B", "z" * 10)]
    got = {r["doc_id"]: r["n_removed"] for r in sd.dedupe(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {"b": 80, "é": 60, "a": 0, "B": 0}


def test_windows_hold_every_string_once(monkeypatch):
    monkeypatch.setattr(sd, "WINDOW", 100)
    offsets = np.array([0, 30, 30, 95, 400, 449, 450, 700])
    found = []
    for row, lo, inner in sd.windows(offsets):
        found += [(row + k, lo + p) for k in range(len(inner) - 1) for p in range(inner[k], inner[k + 1] - sd.LENGTH + 1)]
    assert sorted(found) == [(k, p) for k in range(7) for p in range(offsets[k], offsets[k + 1] - sd.LENGTH + 1)]
    data = np.frombuffer(b"".join(hashlib.sha256(bytes([k])).digest() for k in range(22))[:700], np.uint8)
    covered = sorted(p for row, lo, inner in sd.windows(offsets) for a, b in zip(*sd.runs(data[lo : lo + inner[-1]], inner)[1:3], strict=True) for p in range(lo + a, lo + b + 1))
    assert covered == sorted(p for _, p in found)


def test_refined_buckets_tell_strings_apart():
    data = np.frombuffer(b"abcabcabd" * 30, np.uint8)
    ids = sd.buckets(data)
    grams = [data[k : k + sd.GRAM].tobytes() for k in range(len(ids))]
    assert len(set(ids.tolist())) == len(set(grams))
    assert len(set(zip(ids.tolist(), grams, strict=True))) == len(set(grams))


def test_empty_table(spark):
    assert sd.dedupe(spark.createDataFrame([], "doc_id long, text string")).count() == 0

"""Context mixing against the same model in plain Python, and the base score against counted words."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from skeinwork.llm import context_mixing as cm
from skeinwork.llm.common import table

SHAPE = "doc_id long, text string, score string, block string"
TEXTS = ["The cat sat on the mat. The cat sat.", "the dog sat on the log", "THE CAT\n\nran", None, "", "  ", "Ünïcode — 東京 東京", "aaaaaaaaaaaaaaaaaaaaaaaa", "the cat sat on the mat", "the cat sat on the mat", "zq", "one two three four five six seven", "\x00\x01 end"]


def lower(text):
    return (text or "").translate({k: k + 32 for k in range(65, 91)})


def held_out(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2


class Plain:
    """Counts in dictionaries, one bit after the other."""

    def __init__(self, texts):
        self.n = Counter()
        for text in texts:
            s = [cm.END] * cm.PAD + [*lower(text).encode(), cm.END]
            for p in range(cm.PAD, len(s)):
                for context in self.contexts(s[:p]):
                    self.n[context] += 1
                    for bit in range(8):
                        self.n[context, s[p] >> (7 - bit), bit] += 1

    @staticmethod
    def contexts(past):
        word = past[cm.PAD :]
        begin = max((k + 1 for k, b in enumerate(word) if b in b" \t\n\r\x0b\x0c"), default=0)
        return [*((k, *past[-k:]) for k in cm.ORDERS), ("word", *word[begin:])]

    def inputs(self, past, byte):
        rows, gate = [], 0
        for j, context in enumerate(self.contexts(past)):
            total = self.n[context]
            if total:
                gate = cm.CLASSES * j + min(cm.CLASSES, int(1 + math.log2(total) / 2))
            row = []
            for bit in range(8):
                right = self.n[context, byte >> (7 - bit), bit]
                row.append(max(-127, min(127, round(math.log((right + cm.PRIOR) / (total - right + cm.PRIOR)) * cm.SCALE))) / cm.SCALE)
                total = right
            rows.append(row)
        return rows, gate

    def byte(self, weights, past, byte):
        rows, gate = self.inputs(past, byte)
        w = weights.setdefault(gate, list(cm.FIRST))
        sums = [max(-10.5, min(10.5, sum(w[k] * rows[k][b] for k in range(len(rows))))) for b in range(8)]
        return sum(-math.log1p(math.exp(-s)) for s in sums), rows, w, sums

    def score(self, text, segment):
        s = [cm.END] * cm.PAD + [*lower(text).encode(), cm.END]
        total, weights = 0.0, {}
        for p in range(cm.PAD, len(s)):
            if (p - cm.PAD) % segment == 0:
                weights = {}
            cost, rows, w, sums = self.byte(weights, s[:p], s[p])
            total += cost
            for k in range(len(rows)):
                w[k] += cm.STEP * sum(rows[k][b] / (1 + math.exp(sums[b])) for b in range(8))
        return total / math.log(10)


def found_of(spark, docs, segment=cm.SEGMENT):
    rows = spark.createDataFrame([(i, t, "s", "b") for i, t in docs], SHAPE).repartition(2)
    return cm.score(rows, segment=segment).collect()


@pytest.mark.parametrize("segment", [cm.SEGMENT, 7])
def test_equals_plain_python(spark, segment):
    docs = list(enumerate(TEXTS)) + [(None, "no id"), (None, "no id")]
    plain = Plain([t for i, t in docs if not held_out(i)])
    words = {k: [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), None] for k, (_, t) in enumerate(docs)}
    counts = Counter(w for k, (i, _) in enumerate(docs) if not held_out(i) for w in words[k])
    n, v = sum(counts.values()), len(counts)
    want = sorted((repr(i), held_out(i), len(words[k]), sum(counts[w] > 0 for w in words[k]), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words[k]), plain.score(t, segment)) for k, (i, t) in enumerate(docs))
    got = sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in found_of(spark, docs, segment))
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], abs=1e-9)
        assert g[6] == pytest.approx(w[6], rel=2e-3 if segment < 100 else 1e-3, abs=0.02)


def test_bytes_share_one(spark):
    """The probabilities of all bytes that may follow sum to one."""
    plain = Plain([t for t in TEXTS if t])
    for past in (b"the ca", b"zzz", b"\xe6\x9d"):
        s = [cm.END] * cm.PAD + [*past]
        assert sum(math.exp(plain.byte({}, s, b)[0]) for b in range(256)) == pytest.approx(1, abs=1e-9)


def test_held_out_texts_cost_less_than_words_alone(spark):
    found = cm.score(table(spark, "/root/testdata/sf0.1", "documents")).where("held_out").agg({"score": "sum", "base_score": "sum", "n_bytes": "sum"}).first()
    assert found["sum(score)"] > found["sum(base_score)"]
    assert -found["sum(score)"] * math.log2(10) / found["sum(n_bytes)"] < 3


def test_no_training_texts_and_no_texts(spark):
    only = next(i for i in range(99) if held_out(i))
    (row,) = found_of(spark, [(only, "ab c")])
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0)
    assert row.score == pytest.approx(-5 * 8 * math.log10(2), rel=1e-6)
    assert row.bits_per_byte == pytest.approx(8, rel=1e-6)
    assert found_of(spark, []) == []


def test_long_text(spark):
    text = "lorem ipsum dolor sit amet " * 20_000
    rows = {r.doc_id: r for r in found_of(spark, [(1, text), (2, text), (3, "short")])}
    assert rows[1].score == rows[2].score and rows[1].n_bytes == len(text) + 1
    assert rows[1].bits_per_byte < 0.2


def test_numbers_of_wide_codes():
    code = np.array([5, 1 << 63, 5, 0], np.uint64)
    number, place = cm.dense(code, 64)
    assert code[place][number].tolist() == code.tolist() and len(place) == 3
    code = np.array([5, 5 | 1 << 63, 5, 0], np.uint64)  # the same low bits
    number, place = cm.dense(code, 64)
    assert code[place][number].tolist() == code.tolist() and len(place) == 3
    code = np.array([5, 1 << 63, 5, 0], np.uint64)
    number, place = cm.dense(code[[0, 2, 3]], 3)
    assert number.tolist() == [1, 1, 0] and place.tolist() == [2, 0]

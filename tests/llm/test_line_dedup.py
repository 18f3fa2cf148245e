"""Against a plain loop over all documents in order."""

import random
import re
from collections import defaultdict

import numpy as np

from skeinwork.llm import line_dedup as ld

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def brute(rows, least):
    seen, out = set(), defaultdict(list)
    for i in sorted({r[0] for r in rows if r[0] is not None}):
        own = set()
        for text in [t or "" for k, t in rows if k == i]:
            found = [(m.start(), m.end(), m[0]) for m in WORD.finditer(text)]
            units, last = [], None
            for a, b, w in found:
                if last is None or last[1][-1] in ld.ENDS or "\n" in text[last[0] : a]:
                    units.append([a, []])
                units[-1][1].append("".join(c.lower() if c.isascii() else c for c in w))
                last = b, w
            stops = [u[0] for u in units[1:]] + [len(text)]
            keys = [" ".join(u[1]) for u in units]
            own.update(keys)
            spans, k = [], 0
            while k < len(units):
                stop = k
                while stop < len(units) and keys[stop] in seen:
                    stop += 1
                if sum(len(u[1]) for u in units[k:stop]) >= least:
                    spans.append((units[k][0], stops[stop - 1], stop - k))
                k = max(stop, k + 1)
            kept, at = "", 0
            for a, b, _ in spans:
                kept, at = kept + text[at:a], b
            out[i].append((sum(n for *_, n in spans), ",".join(f"{a}:{b}" for a, b, _ in spans), kept + text[at:]))
        seen |= own
    return {i: sorted(x) for i, x in out.items()}


def results(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r["doc_id"]].append((r["n_removed"], r["removed"], r["kept_text"]))
    return {i: sorted(x) for i, x in out.items()}


def test_equals_a_loop(spark):
    draw = random.Random(7)
    lines = [" ".join(draw.choice(["É", "a", "Bc", "dé,", "🙂", "x.", "y!\t"]) for _ in range(draw.randint(2, 12))) for _ in range(30)]
    rows = [(i, draw.choice(["", " \n", "  "]) + draw.choice(["\n", ". ", " "]).join(draw.choice([str.upper, str, lambda s: s.replace(" ", "\t ")])(draw.choice(lines)) for _ in range(draw.randint(0, 12)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (5, rows[9][1]), (5, rows[9][1]), (None, "\n".join(lines))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS key", "'x' AS block").repartition(4)
    got = results(ld.dedupe(docs, min_words=12))
    assert got.pop(None) == [(0, "", "\n".join(lines))]
    assert got == brute(rows, 12)
    assert any(x[0][0] for x in got.values())
    assert ld.dedupe(docs.limit(0)).count() == 0


def test_a_passage_however_it_is_wrapped(spark):
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcdefg") for _ in range(5))
    passage = [word() + ("," if k % 5 == 4 else "") for k in range(60)]
    wrapped = "\n".join(" ".join(passage[k : k + 5]) for k in range(0, 60, 5))
    inside = f"{word()} {word()}. " + " ".join(passage) + f" {word()} end."
    stock = "All rights reserved. Do not copy."
    rows = [(1, wrapped), (2, inside), (3, stock), (4, f"{word()}. {stock} {word()}"), (5, inside + " " + "q " * 300_000)]
    got = {r["doc_id"]: (r["n_removed"], r["kept_text"][:40]) for r in ld.dedupe(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k][0] for k in (1, 3, 4)] == [0, 0, 0]
    assert got[2][0] == 12 and len(got[2][1]) < 30
    assert got[5][0] >= 12


def test_a_document_of_several_rows(spark):
    line = "one two three four five six seven eight"
    docs = spark.createDataFrame([("b", line), ("b", line), ("c", line), ("é", line)], "doc_id string, text string")
    got = sorted((r["doc_id"], r["n_removed"]) for r in ld.dedupe(docs, min_words=8).collect())
    assert got == [("b", 0), ("b", 0), ("c", 1), ("é", 1)]


def test_stretches_end_with_their_row():
    first, last = ld.stretches(np.array([0, 0, 1, 1, 1]), np.array([3, 4, 4, 9, 1]), np.array([True, True, True, False, True]), 5)
    assert (first.tolist(), last.tolist()) == ([0], [2])

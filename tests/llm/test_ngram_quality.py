"""The sharded model against dictionaries, and what the classifier does with odd rows."""

import math
from collections import Counter

import numpy as np
import pytest

from skeinwork.llm import ngram_quality as nq
from skeinwork.llm.blocks import blocks, unpack_sorted
from skeinwork.llm.common import staged

TEXTS = [
    (1, "the cat sat on the mat and the dog sat on the log", "en"),
    (2, "the dog and the cat ran to the house on the hill", "en"),
    (3, "der hund und die katze sind im haus auf dem berg", "de"),
    (4, "die katze und der hund laufen in das haus im tal", "de"),
    (5, "zq#$ 9931 xkcd %%% qqqq zzzz", "en"),
    (6, None, "en"),
    (7, "   \n ", "de"),
    (8, "the cat sat on the mat", None),
    (9, "un gato", "es"),
]
GOOD = [1, 2, 3, 4]


def model_of(texts: list[bytes]):
    """P(e | context) by the textbook, from dictionaries."""
    top = Counter()
    for t in texts:
        padded = b"\0" * 4 + t
        top.update(padded[i : i + 5] for i in range(len(t)))
    counts = {5: top}
    for n in (4, 3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    cuts = {}
    for n, found in counts.items():
        ones = [sum(v == k for v in found.values()) for k in (1, 2, 3, 4)]
        y = ones[0] / max(1, ones[0] + 2 * ones[1])
        cuts[n] = [min(k, max(0.05, k - (k + 1) * y * ones[k] / ones[k - 1])) if ones[k - 1] and y else 0.5 for k in (1, 2, 3)]

    def p(gram: bytes) -> float:
        n = len(gram)
        if n == 0:
            return 1 / 256
        seen = {g: c for g, c in counts[n].items() if g[:-1] == gram[:-1]}
        if not seen:
            return p(gram[1:])
        total = sum(seen.values())
        cut = lambda c: cuts[n][min(c, 3) - 1]
        share = (seen[gram] - cut(seen[gram])) / total if gram in seen else 0.0
        return share + sum(map(cut, seen.values())) / total * p(gram[1:])

    return p


def frames(spark, texts=TEXTS, good=GOOD):
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in good] + [(5, 0, 0)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_perplexities_equal_the_textbook(spark):
    docs, labels = frames(spark)
    got = {r["doc_id"]: r for r in nq.judge(docs, labels).collect()}
    assert sorted(got) == [t[0] for t in TEXTS]
    by_lang = {"en": [1, 2], "de": [3, 4], None: GOOD, "es": GOOD}
    texts = {i: t.encode() for i, t, _ in TEXTS if t is not None}
    for i, text, lang in TEXTS:
        if text is None or not text.strip():
            assert got[i]["perplexity"] is None and not got[i]["kept"]
            continue
        p = model_of([texts[k] for k in by_lang[lang]])
        padded = b"\0" * 4 + texts[i]
        logs = [math.log(p(padded[k : k + 5])) for k in range(len(texts[i]))]
        assert got[i]["perplexity"] == pytest.approx(math.exp(-sum(logs) / len(logs)), rel=1e-4), i
    assert not got[5]["kept"] and got[1]["kept"] and got[3]["kept"]


def test_probabilities_sum_to_one(spark):
    docs, labels = frames(spark)
    named = docs.selectExpr("doc_id", "lang", "concat('=', coalesce(lang, '')) AS model", "text AS _text")
    held = staged(blocks(named).selectExpr("shiftright(block, 33) AS task", "block", "data"), "test")
    trusted = nq.trusted_rows(held, labels.where("quality = 1").select("doc_id"), "bigint")
    top = nq.with_any(nq.counts(held, trusted, 4, 4), 2)
    low = {r["model"]: r["low"] for r in nq.low_orders(top).collect()}
    rows = top.collect()
    assert {r["model"] for r in rows} == {"=en", "=de", nq.ANY} and len(rows) == len({(r["model"], r["shard"]) for r in rows})
    for row in rows:
        shard = nq.Shard(row["grams"], row["counts"], low[row["model"]])
        for context in unpack_sorted(row["grams"], np.int64)[:20] >> 8:
            assert shard.probabilities((context << 8) | np.arange(256)).sum() == pytest.approx(1.0)


@pytest.mark.parametrize("fan, questions", [(2, 1)])
def test_small_groups_give_the_same(spark, monkeypatch, fan, questions):
    docs, labels = frames(spark)
    want = {r["doc_id"]: r["perplexity"] for r in nq.judge(docs.repartition(1), labels).collect()}
    monkeypatch.setattr(nq, "FAN", fan)
    monkeypatch.setattr(nq, "QUESTIONS", questions)
    got = {r["doc_id"]: r["perplexity"] for r in nq.judge(docs.repartition(6), labels).collect()}
    assert {k: v and round(v, 4) for k, v in got.items()} == {k: v and round(v, 4) for k, v in want.items()}


def test_ids_that_are_words_and_a_long_text(spark):
    docs, labels = frames(spark, [*TEXTS, (20, "the cat and the dog " * 60_000, "en")])
    want = {str(r["doc_id"]): r["perplexity"] for r in nq.judge(docs, labels).collect()}
    got = {r["doc_id"]: r["perplexity"] for r in nq.judge(docs.withColumn("doc_id", docs.doc_id.cast("string")), labels.withColumn("doc_id", labels.doc_id.cast("string"))).collect()}
    assert got == want and got["20"] > 1


def test_repeats_clashes_and_empty_tables(spark):
    docs, labels = frames(spark, TEXTS + TEXTS[:2])
    odd = docs.selectExpr("*", "'x' AS low", "1 AS kept", "2 AS block")
    got = nq.judge(odd, labels).collect()
    assert len(got) == len(TEXTS) + 2
    kept = nq.keep(odd, labels)
    assert kept.columns == odd.columns and {1, 2} <= {r["doc_id"] for r in kept.collect()}
    none = docs.limit(0)
    assert nq.judge(none, labels).count() == 0
    assert nq.judge(docs, labels.limit(0)).count() == len(TEXTS) + 2


def test_all_trusted_documents_count(spark):
    texts = [*TEXTS[:5], (10, "", "fr"), (11, "le chat", "fr")]
    docs, _ = frames(spark, texts)
    labels = spark.range(3_000_000).selectExpr("id AS doc_id", "IF(id IN (5, 11), 0, 1) AS quality")  # most label nothing here
    got = {r["doc_id"]: r["perplexity"] for r in nq.judge(docs, labels).collect()}
    for i, by in ((1, [1, 2]), (2, [1, 2]), (3, [3, 4]), (4, [3, 4]), (5, [1, 2]), (11, GOOD)):  # fr has no trusted byte
        p = model_of([t.encode() for k, t, _ in texts if k in by])
        text = next(t.encode() for k, t, _ in texts if k == i)
        padded = b"\0" * 4 + text
        logs = [math.log(p(padded[k : k + 5])) for k in range(len(text))]
        assert got[i] == pytest.approx(math.exp(-sum(logs) / len(logs)), rel=1e-4), i

"""Base counts against plain Python; sketches that merge; fences."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from skeinwork.llm import quality_rules as qr


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    marked = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(marked) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(marked), failed


def sample():
    draw = random.Random(8)
    parts = ["a", "B", "é", "🙂x", "#", "the", " ", "\n", "\t", "\u00a0", "\x0b", "!", "a b a b a b", "line one\nline one\n"]
    return [(i, "".join(draw.choice(parts) + draw.choice([" ", " ", "\n", ""]) for _ in range(draw.randint(0, 120))), draw.choice(["en", "de", None]), draw.choice(["s1", "s2", None])) for i in range(300)]


def test_base_counts_equal_plain_python(spark):
    rows = [*sample(), (1000, None, "en", "s1"), (1001, "", None, None), (1001, "", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 AS n_words", "true AS kept").repartition(3)
    got = qr.judge(docs).collect()
    assert len(got) == len(rows)
    of = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got}
    assert of == {i: base(t) for i, t, _, _ in rows}
    assert not any(r["kept"] for r in got if r["base_failed"])
    assert qr.judge(docs.limit(0)).count() == 0


def test_outliers_of_a_group_go_and_the_rest_stay(spark):
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(5))
    rows = [(i, " ".join(word() for _ in range(120)), "en", f"s{i % 2}") for i in range(200)]
    rows += [(900 + i, " ".join(word() + "$$#" for _ in range(120)), "en", "s0") for i in range(5)]
    kept = {r["doc_id"]: r["kept"] for r in qr.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert [i for i in kept if not kept[i]] == [900 + i for i in range(5)] or sorted(i for i in kept if not kept[i]) == [900 + i for i in range(5)]


def test_sketches_add_up_and_buckets_are_narrow(spark):
    docs = spark.createDataFrame(sample(), "doc_id long, text string, lang string, source string")
    rated = qr.rates(qr.text_counts(docs))
    whole = qr.sketches(rated)
    halves = qr.sketches(rated.where("doc_id % 2 = 0")).unionByName(qr.sketches(rated.where("doc_id % 2 = 1"))).groupBy("lang", "source", "rate", "bucket").agg(F.sum("n").alias("n"))
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, halves.select(*whole.columns).collect()))
    rows = spark.range(0, 200_000, 7).select("id", qr.bucket_floor(qr.bucket(F.col("id"))).alias("floor"))
    assert rows.where("floor > id OR floor * 1.0323 + 1 < id").count() == 0

"""Ranked search against every document scored for every item."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from skeinwork.llm import lexical_search
from skeinwork.llm.common import table
from tests import oracle

SHAPE, ITEMS = "doc_id long, text string, score string, item string", "item_id long, text string, rank string"
SF = "/root/testdata/sf0.001"


def terms(text):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").translate({k: k + 32 for k in range(65, 91)}))


def brute(docs, items):
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(n > 0 for *_, n in held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for t, d in df.items()}
    out = []
    for item, text in items:
        asked = Counter(terms(text))
        found = [(sum(times * w[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * (25 + 75 * n * n_docs // n_terms))) for t, times in asked.items() if t in c), i) for i, c, n in held]
        best = sorted(((-s, i is None, i or 0) for s, i in found if s > 0))[:10]
        out += [(item, k + 1, None if null else i, -s) for k, (s, null, i) in enumerate(best)]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


def made(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, "s", "i") for i, t in docs], SHAPE)
    q = spark.createDataFrame([(i, t, "r") for i, t in items], ITEMS)
    return rows_of(lexical_search.search(lexical_search.index(d.repartition(3)), q, **kw))


EDGES = [(0, None), (1, ""), (2, " .,!\n"), (3, "Äpfel apfel APFEL"), (4, "一二 三"), (5, "word " * 30_000), (6, "tie one"), (7, "tie one"), (7, "tie one"), (None, "tie one"), (None, "tie one"), (8, "a-b_c 1.5"), *((k, "tie one") for k in range(20, 28))]


@pytest.mark.parametrize("chunk_terms", [lexical_search.CHUNK_TERMS, 3])
def test_edges(spark, chunk_terms):
    items = [(0, "tie"), (0, "tie"), (None, "word APFEL äpfel Äpfel"), (2, None), (3, ""), (4, "nothing found"), (5, "tie tie one 三 c 5 5")]
    assert made(spark, EDGES, items, chunk_terms=chunk_terms) == brute(EDGES, items)


def test_random_texts(spark):
    draw = random.Random(3)
    words = [f"w{k}" for k in range(60)]
    docs = [(k, " ".join(draw.choices(words, [1 / (j + 1) for j in range(60)], k=draw.randint(0, 60)))) for k in range(400)]
    items = [(k, " ".join(draw.choices(words, k=draw.randint(1, 12)))) for k in range(60)]
    assert made(spark, docs, items) == brute(docs, items)


def test_documents_skipped(spark):
    """WAND scores fewer documents than hold a term of the item, with the same result."""
    draw = random.Random(4)
    docs = [" ".join(draw.choices(["common", "usual", "often"], k=draw.randint(5, 60)) + (["rare"] if k % 50 == 7 else [])) for k in range(3000)]
    import pyarrow as pa

    ids, sizes, found, dfs, places, tfs = lexical_search.inverted(pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(docs)], ["doc_id", "_text"]))
    row = {"ids": ids.to_pylist(), "terms": [t.decode() for t in found], "sizes": sizes, "dfs": dfs, "places": places, "tfs": tfs}
    shard = lexical_search.Shard(row, {"rare": 0, "common": 1}, 3000, int(sizes.sum()))
    heaps = lexical_search.Heaps(1)
    scored = lexical_search.wand(shard, np.array([[0, 1]]), np.array([[5000, 1]]), np.array([0]), heaps)
    assert scored < 600  # all until ten rare ones are found, then the rare ones alone
    worth = [dict(zip(shard.doc[shard.cuts[k] : shard.cuts[k + 1]].tolist(), shard.impact[shard.cuts[k] : shard.cuts[k + 1]].tolist(), strict=True)) for k in shard.slot]
    best = sorted((-(5000 * worth[0].get(d, 0) + worth[1].get(d, 0)), False, d) for d in range(3000))
    assert heaps.held[0] == best[:10]


def test_empty_tables(spark):
    assert made(spark, [], [(1, "a")]) == []
    assert made(spark, [(1, "a")], []) == []


def test_equals_sql(spark):
    found = lexical_search.search(lexical_search.index(table(spark, SF, "documents")), table(spark, SF, "benchmark"))
    oracle.check(found, oracle.connection(SF), lexical_search.ORACLE_SQL)


def test_row_groups_are_bounded_by_bytes(spark, monkeypatch):
    """Spark reads a row group at once, so a task's memory doesn't grow with the shards that a file holds."""
    import pyarrow.parquet as pq

    monkeypatch.setattr(lexical_search, "ROW_GROUPS", lexical_search.ROW_GROUPS | {"parquet.block.size": "100000"})
    draw = random.Random(5)
    found = lexical_search.index(spark.createDataFrame([(k, " ".join(f"w{draw.randrange(50_000)}" for _ in range(300_000))) for k in range(15)], "doc_id long, text string").coalesce(1))
    (file,) = found.inputFiles()
    held = pq.ParquetFile(file.removeprefix("file://")).metadata
    assert held.num_row_groups == held.num_rows == found.count() > 2
    assert {f.dataType.simpleString() for f in found.schema if f.name in ("sizes", "places", "tfs")} == {"binary"}

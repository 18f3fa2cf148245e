"""Retrieval against scoring every passage with every segment, and what is found."""

import random

import numpy as np
import pyarrow as pa

from skeinwork.llm import decontaminate as dc


def sample():
    draw = random.Random(5)
    vocabulary = ["".join(draw.choice("abcdefg") for _ in range(draw.randint(1, 5))) for _ in range(300)]
    weights = [1 / (k + 1) for k in range(300)]
    prose = lambda n: " ".join(draw.choices(vocabulary, weights, k=n))
    items = [f"{prose(draw.randint(6, 90))}? {prose(draw.randint(2, 30))}." for _ in range(60)]
    docs = []
    for i in range(80):
        text = prose(draw.randint(0, 400))
        if i % 4 == 0:
            words = text.split()
            cut = draw.randint(0, len(words))
            item = draw.choice(items)
            text = " ".join([*words[:cut], item.upper() if i % 8 else item, *words[cut:]])
        docs.append(text)
    return items, docs


def brute(index: dc.Index, hashes, bounds):
    """All (row, item) whose segments some passage scores above the threshold."""
    found = set()
    for r in range(len(bounds) - 1):
        own = hashes[bounds[r] : bounds[r + 1]]
        runs = [own[a : a + dc.SEGMENT] for a in range(0, max(1, len(own)), dc.SEGMENT)]
        passages = [runs[0], *(np.concatenate(runs[k : k + 2]) for k in range(len(runs) - 1)), runs[-1]]
        for passage in passages:
            score = np.zeros(len(index.threshold))
            there = np.isin(index.terms, passage)
            for seg in range(len(score)):
                at = slice(index.forward.at[seg], index.forward.at[seg + 1])
                score[seg] = index.forward.impact[at][there[index.forward.place[at]]].sum()
            found |= {(r, int(index.item[s])) for s in np.flatnonzero(score >= index.threshold * (1 - 1e-9))}
    return found


def test_retrieval_is_exhaustive():
    items, docs = sample()
    index = dc.build(list(range(len(items))), items)
    hashes, bounds = dc.terms_of(pa.array(docs))
    got = {(r, i) for r, i, *_ in dc.retrieve(index, hashes, bounds)}
    assert got == brute(index, hashes, bounds) and got


def test_planted_items_are_found_and_clean_documents_stay(spark):
    items, texts = sample()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(500, None, "x"), (501, "", "x"), (None, texts[0], "x")], "doc_id long, text string, item_id string")
    table = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(99, None), (98, ""), (0, items[0])], "item_id long, text string")
    held = {r["doc_id"] for r in dc.leaks(docs, table).collect()}
    assert {i for i in range(0, 80, 4)} <= held
    clean = dc.clean(docs, table)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == {i for i in range(80) if i not in held} | {500, 501, None}
    assert dc.leaks(docs, table.limit(0)).count() == 0 and dc.leaks(docs.limit(0), table).count() == 0


def brute_leaks(docs: list[str], items: list[str]) -> dict:
    """(row, item) to (score, question, answer): every passage scored with every segment, shares counted by hand."""
    stats = dc.statistics(items)
    index = dc.build(list(range(len(items))), items, stats)
    out = {}
    for r, text in enumerate(docs):
        own, _ = dc.terms_of(pa.array([text]))
        words = own.tolist()
        runs = max(1, -(-len(words) // dc.SEGMENT))
        for p in range(runs + 1):
            passage = np.array(words[max(0, p - 1) * dc.SEGMENT : (p + 1) * dc.SEGMENT], np.uint64)
            there = np.isin(index.terms, passage)
            for seg, item in enumerate(index.item.tolist()):
                at = slice(index.forward.at[seg], index.forward.at[seg + 1])
                score = index.forward.impact[at][there[index.forward.place[at]]].sum() / index.threshold[seg]
                if score < 1 - 1e-9:
                    continue
                reach = -(-int(index.size[item]) // dc.SEGMENT)
                near = np.array(words[max(0, p - 1 - reach) * dc.SEGMENT : (p + 1 + reach) * dc.SEGMENT], np.uint64)
                have = set(dc.shingles(near, np.array([0, len(near)]), dc.SHINGLE)[0].tolist())
                share = [sum(x in have for x in part.tolist()) / len(part) for part in index.parts[item]]
                if min(share) >= dc.OVERLAP:
                    old = out.get((r, item), (0.0, 0.0, 0.0))
                    out[r, item] = max(score, old[0]), *max((old[1:], tuple(share)), key=lambda s: (min(s), s))
    return out


def found(docs, table):
    return {(r["doc_id"], r["item_id"]): (round(r["score"], 9), round(r["question"], 9), round(r["answer"], 9)) for r in dc.leaks(docs, table).collect()}


def test_rows_and_scores_equal_brute_force_for_any_size_of_part(spark, monkeypatch):
    items, texts = sample()
    texts.append(" ".join(texts))  # a long one
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = {k: tuple(round(x, 9) for x in v) for k, v in brute_leaks(texts, items).items()}
    assert found(docs, table) == want and len(want) >= 20
    monkeypatch.setattr(dc, "INDEX_WORDS", 700)
    assert dc.indexes(table).count() > 2
    assert found(docs, table) == want


def test_ids_that_are_words(spark):
    items, texts = sample()
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "doc_id string, text string")
    table = spark.createDataFrame([(f"i{i}", t) for i, t in enumerate(items)], "item_id string, text string")
    assert {k for k, _ in found(docs, table)} >= {f"d{i}" for i in range(0, 80, 4)}

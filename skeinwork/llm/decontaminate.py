"""Benchmark decontamination: a BM25 inverted index of test items, queried with every passage of the corpus.

Items are cut into segments of at most ``SEGMENT`` words, and the segments are indexed: for each term the segments
that have it with their BM25 impacts, and, for block-max pruning, the largest impact in every block of ``BLOCK``
segments and where the block's postings lie. Document frequencies, the number of segments and their mean length are
taken over all items, however the index is cut. A passage is two neighbouring runs of ``SEGMENT`` words, each run
belonging to two passages, so a segment lies whole in some passage. A segment is retrieved where a passage scores at
least ``RETRIEVE`` of what the segment scores against itself.

As in WAND, each segment's commonest terms whose impacts together stay below its threshold are optional: a passage
without any of its other terms can't reach it, so optional terms have no postings. A passage first adds up the largest
impacts of blocks; only the postings of blocks whose bound reaches the least threshold in them are read, and only
segments whose sum of those and all optional terms reaches their own threshold are scored in full, term by term of
the segment. All passages of a batch go through each step together.

Retrieved items are verified on the passage and as many words around it as the item can reach: the shares of the
question's and the answer's word shingles (the last sentence is the answer) that stand there must both reach
``OVERLAP``. Words are compared without case and outer punctuation.

The index is built in tasks, in parts of about ``INDEX_WORDS`` words of items, so that a part's size is bounded; one
part at a time is broadcast and all documents query it. Null and empty texts and items match nothing; null ids match
nothing; rows and items that repeat match alike; ids may be of any type; a long text is queried whole, passage by
passage; other columns may be null or have any name; empty tables give an empty result.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from skeinwork.llm.arrays import buffer_of, pieces, shingles, span_hashes, words
from skeinwork.llm.common import staged

SEGMENT = 64
BLOCK = 16
#: Words of items in a part of the index: some 40 bytes each when broadcast.
INDEX_WORDS = 500_000
RETRIEVE = 0.5
OVERLAP = 0.6
K1, B = 1.2, 0.75
SHINGLE = 5

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_OUTER = np.zeros(256, bool)
_OUTER[[ord(c) for c in ".,;:!?\"'()[]{}<>*#$%&|-_/\\"]] = True


def terms_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every row's words, lower-cased and without outer punctuation, and each row's offsets into them."""
    data, offsets = buffer_of(column)
    data = _FOLD[data]
    starts, ends, bounds = words(data, offsets)
    for _ in range(4):  # further punctuation stays
        cut = (ends - starts > 1) & _OUTER[data[np.maximum(ends - 1, 0)]] if len(ends) else np.zeros(0, bool)
        ends = ends - cut
        cut = (ends - starts > 1) & _OUTER[data[starts]] if len(ends) else np.zeros(0, bool)
        starts = starts + cut
    return span_hashes(data, starts, ends), bounds


@dataclass
class Postings:
    """Rows of (place, impact) for each term, in compressed form."""

    at: np.ndarray
    place: np.ndarray
    impact: np.ndarray

    @staticmethod
    def of(term: np.ndarray, place: np.ndarray, impact: np.ndarray, n: int) -> Postings:
        order = np.lexsort((place, term))
        return Postings(np.searchsorted(term[order], np.arange(n + 1)), place[order], impact[order])

    def rows(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``key``, place in the postings) of all postings of some keys."""
        return _spread(self.at[key], self.at[key + 1])


def _spread(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, number) of all numbers in some ranges."""
    count = stop - start
    total = np.cumsum(count)
    which = np.repeat(np.arange(len(count)), count)
    return which, np.arange(total[-1] if len(total) else 0) - (total - count)[which] + start[which]


@dataclass
class Index:
    """The index of some items.

    ``essential`` and ``blocks`` are by term, ``cuts`` says where a block's postings begin in ``essential``, ``forward``
    has each segment's terms; ``parts`` has each item's question and answer shingles and ``size`` its words.
    """

    ids: list
    terms: np.ndarray
    item: np.ndarray
    threshold: np.ndarray
    optional: np.ndarray
    forward: Postings
    essential: Postings
    blocks: Postings
    cuts: np.ndarray
    parts: list[tuple[np.ndarray, np.ndarray]]
    size: np.ndarray


@dataclass
class Statistics:
    """Document frequencies by sorted term, and the number and the mean length of all segments."""

    terms: np.ndarray
    df: np.ndarray
    segments: int
    mean: float


def _segments(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(item, words) of each segment, (term, segment, count) of their distinct terms, and each item's words."""
    hashes, bounds = terms_of(pa.array(texts, pa.string()))
    size = np.diff(bounds)
    count = -(-size // SEGMENT)
    item, k = _spread(np.zeros(len(size), np.int64), count)
    length = np.minimum(size[item] - k * SEGMENT, SEGMENT)
    word_item = np.repeat(np.arange(len(size)), size)
    seg = (np.cumsum(count) - count)[word_item] + (np.arange(len(hashes)) - bounds[:-1][word_item]) // SEGMENT
    order = np.lexsort((hashes, seg))
    term, place = hashes[order], seg[order]
    new = np.ones(len(term), bool)
    new[1:] = (term[1:] != term[:-1]) | (place[1:] != place[:-1])
    first = np.flatnonzero(new)
    return item, length, term[first], place[first], np.diff(np.append(first, len(term))), size


def statistics(texts: list[str]) -> Statistics:
    """The statistics of some items by themselves."""
    _, length, term, _, _, _ = _segments(texts)
    terms, df = np.unique(term, return_counts=True)
    return Statistics(terms, df, len(length), float(length.mean()) if len(length) else 1.0)


def build(ids: list, texts: list[str], known: Statistics | None = None) -> Index | None:
    """The index of items with at least one word; None where there are none. ``known`` are the statistics of all items."""
    known = known or statistics(texts)
    item, length, term, place, tf, size = _segments(texts)
    n = len(item)
    if not n:
        return None
    vocabulary, term = np.unique(term, return_inverse=True)
    df = known.df[np.searchsorted(known.terms, vocabulary)].astype(np.float64)
    idf = np.log(1 + (known.segments - df + 0.5) / (df + 0.5))
    impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[place] / known.mean))
    own = np.bincount(place, impact, n)
    threshold = RETRIEVE * own
    # from the commonest term on, terms stay optional while their impacts sum to less than the threshold
    order = np.lexsort((term, -df[term], place))
    run = np.cumsum(impact[order])
    first = np.searchsorted(place[order], np.arange(n))
    before = np.where(first > 0, run[first - 1], 0.0)
    optional_row = np.zeros(len(term), bool)
    optional_row[order] = run - before[place[order]] < threshold[place[order]] * (1 - 1e-9)
    optional = np.bincount(place, np.where(optional_row, impact, 0.0), n)
    must = ~optional_row
    essential = Postings.of(term[must], place[must], impact[must], len(vocabulary))
    wide = n // BLOCK + 1
    keys = np.repeat(np.arange(len(vocabulary)), np.diff(essential.at)) * wide + essential.place // BLOCK
    heads, cuts = np.unique(keys, return_index=True)
    blocks = Postings(np.searchsorted(heads // wide, np.arange(len(vocabulary) + 1)), heads % wide, np.maximum.reduceat(essential.impact, cuts) if len(cuts) else np.zeros(0))
    return Index(ids, vocabulary, item, threshold, optional, Postings.of(place, term, impact, n), essential, blocks, np.append(cuts, len(keys)), [_halves(t) for t in texts], size)


def _halves(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of the question and the answer; an item of one sentence is split at half its words."""
    cut = [m.end() for m in re.finditer(r"[.!?]+\s+", text.rstrip())]
    if cut:
        parts = [text[: cut[-1]], text[cut[-1] :]]
    else:
        w = text.split()
        parts = [" ".join(w[: len(w) // 2]), " ".join(w[len(w) // 2 :])]
    found, at = shingles(*terms_of(pa.array(parts)), SHINGLE)
    halves = [np.unique(found[at[i] : at[i + 1]]) for i in (0, 1)]
    # a part shorter than a shingle is judged with the whole item
    whole = np.unique(np.concatenate(halves)) if min(map(len, halves)) == 0 else None
    if whole is None and min(len(p.split()) for p in parts) < SHINGLE:
        found, at = shingles(*terms_of(pa.array([text])), SHINGLE)
        whole = np.unique(found)
    return (whole, whole) if whole is not None else (halves[0], halves[1])


def _totals(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, each row's place among them, the sums of their values)."""
    keys, back = np.unique(key, return_inverse=True)
    return keys, back, np.bincount(back, value, len(keys))


def retrieve(index: Index, hashes: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(row, item, passage of the row, score over threshold) of all that some passage retrieves."""
    code = np.minimum(np.searchsorted(index.terms, hashes), len(index.terms) - 1)
    known = np.flatnonzero(index.terms[code] == hashes)
    if not len(known):
        return []
    row = np.searchsorted(bounds, known, "right") - 1
    runs = np.maximum(1, -(-np.diff(bounds) // SEGMENT))
    base = np.concatenate([[0], np.cumsum(runs + 1)])  # a passage for each run and the one before; one more at the end
    run = base[row] + (known - bounds[row]) // SEGMENT
    code = code[known]

    def queries(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct (passage, term) rows of some tokens."""
        pair = np.sort(np.concatenate([run[tokens], run[tokens] + 1]).astype(np.int64) * len(index.terms) + np.tile(code[tokens], 2))
        pair = pair[np.concatenate([[True], pair[1:] != pair[:-1]])] if len(pair) else pair
        return pair // len(index.terms), pair % len(index.terms)

    passage, term = queries(np.flatnonzero(np.diff(index.essential.at)[code]))
    n = len(index.threshold)
    wide = n // BLOCK + 1
    slack = np.concatenate([index.threshold - index.optional, np.full(wide * BLOCK - n, np.inf)]).reshape(wide, BLOCK)
    row_of, at = index.blocks.rows(term)
    keys, back, bound = _totals(passage[row_of] * wide + index.blocks.place[at], index.blocks.impact[at])
    alive = np.flatnonzero((bound >= slack.min(1)[keys % wide] * (1 - 1e-9))[back])  # no other block holds a segment in reach
    which, posting = _spread(index.cuts[at[alive]], index.cuts[at[alive] + 1])
    keys, _, score = _totals(passage[row_of[alive]][which] * n + index.essential.place[posting], index.essential.impact[posting])
    wanted = keys[score + index.optional[keys % n] >= index.threshold[keys % n] * (1 - 1e-9)]
    if not len(wanted):
        return []
    held = np.zeros(base[-1] + 1, bool)
    held[wanted // n] = True
    passage, term = queries(np.flatnonzero(held[run] | held[run + 1]))
    have = passage * len(index.terms) + term  # sorted
    which, posting = index.forward.rows(wanted % n)
    asked = (wanted // n)[which] * len(index.terms) + index.forward.place[posting]
    there = have[np.minimum(np.searchsorted(have, asked), len(have) - 1)] == asked
    score = np.bincount(which[there], index.forward.impact[posting][there], len(wanted))
    ratio = score / index.threshold[wanted % n]
    wanted, ratio = wanted[ratio >= 1 - 1e-9], ratio[ratio >= 1 - 1e-9]
    rows = np.searchsorted(base, wanted // n, "right") - 1
    return list(zip(rows.tolist(), index.item[wanted % n].tolist(), (wanted // n - base[rows]).tolist(), ratio.tolist(), strict=True))


def indexes(items: DataFrame, text: str = "text") -> DataFrame:
    """(part, data): the index of all items in parts, each with the statistics of all."""
    kind = items.schema["item_id"].dataType.simpleString()
    rows = items.where(F.col("item_id").isNotNull() & F.col(text).isNotNull()).select("item_id", F.col(text).alias("_text")).distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, length, term, _, _, _ = _segments(batch.column(1).to_pylist())
            terms, df = np.unique(term, return_counts=True)
            columns = [pa.array([*terms.view(np.int64).tolist(), None], pa.int64()), pa.array(np.append(df, len(length)), pa.int64()), pa.array([0] * len(df) + [int(length.sum())], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["term", "df", "words"])

    terms = staged(rows.mapInArrow(count, "term bigint, df bigint, words bigint").groupBy("term").agg(F.sum("df").alias("df"), F.sum("words").alias("words")), "terms")
    whole = terms.where("term IS NULL").first()
    n, words_ = (whole["df"], whole["words"]) if whole else (0, 0)
    parts, mean = -(-max(1, words_) // INDEX_WORDS), words_ / max(1, n)
    dealt = rows.withColumn("part", F.expr(f"CAST(pmod(xxhash64(_text), {parts}) AS INT)"))

    def terms_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column(2).to_numpy()
            for k in np.unique(part):
                found = np.unique(terms_of(batch.column(1).filter(pa.array(part == k)))[0])
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(found), pa.int32()), pa.array(found.view(np.int64))], ["part", "term"])

    def make(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            term, df = right.column("term").to_numpy().view(np.uint64), right.column("df").to_numpy()
            order = np.argsort(term)
            left = left.sort_by([("item_id", "ascending"), ("_text", "ascending")])
            index = build(left.column("item_id").to_pylist(), left.column("_text").to_pylist(), Statistics(term[order], df[order], n, mean))
            out = [] if index is None else [(left.column("part")[0].as_py(), pickle.dumps(index))]
        return pa.table([pa.array([k for k, _ in out], pa.int32()), pa.array([d for _, d in out], pa.binary())], names=["part", "data"])

    of_part = dealt.select("item_id", "_text", "part").mapInArrow(terms_in, "part int, term bigint").distinct().join(terms.select("term", "df"), "term")
    return dealt.groupBy("part").cogroup(of_part.groupBy("part")).applyInArrow(make, "part int, data binary")


def leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text") -> DataFrame:
    """A row for each document and item that it holds: doc_id, item_id, score (over the threshold), question, answer.

    ``question`` and ``answer`` are the shares of their shingles around the passage where the lesser of them is greatest.
    """
    kind, item_kind = (df.schema[c].dataType.simpleString() for df, c in ((docs, "doc_id"), (items, "item_id")))
    shape = f"doc_id {kind}, item_id {item_kind}, score double, question double, answer double"
    picked = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.col(text).alias("_text"))
    context = docs.sparkSession.sparkContext
    index = staged(indexes(items, item_text), "index")
    found = []
    for part in sorted(r["part"] for r in index.select("part").collect()):  # one for each INDEX_WORDS words of items
        shared = context.broadcast(index.where(F.col("part") == part).first()["data"])
        found.append(staged(picked.mapInArrow(_finder(shared, items.schema["item_id"].dataType), shape), "leaks"))
        shared.unpersist()
    if not found:
        return docs.sparkSession.createDataFrame([], shape)
    best = F.max(F.struct(F.least("question", "answer").alias("least"), "question", "answer"))
    rows = reduce(DataFrame.unionAll, found).groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), best.alias("b"))
    return rows.select("doc_id", "item_id", "score", "b.question", "b.answer")


def _finder(shared, item_type):
    kind = to_arrow_type(item_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = pickle.loads(shared.value)
        for batch in pieces(batches, "_text"):
            hashes, bounds = terms_of(batch.column(1))
            rows, ids, scores, shares = [], [], [], []
            for r, i, passage, score in retrieve(index, hashes, bounds):
                reach = -(-int(index.size[i]) // SEGMENT)
                a = bounds[r] + max(0, (passage - 1 - reach) * SEGMENT)
                b = min(bounds[r + 1], bounds[r] + (passage + 1 + reach) * SEGMENT)
                have = np.unique(shingles(hashes[a:b], np.array([0, b - a]), SHINGLE)[0])
                share = [float(np.isin(part, have).mean()) for part in index.parts[i]]
                if min(share) >= OVERLAP:
                    rows.append(r)
                    ids.append(index.ids[i])
                    scores.append(score)
                    shares.append(share)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(ids, kind), pa.array(scores, pa.float64()), pa.array([s[0] for s in shares], pa.float64()), pa.array([s[1] for s in shares], pa.float64())],
                ["doc_id", "item_id", "score", "question", "answer"],
            )

    return run


def clean(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the documents that hold an item."""
    held = leaks(docs, items, text).select("doc_id").distinct()
    return docs.join(held, "doc_id", "left_anti").select(*docs.columns)

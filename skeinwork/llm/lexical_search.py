"""Ranked lexical search: an inverted index of each shard of documents, searched by WAND, and the shards' heaps merged.

A shard is a run of documents with its terms, their postings and the documents' lengths; the index holds every term of
every whole text and serves any items. A search goes through a shard for all items of a chunk in step: each item has a
cursor in every list of its terms. The cursors in the order of their documents, with the largest impact that a term has
in the shard, give the pivot: the first document that could reach the item's tenth score. If the first cursor stands
on it, it is scored; else the cursors before it jump to it, and what lies between is never looked at. A task keeps its
heaps from shard to shard, and only heaps leave it.

Null and empty texts have no terms: such a document is never found, such an item finds nothing. Every row is a document
of its own, so repeated rows are ranked one after the other; equal scores go by ascending ``doc_id``, null ids last.
Items may repeat or have null ids and are answered each. Other columns are ignored; empty tables give no rows; a text
of any length is one document of one shard.
"""

from __future__ import annotations

import re
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from skeinwork.llm.arrays import buffer_of
from skeinwork.llm.blocks import gathered, pack, unpack
from skeinwork.llm.common import staged
from skeinwork.llm.ranges import ranks_of

#: Best documents of an item.
MOST = 10
#: Terms of items, repeats left out, in a chunk that is searched in one pass over the index.
CHUNK_TERMS = 200_000
#: Cursors that move in step.
CURSORS = 1 << 15
#: Row groups of a few shards: Spark reads a row group at once, and Parquet looks at its size after 100 rows otherwise.
ROW_GROUPS = {"parquet.block.size": str(4 << 20), "parquet.page.size.row.check.min": "1"}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_IN_TERM = np.array([48 <= b < 58 or 97 <= b < 123 or b >= 128 for b in range(256)])


def terms_of(text: Column) -> Column:
    """The terms of a text in order: runs of digits, lower-cased ASCII letters and all beyond ASCII."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"), F.lit(0))


def _lists(values: list, ends: list[int], kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values if isinstance(values, pa.Array) else pa.array(values, kind))


def inverted(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Ids and lengths of the documents by ascending id; terms; for each term its number of documents; places and
    counts of all postings by term and document."""
    order = np.argsort(ranks_of(batch.column(0)), kind="stable") if batch.column(0).null_count < batch.num_rows else np.arange(batch.num_rows)
    batch = batch.take(pa.array(order))
    data, offsets = buffer_of(batch.column(1))
    raw = np.insert(data, offsets[1:-1], 10).tobytes().lower()
    found, codes = _TERM.findall(raw), {}
    inside = _IN_TERM[np.frombuffer(raw, np.uint8)]
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]) if len(inside) else inside)
    doc = np.searchsorted(offsets[:-1] + np.arange(len(order)), starts, "right") - 1
    code = np.array([codes.setdefault(t, len(codes)) for t in found], np.int64)
    keys, counts = np.unique(code * len(order) + doc, return_counts=True)
    return batch.column(0), np.bincount(doc, minlength=len(order)), list(codes), np.bincount(keys // max(1, len(order)), minlength=len(codes)), keys % max(1, len(order)), counts


def index(docs: DataFrame, text: str = "text") -> DataFrame:
    """(shard, n_docs, n_terms, ids, terms, dfs, sizes, places, tfs): a row for each shard, written to the shared folder.

    What is as long as the text is packed, so that the JVM passes it on without its elements.
    """
    kind = docs.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)
    shape = f"shard bigint, n_docs bigint, n_terms bigint, ids array<{kind.simpleString()}>, terms array<string>, dfs array<int>, sizes binary, places binary, tfs binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n = TaskContext.get().partitionId() << 33, 0
        for batch, _ in gathered(batches, "_text", 1):
            ids, sizes, terms, dfs, places, tfs = inverted(batch)
            numbers = [pa.array([x], pa.int64()) for x in (base + n, int((sizes > 0).sum()), int(sizes.sum()))]
            held = [(ids.cast(id_type), id_type), ([t.decode() for t in terms], pa.string()), (dfs, pa.int32())]
            packed = [pa.array([pack(x.astype(np.int32))], pa.binary()) for x in (sizes, places, tfs)]
            yield pa.RecordBatch.from_arrays([*numbers, *(_lists(x, [0, len(x)], k) for x, k in held), *packed], ["shard", "n_docs", "n_terms", "ids", "terms", "dfs", "sizes", "places", "tfs"])
            n += 1

    return staged(docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("_text")).mapInArrow(run, shape), "index", **ROW_GROUPS)


def weighted(found: DataFrame, items: DataFrame, n_docs: int) -> DataFrame:
    """(item, terms) of items (item, text): their terms, each with its weight times its occurrences in the item."""
    asked = items.select("item", F.explode(terms_of(F.col("text"))).alias("term")).groupBy("item", "term").agg(F.count("*").alias("times"))
    held = found.select(F.explode(F.arrays_zip(F.col("terms").alias("term"), F.col("dfs").alias("df"))).alias("p")).select("p.term", "p.df")
    counts = held.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    return asked.join(counts, "term").groupBy("item").agg(F.collect_list(F.struct("term", (weight * F.col("times")).alias("weight"))).alias("terms"))


class Heaps:
    """The best documents of every item so far, as (-score, id is null, id) in order."""

    def __init__(self, n: int):
        self.held: list[list[tuple]] = [[] for _ in range(n)]
        self.least = np.ones(n, np.int64)  # the score that a document needs, ties included

    def offer(self, item: int, score: int, doc_id) -> None:
        own = self.held[item]
        insort(own, (-score, doc_id is None, "" if doc_id is None else doc_id))
        del own[MOST:]
        if len(own) == MOST:
            self.least[item] = -own[-1][0]


class Shard:
    """Postings of the terms that items ask for, with what each is worth."""

    def __init__(self, row: dict, number_of: dict[str, int], n_docs: int, n_terms: int):
        self.ids = row["ids"]
        self.n = len(self.ids)
        cuts = np.concatenate([[0], np.cumsum(row["dfs"])])
        kept = [(number_of[t], k) for k, t in enumerate(row["terms"]) if t in number_of]
        self.slot = np.full(len(number_of), -1)
        self.slot[[t for t, _ in kept]] = np.arange(len(kept))
        at = [np.arange(cuts[k], cuts[k + 1]) for _, k in kept]
        flat = np.concatenate([np.zeros(0, np.int64), *at])
        self.cuts = np.concatenate([[0], np.cumsum([len(a) for a in at])]).astype(np.int64)
        self.doc, tf = row["places"][flat].astype(np.int64), row["tfs"][flat].astype(np.int64)
        norm = 100 - 75 + (75 * row["sizes"].astype(np.int64) * n_docs) // max(1, n_terms)
        self.impact = (1_000_000_000 * tf) // (1000 * tf + 8 * norm[self.doc])
        self.most = np.maximum.reduceat(self.impact, self.cuts[:-1]) if kept else np.zeros(0, np.int64)
        self.key = np.repeat(np.arange(len(kept)), np.diff(self.cuts)) * (self.n + 1) + self.doc


def wand(shard: Shard, terms: np.ndarray, weights: np.ndarray, items: np.ndarray, heaps: Heaps) -> int:
    """Search a shard for some items, whose terms are rows of numbers (-1 for none); the number of documents scored."""
    slot = np.where(terms >= 0, shard.slot[terms], -1)
    width = (slot >= 0).sum(1)
    order = np.argsort(slot < 0, axis=1, kind="stable")[:, : max(1, width.max(initial=0))]
    slot, weights = np.take_along_axis(slot, order, 1), np.take_along_axis(weights, order, 1)
    own = slot >= 0
    at, end = np.where(own, shard.cuts[slot], 0), np.where(own, shard.cuts[slot + 1], 0)
    bound = np.where(own, weights * (shard.most[slot] if len(shard.most) else 0), 0)
    docs = np.append(shard.doc, shard.n)
    here = np.where(own, docs[at], shard.n)
    scored = 0
    keep = width > 0
    while True:
        if not keep.all():
            items, slot, weights, at, end, bound, here = (x[keep] for x in (items, slot, weights, at, end, bound, here))
        if not len(items):
            return scored
        rows = np.arange(len(items))
        by = np.argsort(here, axis=1)
        reach = np.cumsum(np.take_along_axis(bound, by, 1), 1) >= heaps.least[items][:, None]
        first = np.where(reach.any(1), reach.argmax(1), -1)
        pivot = np.where(first >= 0, here[rows, by[rows, first]], shard.n)
        keep = pivot < shard.n
        ready = keep & (here[rows, by[:, 0]] == pivot)
        on = (here == pivot[:, None]) & ready[:, None]
        r, c = np.nonzero(on)
        total = np.zeros(len(items), np.int64)
        np.add.at(total, r, weights[r, c] * shard.impact[at[r, c]])
        scored += int(ready.sum())
        for k in np.flatnonzero(ready & (total >= heaps.least[items])).tolist():
            heaps.offer(int(items[k]), int(total[k]), shard.ids[int(pivot[k])])
        at[r, c] += 1
        behind = (here < pivot[:, None]) & (keep & ~ready)[:, None]
        i, j = np.nonzero(behind)
        at[i, j] = np.searchsorted(shard.key, slot[i, j] * (shard.n + 1) + pivot[i])
        moved = on | behind
        here[moved] = np.where(at[moved] < end[moved], docs[np.minimum(at[moved], len(docs) - 1)], shard.n)


def searched(found: DataFrame, chunk: list[tuple[int, list[tuple[str, int]]]], n_docs: int, n_terms: int) -> DataFrame:
    """(item, doc_id, score): the best documents of the chunk's items among those of each task."""
    id_type = to_arrow_type(found.schema["ids"].dataType.elementType)
    number_of: dict[str, int] = {}
    chunk = sorted(chunk, key=lambda x: len(x[1]))
    asked = [(item, [number_of.setdefault(t, len(number_of)) for t, _ in terms], [w for _, w in terms]) for item, terms in chunk]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps, groups, low = Heaps(len(asked)), [], 0
        while low < len(asked):
            high = low + 1
            while high < len(asked) and (high + 1 - low) * len(asked[high][1]) <= CURSORS:
                high += 1
            width = len(asked[high - 1][1])
            terms, weights = np.full((high - low, width), -1), np.zeros((high - low, width), np.int64)
            for k, (_, t, w) in enumerate(asked[low:high]):
                terms[k, : len(t)], weights[k, : len(w)] = t, w
            groups.append((terms, weights, np.arange(low, high)))
            low = high
        for batch in batches:
            for k in range(batch.num_rows):
                ids, terms, dfs = (batch.column(name)[k].values for name in ("ids", "terms", "dfs"))
                row = {"ids": ids.to_pylist(), "terms": terms.to_pylist(), "dfs": dfs.to_numpy(zero_copy_only=False)} | {name: unpack(batch.column(name)[k].as_py(), np.int32) for name in ("sizes", "places", "tfs")}
                shard = Shard(row, number_of, n_docs, n_terms)
                for group in groups:
                    wand(shard, *group, heaps)
        best = [(asked[k][0], None if null else doc, -score) for k, own in enumerate(heaps.held) for score, null, doc in own]
        columns = [pa.array([b[k] for b in best], kind) for k, kind in enumerate((pa.int64(), id_type, pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score"])

    kind = found.schema["ids"].dataType.elementType.simpleString()
    return found.select("ids", "terms", "dfs", "sizes", "places", "tfs").mapInArrow(run, f"item bigint, doc_id {kind}, score bigint")


def search(found: DataFrame, items: DataFrame, text: str = "text", chunk_terms: int = CHUNK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the best documents of every item in an ``index``."""
    asked = staged(items.select(F.monotonically_increasing_id().alias("item"), "item_id", F.col(text).alias("text")), "items")
    n_docs, n_terms = found.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    queries = staged(weighted(found, asked, n_docs), "queries")
    n = -(-(queries.agg(F.sum(F.size("terms"))).first()[0] or 0) // chunk_terms)
    parts = []
    for k in range(n):
        chunk = [(r.item, [(t.term, t.weight) for t in r.terms]) for r in queries.where(F.pmod(F.xxhash64("item"), F.lit(n)) == k).collect()]
        parts.append(staged(searched(found, chunk, n_docs, n_terms), "heaps"))
    best = asked.sparkSession.createDataFrame([], f"item bigint, doc_id {found.schema['ids'].dataType.elementType.simpleString()}, score bigint")
    for part in parts:
        best = best.unionAll(part)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= MOST)
    return ranked.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


ORACLE_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS terms FROM documents)
, s AS (SELECT count(*) FILTER (len(terms) > 0) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM d)
, p AS (SELECT r, doc_id, term, count(*) AS tf, any_value(m) AS m FROM (SELECT r, doc_id, unnest(terms) AS term, 100 - 75 + (75 * len(terms) * n_docs) // n_terms AS m FROM d, s WHERE len(terms) > 0) GROUP BY r, doc_id, term)
, f AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term)
, i AS (SELECT row_number() OVER () AS item, item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS terms FROM benchmark)
, q AS (SELECT item, item_id, unnest(terms) AS term FROM i)
, z AS (SELECT item, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN f USING (term) JOIN p USING (term) GROUP BY item, item_id, r, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM z WHERE score > 0) WHERE rank <= {MOST}"""

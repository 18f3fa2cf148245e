"""Substring deduplication by hashing units.

A unit is a line or a part of one that ends with a punctuation mark: a new unit begins with each word that follows a
line's end or a word ending in one of ``ENDS``, and reaches to the next unit. A unit is normalised (A-Z lower-cased, a
space between words) and hashed; digests are grouped over all documents, and the document with the least id keeps its
occurrences. Elsewhere the unit is a repeat. Repeats go where neighbouring ones together have ``MIN_WORDS`` words or
more, so that a passage goes however it is wrapped and wherever in a line it begins, and a stock line or a short
phrase that repeats by chance stays. Spans are offsets in the original text (code points, ends exclusive).

Documents lie in blocks that are written once (``blocks.Bucketed``); a block asks about its own distinct units
(``ranges``), so a unit that a third of all documents share is one entry for each block, and no text is joined.
Digests have 64 bits: two different units are taken for equal with a chance of 2^-64 a pair.

Null and empty texts have no units and come out empty; rows with one id don't repeat each other; null ids stay whole
and lend nothing; ids of any type that can be compared will do; a long text is a block of its own and is read whole;
other columns may be null or have any name; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from skeinwork.llm.arrays import buffer_of, pieces, sequence_hashes, span_hashes, words
from skeinwork.llm.blocks import Bucketed, blocks, opened, pack_sorted
from skeinwork.llm.common import staged
from skeinwork.llm.ranges import ANSWER, QUESTION, cuts_of, flags_of, grouped, heads_of, of_least, pack_ids, questions, ranges_log, ranks_of

MIN_WORDS = 35
ENDS = ".,!?;:"
PIECE = 1 << 19
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ENDS]] = True


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first byte, number of words, digest) of the units of some texts in order."""
    starts, ends, bounds = words(data, offsets)
    if not len(starts):
        return (*(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, np.uint64))
    row = np.searchsorted(offsets, starts, "right") - 1
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    new = np.ones(len(starts), bool)
    new[1:] = (row[1:] != row[:-1]) | _ENDS[data[ends[:-1] - 1]] | (lines[starts[1:]] != lines[ends[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts))
    return row[first], starts[first], last - first, sequence_hashes(span_hashes(_FOLD[data], starts, ends), first, last)


class Block:
    """The units of a block, and of its distinct ones the first documents."""

    def __init__(self, data: bytes):
        self.batch = opened(data)
        self.rank = ranks_of(self.batch.column(0))
        found, at, base = [], 0, 0
        for piece in pieces(iter([self.batch]), "_text", PIECE):
            content, offsets = buffer_of(piece.column(1))
            row, start, n, key = units(content, offsets)
            found.append((row + at, start + base, n, key))
            at, base = at + piece.num_rows, base + len(content)
        self.row, self.start, self.n, key = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
        rank = self.rank[self.row]
        self.order = np.lexsort((rank, key))
        key, rank = key[self.order], rank[self.order]
        heads = heads_of(key)
        self.asked, self.head, self.group = key[heads], self.order[heads], grouped(heads, len(key))
        self.late = rank != rank[heads][self.group]

    def repeats(self, covered: np.ndarray) -> np.ndarray:
        """Whether each unit, in order, is one that a smaller document has."""
        out = np.empty(len(self.order), bool)
        out[self.order] = self.late | covered[self.group]
        return out


def stretches(row: np.ndarray, n: np.ndarray, repeat: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(first unit, unit after the last) of neighbouring repeats of one row with enough words together."""
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (repeat[1:] != repeat[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row))
    total = np.concatenate([[0], np.cumsum(n)])
    keep = repeat[first] & (total[last] - total[first] >= min_words) if len(first) else np.zeros(0, bool)
    return first[keep], last[keep]


_ROW = ["doc_id", "n_removed", "n_removed_chars", "removed", "kept_text"]


def _rows(batch: pa.RecordBatch, row: np.ndarray, count: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Table:
    """The result for a block from the byte spans that go and their numbers of units."""
    content, offsets = buffer_of(batch.column(1))
    chars = np.concatenate([[0], np.cumsum((content & 0xC0) != 0x80)])
    data, cut = content.tobytes(), np.searchsorted(row, np.arange(batch.num_rows + 1)).tolist()
    out: list[list] = [[], [], [], []]
    for r in range(batch.num_rows):
        lo, hi = int(offsets[r]), int(offsets[r + 1])
        spans, kept, last = [], [], lo
        for x, y in zip(a[cut[r] : cut[r + 1]].tolist(), b[cut[r] : cut[r + 1]].tolist(), strict=True):
            kept.append(data[last:x])
            spans.append((int(chars[x] - chars[lo]), int(chars[y] - chars[lo])))
            last = y
        kept.append(data[last:hi])
        values = int(count[cut[r] : cut[r + 1]].sum()), sum(y - x for x, y in spans), ",".join(f"{x}:{y}" for x, y in spans), b"".join(kept).decode()
        for column, value in zip(out, values, strict=True):
            column.append(value)
    kinds = pa.int64(), pa.int64(), pa.string(), pa.string()
    return pa.table([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=_ROW)


def dedupe(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """A row for each document: doc_id, n_removed (units), n_removed_chars, removed (start:stop of stretches), kept_text."""
    kind, id_type = docs.schema["doc_id"].dataType.simpleString(), to_arrow_type(docs.schema["doc_id"].dataType)
    shape = f"doc_id {kind}, n_removed bigint, n_removed_chars bigint, removed string, kept_text string"
    own = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("_text"))
    table = Bucketed(blocks(own.where("doc_id IS NOT NULL")), "block", "lines")
    held = table.rows.select("block", "data")
    log = ranges_log(table.rows.agg(F.sum("size")).first()[0] or 0)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                block = Block(data)
                row = lambda a, b: [pack_sorted(block.asked[a:b]), b"", pack_ids(block.batch.column(0), block.rank, block.row[block.head[a:b]])]  # noqa: E731, B023
                yield from questions(number, log, 64, block.asked, row).to_batches()

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for data in left.column("data").to_pylist():
            block = Block(data)
            repeat = block.repeats(*flags_of(right, 1, cuts_of(block.asked, 64, log), 1))
            first, last = stretches(block.row, block.n, repeat, min_words)
            offsets = buffer_of(block.batch.column(1))[1]
            starts = np.append(block.start, 0)
            same = np.append(block.row[1:] == block.row[:-1], [False])[last - 1]  # else the text ends with the stretch
            stop = np.where(same, starts[last], offsets[block.row[first] + 1])
            out.append(_rows(block.batch, block.row[first], last - first, block.start[first], stop))
        return pa.concat_tables(out)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for batch in pieces(batches, "_text"):
            yield from _rows(batch, none, none, none, none).to_batches()

    answers = staged(held.mapInArrow(ask, QUESTION).groupBy("part").applyInArrow(of_least(id_type, 1), ANSWER), "units")
    done = staged(held.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(cut, shape), "lines")
    table.drop()
    return done.unionAll(own.where("doc_id IS NULL").mapInArrow(whole, shape))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
, w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*') AS w FROM d)
, p AS (SELECT doc_id, i, w[i] AS piece, regexp_extract(w[i], '^[^\x20\x09-\x0D]+') AS word,
    i > 1 AND (regexp_matches(w[greatest(i - 1, 1)], '[.,!?;:][\x20\x09-\x0D]+$') OR contains(w[greatest(i - 1, 1)], chr(10))) OR i = 1 AS new
    FROM w, unnest(range(1, len(w) + 1)) AS r(i))
, u AS (SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS u FROM p)
, k AS (SELECT doc_id, u, count(*) AS n, sum(length(piece)) AS chars,
    string_agg(translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' ORDER BY i) AS key FROM u GROUP BY doc_id, u)
, f AS (SELECT *, min(doc_id) OVER (PARTITION BY key) < doc_id AS rep FROM k)
, s AS (SELECT *, u - row_number() OVER (PARTITION BY doc_id, rep ORDER BY u) AS stretch,
    sum(chars) OVER (PARTITION BY doc_id ORDER BY u) AS upto FROM f)
, g AS (SELECT *, rep AND sum(n) OVER (PARTITION BY doc_id, rep, stretch) >= 35 AS gone FROM s)
, h AS (SELECT doc_id, stretch, count(*) AS n, min(upto - chars) AS a, max(upto) AS b FROM g WHERE gone GROUP BY doc_id, stretch)
, lead AS (SELECT doc_id, t, length(regexp_extract(t, '^[\x20\x09-\x0D]*')) AS lead FROM d)
, r AS (SELECT doc_id, sum(n) AS n, sum(b - a) AS chars, string_agg((a + lead) || ':' || (b + lead), ',' ORDER BY a) AS removed FROM h JOIN lead USING (doc_id) GROUP BY doc_id)
, q AS (SELECT doc_id, string_agg(piece, '' ORDER BY i) AS kept FROM (SELECT u.doc_id, u.i, u.piece FROM u JOIN g USING (doc_id, u) WHERE NOT gone) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(r.n, 0) AS BIGINT) AS n_removed, CAST(coalesce(r.chars, 0) AS BIGINT) AS n_removed_chars, coalesce(removed, '') AS removed,
    left(t, lead) || coalesce(kept, '') AS kept_text
FROM lead LEFT JOIN r USING (doc_id) LEFT JOIN q USING (doc_id)
"""

"""Exact substring deduplication by bucket-pointer refinement.

A string of ``LENGTH`` bytes goes wherever it also starts in a document with a smaller id. Positions lie in buckets,
known by a bucket identifier; a bucket is refined by the identifier of a later offset, the new identifiers take the
place of the old ones, and the next refinement sorts by those:

* The initial buckets are the 8-grams. The bucket of the 16-gram at i is refined from the bucket at i by that at i + 8,
  the 32-gram's from the 16-gram's at i and i + 16, and the 50-gram's from the 32-gram's at i and i + 18.
* What is in a bucket of one document only can't be shared, nor can anything refined from it, so buckets are compared
  over all documents three times, each time for the positions still open:

  1. *Buckets of 32-grams.* Each string is filed under one of its 32-grams, the one with the least identifier (its
     anchor), so that neighbouring strings mostly share one and equal strings have equal anchors. Anchors in one
     document close all their strings.
  2. *Runs.* Neighbouring strings with one anchor are a run, known by the anchor's bucket and its content. Runs that a
     smaller document has go as a whole; a bucket whose runs are all equal is settled; in the others the first
     document's run of each content stays open, as all that its strings can still meet are other contents' first runs.
  3. *Buckets of 50-grams.* The strings of open runs are refined to their last bucket, whose least document keeps them.

Documents lie in blocks that are written once, bucketed by block (``blocks.Bucketed``). A block asks about its own
distinct buckets only: sorted, delta-coded arrays, a row for each range of identifiers. A range sorts what all blocks
ask and answers in bits, and only the answers travel back to the blocks. So a bucket that a third of all documents has
is one entry for each block. Anchors in more than ``HOT`` blocks aren't gathered by anchor in the second comparison
but by content; their runs count as of several contents, which opens more strings and changes no result.

Bucket identifiers are 64-bit hashes of the pair that they were refined from, so two different strings are taken for
equal with a chance of 2^-64 a pair.

Null and empty texts have no strings. Null ids have no order: their documents are left whole and lend nothing. Rows
with one id lend nothing to each other; each is held against the documents with smaller ids. Ids of any type that
can be compared will do. A text longer than ``WINDOW`` is worked off in windows that overlap by ``LENGTH`` - 1 bytes,
each with runs of its own, so its length bounds nothing but the text itself. An empty table gives an empty result;
other columns may be null or have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from skeinwork.llm.arrays import buffer_of, finish, mix, pieces, span_hashes
from skeinwork.llm.blocks import Bucketed, blocks, opened, pack, pack_sorted, unpack, unpack_sorted
from skeinwork.llm.common import staged
from skeinwork.llm.ranges import ANSWER, QUESTION, answer_rows, cuts_of, flags_of, grouped, heads_of, of_least, pack_ids, questions, ranges_log, ranks_of, unpacked_ids

LENGTH = 50
GRAM = 32
#: Bytes of text that a task refines at a time.
WINDOW = 1 << 18
#: An anchor in more blocks than this is hot.
HOT = 64
_PLACE = np.uint64((1 << 28) - 1)
_16 = np.uint64(16)
_1 = np.uint64(1)


# --- buckets within a text -----------------------------------------------------------------------------


def refined(at: np.ndarray, later: np.ndarray) -> np.ndarray:
    """The identifiers of buckets refined by those of a later offset."""
    return finish(mix(at, later))


def buckets(data: np.ndarray) -> np.ndarray:
    """The identifier of the ``GRAM``-gram bucket of every position that has one."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    data = np.ascontiguousarray(data)
    ids = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,)).astype(np.uint64)
    width = 8
    while width < GRAM:
        ids = refined(ids[:-width], ids[width:])
        width *= 2
    return ids


def windows(offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, first byte, offsets from there) of pieces of about ``WINDOW`` bytes that hold every string once."""
    row, n = 0, len(offsets) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + WINDOW, "right")) - 1)
        if stop > row + 1 or offsets[row + 1] - offsets[row] <= WINDOW:
            yield row, int(offsets[row]), offsets[row : stop + 1] - offsets[row]
        else:
            for lo in range(int(offsets[row]), int(offsets[row + 1]), WINDOW):
                yield row, lo, np.array([0, min(int(offsets[row + 1]), lo + WINDOW + LENGTH - 1) - lo])
        row = stop


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first string, last string, bucket of the anchor, bucket of the content) of a window's runs."""
    ids, width = buckets(data), LENGTH - GRAM + 1
    if len(data) < LENGTH:
        return (*(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    low = (ids & ~_PLACE) | np.arange(len(ids), dtype=np.uint64)
    k = 1
    while k < width:
        step = min(k, width - k)
        low = np.minimum(low[:-step], low[step:])
        k += step
    place = (low & _PLACE).astype(np.int64)
    end = np.repeat(offsets[1:], np.diff(offsets))[: len(place)]
    start = np.flatnonzero(np.arange(len(place)) + LENGTH <= end)
    place = place[start]
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    a, at = start[first], place[first]
    b = start[np.append(first[1:], len(start)) - 1] if len(start) else a
    content = finish(span_hashes(data, a, b + LENGTH) + (at - a).astype(np.uint64))
    anchor = finish(ids[at])  # least identifiers are small; this spreads them over the ranges
    return np.searchsorted(offsets, a, "right") - 1, a, b, anchor, refined(anchor, content)


def strings(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of the 50-gram, run, start) of all strings of some runs."""
    count = b - a + 1
    size = count + LENGTH - 1
    base = np.cumsum(size) - size
    ids = buckets(data[np.arange(size.sum()) - np.repeat(base - a, size)])
    run = np.repeat(np.arange(len(a)), count)
    step = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    at = base[run] + step
    return refined(ids[at], ids[at + LENGTH - GRAM]) if len(at) else np.zeros(0, np.uint64), run, a[run] + step


# --- a block's part ------------------------------------------------------------------------------------


class Block:
    """A block's open positions, from one comparison to the next."""

    def __init__(self, data: bytes):
        self.batch = opened(data)
        self.data, self.offsets = buffer_of(self.batch.column(1))
        parts = []
        for row, lo, offsets in windows(self.offsets):
            r, a, b, h, u = runs(self.data[lo : lo + int(offsets[-1])], offsets)
            parts.append((r + row, a + lo, b + lo, h >> _16, u))
        self.row, self.a, self.b, h, self.u = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
        self.rank = ranks_of(self.batch.column(0))
        order = np.lexsort((self.row, h))
        h = h[order]
        heads = heads_of(h)
        self.anchor = np.empty(len(h), np.int64)
        self.anchor[order] = grouped(heads, len(h))
        self.anchors = h[heads]
        many = np.zeros(len(heads), bool)
        many[grouped(heads, len(h))[1:][(h[1:] == h[:-1]) & (self.row[order][1:] != self.row[order][:-1])]] = True
        self.asked = (self.anchors << _1) | many

    def with_anchors(self, shared: np.ndarray, hot: np.ndarray) -> None:
        """Only runs of shared anchors stay; they are sorted by (filed, u), where ``filed`` is what they are gathered by."""
        keep = np.flatnonzero(shared[self.anchor])
        anchor, u = self.anchor[keep], self.u[keep]
        filed = (np.where(hot[anchor], u >> _16, self.anchors[anchor]) << _1) | hot[anchor]
        rank = self.rank[self.row[keep]]
        order = np.lexsort((rank, u, filed))
        keep = keep[order]
        self.row, self.a, self.b, self.u, self.filed, rank = self.row[keep], self.a[keep], self.b[keep], u[order], filed[order], rank[order]
        self.head = heads_of(self.filed, self.u)
        self.group = grouped(self.head, len(keep))
        self.first = rank == rank[self.head][self.group]

    def with_runs(self, covered: np.ndarray, open_: np.ndarray) -> None:
        """Covered runs give spans; the strings of open ones are sorted by their last bucket."""
        gone = ~self.first | covered[self.group]
        self.spans = [(self.row[gone], self.a[gone], self.b[gone] + LENGTH)]
        keep = np.flatnonzero(self.first & open_[self.group])
        self.key, run, self.start = strings(self.data, self.a[keep], self.b[keep])
        self.row = self.row[keep][run]
        rank = self.rank[self.row]
        order = np.lexsort((rank, self.key))
        self.key, self.start, self.row, rank = self.key[order], self.start[order], self.row[order], rank[order]
        self.head = heads_of(self.key)
        self.group = grouped(self.head, len(order))
        self.first = rank == rank[self.head][self.group]

    def with_strings(self, covered: np.ndarray) -> None:
        gone = ~self.first | covered[self.group]
        self.spans.append((self.row[gone], self.start[gone], self.start[gone] + LENGTH))



# --- the three comparisons -----------------------------------------------------------------------------


def _of_anchors(hot: int) -> Callable[[pa.Table], pa.Table]:
    """Which anchors several documents have, and which are in more than ``hot`` blocks."""

    def answer(group: pa.Table) -> pa.Table:
        found = [unpack_sorted(d, np.uint64) for d in group.column("data").to_pylist()]
        values = np.concatenate(found)
        order = np.argsort(values, kind="stable")
        key = values[order] >> _1
        heads = heads_of(key)
        times = np.diff(np.append(heads, len(key)))
        shared = (times > 1) | (np.bitwise_or.reduceat(values[order], heads) & _1 == 1)
        flags = np.empty((2, len(key)), bool)
        flags[:, order] = np.stack([shared, times > hot])[:, grouped(heads, len(key))]
        return answer_rows(group, 1, [len(x) for x in found], *flags)

    return answer


def _of_runs(kind: pa.DataType) -> Callable[[pa.Table], pa.Table]:
    """Which runs a smaller document has, and which of the first ones stay open."""

    def answer(group: pa.Table) -> pa.Table:
        found = [unpack_sorted(d, np.uint64) for d in group.column("data").to_pylist()]
        filed, u = np.concatenate(found), np.concatenate([unpack(d, np.uint64) for d in group.column("contents").to_pylist()])
        rank = unpacked_ids(group.column("ids").to_pylist(), kind)
        order = np.lexsort((rank, u, filed))
        filed, u, rank = filed[order], u[order], rank[order]
        heads, tops = heads_of(filed, u), heads_of(filed)
        late = rank != rank[heads][grouped(heads, len(rank))]
        several = (filed[tops] & _1 == 1) | (u[tops] != u[np.append(tops[1:], len(u)) - 1])
        flags = np.empty((2, len(rank)), bool)
        flags[:, order] = np.stack([late, ~late & several[grouped(tops, len(rank))]])
        return answer_rows(group, 2, [len(x) for x in found], *flags)

    return answer


def spans_of(block: Block, answers: pa.Table, log: int) -> None:
    """Take the block as far as the answers go."""
    kinds = set(answers.column("kind").to_pylist())
    if 1 in kinds:
        block.with_anchors(*flags_of(answers, 1, cuts_of(block.asked, 49, log), 2))
    else:
        none = np.zeros(len(block.anchors), bool)
        block.with_anchors(none, none)
    block.cuts = cuts_of(block.filed[block.head], 49, log)


def _asking(stage: int, log: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The questions of the second and the third comparison."""

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for number, data in zip(left.column("block").to_pylist(), left.column("data").to_pylist(), strict=True):
            block = Block(data)
            spans_of(block, right, log)
            if stage == 2:
                at = block.head
                filed, u = block.filed[at], block.u[at]
                out.append(questions(number, log, 49, filed, lambda a, b: [pack_sorted(filed[a:b]), pack(u[a:b]), pack_ids(block.batch.column(0), block.rank, block.row[at[a:b]])]))  # noqa: B023
            else:
                block.with_runs(*flags_of(right, 2, block.cuts, 2))
                at = block.head
                key = block.key[at]
                out.append(questions(number, log, 64, key, lambda a, b: [pack_sorted(key[a:b]), b"", pack_ids(block.batch.column(0), block.rank, block.row[at[a:b]])]))  # noqa: B023
        return pa.concat_tables(out) if out else questions(0, log, 49, np.zeros(0, np.uint64), lambda a, b: [])

    return ask


def _asked_anchors(log: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys = Block(data).asked
                yield from questions(number, log, 49, keys, lambda a, b: [pack_sorted(keys[a:b]), b"", b""]).to_batches()  # noqa: B023

    return run


def _merged(row: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The maximal runs of bytes under the spans, sorted; spans of one row meet where they touch."""
    order = np.lexsort((a, row))
    row, a, b = row[order], a[order], b[order]
    reach = np.maximum.accumulate(b)  # rows follow each other in the block's bytes
    new = np.ones(len(a), bool)
    new[1:] = (row[1:] != row[:-1]) | (a[1:] > reach[:-1])
    first = np.flatnonzero(new)
    return row[first], a[first], reach[np.append(first[1:], len(a)) - 1] if len(a) else b


_ROW = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"]


def _rows(ids: pa.Array, data: np.ndarray, offsets: np.ndarray, row: np.ndarray, a: np.ndarray, b: np.ndarray, kind: pa.DataType) -> pa.Table:
    content = data.tobytes()
    cut = np.searchsorted(row, np.arange(len(ids) + 1)).tolist()
    a, b, offsets = a.tolist(), b.tolist(), offsets.tolist()
    out: list[list] = [[], [], [], [], []]
    for r in range(len(ids)):
        lo, hi = offsets[r], offsets[r + 1]
        own = list(zip(a[cut[r] : cut[r + 1]], b[cut[r] : cut[r + 1]], strict=True))
        digest, last = hashlib.sha256(), lo
        for x, y in own:
            digest.update(content[last:x])
            last = y
        digest.update(content[last:hi])
        for column, value in zip(out, (hi - lo, sum(y - x for x, y in own), len(own), digest.hexdigest(), ",".join(f"{x - lo}:{y - lo}" for x, y in own)), strict=True):
            column.append(value)
    kinds = pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()
    return pa.table([ids.cast(kind), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=_ROW)


def dedupe(docs: DataFrame, text: str = "text", hot: int = HOT) -> DataFrame:
    """A row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (start:stop in bytes)."""
    kind, id_type = docs.schema["doc_id"].dataType.simpleString(), to_arrow_type(docs.schema["doc_id"].dataType)
    shape = f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, removed string"
    own = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("_text"))
    table = Bucketed(blocks(own.where("doc_id IS NOT NULL")), "block", "texts")
    held = table.rows.select("block", "data")
    log = ranges_log(table.rows.agg(F.sum("size")).first()[0] or 0)

    def compared(questions: DataFrame, answer: Callable[[pa.Table], pa.Table], label: str) -> DataFrame:
        return staged(questions.groupBy("part").applyInArrow(answer, ANSWER), label)

    def beside(answers: DataFrame):
        return held.groupBy("block").cogroup(answers.groupBy("block"))

    answers = compared(held.mapInArrow(_asked_anchors(log), QUESTION), _of_anchors(hot), "anchors")
    answers = answers.unionAll(compared(beside(answers).applyInArrow(_asking(2, log), QUESTION), _of_runs(id_type), "runs"))
    answers = answers.unionAll(compared(beside(answers).applyInArrow(_asking(3, log), QUESTION), of_least(id_type, 3), "strings"))

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [pa.table([pa.array([], t) for t in (id_type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())], names=_ROW)]
        for data in left.column("data").to_pylist():
            block = Block(data)
            spans_of(block, right, log)
            block.with_runs(*flags_of(right, 2, block.cuts, 2))
            block.with_strings(*flags_of(right, 3, cuts_of(block.key[block.head], 64, log), 1))
            spans = _merged(*(np.concatenate(x) for x in zip(*block.spans, strict=True)))
            out.append(_rows(block.batch.column(0), block.data, block.offsets, *spans, id_type))
        return pa.concat_tables(out)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for batch in pieces(batches, "_text"):
            yield from _rows(batch.column(0), *buffer_of(batch.column(1)), none, none, none, id_type).to_batches()

    done = staged(beside(answers).applyInArrow(cut, shape), "substrings")
    table.drop()
    return done.unionAll(own.where("doc_id IS NULL").mapInArrow(whole, shape))

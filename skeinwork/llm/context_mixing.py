"""Language-model scores by online logistic mixing of bit predictors over hashed contexts.

A text is its bytes, A-Z lower-cased, and one end byte. Each byte is eight bits, each bit predicted by several
contexts (the 2, 3 and 5 bytes before, and the word so far) from how often the bits of training texts followed there.
The predictions meet in the logistic domain: their stretched probabilities are summed with weights of a set that a gate chooses by the
longest context seen and how often it was seen, and after each byte the weights move along the gradient of what the
byte cost. Weights begin anew with every ``SEGMENT`` bytes of a text, contexts don't.

What is gathered are the counts of all (context, byte) pairs of all training texts: every block of documents sends its
distinct pairs with their counts to ranges of the contexts, a range adds them up and answers each pair with the
eight bits' stretched probabilities. Up to five bytes are compared as they are, words by 48 bits of a hash.
Words for the base score go the same way, compared as text.

Null and empty texts are one end. Null ids count as empty text for the split into training and held-out rows. Repeated
rows are scored each; columns besides ``doc_id`` and the text are ignored; an empty table gives no rows. A text of any
length is scored whole, in one block. Without training texts all bits cost one bit and ``base_score`` is 0.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from skeinwork.llm.arrays import IS_SPACE, buffer_of, finish, span_hashes
from skeinwork.llm.blocks import Bucketed, blocks, opened, pack, pack_batch, pack_sorted, unpack, unpack_sorted
from skeinwork.llm.common import staged
from skeinwork.llm.ranges import grouped, heads_of, ranges_log

#: Bytes of the contexts, from the shortest; the context after them is the word so far.
ORDERS, END = (2, 3, 5), 255
CONTEXTS, PAD = len(ORDERS) + 1, max(ORDERS)
#: Text bytes of a block, for which a task takes some 80 times as much memory.
BLOCK = 2 << 20
#: Blocks whose contexts tell where ranges begin; the places change no result.
SAMPLED = 8
#: Ranges for each range that other operators would take.
FINER = 4
#: Bytes after which the weights begin anew.
SEGMENT = 4096
#: First weight of each context, from the shortest; the step of the gradient; what is added to both counts of a bit.
FIRST, STEP, PRIOR = (0.2, 0.3, 0.35, 0.4), 0.008, 0.05
#: Stretched probabilities are kept in these parts of one, between -127 and 127 of them.
SCALE = 12.0
#: Steps that are laid out at once.
TIMES = 32
#: Gates: no context seen, or which is the longest and four classes of how often it was seen.
CLASSES = 4
_LOW48, WORD = np.uint64((1 << 48) - 1), 255
QUESTION = "part int, block bigint, keys binary, counts binary, words binary"
ANSWER = "block bigint, part int, bits binary, words binary, n_words bigint, n_kinds bigint"


def is_held_out(doc_id: Column) -> Column:
    """Rows that the model doesn't learn from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def dense(code: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each value's number among the distinct ones, and a place of each distinct one.

    Values and places are sorted as one number where they fit in 64 bits; wider values by their low bits, and in full
    where two of them share these.
    """
    n = len(code)
    room = max(1, int(n).bit_length())
    mixed = code << np.uint64(room)
    mixed |= np.arange(n, dtype=np.uint64)
    mixed.sort()
    place = (mixed & np.uint64((1 << room) - 1)).view(np.int64)
    mixed >>= np.uint64(room)
    new = np.ones(n, bool)
    np.not_equal(mixed[1:], mixed[:-1], out=new[1:])
    heads = place[new]
    if bits + room > 64 and len(heads_of(code[place])) > len(heads):
        _, at, inverse = np.unique(code, return_index=True, return_inverse=True)
        return inverse.astype(np.int32), at
    inverse = np.empty(n, np.int32)
    inverse[place] = np.cumsum(new, dtype=np.int32) - 1
    return inverse, heads


def keys_of(stream: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """The context before each place as a number, its order in front, then the place's byte."""
    context = np.full(len(at), order << 48, np.uint64)
    for k in range(order):
        context |= stream[at - 1 - k].astype(np.uint64) << np.uint64(8 * k)
    return (context << np.uint64(8)) | stream[at]


def word_contexts(stream: np.ndarray) -> np.ndarray:
    """A hash of the bytes from the last white space or the text's begin to each place, that place left out."""
    starts = np.flatnonzero(np.concatenate([[True], (IS_SPACE | (np.arange(256) == END))[stream[:-1]]]) if len(stream) else np.zeros(0, bool))
    begin = np.repeat(starts, np.diff(np.append(starts, len(stream))))
    return (span_hashes(stream, begin, np.arange(len(stream)), END) & _LOW48) | np.uint64(WORD << 48)


class Block:
    """Documents as one stream of bytes: before each text its pads, after it the end."""

    def __init__(self, data: bytes):
        batch = opened(data)
        self.ids, held = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        self.held = held
        content, offsets = buffer_of(batch.column(2))
        self.raw = content.tobytes().lower()
        self.offsets, sizes = offsets, np.diff(offsets)
        base = np.concatenate([[0], np.cumsum(sizes + PAD + 1)])
        self.begin, self.end = base[:-1] + PAD, base[1:]
        self.stream = np.full(base[-1], END, np.uint8)
        self.stream[np.arange(len(content)) + np.repeat(self.begin - offsets[:-1], sizes)] = np.frombuffer(self.raw, np.uint8)
        learnt = np.zeros(base[-1] + 1, np.int8)  # differences of a mask over the places of training texts
        np.add.at(learnt, self.begin[~held], 1)
        np.add.at(learnt, self.end[~held], -1)
        self.learnt = np.flatnonzero(np.cumsum(learnt[:-1], dtype=np.int8)[PAD:])
        self.number, keys, counts = [], [], []
        whole = self.stream.astype(np.uint64)
        triples, at = dense(whole[2:] | whole[1:-1] << np.uint64(8) | whole[:-2] << np.uint64(16), 24) if len(whole) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        for order in ORDERS:
            if order == 2:
                number, place = triples[PAD - 2 :], None
            elif order < 5:
                code = whole[PAD:].copy()
                for k in range(order):
                    code |= whole[PAD - 1 - k : -1 - k] << np.uint64(8 * (k + 1))
                number, place = dense(code, 8 * (order + 1))
            else:  # six bytes are two triples, each by its number
                wide = triples.astype(np.uint64)
                room = max(1, int(triples.max(initial=0)).bit_length())
                number, place = dense(wide[3:] | wide[:-3] << np.uint64(room), 2 * room)
            self.number.append(number)
            keys.append(keys_of(self.stream, at + 2 if place is None else place + PAD, order))
            counts.append(np.bincount(number[self.learnt], minlength=len(keys[-1])))
        word = (word_contexts(self.stream)[PAD:] << np.uint64(8)) | self.stream[PAD:]
        number, place = dense(finish(word), 64)
        self.number.append(number)
        keys.append(word[place])
        counts.append(np.bincount(number[self.learnt], minlength=len(place)))
        self.sizes = [len(k) for k in keys]
        self.keys, self.counts = np.concatenate(keys), np.concatenate(counts)

    def ranged(self, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs in order, and where the ranges begin, which ``bounds`` part; a context's pairs are in one range."""
        order = np.argsort(self.keys)
        return order, np.concatenate([[0], np.searchsorted(self.keys[order] >> np.uint64(8), bounds), [len(order)]])

    def words(self) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """The distinct words, their counts in training texts, and all words by number with each text's end in them."""
        codes: dict[bytes, int] = {}
        found, ends = [], []
        for a, b in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist(), strict=True):
            found += [codes.setdefault(w, len(codes)) for w in self.raw[a:b].split()]
            ends.append(len(found))
        number, ends = np.array(found, np.int64), np.array(ends, np.int64)
        learnt = np.repeat(~self.held, np.diff(ends, prepend=0))
        return list(codes), np.bincount(number[learnt], minlength=len(codes)), number, ends


def word_parts(words: list[bytes], log: int) -> tuple[np.ndarray, np.ndarray]:
    """Words in the order of their ranges, and where the ranges begin."""
    part = np.array([zlib.crc32(w) for w in words], np.uint64) >> np.uint64(32 - log)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange((1 << log) + 1))


def bounds_of(held: DataFrame, log: int) -> np.ndarray:
    """The contexts at which ranges begin, from the distinct pairs of a few blocks: as many pairs in each range there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                contexts = np.sort(Block(data).keys) >> np.uint64(8)
                at = (np.arange(1, 1 << log) * len(contexts)) >> log
                yield pa.RecordBatch.from_arrays([pa.array([contexts[at].tolist() if len(contexts) else []], pa.list_(pa.int64()))], ["contexts"])

    some = held.select("block").orderBy(F.xxhash64("block")).limit(SAMPLED)
    found = [r.contexts for r in held.join(some, "block", "left_semi").select("data").mapInArrow(run, "contexts array<bigint>").collect()]
    every = np.sort(np.concatenate([np.zeros(0, np.int64), *(np.array(f, np.int64) for f in found)])).astype(np.uint64)
    return np.unique(every[(np.arange(1, 1 << log) * len(every)) >> log]) if len(every) else every


def asked(log: int, bounds: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The distinct pairs and words of every block, by range, with their counts in its training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                block = Block(data)
                at, cut = block.ranged(bounds)
                keys, learnt = block.keys[at], block.counts[at].astype(np.uint32)
                words, counts, *_ = block.words()
                order, word_cut = word_parts(words, log)
                rows = []
                for p in range(1 << log):
                    a, b = (cut[p], cut[p + 1]) if p + 1 < len(cut) else (0, 0)
                    own = order[word_cut[p] : word_cut[p + 1]]
                    if a < b or len(own):
                        held = pa.RecordBatch.from_arrays([pa.array([words[k] for k in own], pa.binary()), pa.array(counts[own], pa.int64())], ["word", "n"])
                        rows.append((p, number, pack_sorted(keys[a:b]), pack(learnt[a:b]), pack_batch(held)))
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, ["part", "block", "keys", "counts", "words"])

    return run


def predicted(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For sorted distinct pairs with their counts: the stretched probability of each of the byte's bits as it is, and
    the class of how often the context was seen, 0 for never; nine signed bytes each."""
    out = np.empty((len(keys), 9), np.int8)
    sums = []
    for bit in range(9):
        heads = heads_of(keys >> np.uint64(8 - bit)) if bit < 8 else np.arange(len(keys))
        sums.append(np.add.reduceat(counts, heads)[grouped(heads, len(keys))] if len(keys) else counts)
    for bit in range(8):
        right = sums[bit + 1]
        stretched = np.log((right + PRIOR) / (sums[bit] - right + PRIOR))
        out[:, bit] = np.clip(np.rint(stretched * SCALE), -127, 127)
    seen = sums[0]
    out[:, 8] = np.where(seen > 0, np.minimum(CLASSES, 1 + np.log2(np.maximum(1, seen)) / 2), 0)
    return out


def answer(group: pa.Table) -> pa.Table:
    """All blocks' counts of a range added up, and each block's pairs and words answered."""
    blocks_, parts = group.column("block").to_pylist(), group.column("part").to_pylist()
    found = [unpack_sorted(d, np.uint64) for d in group.column("keys").to_pylist()]
    keys = np.concatenate(found)
    counts = np.concatenate([unpack(d, np.uint32) for d in group.column("counts").to_pylist()]).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    heads = heads_of(keys[order])
    sums = np.add.reduceat(counts[order], heads) if len(keys) else counts
    bits = predicted(keys[order][heads], sums)
    at = np.empty(len(keys), np.int64)
    at[order] = grouped(heads, len(keys))
    asked_words = [opened(d) for d in group.column("words").to_pylist()]
    words = pa.chunked_array([w.column(0) for w in asked_words]).combine_chunks().dictionary_encode()
    numbers = words.indices.to_numpy(zero_copy_only=False)
    n = np.bincount(numbers, np.concatenate([w.column(1).to_numpy(zero_copy_only=False) for w in asked_words]), minlength=len(words.dictionary)).astype(np.int64)
    ends, word_ends = np.cumsum([len(x) for x in found]), np.cumsum([w.num_rows for w in asked_words])
    rows = [(-1, parts[0], b"", b"", int(n.sum()), int((n > 0).sum()))]
    for k, block in enumerate(blocks_):
        own, own_words = at[ends[k] - len(found[k]) : ends[k]], numbers[word_ends[k] - asked_words[k].num_rows : word_ends[k]]
        rows.append((block, parts[0], zstandard.compress(np.ascontiguousarray(bits[own].T).tobytes(), 1), pack(n[own_words]), 0, 0))
    kinds = pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()
    return pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["block", "part", "bits", "words", "n_words", "n_kinds"])


def mixed(numbers: list[np.ndarray], bits: list[np.ndarray], begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The natural logarithm of the probability of each stretch of bytes from ``begin`` to ``end``.

    ``numbers`` has for each context the row of ``bits`` that belongs to each place. All stretches go in step, and
    what doesn't depend on weights is laid out for ``TIMES`` steps at once, bit by bit beside each other.
    """
    order = np.argsort(begin - end, kind="stable")
    begin, size = begin[order], (end - begin)[order]
    n, sets = len(begin), 1 + CLASSES * CONTEXTS
    weights = [np.full(n * sets, f / SCALE, np.float32) for f in FIRST]
    words = [np.ascontiguousarray(b[:, :8]).view(np.int64).ravel() for b in bits]
    classes = [np.ascontiguousarray(b[:, 8]) for b in bits]
    step, cost = np.float32(STEP / SCALE / SCALE), np.zeros(n)
    for low in range(0, int(size[0]) if n else 0, TIMES):
        live = int(np.searchsorted(-size, -low))  # stretches that are longer than this
        times = min(TIMES, int(size[0]) - low)
        at = np.minimum(begin[:live] + (low + np.arange(times))[:, None], begin[:live] + size[:live] - 1)
        rows = [x[at] for x in numbers]
        gate = np.zeros((times, live), np.int64)
        for k in range(CONTEXTS):
            seen = classes[k][rows[k]]
            np.copyto(gate, CLASSES * k + seen.astype(np.int64), where=seen > 0)
        gate += np.arange(live) * sets
        inputs = [np.ascontiguousarray(w[r].view(np.int8).reshape(times, live, 8).transpose(0, 2, 1)).astype(np.float32) for w, r in zip(words, rows, strict=True)]
        for t in range(times):
            own = int(np.searchsorted(-size[:live], -(low + t)))
            g = gate[t, :own]
            held = [w[g] for w in weights]
            here = [x[t, :, :own] for x in inputs]
            total = here[0] * held[0]
            for x, w in zip(here[1:], held[1:], strict=True):
                total += x * w
            np.clip(total, -10.5, 10.5, out=total)
            np.negative(total, out=total)
            odds = np.exp(total, out=total)
            wrong = odds + np.float32(1)
            cost[:own] -= np.log(np.multiply.reduce(wrong, axis=0))
            np.divide(odds, wrong, out=wrong)
            wrong *= step
            for w, x, h in zip(weights, here, held, strict=True):
                w[g] = h + (x * wrong).sum(0)
    out = np.empty(n)
    out[order] = cost
    return out


def scores(block: Block, answers: pa.Table, bounds: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """The natural logarithm of each text's probability."""
    at, cut = block.ranged(bounds)
    bits = np.zeros((len(at), 9), np.int8)
    for part, data in zip(answers.column("part").to_pylist(), answers.column("bits").to_pylist(), strict=True):
        if part + 1 < len(cut):
            bits[at[cut[part] : cut[part + 1]]] = np.frombuffer(zstandard.decompress(data), np.int8).reshape(9, -1).T
    tables = np.split(bits, np.cumsum(block.sizes)[:-1])
    n = -(-(block.end - block.begin) // segment)
    row = np.repeat(np.arange(len(n)), n)
    begin = block.begin[row] + (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * segment
    cost = mixed(block.number, tables, begin - PAD, np.minimum(begin + segment, block.end[row]) - PAD)
    return np.bincount(row, cost, minlength=len(n))


def score(docs: DataFrame, text: str = "text", segment: int = SEGMENT) -> DataFrame:
    """A row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes and
    bits_per_byte, of the bytes and the end."""
    kind = docs.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)
    own = docs.select("doc_id", is_held_out(F.col("doc_id")).alias("_held"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    names = ["doc_id", "held_out", "n_tokens", "n_known", "n_ends", "log_sum", "score", "n_bytes", "n_words", "n_kinds"]
    kinds = [id_type, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
    shape = ", ".join(f"{n} {k}" for n, k in zip(names, [kind.simpleString(), "boolean", *["bigint"] * 3, "double", "double", *["bigint"] * 3], strict=True))
    table = Bucketed(blocks(own, most=BLOCK), "block", "scored", deal=False)
    try:
        held = table.rows.select("block", "data")
        log = min(20, ranges_log(FINER * (table.rows.agg(F.sum("size")).first()[0] or 0)))

        bounds = bounds_of(held, log)

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            """The rows of a block; or what the ranges say of all words, in rows without ``held_out``."""
            out = [pa.table([pa.array([], k) for k in kinds], names=names)]
            if not left.num_rows:
                blank = [pa.nulls(right.num_rows, k) for k in kinds[:-2]]
                out.append(pa.table([*blank, right.column("n_words"), right.column("n_kinds")], names=names))
            for data in left.column("data").to_pylist():
                block = Block(data)
                words, _, number, ends = block.words()
                order, cut = word_parts(words, log)
                counts = np.zeros(len(words), np.int64)
                for part, said in zip(right.column("part").to_pylist(), right.column("words").to_pylist(), strict=True):
                    counts[order[cut[part] : cut[part + 1]]] = unpack(said, np.int64)
                row = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
                n = np.bincount(row, minlength=len(ends)) + 1
                known = np.bincount(row, counts[number] > 0, minlength=len(ends))
                logs = np.bincount(row, np.log10(counts + 1.0)[number], minlength=len(ends))
                cost, size, none = scores(block, right, bounds, segment) / math.log(10), block.end - block.begin, np.zeros(len(n))
                columns = [block.ids, block.held, n, known, ~block.held, logs, cost, size, none, none]
                out.append(pa.table([(c if isinstance(c, pa.Array) else pa.array(c)).cast(k) for c, k in zip(columns, kinds, strict=True)], names=names))
            return pa.concat_tables(out)

        answers = held.mapInArrow(asked(log, bounds), QUESTION).groupBy("part").applyInArrow(answer, ANSWER)
        rows = staged(held.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, shape), "scores")
    finally:
        table.drop()
    n_words, n_kinds, n_ends = rows.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n_words", "n_kinds", "n_ends"))).first()
    n_train, rest = n_words + n_ends, math.log10(n_words + n_ends + n_kinds + (n_ends > 0) + 1)
    base = F.col("log_sum") + math.log10(n_ends + 1) - F.col("n_tokens") * rest
    per_byte = -F.col("score") * math.log2(10) / F.col("n_bytes")
    known = F.col("n_known") + int(n_ends > 0)
    return rows.where("held_out IS NOT NULL").select("doc_id", "held_out", "n_tokens", known.alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"), base.alias("base_score"), "score", "n_bytes", per_byte.alias("bits_per_byte"))

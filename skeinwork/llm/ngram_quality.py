"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text, thresholded per language.

Tokens are bytes, so an n-gram of up to ``ORDER`` of them is one 64-bit integer and its context and suffix are
shifts. Everything that a five-byte gram a b c d e needs from the model, its context a b c d, the shorter grams down
to c d e and their contexts, has the bytes c d at the same place, so the model is sharded by them: a shard's counts
of the highest order give its lower orders (which count distinct left neighbours) and all its contexts, and only the
grams of one and two bytes add up over the shards. Those are a table of 65 536 probabilities for a language.
Discounts follow from the counts of counts of each language and order.

Documents lie in compressed blocks that are written once, bucketed by the task that wrote them, so no text is shuffled.
Which rows are trusted comes to a task's blocks as row numbers. Each block asks each shard for its own distinct grams,
the questions meet the shard's counts, and the answers go back to the task's blocks, which add up every document's log
probability. Questions about a shard are split into groups of ``QUESTIONS`` blocks, each of which gets the shard's
counts, and counts are merged in a tree of ``FAN`` at a time, so no shard is too common for a task: a pair of bytes has
at most 2^24 grams.

A document is kept where its perplexity lies between two quantiles of its language's trusted documents, widened by
``SLACK`` times their distance from the median and, as a short text's mean varies more, by an allowance that falls
with the root of its bytes: what is stranger than trusted text goes, and what is far duller. The quantiles come from
histograms of log perplexity in steps of 1/256, which add up exactly.

Trusted documents are those labelled 1; all their text counts. Texts without words are rejected with a null perplexity;
a language without a trusted byte, null included, borrows the thresholds and the model of all trusted text together;
rows that repeat are judged alike; ids may be of any type; a long text is a block of its own and is worked off in
pieces only where it shares its block; other columns may be null or have any name; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from skeinwork.llm.arrays import IS_SPACE, buffer_of, pieces
from skeinwork.llm.blocks import Bucketed, blocks, opened, pack, pack_sorted, unpack, unpack_sorted
from skeinwork.llm.common import staged

ORDER = 5
LOW, HIGH = 0.005, 0.995
SLACK = 0.5
ALLOW_LOW, ALLOW_HIGH = 4.0, 1.0
STEPS = 256
#: Text bytes that a task works on at a time.
PIECE = 1 << 19
#: Blocks that ask a shard together, and partial counts that are merged at a time.
QUESTIONS, FAN = 256, 64
#: Text bytes of the corpus for each shard of the model, and the bounds of their number; there are 2^16 pairs of bytes.
SHARD_BYTES, LEAST_SHARDS, MOST_SHARDS = 128 << 20, 32, 1 << 16
ANY = "*"  # the model of all languages; a language's own model is its name after "="


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ORDER-gram that ends at every byte, zero bytes standing before a text, and each byte's row."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    place = np.arange(len(data)) - offsets[:-1][row]
    key = np.zeros(len(data), np.int64)
    for k in range(ORDER):
        shifted = np.zeros(len(data), np.int64)
        shifted[k:] = data[: len(data) - k] if k else data
        shifted[place < k] = 0
        key |= shifted << (8 * k)
    return key, row


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each gram: a hash of its third and fourth byte."""
    pair = ((keys >> 8) & 0xFFFF).astype(np.uint64)
    return (((pair * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(shards)).astype(np.int32)


def _dealt(keys: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places of its grams), the order within a shard kept."""
    shard = _shard(keys, shards)
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in range(shards):
        if cuts[s] < cuts[s + 1]:
            yield s, order[cuts[s] : cuts[s + 1]]


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


# --- counts and the model ------------------------------------------------------------------------------


_COUNTS = "shard int, model string, part bigint, grams binary, counts binary"


def _by_model(batch: pa.RecordBatch, rows: np.ndarray | None = None) -> Iterator[tuple[str, pa.RecordBatch]]:
    """The rows of each model, with their places as ``_row``."""
    models = np.array(batch.column(2).to_pylist())
    every = batch.append_column("_row", pa.array(np.arange(batch.num_rows)))
    chosen = np.ones(batch.num_rows, bool) if rows is None else np.isin(np.arange(batch.num_rows), rows)
    for name in np.unique(models[chosen]):
        yield str(name), every.filter(pa.array(chosen & (models == name)))


def trusted_rows(held: DataFrame, good: DataFrame, id_type: str) -> DataFrame:
    """(task, block, row) of the documents in blocks whose ids are in ``good``."""

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task, block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = opened(data).column(0)
                n = len(found)
                yield pa.RecordBatch.from_arrays([found, pa.array([task] * n, pa.int64()), pa.array([block] * n, pa.int64()), pa.array(np.arange(n), pa.int64())], ["doc_id", "task", "block", "row"])

    return held.mapInArrow(ids, f"doc_id {id_type}, task bigint, block bigint, row bigint").join(good, "doc_id", "left_semi").select("task", "block", "row")


def counts(held: DataFrame, trusted: DataFrame, tasks: int, shards: int) -> DataFrame:
    """(shard, model, part, grams, counts): the packed counts of the trusted rows, one row for each shard and model."""

    def tally(left: pa.Table, right: pa.Table) -> pa.Table:
        parts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        block_of, row_of = right.column("block").to_numpy(), right.column("row").to_numpy()
        for block, data in zip(left.column("block").to_pylist(), left.column("data").to_pylist(), strict=True):
            for model, rows in _by_model(opened(data), row_of[block_of == block]):
                for piece in pieces(iter([rows]), "_text", PIECE):
                    parts.setdefault(model, []).append(_counted(grams(*buffer_of(piece.column(3)))[0]))
                    if sum(len(k) for k, _ in parts[model]) > 4_000_000:
                        parts[model] = [_merged(parts[model])]
        task = left.column("task")[0].as_py() if left.num_rows else 0
        return pa.Table.from_batches([_count_rows(model, task, *_merged(found), shards) for model, found in parts.items()], _COUNTS_ARROW)

    return _merged_rows(held.groupBy("task").cogroup(trusted.groupBy("task")).applyInArrow(tally, _COUNTS), tasks)


_COUNTS_ARROW = pa.schema([("shard", pa.int32()), ("model", pa.string()), ("part", pa.int64()), ("grams", pa.binary()), ("counts", pa.binary())])


def _merged_rows(rows: DataFrame, parts: int) -> DataFrame:
    """One row for each shard and model, ``FAN`` parts of each at a time."""

    def merge(group: pa.Table) -> pa.Table:
        merged = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for g, c in zip(group.column("grams"), group.column("counts"), strict=True):
            merged = _merged([merged, (unpack_sorted(g.as_py(), np.int64), unpack(c.as_py(), np.int64))])
        return pa.table([group.column("shard")[:1], group.column("model")[:1], group.column("part")[:1], pa.array([pack_sorted(merged[0])], pa.binary()), pa.array([pack(merged[1])], pa.binary())], schema=_COUNTS_ARROW)

    while True:
        rows = rows.withColumn("part", F.expr(f"part div {FAN}")).groupBy("shard", "model", "part").applyInArrow(merge, _COUNTS)
        parts = -(-parts // FAN)
        if parts <= 1:
            return rows


def with_any(top: DataFrame, models: int) -> DataFrame:
    """``top`` with the counts of all models together as those of ``ANY``."""
    numbered = top.withColumn("part", F.expr(f"pmod(xxhash64(model), {models})")).withColumn("model", F.lit(ANY))
    return top.unionByName(_merged_rows(numbered, models))


def _count_rows(model: str, task: int, keys: np.ndarray, n: np.ndarray, shards: int) -> pa.RecordBatch:
    rows = [(s, pack_sorted(keys[at]), pack(n[at].astype(np.int64))) for s, at in _dealt(keys, shards)]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([model] * len(rows), pa.string()), pa.array([task] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], schema=_COUNTS_ARROW)


def _orders(keys: np.ndarray, n: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Sorted grams and counts of orders 5, 4 and 3 of a shard, and its part of order 2; below the highest, counts
    are of distinct left neighbours."""
    out = {ORDER: (keys, n)}
    for order in range(ORDER - 1, 1, -1):
        out[order] = _counted(out[order + 1][0] & ((1 << (8 * order)) - 1))
    return out


def _count_of_counts(n: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(n, 5), minlength=6)[1:5]


def _discounts(ones: np.ndarray) -> np.ndarray:
    """D1, D2 and D3+ from n1 to n4: D_k = k - (k + 1) Y n_{k+1} / n_k with Y = n1 / (n1 + 2 n2)."""
    y = ones[0] / max(1, ones[0] + 2 * ones[1])
    return np.array([min(k, max(0.05, k - (k + 1) * y * ones[k] / ones[k - 1])) if ones[k - 1] and y else 0.5 for k in (1, 2, 3)])


class Level:
    """One order's sorted grams with their shares and contexts with their weights for the order below."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, discounts: np.ndarray):
        cut = discounts[np.minimum(n, 3) - 1]
        context = keys >> 8
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(keys) else np.zeros(0, np.int64)
        total = np.add.reduceat(n.astype(np.float64), first) if len(first) else np.zeros(0)
        spread = np.repeat(total, np.diff(np.append(first, len(keys))))
        self.keys, self.share = keys, (n - cut) / spread
        self.contexts, self.gamma = context[first], (np.add.reduceat(cut, first) / total if len(first) else total)

    def over(self, asked: np.ndarray, below: np.ndarray) -> np.ndarray:
        """The probabilities of grams, given those of their suffixes; an unseen context has weight 1."""
        return _looked_up(self.keys, self.share, asked, 0.0) + _looked_up(self.contexts, self.gamma, asked >> 8, 1.0) * below


def _looked_up(keys: np.ndarray, values: np.ndarray, asked: np.ndarray, otherwise: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(asked), otherwise)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at], otherwise)


def low_orders(top: DataFrame) -> DataFrame:
    """(model, low): for each model the packed discounts of orders 3 to 5 and the probabilities of all pairs of bytes."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for model, g, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                orders = _orders(unpack_sorted(g, np.int64), unpack(c, np.int64))
                pairs, n = orders[2]
                names = np.append(pairs, [-(10 * order + k + 1) for order in (3, 4, 5) for k in range(4)])
                sums = np.concatenate([n, *(_count_of_counts(orders[order][1]) for order in (3, 4, 5))])
                yield pa.RecordBatch.from_arrays([pa.array([model] * len(names), pa.string()), pa.array(names, pa.int32()), pa.array(sums, pa.int64())], ["model", "what", "n"])

    def lows(group: pa.Table) -> pa.Table:
        stats = dict(zip(group.column("what").to_pylist(), group.column("n").to_pylist(), strict=True))
        discounts = [_discounts(np.array([stats.get(-(10 * order + k), 0) for k in (1, 2, 3, 4)], np.float64)) for order in (3, 4, 5)]
        pairs = np.array(sorted(k for k in stats if k >= 0), np.int64)
        two = pairs, np.array([stats[k] for k in pairs.tolist()], np.int64)
        one = _counted(pairs & 0xFF)
        single = Level(*one, _discounts(_count_of_counts(one[1]))).over(np.arange(256), np.full(256, 1 / 256))
        both = np.arange(1 << 16)
        known = Level(*two, _discounts(_count_of_counts(two[1]))).over(both, single[both & 0xFF])
        return pa.table({"model": group.column("model")[:1], "low": pa.array([pack(np.concatenate([*discounts, known]))], pa.binary())})

    sums = top.select("model", "grams", "counts").mapInArrow(part, "model string, what int, n bigint").groupBy("model", "what").agg(F.sum("n").alias("n"))
    return sums.groupBy("model").applyInArrow(lows, "model string, low binary")


class Shard:
    """The model of one shard, from its packed grams, counts and lower orders."""

    def __init__(self, grams: bytes, counts: bytes, low: bytes):
        orders, numbers = _orders(unpack_sorted(grams, np.int64), unpack(counts, np.int64)), unpack(low, np.float64)
        self.levels, self.pairs = [(order, Level(*orders[order], numbers[3 * k : 3 * k + 3])) for k, order in enumerate((3, 4, 5))], numbers[9:]

    def probabilities(self, asked: np.ndarray) -> np.ndarray:
        """P(e | a b c d) of grams a b c d e."""
        p = self.pairs[asked & 0xFFFF]
        for order, level in self.levels:
            p = level.over(asked & ((1 << (8 * order)) - 1), p)
        return p


# --- scoring -------------------------------------------------------------------------------------------


def asked(held: DataFrame, shards: int, groups: int) -> DataFrame:
    """(shard, model, salt, task, block, grams): what each block needs to know of each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task, block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                for model, rows in _by_model(opened(data)):
                    found: list[np.ndarray] = []
                    for piece in pieces(iter([rows]), "_text", PIECE):
                        found.append(_counted(grams(*buffer_of(piece.column(3)))[0])[0])
                        if sum(map(len, found)) > 2_000_000:
                            found = [_counted(np.concatenate(found))[0]]
                    keys = _counted(np.concatenate(found))[0]
                    out = [(s, pack_sorted(keys[at])) for s, at in _dealt(keys, shards)]
                    n = len(out)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([s for s, _ in out], pa.int32()), pa.array([model] * n, pa.string()), pa.array([(block + (block >> 33)) % groups] * n, pa.int64()), pa.array([task] * n, pa.int64()), pa.array([block] * n, pa.int64()), pa.array([g for _, g in out], pa.binary())],
                        ["shard", "model", "salt", "task", "block", "grams"],
                    )

    return held.mapInArrow(run, "shard int, model string, salt bigint, task bigint, block bigint, grams binary")


_ANSWER = pa.schema([("task", pa.int64()), ("block", pa.int64()), ("model", pa.string()), ("grams", pa.binary()), ("logp", pa.binary())])


def answered(questions: DataFrame, top: DataFrame, low: DataFrame, shards: int, groups: int) -> DataFrame:
    """(task, block, model, grams, logp): each question with its log probabilities; without a model they are uniform."""

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _ANSWER.empty_table()
        model = Shard(*(right.column(c)[0].as_py() for c in ("grams", "counts", "low"))) if right.num_rows else None
        out = []
        for g in left.column("grams").to_pylist():
            own = unpack_sorted(g, np.int64)
            p = model.probabilities(own) if model else np.full(len(own), 1 / 256)
            out.append(pack(np.log(p).astype(np.float32)))
        return pa.table([left.column("task"), left.column("block"), left.column("model"), left.column("grams"), pa.array(out, pa.binary())], schema=_ANSWER)

    # a shard without counts of a model still has the model's lower orders
    empty = pack(np.zeros(0, np.int64))
    every = low.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    parts = every.join(top.select("shard", "model", "grams", "counts"), ["shard", "model"], "left")
    filled = parts.select("shard", "model", *(F.coalesce(c, F.lit(bytearray(empty))).alias(c) for c in ("grams", "counts")), "low").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))))
    both = questions.groupBy("shard", "model", "salt").cogroup(filled.groupBy("shard", "model", "salt"))
    return both.applyInArrow(answer, "task bigint, block bigint, model string, grams binary, logp binary")


def perplexities(held: DataFrame, told: DataFrame, id_type) -> DataFrame:
    """A row for each document: doc_id, lang, n_bytes, perplexity (for each byte; null without words)."""
    shape = pa.schema([("doc_id", to_arrow_type(id_type)), ("lang", pa.string()), ("n_bytes", pa.int64()), ("perplexity", pa.float64())])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [shape.empty_table()]
        block_of, model_of = right.column("block").to_numpy(), right.column("model").to_pylist()
        for block, data in zip(left.column("block").to_pylist(), left.column("data").to_pylist(), strict=True):
            batch = opened(data)
            total, size, wordy = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, bool)
            mine = np.flatnonzero(block_of == block).tolist()
            for model, whole in _by_model(batch):
                some = [i for i in mine if model_of[i] == model]
                keys = np.concatenate([np.zeros(0, np.int64), *(unpack_sorted(right.column("grams")[i].as_py(), np.int64) for i in some)])
                values = np.concatenate([np.zeros(0, np.float32), *(unpack(right.column("logp")[i].as_py(), np.float32) for i in some)])
                order = np.argsort(keys, kind="stable")
                keys, values = keys[order], values[order]
                for rows in pieces(iter([whole]), "_text", PIECE):
                    content, offsets = buffer_of(rows.column(3))
                    key, row = grams(content, offsets)
                    at = rows.column(4).to_numpy()
                    size[at] = np.diff(offsets)
                    if len(key):
                        total[at] = np.bincount(row, values[np.searchsorted(keys, key)], len(at))
                        wordy[at] = np.bincount(row, ~IS_SPACE[content], len(at)) > 0
            value = np.exp(-total / np.maximum(size, 1))
            out.append(pa.table([batch.column(0), batch.column(1), pa.array(size), pa.array(value, mask=~wordy)], schema=shape))
        return pa.concat_tables(out)

    return held.groupBy("task").cogroup(told.groupBy("task")).applyInArrow(score, f"doc_id {id_type.simpleString()}, lang string, n_bytes bigint, perplexity double")


def shards_for(n_bytes: int) -> int:
    return max(LEAST_SHARDS, min(MOST_SHARDS, -(-n_bytes // SHARD_BYTES)))


def thresholds(trusted: DataFrame) -> DataFrame:
    """(lang, low, high) of log perplexity from rows (lang, logppl) of trusted documents, ``ANY`` included."""
    step = F.floor(F.col("logppl") * STEPS)
    own = trusted.select(F.coalesce("lang", F.lit("")).alias("lang"), step.alias("step")).groupBy("lang", "step").agg(F.count("*").alias("n"))
    every = own.unionByName(own.groupBy("step").agg(F.sum("n").alias("n")).select(F.lit(ANY).alias("lang"), "step", "n"))
    upto = every.select("*", F.sum("n").over(W.partitionBy("lang").orderBy("step")).alias("upto"), F.sum("n").over(W.partitionBy("lang")).alias("all"))
    at = lambda q: F.min(F.when(F.col("upto") >= F.lit(q) * F.col("all"), F.col("step"))) / F.lit(float(STEPS))
    cut = upto.groupBy("lang").agg(at(LOW).alias("a"), at(0.5).alias("m"), at(HIGH).alias("b"))
    return cut.select("lang", (F.col("a") - SLACK * (F.col("m") - F.col("a"))).alias("low"), (F.col("b") + 1 / STEPS + SLACK * (F.col("b") - F.col("m"))).alias("high"))


def judge(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """A row for each document: doc_id, lang, n_bytes, perplexity, low, high, kept."""
    good = labels.where("quality = 1").select("doc_id").distinct()
    id_type, tag = docs.schema["doc_id"].dataType, F.concat(F.lit("="), F.coalesce("lang", F.lit("")))
    some = docs.where(F.octet_length(text) > 0).select("doc_id", tag.alias("_own")).join(good, "doc_id", "left_semi")
    own = staged(some.select("_own").distinct(), "languages")
    named = docs.select("doc_id", "lang", F.col(text).alias("_text"), tag.alias("_tag")).join(own, F.col("_tag") == F.col("_own"), "left")
    cut_up = blocks(named.select("doc_id", "lang", F.coalesce("_own", F.lit(ANY)).alias("model"), "_text"))
    texts = Bucketed(cut_up.select(F.shiftright("block", 33).alias("task"), "block", "size", "data"), "task", "texts", deal=False)
    held = texts.rows.select("task", "block", "data")
    whole = texts.rows.agg(F.sum("size").alias("size"), F.count("*").alias("blocks"), F.max("task").alias("task")).first()
    shards, groups = shards_for(whole["size"] or 0), -(-max(1, whole["blocks"]) // QUESTIONS)
    top = staged(counts(held, trusted_rows(held, good, id_type.simpleString()), (whole["task"] or 0) + 1, shards), "grams")
    if not docs.select(tag.alias("_tag")).join(own, F.col("_tag") == F.col("_own"), "left_anti").isEmpty():
        top = staged(with_any(top, max(1, own.count())), "grams")
    told = answered(asked(held, shards, groups), top, staged(low_orders(top), "low"), shards, groups)
    scored = staged(perplexities(held, told, id_type), "perplexity")
    texts.drop()
    logs = scored.withColumn("logppl", F.ln("perplexity"))
    cut = staged(thresholds(logs.where("logppl IS NOT NULL").join(good, "doc_id", "left_semi").select("lang", "logppl")), "thresholds")
    own = cut.withColumnRenamed("lang", "_lang")
    whole = cut.where(F.col("lang") == ANY).select(F.col("low").alias("low_any"), F.col("high").alias("high_any"), F.lit(1).alias("_one"))
    named = logs.withColumn("_one", F.lit(1)).join(own, F.coalesce("lang", F.lit("")) == F.col("_lang"), "left").join(F.broadcast(whole), "_one", "left")
    root = F.sqrt(F.greatest("n_bytes", F.lit(1)))
    low = F.coalesce("low", "low_any", F.lit(float("-inf"))) - ALLOW_LOW / root
    high = F.coalesce("high", "high_any", F.lit(float("inf"))) + ALLOW_HIGH / root
    return named.select("doc_id", "lang", "n_bytes", "perplexity", F.exp(low).alias("low"), F.exp(high).alias("high"), F.coalesce((F.col("logppl") >= low) & (F.col("logppl") < high), F.lit(False)).alias("kept"))


def keep(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the documents that ``judge`` rejects."""
    bad = judge(docs, labels, text).where("NOT kept").select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)

"""Near-duplicates by ProbMinHash, banding and verification.

A document is the weighted set of its five-word shingles, weighted by how often they occur. Every shingle has a
Poisson process of arrivals whose rate is its weight and whose times and components come from its hash; a
component keeps the shingle that arrives first. The processes run in rounds, and a shingle stops for good once its
next arrival is later than every component's first (early termination). Two documents agree in a component with
the probability of their probability Jaccard similarity. A document that repeats shingles has a second signature, in
which every distinct shingle weighs 1, so that two documents agree with the probability of their plain Jaccard
similarity; for others both are the same. Two documents at 0.8 in either share no band once in 20 000 times.

Equal word sequences collapse first. Bands of both signatures bring documents into buckets; in every bucket all members
are held against a centre, and pairs are verified on the whole texts: the probability Jaccard, or the plain one,
must be at least 0.8. Documents whose buckets still hold several classes are bounded then (``limits``): what a document
shares with none of the others bounds its similarity to each of them, so a document all of whose bounds lie below 0.8
leaves. In a bucket of up to ``SMALL`` of the others, pairs of different classes become rows where the bound of the pair
allows it, in the first bucket that they share and where their signatures agree enough. Larger buckets that share
members are one crowd, which is dealt into blocks: a task holds two blocks of shingle sets against each other, all pairs
exactly, and gives only the links that join classes (``crowded``). So every pair of a bucket is either held together or
already in one class; what a crowd costs in tasks still grows with its square, its rows don't. Classes are the connected
components of the verified links, found by label propagation over tables in the shared folder.

Texts without words are alone in their class. Null ids get a null class; rows with one id count as one document,
which is near whatever one of its texts is near; ids may be of any type; long texts are read whole; an empty table
gives an empty result; other columns may be null or have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.arrays import buffer_of, finish, mix, pieces, shingles, span_hashes, words
from skeinwork.llm.common import staged

BANDS, ROWS = 25, 5
THRESHOLD = 0.8
#: Pairs whose components agree less often than this in both signatures are not read again: at a similarity of 0.8 the
#: standard deviation over 125 components is 0.036, so this lies five deviations below: once in three million pairs.
SKETCH_FLOOR = 0.62
#: Members up to which a bucket's pairs become rows.
SMALL = 32
#: Shingles and documents of a crowd's block (some 12 MB), and into how many blocks smaller crowds are dealt.
BLOCK_SHINGLES, BLOCK_ROWS, BLOCKS = 1 << 20, 4096, 8
#: Up to so many ids of candidates (8 bytes each) are broadcast to pick their texts; beyond, the texts are shuffled.
BROADCAST_IDS = 2_000_000
#: Up to so many documents' labels are broadcast to the links; beyond, both are shuffled.
BROADCAST_LABELS = 100_000
_ONE, _TWO = np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0x2545F4914F6CDD1D)


def weighted(found: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's distinct shingles: (row, hash, count)."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((found, row))
    row, found = row[order], found[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (found[1:] != found[:-1])
    at = np.flatnonzero(new)
    return row[at], found[at], np.diff(np.append(at, len(row)))


def signatures(found: np.ndarray, bounds: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """ProbMinHash components (rows x size) of rows of shingle hashes; zeros for a row without shingles."""
    rows = len(bounds) - 1
    row, item, weight = weighted(found, bounds)
    best = np.full(rows * size, np.inf)
    who = np.zeros(rows * size, np.uint64)
    time, turn = np.zeros(len(row)), 0
    while len(row):
        turn += 1
        h = finish(item * _TWO + np.uint64(turn * int(_ONE) & 0xFFFFFFFFFFFFFFFF))
        unit = ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        time = time - np.log(unit) / weight
        slot = row * size + (finish(h ^ _ONE) % np.uint64(size)).astype(np.int64)
        early = np.flatnonzero(time < best[slot])
        order = early[np.lexsort((item[early], time[early], slot[early]))]
        first = np.ones(len(order), bool)
        first[1:] = slot[order][1:] != slot[order][:-1]
        win = order[first]
        best[slot[win]], who[slot[win]] = time[win], item[win]
        going = time < best.reshape(rows, size).max(1)[row]
        row, item, weight, time = row[going], item[going], weight[going], time[going]
    return who.reshape(rows, size)


def plain_signatures(found: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows that repeat a shingle, and their signatures when every distinct shingle weighs 1."""
    row, item, weight = weighted(found, bounds)
    rows = np.unique(row[weight > 1])
    some = np.isin(row, rows)
    return rows, signatures(item[some], np.append(np.searchsorted(row[some], rows), some.sum()))


def _bands(sig: np.ndarray) -> np.ndarray:
    bands = np.full((len(sig), BANDS), 0x9E37, np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        bands = mix(bands, sig[:, k::ROWS])
    return bands.astype(np.int64)


def sketch(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_words, key, bands, sig, plain): the digest of the words, a hash for each band of both signatures, the
    components' low bytes; ``plain`` has those of the second signature and is null where both are the same."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text", 1 << 20):
            data, offsets = buffer_of(batch.column(1))
            starts, ends, bounds = words(data, offsets)
            hashes = span_hashes(data, starts, ends)
            found, at = shingles(hashes, bounds)
            sig = signatures(found, at)
            bands, plain = list(_bands(sig)), [None] * len(sig)
            again, flat = plain_signatures(found, at)
            for r, own, other in zip(again.tolist(), flat, _bands(flat), strict=True):
                bands[r], plain[r] = np.union1d(bands[r], other), own.astype(np.uint8).view(np.int8)
            second = span_hashes(data, starts, ends, 7)
            keys = [hashes[a:b].tobytes() + second[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.diff(bounds), pa.int64()),
                    pa.array([hashlib.md5(k).digest() for k in keys], pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                    pa.FixedSizeListArray.from_arrays(pa.array(sig.astype(np.uint8).view(np.int8).ravel()), BANDS * ROWS).cast(pa.list_(pa.int8())),
                    pa.array(plain, pa.list_(pa.int8())),
                ],
                ["doc_id", "n_words", "key", "bands", "sig", "plain"],
            )

    picked = docs.select("doc_id", F.col(text).alias("_text"))
    return picked.mapInArrow(run, f"doc_id {kind}, n_words bigint, key binary, bands array<bigint>, sig array<tinyint>, plain array<tinyint>")


# --- verification --------------------------------------------------------------------------------------


def probability_jaccard(a: np.ndarray, p: np.ndarray, b: np.ndarray, q: np.ndarray) -> float:
    """J_P of two weighted sets (sorted distinct hashes and their counts), in the time of a sort.

    Over the common elements i: 1 / sum over all j of max(p_j / p_i, q_j / q_i). Which side of the maximum
    holds depends only on how the ratios p_j / q_j and p_i / q_i compare, so sums over sorted ratios give all.
    """
    both, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    pc, qc = p[ia], q[ib]
    ratio = pc / qc
    order = np.argsort(ratio, kind="stable")
    ratio, pc, qc = ratio[order], pc[order], qc[order]
    only_p, only_q = 1.0 - pc.sum(), 1.0 - qc.sum()
    below = np.searchsorted(ratio, ratio, "left")  # those j have the larger q_j / q_i
    sums_p, sums_q = np.concatenate([[0], np.cumsum(pc)]), np.concatenate([[0], np.cumsum(qc)])
    total = (sums_p[-1] - sums_p[below] + max(only_p, 0.0)) / pc + (sums_q[below] + max(only_q, 0.0)) / qc
    return float((1.0 / total).sum())


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The larger of the probability Jaccard and the plain Jaccard of two documents' shingles."""
    common = len(np.intersect1d(a[0], b[0], assume_unique=True))
    plain = common / max(1, len(a[0]) + len(b[0]) - common)
    return max(plain, probability_jaccard(*a, *b)) if common else 0.0


def _shingled(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    data, offsets = buffer_of(column)
    starts, ends, bounds = words(data, offsets)
    row, item, count = weighted(*shingles(span_hashes(data, starts, ends), bounds))
    cut = np.searchsorted(row, np.arange(len(column) + 1))
    return [(item[a:b], count[a:b].astype(np.float64)) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "ta", 1 << 20):
        at = {batch.schema.names[i]: batch.column(i) for i in range(batch.num_columns)}
        leader, last = None, None
        near = []
        ours = _shingled(at["tb"])
        for text, other in zip(at["ta"], ours, strict=True):
            if last is None or text.as_py() != last:  # rows of one leader stand together
                last = text.as_py()
                leader = _shingled(pa.array([last], at["ta"].type))[0]
            near.append(similarity(leader, other))
        keep = np.array(near) >= THRESHOLD
        yield pa.RecordBatch.from_arrays([at["a"].filter(pa.array(keep)), at["b"].filter(pa.array(keep)), pa.array(np.array(near)[keep])], ["a", "b", "similarity"])


def verify(pairs: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """The pairs (a, b) whose texts are near enough: (a, b, similarity)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("t")).join(ids, "doc_id", "left_semi")
    of_b = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("t").alias("tb")), "b")
    both = of_b.join(texts.select(F.col("doc_id").alias("a"), F.col("t").alias("ta")), "a")
    near = both.select("a", "b", "ta", "tb").mapInArrow(_verified, f"a {kind}, b {kind}, similarity double")
    return near.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


# --- classes -------------------------------------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """(id, label) for every id in the links (a, b): the least id that links reach, by rounds of joins.

    Every round takes the least label among a node and its neighbours, then the label of that label, so that a
    path halves; each round's table goes to the shared folder. Every round reads the links, so they should be stored.
    """
    both = links.select("a", "b").union(links.select("b", "a"))
    labels = staged(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "id"), "labels")
    held = _sent(labels)
    while True:
        heard = both.join(held(labels.withColumnRenamed("id", "b")), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("least"))
        one = heard.join(held(labels), "id").select("id", F.col("label").alias("old"), F.least("label", "least").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("far"))
        moved = staged(one.join(held(jump), "label").select("id", "old", F.least("label", "far").alias("label")), "labels")
        labels = moved.select("id", "label")
        if moved.where("label <> old").isEmpty():
            return labels


def _sent(labels: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """How tables of the size of ``labels`` go into joins."""
    return F.broadcast if labels.count() <= BROADCAST_LABELS else lambda df: df


def _agreement(a: str, b: str) -> Column:
    """The share of equal components of two signatures."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda acc, x: acc + x) / F.lit(float(BANDS * ROWS))


def merged_labels(known: DataFrame | None, new: DataFrame) -> DataFrame:
    """(id, label) after new links (a, b): the classes so far stand for their members, so only they are linked."""
    ends = new.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    if known is None:
        return components(new)
    ids = staged(known.unionByName(ends.join(known, "id", "left_anti").select("id", F.col("id").alias("label"))), "labels")
    held = _sent(ids)
    la, lb = (held(ids.select(F.col("id").alias(x), F.col("label").alias(f"l{x}"))) for x in "ab")
    between = new.join(la, "a").join(lb, "b").where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct()
    moved = components(staged(between, "links")).select(F.col("id").alias("label"), F.col("label").alias("to"))
    return staged(ids.join(moved, "label", "left").select("id", F.coalesce("to", "label").alias("label")), "labels")


def limits(docs: DataFrame, ids: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n, own, share): of each document, its distinct shingles, how many of them none of the other documents
    in ``ids`` has, and the weight of those among all. Documents of several rows are left out."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "t", 1 << 20):
            for row, (item, count) in enumerate(_shingled(batch.column(1))):
                n = len(item)
                columns = [batch.column(0).take(pa.array([row] * n, pa.int64())), pa.array(item.view(np.int64)), pa.array(count / max(1.0, count.sum())), pa.array([n] * n, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item", "weight", "n"])

    texts = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("t")).join(ids, "doc_id", "left_semi")
    found = texts.mapInArrow(run, f"doc_id {kind}, item bigint, weight double, n bigint")
    owned = found.groupBy("item").agg(F.count("*").alias("times"), *(F.first(c).alias(c) for c in ("doc_id", "weight", "n")))
    once = owned.where("times = 1").groupBy("doc_id").agg(F.count("*").alias("own"), F.sum("weight").alias("share"), F.max("n").alias("n"))
    single = texts.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows = 1").select("doc_id")
    return once.join(single, "doc_id").select("doc_id", "n", "own", "share")


def _reachable(x: dict[str, Column], y: dict[str, Column]) -> Column:
    """Whether two documents' bounds allow a similarity of ``THRESHOLD``; true where one has none.

    Common shingles are at most n - own of either, and the union holds one document and the other's own. With own
    weights p and q, the probability Jaccard is at most (1 - p)(1 - q) / (1 - pq).
    """
    plain = F.least(x["n"] - x["own"], y["n"] - y["own"]) / F.greatest(x["n"] + y["own"], y["n"] + x["own"])
    weighted_ = (1 - x["share"]) * (1 - y["share"]) / F.greatest(1 - x["share"] * y["share"], F.lit(1e-12))
    return F.coalesce(F.greatest(plain, weighted_) >= THRESHOLD - 1e-6, F.lit(True))


def _met_by_centres(members: DataFrame, marks: DataFrame) -> DataFrame:
    """The pairs (a, b, low, high) of all members with their buckets' centres whose signatures agree enough."""
    centre = members.where("place < 0").select("bucket", F.col("doc_id").alias("a"))
    met = members.where("place >= 0").join(centre, "bucket")
    low, high = F.least("a", "doc_id").alias("low"), F.greatest("a", "doc_id").alias("high")
    pairs = met.select(low, high, "a").groupBy("low", "high").agg(F.min("a").alias("a")).select("low", "high", "a", F.when(F.col("a") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("b"))
    sigs = marks.select("doc_id", "sig", F.coalesce("plain", "sig").alias("plain"))
    agree = pairs.join(sigs.withColumnsRenamed({"doc_id": "a", "sig": "sa", "plain": "pa"}), "a").join(sigs.withColumnsRenamed({"doc_id": "b", "sig": "sb", "plain": "pb"}), "b")
    return agree.where((_agreement("sa", "sb") >= SKETCH_FLOOR) | (_agreement("pa", "pb") >= SKETCH_FLOOR)).select("a", "b", "low", "high")


_INFO = ("n", "own", "share", "sig", "plain", "bands")


def _met_in_buckets(members: DataFrame, info: DataFrame) -> DataFrame:
    """The pairs (a, b, low, high) of members of other classes that may be near; those of one crowd meet there."""
    wide = members.join(info, "doc_id")
    leader = wide.select("bucket", F.col("doc_id").alias("a"), F.col("label").alias("la"), *(F.col(c).alias(f"{c}_a") for c in ("crowd", *_INFO)))
    later = (F.col("label") != F.col("la")) & (F.col("a") < F.col("doc_id")) & F.coalesce(F.col("crowd") != F.col("crowd_a"), F.lit(True))
    near = _reachable(*({c: F.col(f"{c}{end}") for c in _INFO} for end in ("", "_a")))
    first = F.array_min(F.array_intersect("bands", "bands_a")) == F.col("bucket")
    agree = (_agreement("sig", "sig_a") >= SKETCH_FLOOR) | (_agreement("plain", "plain_a") >= SKETCH_FLOOR)
    met = wide.join(leader, "bucket").where(later & near & first & agree)
    return met.select("a", F.col("doc_id").alias("b"), F.col("a").alias("low"), F.col("doc_id").alias("high"))


# --- crowds --------------------------------------------------------------------------------------------


def joining(label: np.ndarray, left: np.ndarray, right: np.ndarray, items: np.ndarray, counts: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, float]]:
    """Links (x, y, similarity) between rows ``left`` and ``right`` that join all classes with near rows among them.

    Row r has the distinct shingles items[bounds[r]:bounds[r + 1]] and their counts; equal labels are one class from the
    start. Where ``left`` and ``right`` are the same, each pair meets once. Common shingles are counted for all pairs:
    those of many rows by a product of matrices, the others by their postings. They give the plain Jaccard, and with the
    heaviest shingles of either side a bound of the probability Jaccard, which is worked out only where that allows it.
    """
    n, same, cls = np.diff(bounds), np.array_equal(left, right), label.copy()
    row = np.repeat(np.arange(len(n)), n)
    _, at, times = np.unique(items, return_inverse=True, return_counts=True)
    often = times >= max(16, len(n) // 16)
    number = np.cumsum(often) - 1
    repeats = np.maximum.reduceat(np.append(counts, 0), bounds[:-1]) > 1 if len(n) else np.zeros(0, bool)
    heavy = np.lexsort((-counts, row))  # the heaviest first in every row
    total = np.concatenate([[0], np.cumsum(counts[heavy])])
    weight = np.maximum(total[bounds[1:]] - total[bounds[:-1]], 1)
    place = np.full(len(n), -1)
    place[right] = np.arange(len(right))
    theirs = np.flatnonzero(place[row] >= 0)
    rare = theirs[~often[at[theirs]]]
    rare = rare[np.argsort(at[rare], kind="stable")]
    first, holder = np.searchsorted(at[rare], np.arange(len(times) + 1)), place[row[rare]]
    common = theirs[often[at[theirs]]]
    ny, step, found = n[right], max(1, min(256, (1 << 22) // max(1, len(right)))), []
    for begin in range(0, len(left), step):
        strip = left[begin : begin + step]
        shared = np.zeros((len(strip), len(right)), np.float32)
        mine = np.full(len(n), -1)
        mine[strip] = np.arange(len(strip))
        ours = np.flatnonzero((mine[row] >= 0) & often[at])
        for low in range(0, int(often.sum()), 1024):
            x, y = np.zeros((len(strip), 1024), np.float32), np.zeros((len(right), 1024), np.float32)
            for matrix, entries, where in ((x, ours, mine), (y, common, place)):
                some = entries[(number[at[entries]] >= low) & (number[at[entries]] < low + 1024)]
                matrix[where[row[some]], number[at[some]] - low] = 1
            shared += x @ y.T
        for k, r in enumerate(strip.tolist()):
            seen = at[bounds[r] : bounds[r + 1]]
            seen = seen[~often[seen]]
            size = first[seen + 1] - first[seen]
            where = np.repeat(first[seen] - np.cumsum(size) + size, size) + np.arange(size.sum())
            both = shared[k].astype(np.int64) + np.bincount(holder[where], minlength=len(right))
            plain = both / np.maximum(1, n[r] + ny - both)
            p = (total[bounds[r] + both] - total[bounds[r]]) / weight[r]
            q = (total[bounds[right] + both] - total[bounds[right]]) / weight[right]
            most = np.where(repeats[r] | repeats[right], p * q / np.maximum(p + q - p * q, 1e-12), 0.0)
            open_ = (both > 0) & (cls[right] != cls[r]) & ((plain >= THRESHOLD) | (most >= THRESHOLD - 1e-6))
            if same:
                open_ &= right > r
            for j in np.flatnonzero(open_).tolist():
                other = int(right[j])
                if cls[other] == cls[r]:
                    continue
                (a, b), (c, d) = bounds[[r, r + 1]], bounds[[other, other + 1]]
                near = plain[j] if plain[j] >= THRESHOLD else probability_jaccard(items[a:b], counts[a:b].astype(float), items[c:d], counts[c:d].astype(float))
                if near >= THRESHOLD:
                    found.append((r, other, float(near)))
                    cls[cls == cls[other]] = cls[r]
    return found


def crowded(docs: DataFrame, placed: DataFrame, text: str = "text") -> DataFrame:
    """Links (a, b, similarity) that join the classes of every crowd; ``placed`` has (doc_id, label, crowd, n).

    A crowd's documents are dealt into blocks by their ids and go to each pair of blocks that theirs is in.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    size = placed.groupBy("crowd").agg(F.sum(F.coalesce("n", F.lit(0))).alias("all"), F.count("*").alias("rows"))
    blocks = F.greatest(F.ceil(F.col("all") / BLOCK_SHINGLES), F.ceil(F.col("rows") / BLOCK_ROWS), F.least(F.ceil(F.col("rows") / 128), F.lit(BLOCKS)))
    dealt = staged(placed.join(size.select("crowd", blocks.cast("int").alias("blocks")), "crowd").select("doc_id", "label", "crowd", "blocks", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int").alias("block")), "crowds")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "t", 1 << 20):
            found = _shingled(batch.column(1))
            columns = [[item.tobytes() for item, _ in found], [count.astype(np.int32).tobytes() for _, count in found]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.binary()) for c in columns)], ["doc_id", "items", "counts"])

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        column = {c: group.column(c).combine_chunks() for c in ("doc_id", "label", "block", "items", "counts")}
        (items, ends), (counts, _) = buffer_of(column["items"]), buffer_of(column["counts"])
        label = column["label"].dictionary_encode()
        label = (label.combine_chunks() if isinstance(label, pa.ChunkedArray) else label).indices.to_numpy(zero_copy_only=False).astype(np.int64)
        block = column["block"].to_numpy(zero_copy_only=False)
        left, right = (np.flatnonzero(block == group.column(c)[0].as_py()) for c in ("i", "j"))
        found = joining(label, left, right, np.frombuffer(items.tobytes(), np.uint64), np.frombuffer(counts.tobytes(), np.int32).astype(np.int64), ends // 8)
        ids = [column["doc_id"].take(pa.array([f[k] for f in found], pa.int64())) for k in (0, 1)]
        return pa.Table.from_arrays([*ids, pa.array([f[2] for f in found], pa.float64())], ["a", "b", "similarity"])

    ids = dealt.select("doc_id")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("t")).join(ids, "doc_id", "left_semi")
    known = staged(texts.mapInArrow(sets, f"doc_id {kind}, items binary, counts binary").join(dealt, "doc_id"), "sets")
    other = known.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = other.select("doc_id", "label", "crowd", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "items", "counts")
    return pairs.groupBy("crowd", "i", "j").applyInArrow(compare, f"a {kind}, b {kind}, similarity double")


def links_of(docs: DataFrame, marks: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b) between distinct texts, and their classes (id, label).

    ``marks`` has (doc_id, bands, sig, plain) for one document of every distinct text. A bucket's centre is the member
    that shares most buckets with others: it meets all the bucket first and, where the members are copies of it, settles
    it. What is left in buckets of several classes meets in pairs or, where there are many, in crowds.
    """
    buckets = marks.select("doc_id", F.explode("bands").alias("bucket"))
    full = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = staged(buckets.join(full, "bucket"), "buckets")
    crowd = shared.groupBy("doc_id").agg(F.sum("n").alias("crowd"))
    centre = shared.join(crowd, "doc_id").groupBy("bucket").agg(F.max_by("doc_id", F.struct("crowd", F.xxhash64("doc_id"), "doc_id")).alias("centre"))
    place = F.when(F.col("doc_id") == F.col("centre"), -1).otherwise(0)
    members = staged(shared.join(centre, "bucket").select("bucket", "doc_id", place.alias("place")), "buckets")
    likely = staged(_met_by_centres(members, marks), "pairs")
    links = staged(verify(likely.select("a", "b"), docs, text), "verified")
    classes = merged_labels(None, links)
    # the centres have met all of their buckets; of the others, buckets that hold more than one class meet again
    label = classes.select(F.col("id").alias("doc_id"), "label")
    named = members.where("place >= 0").join(label, "doc_id", "left").select("bucket", "doc_id", F.coalesce("label", "doc_id").alias("label"))
    left = staged(_mixed(named), "buckets")
    if left.isEmpty():
        return links, classes
    ids = left.select("doc_id")
    known = marks.join(ids, "doc_id", "left_semi").join(limits(docs, ids, text), "doc_id", "left").withColumn("plain", F.coalesce("plain", "sig"))
    alone = F.greatest(1 - F.col("own") / F.col("n"), 1 - F.col("share")) < THRESHOLD - 1e-6
    info = staged(known.where(~F.coalesce(alone, F.lit(False))).select("doc_id", *_INFO), "limits")
    left = staged(_mixed(left.join(info.select("doc_id"), "doc_id", "left_semi")), "buckets")
    large = left.where((F.col("size") > SMALL) & (F.col("doc_id") != F.col("least"))).select(F.col("least").alias("a"), F.col("doc_id").alias("b"))
    many = not large.isEmpty()
    crowds = (components(large) if many else classes.limit(0)).select(F.col("id").alias("doc_id"), F.col("label").alias("crowd"))
    small = left.where(F.col("size") <= SMALL).select("bucket", "doc_id", "label").join(crowds, "doc_id", "left")
    likely = staged(_met_in_buckets(small, info).join(likely, ["low", "high"], "left_anti").select("a", "b"), "pairs")
    new = staged(verify(likely, docs, text), "verified")
    if many:
        placed = crowds.join(left.select("doc_id", "label").distinct(), "doc_id").join(info.select("doc_id", "n"), "doc_id")
        new = new.unionByName(staged(crowded(docs, placed, text), "verified"))
    return links.unionByName(new), merged_labels(classes, new)


def _mixed(members: DataFrame) -> DataFrame:
    """The members of buckets that hold more than one class: (bucket, doc_id, label), the bucket's size and least id."""
    per = members.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size"), F.min("doc_id").alias("least"))
    return members.select("bucket", "doc_id", "label").join(per.where("low <> high").drop("low", "high"), "bucket")


def classify(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row for each row of ``docs``: doc_id, class_id (the least id of its class), n_links, is_kept.

    ``n_links`` counts the verified links of the document's text to different texts, of a crowd those that join classes;
    ``is_kept`` holds for one document of every class, the one with the class's id.
    """
    marks = staged(sketch(docs, text), "marks")
    solid = marks.where("n_words > 0 AND doc_id IS NOT NULL")
    first = solid.groupBy("key").agg(F.min("doc_id").alias("rep"))
    chosen = solid.join(first.withColumnRenamed("rep", "doc_id"), ["key", "doc_id"])
    reps = staged(chosen.groupBy("doc_id").agg(F.min(F.struct("key", "bands", "sig", "plain")).alias("m")).select("doc_id", "m.*"), "reps")
    links, classes = links_of(docs, reps, text)
    own = marks.select("doc_id", "key", "n_words")
    named = own.join(first, "key", "left").withColumn("rep", F.when(F.col("n_words") > 0, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id")))
    label = classes.select(F.col("id").alias("rep"), "label")
    count = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    out = named.join(label, "rep", "left").join(count, "rep", "left")
    class_id = F.coalesce("label", "rep")
    return out.select("doc_id", class_id.alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), (class_id == F.col("doc_id")).alias("is_kept"))


def keep_first(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one document of each class, the one with the least id; null ids stay."""
    gone = classify(docs, text).where("NOT is_kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)

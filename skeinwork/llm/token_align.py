"""Alignment of two tokenisations of the same text: where both end a token, and which tokens share bytes.

Python only tokenises: a row leaves it with the ids and the byte ends of both sides. All else is array functions. The
bytes of a text point at the tokens that hold them (each token's number repeated over its bytes), so that a common end
finds its tokens at once and a text costs what its length is, not its square: ``array_intersect`` of the ends gives the
groups; every end of either side closes one stretch that one pair of tokens shares, so ``array_union`` gives the links.

Null and empty texts, and texts that one tokeniser doesn't give back byte by byte, have no tokens: zeros and an empty
digest. Repeated rows and repeated or null ids stay rows of their own; columns besides ``doc_id`` and the text are
ignored; an empty table gives no rows. A text of any length is one row with arrays of its tokens and bytes.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from skeinwork.llm.arrays import pieces
from skeinwork.llm.common import staged

FOLDER, BYTE_FILE, PIECE_FILE = "/opt/tokenizers", "byte_bpe_50k.json", "piece_bpe_32k.model"
#: The pattern that splits text before byte-level merges: a fixed value of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pairs that are sent to all tasks (some 60 MB); more are joined by a shuffle.
BROADCAST_PAIRS = 1_000_000
#: Places over which one pair's documents are dealt where pairs are joined by a shuffle.
SALTS = 16
SHIFT = 32


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself where printable, else from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteTokens:
    """A byte-level vocabulary file; ids follow the order of its merges, so that ranks merge as the file does."""

    def __init__(self, data: bytes):
        import tiktoken

        at, spec = byte_characters(), json.loads(data)
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(at[c] for c in piece): number for piece, number in spec["model"]["vocab"].items() if piece not in special}
        self.bytes = [b""] * (max(spec["model"]["vocab"].values()) + 1)
        for piece, number in ranks.items():
            self.bytes[number] = piece
        self.model = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        return self.model.encode_to_numpy(" " + text, disallowed_special=())


class PieceTokens:
    """A piece model, which sets a space before the text itself."""

    def __init__(self, data: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=data)
        pieces = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, num_threads=1), np.int64)


@lru_cache(2)
def _models(sources: tuple[bytes, bytes]) -> tuple[ByteTokens, PieceTokens]:
    return ByteTokens(sources[0]), PieceTokens(sources[1])


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(p) for p in parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *parts]).astype(np.int32), pa.int32()))


def tokens(docs: DataFrame, text: str = "text", folder: str = FOLDER) -> DataFrame:
    """(doc_id, a_ids, a_ends, b_ids, b_ends): both sides' tokens with their ends in bytes of space and text."""
    sources = (Path(folder, BYTE_FILE).read_bytes(), Path(folder, PIECE_FILE).read_bytes())
    kind = docs.schema["doc_id"].dataType
    id_type, none = to_arrow_type(kind), np.zeros(0, np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = _models(sources)
        sizes = [np.array([len(x) for x in m.bytes], np.int32) for m in models]
        for batch in pieces(batches, "_text", 1 << 20):
            columns: list[list[np.ndarray]] = [[], [], [], []]
            for content in batch.column(1).to_pylist():
                found = [m.encode(content) for m in models] if content else [none, none]
                whole = (" " + content).encode() if content else b""
                if any(b"".join([m.bytes[i] for i in ids.tolist()]) != whole for m, ids in zip(models, found, strict=True)):
                    found = [none, none]
                for k, ids in enumerate(found):
                    columns[2 * k].append(ids)
                    columns[2 * k + 1].append(np.cumsum(sizes[k][ids], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(id_type), *map(_lists, columns)], ["doc_id", "a_ids", "a_ends", "b_ids", "b_ends"])

    shape = ", ".join([f"doc_id {kind.simpleString()}", *(f"{c} array<int>" for c in ("a_ids", "a_ends", "b_ids", "b_ends"))])
    return docs.select("doc_id", F.col(text).alias("_text")).mapInArrow(run, shape)


def holders(ends: Column) -> Column:
    """For every byte, the number (from 0) of the token that holds it."""
    return F.flatten(F.transform(ends, lambda e, k: F.array_repeat(k, e - F.when(k > 0, F.get(ends, k - 1)).otherwise(0))))


def links_of() -> Column:
    """The pair of ids that share the stretch before each end of either side, as one number; sorted."""
    link = lambda e: F.shiftleft(F.get("a_ids", F.get("a_of", e - 1)).cast("long"), SHIFT) + F.get("b_ids", F.get("b_of", e - 1))
    return F.sort_array(F.transform(F.array_union("a_ends", "b_ends"), link))


def groups_of() -> Column:
    """``a1,a2|b1;a3|b2,b3``: the ids between common ends."""

    def side(s: str, begin: Column, end: Column) -> Column:
        first, last = F.get(f"{s}_of", begin), F.get(f"{s}_of", end - 1)
        several = F.array_join(F.slice(f"{s}_names", first + 1, last - first + 1), ",")
        return F.when(first == last, F.get(f"{s}_names", first)).otherwise(several)

    groups = F.transform("cuts", lambda end, k: F.concat(side("a", F.get("begins", k), end), F.lit("|"), side("b", F.get("begins", k), end)))
    return F.array_join(groups, ";")


def aligned(found: DataFrame) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, links) of ``tokens``, by array functions alone.

    What lambdas look up (cuts, holders, names) is made a step before, so that it is worked out once for a row.
    """
    sizes = [F.size(f"{s}_ids").cast("long").alias(f"n_{s}") for s in "ab"]
    cuts = F.array_intersect("a_ends", "b_ends")
    found = found.select(F.monotonically_increasing_id().alias("row"), "*", cuts.alias("cuts"), F.concat(F.array(F.lit(0)), cuts).alias("begins"), *(holders(F.col(f"{s}_ends")).alias(f"{s}_of") for s in "ab"), *(F.col(f"{s}_ids").cast("array<string>").alias(f"{s}_names") for s in "ab"))
    digest = F.when(F.size("cuts") > 0, F.sha2(groups_of(), 256)).otherwise("")
    found = found.select("row", "doc_id", *sizes, F.size("cuts").cast("long").alias("n_groups"), digest.alias("groups_sha256"), links_of().alias("links"))
    return found.withColumn("n_links", F.size("links").cast("long"))


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n_docs, best): how many documents hold a pair, and whether no pair of its first id is in more."""
    counts = rows.select(F.explode(F.array_distinct("links")).alias("pair")).groupBy("pair").agg(F.count("*").alias("n_docs"))
    counts = counts.withColumn("a", F.shiftright("pair", SHIFT))
    most = counts.groupBy("a").agg(F.max("n_docs").alias("most"))
    return counts.join(most, "a").select("pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def align(docs: DataFrame, text: str = "text", folder: str = FOLDER, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """A row for each document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    rows = staged(aligned(tokens(docs, text, folder)), "aligned")
    counts = staged(pair_counts(rows), "pairs")
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    sums = [F.coalesce(F.sum(F.when(F.col("best"), F.col("n"))), F.lit(0)).alias("n_best"), F.coalesce(F.sum(F.col("n") * F.col("n_docs")), F.lit(0)).alias("count_sum")]
    linked = rows.select("row", F.explode("links").alias("pair"))
    if counts.count() <= broadcast_pairs:
        summed = linked.withColumn("n", F.lit(1).cast("long")).join(F.broadcast(counts), "pair").groupBy("row").agg(*sums)
    else:
        salt = F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")
        spread = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        summed = linked.groupBy("row", "pair").agg(F.count("*").alias("n")).withColumn("salt", salt).join(spread, ["pair", "salt"]).groupBy("row").agg(*sums)
    found = rows.select("row", *kept).join(summed, "row", "left")
    return found.select(*kept[:-1], *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")), "groups_sha256")

"""Comparing identifiers over all blocks: each block asks each range of identifiers about its own distinct ones.

A question is a sorted, delta-coded array for one range; a range sorts what all blocks ask and answers in bits, in the
order of the entries. An identifier that a third of all documents has is one entry for each block.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from skeinwork.llm.blocks import opened, pack, pack_batch, pack_sorted, unpack, unpack_sorted

#: Text bytes for each range of identifiers.
RANGE_BYTES, LEAST_RANGES_LOG = 32 << 20, 6

def heads_of(*columns: np.ndarray) -> np.ndarray:
    """Where rows of sorted columns begin a new group."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def grouped(heads: np.ndarray, n: int) -> np.ndarray:
    """The group of each of n sorted rows."""
    return np.repeat(np.arange(len(heads)), np.diff(np.append(heads, n)))


def ranks_of(ids: pa.Array) -> np.ndarray:
    """Numbers that compare as the ids do."""
    if pa.types.is_integer(ids.type):
        return ids.to_numpy(zero_copy_only=False).astype(np.int64)
    return np.unique(np.array(ids.to_pylist(), object), return_inverse=True)[1] if len(ids) else np.zeros(0, np.int64)


def pack_ids(ids: pa.Array, ranks: np.ndarray, rows: np.ndarray) -> bytes:
    """The ids of some rows; ``ranks`` are those of all."""
    if pa.types.is_integer(ids.type):
        return pack(ranks[rows])
    return pack_batch(pa.RecordBatch.from_arrays([ids.take(pa.array(rows))], ["id"]))


def unpacked_ids(messages: list[bytes], kind: pa.DataType) -> np.ndarray:
    if pa.types.is_integer(kind):
        return np.concatenate([unpack(m, np.int64) for m in messages])
    return ranks_of(pa.concat_arrays([opened(m).column(0) for m in messages]))


def cuts_of(keys: np.ndarray, bits: int, log: int) -> np.ndarray:
    """Where the ranges begin in sorted keys of so many bits; there are 2^log ranges."""
    return np.append(np.searchsorted(keys, np.arange(1 << log, dtype=np.uint64) << np.uint64(bits - log)), len(keys))


def bits_of(*flags: np.ndarray) -> bytes:
    return b"".join(np.packbits(f).tobytes() for f in flags)


def flags_of(answers: pa.Table, kind: int, cuts: np.ndarray, n: int) -> list[np.ndarray]:
    """The flags that the ranges answered, n for each entry, in the order of the entries."""
    out = [np.zeros(int(cuts[-1]), bool) for _ in range(n)]
    for k, part, data in zip(answers.column("kind").to_pylist(), answers.column("part").to_pylist(), answers.column("bits").to_pylist(), strict=True):
        if k == kind:
            size = int(cuts[part + 1] - cuts[part])
            for flags, bits in zip(out, np.split(np.frombuffer(data, np.uint8), n), strict=True):
                flags[cuts[part] : cuts[part + 1]] = np.unpackbits(bits, count=size)
    return out


def answer_rows(group: pa.Table, kind: int, sizes: list[int], *flags: np.ndarray) -> pa.Table:
    ends = np.cumsum(sizes)
    data = [bits_of(*(f[e - n : e] for f in flags)) for e, n in zip(ends, sizes, strict=True)]
    n = group.num_rows
    return pa.table({"block": group.column("block"), "kind": pa.array([kind] * n, pa.int32()), "part": group.column("part"), "bits": pa.array(data, pa.binary())})


ANSWER = "block bigint, kind int, part int, bits binary"


def of_least(kind: pa.DataType, number: int) -> Callable[[pa.Table], pa.Table]:
    """Which identifiers a smaller document has, as answers of this kind."""

    def answer(group: pa.Table) -> pa.Table:
        found = [unpack_sorted(d, np.uint64) for d in group.column("data").to_pylist()]
        key, rank = np.concatenate(found), unpacked_ids(group.column("ids").to_pylist(), kind)
        order = np.lexsort((rank, key))
        heads = heads_of(key[order])
        flags = np.empty(len(key), bool)
        flags[order] = rank[order] != rank[order][heads][grouped(heads, len(key))]
        return answer_rows(group, number, [len(x) for x in found], flags)

    return answer


def questions(block: int, log: int, bits: int, keys: np.ndarray, row: Callable[[int, int], list[bytes]]) -> pa.Table:
    """A row (part, block, ...) for each range that the sorted keys reach; ``row`` packs the entries from a to b."""
    cut = cuts_of(keys, bits, log)
    parts = np.flatnonzero(np.diff(cut))
    packed = [row(int(cut[p]), int(cut[p + 1])) for p in parts]
    names = ["data", "contents", "ids"]
    columns = [pa.array([p[k] for p in packed], pa.binary()) for k in range(3)]
    return pa.table([pa.array(parts, pa.int32()), pa.array([block] * len(parts), pa.int64()), *columns], names=["part", "block", *names])


QUESTION = "part int, block bigint, data binary, contents binary, ids binary"


def ranges_log(size: int) -> int:
    return max(LEAST_RANGES_LOG, min(20, math.ceil(math.log2(max(1, size / RANGE_BYTES)))))



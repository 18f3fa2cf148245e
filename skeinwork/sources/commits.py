"""Commit blocks: version, did, rev, the tree's root, and a signature over all but itself."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from skeinwork.functions.cbor import Link, decode, encode

VERSIONS = (2, 3)


def unsigned(did: str, rev: str, data: str, version: int = 3) -> dict:
    return {"did": did, "rev": rev, "data": Link.parse(data), "prev": None, "version": version}


def signed(commit: dict, signature: bytes) -> bytes:
    return encode({**commit, "sig": signature})


def opened(block: bytes) -> tuple[dict, bytes | None]:
    """A commit without its signature, and that; other shapes are errors. Version 2 may lack rev and signature."""
    commit = decode(block)
    if not isinstance(commit, dict) or commit.get("version") not in VERSIONS or isinstance(commit["version"], bool):
        raise ValueError("not a commit of a known version")
    version = commit["version"]
    kinds = {"did": str, "data": Link, "rev": str, "sig": bytes}
    for name, kind in kinds.items():
        if name not in commit and name in ("rev", "sig") and version == 2:
            continue
        if not isinstance(commit.get(name), kind):
            raise ValueError(f"commit has no valid {name}")
    if not isinstance(commit.get("prev"), (Link, type(None))):
        raise ValueError("commit has no valid prev")
    content = {"did": commit["did"], "rev": commit.get("rev", ""), "data": commit["data"], "prev": commit.get("prev"), "version": version}
    return content, commit.get("sig")


def sealed(roots: DataFrame, sign: Callable[[str, bytes], bytes]) -> DataFrame:
    """(repo, rev, cid, data): a signed commit block for each (repo, rev, root).

    ``sign`` takes a repository and the unsigned bytes; it runs in tasks, so it must find its keys there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = []
            for repo, rev, root in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                commit = unsigned(repo, rev, root)
                blocks.append(signed(commit, sign(repo, encode(commit))))
            cids = [str(Link(b"\x01\x71\x12\x20" + hashlib.sha256(b).digest())) for b in blocks]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cids, pa.string()), pa.array(blocks, pa.binary())], ["repo", "rev", "cid", "data"])

    return roots.select("repo", "rev", "root").mapInArrow(run, "repo string, rev string, cid string, data binary")


def decoded(blocks: DataFrame, key: str, data: str = "data") -> DataFrame:
    """(key, did, rev, version, root, content, signature, error); ``content`` is what the signature covers."""
    kind = blocks.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for block in batch.column(1).to_pylist():
                try:
                    commit, signature = opened(block or b"")
                    rows.append((commit["did"], commit["rev"], commit["version"], str(commit["data"]), encode(commit), signature, None))
                except (ValueError, UnicodeDecodeError) as why:
                    rows.append((None, None, None, None, None, None, str(why)))
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], [key, "did", "rev", "version", "root", "content", "signature", "error"])

    return blocks.select(key, data).mapInArrow(run, f"{key} {kind}, did string, rev string, version bigint, root string, content binary, signature binary, error string")

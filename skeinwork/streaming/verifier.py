"""The commit verifier: gates in order over each repository's commits.

Everything that a commit shows by itself (``inspected``: its archive, its signed block, the root before its ops, its
fields and record ids) is worked out wherever the commit lies, and signatures beside it; only small rows then meet by
repository. ``step`` is the one place that decides an outcome and the next state: the batch folds it over partitions
sorted by repository and sequence, the stream keeps its state in the state store.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, fields
from itertools import accumulate

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.functions.cbor import encode
from skeinwork.functions.curves import verified
from skeinwork.functions.identifiers import TID
from skeinwork.functions.tids import DIGITS
from skeinwork.operators import merkle, streams
from skeinwork.session import stored, work_dir
from skeinwork.sources import archives, commits as commit_blocks
from skeinwork.streaming.files import ordered_files

_REV = re.compile(rf"\A{TID}\Z")
#: Commits in a batch of the stream.
ROWS_A_BATCH = 1_000_000
#: Groups of repositories in the stream. A group costs some milliseconds a batch however few rows it has, and its state
#: is written anew where any of its repositories has rows.
GROUPS = 1024
#: Commits whose archives a task holds as Python values at once.
ROWS_AT_ONCE = 64
OUTPUT = "seq bigint, repo string, rev string, outcome string, note string, missing bigint"
OPS = "array<struct<action:string,path:string,cid:string,prev:string>>"


@dataclass(frozen=True)
class State:
    """What is known of a repository: the last rev and data that hold, and whether it waits for a resync."""

    rev: str = ""
    data: str = ""
    waiting: bool = False


@dataclass(frozen=True)
class Policy:
    """``now_us`` and ``tolerance_us`` bound revs from the future. ``resync`` sends failures to a resync, for which later
    failures wait; without it a failure is an error, and its data becomes the new state where the archive could be
    read. ``lenient`` takes a commit that names the known data though its inverted root differs; ``reject_legacy``
    treats commits without previous data as failures instead of skipping the chain check."""

    now_us: int | None = None
    tolerance_us: int = 300_000_000
    resync: bool = False
    lenient: bool = True
    reject_legacy: bool = False


@dataclass(frozen=True)
class Checked:
    """What a commit shows by itself, its account and its signature."""

    rev: str | None
    prev_data: str | None
    early: str | None  # the outcome of a gate before the state is read
    duplicate: bool
    data: str | None  # null where the archive or the commit block can't be read
    rooted: bool
    legacy: bool
    inverted: str | None  # null where blocks or prevs are missing
    field: str | None
    op_error: str | None
    missing: int
    active: bool
    signed: bool | None  # null without a key


FIELDS = [f.name for f in fields(Checked)]


def rev_micros(rev: str) -> int:
    value = 0
    for c in rev:
        value = value * 32 + DIGITS.index(c)
    return value >> 10


def early_outcome(rev: str | None, n_bytes: int, n_ops: int, policy: Policy) -> str | None:
    if rev is None or not _REV.match(rev):
        return "InvalidRev"
    if policy.now_us is not None and policy.tolerance_us >= 0 and rev_micros(rev) > policy.now_us + policy.tolerance_us:
        return "FutureRev"
    return "Oversized" if n_bytes > streams.MAX_BYTES or n_ops > streams.MAX_OPS else None


def is_legacy(prev_data: str | None, ops: list[dict]) -> bool:
    return not prev_data and bool(ops) and not any(o["action"] in ("update", "delete") and o["prev"] for o in ops)


def opened_archive(blocks: bytes, commit: str) -> tuple[dict, bytes | None, str, dict[str, bytes]]:
    """The commit, its signature, the archive's root and all blocks."""
    roots, at = archives.read_header(blocks)
    held = dict(archives.read_blocks(blocks, at))
    if commit not in held:
        raise ValueError("the commit's block is missing")
    return *commit_blocks.opened(held[commit]), roots[0], held


_SHOWN = FIELDS[: FIELDS.index("active")] + ["content", "signature"]
_SHOWN_DDL = "early string, duplicate boolean, data string, rooted boolean, legacy boolean, inverted string, field string, op_error string, missing bigint, content binary, signature binary"


def inspect(repo: str, rev: str | None, commit: str, prev_data: str | None, blocks: bytes, ops: list[dict], policy: Policy) -> dict:
    """What one commit shows by itself, with what its signature covers."""
    out: dict = dict.fromkeys(_SHOWN) | {"early": early_outcome(rev, len(blocks), len(ops), policy), "duplicate": len({o["path"] for o in ops}) < len(ops), "rooted": False, "legacy": is_legacy(prev_data, ops), "missing": 0}
    if out["early"] or out["duplicate"]:
        return out
    try:
        inner, signature, root, held = opened_archive(blocks, commit)
    except (ValueError, KeyError, TypeError):
        return out
    data = str(inner["data"])
    out |= {"data": data, "rooted": root == commit, "content": encode(inner), "signature": signature or b""}
    out["missing"] = sum(o["action"] != "delete" and o["cid"] not in held for o in ops)
    items = [merkle.Item(None, data, 1 << 20)]  # a tree of which nothing is known
    try:
        items = merkle.unfolded(held, data)
        out["inverted"] = merkle.inverted(items, ops)
    except (ValueError, KeyError, TypeError):
        pass
    out["op_error"] = merkle.op_error(items, ops)
    own = (("version", inner["version"] == streams.VERSION), ("did", inner["did"] == repo), ("rev", inner["rev"] == rev))
    out["field"] = next((name for name, same in own if not same), None)
    return out


def _ops_of(column: pa.ListArray) -> list[list[dict]]:
    """The ops of each row, read by field; null lists are empty."""
    ops = column.flatten()
    names = [f.name for f in ops.type]
    rows = [dict(zip(names, values, strict=True)) for values in zip(*(c.to_pylist() for c in ops.flatten()), strict=True)]
    ends = list(accumulate(n or 0 for n in pc.list_value_length(column).to_pylist()))
    return [rows[begin:end] for begin, end in zip([0, *ends[:-1]], ends, strict=True)]


def inspected(commits: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """(seq, repo, rev, prev_data, ...) of commits (seq, repo, rev, commit, prev_data, blocks, ops), without a shuffle.

    ``content`` and ``signature`` are null where no gate comes to the signature.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                rows = zip(*(c.to_pylist() for c in part.columns[1:6]), _ops_of(part.column(6)), strict=True)
                shown = [inspect(repo, rev, commit, prev, blocks or b"", ops, policy) for repo, rev, prev, commit, blocks, ops in rows]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], *(pa.array([s[k.name] for s in shown], k.type) for k in kinds)], ["seq", "repo", "rev", "prev_data", *kinds.names])

    text, flag = pa.string(), pa.bool_()
    kinds = pa.schema([("early", text), ("duplicate", flag), ("data", text), ("rooted", flag), ("legacy", flag), ("inverted", text), ("field", text), ("op_error", text), ("missing", pa.int64()), ("content", pa.binary()), ("signature", pa.binary())])
    return commits.select("seq", "repo", "rev", "prev_data", "commit", "blocks", "ops").mapInArrow(run, f"seq bigint, repo string, rev string, prev_data string, {_SHOWN_DDL}")


def checked(commits: DataFrame, keys: DataFrame, hosting: DataFrame | None = None, policy: Policy = Policy()) -> DataFrame:
    """(seq, repo) and the fields of ``Checked``.

    ``keys`` has (repo, keys), a list whose later names are tried where the first fail; ``hosting`` has (did, active).
    """
    shown = inspected(commits, policy).join(keys.select("repo", "keys"), "repo", "left")
    rest = ["seq", "repo", *FIELDS[: FIELDS.index("active")]]
    said = verified(shown, [*rest, "keys"], "keys")
    signed: Column = F.when(F.col("keys").isNotNull(), F.col("valid")).alias("signed")
    if hosting is None:
        return said.select(*rest, F.lit(True).alias("active"), signed)
    held = hosting.select(F.col("did").alias("repo"), "active")
    return said.join(held, "repo", "left").select(*rest, F.coalesce("active", F.lit(True)).alias("active"), signed)


def step(state: State, c: Checked, policy: Policy = Policy()) -> tuple[State, str, str | None]:
    """The next state, the outcome, and a note on commits that pass with one: gates in order."""

    def failed(reason: str) -> tuple[State, str, None]:
        if policy.resync:
            return State(state.rev, state.data, True), "buffered" if state.waiting else reason, None
        return (State(c.rev, c.data) if c.data is not None and reason != "DuplicatePath" else state), reason, None

    if c.early:
        return state, c.early, None
    if not c.active:
        return state, "AccountInactive", None
    if state.rev and c.rev <= state.rev:
        return state, "replayed", None
    if c.duplicate:
        return failed("DuplicatePath")
    if c.data is None:
        return failed("InversionFailure")
    if not c.rooted:
        return state, "FieldMismatch", None
    note = "legacy" if state.rev and c.legacy else None
    if note and policy.reject_legacy:
        return failed("LegacyCommit")
    if state.rev and not note:
        if c.inverted is None:
            return failed("InversionFailure")
        named = c.prev_data == state.data
        if not named or c.inverted != state.data:
            if not (named and policy.lenient):
                return failed("ChainBreak")
            note = "incomplete"
    if c.field:
        return state, "FieldMismatch", None
    if not c.signed:
        return state, "KeyUnknown" if c.signed is None else "SignatureFailure", None
    if c.op_error:
        return failed("OpCIDMismatch")
    return State(c.rev, c.data, state.waiting), "verified", note


def verify_batch(rows: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """(seq, repo, rev, outcome, note, missing) of ``checked`` commits; ``missing`` counts record blocks that a verified
    commit lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repo, state = None, State()
        for batch in batches:
            seqs, repos, *parts = (c.to_pylist() for c in batch.columns)
            out: list[tuple] = []
            for r, *values in zip(repos, *parts, strict=True):
                if r != repo:
                    repo, state = r, State()
                c = Checked(*values)
                state, said, note = step(state, c, policy)
                out.append((said, note, c.missing if said == "verified" else 0))
            kinds = zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True) if out else ((x, k) for x, k in (((), pa.string()), ((), pa.string()), ((), pa.int64())))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(x, k) for x, k in kinds)], ["seq", "repo", "rev", "outcome", "note", "missing"])

    ordered = rows.select("seq", "repo", *FIELDS).repartition("repo").sortWithinPartitions("repo", "seq")
    return ordered.mapInArrow(run, OUTPUT)


def stateful(rows: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """The verifier on a streaming DataFrame of ``checked`` commits; the state store has the state of each repository, by
    groups of them."""

    def run(key, frames, held):
        states = {repo: State(*rest) for repo, *rest in json.loads(held.get[0])} if held.exists else {}
        batch = pd.concat(list(frames), ignore_index=True).sort_values("seq", kind="stable")
        rows = batch[["repo", *FIELDS]].astype(object)
        said = []
        for repo, *values in rows.where(rows.notna(), None).itertuples(index=False, name=None):
            c = Checked(*values)
            states[repo], outcome, note = step(states.get(repo, State()), c, policy)
            said.append((outcome, note, int(c.missing) if outcome == "verified" else 0))
        held.update((json.dumps([(repo, s.rev, s.data, s.waiting) for repo, s in states.items()]),))
        outcomes, notes, missing = zip(*said, strict=True)
        yield pd.DataFrame({"seq": batch["seq"].to_numpy(), "repo": batch["repo"].to_numpy(), "rev": batch["rev"].to_numpy(), "outcome": outcomes, "note": notes, "missing": missing})

    grouped = rows.withColumn("_group", F.pmod(F.xxhash64("repo"), F.lit(GROUPS)))
    return grouped.groupBy("_group").applyInPandasWithState(run, OUTPUT, "states string", "append", "NoTimeout")


def verify_stream(checked_rows: DataFrame, rows_a_batch: int = ROWS_A_BATCH, least: int = 3, policy: Policy = Policy()) -> DataFrame:
    """The ``checked`` commits verified as a stream of several batches, each a range of the sequence in one file, and read back.

    The ranges are written by one job. There are ``least`` at least and as many as the rows ask for, and the state store
    carries every repository from batch to batch.
    """
    spark = checked_rows.sparkSession
    sink, state = (work_dir(spark, x) for x in ("outcomes", "state"))
    rows = stored(checked_rows.select("seq", "repo", *FIELDS), "checked")
    source = ordered_files(rows, "seq", max(least, -(-rows.count() // rows_a_batch)))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = stateful(stream, policy).writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(OUTPUT).parquet(sink)


# The verifier's counters and the outcomes or notes that each counts.
COUNTERS = {
    "events_verified": ["verified"],
    "chain_breaks": ["ChainBreak"],
    "inversion_failures": ["InversionFailure"],
    "inversion_incomplete": ["incomplete"],
    "signature_failures": ["SignatureFailure"],
    "resyncs": ["resynced"],
    "resync_failures": ["resync_failed"],
    "rev_replays_dropped": ["replayed"],
    "chain_state_save_failures": ["save_failed"],
    "future_revs_rejected": ["FutureRev"],
    "field_mismatches": ["FieldMismatch"],
    "op_cid_mismatches": ["OpCIDMismatch"],
    "legacy_commits": ["legacy", "LegacyCommit"],
    "missing_record_blocks_ops": ["missing"],
    "duplicate_paths": ["DuplicatePath"],
    "oversized_commits": ["Oversized"],
    "sync_no_ops": ["unchanged"],
    "accounts_inactive": ["AccountInactive"],
    "account_event_replays_dropped": ["account_replayed"],
}


def counters(outcomes: DataFrame, *others: DataFrame) -> DataFrame:
    """(counter, n) of all counters from a verifier's rows, and from further rows (outcome, n) of syncs and accounts."""
    summed = outcomes.groupBy("outcome", "note").agg(F.count("*").alias("n"), F.sum("missing").alias("missing"))
    parts = summed.select(F.explode(F.array(F.struct(F.col("outcome").alias("said"), "n"), F.struct(F.col("note").alias("said"), "n"), F.struct(F.lit("missing").alias("said"), F.col("missing").alias("n")))).alias("p")).select("p.*")
    for other in others:
        parts = parts.unionByName(other.select(F.col("outcome").alias("said"), F.col("n").cast("long").alias("n")))
    names = outcomes.sparkSession.createDataFrame([(c, said) for c, all_ in COUNTERS.items() for said in all_], "counter string, said string")
    return names.join(parts, "said", "left").groupBy("counter").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))

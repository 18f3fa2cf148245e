"""One processor for all events of a repository: commits, syncs, accounts, forced resyncs and fetched repositories.

The events are one stream of tagged rows. A failure marks its repository as waiting; while it waits, commits that fail
go to a ring of bounded length, and its oldest makes room. When the fetched repository comes, it is applied against
what is known by then, the ring is replayed in order, and one ``resynced`` row comes out before whatever follows it:
rows are numbered by the event that caused them (``cause``) and their place among its rows (``nth``).

``act`` is the one place that decides. The batch (``process``) folds it over partitions sorted by repository and
sequence, starts from the states that an earlier run left and leaves states for the next; the stream (``stream``) keeps
the same state in the state store, from where ``kept_states`` reads it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from skeinwork.session import stored, work_dir
from skeinwork.streaming.files import ordered_files
from skeinwork.streaming.verifier import FIELDS, Checked, Policy, State, step

#: Commits that a waiting repository keeps.
RING = 2048
KINDS = ["state", "commit", "fetched", "account", "sync", "request"]
EVENT = "seq bigint, repo string, kind string, rev string, prev_data string, early string, duplicate boolean, data string, rooted boolean, legacy boolean, inverted string, field string, op_error string, missing bigint, active boolean, signed boolean, number bigint, status string, error string, held string"
OUTPUT = "cause bigint, nth int, seq bigint, repo string, kind string, rev string, outcome string, note string, missing bigint, old_rev string, held string"
_NAMES = [c.split()[0] for c in EVENT.split(", ")]
_OUT = pa.schema([("cause", pa.int64()), ("nth", pa.int32()), ("seq", pa.int64()), *((n, pa.string()) for n in ("repo", "kind", "rev", "outcome", "note")), ("missing", pa.int64()), ("old_rev", pa.string()), ("held", pa.string())])


@dataclass(frozen=True)
class Repository:
    """What is known of a repository: its chain, whether it waits and for what, its account, and the ring of commits."""

    rev: str = ""
    data: str = ""
    waiting: bool = False
    reason: str | None = None
    retried: bool = False
    active: bool = True
    status: str | None = None
    number: int | None = None  # of the newest account event
    ring: tuple[tuple, ...] = ()  # (seq, fields of Checked)

    def text(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def of(text: str) -> Repository:
        held = json.loads(text)
        return Repository(**held | {"ring": tuple((seq, tuple(values)) for seq, values in held["ring"])})


Row = tuple[int, str, str | None, str, str | None, int, str | None]  # seq, kind, rev, outcome, note, missing, old rev


def _commit(known: Repository, seq: int, c: Checked, policy: Policy, most: int) -> tuple[Repository, list[Row]]:
    state, said, note = step(State(known.rev, known.data, known.waiting), replace(c, active=known.active), policy)
    rows: list[Row] = [(seq, "commit", c.rev, said, note, c.missing if said == "verified" else 0, None)]
    reason = known.reason if known.waiting or not state.waiting else said
    ring = known.ring
    if said == "buffered":
        if len(ring) >= most:
            rows.append((ring[0][0], "commit", ring[0][1][0], "overflowed", None, 0, None))
            ring = ring[1:]
        ring += ((seq, tuple(asdict(c).values())),)
    return replace(known, rev=state.rev, data=state.data, waiting=state.waiting, reason=reason, ring=ring), rows


def _wanted(known: Repository, seq: int, kind: str, rev: str | None) -> tuple[Repository, list[Row]]:
    if known.waiting:
        return known, [(seq, kind, rev, "waiting", None, 0, None)]
    return replace(known, waiting=True, reason="sync", retried=False), [(seq, kind, rev, "resync_wanted", None, 0, None)]


def _sync(known: Repository, e: dict) -> tuple[Repository, list[Row]]:
    """Replayed, confirmed or in need of a fetch; what only confirms the known data must hold by itself."""
    seq, rev = e["seq"], e["rev"]

    def said(outcome: str, note: str | None = None) -> tuple[Repository, list[Row]]:
        return known, [(seq, "sync", rev, outcome, note, 0, None)]

    if e["early"]:
        return said(e["early"])
    if not known.active:
        return said("AccountInactive")
    if known.rev and rev <= known.rev:
        return said("replayed")
    if not known.rev or e["data"] is None or e["data"] != known.data:
        return _wanted(known, seq, "sync", rev)
    if e["field"]:
        return said("FieldMismatch", e["field"])
    if not e["signed"]:
        return said("KeyUnknown" if e["signed"] is None else "SignatureFailure")
    return replace(known, rev=rev), said("unchanged")[1]


def _refused(known: Repository, e: dict) -> str | None:
    """Why a fetched repository isn't taken."""
    if e["error"]:
        return e["error"]
    if not e["signed"]:
        return "signature"
    if e["field"]:
        return e["field"]
    if e["rev"] < known.rev or (e["rev"] == known.rev and e["data"] != known.data):
        return "regression"
    return None


def _fetched(known: Repository, e: dict, policy: Policy) -> tuple[Repository, list[Row]]:
    """The repository as it was fetched, applied to what is known by now; then the ring, whose failures are errors."""
    seq, rev = e["seq"], e["rev"]
    if not known.waiting:
        return known, [(seq, "fetched", rev, "unasked", None, 0, None)]
    idle = replace(known, waiting=False, reason=None, retried=False)
    if not known.active:
        return idle, [(seq, "fetched", rev, "resync_failed", "inactive", 0, None)]
    refused = _refused(known, e)
    if refused and e["error"] and known.reason == "sync" and not known.retried:
        return replace(known, retried=True), [(seq, "fetched", rev, "resync_retry", refused, 0, None)]
    if refused:
        return idle, [(seq, "fetched", rev, "resync_failed", refused, 0, None)]
    rows: list[Row] = [(seq, "fetched", rev, "resynced", known.reason, 0, known.rev)]
    known = replace(idle, rev=rev, data=e["data"], ring=())
    single = replace(policy, resync=False)
    for at, values in idle.ring:
        known, said = _commit(known, at, Checked(*values), single, 0)
        rows += [(*row[:1], "replay", *row[2:]) for row in said]
    return known, rows


def act(known: Repository, e: dict, policy: Policy, most: int = RING) -> tuple[Repository, list[Row]]:
    """The next state and the rows of one event, a dict with the names of ``EVENT``."""
    kind, seq = e["kind"], e["seq"]
    if kind == "state":
        return Repository.of(e["held"]), []
    if kind == "commit":
        return _commit(known, seq, Checked(*(e[n] for n in FIELDS)), policy, most)
    if kind == "sync":
        return _sync(known, e)
    if kind == "fetched":
        return _fetched(known, e, policy)
    if kind == "request":
        if not known.active:
            return known, [(seq, kind, None, "resync_failed", "inactive", 0, None)]
        return _wanted(known, seq, kind, None)
    if known.number is not None and e["number"] <= known.number:
        return known, [(seq, kind, None, "account_replayed", None, 0, None)]
    return replace(known, active=e["active"], status=e["status"], number=e["number"]), [(seq, kind, None, "account", e["status"], 0, None)]


# --- the union of events -----------------------------------------------------------------------------------


def union(commits: DataFrame | None = None, syncs: DataFrame | None = None, accounts: DataFrame | None = None, fetched: DataFrame | None = None, requests: DataFrame | None = None, states: DataFrame | None = None) -> DataFrame:
    """The events as tagged rows of ``EVENT``: ``commits`` as ``verifier.checked`` gives them; ``syncs`` (seq, repo, rev,
    data, field, signed, early); ``accounts`` (seq, repo, number, active, status); ``fetched`` (seq, repo, rev, data,
    field, signed, error); ``requests`` (seq, repo); ``states`` (repo, held) as an earlier run left them."""
    found = None
    for kind, rows in zip(KINDS, (states, commits, fetched, accounts, syncs, requests), strict=True):
        if rows is None:
            continue
        if kind == "state":
            rows = rows.select("repo", "held").withColumn("seq", F.lit(None).cast("long"))
        rows = rows.withColumn("kind", F.lit(kind))
        shaped = rows.select(*((F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in (c.split() for c in EVENT.split(", "))))
        found = shaped if found is None else found.unionAll(shaped)
    return found


# --- batch ---------------------------------------------------------------------------------------------------


def process(events: DataFrame, policy: Policy = Policy(resync=True), most: int = RING) -> tuple[DataFrame, DataFrame]:
    """The rows (``OUTPUT`` without ``held``) of all events, and the states (repo, held) after them.

    A state row comes before the events of its repository. A repository's events meet in one task, in order, and only
    its state is held there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repo, known = None, Repository()
        for batch in batches:
            out: list[dict] = []
            for e in batch.to_pylist():
                if e["repo"] != repo:
                    if repo is not None:
                        out.append({"repo": repo, "kind": "state", "held": known.text()})
                    repo, known = e["repo"], Repository()
                known, rows = act(known, e, policy, most)
                out += [dict(zip(_OUT.names, (e["seq"], nth, row[0], repo, *row[1:], None), strict=True)) for nth, row in enumerate(rows)]
            yield pa.RecordBatch.from_pylist(out, _OUT)
        if repo is not None:
            yield pa.RecordBatch.from_pylist([{"repo": repo, "kind": "state", "held": known.text()}], _OUT)

    ordered = events.where("repo IS NOT NULL").repartition("repo").sortWithinPartitions("repo", F.asc_nulls_first("seq"))
    done = stored(ordered.select(*_NAMES).mapInArrow(run, OUTPUT), "events")
    return done.where("kind <> 'state'").drop("held"), done.where("kind = 'state'").select("repo", "held")


def opened_states(states: DataFrame) -> DataFrame:
    """(repo, rev, data, waiting, reason, active, status, n_ring) of states."""
    shape = "rev string, data string, waiting boolean, reason string, active boolean, status string, ring array<string>"
    return states.select("repo", F.from_json("held", shape).alias("s")).select("repo", *(f"s.{c}" for c in ("rev", "data", "waiting", "reason", "active", "status")), F.size("s.ring").alias("n_ring"))


# --- stream --------------------------------------------------------------------------------------------------


class Events(StatefulProcessor):
    """``act`` over a repository's events: the chain as a value and the ring as a list in the state store."""

    def __init__(self, policy: Policy, most: int):
        self.policy, self.most = policy, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.chain = handle.getValueState("chain", "held string")
        self.ring = handle.getListState("ring", "seq bigint, fields string")

    def _known(self) -> Repository:
        if not self.chain.exists():
            return Repository()
        ring = tuple((int(seq), tuple(json.loads(values))) for seq, values in self.ring.get()) if self.ring.exists() else ()
        return replace(Repository.of(self.chain.get()[0]), ring=ring)

    def _keep(self, before: tuple, known: Repository) -> None:
        self.chain.update((replace(known, ring=()).text(),))
        if known.ring != before:
            if known.ring:
                self.ring.put([(seq, json.dumps(values)) for seq, values in known.ring])
            else:
                self.ring.clear()

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803  the interface's names
        for held in initialState["held"]:
            self._keep((), Repository.of(held))

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        known = self._known()
        before, out = known.ring, []
        batch = pd.concat(list(rows), ignore_index=True).sort_values("seq", kind="stable", na_position="first")
        for values in batch[_NAMES].itertuples(index=False, name=None):
            e = {n: None if v is None or v != v else v for n, v in zip(_NAMES, values, strict=True)}
            for n in ("seq", "number", "missing"):
                e[n] = None if e[n] is None else int(e[n])
            known, said = act(known, e, self.policy, self.most)
            out += [(e["seq"], nth, row[0], key[0], *row[1:]) for nth, row in enumerate(said)]
        self._keep(before, known)
        frame = pd.DataFrame(out, columns=_OUT.names[:-1])
        for n in ("cause", "nth", "seq", "missing"):
            frame[n] = frame[n].astype("int64" if n != "nth" else "int32")
        yield frame

    def close(self) -> None:
        pass


_ROWS = OUTPUT.removesuffix(", held string")


def stateful(events: DataFrame, policy: Policy = Policy(resync=True), most: int = RING, states: DataFrame | None = None) -> DataFrame:
    """The processor on a streaming DataFrame of ``EVENT`` rows; ``states`` (repo, held) are where repositories begin."""
    begin = states.groupBy("repo") if states is not None else None
    return events.groupBy("repo").transformWithStateInPandas(Events(policy, most), _ROWS, "Append", "None", begin)


def stream(events: DataFrame, policy: Policy = Policy(resync=True), most: int = RING, states: DataFrame | None = None, batches: int = 3, checkpoint: str | None = None) -> DataFrame:
    """The rows of ``EVENT`` rows taken as a stream of micro-batches, each a range of the sequence; read back at the end."""
    spark = events.sparkSession
    sink, checkpoint = work_dir(spark, "rows"), checkpoint or work_dir(spark, "state")
    source = ordered_files(events.where("repo IS NOT NULL").select(*_NAMES), "seq", batches)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(source)
        query = stateful(rows, policy, most, states).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.schema(_ROWS).parquet(sink)


def kept_states(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(repo, held) as the stream left them in its state store, rings included."""
    read = lambda name: spark.read.format("statestore").option("stateVarName", name)
    chain = read("chain").load(checkpoint).select(F.col("key.repo").alias("repo"), F.col("value.held").alias("held"))
    ring = read("ring").option("flattenCollectionTypes", "false").load(checkpoint)
    rings = ring.select(F.col("key.repo").alias("repo"), F.col("list_value").alias("ring"))
    packed = F.concat(F.lit("["), F.array_join(F.transform("ring", lambda r: F.concat(F.lit("["), r["seq"].cast("string"), F.lit(", "), r["fields"], F.lit("]"))), ", "), F.lit("]"))
    whole = F.when(F.col("ring").isNull(), F.col("held")).otherwise(F.concat(F.expr("substring(held, 1, length(held) - length('[]}'))"), packed, F.lit("}")))
    return chain.join(rings, "repo", "left").select("repo", whole.alias("held"))

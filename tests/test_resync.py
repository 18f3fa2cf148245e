"""The processor of all events: what a fetch does to a waiting repository, in batch, from run to run and as a stream."""

from dataclasses import asdict, replace

from pyspark.sql import functions as F

from skeinwork.plans import resync as plans
from skeinwork.streaming import resync
from skeinwork.streaming.resync import Repository, act
from skeinwork.streaming.verifier import Checked, Policy

SF = "/root/testdata/sf0.001"
WAITS = Policy(resync=True)
BLANK = {"seq": 0, "rev": None, "data": None, "early": None, "field": None, "signed": True, "error": None, "active": None, "number": None, "status": None, "held": None}


def rev(n: int) -> str:
    return f"3kabcdefg{'234567'[n // 30]}{'abcdefghijklmnopqrstuvwxyz234567'[n % 30]}2k"


def commit(n: int, prev: int, **changes) -> dict:
    c = Checked(rev(n), f"d{prev}", None, False, f"d{n}", True, False, f"d{prev}", None, None, 0, True, True)
    return BLANK | asdict(replace(c, **changes)) | {"kind": "commit", "seq": n}


def event(kind: str, n: int, of: int | None = None, **more) -> dict:
    return BLANK | {"kind": kind, "seq": n} | ({} if of is None else {"rev": rev(of), "data": f"d{of}"}) | more


def told(events: list[dict], most: int = 2, policy: Policy = WAITS, known: Repository = Repository()) -> tuple[list[tuple], Repository]:
    out = []
    for e in events:
        known, rows = act(known, e, policy, most)
        out += [(row[0], row[1], row[3], row[4]) for row in rows]
    return out, known


def test_failures_wait_and_are_replayed_after_the_fetch():
    said, known = told([commit(1, 0), commit(3, 2), commit(4, 3), commit(5, 4), event("fetched", 6, 3)])
    assert said == [(1, "commit", "verified", None), (3, "commit", "ChainBreak", None), (4, "commit", "buffered", None), (5, "commit", "buffered", None), (6, "fetched", "resynced", "ChainBreak"), (4, "replay", "verified", None), (5, "replay", "verified", None)]
    assert known == Repository(rev=rev(5), data="d5")


def test_the_oldest_makes_room_and_is_lost():
    said, known = told([commit(1, 0), commit(3, 2), commit(4, 3), commit(5, 4), commit(6, 5), event("fetched", 7, 3)])
    assert said[4:6] == [(6, "commit", "buffered", None), (4, "commit", "overflowed", None)]
    assert said[6:] == [(7, "fetched", "resynced", "ChainBreak"), (5, "replay", "ChainBreak", None), (6, "replay", "verified", None)]
    assert known.data == "d6" and not known.waiting


def test_a_commit_that_holds_passes_while_its_repository_waits():
    said, known = told([commit(1, 0), commit(3, 2), commit(4, 1), event("fetched", 5, 2)])
    assert [s[2] for s in said] == ["verified", "ChainBreak", "verified", "resync_failed"]  # the fetch is older by now
    assert said[-1][3] == "regression" and known.data == "d4" and not known.waiting


def test_what_was_replayed_before_is_dropped():
    said, known = told([commit(1, 0), commit(3, 2), commit(4, 3), event("fetched", 5, 4)])
    assert said[-2:] == [(5, "fetched", "resynced", "ChainBreak"), (4, "replay", "replayed", None)]
    assert known.data == "d4"


def test_fetches_that_are_refused_keep_the_ring():
    waiting = [commit(1, 0), commit(3, 2), commit(4, 3)]
    for more, note in (({"error": "timeout"}, "timeout"), ({"signed": False}, "signature"), ({"signed": None}, "signature"), ({"field": "did"}, "did")):
        said, known = told([*waiting, event("fetched", 5, 3, **more)])
        assert said[-1] == (5, "fetched", "resync_failed", note)
        assert not known.waiting and len(known.ring) == 1
    said, known = told([*waiting, event("account", 5, active=False, status="deactivated", number=5), event("fetched", 6, 3)])
    assert said[-1] == (6, "fetched", "resync_failed", "inactive")
    said, _ = told([event("fetched", 6, 3)], known=known)
    assert said == [(6, "fetched", "unasked", None)]


def test_a_sync_is_tried_once_more():
    said, known = told([commit(1, 0), event("sync", 2, 2), event("fetched", 3, 2, error="timeout"), event("fetched", 4, 2, error="timeout"), event("fetched", 5, 2)])
    assert [s[2] for s in said] == ["verified", "resync_wanted", "resync_retry", "resync_failed", "unasked"]
    assert known == Repository(rev=rev(1), data="d1")


def test_syncs_in_order_of_their_gates():
    known = Repository(rev=rev(3), data="d3")
    for e, want in (
        (event("sync", 9, 3), "replayed"),
        (event("sync", 9, 4, data="d3"), "unchanged"),
        (event("sync", 9, 4, data="d3", field="rev"), "FieldMismatch"),
        (event("sync", 9, 4, data="d3", signed=False), "SignatureFailure"),
        (event("sync", 9, 4, data="d3", signed=None), "KeyUnknown"),
        (event("sync", 9, 4, data=None), "resync_wanted"),
        (event("sync", 9, 4), "resync_wanted"),
        (event("sync", 9, 4, early="FutureRev"), "FutureRev"),
    ):
        assert told([e], known=known)[0][0][2] == want
    assert told([event("sync", 9, 4, data="d3")], known=known)[1].rev == rev(4)
    assert told([event("sync", 9, 4)], known=replace(known, active=False))[0][0][2] == "AccountInactive"
    assert told([event("request", 9)], known=known)[1].waiting
    assert told([event("request", 9)], known=replace(known, active=False))[0][0][2:] == ("resync_failed", "inactive")


def test_accounts_gate_commits_and_replays_are_dropped():
    said, known = told([event("account", 1, active=False, number=7, status="takendown"), commit(2, 0), event("account", 3, active=True, number=7), event("account", 4, active=True, number=8), commit(5, 0)])
    assert [s[2] for s in said] == ["account", "AccountInactive", "account_replayed", "account", "verified"]
    assert known.active and known.status is None


def test_a_state_survives_as_text():
    _, known = told([commit(1, 0), commit(3, 2), commit(4, 3, missing=2, signed=None)])
    assert Repository.of(known.text()) == known and len(known.ring) == 1


def states_of(df):
    return sorted((r.repo, r.held) for r in df.collect())


def test_two_runs_and_a_stream_leave_the_states_of_one_run(spark):
    events = plans._events(spark, SF)
    rows, states = resync.process(events, WAITS, 2)
    want, want_states = sorted(map(tuple, rows.collect()), key=repr), states_of(states)
    half = events.agg(F.max("seq")).first()[0] // 2
    first, left = resync.process(events.where(F.col("seq") <= half), WAITS, 2)
    later = events.where(F.col("seq") > half)
    second, end = resync.process(later.unionAll(resync.union(states=left)), WAITS, 2)
    assert sorted(map(tuple, first.unionAll(second).collect()), key=repr) == want
    assert states_of(end) == want_states
    checkpoint = resync.work_dir(spark, "state")
    streamed = resync.stream(later, WAITS, 2, states=left, batches=2, checkpoint=checkpoint)
    assert sorted(map(tuple, streamed.collect()), key=repr) == sorted(map(tuple, second.collect()), key=repr)
    kept = {repo: Repository.of(held) for repo, held in states_of(resync.kept_states(spark, checkpoint))}
    assert kept == {repo: Repository.of(held) for repo, held in want_states if repo in kept}


def test_empty_events(spark):
    rows, states = resync.process(plans._events(spark, SF).limit(0), WAITS)
    assert rows.count() == 0 and states.count() == 0


def test_null_repositories_are_left_out(spark):
    made = spark.createDataFrame([(1, None, True, 1), (2, "a", True, 2)], "seq long, repo string, active boolean, number long")
    rows, _ = resync.process(resync.union(accounts=made), WAITS)
    assert [r.repo for r in rows.collect()] == ["a"]

"""Queries over the events of all kinds of a repository: resyncs with replay, in order, from run to run and as a stream.

Every operation is a commit; some can't be inverted and some are wrongly signed. Fetched repositories come after every
sixth commit, as they were two commits before. Accounts, syncs and forced resyncs come in between. The oracle is the
same machine as a recursive query over each repository's events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skeinwork.functions.tids import tid
from skeinwork.plans.registry import query
from skeinwork.plans.views import V_OPS, sql_tid, v_ops
from skeinwork.session import stored
from skeinwork.streaming import resync
from skeinwork.streaming.verifier import Policy

START, MOST = 1_704_067_200_000_000, 2
POLICY = Policy(resync=True)


def _rev(number: Column) -> Column:
    return tid(F.lit(START) + number, F.lit(0))


def _data(seq: Column) -> Column:
    return F.concat(F.lit("d"), seq)


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = W.partitionBy("repo").orderBy("seq")
    return v_ops(spark, sf_dir).select("repo", F.col("seq").alias("s"), F.row_number().over(own).alias("n"), F.lag("seq").over(own).alias("before"), F.lag("seq", 2).over(own).alias("f"))


def _commits(marked: DataFrame) -> DataFrame:
    s, prev = F.col("s"), F.coalesce(_data(F.col("before")), F.lit(""))
    fixed = {"duplicate": F.lit(False), "rooted": F.lit(True), "legacy": F.lit(False), "missing": F.lit(0), "active": F.lit(True)}
    return marked.select("repo", (5 * s).alias("seq"), _rev(2 * s).alias("rev"), prev.alias("prev_data"), _data(s).alias("data"), F.when(s % 13 != 0, prev).alias("inverted"), (s % 29 != 0).alias("signed")).withColumns(fixed)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = stored(_marked(spark, sf_dir), "marked")
    s, n, f = F.col("s"), F.col("n"), F.col("f")
    fetched = marked.where("n % 6 = 0").select("repo", (5 * s + 1).alias("seq"), _rev(2 * f).alias("rev"), _data(f).alias("data"), (s % 5 != 0).alias("signed"), F.when(s % 7 == 0, "did").alias("field"), F.when(F.expr("(n div 6) % 4 = 3"), "timeout").alias("error"))
    accounts = marked.where("n % 17 IN (5, 9)").select("repo", (5 * s + 2).alias("seq"), (n % 17 == 9).alias("active"), F.when(n % 17 != 9, "deactivated").alias("status"), F.when(n % 4 == 0, 1).otherwise(s).alias("number"))
    syncs = marked.where("n % 11 = 7").select("repo", (5 * s + 3).alias("seq"), _rev(2 * s + 1).alias("rev"), _data(s).alias("data"), (s % 4 != 0).alias("signed"), F.when(s % 3 == 0, "rev").alias("field"))
    requests = marked.where("n % 23 = 14").select("repo", (5 * s + 4).alias("seq"))
    return resync.union(_commits(marked), syncs, accounts, fetched, requests)


_NONE = "NULL, NULL, NULL, false, NULL, NULL, NULL"
_OTHERS = f"""
  UNION ALL SELECT repo, 5 * seq + 1, 'fetched', NULL, 2 * f, f, false, seq % 5 <> 0, CASE WHEN seq % 7 = 0 THEN 'did' END, CASE WHEN (n // 6) % 4 = 3 THEN 'timeout' END, NULL, NULL FROM marked WHERE n % 6 = 0
  UNION ALL SELECT repo, 5 * seq + 2, 'account', {_NONE}, n % 17 = 9, CASE WHEN n % 4 = 0 THEN 1 ELSE seq END FROM marked WHERE n % 17 IN (5, 9)
  UNION ALL SELECT repo, 5 * seq + 3, 'sync', NULL, 2 * seq + 1, seq, false, seq % 4 <> 0, CASE WHEN seq % 3 = 0 THEN 'rev' END, NULL, NULL, NULL FROM marked WHERE n % 11 = 7
  UNION ALL SELECT repo, 5 * seq + 4, 'request', {_NONE}, NULL, NULL FROM marked WHERE n % 23 = 14"""


def _machine(waits: bool = True, others: str = _OTHERS) -> str:
    """The machine: ``z`` has a row for each event and each replayed commit, with the state after it."""
    failed = "o IN ('InversionFailure', 'ChainBreak')"
    broken = "CASE WHEN e.bad THEN 'InversionFailure' ELSE 'ChainBreak' END"
    return f"""WITH RECURSIVE {V_OPS}
, marked AS (SELECT seq, repo, row_number() OVER w AS n, lag(seq) OVER w AS before, lag(seq, 2) OVER w AS f FROM ops WINDOW w AS (PARTITION BY repo ORDER BY seq))
, evs AS (SELECT repo, 5 * seq AS pos, 'commit' AS kind, before, 2 * seq AS r, seq AS d, seq % 13 = 0 AS bad, seq % 29 <> 0 AS signed, NULL::VARCHAR AS field, NULL::VARCHAR AS error, NULL::BOOLEAN AS act, NULL::BIGINT AS number FROM marked{others})
, eve AS (SELECT *, lead(pos) OVER (PARTITION BY repo ORDER BY pos) AS nxt FROM evs)
, z AS (SELECT repo, min(pos) AS nxt, []::BIGINT[] AS q, []::BIGINT[] AS ring, 0::BIGINT AS r, 0::BIGINT AS d, false AS w, NULL::VARCHAR AS reason, false AS retried, true AS active, NULL::VARCHAR AS status, NULL::BIGINT AS number,
    NULL::BIGINT AS cause, 0 AS nth, NULL::BIGINT AS seq, NULL::VARCHAR AS kind, NULL::BIGINT AS rr, NULL::VARCHAR AS outcome, NULL::VARCHAR AS note, NULL::BIGINT AS gone, NULL::BIGINT AS old FROM evs GROUP BY repo
  UNION ALL
  SELECT repo, CASE WHEN again THEN nxt ELSE e_nxt END, CASE WHEN o = 'resynced' THEN ring WHEN again THEN q[2:] ELSE [] END,
    CASE WHEN o = 'resynced' THEN [] WHEN o = 'buffered' THEN list_append(CASE WHEN len(ring) >= {MOST} THEN ring[2:] ELSE ring END, e_pos) ELSE ring END,
    CASE WHEN o IN ('verified', 'unchanged', 'resynced') OR moved THEN e_r ELSE r END, CASE WHEN o IN ('verified', 'resynced') OR moved THEN e_d ELSE d END,
    CASE WHEN o = 'resync_wanted' OR begun THEN true WHEN ended THEN false ELSE w END, CASE WHEN o = 'resync_wanted' THEN 'sync' WHEN begun THEN o WHEN ended THEN NULL ELSE reason END,
    CASE WHEN o = 'resync_retry' THEN true WHEN o = 'resync_wanted' OR ended THEN false ELSE retried END,
    CASE WHEN o = 'account' THEN e_act ELSE active END, CASE WHEN o = 'account' THEN CASE WHEN NOT e_act THEN 'deactivated' END ELSE status END, CASE WHEN o = 'account' THEN e_number ELSE number END,
    CASE WHEN again THEN cause ELSE e_pos END, CASE WHEN again THEN nth + 1 ELSE 0 END, e_pos, CASE WHEN again THEN 'replay' ELSE e_kind END, e_r, o,
    CASE WHEN o = 'account' THEN CASE WHEN NOT e_act THEN 'deactivated' END WHEN o = 'FieldMismatch' THEN e_field WHEN o = 'resynced' THEN reason WHEN o = 'resync_retry' THEN e_error WHEN o = 'resync_failed' THEN CASE WHEN NOT active THEN 'inactive' ELSE coalesce(e_error, CASE WHEN NOT e_signed THEN 'signature' END, e_field, 'regression') END END,
    CASE WHEN o = 'buffered' AND len(ring) >= {MOST} THEN ring[1] END, CASE WHEN o = 'resynced' THEN r END
  FROM (SELECT *, e_kind = 'commit' AND NOT again AND {failed} AND {str(waits).lower()} AS begun, e_kind = 'commit' AND (again OR {str(not waits).lower()}) AND {failed} AS moved, e_kind = 'fetched' AND o IN ('resynced', 'resync_failed') AS ended FROM
    (SELECT z.*, len(z.q) > 0 AS again, e.pos AS e_pos, e.kind AS e_kind, e.r AS e_r, e.d AS e_d, e.act AS e_act, e.number AS e_number, e.nxt AS e_nxt, e.field AS e_field, e.error AS e_error, e.signed AS e_signed,
      CASE e.kind
      WHEN 'commit' THEN CASE WHEN NOT z.active THEN 'AccountInactive' WHEN z.r > 0 AND e.r <= z.r THEN 'replayed' WHEN z.r > 0 AND (e.bad OR e.before IS DISTINCT FROM z.d) THEN CASE WHEN z.w AND len(z.q) = 0 THEN 'buffered' ELSE {broken} END WHEN NOT e.signed THEN 'SignatureFailure' ELSE 'verified' END
      WHEN 'fetched' THEN CASE WHEN NOT z.w THEN 'unasked' WHEN NOT z.active THEN 'resync_failed' WHEN e.error IS NOT NULL AND z.reason = 'sync' AND NOT z.retried THEN 'resync_retry' WHEN e.error IS NOT NULL OR NOT e.signed OR e.field IS NOT NULL OR e.r < z.r OR (e.r = z.r AND e.d <> z.d) THEN 'resync_failed' ELSE 'resynced' END
      WHEN 'account' THEN CASE WHEN e.number <= z.number THEN 'account_replayed' ELSE 'account' END
      WHEN 'sync' THEN CASE WHEN NOT z.active THEN 'AccountInactive' WHEN z.r > 0 AND e.r <= z.r THEN 'replayed' WHEN z.r = 0 OR e.d <> z.d THEN CASE WHEN z.w THEN 'waiting' ELSE 'resync_wanted' END WHEN e.field IS NOT NULL THEN 'FieldMismatch' WHEN NOT e.signed THEN 'SignatureFailure' ELSE 'unchanged' END
      ELSE CASE WHEN NOT z.active THEN 'resync_failed' WHEN z.w THEN 'waiting' ELSE 'resync_wanted' END END AS o
    FROM z JOIN eve e ON e.repo = z.repo AND e.pos = CASE WHEN len(z.q) > 0 THEN z.q[1] ELSE z.nxt END)))
, said AS (SELECT cause, nth, seq, repo, kind, rr, outcome, note, old FROM z WHERE cause IS NOT NULL
  UNION ALL SELECT cause, 1, gone, repo, 'commit', 2 * (gone // 5), 'overflowed', NULL, NULL FROM z WHERE gone IS NOT NULL)"""


_TID, _OLD = sql_tid(f"({START} + rr) * 1024"), sql_tid(f"({START} + old) * 1024")
_ROWS = f"{_machine()} SELECT cause, nth, seq, repo, kind, CASE WHEN rr IS NOT NULL THEN {_TID} END AS rev, outcome, note, CASE WHEN old > 0 THEN {_OLD} WHEN old = 0 THEN '' END AS old_rev FROM said"


@query(_ROWS)
def i14_resync_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events under the resync policy: emitted, buffered, overflowed, resynced and replayed rows in their order."""
    rows, _ = resync.process(_events(spark, sf_dir), POLICY, MOST)
    return rows.drop("missing")


@query(_ROWS)
def k06_union_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows from one stream of all kinds of events, its state in the state store."""
    return resync.stream(_events(spark, sf_dir), POLICY, MOST).drop("missing")


@query(f"{_machine()}, last AS (SELECT repo, arg_max(struct_pack(r := r, d := d, w := w, reason := reason, active := active, status := status, n := len(ring)), (cause, nth)) AS s FROM z WHERE cause IS NOT NULL GROUP BY repo) SELECT repo, CASE WHEN s.r > 0 THEN {sql_tid(f'({START} + s.r) * 1024')} ELSE '' END AS rev, CASE WHEN s.d > 0 THEN 'd' || s.d ELSE '' END AS data, s.w AS waiting, s.reason AS reason, s.active AS active, s.status AS status, CAST(s.n AS INTEGER) AS n_ring FROM last")
def a26_state_between_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states after two runs over the halves of the events, the second from what the first left."""
    events = stored(_events(spark, sf_dir), "events")
    half = F.lit(events.agg(F.max("seq")).first()[0] // 2)
    _, states = resync.process(events.where(F.col("seq") <= half), POLICY, MOST)
    _, states = resync.process(events.where(F.col("seq") > half).unionAll(resync.union(states=states)), POLICY, MOST)
    return resync.opened_states(states)


@query(f"{_machine()} SELECT repo, seq, outcome, note FROM said WHERE kind = 'request' OR outcome = 'resynced'")
def i13_forced_resync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of resyncs that are asked for, and every resync that was done."""
    rows, _ = resync.process(_events(spark, sf_dir), POLICY, MOST)
    return rows.where("kind = 'request' OR outcome = 'resynced'").select("repo", "seq", "outcome", "note")


_CLASSES = {"accepted": "verified", "dropped": "replayed", "chain_breaks": "ChainBreak", "inversion_errors": "InversionFailure", "signature_failures": "SignatureFailure"}


@query(f"{_machine(False, '')}, n AS (SELECT repo, count(*) AS emitted FROM ops GROUP BY repo), c AS (SELECT repo, {', '.join(f'''count(*) FILTER (outcome = '{o}') AS {c}''' for c, o in _CLASSES.items())} FROM said GROUP BY repo) SELECT n.repo, emitted, c.* EXCLUDE (repo), emitted = {' + '.join(_CLASSES)} AS holds FROM n JOIN c ON n.repo = c.repo")
def i17_swarm_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each repository's commits where failures are errors: every one is accepted, dropped or one of the failures."""
    rows, _ = resync.process(resync.union(_commits(_marked(spark, sf_dir))), Policy(), MOST)
    said = F.col("outcome")
    counted = rows.groupBy("repo").agg(*(F.count_if(said == o).alias(c) for c, o in _CLASSES.items()))
    emitted = v_ops(spark, sf_dir).groupBy("repo").agg(F.count("*").alias("emitted"))
    total = sum((F.col(c) for c in _CLASSES), F.lit(0))
    return emitted.join(counted, "repo").withColumn("holds", F.col("emitted") == total)

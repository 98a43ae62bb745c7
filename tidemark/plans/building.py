"""Queries of the sample build: earlier sessions, evidence at decisions, samples and rejects, on the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import settled, settled_sql
from tidemark.operators import building as B
from tidemark.operators import micro as M
from tidemark.plans.microstructure import _BF, _STATES, STEP, _bars, _sessions, _states
from tidemark.registry import query
from tidemark.sources.storage import kept
from tidemark.sources.views import with_views

#: Steps of a bar.
N = 6

_PRIOR = {
    "ses": "SELECT target, session_start, max(high) AS high, min(low) AS low, arg_max(close, bar) AS close FROM bars GROUP BY ALL",
    "prior": "SELECT target, session_start, lag(high) OVER w AS prev_high, lag(low) OVER w AS prev_low, lag(close) OVER w AS prev_close, lag(session_start) OVER w AS prev_start FROM ses WINDOW w AS (PARTITION BY target ORDER BY session_start)",
}
_THRESHOLD = {
    "sess": "SELECT DISTINCT target, session_start FROM states",
    "pv": "SELECT a.target, a.session_start, list_sort(list(b.volume)) AS v FROM sess a JOIN states b ON b.target = a.target AND b.session_start < a.session_start AND b.volume > 0 GROUP BY ALL",
    "thr": "SELECT sess.*, CAST(coalesce(v[greatest(0, CAST(floor(len(v) * 0.9) AS BIGINT) - 1) + 1], 1) AS BIGINT) AS threshold FROM sess LEFT JOIN pv USING (target, session_start)",
}
_USED = {
    "cd": f"SELECT target, session_start, bar, session_start + (bar + 1) * INTERVAL {N * STEP} SECOND AS decision_at FROM bars",
    "used": """SELECT c.*, 'trade' AS feature, (SELECT max((t.exchange_ts, t.event_id)) FROM t0 t WHERE t.target = c.target AND t.session_start = c.session_start AND t.exchange_ts < c.decision_at) AS ev FROM cd c
        UNION ALL SELECT c.*, 'quote', (SELECT max((t.exchange_ts, t.event_id)) FROM q0 t WHERE t.target = c.target AND t.session_start = c.session_start AND t.exchange_ts < c.decision_at) FROM cd c""",
    "recv": "SELECT 'trade' AS feature, event_id, target, session_start, exchange_ts, received_ts FROM t0 UNION ALL SELECT 'quote', event_id, target, session_start, exchange_ts, received_ts FROM q0",
    "vl": "SELECT *, min(received_ts) OVER (PARTITION BY feature, target, session_start ORDER BY exchange_ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS valid_to FROM recv",
    "au": """SELECT u.target, u.session_start, u.bar, u.feature, u.ev[2] AS evidence_id, CASE WHEN u.ev IS NULL THEN 'ABSENT' WHEN v.event_id IS NULL THEN 'UNKNOWN' WHEN v.received_ts > decision_at THEN 'LATE' WHEN v.valid_to <= decision_at THEN 'SUPERSEDED' ELSE 'OK' END AS finding
        FROM used u LEFT JOIN vl v ON v.feature = u.feature AND v.event_id = u.ev[2] AND v.target = u.target AND v.session_start = u.session_start""",
}


def _audited(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    candidates = bars.withColumn("decision_at", F.expr(f"session_start + make_dt_interval(0, 0, 0, (bar + 1) * {N * STEP})"))
    used, valid = None, None
    for feature, events in zip(("trade", "quote"), _sessions(spark, sf_dir)):
        order = ["exchange_ts", "event_id"]
        x = events.select(*M.KEYS, "event_id", "exchange_ts", "received_ts", F.floor(M.seconds_between("exchange_ts", "session_start") / (N * STEP)).alias("bar"))
        u, v = B.used_evidence(x, candidates, feature, order), B.validity(x, M.KEYS, feature, order)
        used, valid = (u, v) if used is None else (used.unionByName(u), valid.unionByName(v))
    return B.audit_evidence(used, valid, M.KEYS)


@query(with_views(f"SELECT b.target, b.session_start, {', '.join(f'p.prev_{n}' for n in ('high', 'low', 'close'))}, p.prev_start, threshold FROM ses b JOIN prior p USING (target, session_start) JOIN thr USING (target, session_start)", "v_ticks", "v_quotes", **_BF, **_PRIOR, **_THRESHOLD))
def prior_session_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each session what is known before it: range and close of the session before, and the large size of all earlier trades."""
    return B.prior_sessions(_bars(spark, sf_dir)).join(B.prior_thresholds(_states(spark, sf_dir)), M.KEYS)


@query(with_views("SELECT target, session_start, bar, feature, evidence_id, finding FROM au", "v_ticks", "v_quotes", **_BF, **_USED))
def evidence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last trade and quote by each bar's end against the times from which and to which they were valid."""
    return _audited(spark, sf_dir, _bars(spark, sf_dir)).select(*B.CANDIDATE, "feature", "evidence_id", "finding")


_BUILD = {
    **_BF, **_PRIOR, **_THRESHOLD, **_USED,
    "fl": "SELECT target, session_start, step, CASE WHEN sum(volume) OVER w > 0 THEN sum(CASE WHEN volume >= threshold THEN volume ELSE 0 END) OVER w / sum(volume) OVER w END AS large_share FROM states JOIN thr USING (target, session_start) WINDOW w AS (PARTITION BY target, session_start ORDER BY step ROWS 9 PRECEDING)",
    "ls": f"SELECT target, session_start, step // {N} AS bar, max(step) AS last_step, arg_max(bid, step) AS b, arg_max(ask, step) AS a, arg_max(quote_fresh, step) AS fresh FROM states GROUP BY ALL",
    "qt": "SELECT target, session_start, bar, last_step, CASE WHEN fresh AND a >= b THEN b END AS bid, CASE WHEN fresh AND a >= b THEN a END AS ask FROM ls",
    "ent": "SELECT target, session_start, bar, bid, ask, greatest(0.5 * CASE WHEN atr5 > 0 THEN atr5 ELSE 1 END, 3) AS width FROM bf JOIN qt USING (target, session_start, bar) WHERE complete AND ask IS NOT NULL",
    "hz": "SELECT e.target, e.session_start, e.bar, k.k, high >= ask + width AS up, low <= bid - width AS down FROM ent e, (VALUES (1), (2), (3)) k(k), bars b WHERE b.target = e.target AND b.session_start = e.session_start AND b.bar = e.bar + k.k AND b.complete",
    "tch": "SELECT *, min(CASE WHEN up OR down THEN k END) OVER (PARTITION BY target, session_start, bar) AS first FROM hz",
    "lbl": "SELECT target, session_start, bar, coalesce(max(CASE WHEN up AND down THEN 'AMBIGUOUS' WHEN up THEN 'LONG' WHEN down THEN 'SHORT' END), 'NO_TRADE') AS label, coalesce(max(first), 3) AS outcome_at FROM tch WHERE k <= coalesce(first, 3) GROUP BY ALL HAVING count(*) = coalesce(max(first), 3)",
    "late": "SELECT target, session_start, bar, string_agg(feature, ',' ORDER BY feature) AS failures FROM au WHERE finding IN ('LATE', 'UNKNOWN') GROUP BY ALL",
    "all_": """SELECT bf.*, q.bid AS eb, q.ask AS ea, l.label AS lab, l.outcome_at AS oat, o.bid AS xb, o.ask AS xa, f.failures, large_share, prev_high, prev_close, (SELECT max(m.bar) FROM bars m WHERE m.target = bf.target AND m.session_start = bf.session_start) - bf.bar AS following
        FROM bf LEFT JOIN qt q USING (target, session_start, bar) LEFT JOIN lbl l USING (target, session_start, bar) LEFT JOIN qt o ON o.target = bf.target AND o.session_start = bf.session_start AND o.bar = bf.bar + l.outcome_at
        LEFT JOIN late f ON f.target = bf.target AND f.session_start = bf.session_start AND f.bar = bf.bar LEFT JOIN prior p ON p.target = bf.target AND p.session_start = bf.session_start LEFT JOIN fl ON fl.target = bf.target AND fl.session_start = bf.session_start AND fl.step = q.last_step""",
    "why": "SELECT *, CASE WHEN NOT complete THEN 'INCOMPLETE_DECISION_BAR' WHEN ea IS NULL THEN 'NO_ENTRY_QUOTE' WHEN failures IS NOT NULL THEN 'EVIDENCE' WHEN following < 3 THEN 'SHORT_SESSION' WHEN lab IS NULL THEN 'INCOMPLETE_HORIZON' WHEN xa IS NULL THEN 'NO_EXIT_QUOTE' END AS reason FROM all_",
}


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = kept(_states(spark, sf_dir), "states")  # seven steps below read states or bars: they are made once
    bars = kept(M.bars(states, N, F.when(F.hour("session_start") == 8, 30).otherwise(84)), "bars")
    thresholds = B.prior_thresholds(states)
    flow = M.order_flow(states.join(thresholds, M.KEYS), 10, F.col("threshold")).select(*M.KEYS, F.col("step").alias("last_step"), "large_share")
    last = B.last_states(states, N, ["bid", "ask", "quote_fresh"])
    large = last.join(flow, [*M.KEYS, "last_step"]).select(*B.CANDIDATE, "large_share")
    failures = B.audit_failures(_audited(spark, sf_dir, bars))
    x = B.build_samples(M.bar_features(bars), last, B.prior_sessions(bars), failures, 3, 0.5, 3.0, 1.0)
    return x.join(large, B.CANDIDATE, "left")


@query(with_views(f"""SELECT target, session_start, bar, reason, CASE WHEN reason = 'EVIDENCE' THEN failures END AS failures, CASE WHEN reason IS NULL THEN lab END AS label, CASE WHEN reason IS NULL THEN CAST(oat AS INTEGER) END AS outcome_at, reason IS NULL AND lab <> 'AMBIGUOUS' AS training_eligible,
    {settled_sql("CASE WHEN reason IS NULL THEN xb - ea - 1 END", 4)} AS long_net, {settled_sql("CASE WHEN reason IS NULL THEN eb - xa - 1 END", 4)} AS short_net, {settled_sql("CASE WHEN reason IS NULL THEN CASE lab WHEN 'LONG' THEN xb - ea - 1 WHEN 'SHORT' THEN eb - xa - 1 ELSE 0 END END", 4)} AS net,
    {settled_sql('large_share')} AS large_share, {settled_sql('CASE WHEN atr5 <> 0 THEN (close - prev_high) / atr5 END', 4)} AS to_prev_high, {settled_sql('CASE WHEN atr5 <> 0 THEN (close - prev_close) / atr5 END', 4)} AS to_prev_close FROM why""", "v_ticks", "v_quotes", **_BUILD))  # fmt: skip
def built_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples and rejects, one row a bar: entries and exits at real quotes, what was known of earlier sessions, evidence as received."""
    x = _samples(spark, sf_dir).withColumn("failures", F.when(F.col("reason") == "EVIDENCE", F.array_join("failures", ",")))
    nets = [settled(n, 4).alias(n) for n in ("long_net", "short_net", "net", "to_prev_high", "to_prev_close")]
    return x.select(*B.CANDIDATE, "reason", "failures", "label", "outcome_at", "training_eligible", settled("large_share").alias("large_share"), *nets)


@query(with_views("SELECT coalesce(reason, CASE lab WHEN 'AMBIGUOUS' THEN 'SAMPLE_NOT_TRAINED' ELSE 'SAMPLE' END) AS outcome, count(*) AS n FROM why GROUP BY ALL", "v_ticks", "v_quotes", **_BUILD))
def sample_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many candidates became samples, and the rest by reason."""
    kept = F.when(F.col("training_eligible"), "SAMPLE").otherwise("SAMPLE_NOT_TRAINED")
    return _samples(spark, sf_dir).groupBy(F.coalesce("reason", kept).alias("outcome")).agg(F.count("*").alias("n"))

"""The sample build against hand values: contexts, evidence, rejects by reason, schemas."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import building as B

D = dt.datetime
S1, S2 = D(2024, 1, 2, 9), D(2024, 1, 3, 9)


def test_prior_thresholds_against_sorted_lists(spark):
    rng = random.Random(4)
    rows = [(t, D(2024, 1, d, 9), i, rng.choice([0, 1, 1, 2, 3, 5, 8, 40])) for t in (1, 2) for d in range(1, 12) for i in range(rng.randint(1, 25))]
    got = {(r.target, r.session_start): r.threshold for r in B.prior_thresholds(spark.createDataFrame(rows, "target int, session_start timestamp_ntz, step int, volume long")).collect()}
    for t, s in {(r[0], r[1]) for r in rows}:
        v = sorted(r[3] for r in rows if r[0] == t and r[1] < s and r[3] > 0)
        assert got[t, s] == (v[max(0, int(len(v) * 0.9) - 1)] if v else 1)


def test_no_states_give_no_thresholds(spark):
    assert B.prior_thresholds(spark.createDataFrame([], "target int, session_start timestamp_ntz, step int, volume long")).collect() == []


def test_prior_sessions(spark):
    rows = [(1, S1, 0, 5.0, 3.0, 4.0), (1, S1, 1, 9.0, 8.0, None), (1, S2, 0, 7.0, 6.0, 6.5), (2, S2, 0, 1.0, 1.0, 1.0)]
    got = B.prior_sessions(spark.createDataFrame(rows, "target int, session_start timestamp_ntz, bar int, high double, low double, close double"))
    assert {(r.target, r.session_start): (r.prev_high, r.prev_low, r.prev_close, r.prev_start) for r in got.collect()} == {(1, S1): (None,) * 4, (1, S2): (9.0, 3.0, 4.0, S1), (2, S2): (None,) * 4}


def test_audit_of_evidence(spark):
    at = lambda m: S1 + dt.timedelta(minutes=m)
    # event 1 is seen at 1, 2 at 12 (after the first decision), 3 overtakes 2 at 11
    events = spark.createDataFrame([(1, S1, 0, 1, at(0), at(1)), (1, S1, 0, 2, at(8), at(12)), (1, S1, 1, 3, at(11), at(11)), (1, S1, 3, 4, at(31), at(31))], "target int, session_start timestamp_ntz, bar int, event_id long, exchange_ts timestamp_ntz, received_ts timestamp_ntz")
    candidates = spark.createDataFrame([(1, S1, b, at(10 * (b + 1))) for b in range(4)] + [(2, S1, 0, at(10))], "target int, session_start timestamp_ntz, bar int, decision_at timestamp_ntz")
    used = B.used_evidence(events, candidates, "quote", ["exchange_ts", "event_id"])
    valid = B.validity(events, ["target", "session_start"], "quote", ["exchange_ts", "event_id"])
    assert {r.evidence_id: r.valid_to for r in valid.collect()} == {1: at(11), 2: at(11), 3: at(31), 4: None}
    audited = B.audit_evidence(used, valid, ["target", "session_start"])
    assert {(r.target, r.bar): (r.evidence_id, r.finding) for r in audited.collect()} == {(1, 0): (2, "LATE"), (1, 1): (3, "OK"), (1, 2): (3, "OK"), (1, 3): (4, "OK"), (2, 0): (None, "ABSENT")}
    old = used.withColumn("evidence_id", F.when(F.col("bar") == 0, 9).when(F.col("evidence_id").isNotNull(), 1))
    checked = B.audit_evidence(old, valid, ["target", "session_start"])
    assert {(r.target, r.bar): r.finding for r in checked.collect()} == {(1, 0): "UNKNOWN" , (1, 1): "SUPERSEDED", (1, 2): "SUPERSEDED", (1, 3): "SUPERSEDED", (2, 0): "UNKNOWN"}
    assert [(r.bar, r.failures) for r in B.audit_failures(audited).collect()] == [(0, ["quote"])]


def _build(spark, bars, last, failures=(), horizon=2):
    b = spark.createDataFrame(bars, "target int, session_start timestamp_ntz, bar int, complete boolean, close double, high double, low double, atr5 double")
    q = spark.createDataFrame(last, "target int, session_start timestamp_ntz, bar int, bid double, ask double, quote_fresh boolean")
    c = spark.createDataFrame([(1, S1, 110.0, 90.0, 100.0)], "target int, session_start timestamp_ntz, prev_high double, prev_low double, prev_close double")
    f = spark.createDataFrame(list(failures), "target int, session_start timestamp_ntz, bar int, failures array<string>")
    return {r.bar: r for r in B.build_samples(b, q, c, f, horizon, 1.0, 2.0, 0.5).collect()}


def test_samples_and_rejects_are_the_candidates(spark):
    # bar: complete, high, low; quotes are 99/101 but for those given
    shape = {0: (True, 100, 100), 1: (True, 103, 100), 2: (True, 100, 100), 3: (True, 104, 96), 4: (False, 100, 100), 5: (True, 100, 100), 6: (True, 100, 100), 7: (True, 100, 100), 8: (True, 100, 100), 9: (True, 100, 100), 10: (True, 103, 100), 11: (True, 100, 100)}
    bars = [(1, S1, k, ok, 100.0, float(h), float(lo), 2.0 if k else None) for k, (ok, h, lo) in shape.items()]
    quotes = {k: (99.0, 101.0, True) for k in shape} | {5: (99.0, 101.0, False), 6: (101.0, 99.0, True), 10: (None, None, False)}
    got = _build(spark, bars, [(1, S1, k, *q) for k, q in quotes.items()], [(1, S1, 7, ["quote"])])
    assert {k: r.reason for k, r in got.items()} == {
        0: None, 1: None, 2: None, 3: "INCOMPLETE_HORIZON", 4: "INCOMPLETE_DECISION_BAR", 5: "NO_ENTRY_QUOTE", 6: "NO_ENTRY_QUOTE", 7: "EVIDENCE", 8: "NO_EXIT_QUOTE", 9: "NO_EXIT_QUOTE", 10: "NO_ENTRY_QUOTE", 11: "SHORT_SESSION",
    }
    first = got[0]  # the range is unknown, so the minimum holds: barriers at 103 and 97, the first is reached at bar 1
    assert (first.label, first.outcome_at, first.upper, first.lower, first.long_net, first.short_net, first.net, first.training_eligible) == ("LONG", 1, 103.0, 97.0, -2.5, -2.5, -2.5, True)
    assert (got[1].label, got[1].outcome_at, got[1].training_eligible) == ("AMBIGUOUS", 2, False)
    assert (got[2].label, got[2].net, got[2].to_prev_high, got[2].to_prev_close) == ("AMBIGUOUS", 0.0, -5.0, 0.0)
    assert got[8].label is None and got[8].net is None and not got[8].training_eligible


def test_build_of_nothing(spark):
    assert _build(spark, [], []) == {}


def test_feature_schemas(spark):
    full, hist, less = (B.feature_schema(k) for k in B.SCHEMAS)
    assert [len(s["primary"]) for s in (full, hist, less)] == [40, 35, 35]
    assert [len(s["formal"]) for s in (full, hist, less)] == [29, 25, 23]
    assert [len(s["missing"]) for s in (full, hist, less)] == [6, 4, 10]
    assert "basis_pct" in full["formal"] and "basis_pct" not in hist["formal"] and "large_trade_ratio" not in less["formal"]
    row = spark.createDataFrame([(1, *[None if n == "atr_5m" else 1.0 for n in hist["primary"]])], "id int, " + ", ".join(f"{n} double" for n in hist["primary"]))
    out = B.with_schema(row, "historical", ["id"]).first()
    assert out.atr_missing == 1.0 and out.quote_missing == 0.0 and len(out) == 1 + 25 + 4
    with pytest.raises(ValueError, match="basis_points"):
        B.with_schema(row, "full", ["id"])
    with pytest.raises(ValueError):
        B.feature_schema("none")

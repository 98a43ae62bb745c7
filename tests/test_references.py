"""Hand values of gates, calendars, judgement checks and fact tables."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import calendars, facts, rules

NAN, INF = float("nan"), float("inf")


def test_numbers_that_are_not_finite_are_zero_in_gates(spark):
    good = {"volume_ratio": 2.0, "turnover_ratio": 2.0, "day_return": 3.0, "close_position": 0.9, "amount": 60e6, "atr_pct": 4.5, "study_score": 300.0, "hot_score": 260.0}

    def of(**changed):
        df = spark.range(1).select(*[F.lit(v).cast("double").alias(k) for k, v in (good | changed).items()], F.lit("7").alias("industry"))
        return df.select(rules.hot_gate().alias("gate"), rules.hot_score().alias("score"), rules.edge_pct().alias("edge")).first()

    assert of().gate == "hot"
    for bad in (NAN, INF, -INF, None):
        zero, got = of(volume_ratio=0.0), of(volume_ratio=bad)
        assert tuple(got) == tuple(zero) and got.gate == "insufficient-heat"
        assert of(amount=bad).score == of(amount=0.0).score
        assert of(atr_pct=bad).gate == "insufficient-heat"  # an unknown range is too wide


def test_the_half_day_ends_a_minute_late_at_most(spark):
    t = lambda d, h, m=0, s=0, us=0: dt.datetime(2024, 3, d, h, m, s, us)
    rows = [(dt.date(2024, 3, d), t(d, 9), last) for d, last in ((18, t(18, 13, 30, 40)), (19, t(19, 13, 31)), (20, t(20, 13, 31, 0, 1)), (21, t(21, 8)))]
    df = spark.createDataFrame(rows, "segment_day date, first_ts timestamp_ntz, last_ts timestamp_ntz")
    assert [(r.day_close, r.is_expiry) for r in calendars.build_calendar(df).orderBy("trading_date").collect()] == [("13:30", False), ("13:30", False), ("13:45", True), ("13:30", False)]
    with pytest.raises(ValueError, match="multiple contract aliases"):
        calendars.build_calendar(df.withColumn("alias", F.date_format("segment_day", "dd")))


def test_minute_files_begin_their_own_night(spark):
    t = lambda d, h, m=0: dt.datetime(2024, 3, d, h, m)
    # Thursday with a head, Friday with the tail of it and a head, Saturday a tail only, Monday a day only
    rows = [(7, t(7, 8, 45), t(7, 23, 59)), (8, t(8, 0), t(8, 23, 59)), (9, t(9, 0), t(9, 5)), (11, t(11, 8, 45), t(11, 13, 45))]
    df = spark.createDataFrame([(dt.date(2024, 3, d), a, b) for d, a, b in rows], "segment_day date, first_ts timestamp_ntz, last_ts timestamp_ntz")
    got = {(str(r.trading_date), str(r.night_start), r.nights) for r in calendars.build_calendar(df, minute_files=True).collect()}
    assert got == {("2024-03-07", "None", 0), ("2024-03-08", "2024-03-07", 1), ("2024-03-11", "2024-03-08", 1)}
    # a tail whose night has no beginning in the files belongs to the day before
    alone = df.where("segment_day >= '2024-03-09'")
    assert {str(r.night_start) for r in calendars.build_calendar(alone, minute_files=True).collect()} == {"2024-03-08"}


JUDGED = (
    "id int, diagnosed boolean, decided boolean, regime string, alternative_regime string, direction string, gate_result string, confidence double, "
    "trace array<struct<node: string, branch: string, facts: array<string>>>, stance string, active_entry double, patient_entry double, take_profit double, stop_loss double"
)
TRACE = [("D1", "ok", ["F1"]), ("D2", "tight_channel", ["F1"]), ("D3", "bullish", ["F1"]), ("D4", "ok", ["F2"])]
GOOD = dict(diagnosed=True, decided=True, regime="tight_channel", alternative_regime=None, direction="bullish", gate_result="proceed", confidence=70.0, trace=TRACE, stance="enter", active_entry=100.0, patient_entry=99.0, take_profit=103.0, stop_loss=98.0)


def found(spark, cited=(("F1", 100.0),), **changed):
    row = {"id": 1} | GOOD | changed
    j = spark.createDataFrame([tuple(row.values())], JUDGED)
    c = spark.createDataFrame([(1, *x) for x in cited], "id int, fact_id string, value double")
    f = spark.createDataFrame([(1, "F1", 100.0), (1, "F2", 101.0)], "id int, fact_id string, fact double")
    return sorted(r.code for r in rules.judgement_errors(j, c, f, "id").collect())


@pytest.mark.parametrize(
    ("changed", "codes"),
    [
        ({}, []),
        ({"diagnosed": False}, ["BAD_SHAPE"]),
        ({"alternative_regime": "sideways"}, ["BAD_ENUM"]),
        ({"regime": "spike", "alternative_regime": "tight_channel"}, []),
        ({"regime": "spike", "alternative_regime": "normal_channel"}, ["TRACE_CONFLICT"]),
        ({"direction": "neutral"}, ["TRACE_CONFLICT"]),
        ({"trace": [*TRACE[:3], ("D4", "ok", [])]}, ["NO_EVIDENCE"]),
        ({"trace": [*TRACE[:3], ("D4", "ok", None)]}, ["NO_EVIDENCE"]),
        ({"trace": [*TRACE[:3], ("D4", "ok", ["F1", "F9"])]}, ["UNKNOWN_FACT"]),
        ({"trace": TRACE[:3]}, ["MISSING_NODE"]),
        ({"trace": []}, ["BAD_SHAPE", *["MISSING_NODE"] * 4]),
        ({"confidence": 70.5}, ["BAD_TYPE"]),
        ({"gate_result": "wait"}, ["GATE_VIOLATION"] * 3),
        ({"decided": False, "gate_result": "wait"}, []),
        ({"stop_loss": 101.0}, ["PRICE_ORDER"]),
        ({"take_profit": 101.0}, ["RR_TOO_LOW"]),
        ({"take_profit": 120.0}, ["UNANCHORED_PRICE"]),
        ({"cited": (("F1", 100.6),)}, ["FACT_VALUE_MISMATCH"]),
        ({"cited": (("F7", 100.0),)}, ["UNKNOWN_FACT"]),
    ],
)
def test_judgements(spark, changed, codes):
    assert found(spark, **changed) == codes


def test_categories(spark):
    codes = ["BAD_TYPE", "NO_EVIDENCE", "TRACE_CONFLICT", "FORBIDDEN_CONTENT", "UNANCHORED_PRICE", "NEVER_HEARD_OF"]
    got = rules.counts_by_category(spark.createDataFrame([(x,) for x in codes], "code string"))
    assert {(r.category, r.n) for r in got.collect()} == {("schema", 2), ("missing", 1), ("inconsistency", 2), ("untraceable", 1)}


def test_fact_ids_hold_their_places(spark):
    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(i)
    rows = [("t", day(i), 100.0 + i, 102.0 + i, 99.0 + i, 101.0 + i, 1000.0 + i) for i in range(61)]
    df = spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, turnover double")
    got = {}
    for r in facts.fact_table(facts.market_facts(df)).collect():
        got.setdefault(r.date, {})[r.fact_id] = (r.key, r.value if r.text is None else r.text)
    assert got[day(0)] == {"F1": ("insufficient", 1.0)} and got[day(23)] == {"F1": ("insufficient", 24.0)}
    early, late = got[day(24)], got[day(60)]
    assert len(early) == 20 and len(late) == 22
    assert late["F1"] == ("close", 161.0) and late["F2"] == ("prevClose", 160.0) and late["F3"] == ("changePct", 0.63)
    assert late["F8"] == ("closeVsMa20", "above") and late["F9"] == ("closeVsMa60", "above") and late["F11"] == ("avgTurnover20", 1050.5)
    assert early["F7"] == ("closeVsMa20", "above") and early["F8"] == ("turnover", 1024.0) and early["F12"] == ("swingHigh60", 126.0)
    assert late["F14"] == ("swingHigh60", 162.0) and late["F15"] == ("swingLow60", 100.0) and late["F16"] == ("retracementPct", 98.39)
    assert late["F18"] == ("trendBarRun", 61.0) and late["F19"] == ("trendBarRunDirection", "up")
    bars = json.loads(late["F22"][1])
    assert [b["date"] for b in bars] == [str(day(i)) for i in range(56, 61)] and bars[-1] == {"date": str(day(60)), "dir": "up", "bodyRatio": 0.33, "upperWickRatio": 0.33, "lowerWickRatio": 0.33}

"""Regimes against a plain walk, and hand values of rules, calendars and streams."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark.operators import calendars, evaluation, facts, rules, samples

from .test_operators import one


def walk(bars):
    """Pullback depth and regime of the last bar of a list of (open, high, low, close)."""
    closes = [b[3] for b in bars[-20:]]
    pivots, way, top = [closes[0]], 0, closes[0]
    for x in closes[1:]:
        far = abs(x - top) / top * 100 >= 0.5
        if not way:
            if far:
                way, top = (1 if x > top else -1), x
        elif (x > top) if way > 0 else (x < top):
            top = x
        elif far:
            pivots.append(top)
            way, top = -way, x
    legs = [b - a for a, b in zip(pivots, [*pivots[1:], top], strict=True) if b != a]
    up = closes[-1] >= closes[0]
    ratios = [abs(b) / abs(a) * 100 for a, b in zip(legs, legs[1:], strict=False) if (b < 0) == up and (a < 0) != up]
    depth = None if len(closes) < 3 or not legs else sorted(ratios[-3:])[len(ratios[-3:]) // 2] if ratios else 0.0
    if len(bars) < 25:
        return depth, "insufficient_data"

    def side(b):
        return 0 if b[1] <= b[2] or abs(b[3] - b[0]) / (b[1] - b[2]) < 0.1 else 1 if b[3] > b[0] else -1

    run = 0
    for b in reversed(bars[-5:]):
        if not side(b) or side(b) != side(bars[-1]):
            break
        run += 1
    last = bars[-run:] if run else []
    overlaps = []
    for a, b in zip(last, last[1:], strict=False):
        (at, ab), (bt, bb) = [(max(x[0], x[3]), min(x[0], x[3])) for x in (a, b)]
        least = min(at - ab, bt - bb)
        overlaps.append(max(0, min(at, bt) - max(ab, bb)) / least if least > 0 else 0)
    mean = lambda v: sum(v) / len(v) if v else 0
    if run >= 3 and mean(overlaps) < 0.3 and mean([abs(b[3] - b[0]) / (b[1] - b[2]) for b in last]) > 0.5:
        return depth, "spike"
    ma5, ma20 = mean([b[3] for b in bars[-5:]]), mean([b[3] for b in bars[-20:]])
    trending = depth is not None and (bars[-1][3] >= ma20 if ma5 >= ma20 else bars[-1][3] <= ma20)
    return depth, "tight_channel" if trending and depth < 30 else "normal_channel" if trending and depth <= 50 else "trading_range"


def test_regimes_against_a_plain_walk(spark):
    rng, rows, per = random.Random(5), [], {}
    for ticker in range(4):
        price = 100.0
        for i in range(90):
            start = price
            price *= 1 + rng.gauss(0.004 if i % 40 < 12 else -0.001, 0.012)
            bar = (start, max(start, price) * (1 + rng.random() * 0.004), min(start, price) * (1 - rng.random() * 0.004), price)
            per.setdefault(ticker, []).append(bar)
            rows.append((ticker, dt.date(2024, 1, 1) + dt.timedelta(i), *bar, 1e6))
    df = spark.createDataFrame(rows, "ticker int, date date, open double, high double, low double, close double, turnover double").repartition(3)
    seen = set()
    for r in facts.regimes(facts.market_facts(df)).select("ticker", "date", "pullback_pct", "regime", "confidence").collect():
        depth, regime = walk(per[r.ticker][: (r.date - dt.date(2024, 1, 1)).days + 1])
        assert r.regime == regime and (depth is None) == (r.pullback_pct is None) and (depth is None or abs(depth - r.pullback_pct) < 1e-6) and 10 <= r.confidence <= 95
        seen.add(regime)
    assert len(seen) >= 4


def test_contract_months_and_third_wednesdays(spark):
    days = spark.createDataFrame([("2024-08-21",), ("2024-08-22",), ("2024-12-31",)], "d string").select(F.to_date("d").alias("d"))
    code, expiry = calendars.near_contract("d", "TMF")
    got = [(r.c, str(r.e)) for r in days.select("d", code.alias("c"), expiry.alias("e")).orderBy("d").collect()]
    assert got == [("TMF202408", "2024-08-21"), ("TMF202409", "2024-09-18"), ("TMF202501", "2025-01-15")]


def test_calendar_joins_nights_to_the_next_date(spark):
    t = lambda d, h, m=0: dt.datetime(2024, 3, d, h, m)
    rows = [(dt.date(2024, 3, 7), t(6, 15), t(7, 13, 45)), (dt.date(2024, 3, 8), t(8, 0), t(8, 13, 30)), (dt.date(2024, 3, 11), t(8, 15), t(11, 13, 44)), (dt.date(2024, 3, 12), t(11, 15), t(12, 4))]
    x = calendars.build_calendar(spark.createDataFrame(rows, "segment_day date, first_ts timestamp_ntz, last_ts timestamp_ntz"))
    got = {(str(r.trading_date), r.day_close, str(r.night_start), r.nights) for r in x.collect()}
    assert got == {("2024-03-07", "13:45", "2024-03-06", 1), ("2024-03-08", "13:30", "2024-03-07", 1), ("2024-03-11", "13:45", "2024-03-08", 1), ("None", None, "2024-03-11", 1)}


def test_hot_and_cost_gates(spark):
    row = {"volume_ratio": 2.0, "turnover_ratio": 2.0, "day_return": 3.0, "close_position": 0.9, "amount": 60e6, "atr_pct": 4.5, "study_score": 300.0}
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in row.items()], F.lit("7").alias("industry"))
    x = rules.cost_gate(df.withColumn("gate", rules.hot_gate()).withColumn("hot_score", rules.hot_score())).first()
    assert (x.gate, x.hot_score, x.cost_pct, x.required_pct) == ("hot", 259.8, 0.585, 1.755) and abs(x.edge_pct - 2.459) < 2e-3 and x.pays and x.size_multiplier == 0.72
    assert df.withColumn("industry", F.lit(17)).select(rules.hot_gate().alias("g")).first().g == "excluded-industry"
    assert one(spark, b=rules.slot_budget(F.lit(1000.0), F.lit(1800.0), F.lit(3), F.lit(1), F.lit(0.72))).b == 360


def test_fold_sizes():
    assert evaluation.fold_sizes(100, 5) == (12, 6, 40) and evaluation.fold_sizes(17, 5) is None


def test_conflicting_minutes_and_clipped_buckets(spark):
    s, e = dt.datetime(2024, 1, 2, 8, 45), dt.datetime(2024, 1, 2, 9, 10)
    m = lambda k: s + dt.timedelta(minutes=k)
    rows = [(1, s, e, m(0), 1.0, 2.0, 1.0, 2.0, 5), (1, s, e, m(0), 1.0, 2.0, 1.0, 2.0, 5), (1, s, e, m(3), 2.0, 4.0, 2.0, 3.0, 1), (1, s, e, m(3), 2.0, 4.0, 2.0, 9.0, 1), (1, s, e, m(16), 1.0, 1.0, 1.0, 1.0, 1)]
    df = spark.createDataFrame(rows, "target int, session_start timestamp_ntz, session_end timestamp_ntz, minute timestamp_ntz, open double, high double, low double, close double, volume long")
    got = samples.bars_of_minutes(df, [15]).collect()
    assert [(r.bucket, r.open, r.high, r.minutes, r.conflict) for r in got] == [(0, 1.0, 4.0, 2, True)]

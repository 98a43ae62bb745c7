"""Hand values, limits, leakage and order independence of the market operators."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import book, daily, micro, signals, validation
from tidemark.sources import storage


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def bars(spark, closes, ticker=1):
    day = dt.date(2024, 1, 1)
    rows = [(ticker, day + dt.timedelta(i), float(c), float(c) + 1, float(c) - 1, float(c), 100.0 + i, 1e8) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "ticker int, date date, open double, high double, low double, close double, volume double, turnover double")


def test_scalars(spark):
    r = one(
        spark, a=S.half_up(F.lit(-2.5), 0), b=S.half_up(F.lit(2.5), 0), c=S.clamp(F.lit(7.0), 0, 5), d=S.pct_change(F.lit(3.0), F.lit(0.0)), e=S.finite_or_null(F.lit(" ")), f=S.finite_or_null(F.lit("1.5")),
        g=S.number_of(F.lit("x"), F.lit("1,234.5")), h=S.is_date(F.lit("2024-02-30")), i=S.is_date(F.lit("2024-02-29")), j=S.compact_number(F.lit(1234567.0)), k=S.microprice(F.lit(99.0), F.lit(1.0), F.lit(101.0), F.lit(3.0)),
        l=S.finite_or_null(F.lit("NaN")),
    )
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g, r.h, r.i, r.j, r.k, r.l) == (-2.0, 3.0, 5.0, None, None, 1.5, 1234.5, False, True, "1.23M", 99.5, None)


def test_wma_and_hull(spark):
    got = [r.w for r in bars(spark, [1, 2, 3, 4]).select(daily.wma("close", 3).alias("w"), "date").orderBy("date").collect()]
    assert got[:2] == [None, None] and abs(got[2] - 14 / 6) < 1e-12 and abs(got[3] - 20 / 6) < 1e-12


def test_gate_limits_pass(spark):
    cols = {"hma9_slope": 0.1, "hma20_slope": 0.0, "close_to_hma9": 6.0, "avg_turnover": 2e7, "momentum5": 18.0, "close_position": 0.72}
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])
    assert df.select(daily.gate_reasons().alias("r")).first().r == []
    worse = df.withColumn("momentum5", F.lit(18.01)).withColumn("hma9_slope", F.lit(0.0)).withColumn("avg_turnover", F.lit(None).cast("double"))
    assert worse.select(daily.gate_reasons().alias("r")).first().r == ["missing_avg_turnover", "hma9_not_rising", "momentum_too_high"]


def test_features_ignore_the_future_and_row_order(spark):
    closes = [random.Random(4).uniform(50, 60) for _ in range(60)]
    whole = daily.features(bars(spark, closes))
    changed = daily.features(bars(spark, closes[:50] + [1e6] * 10).orderBy(F.rand(3)))
    cut = F.col("date") < F.lit(dt.date(2024, 1, 1) + dt.timedelta(50))
    assert sorted(map(str, whole.where(cut).collect())) == sorted(map(str, changed.where(cut).collect()))


def ts(second, micros=0):
    return dt.datetime(2024, 1, 2, 9, 0, second, micros)


def test_two_clock_asof(spark):
    kind = "event_id long, target long, exchange_ts timestamp_ntz, received_ts timestamp_ntz"
    ticks = spark.createDataFrame([(1, 1, ts(10), ts(10)), (2, 1, ts(20), ts(20)), (3, 2, ts(5), ts(5)), (4, 3, ts(1), ts(1))], kind)
    quotes = spark.createDataFrame([(11, 1, ts(9), ts(12)), (12, 1, ts(8), ts(9)), (13, 1, ts(10), ts(30)), (14, 1, ts(15), ts(15)), (15, 1, ts(15), ts(16)), (16, 2, ts(6), ts(6))], kind)
    got = {r.event_id: (r.quote_id, r.status) for r in micro.asof_quotes(ticks, quotes, ["target"], 5.0).collect()}
    assert got == {1: (12, "OK"), 2: (15, "OK"), 3: (None, "MISSING"), 4: (None, "MISSING")}
    assert {r.status for r in micro.asof_quotes(ticks.where("event_id = 2"), quotes, ["target"], 4.999999).collect()} == {"STALE"}


def test_session_edges(spark):
    cal = micro.weekday_calendar(spark, "2024-01-05", "2024-01-08")
    rows = [(dt.datetime(2024, 1, 5, 8, 45),), (dt.datetime(2024, 1, 5, 13, 45),), (dt.datetime(2024, 1, 6, 4, 59),), (dt.datetime(2024, 1, 6, 5, 0),)]
    x = micro.resolve_sessions(spark.createDataFrame(rows, "exchange_ts timestamp_ntz"), cal).orderBy("exchange_ts")
    assert [(r.session, str(r.trading_date)) for r in x.collect()] == [("DAY", "2024-01-05"), ("CLOSED", "None"), ("NIGHT", "2024-01-08"), ("CLOSED", "None")]


def test_ema_starts_at_the_first_value(spark):
    df = spark.createDataFrame([(1, 1, 10.0), (1, 2, 20.0), (1, 3, 20.0)], "k int, i int, v double")
    assert [r.e for r in micro.ema(df, "v", 3, ["k"], "i", "e").orderBy("i").collect()] == [10.0, 15.0, 17.5]


def test_triple_barrier_hand_values(spark):
    start = dt.datetime(2024, 1, 1, 8, 45)
    b = spark.createDataFrame([(1, start, i, h, lo, True) for i, (h, lo) in enumerate([(100.0, 99.0), (101.0, 99.5), (104.0, 99.0), (110.0, 80.0)])], "target int, session_start timestamp_ntz, bar long, high double, low double, complete boolean")
    e = spark.createDataFrame([(1, start, 0, 99.5, 100.5, 1.0), (1, start, 2, 99.5, 100.5, 1.0)], "target int, session_start timestamp_ntz, bar long, bid double, ask double, atr double")
    got = {r.bar: (r.label, r.touch_at, r.mfe) for r in micro.triple_barrier(e, b, 2, 1.0, 3.0).collect()}
    assert got == {0: ("LONG", 2, 3.5)} | {2: ("AMBIGUOUS", 1, 9.5)}


def test_one_position_blocks(spark):
    df = spark.createDataFrame([(1, t, f"s{t}") for t in (0, 5, 10, 12, 25)], "k int, t long, s string")
    assert [r.t for r in signals.one_position(df, ["k"], "t", 10).orderBy("t").collect()] == [0, 10, 25]


def test_pairing_uses_an_original_once(spark):
    early = spark.createDataFrame([(1, 0, 5.0), (1, 1, 5.0), (1, 2, 6.0)], "k int, t long, v double")
    late = spark.createDataFrame([(1, 3, 5.0)], "k int, t long, v double")
    assert [r.lead for r in signals.pair_leads(early, late, ["k"], "t", "v").orderBy("t").collect()] == [3.0, None, None]


def test_drawdown_rule_buys_in_tranches_the_day_after(spark):
    # 80 is -20 %, so 78 buys; 74 is below -25 %, so 72 buys; 96 resets; 81 is 15.6 % under 96 and leaves
    b = bars(spark, [100, 80, 78, 74, 72, 96, 81])
    r = signals.drawdown_rule(b, ["ticker"], "date", 252).first()
    assert (r.trades, r.wins, r.open_units) == (1, 1, 0) and abs(r.sum_return - (2 * 81 / (78 + 72) - 1)) < 1e-9
    # no entry again before the event has ended
    r = signals.drawdown_rule(bars(spark, [100, 80, 80, 60, 60, 60]), ["ticker"], "date", 252).first()
    assert (r.trades, r.open_units) == (1, 0)


def test_pullback_is_of_the_leg_before(spark):
    z = signals.swing_depth(bars(spark, [100, 110, 105, 120, 114, 130]), ["ticker"], "date").first()
    assert z.pullbacks == 2 and abs(z.pullback_pct - 50) < 1e-9
    assert signals.swing_depth(bars(spark, [100, 101, 102]), ["ticker"], "date").first().pullback_pct == 0
    assert signals.swing_depth(bars(spark, [100, 101]), ["ticker"], "date").first().pullback_pct is None


def test_book_confidence_values(spark):
    df = spark.createDataFrame([("a", 0.5), ("a", 0.5), ("a", 0.5), ("b", -0.04), ("b", -0.5), ("c", 0.9), ("d", -0.2), ("d", -0.4)], "k string, pressure double")
    got = {r.k: (r.score, r.persistence, r.label, r.adjustment, r.reliability) for r in book.confidence(df, ["k"]).collect()}
    assert got == {"a": (80.0, 1, "strong_buy_pressure", 8, "high"), "b": (39.0, 0, "sell_pressure", -2, "medium"), "c": (86.0, 0, "strong_buy_pressure", 8, "low"), "d": (28.0, -1, "strong_sell_pressure", -5, "medium")}


def test_reference_prices_weigh_levels(spark):
    level = "array<struct<price:double,volume:double,diff:double>>"
    bids, asks = [(99.0, 2.0, 0.0), (98.0, 3.0, 0.0), (97.0, 3.0, 0.0)], [(101.0, 1.0, 0.0), (102.0, 9.0, 0.0)]
    checked = spark.createDataFrame([("a", 1, None, bids, asks)], f"k string, t int, problem string, bids {level}, asks {level}")
    scored = spark.createDataFrame([("a", 70.0)], "k string, score double")
    r = book.reference_prices(checked, scored, ["k"], "t").first()
    # weighted bid volumes 10, 12, 9: the second; ask volumes 5, 36
    assert (r.active_entry, r.patient_entry, r.take_profit, r.stop_loss, r.stop_reliability) == (101.0, 98.0, 101.0, 97.0, "normal")


def test_preopen_states(spark):
    r = one(
        spark, a=book.auction_state(F.lit(100.0), F.lit(101.5), F.lit(99.0)), b=book.auction_state(F.lit(100.0), F.lit(98.0), F.lit(98.0)), c=book.auction_state(F.lit(100.0), F.lit(98.0), F.lit(97.0)), d=book.auction_state(F.lit(100.0), F.lit(100.5), F.lit(97.0)),
        e=book.auction_state(F.lit(100.0), F.lit(None).cast("double"), F.lit(97.0)), f=book.basis_view(F.lit(-150.0), F.lit(7)), g=book.basis_view(F.lit(-301.0), F.lit(7)), h=book.basis_view(F.lit(-150.0), F.lit(3)), i=book.currency_view(F.lit(-0.1)),
        j=book.relative_strength(book.moves_of(F.lit("dow=1.5, nasdaq = 0.2")), F.lit("neutral")), k=book.relative_strength(book.moves_of(F.lit("dow=-1.5,x=-1")), F.lit("neutral")), l=book.relative_strength(book.moves_of(F.lit("")), F.lit("neutral")),
        m=book.preopen_environment(F.lit("bullish"), F.lit("bullish"), F.lit("aligned"), F.lit(False), F.lit(False), F.lit(True)), n=book.preopen_environment(F.lit("bullish"), F.lit("bearish"), F.lit("aligned"), F.lit(False), F.lit(False), F.lit(True)),
    )
    assert (r.a, r.b, r.c, r.d, r.e) == ("last_minute_pull_up", "last_minute_press_down_held", "last_minute_press_down_failed", "stable", "insufficient")
    assert (r.f, r.g, r.h, r.i, r.j, r.k, r.l, r.m, r.n) == ("neutral", "bearish", "bearish", "bullish", "taiwan_weaker_than_us", "taiwan_resilient", "missing", "bullish", "conflict")


def test_exit_rule_of_a_position(spark):
    f = lambda ret, day, close=10.0, high=10.0, before=9.0, top=10.0: signals.exit_reason(*[F.lit(v) for v in (ret, day, close, high, before, top)], F.lit(None).cast("double"))
    r = one(spark, a=f(-0.2, 1), b=f(-0.055, 2), c=f(0.13, 2), d=f(0.05, 6), e=f(0.05, 3), f=f(0.05, 3, close=8.0), g=f(-0.01, 3))
    assert tuple(r) == (None, "stop", "target", "time", None, "no_continuation", "no_continuation")


def test_auc_counts_ties_half(spark):
    df = spark.createDataFrame([(1, 0.2, False), (1, 0.5, True), (1, 0.5, False), (1, 0.9, True)], "k int, p double, y boolean")
    assert validation.auc(df, ["k"], "p", "y").first().auc == 0.875


def test_purge_is_strict(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    rows = [(0, "train", day(1), day(3)), (0, "train", day(2), day(5)), (0, "validate", day(5), day(6)), (0, "test", day(9), day(10))]
    x = validation.purge(spark.createDataFrame(rows, "fold int, role string, d timestamp, o timestamp"), "d", "o", "1 day")
    assert sorted(r.d.day for r in x.collect()) == [1, 5, 9]


def test_steps_read_the_first_bound_not_below(spark):
    steps = spark.createDataFrame([(0.4, 0.1), (0.8, 0.7)], "bound double, value double")
    df = spark.createDataFrame([(0.1,), (0.4,), (0.41,), (0.99,)], "p double")
    assert [r.q for r in validation.read_steps(df, steps, "p", "q").orderBy("p").collect()] == [0.1, 0.1, 0.7, 0.7]


def test_logistic_reaches_its_optimum(spark):
    df = spark.createDataFrame([(float(i % 7), float((i * 5) % 11), float((i % 7) > 3)) for i in range(200)], "a double, b double, y double")
    scored = validation.score_logistic(validation.fit_logistic(df, ["a", "b"], "y", 1.0), df, "p", ["a", "b"])
    assert scored.agg(F.avg(((F.col("p") >= 0.5) == (F.col("y") == 1)).cast("double"))).first()[0] == 1.0


def test_book_problems_in_order(spark):
    level = "array<struct<price:double,volume:double,diff:double>>"
    rows = [([(99.0, 2.0, 1.0)], [(101.0, 2.0, 0.0)], False), ([], [(101.0, 1.0, 0.0)], False), ([(99.0, 0.0, 0.0)], [(101.0, 1.0, 0.0)], False), ([(101.0, 1.0, 0.0)], [(101.0, 1.0, 0.0)], False), (None, None, True), ([(-1.0, 1.0, 0.0)], [(101.0, 1.0, 0.0)], False)]
    x = book.check_snapshots(spark.createDataFrame(rows, f"bids {level}, asks {level}, suspend boolean"))
    assert [r.problem for r in x.collect()] == [None, "missing_bid_depth", "missing_positive_bid_depth", "crossed_or_locked_book", "suspended", "invalid_bid_level"]
    assert book.pressures(x).first().pressure == 0.2


def test_segments_keep_ids_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", ts(1)), (1, "a", ts(2)), (2, "b", ts(3)), (3, "b", ts(4))], "event_id long, day string, exchange_ts timestamp_ntz")
    path = f"file://{tmp_path}/s"
    manifest, taken = storage.append_segments(df, path, df.where("event_id = 3"), ["day"])
    assert sorted((r.day, r.record_count) for r in manifest.collect()) == [("a", 1), ("b", 1)] and sorted(r.event_id for r in taken.collect()) == [1, 3]
    assert storage.verify_segments(spark, path, manifest, ["day"]).count() == 0
    assert storage.verify_segments(spark, path, manifest.withColumn("record_count", F.lit(9).cast("long")), ["day"]).count() == 2
    assert storage.file_checksums(spark, path).where("path LIKE '%.parquet'").count() == 2


def test_ragged_payloads_are_left_out(spark):
    df = spark.createDataFrame([(1, [1, 2], ["a", "b"]), (2, [1], ["a", "b"]), (3, None, ["a"])], "k int, x array<int>, y array<string>")
    assert [(r.k, r.place, r.x, r.y) for r in storage.unzip_columns(df, ["k"], ["x", "y"]).collect()] == [(1, 0, 1, "a"), (1, 1, 2, "b")]
    assert [r.bad for r in df.select(storage.ragged(["x", "y"]).alias("bad")).collect()] == [False, True, True]


def test_candles_and_csv(spark, tmp_path):
    c = storage.candles(spark.createDataFrame([("2024-01-01", "10", None, " 5 "), ("2024-01-02", None, None, "1")], "Date string, ClosingPrice string, lastPrice string, Trading_Volume string")).collect()
    assert [(r.date, r.close, r.volume, r.open) for r in c] == [("2024-01-01", 10.0, 5.0, None)]
    (tmp_path / "x.csv").write_text("d,v\n2024,\"1,234\"\n2025,-\n")
    assert [r.v for r in storage.exchange_csv(spark, f"file://{tmp_path}/x.csv", ["v"]).collect()] == [1234.0, None]

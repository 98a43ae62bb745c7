"""Daily candidates, positions of the day before, presets and bar records by hand values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import candidates as C
from tidemark.operators import signals as G

DAY = dt.date(2024, 1, 1)


def day(i):
    return DAY + dt.timedelta(days=i)


def test_latest_evidence(spark):
    at = lambda d, h: dt.datetime(2024, 1, 1, h) + dt.timedelta(days=d)
    bars = [("a", day(i), 10.0, at(i, 15)) for i in range(30)]
    bars[2] = ("a", day(2), 10.0, at(40, 9))  # a late repair, within the reach of the bars 2 to 25
    bars += [("b", day(i), 10.0, at(i, 16)) for i in range(3, 8)]
    flows = [("a", day(28), at(28, 18))]
    x = C.latest_evidence(spark.createDataFrame(bars, "ticker string, date date, close double, available_at timestamp_ntz"), spark.createDataFrame(flows, "ticker string, date date, available_at timestamp_ntz"))
    got = {(r.ticker, (r.date - DAY).days): r.decision_time for r in x.collect()}
    assert got["a", 1] == at(1, 15)
    assert got["a", 2] == got["a", 25] == at(40, 9)
    assert got["a", 26] == at(26, 15) and got["a", 28] == at(28, 18) and got["a", 29] == at(29, 15)
    # b's market holds a's observations: those of days 3 and 5 rest on the repaired bar
    assert got["b", 3] == at(40, 9) and got["b", 5] == at(40, 9) and got["b", 4] == at(4, 16) and got["b", 6] == at(6, 16)


def test_candidates_need_a_price_a_range_and_required_features(spark):
    names = [n for n in C.FEATURES if n not in ("avg_turnover_log10", "foreign_streak", "foreign_intensity", "foreign_percentile")]
    row = lambda t, **k: (t, day(0), *[k.get(n, 1.0) for n in ["close", "high", "low", *names]])
    rows = [row("ok", high=2.0), row("flat"), row("free", high=2.0, close=0.0), row("soft", high=2.0, volume_ratio=None), row("hard", high=2.0, momentum5=None), row("nan", high=2.0, hma9_slope=float("nan")), row("silent", high=2.0), row("thin", high=2.0, avg_turnover=0.0)]
    daily = spark.createDataFrame(rows, "ticker string, date date, close double, high double, low double, " + ", ".join(f"{n} double" for n in names))
    foreign = spark.createDataFrame([("ok", day(0), 3, 0.123456785, None)], "ticker string, date date, foreign_streak long, foreign_intensity double, foreign_percentile double")
    evidence = daily.select("ticker", "date", F.when(F.col("ticker") != "silent", F.lit("2024-01-01 15:00:00").cast("timestamp_ntz")).alias("decision_time"))
    got = {r.ticker: r for r in C.candidates(daily, foreign, evidence).collect()}
    assert sorted(got) == ["ok", "soft", "thin"]
    assert got["ok"].foreign_streak == 3 and got["ok"].foreign_intensity == pytest.approx(0.12345679, abs=1e-12) and got["ok"].avg_turnover_log10 == 0.0
    assert got["soft"].volume_ratio is None and got["soft"].foreign_streak is None and got["thin"].avg_turnover_log10 is None


def test_positions_before(spark):
    published = spark.createDataFrame([(day(0), 1.0), (day(1), 3.0), (day(2), 5.0), (day(3), None), (day(4), 7.0), (day(6), 9.0)], "trading_date date, net double")
    closes = spark.createDataFrame([(day(i), 100.0 + i) for i in (0, 1, 2, 3, 4, 5, 6)], "trading_date date, close double")
    got = [(r.trading_date, r.close, r.net, round(r.net_z, 6)) for r in C.positions_before(published, closes, ["net"], 2).orderBy("trading_date").collect()]
    # pairs: day 1 gets 1, 2 gets 3, 3 gets 5, 4 lacks the position before, 6 gets 7; the z of 5 is against 1 and 3, of 7 against 3 and 5
    assert got == [(day(3), 103.0, 5.0, 3.0), (day(6), 106.0, 7.0, 3.0)]
    same = spark.createDataFrame([(day(i), 2.0) for i in range(4)], "trading_date date, net double")
    assert [r.net_z for r in C.positions_before(same, closes, ["net"], 2).collect()] == [0.0]
    assert C.positions_before(same.limit(0), closes, ["net"], 2).collect() == []


def test_strong_volume_at_the_ratio_itself(spark):
    rows = [(1, w, i, v) for w, vols in ((60, [1, 1, 4]), (7, [9, 9, 9])) for i, v in enumerate(vols)]
    bars = spark.createDataFrame(rows, "target int, width int, at int, volume long")
    got = G.with_presets(bars, ["target"], "at", "width", {60: (3, 0.3, 3, 2.0)}).orderBy("at").collect()
    assert [(r.width, r.volume_avg, r.strong, r.pivot_bars, r.zone_pct) for r in got] == [(60, None, False, 3, 0.3), (60, None, False, 3, 0.3), (60, 2.0, True, 3, 0.3)]


def test_stored_bars_and_their_folders(spark, tmp_path):
    bars = spark.createDataFrame([(day(0), "DAY", dt.datetime(2024, 1, 1, 8, 45), 1.0, 2.0, 0.5, 1.5, 7), (day(1), "NIGHT", dt.datetime(2024, 1, 1, 23, 50), 1.0, 1.0, 1.0, 1.0, 1)], "trading_date date, session string, bar_start timestamp_ntz, open double, high double, low double, close double, volume long")
    records = C.stored_bars(bars, F.lit("TXA"), F.lit("2024-01-03T00:00:00+08:00"))
    first, second = records.orderBy("trading_date").collect()
    assert first.event_id == "derived-kbar-15m-TXA-2024-01-01-DAY-2024-01-01T08:45:00" and first.fields.bar_end == "2024-01-01T09:00:00" and first.fields.Volume == 7
    assert second.fields.bar_end == "2024-01-02T00:05:00" and second.alias_code == "TXA"
    C.write_stored_bars(records, str(tmp_path / "bars"))
    C.write_stored_bars(records, str(tmp_path / "bars"))
    back = spark.read.parquet(str(tmp_path / "bars"))
    assert back.count() == 4 and {p.name for p in (tmp_path / "bars").iterdir() if p.is_dir()} == {"trading_date=2024-01-01", "trading_date=2024-01-02"}

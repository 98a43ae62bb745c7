"""Landed lines by hand: names of several providers, what is unknown, and what doesn't fit."""

import datetime as dt

from tidemark.sources import landed


def test_names_types_and_rescued_columns(spark):
    lines = [
        '{"stock_id": "2330", "date": "2024-01-02", "open": 590.0, "max": 593, "min": 589, "close": 593.0, "Trading_Volume": 26059058, "Trading_money": 15430000000, "spread": -1.0, "Trading_turnover": 22000}',
        '{"Code": "1101", "Date": "1130102", "ClosingPrice": "34.50", "TradeVolume": "12,345,678", "Change": "--", "OpeningPrice": "", "Name": "x"}',
        '{"SecuritiesCompanyCode": "6488", "Date": "20240102", "Close": "n/a", "TradingShares": "1.5", "High": null}',
        "[1, 2]",
        "{oops",
        None,
    ]
    x = landed.read_landed(spark.createDataFrame([(i, v, "old") for i, v in enumerate(lines)], "i int, line string, close string"), "price")
    a, b, c, *rest = x.orderBy("i").collect()
    day = dt.date(2024, 1, 2)
    assert (a.code, a.date, a.open, a.high, a.close, a.volume, a.turnover, a.change) == ("2330", day, 590.0, 593.0, 593.0, 26059058, 1.543e10, -1.0)
    assert a.rescued == {"Trading_turnover": "22000"} and a.bad == [] and a.readable
    assert (b.code, b.date, b.close, b.volume, b.change, b.open, b.rescued, b.bad) == ("1101", day, 34.5, 12345678, None, None, {"Name": "x"}, [])
    assert (c.code, c.date, c.close, c.volume, c.bad) == ("6488", day, None, None, ["close", "volume"])
    assert [(r.readable, r.code, r.rescued, r.line) for r in rest] == [(False, None, None, v) for v in lines[3:]]
    report = {r.column: (r.n, r.bad) for r in landed.landing_report(landed.landing_marks(x, "price")).collect()}
    assert report["code"] == (3, 0) and report["close"] == (2, 1) and report["volume"] == (2, 1) and report["(line)"] == (3, 3) and report["?Name"] == (1, 0)


def test_dates_and_numbers(spark):
    from pyspark.sql import functions as F

    dates = {"2024-02-30": None, "2024/02/29": dt.date(2024, 2, 29), "0990131": dt.date(2010, 1, 31), "1130230": None, "2024-01-02 13:30": dt.date(2024, 1, 2), "": None, "20241301": None}
    df = spark.createDataFrame([(k,) for k in dates], "t string")
    assert {r.t: r.d for r in df.select("t", landed.date_text(F.col("t")).alias("d")).collect()} == dates
    numbers = {"1,234.5": 1234.5, " 7 ": 7.0, "NaN": None, "Infinity": None, "1e3": 1000.0, "12a": None}
    df = spark.createDataFrame([(k,) for k in numbers], "t string")
    assert {r.t: r.n for r in df.select("t", landed.number_text(F.col("t")).alias("n")).collect()} == numbers


def test_every_data_set_reads_an_empty_table(spark):
    none = spark.createDataFrame([], "line string")
    for name, columns in landed.CATALOGUE.items():
        assert landed.read_landed(none, name).columns == ["line", *columns, "rescued", "bad", "readable"]

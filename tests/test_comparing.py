"""Spikes, guidance, outcomes and opening books by hand values."""

import datetime as dt

from tidemark.operators import book, evaluation, facts, samples

T = dt.datetime


def _spikes(spark, later, after=3):
    # two trend bars up from 10 to 14 that don't overlap, after a small bar
    bars = [(10.0, 10.1, 9.9, 10.0), (10.0, 12.0, 10.0, 12.0), (12.0, 14.0, 12.0, 14.0), *later]
    rows = [("a", i, *b) for i, b in enumerate(bars)]
    return [tuple(r) for r in facts.spikes(spark.createDataFrame(rows, "ticker string, at int, open double, high double, low double, close double"), ["ticker"], "at", after).collect()]


def test_spike_outcomes(spark):
    flat = lambda c: (c, c + 0.1, c - 0.1, c)
    assert _spikes(spark, [flat(14.0), flat(13.0), flat(11.9)]) == [("a", 2, 2, 1, "reversal")]
    assert _spikes(spark, [flat(14.0), flat(14.0), flat(14.5)]) == [("a", 2, 2, 1, "trading_range")]
    assert _spikes(spark, [flat(14.0), flat(16.0), flat(18.0)]) == [("a", 2, 2, 1, "channel")]
    assert _spikes(spark, [flat(14.0), flat(16.0)]) == [("a", 2, 2, 1, None)]
    # half the way back is not yet a reversal
    assert _spikes(spark, [flat(16.0), flat(13.0), flat(12.0)])[0][4] == "channel"


def test_overlapping_or_doubtful_bars_are_no_spike(spark):
    rows = [("a", 0, 10.0, 12.0, 10.0, 12.0), ("a", 1, 11.0, 13.0, 11.0, 13.0), ("b", 0, 1.0, 9.0, 0.0, 3.0), ("b", 1, 3.0, 9.0, 0.0, 5.0), ("c", 0, 1.0, 1.0, 1.0, 1.0), ("c", 1, 1.0, 1.0, 1.0, 1.0)]
    assert facts.spikes(spark.createDataFrame(rows, "ticker string, at int, open double, high double, low double, close double"), ["ticker"], "at").collect() == []


def test_guidance(spark):
    priced = [("a", T(2024, 1, 1, 9), 10.0, 11.0, 11.0, 9.0, 12.0, 8.0), ("a", T(2024, 1, 1, 10), 11.0, 11.0, 11.0, 9.0, 12.0, 8.0), ("a", T(2024, 1, 1, 11), 10.0, 11.0, 11.0, 9.0, 10.5, 8.0)]
    priced = spark.createDataFrame(priced, "code string, snapshot_ts timestamp_ntz, best_bid double, best_ask double, active_entry double, patient_entry double, take_profit double, stop_loss double")
    at = [("a", T(2024, 1, 1, 8, 59)), ("a", T(2024, 1, 1, 9)), ("a", T(2024, 1, 1, 9, 0, 31)), ("a", T(2024, 1, 1, 10, 0, 5)), ("a", T(2024, 1, 1, 11, 0, 5)), ("b", T(2024, 1, 1, 9))]
    x = book.guidance(spark.createDataFrame([(i, *r) for i, r in enumerate(at)], "id int, code string, at timestamp_ntz"), priced, "code", "at", 30.0)
    assert {r.id: r.problem for r in x.collect()} == {0: "missing_snapshot", 1: None, 2: "stale_snapshot", 3: "invalid_spread", 4: "price_order", 5: "missing_snapshot"}


def test_outcomes_of_predictions(spark):
    p = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x")], "row int, hash string")
    o = spark.createDataFrame([(1, "x", 5), (2, "y", 6), (9, "x", 7)], "row int, hash string, outcome int")
    joined, bad = evaluation.outcomes_of_predictions(p, o, "row", "hash")
    assert [(r.row, r.outcome) for r in joined.collect()] == [(1, 5)] and {r.row: r.problem for r in bad.collect()} == {2: "hash", 3: "missing"}


def test_opening_book(spark):
    x = spark.createDataFrame([(1, [0.0, 0.0], [0.0]), (2, [0.0], [1.0]), (3, [], [])], "id int, bids array<double>, asks array<double>")
    assert {r.id: r.e for r in x.select("id", samples.opening_book_is_empty("bids", "asks").alias("e")).collect()} == {1: True, 2: False, 3: True}

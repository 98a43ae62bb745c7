"""Segments: a batch that comes again changes nothing, duplicates are told, one changed byte fails the read; days of records."""

import datetime as dt
import glob
import os

import pytest

from tidemark.sources import segments

KIND = "event_id long, ts timestamp_ntz, value double"


def at(day, hour=9):
    return dt.datetime(2024, 1, day, hour)


def contents(spark, path):
    rows = sorted(map(tuple, segments.read_segments(spark, path, KIND).collect()))
    return rows, sorted((r.record_count, r.first_ts, r.last_ts, r.batch) for r in segments.manifest(spark, path).collect()), sorted(map(tuple, segments.duplicates(spark, path).select("event_id", "n", "batch").collect()))


@pytest.fixture
def store(spark, tmp_path):
    path = str(tmp_path / "store")
    batches = [
        spark.createDataFrame([(1, at(1), 1.0), (2, at(1), 2.0), (2, at(1, 8), 2.5), (3, at(2), 3.0)], KIND),
        spark.createDataFrame([(3, at(2), 3.0), (3, at(2), 3.0), (4, at(2, 11), 4.0)], KIND),
    ]
    for i, b in enumerate(batches):
        segments.commit_batch(b, i, path, "ts")
    return path, batches


def test_ids_once_and_duplicates_counted(spark, store):
    rows, manifest, again = contents(spark, store[0])
    assert rows == [(1, at(1), 1.0), (2, at(1, 8), 2.5), (3, at(2), 3.0), (4, at(2, 11), 4.0)]
    assert again == [(2, 1, 0), (3, 2, 1)] and sum(m[0] for m in manifest) == 4


def test_a_batch_that_comes_again_changes_neither_rows_nor_manifest(spark, store):
    path, batches = store
    before = contents(spark, path)
    for i in (1, 0, 1):
        segments.commit_batch(batches[i], i, path, "ts")
    assert contents(spark, path) == before


def test_a_batch_that_did_not_end_is_not_read(spark, store):
    path, _ = store
    before = contents(spark, path)
    spark.createDataFrame([(9, at(3), 9.0)], KIND).selectExpr("*", "'2024-01-03' AS day").write.partitionBy("day").parquet(f"{path}/segments/batch=7")
    assert contents(spark, path) == before


def test_one_changed_byte_and_a_missing_file_fail_the_read(spark, store):
    path, _ = store
    file = sorted(glob.glob(f"{path}/segments/batch=0/day=*/*.parquet"))[0]
    raw = bytearray(open(file, "rb").read())
    raw[8] ^= 1
    with open(file, "wb") as f:
        f.write(raw)
    os.remove(os.path.join(os.path.dirname(file), f".{os.path.basename(file)}.crc"))  # or the local file system notices first
    with pytest.raises(Exception, match="not what was committed"):
        segments.read_segments(spark, path, KIND).collect()
    os.remove(file)
    with pytest.raises(Exception, match="is missing"):
        segments.read_segments(spark, path, KIND).collect()


def test_a_horizon_looks_ids_up_in_its_days_only(spark, tmp_path):
    path = str(tmp_path / "store")
    segments.commit_batch(spark.createDataFrame([(1, at(1), 1.0), (2, at(9), 1.0)], KIND), 0, path, "ts")
    segments.commit_batch(spark.createDataFrame([(1, at(10), 1.0), (2, at(10), 1.0)], KIND), 1, path, "ts", "2 days")
    assert contents(spark, path)[2] == [(2, 1, 1)]


def test_an_empty_store_and_an_empty_batch(spark, tmp_path):
    path = str(tmp_path / "store")
    assert contents(spark, path) == ([], [], [])
    segments.commit_batch(spark.createDataFrame([], KIND), 0, path, "ts")
    assert contents(spark, path) == ([], [], [])


DAY = "day string, seq int, event_id string, source string, target string, exchange_ts timestamp_ntz"


def day_of(spark, rows):
    from tidemark.operators.micro import weekday_calendar

    cal = weekday_calendar(spark, "2024-01-02", "2024-01-05")
    return spark.createDataFrame(rows, DAY), cal


def test_days_in_order_with_sessions(spark):
    d = "2024-01-03"
    records, cal = day_of(spark, [(d, 0, f"x-{d}-0", "h", "A1", at(3, 10)), (d, 1, f"x-{d}-1", "h", "A1", at(3, 9)), (d, 2, f"x-{d}-2", "h", "A1", at(3, 9)), (d, 3, f"x-{d}-3", "h", "A1", at(3, 20))])
    ticks, faults = segments.historical_ticks(records, cal, "h")
    got = [(r.seq, r.place, r.session, str(r.trading_date)) for r in ticks.orderBy("place").collect()]
    assert got == [(1, 1, "DAY", d), (2, 2, "DAY", d), (0, 3, "DAY", d), (3, 4, "NIGHT", "2024-01-04")] and faults.isEmpty()


@pytest.mark.parametrize(
    ("change", "fault"),
    [((0, 1, "x-2024-01-04-1", "h", "A1", at(3)), "OTHER_DAY"), ((0, 1, "x-2024-01-03-1", "g", "A1", at(3)), "SOURCE"), ((0, 1, "x-2024-01-03-1", "h", "A2", at(3)), "MIXED_TARGETS"), ((0, 1, "x-2024-01-03-1", "h", "A1", at(3, 14)), "OUTSIDE_SESSIONS")],
)
def test_a_fault_fails_the_day(spark, change, fault):
    good = ("2024-01-03", 0, "x-2024-01-03-0", "h", "A1", at(3))
    records, cal = day_of(spark, [good, ("2024-01-03", *change[1:])])
    with pytest.raises(ValueError, match=fault):
        segments.historical_ticks(records, cal, "h")
    ticks, faults = segments.historical_ticks(records, cal, "h", strict=False)
    assert ticks.isEmpty() and {r.fault for r in faults.collect()} == {fault}

"""A stream in several batches against the table's step states; late events; the session's end."""

import datetime as dt

from tidemark.operators import micro
from tidemark.streaming import live, states

START, END = dt.datetime(2024, 1, 2, 8, 45), dt.datetime(2024, 1, 2, 8, 46)
KIND = "target long, session_start timestamp_ntz, session_end timestamp_ntz, ts timestamp, event_id long, kind string, price double, volume long, side string, bid double, ask double, depth long"


def tick(target, second, i, price, side="buy"):
    return (target, START, END, START + dt.timedelta(seconds=second), i, "tick", price, 2, side, None, None, None)


def quote(target, second, i, bid):
    return (target, START, END, START + dt.timedelta(seconds=second), i, "quote", None, None, "unknown", bid, bid + 1, 5)


def closed(spark, folder, batches, delay="5 seconds"):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, KIND).coalesce(1).write.parquet(f"{folder}/{i}")
    stream = spark.readStream.schema(KIND).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(folder)
    with states.rocksdb_state(spark):
        return live.run(states.stream_states(stream, 2, 10.0, delay), "states")


def test_batches_give_the_steps_of_the_table(spark, tmp_path):
    first = [tick(1, 3.5, 1, 10.0), quote(1, 4.1, 2, 9.5), tick(1, 3.5, 3, 11.0, "sell"), tick(2, 50, 4, 7.0)]
    second = [tick(1, 52, 5, 12.0), quote(1, 47, 6, 8.0), tick(1, 52.5, 7, 13.0), tick(2, 55, 8, 6.0, "unknown")]
    out = closed(spark, str(tmp_path), [first, second, [tick(9, 400, 10, 1.0)]])
    every = spark.createDataFrame(first + second, KIND).withColumnRenamed("ts", "exchange_ts")
    every = every.withColumn("exchange_ts", every.exchange_ts.cast("timestamp_ntz"))
    table = micro.step_states(every.where("kind = 'tick'"), every.where("kind = 'quote'"), 2, 10.0)
    columns = [c for c in table.columns if c in out.columns]
    got = {(r.target, r.step): tuple(r) for r in out.where("target < 9").select(*columns).collect()}
    want = {(r.target, r.step): tuple(r) for r in table.select(*columns).collect()}
    assert len(columns) > 18 and want == {k: v for k, v in got.items() if k in want}
    # after the last event steps go on to the session's end, with the quote carried
    assert {s for t, s in got if t == 1} == set(range(1, 30)) and {s for t, s in got if t == 2} == set(range(25, 30))
    last = out.where("target = 1 AND step = 29").first()
    assert (last.bid, last.trades, last.volume, last.open, last.quote_fresh) == (8.0, 0, 0, None, False)


def test_an_event_of_a_closed_step_is_late(spark, tmp_path):
    # a batch closes the steps that the batches before it have passed
    out = closed(spark, str(tmp_path), [[tick(1, 2.5, 1, 10.0), tick(1, 40, 2, 11.0)], [tick(1, 41, 3, 11.0)], [tick(1, 3, 4, 99.0), tick(1, 45, 5, 12.0)], [tick(9, 400, 6, 1.0)]])
    assert {r.high for r in out.where("target = 1 AND trades > 0").collect()} == {10.0, 11.0, 12.0}

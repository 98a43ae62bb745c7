"""Queries of stateful streams, of segments stored exactly once, and of stored days of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import settled, settled_sql
from tidemark.plans.microstructure import _CAL, _SESSIONS, _STATES, AGE, STEP, _calendar
from tidemark.registry import query
from tidemark.sources import segments as T
from tidemark.sources.storage import shared_folder
from tidemark.sources.views import v_ticks, with_views
from tidemark.streaming import live, states

_CLOSED = {
    **_STATES,
    # steps that the watermark, ten minutes behind the last event inside a session, has passed
    "mark": "SELECT epoch_ms(max(exchange_ts)) - 600000 AS ms FROM (SELECT exchange_ts FROM t0 UNION ALL SELECT exchange_ts FROM q0)",
    "span": f"""SELECT target, session_start, min(step) AS a, least(CASE WHEN hour(session_start) = 8 THEN 29 ELSE 83 END, CAST(floor((any_value(ms) - epoch_ms(session_start)) / {STEP}e3) AS BIGINT) - 1) AS b
        FROM (SELECT target, session_start, step FROM t0 UNION ALL SELECT target, session_start, step FROM q0), mark GROUP BY target, session_start""",
    "grid": "SELECT target, session_start, unnest(generate_series(a, b)) AS step FROM span",
}
_CLOSED = {k: _CLOSED[k] for k in (*_SESSIONS, "t0", "q0", "t1", "q1", "mark", "span", "grid", "raw", "states")}
_COLS = ["target", "session_start", "step", "open", "high", "low", "close", "volume", "trades", "buy_volume", "sell_volume", "unknown_volume", "bid", "ask", "quote_fresh"]


def _session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream of events inside sessions, trades and quotes in one."""
    x = live.read_events(spark, sf_dir).withColumn("_instant", F.col("ts"))
    x = live.tag_sessions(x, _calendar(spark, sf_dir)).where("session <> 'CLOSED'").withColumn("ts", F.col("_instant"))
    quote = F.col("event_type").isin("signup", "error")
    number = F.regexp_extract("props", "[0-9]+", 0).cast("long")
    return x.select(
        "target", "session_start", "session_end", "ts", "event_id", F.when(quote, "quote").otherwise("tick").alias("kind"), F.when(~quote, F.col("value")).alias("price"), F.when(~quote, number).alias("volume"),
        F.expr("CASE event_type WHEN 'click' THEN 'buy' WHEN 'view' THEN 'sell' ELSE 'unknown' END").alias("side"), F.when(quote, F.col("value") - 0.5).alias("bid"), F.when(quote, F.col("value") + 0.5).alias("ask"), F.when(quote, number).alias("depth"),
    )


@query(with_views(f"SELECT {', '.join(_COLS)}, {settled_sql('notional', 3)} AS notional, {settled_sql('spread')} AS spread, {settled_sql('tick_age_s', 3)} AS tick_age_s, {settled_sql('quote_age_s', 3)} AS quote_age_s FROM states", "v_ticks", "v_quotes", **_CLOSED))
def stream_step_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step that a stream's timers closed, empty ones with the last quote carried: what the table's steps are."""
    with states.rocksdb_state(spark):
        x = live.run(states.stream_states(_session_events(spark, sf_dir), STEP, AGE, "10 minutes"), "states")
    return x.select(*_COLS, settled("notional", 3).alias("notional"), settled("spread").alias("spread"), settled("tick_age_s", 3).alias("tick_age_s"), settled("quote_age_s", 3).alias("quote_age_s"))


def _stored(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """Events as a stream, every third one three times, stored as segments; and the batch form of a part of them, committed twice."""
    x = live.read_events(spark, sf_dir).select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "target", "value")
    path = shared_folder(spark, "store")
    T.store_stream(x.withColumn("_k", F.explode(F.sequence(F.lit(1), F.when(F.col("event_id") % 3 == 0, 3).otherwise(1)))).drop("_k"), path, "ts").awaitTermination()
    last = T.manifest(spark, path).agg(F.max("batch")).first()[0] or 0
    again = v_ticks(spark, sf_dir).select("event_id", F.col("exchange_ts").alias("ts"), "target", F.col("price").alias("value"))
    for _ in range(2):
        T.commit_batch(again, last + 1, path, "ts", "40 days")
    return path, x


@query("SELECT CAST(ts AS DATE) AS date, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids, " + settled_sql("sum(value)", 3) + " AS total, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1")
def stored_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the segments hold, read from bytes whose hash is the manifest's: each event once, whatever came again."""
    path, x = _stored(spark, sf_dir)
    y = T.read_segments(spark, path, x.schema)
    return y.groupBy(F.to_date("ts").alias("date")).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"), settled(F.sum("value"), 3).alias("total"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("SELECT event_id, CAST(CASE WHEN event_id % 3 = 0 THEN 2 ELSE 0 END + CASE WHEN event_type NOT IN ('signup', 'error') THEN 1 ELSE 0 END AS BIGINT) AS n FROM events WHERE event_id % 3 = 0 OR event_type NOT IN ('signup', 'error')")
def stored_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each id came again; a batch that was committed twice counts once."""
    path, _ = _stored(spark, sf_dir)
    return T.duplicates(spark, path).groupBy("event_id").agg(F.sum("n").alias("n"))


_DAYS = {
    **_CAL,
    "rec": """SELECT event_id, strftime(exchange_ts, '%Y-%m-%d-%H') || '-' || CASE WHEN target < 2 AND hour(exchange_ts) % 4 = 0 THEN 0 ELSE target END AS day, event_id % 97 = 0 AS other, event_id % 89 = 0 AS unnamed, target, exchange_ts FROM v_ticks""",
    "ses": "SELECT rec.*, trading_date, session FROM rec LEFT JOIN cal ON exchange_ts >= session_start AND exchange_ts < session_end",
    "flt": """SELECT day, 'SOURCE' AS fault FROM rec WHERE other UNION ALL SELECT day, 'OTHER_DAY' FROM rec WHERE unnamed UNION ALL SELECT day, 'OUTSIDE_SESSIONS' FROM ses WHERE session IS NULL
        UNION ALL SELECT rec.day, 'MIXED_TARGETS' FROM rec JOIN (SELECT day FROM rec GROUP BY 1 HAVING count(DISTINCT target) > 1) m ON m.day = rec.day""",
}


def _days(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Trades as records of hours and targets, each such 'day' a store of its own; some of two targets, of another source or day."""
    x = v_ticks(spark, sf_dir).withColumn("day", F.concat(F.date_format("exchange_ts", "yyyy-MM-dd-HH"), F.lit("-"), F.when((F.col("target") < 2) & (F.hour("exchange_ts") % 4 == 0), 0).otherwise(F.col("target"))))
    name = F.concat(F.lit("h-"), F.when(F.col("event_id") % 89 == 0, "elsewhere").otherwise(F.col("day")), F.lit("-"), F.col("event_id"))
    records = x.select("day", F.col("event_id").alias("seq"), name.alias("event_id"), F.when(F.col("event_id") % 97 == 0, "other").otherwise("historical").alias("source"), F.col("target").cast("string").alias("target"), "exchange_ts")
    return T.historical_ticks(records, _calendar(spark, sf_dir), "historical", strict=False)


@query(with_views("SELECT event_id AS seq, day, session, trading_date, row_number() OVER (PARTITION BY day ORDER BY exchange_ts, event_id) AS place FROM ses WHERE day NOT IN (SELECT day FROM flt)", "v_ticks", **_DAYS))
def historical_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _days(spark, sf_dir)[0].select("seq", "day", "session", "trading_date", "place")


@query(with_views("SELECT fault, count(*) AS n, count(DISTINCT day) AS days FROM flt GROUP BY 1", "v_ticks", **_DAYS))
def historical_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _days(spark, sf_dir)[1].groupBy("fault").agg(F.count("*").alias("n"), F.count_distinct("day").alias("days"))

"""Structured Streaming: split, deduplicate, tag, aggregate and store live events.

Functions take and give streaming DataFrames (batch ones work as well); run() drives a query
over all that has arrived and ends, with a checkpoint in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.sources.storage import shared_folder

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, glob: str = "events.parquet", files_per_batch: int = 1) -> DataFrame:
    """Event files of a folder as a stream; ts as an instant, for watermarks."""
    rows = spark.readStream.schema(EVENTS).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("target", F.col("user_id") % 5)


def split(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(trades, quotes) of a combined stream."""
    quote = F.col("event_type").isin("signup", "error")
    return events.where(~quote), events.where(quote)


def distinct_events(events: DataFrame, delay: str) -> DataFrame:
    """The first event of each id within the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def tumbling_bars(trades: DataFrame, width: str, delay: str, start: str = "0 seconds") -> DataFrame:
    """Bars by target and window, closed when the watermark passes; start shifts windows to the session's begin."""
    order = F.struct("ts", "event_id")
    return (
        trades.withWatermark("ts", delay)
        .groupBy("target", F.window("ts", width, width, start))
        .agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").alias("trades"))
        .select("target", F.col("window.start").alias("bar_start"), F.col("window.end").alias("bar_end"), "open", "high", "low", "close", "trades")
    )


def out_of_order(events: DataFrame, tops: DataFrame, received: str = "received_ts", exchange: str = "ts") -> DataFrame:
    """Per target of a batch: n events, those late behind one received before, and the top exchange time.

    tops (target, top): the top of all batches before. Events are ordered within an hour of
    receipt; what came in the hours before is one row an hour and target, so no target's batch
    meets in one task.
    """
    x = events.select("target", F.col(received).alias("_r"), F.col(exchange).alias("_x"), "event_id").withColumn("_hour", F.date_trunc("hour", "_r"))
    hours = x.groupBy("target", "_hour").agg(F.max("_x").alias("_end"))
    before = F.max("_end").over(W.partitionBy("target").orderBy("_hour").rowsBetween(W.unboundedPreceding, -1))
    hours = hours.select("target", "_hour", before.alias("_before"))
    inside = F.max("_x").over(W.partitionBy("target", "_hour").orderBy("_r", "event_id").rowsBetween(W.unboundedPreceding, -1))
    x = x.withColumn("_inside", inside).join(hours, ["target", "_hour"]).join(tops.select("target", F.col("top").alias("_top")), "target", "left")
    late = F.coalesce(F.col("_x") < F.greatest("_inside", "_before", "_top"), F.lit(False))  # greatest passes over nulls
    return x.groupBy("target").agg(F.count("*").alias("n"), F.count_if(late).alias("late"), F.greatest(F.max("_x"), F.max("_top")).alias("top"))


def run_out_of_order(stream: DataFrame, name: str) -> DataFrame:
    """out_of_order over all that has arrived, batch by batch; a batch that is repeated is replaced."""
    spark, path = stream.sparkSession, shared_folder(stream.sparkSession, name)
    kinds = "target long, n long, late long, top timestamp"
    spark.createDataFrame([], kinds).write.parquet(f"{path}/batch=-1")

    def one(batch: DataFrame, batch_id: int) -> None:
        known = batch.sparkSession.read.schema(f"{kinds}, batch long").parquet(path).where(F.col("batch") < batch_id)
        out_of_order(batch, known.groupBy("target").agg(F.max("top").alias("top"))).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(f"{kinds}, batch long").parquet(path)


def tag_sessions(events: DataFrame, calendar: DataFrame, ts: str = "ts") -> DataFrame:
    """Live events with their session, by a join of the stream with the calendar's hours; CLOSED outside all."""
    from tidemark.operators.micro import resolve_sessions

    return resolve_sessions(events.withColumn(ts, F.col(ts).cast("timestamp_ntz")), calendar, ts)


def is_stale(received: str, exchange: str, limit: str = "5 seconds") -> Column:
    """Whether an event came over `limit` after it happened."""
    return F.col(received) - F.col(exchange) > F.expr(f"interval {limit}")


def quality_rows(events: DataFrame, connections: DataFrame, drops: DataFrame) -> DataFrame:
    """(target, reason): reasons of events, lost connections and dropped batches in one stream of quality rows.

    events: target, reasons array; connections: target, connected; drops: target, dropped count.
    """
    lost = connections.where("NOT connected").select("target", F.lit("CONNECTION_LOST").alias("reason"))
    dropped = drops.where("dropped > 0").select("target", F.explode(F.array_repeat(F.lit("QUEUE_DROP"), F.col("dropped").cast("int"))).alias("reason"))
    return events.select("target", F.explode("reasons").alias("reason")).unionByName(lost).unionByName(dropped)


def checksum(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: how many rows and a sum of their hashes, which doesn't depend on order: equal for a stream and its replay."""
    return df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).cast("string").alias("checksum"))


def run(stream: DataFrame, name: str, partitions: tuple[str, ...] = ()) -> DataFrame:
    """Runs a stream over what is there into a Parquet table in the shared folder, partitioned if asked; the table."""
    spark = stream.sparkSession
    path = shared_folder(spark, name)
    writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True)
    (writer.partitionBy(*partitions) if partitions else writer).start(path).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def score_closed_bars(bars: DataFrame, score, name: str) -> DataFrame:
    """Scores each closed bar once: bars come in append mode, when the watermark has closed them; the scored table."""
    path = shared_folder(bars.sparkSession, name)
    score_batches(bars, score, path)
    return bars.sparkSession.read.parquet(path)


def score_batches(stream: DataFrame, score, path: str) -> None:
    """Applies a batch scoring function to each micro-batch and appends its rows; a batch that is repeated is replaced."""

    def one(batch: DataFrame, batch_id: int) -> None:
        score(batch).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start().awaitTermination()

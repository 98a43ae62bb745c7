"""Segments of a stream or a table, committed by manifest, and read only as far as their bytes are what was committed."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

MANIFEST = "file string, sha256 string, record_count long, first_ts timestamp, last_ts timestamp, batch long"
DUPLICATES = "event_id long, n long, batch long"


def _there(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """A Parquet table, or an empty one where nothing has been written."""
    try:
        return spark.read.schema(schema).option("recursiveFileLookup", "false").parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(file, content) of every data file below <path>/segments; file is the path from there on."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{path}/segments")
    return found.select(F.substring_index("path", "/segments/", -1).alias("file"), "content")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row a committed file: file, sha256 of its bytes, record_count, first_ts, last_ts, batch."""
    return _there(spark, f"{path}/manifest", MANIFEST)


def duplicates(spark: SparkSession, path: str) -> DataFrame:
    """How often each batch met an id again that it or a batch before held: event_id, n, batch."""
    return _there(spark, f"{path}/duplicates", DUPLICATES)


def commit_batch(batch: DataFrame, batch_id: int, path: str, ts: str, horizon: str | None = None) -> None:
    """Stores a batch's new events as segments by day of `ts` and commits them by its manifest, the last thing written.

    Of rows with one id the first by time stays, unless an earlier batch holds the id; the others are
    counted as duplicates. With a horizon (an interval), ids are looked up in segments of days not older
    than that before the batch's first event, so that what is looked up doesn't grow with the store.
    A batch that is repeated replaces its own files and gives the same rows and manifest.
    """
    spark = batch.sparkSession
    days = batch.withColumn("day", F.date_format(ts, "yyyy-MM-dd"))
    rest = sorted(c for c in days.columns if c not in ("event_id", ts))
    groups = days.groupBy("event_id").agg(F.min(F.struct(ts, *rest)).alias("_e"), F.count("*").alias("_n"))
    committed = manifest(spark, path).where(F.col("batch") < batch_id)
    at = F.to_date(F.regexp_extract("file", r"day=([0-9-]+)", 1))
    if horizon is not None:
        begun = days.agg((F.min(ts).cast("timestamp") - F.expr(f"interval {horizon}")).cast("date")).first()[0]
        committed = committed.where(at >= F.lit(begun))
    places = [f"{path}/segments/batch={r.batch}/day={r.day}" for r in committed.select("batch", F.regexp_extract("file", r"day=([0-9-]+)", 1).alias("day")).distinct().collect()]  # one row a batch and day in the horizon
    known = spark.read.parquet(*places).select("event_id").distinct().withColumn("_known", F.lit(1)) if places else spark.createDataFrame([], "event_id long, _known int")
    met = groups.join(known, "event_id", "left")
    fresh = met.where("_known IS NULL").select("event_id", *[F.col(f"_e.{c}").alias(c) for c in (ts, *rest)]).select(*days.columns)
    target = f"{path}/segments/batch={batch_id}"
    fresh.write.mode("overwrite").partitionBy("day").parquet(target)
    again = F.col("_n") - F.when(F.col("_known").isNull(), 1).otherwise(0)
    met.select("event_id", again.cast("long").alias("n"), F.lit(batch_id).cast("long").alias("batch")).where("n > 0").write.mode("overwrite").parquet(f"{path}/duplicates/batch={batch_id}")
    hashed = _files(spark, path).where(F.col("file").startswith(f"batch={batch_id}/")).select("file", F.sha2("content", 256).alias("sha256"))
    stored = spark.read.schema(days.schema).parquet(target)
    counted = stored.groupBy(F.concat(F.lit(f"batch={batch_id}"), F.substring_index("_metadata.file_path", f"/batch={batch_id}", -1)).alias("file")).agg(
        F.count("*").alias("record_count"), F.min(ts).cast("timestamp").alias("first_ts"), F.max(ts).cast("timestamp").alias("last_ts")
    )
    hashed.join(counted, "file").withColumn("batch", F.lit(batch_id).cast("long")).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/batch={batch_id}")


def store_stream(stream: DataFrame, path: str, ts: str, horizon: str | None = None, every: str | None = None) -> StreamingQuery:
    """Commits a stream's batches as segments below path, exactly once each: `every` so often, or all that is there and then no more."""

    def one(batch: DataFrame, batch_id: int) -> None:
        commit_batch(batch, batch_id, path, ts, horizon)

    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{path}/checkpoint")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def read_segments(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The events of committed segments, parsed from the very bytes whose hash is compared: one changed byte, or a missing file, fails the read.

    Files that no manifest names, as a batch that didn't end leaves them, are passed over. A file is a task's; files are as large as a batch made them.
    """
    empty = spark.createDataFrame([], schema)
    names = empty.columns
    arrow = empty.toArrow().schema
    wanted = manifest(spark, path).select("file", "sha256", "record_count")
    try:
        found = _files(spark, path)
    except AnalysisException:
        found = spark.createDataFrame([], "file string, content binary")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                file, digest, records, content = (batch.column(k)[i].as_py() for k in range(4))
                if content is None:
                    raise ValueError(f"segment {file} is missing")
                if sha256(content).hexdigest() != digest:
                    raise ValueError(f"segment {file} is not what was committed")
                rows = pq.read_table(pa.BufferReader(content))
                if rows.num_rows != records:
                    raise ValueError(f"segment {file} has {rows.num_rows} records, {records} were committed")
                day = file.split("day=")[1].split("/")[0]
                if "day" in names:
                    rows = rows.append_column("day", pa.array([day] * rows.num_rows))
                yield from rows.select(names).cast(arrow).to_batches()

    return wanted.join(found, "file", "left").select("file", "sha256", "record_count", "content").mapInArrow(parse, schema)


def historical_ticks(records: DataFrame, calendar: DataFrame, source: str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(ticks of stored days in order, one row a fault) from records: day, seq (stored order), event_id, source, target, exchange_ts, ....

    Faults are those that make a day unusable: `source` other than the given one, an event_id that
    doesn't name its day, more than one target a day, a tick outside every session. A day with a fault
    gives no ticks; strict raises at the first. Ticks carry trading_date and session of the calendar, and
    place, their number within the day by time and then stored order.
    """
    from pyspark.sql import Window as W

    from tidemark.operators.micro import resolve_sessions

    x = resolve_sessions(records, calendar)
    targets = records.groupBy("day").agg(F.min("target").alias("_a"), F.max("target").alias("_b"))
    x = x.join(targets, "day")
    fault: Column = F.array_compact(
        F.array(
            F.when(~F.col("source").eqNullSafe(F.lit(source)), F.lit("SOURCE")),
            F.when(~F.coalesce(F.contains("event_id", F.concat(F.lit("-"), "day", F.lit("-"))), F.lit(False)), F.lit("OTHER_DAY")),
            F.when(F.col("_a") != F.col("_b"), F.lit("MIXED_TARGETS")),
            F.when(F.col("session") == "CLOSED", F.lit("OUTSIDE_SESSIONS")),
        )
    )
    faults = x.select("day", "event_id", F.explode(fault).alias("fault"))
    if strict and (first := faults.orderBy("day", "event_id", "fault").first()) is not None:
        raise ValueError(f"{first.day}: {first.fault} at {first.event_id}")
    bad = faults.select(F.col("day").alias("_day")).distinct()
    place = F.row_number().over(W.partitionBy("day").orderBy("exchange_ts", "seq"))
    ticks = x.join(bad, F.col("day") == F.col("_day"), "left_anti").select(*records.columns, "trading_date", "session", place.alias("place"))
    return ticks, faults

"""Immutable segments with a manifest, content-addressed evidence, landed files, and their checks."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import c, content_hash, finite_or_null, number_of


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that all executors see: under spark.checkpoint.dir; where that is unset, a temporary one of a local session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-")
    return f"{base.rstrip('/')}/tidemark-{uuid.uuid4().hex}/{name}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read back: what comes after doesn't hold its plan."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables of kept() that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._kept_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def append_segments(events: DataFrame, path: str, known_ids: DataFrame | None, partitions: list[str], ts: str = "exchange_ts") -> tuple[DataFrame, DataFrame]:
    """Appends events with new ids, partitioned; (manifest of this append, events whose id was taken).

    Of rows with one id the first by time stays; the others, and ids in known_ids, are the duplicates.
    """
    numbered = events.withColumn("_n", F.row_number().over(W.partitionBy("event_id").orderBy(ts)))
    fresh, taken = numbered.where("_n = 1").drop("_n"), numbered.where("_n > 1").drop("_n")
    if known_ids is not None:
        ids = known_ids.select("event_id").distinct()
        taken = taken.unionByName(fresh.join(ids, "event_id", "left_semi"))
        fresh = fresh.join(ids, "event_id", "left_anti")
    segment = uuid.uuid4().hex
    fresh.withColumn("segment", F.lit(segment)).write.mode("append").partitionBy(*partitions).parquet(path)
    stored = events.sparkSession.read.parquet(path).where(F.col("segment") == segment)
    # a checksum of the ids that doesn't depend on their order: a sum of hashes
    checksum = F.sum(F.xxhash64("event_id").cast("decimal(38,0)")).cast("string")
    manifest = stored.groupBy("segment", *partitions).agg(F.count("*").alias("record_count"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), checksum.alias("checksum"))
    return manifest, taken


def verify_segments(spark: SparkSession, path: str, manifest: DataFrame, partitions: list[str]) -> DataFrame:
    """Partitions of the manifest or the store whose record counts or checksums differ; empty if all is well."""
    keys = ["segment", *partitions]
    found = spark.read.parquet(path).groupBy(*keys).agg(F.count("*").alias("found"), F.sum(F.xxhash64("event_id").cast("decimal(38,0)")).cast("string").alias("found_checksum"))
    x = manifest.join(found, keys, "full_outer")
    return x.where(~(F.col("record_count").eqNullSafe(F.col("found")) & F.col("checksum").eqNullSafe(F.col("found_checksum")))).select(*keys, "record_count", "found")


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of every file under a folder, read by Spark."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def evidence(rows: DataFrame, payload: list[str]) -> DataFrame:
    """Rows with source_hash, id and `problem`: the clocks must run published <= available <= fetched."""
    x = rows.withColumn("source_hash", content_hash(*sorted(payload)))
    wrong = F.when(F.col("published_at") > F.col("available_at"), "published_after_available").when(F.col("available_at") > F.col("fetched_at"), "available_after_fetched")
    return x.select("*", F.sha2(F.concat_ws("|", "source", "ticker", F.col("available_at").cast("string"), "source_hash"), 256).alias("id"), wrong.alias("problem"))


def evidence_as_of(rows: DataFrame, decision: str, keys: list[str]) -> DataFrame:
    """The latest record of each key and date that was available at its decision time, hash deciding ties."""
    w = W.partitionBy(*keys).orderBy(F.col("available_at").desc(), F.col("source_hash").desc())
    return rows.where(F.col("available_at") <= F.col(decision)).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def manifest_hash(rows: DataFrame, keys: list[str], id_col: str = "id") -> DataFrame:
    """sha256 over the ordered ids of each key."""
    return rows.groupBy(*keys).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(id_col)), "\n"), 256).alias("manifest_hash"), F.count("*").alias("n"))


def unzip_columns(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row per place of parallel arrays; ragged payloads are left out (see ragged)."""
    same = ~ragged(columns)
    zipped = F.posexplode(F.arrays_zip(*columns)).alias("place", "_z")
    return df.where(same).select(*keys, zipped).select(*keys, "place", *[F.col(f"_z.{n}").alias(n) for n in columns])


def ragged(columns: list[str]) -> Column:
    """Whether parallel arrays differ in length or one is missing."""
    sizes = [F.coalesce(F.size(n), F.lit(-1)) for n in columns]
    return F.greatest(*sizes, F.lit(-1)) != F.least(*sizes, F.lit(1 << 30))


def first_non_empty(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """For each key the rows of the first source that has any."""
    both = None
    for i, s in enumerate(sources):
        s = s.withColumn("_source", F.lit(i))
        both = s if both is None else both.unionByName(s)
    return both.withColumn("_first", F.min("_source").over(W.partitionBy(*keys))).where("_source = _first").drop("_source", "_first")


def prefer(live: DataFrame, historical: DataFrame, keys: list[str]) -> DataFrame:
    """Live rows, and historical ones of keys that live has none of."""
    return live.unionByName(historical.join(live.select(*keys).distinct(), keys, "left_anti"))


# Names under which providers send the columns of a candle, in order of preference.
CANDLE_NAMES = {"date": ("date", "Date", "time", "timestamp"), "open": ("open", "Open", "OpeningPrice"), "high": ("high", "High", "max", "HighestPrice"), "low": ("low", "Low", "min", "LowestPrice"), "close": ("close", "Close", "ClosingPrice", "lastPrice", "price"), "volume": ("volume", "Trading_Volume", "trading_volume", "TradeVolume", "TradingShares")}


def candles(rows: DataFrame) -> DataFrame:
    """Provider rows as date, open, high, low, close, volume; rows without a close are dropped."""
    exact = {n: n for n in rows.columns}

    def pick(names: tuple[str, ...], number: bool) -> Column:
        there = [F.col(f"`{exact[n]}`") for n in names if n in exact]
        return F.coalesce(*[finite_or_null(x) if number else x.cast("string") for x in there]) if there else F.lit(None).cast("double" if number else "string")

    return rows.select(*[pick(names, n != "date").alias(n) for n, names in CANDLE_NAMES.items()]).where("close IS NOT NULL")


def exchange_csv(spark: SparkSession, path: str, numbers: list[str]) -> DataFrame:
    """A landed CSV: blanks and dashes are null, thousands separators go."""
    rows = spark.read.option("header", True).csv(path)
    return rows.select(*[number_of(F.when(F.trim(n).isin("", "-"), None).otherwise(F.col(n))).alias(n) if n in numbers else F.trim(n).alias(n) for n in rows.columns])


def collection_coverage(requested: DataFrame, landed: DataFrame, key: str, source: str) -> DataFrame:
    """By source: requested keys, keys that landed, and the share."""
    total = requested.select(key).distinct().agg(F.count("*").alias("requested"))
    got = landed.join(requested.select(key).distinct(), key, "left_semi").groupBy(source).agg(F.count_distinct(key).alias("accepted"))
    return got.crossJoin(F.broadcast(total)).withColumn("coverage_pct", F.col("accepted") / F.col("requested") * 100)


def event_problems(df: DataFrame) -> Column:
    """Reasons against an event, in order: bad price, negative volume, late, early."""
    from tidemark.functions.scalars import reasons

    return reasons(("INVALID_PRICE", F.coalesce(F.col("price") <= 0, F.lit(True))), ("NEGATIVE_VOLUME", F.col("volume") < 0), ("OUT_OF_SESSION", F.col("session") == "CLOSED"), ("STALE", F.expr("received_ts - exchange_ts > interval 5 minutes")))


def quality_report(events: DataFrame, keys: list[str], ts: str = "exchange_ts") -> DataFrame:
    """Events, duplicates by id, out-of-order receipts and the longest gap in seconds, by key."""
    w = W.partitionBy(*keys).orderBy("received_ts", "event_id")
    micros = lambda x: F.unix_micros(c(x).cast("timestamp"))
    x = events.withColumn("_top", F.max(ts).over(w.rowsBetween(W.unboundedPreceding, -1)))
    x = x.withColumn("_gap", (micros(ts) - micros(F.lag(ts).over(W.partitionBy(*keys).orderBy(ts, "event_id")))) / 1e6)
    return x.groupBy(*keys).agg(F.count("*").alias("n"), (F.count("*") - F.count_distinct("event_id")).alias("duplicates"), F.count_if(F.col(ts) < F.col("_top")).alias("out_of_order"), F.max("_gap").alias("longest_gap_s"))


def write_evidence(rows: DataFrame, path: str) -> DataFrame:
    """Appends evidence by the id of its content; what is stored stays as it is, so a repeat changes nothing. The rows that are new."""
    spark = rows.sparkSession
    fresh = rows.where("problem IS NULL").dropDuplicates(["id"])
    try:
        known = spark.read.parquet(path).select("id")
    except AnalysisException:  # nothing is stored yet
        known = None
    fresh = fresh if known is None else fresh.join(known, "id", "left_anti")
    fresh.write.mode("append").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def evidence_manifest(stored: DataFrame, payload: list[str]) -> DataFrame:
    """(id, source, ticker, available_at, source_hash, intact): intact where the content still has the hash and the id."""
    again = content_hash(*sorted(payload))
    name = F.sha2(F.concat_ws("|", "source", "ticker", F.col("available_at").cast("string"), again), 256)
    return stored.select("id", "source", "ticker", "available_at", "source_hash", ((again == F.col("source_hash")) & (name == F.col("id"))).alias("intact"))


def market_clock(date: str | Column) -> Column:
    """Daily market rows are available at 13:30 of their date."""
    return F.to_timestamp_ntz(F.concat(c(date).cast("string"), F.lit(" 13:30:00")), F.lit("yyyy-MM-dd HH:mm:ss"))


def institutional_clock(date: str | Column, published: str | Column) -> tuple[Column, Column]:
    """(available, quality): the stated time, or 18:00 of the date, which is inferred."""
    evening = F.to_timestamp_ntz(F.concat(c(date).cast("string"), F.lit(" 18:00:00")), F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.coalesce(c(published), evening), F.when(c(published).isNotNull(), "explicit").otherwise("inferred_schedule")


def read_segments(spark: SparkSession, path: str, manifest: DataFrame, partitions: list[str]) -> DataFrame:
    """The segments of a store whose manifest agrees with what is there; a difference is an error."""
    wrong = verify_segments(spark, path, manifest, partitions).limit(5).collect()
    if wrong:
        raise ValueError(f"segments differ from their manifest: {wrong}")
    return spark.read.parquet(path)


def cached(df: DataFrame, folder: str, raw_hash: str, spec_hash: str, version: int = 1) -> DataFrame:
    """df as stored under the hashes of its input and its settings; built only where no table with that header is there."""
    spark = df.sparkSession
    path = f"{folder.rstrip('/')}/{raw_hash[:16]}-{spec_hash[:16]}"
    header = spark.createDataFrame([(version, raw_hash, spec_hash)], "version int, raw_hash string, spec_hash string")
    try:
        good = spark.read.parquet(f"{path}/header").join(header, ["version", "raw_hash", "spec_hash"], "left_semi").count() == 1
    except AnalysisException:  # no such table
        good = False
    if not good:
        df.write.mode("overwrite").parquet(f"{path}/rows")
        header.write.mode("overwrite").parquet(f"{path}/header")  # last: a header says that the rows are whole
    return spark.read.schema(df.schema).parquet(f"{path}/rows")


def missing_keys(wanted: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """The wanted keys that are not stored yet."""
    return wanted.select(*keys).distinct().join(stored.select(*keys), keys, "left_anti")


def markdown_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each row as a line of a Markdown table, pipes escaped; header_line gives the first two lines."""
    cell = lambda n: F.regexp_replace(F.coalesce(F.col(n).cast("string"), F.lit("")), r"\|", r"\\|")
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(n) for n in columns]), F.lit(" |")).alias("line"))


def header_line(columns: list[str]) -> str:
    return f"| {' | '.join(columns)} |\n| {' | '.join('---' for _ in columns)} |"


def coverage_with_reasons(requested: DataFrame, landed: DataFrame, key: str, source: str, reason: str) -> DataFrame:
    """By source: keys that landed, their share, and of those that came but were left out how many for which reason.

    landed: key, source, reason (null where accepted).
    """
    asked = requested.select(key).distinct()
    total = asked.agg(F.count("*").alias("requested"))
    x = landed.join(asked, key, "left_semi").groupBy(source, key).agg(F.bool_or(F.col(reason).isNull()).alias("_ok"), F.min(reason).alias("_why"))
    x = x.groupBy(source, F.when(~F.col("_ok"), F.col("_why")).alias("reason")).agg(F.count("*").alias("keys"))
    return x.crossJoin(F.broadcast(total)).withColumn("pct", F.col("keys") / F.col("requested") * 100)


def feed_items(df: DataFrame, keys: list[str], xml: str) -> DataFrame:
    """(keys, number, title, published): items of feed text that name an episode and a date."""
    item = F.explode(F.regexp_extract_all(xml, F.lit(r"(?s)<item>(.*?)</item>"), F.lit(1)))
    part = lambda tag: F.trim(F.regexp_extract("_item", rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1))
    x = df.select(*keys, item.alias("_item")).select(*keys, part("title").alias("title"), part("pubDate").alias("_date"))
    number = F.regexp_extract("title", r"(?i)EP\.?\s*(\d+)", 1).try_cast("int")
    return x.select(*keys, number.alias("number"), "title", F.try_to_timestamp("_date", F.lit("dd MMM yyyy HH:mm:ss")).cast("date").alias("published")).where("number IS NOT NULL AND published IS NOT NULL")

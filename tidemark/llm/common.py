"""Shared helpers of the training-data operators: shared storage, components, byte kernels."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as a Java regular expression; a word is a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"


#: Spark's setting that removes the shuffle files of a query when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where it is unset, a folder of our own.

    A folder of our own is of this machine, so without the setting only a local session runs.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


@contextmanager
def _shuffle_files_go(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as a compressed table in the shared folder and reads it back.

    Nothing needs the shuffle files of the write after it; Spark removes them when the write ends,
    so that disk holds those of one step at a time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}/{name}"
    with _shuffle_files_go(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    for made in _SCOPES:
        made.append(out)
    return out


#: Lists that written() adds its tables to, one for each scratch() that is open.
_SCOPES: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Deletes what written() makes inside, unless it is taken from the list; for results that are consumed inside."""
    made: list[DataFrame] = []
    _SCOPES.append(made)
    try:
        yield made
    finally:
        _SCOPES.pop()
        discard(*made)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() that no later step reads."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._written_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Edges of one partition of a component table, about.
EDGE_ROWS = 50_000


def _written_edges(edges: DataFrame, rows: int) -> tuple[DataFrame, int, int]:
    """The edges as a table in partitions that suit `rows`, with their number and a fingerprint, from one job."""
    seen = Observation()
    total = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    sized = edges.distinct().coalesce(max(1, -(-rows // EDGE_ROWS)))
    out = written(sized.observe(seen, F.count(F.lit(1)).alias("n"), total.alias("sum")), "edges")
    return out, seen.get["n"], int(seen.get["sum"] or 0)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph as (node, component), component the smallest node.

    edges: columns a, b (long, not null). Only nodes with an edge to a smaller node come back.
    Alternating large-star and small-star steps (Kiveris et al., 2014): each round is two
    grouped minima and never holds a component in one task; rounds grow with the logarithm of
    the longest path. Every round is written to the shared folder, so a lost executor costs
    one round at most, and in partitions that suit the number of edges.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    e, n, before = _written_edges(e, e.count())

    for _ in range(rounds if n else 0):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        last = e
        e, n, now = _written_edges(small, n)
        discard(last)
        if now == before:
            break
        before = now
    else:
        if n:
            raise RuntimeError("components did not settle")
    return e.selectExpr("a AS node", "b AS component")

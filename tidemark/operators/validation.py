"""Validation of models and rules as tables: folds, purging, scaling, metrics, bootstraps, verdicts."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from tidemark.functions.scalars import c, reasons, sigmoid


def number_by_time(df: DataFrame, ts: str, row_id: str) -> DataFrame:
    """df with `place`, from 0 in order of time, by counts per day: no task orders all rows."""
    x = df.withColumn("_day", F.to_date(ts))
    days = x.groupBy("_day").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.orderBy("_day")) - F.col("_n")  # one row a day
    x = x.join(days.select("_day", before.alias("_before")), "_day")
    rank = F.row_number().over(W.partitionBy("_day").orderBy(ts, row_id)) - 1
    return x.withColumn("place", F.col("_before") + rank).drop("_day", "_before")


def fold_ranges(spark: SparkSession, rows: int, folds: int, train: int, validate: int, test: int) -> DataFrame:
    """(fold, role, low, high): expanding training, then validation and test, the tests end to end at the tail."""
    out = []
    for k in range(folds):
        end = rows - (folds - 1 - k) * test
        out += [(k, "test", end - test, end), (k, "validate", end - test - validate, end - test), (k, "train", 0, end - test - validate)]
    if out and min(r[3] - r[2] for r in out if r[1] == "train") < train:
        raise ValueError("too few rows for the folds")
    return spark.createDataFrame(out, "fold int, role string, low long, high long")


def assign_folds(numbered: DataFrame, ranges: DataFrame) -> DataFrame:
    """Each row with each fold and role it has; ranges is a table of a few rows a fold."""
    return numbered.join(F.broadcast(ranges), (F.col("place") >= F.col("low")) & (F.col("place") < F.col("high")))


def purge(assigned: DataFrame, decision: str, outcome: str, embargo: str) -> DataFrame:
    """Training and validation rows whose outcome is not before the next part's first decision go, as do

    those decided within the embargo (an interval text) before it.
    """
    starts = assigned.groupBy("fold").agg(F.min(F.when(F.col("role") == "validate", F.col(decision))).alias("_v"), F.min(F.when(F.col("role") == "test", F.col(decision))).alias("_t"))
    x = assigned.join(starts, "fold")
    edge = F.when(F.col("role") == "train", F.col("_v")).when(F.col("role") == "validate", F.col("_t"))
    keep = edge.isNull() | ((F.col(outcome) < edge) & (F.col(decision) < edge - F.expr(f"interval {embargo}")))
    return x.where(keep).drop("_v", "_t")


def locked_suffix(df: DataFrame, date: str, share: float = 0.15, dates: int = 40) -> DataFrame:
    """df with `locked`: the larger of the last ceil(share * rows) rows and the rows of the last dates; all with fewer dates.

    df has `place`, from 0 in order of time (number_by_time), so the cut falls on a row.
    """
    days = df.groupBy(date).agg(F.count("*").alias("_n"), F.min("place").alias("_first"))
    w = W.orderBy(F.col(date).desc())  # one row a date
    days = days.withColumn("_rank", F.row_number().over(w))
    cut = days.agg(F.sum("_n").alias("_all"), F.coalesce(F.max(F.when(F.col("_rank") == dates, F.col("_first"))), F.lit(0)).alias("_by_date"))
    start = F.least(F.col("_all") - F.ceil(F.col("_all") * share), F.col("_by_date"))
    return df.crossJoin(F.broadcast(cut)).withColumn("locked", F.col("place") >= start).drop("_all", "_by_date")


def medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the exact median of each column."""
    return df.agg(*[F.percentile(x, F.lit(0.5)).alias(x) for x in columns])


def impute(df: DataFrame, fitted: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls become the medians of one fitted row; <name>_missing says where."""
    m = fitted.select(*[F.col(x).alias(f"_m_{x}") for x in columns])
    x = df.crossJoin(F.broadcast(m))
    return x.select(*[n for n in df.columns if n not in columns], *[F.coalesce(n, f"_m_{n}").alias(n) for n in columns], *[F.col(n).isNull().alias(f"{n}_missing") for n in columns])


def scaling(df: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """One row: clip limits, mean and population deviation of each clipped column, a deviation of 0 as 1."""
    limits = df.agg(*[F.percentile(x, F.lit(p)).alias(f"{x}_{n}") for x in columns for n, p in (("low", low), ("high", high))])
    x = df.crossJoin(F.broadcast(limits))
    clip = lambda n: F.least(F.greatest(F.col(n), F.col(f"{n}_low")), F.col(f"{n}_high"))
    keep = [F.first(f"{n}_{e}").alias(f"{n}_{e}") for n in columns for e in ("low", "high")]
    return x.agg(*keep, *[F.avg(clip(n)).alias(f"{n}_mean") for n in columns], *[F.when(F.stddev_pop(clip(n)) == 0, 1.0).otherwise(F.stddev_pop(clip(n))).alias(f"{n}_sd") for n in columns])


def scale(df: DataFrame, fitted: DataFrame, columns: list[str]) -> DataFrame:
    x = df.crossJoin(F.broadcast(fitted))
    clip = lambda n: F.least(F.greatest(F.col(n), F.col(f"{n}_low")), F.col(f"{n}_high"))
    return x.select(*[n for n in df.columns if n not in columns], *[((clip(n) - F.col(f"{n}_mean")) / F.col(f"{n}_sd")).alias(n) for n in columns])


def classification(df: DataFrame, keys: list[str], p: str, label: str, bins: int = 10) -> DataFrame:
    """Rows, Brier, log loss, accuracy, precision, recall, F1, the confusion counts, and expected calibration error over equal bins, by keys."""
    y, q = F.col(label).cast("double"), F.least(F.greatest(F.col(p), F.lit(1e-15)), F.lit(1 - 1e-15))
    cell = lambda said, is_: F.sum(((F.col(p) >= 0.5) == F.lit(said)).cast("long") * (y == is_).cast("long"))
    x = df.withColumn("_bin", F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)))
    per = x.groupBy(*keys, "_bin").agg(
        F.count("*").alias("_n"), F.sum(p).alias("_p"), F.sum(y).alias("_y"), F.sum((F.col(p) - y) ** 2).alias("_b"),
        F.sum(-(y * F.log(q) + (1 - y) * F.log(1 - q))).alias("_l"), cell(True, 1).alias("_tp"), cell(True, 0).alias("_fp"), cell(False, 1).alias("_fn"), cell(False, 0).alias("_tn"),
    )
    n = F.sum("_n")
    total = per.groupBy(*keys).agg(n.alias("n"), (F.sum("_b") / n).alias("brier"), (F.sum("_l") / n).alias("log_loss"), *[F.sum(f"_{x}").alias(x) for x in ("tp", "fp", "fn", "tn")], (F.sum(F.abs(F.col("_p") - F.col("_y"))) / n).alias("ece"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    part = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    total = total.withColumn("accuracy", (tp + tn) / F.col("n")).withColumn("precision", part(tp, tp + fp)).withColumn("recall", part(tp, tp + fn))
    return total.withColumn("f1", part(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def reliability(df: DataFrame, p: str, label: str, bins: int = 10) -> DataFrame:
    x = df.withColumn("bin", F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)))
    return x.groupBy("bin").agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(label).cast("double")).alias("share"))


def average_rank(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Ranks from 1, ties sharing their average, from counts per value: no key's rows are ordered whole."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    w = W.partitionBy(*keys).orderBy(value)
    ranks = counts.withColumn(out, F.sum("_n").over(w) - (F.col("_n") - 1) / 2.0).drop("_n")
    return df.join(ranks, [*keys, value], "left")


def auc(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """Area under the curve by rank sums, a tie counting half."""
    x = average_rank(df, keys, score, "_rank")
    y = F.col(label).cast("boolean")
    ones, zeros = F.count_if(y), F.count_if(~y)
    return x.groupBy(*keys).agg(F.when((ones > 0) & (zeros > 0), (F.sum(F.when(y, F.col("_rank"))) - ones * (ones + 1) / 2.0) / (ones * zeros)).alias("auc"))


def rank_correlation(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, F.col(a).alias("_a"), F.col(b).alias("_b"))
    x = average_rank(average_rank(both, keys, "_a", "_ra"), keys, "_b", "_rb")
    return x.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("_ra", "_rb").alias("ic"))


def information_table(df: DataFrame, keys: list[str], features: list[str], target: str) -> DataFrame:
    """Rank correlation of each feature with the target, by keys."""
    long = df.unpivot([*keys, target], features, "feature", "value")
    return rank_correlation(long, [*keys, "feature"], "value", target)


def trading_metrics(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Trades, win rate, averages, profit factor, total and expectation. trades: net."""
    n, net = F.count("*"), F.col("net")
    gains, losses = F.sum(F.greatest(net, F.lit(0.0))), F.sum(F.least(net, F.lit(0.0)))
    return trades.groupBy(*keys).agg(n.alias("trades"), (F.count_if(net > 0) / n).alias("win_rate"), F.avg(net).alias("ev"), F.sum(net).alias("total"), F.avg(F.when(net > 0, net)).alias("avg_win"), F.avg(F.when(net < 0, net)).alias("avg_loss"), F.when(losses < 0, gains / -losses).alias("profit_factor"))


def equity_metrics(trades: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Largest fall of the running total below its high (which starts at 0) and the longest losing streak."""
    w = W.partitionBy(*keys).orderBy(*order)
    past = w.rowsBetween(W.unboundedPreceding, 0)
    x = trades.withColumn("_e", F.sum("net").over(past)).withColumn("_i", F.sum(F.when(F.col("net") < 0, 0).otherwise(1)).over(past))
    x = x.withColumn("_top", F.greatest(F.lit(0.0), F.max("_e").over(past))).withColumn("_run", F.sum(F.when(F.col("net") < 0, 1).otherwise(0)).over(W.partitionBy(*keys, "_i").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    return x.groupBy(*keys).agg(F.max(F.col("_top") - F.col("_e")).alias("max_drawdown"), F.max("_run").alias("losing_streak"))


def contributions(trades: DataFrame, dimensions: list[str]) -> DataFrame:
    """Net by each dimension and over all, from one pass over grouping sets; `dimension` all reconciles."""
    x = trades.groupingSets([[d] for d in dimensions] + [[]], *dimensions).agg(*[F.grouping(d).alias(f"_g{d}") for d in dimensions], F.sum("net").alias("net"), F.count("*").alias("n"))
    name, value = F.lit("all"), F.lit("all")
    for d in dimensions:
        name, value = F.when(F.col(f"_g{d}") == 0, d).otherwise(name), F.when(F.col(f"_g{d}") == 0, F.col(d).cast("string")).otherwise(value)
    return x.select(name.alias("dimension"), value.alias("member"), "net", "n")


def concentration(parts: DataFrame, keys: list[str], value: str = "net") -> DataFrame:
    """Largest positive part over the total of all parts."""
    return parts.groupBy(*keys).agg(F.when(F.sum(value) > 0, F.max(F.greatest(F.lit(0.0), F.col(value))) / F.sum(value)).alias("concentration"))


def distribution(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, median, worst, best, population deviation and inclusive interquartile range."""
    q = lambda p: F.percentile(value, F.lit(p))
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), q(0.5).alias("median"), F.min(value).alias("worst"), F.max(value).alias("best"), F.stddev_pop(value).alias("deviation"), (q(0.75) - q(0.25)).alias("iqr"))


# Limits of the stability gate.
GATE = {"folds": 5, "share": 0.70, "majority": 0.50, "fold": 0.40, "month": 0.30, "direction": 0.85, "event": 0.40}


def stability_gate(folds: DataFrame, parts: DataFrame) -> DataFrame:
    """One row: valid folds, ratios, concentrations and the reasons against, in order.

    folds: fold, sufficient, test_ev, baseline_ev, test_brier, baseline_brier, test_log_loss,
    baseline_log_loss, net, cost_complete. parts: dimension (month, direction, event, regime,
    target), member, net. With fewer than five sufficient folds that is the only reason.
    """
    ok = folds.where("sufficient")
    ratio = lambda cond: F.count_if(cond) / F.count("*")
    top = F.max(F.greatest(F.lit(0.0), F.col("net")))
    x = ok.agg(
        F.count("*").alias("valid"), F.sum("net").alias("total"), ratio(F.col("test_ev") >= 0).alias("positive"), ratio(F.col("test_ev") > F.col("baseline_ev")).alias("baseline"),
        ratio(F.col("test_brier") <= F.col("baseline_brier")).alias("brier"), ratio(F.col("test_log_loss") <= F.col("baseline_log_loss")).alias("log_loss"), top.alias("_fold"), F.coalesce(F.every("cost_complete"), F.lit(False)).alias("_costs"),
    )
    of = lambda d, f: F.max(F.when(F.col("dimension") == d, f)).alias(f"_{d}")
    worst = lambda d: F.coalesce(F.bool_or((F.col("dimension") == d) & (F.col("net") < 0)), F.lit(False)).alias(f"_bad_{d}")
    p = parts.agg(*[of(d, F.greatest(F.lit(0.0), F.col("net"))) for d in ("month", "direction", "event")], worst("regime"), worst("target"))
    x = x.crossJoin(F.broadcast(p))
    dims = ("fold", "month", "direction", "event")
    x = x.select("*", *[F.when(F.col("total") > 0, F.col(f"_{d}") / F.col("total")).alias(f"{d}_concentration") for d in dims])
    above = lambda d: (f"{d.upper()}_CONCENTRATION_ABOVE_{round(GATE[d] * 100)}_PERCENT", F.coalesce(F.col(f"{d}_concentration") > GATE[d], F.lit(True)))
    why = reasons(
        ("NON_POSITIVE_TOTAL_OUTER_NET_PNL", F.coalesce(F.col("total") <= 0, F.lit(True))), ("NON_NEGATIVE_FOLD_RATIO_BELOW_70_PERCENT", F.col("positive") < GATE["share"]), ("BASELINE_OUTPERFORMANCE_BELOW_70_PERCENT", F.col("baseline") < GATE["share"]),
        ("BRIER_NOT_NONINFERIOR_IN_STRICT_MAJORITY", F.col("brier") <= GATE["majority"]), ("LOG_LOSS_NOT_NONINFERIOR_IN_STRICT_MAJORITY", F.col("log_loss") <= GATE["majority"]), *[above(d) for d in dims],
        ("INCOMPLETE_COST_MODEL", ~F.col("_costs")), ("NEGATIVE_REGIME_CONTRIBUTION", F.col("_bad_regime")), ("NEGATIVE_TARGET_CODE_CONTRIBUTION", F.col("_bad_target")),
    )
    few = F.col("valid") < GATE["folds"]
    return x.select("valid", "total", *[F.when(few, 0.0).otherwise(F.col(k)).alias(k) for k in ("positive", "baseline", "brier", "log_loss")], *[F.when(~few, F.col(f"{d}_concentration")).alias(f"{d}_concentration") for d in dims], F.when(few, F.array(F.lit("FEWER_THAN_FIVE_VALID_OUTER_FOLDS"))).otherwise(why).alias("reasons"))


def matched_control(signals: DataFrame, controls: DataFrame, bucket: list[str], value: str) -> DataFrame:
    """Mean of the controls, weighted by how many signals each bucket has; buckets without controls are left out."""
    s, k = signals.groupBy(*bucket).agg(F.count("*").alias("_w"), F.sum(value).alias("_s")), controls.groupBy(*bucket).agg(F.avg(value).alias("_m"))
    x = s.join(k, bucket)
    return x.agg(F.sum("_w").alias("signals"), (F.sum("_s") / F.sum("_w")).alias("signal_mean"), (F.sum(F.col("_w") * F.col("_m")) / F.sum("_w")).alias("control_mean"))


def seeded_draw(row_id: str | Column, seed: str) -> Column:
    """The same draw on any partitioning and in any engine: 15 hexadecimal digits of an md5 as a number."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), c(row_id).cast("string"))), 1, 15), 16, 10).cast("long")


def sample_controls(moments: DataFrame, keys: list[str], row_id: str, n: int, seed: str) -> DataFrame:
    """n random rows of each key, without replacement."""
    return moments.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(seeded_draw(row_id, seed), row_id))).where(F.col("_r") <= n).drop("_r")


#: A Poisson weight of mean 1 is the number of these that a draw below 65,536 reaches: its distribution function in 65,536ths.
POISSON = [math.floor(65536 * sum(math.exp(-1) / math.factorial(k) for k in range(j + 1))) for j in range(8)]


def resample_sums(rows: DataFrame, by: list[str], value: str, row_id: list[str], resamples: int, seed: str) -> DataFrame:
    """(by, i, weight, total): the sums of each bootstrap resample i, in one aggregate that combines before it shuffles.

    A resample takes each row a Poisson number of times, so that rows need no numbers and no join; eight
    weights come of one hash of the row's id. Reruns agree on any partitioning.
    """
    x = rows.where(F.col(value).isNotNull()).select(*by, F.concat_ws(":", F.lit(seed), *[F.col(n).cast("string") for n in row_id]).alias("_id"), F.col(value).cast("double").alias("_v"))
    x = x.repartition("_id")  # a small file is few tasks' rows, and each is drawn for all resamples
    own = x.select(*by).schema
    drawn = StructType([*own, StructField("i", IntegerType()), StructField("weight", LongType()), StructField("total", DoubleType())])
    bounds = np.array(POISSON)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sums of each batch's groups, all resamples."""
        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys = pa.Table.from_batches([batch]).select(by).append_column("_all", pa.nulls(batch.num_rows, pa.int8())).append_column("_at", pa.array(np.arange(batch.num_rows)))
            groups = keys.group_by([*by, "_all"], use_threads=False).aggregate([("_at", "list")])
            order = groups["_at_list"].combine_chunks()
            starts, places = order.offsets.to_numpy()[:-1] - order.offsets[0].as_py(), order.flatten().to_numpy()
            told = batch["_id"].take(pa.array(places)).dictionary_encode()  # rows of one id share its hashes
            ids, which = [v.encode() for v in told.dictionary.to_pylist()], told.indices.to_numpy()
            v = batch["_v"].to_numpy()[places, None]
            for first in range(0, resamples, 8):
                end = f":{first // 8}".encode()
                u = np.frombuffer(b"".join([hashlib.md5(i + end, usedforsecurity=False).digest() for i in ids]), ">u2").reshape(-1, 8)[:, : resamples - first]
                w = np.searchsorted(bounds, u, side="right")[which]
                weight, total = np.add.reduceat(w, starts, axis=0), np.add.reduceat(w * v, starts, axis=0)
                n = u.shape[1]
                each = np.repeat(np.arange(len(starts)), n)
                columns = [groups[k].combine_chunks().take(pa.array(each)) for k in by]
                numbers = [np.tile(np.arange(first, first + n, dtype=np.int32), len(starts)), weight.ravel(), total.ravel()]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(c) for c in numbers]], names=drawn.names)

    return x.mapInArrow(draw, drawn).groupBy(*by, "i").agg(F.sum("weight").alias("weight"), F.sum("total").alias("total"))


def order_interval(values: DataFrame, by: list[str], value: str, confidence: float = 0.95) -> DataFrame:
    """(by, n, low, high): of n values those at places int(tail n) and int((1 - tail) n) of their order, from 0."""
    tail = (1 - confidence) / 2
    x = values.groupBy(*by).agg(F.array_sort(F.collect_list(value)).alias("_d"))  # a number a resample
    n = F.size("_d")
    at = lambda p: F.get("_d", p.cast("int"))
    return x.select(*by, n.alias("n"), at(F.floor(n * tail)).alias("low"), at(F.least(n - 1, F.floor(n * (1 - tail)))).alias("high"))


def bootstrap_mean(values: DataFrame, value: str, row_id: list[str], resamples: int, seed: str) -> DataFrame:
    """95 percent interval of the mean over resamples of the rows; row_id tells them apart."""
    means = resample_sums(values, [], value, row_id, resamples, seed).where("weight > 0").withColumn("_m", F.col("total") / F.col("weight"))
    return order_interval(means, [], "_m").select(F.col("n").alias("resamples"), "low", "high")


def correlation_groups(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, corr) of each pair of a few columns, over rows that have both."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    return row.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "corr").select(F.split("pair", r"\|")[0].alias("a"), F.split("pair", r"\|")[1].alias("b"), "corr")


def model_thresholds(df: DataFrame, p_trade: str, p_long: str, trade: float, edge: float) -> Column:
    """Signal of a two-stage model: no trade below `trade`, else the side that is likely enough."""
    return F.when(F.col(p_trade) < trade, "NO_TRADE").when(F.col(p_long) >= 0.5 + edge, "LONG").when(F.col(p_long) <= 0.5 - edge, "SHORT").otherwise("NO_TRADE")


def fit_logistic(df: DataFrame, features: Iterable[str], label: str, l2: float, rows: int | None = None):
    """L2 logistic regression at its optimum, by Spark ML; l2 is divided by the rows as its loss is a mean."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    n = rows if rows is not None else df.count()
    fit = LogisticRegression(featuresCol="_x", labelCol=label, regParam=l2 / max(1, n), elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-9, probabilityCol="_p", predictionCol="_y", rawPredictionCol="_r")
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_x"), fit]).fit(df)


def coefficients(model, features: Iterable[str]) -> tuple[float, dict[str, float]]:
    """(intercept, coefficient by feature) of a fit: a number for each feature."""
    fit = model.stages[-1]
    return float(fit.intercept), dict(zip(features, [float(v) for v in fit.coefficients.toArray()], strict=True))


def score_logistic(model, df: DataFrame, out: str, features: Iterable[str]) -> DataFrame:
    """df with the probability of label 1, as an expression of the coefficients: it stays in generated code."""
    base, by_name = coefficients(model, features)
    total = F.lit(base)
    for name, k in by_name.items():
        total = total + F.lit(k) * F.col(name).cast("double")
    return df.withColumn(out, sigmoid(total))


def fit_steps(df: DataFrame, score: str, label: str) -> DataFrame:
    """Isotonic blocks (bound, value): a score is read as the value of the first bound not below it."""
    from pyspark.ml.regression import IsotonicRegression

    model = IsotonicRegression(featuresCol=score, labelCol=label).fit(df.select(F.col(score).cast("double"), F.col(label).cast("double")))
    rows = list(zip(model.boundaries.toArray().tolist(), model.predictions.toArray().tolist(), strict=True))
    return df.sparkSession.createDataFrame(rows, "bound double, value double").groupBy("value").agg(F.max("bound").alias("bound"))


def read_steps(df: DataFrame, steps: DataFrame, score: str, out: str) -> DataFrame:
    """Scores through the steps, which are far fewer than rows; above the last bound its value holds."""
    table = F.broadcast(steps.agg(F.array_sort(F.collect_list(F.struct("bound", "value"))).alias("_steps")))
    x = df.crossJoin(table)
    hit = F.filter("_steps", lambda s: s["bound"] >= F.col(score))
    return x.withColumn(out, F.coalesce(F.get(hit, F.lit(0))["value"], F.element_at("_steps", -1)["value"])).drop("_steps")

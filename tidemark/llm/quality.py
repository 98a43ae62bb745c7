"""Quality classifier: random Fourier features, ridge by normal equations, isotonic calibration.

1. Each whole text gives statistics of its characters, words and lines.
2. Random Fourier features cos(W x + b) of the standardised statistics approximate a Gaussian
   kernel. W and b come from a fixed seed.
3. Each partition of the labelled rows sums its part of the normal equations; the parts are
   added by row of the matrix, and a ridge system of `features` unknowns is solved.
4. Scores of labelled rows that the fit did not see are calibrated by isotonic regression
   over equal-width bins of the raw score (pool adjacent violators), read by interpolation.

Fit and calibration take at most about `max_labelled` labelled rows each, chosen by a hash of
the id; statistics and scores are of all rows. With fewer than two labels the score is the
share of label 1 (0.5 without labels).

Cases: a null text is an empty one and is scored; rows with a null label or a null doc_id don't
train; labels of a doc_id that is labelled twice count twice; repeated rows are scored each;
an empty table gives no rows; other columns are dropped by score_documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SEED, FEATURES, RIDGE, GAMMA, BINS, MAX_LABELLED = 17, 256, 1.0, 0.02, 1000, 200_000
#: Statistics of a text, in order.
STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "long_words", "line_words", "lines_short", "upper", "digit", "space", "ascii_other",
    "high", "stop_marks", "symbols", "bars", "bangs", "distinct_words", "distinct_lines", "top_word", "capital_words", "odd_ends",
    "byte_entropy", "top_bigrams", "repeat_words", "mark_runs",
)

_CLASS = np.zeros(256, np.uint8)  # 1 upper, 2 lower, 3 digit, 4 space, 5 high, 6 .,;:'"-, 7 ! or ?, 8 |, 9 other
_CLASS[:] = 9
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 5
_CLASS[[32, 9, 10, 11, 12, 13]] = 4
_CLASS[[ord(c) for c in ".,;:'\"-"]], _CLASS[[ord(c) for c in "!?"]], _CLASS[ord("|")] = 6, 7, 8


def statistics(text: str | None) -> list[float]:
    """The numbers named in STATISTICS, all finite."""
    data = (text or "").encode()
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    n, n_words, n_lines = max(1, len(data)), max(1, len(words)), max(1, len(lines))
    raw = np.frombuffer(data, np.uint8)
    kinds = np.bincount(_CLASS[raw], minlength=10) / n
    share = np.bincount(raw, minlength=256)
    share = share[share > 0] / n
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    per_line = [x.count(b" ") + 1 for x in lines] or [0]
    distinct = set(words)
    tallies: dict[bytes, int] = {}
    for w in words:
        tallies[w] = tallies.get(w, 0) + 1
    pairs = len(set(zip(words, words[1:], strict=False)))
    ends = sum(not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in b".,;:" for w in words)
    other = (_CLASS[raw] >= 7).astype(np.int8)
    return [
        np.log1p(len(data)),
        np.log1p(len(words)),
        float(sizes.mean()),
        float((sizes > 12).mean()),
        float(np.log1p(np.mean(per_line))),
        sum(x < 4 for x in per_line) / n_lines,
        *(float(kinds[k]) for k in (1, 3, 4, 9, 5, 6)),
        float(kinds[7] + kinds[9]),
        float(kinds[8]),
        float(kinds[7]),
        len(distinct) / n_words,
        len(set(lines)) / n_lines,
        max(tallies.values(), default=0) / n_words,
        sum(w[:1].isupper() for w in words) / n_words,
        ends / n_words,
        float(-(share * np.log2(share)).sum()) if len(share) else 0.0,
        1 - pairs / n_words,
        sum(c > 3 for c in tallies.values()) / max(1, len(distinct)),
        float((other[1:] & other[:-1]).sum() / n) if len(raw) > 1 else 0.0,
    ]


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, stats array<float>) of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.array([statistics(t) for t in batch.column(1).to_pylist()], np.float32).reshape(-1, len(STATISTICS))
            offsets = np.arange(0, flat.size + 1, len(STATISTICS), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.ravel()))], ["doc_id", "stats"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, f"doc_id {docs.schema[id_col].dataType.simpleString()}, stats array<float>")


class Model:
    """What score needs: scaling, the random features, the ridge weights and the calibration."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, features: int, gamma: float, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, spread
        self.turn = rng.normal(scale=np.sqrt(2 * gamma), size=(len(mean), features))
        self.shift = rng.uniform(0, 2 * np.pi, features)
        self.weights = np.zeros(features + 1)
        self.knots, self.values = np.array([0.0, 1.0]), np.array([0.5, 0.5])

    def lift(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.spread, -8, 8)
        z = np.sqrt(2 / len(self.shift)) * np.cos(x @ self.turn + self.shift)
        return np.hstack([z, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.lift(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.knots, self.values)


def isotonic(x: np.ndarray, total: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins (x ascending, rows, rows of label 1): knots and shares."""
    blocks: list[list[float]] = []
    for p, n, k in zip(x, total, ones, strict=True):
        blocks.append([p * n, n, k])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    at = np.array([b[0] / b[1] for b in blocks])
    return at, np.array([(b[2] + 0.5) / (b[1] + 1) for b in blocks])


def _stats(series: pd.Series) -> np.ndarray:
    return np.stack(series.to_numpy()).astype(np.float64) if len(series) else np.zeros((0, len(STATISTICS)))


def fit(train: DataFrame, calibrate: DataFrame, features: int = FEATURES, ridge: float = RIDGE, gamma: float = GAMMA, bins: int = BINS, seed: int = SEED) -> Model:
    """train and calibrate: stats and label (0 or 1, not null). What comes to the driver is of fixed size."""
    width = len(STATISTICS)
    sums = train.agg(F.count("*").alias("n"), F.avg(F.col("label").cast("double")).alias("p"), *[F.avg(F.col("stats")[i].cast("double")).alias(f"m{i}") for i in range(width)], *[F.stddev_pop(F.col("stats")[i].cast("double")).alias(f"s{i}") for i in range(width)]).first()
    model = Model(np.array([sums[f"m{i}"] or 0.0 for i in range(width)]), np.array([sums[f"s{i}"] or 1.0 for i in range(width)]), features, gamma, seed)
    share = 0.5 if sums["p"] is None else sums["p"]
    model.values = np.array([share, share])
    if not 0 < share < 1:
        return model

    def equations(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = np.zeros((features + 1, features + 2))
        for part in parts:
            z, y = model.lift(_stats(part["stats"])), part["label"].to_numpy(np.float64)
            a[:, :-1] += z.T @ z
            a[:, -1] += z.T @ y
        yield pd.DataFrame({"row": np.repeat(np.arange(features + 1), features + 2), "col": np.tile(np.arange(features + 2), features + 1), "x": a.ravel()})

    parts = train.select("stats", "label").mapInPandas(equations, "row int, col int, x double")
    system = np.zeros((features + 1, features + 2))
    for r in parts.groupBy("row", "col").agg(F.sum("x").alias("x")).collect():
        system[r["row"], r["col"]] = r["x"]
    penalty = np.eye(features + 1) * ridge
    penalty[-1, -1] = 1e-6
    model.weights = np.linalg.solve(system[:, :-1] + penalty, system[:, -1])

    def binned(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            at = np.floor(np.clip(model.raw(_stats(part["stats"])), -1, 2) * bins).astype(np.int64)
            yield pd.DataFrame({"bin": at, "n": 1, "ones": part["label"].to_numpy(np.int64)}).groupby("bin", as_index=False).sum()

    table = calibrate.select("stats", "label").mapInPandas(binned, "bin long, n long, ones long").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).toPandas().sort_values("bin")
    if len(table):
        model.knots, model.values = isotonic((table["bin"].to_numpy() + 0.5) / bins, table["n"].to_numpy(float), table["ones"].to_numpy(float))
    return model


def fold(id_col: Column) -> Column:
    """The fold of a row: crc32 of its id as text, modulo 3; fold 1 is held out."""
    return F.crc32(id_col.cast("string")) % 3


def _training_rows(labels: DataFrame, label_col: str, id_col: str, max_labelled: int) -> DataFrame:
    """(_id, label) of folds 0 and 2: all of them, or about 2 * max_labelled by a hash of the id."""
    labelled = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label"))
    rows = labelled.where(fold(F.col("_id")) != 1)
    part = min(1.0, 2.0 * max_labelled / max(1, rows.count()))
    return rows.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int(part * (1 << 30))) if part < 1 else rows


def _fit_known(known: DataFrame) -> Model:
    return fit(known.where(fold(F.col("doc_id")) == 0), known.where(fold(F.col("doc_id")) == 2))


def _scores(model: Model, column: pa.Array) -> np.ndarray:
    return model.score(column.flatten().to_numpy().reshape(-1, len(STATISTICS)).astype(np.float64))


def score_documents(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Rows of fold 0 fit the ridge weights, rows of fold 2 calibrate, rows of fold 1 do neither.
    """
    stats = written(describe(docs, id_col, text_col), "statistics")
    rows = _training_rows(labels, label_col, id_col, max_labelled)
    known = written(stats.join(rows, F.col("doc_id") == F.col("_id")).select("doc_id", "stats", "label"), "labelled")
    shared = docs.sparkSession.sparkContext.broadcast(_fit_known(known))  # of fixed size

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = _scores(shared.value, batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got), pa.array((got >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out")
    return stats.select(F.col("doc_id").cast("long"), held, "stats").mapInArrow(work, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED, least: float = 0.5) -> DataFrame:
    """The rows of docs that score at least `least`, with all their columns; texts are not moved.

    The training rows are broadcast if they are at most 4 * max_labelled pairs of numbers, as they
    are by their hash unless an id has very many labels; else Spark picks the join.
    """
    rows = _training_rows(labels, label_col, id_col, max_labelled)
    rows = F.broadcast(rows) if rows.count() <= 4 * max_labelled else rows
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    some = slim.join(rows, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "label")
    known = written(describe(some.select(F.struct("doc_id", "label").alias("doc_id"), "text")).select("doc_id.doc_id", "stats", "doc_id.label"), "labelled")
    shared = docs.sparkSession.sparkContext.broadcast(_fit_known(known))  # of fixed size

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                flat = np.array([statistics(t) for t in batch.column(at).to_pylist()], np.float32)
                yield batch.filter(pa.array(shared.value.score(flat.astype(np.float64)) >= least))

    at = docs.columns.index(text_col)
    return docs.mapInArrow(work, docs.schema)

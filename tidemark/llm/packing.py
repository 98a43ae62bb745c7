"""Best-fit packing by minimum bin slack.

Each text becomes token ids and an end id; only what is longer than a sequence is cut. What
fits together depends on lengths alone, so the plan is made from the histogram of lengths,
which has at most `capacity` rows however many texts there are: for a bin, a bitset subset-sum
dynamic programme over the lengths that are left finds the fullest combination, and that is
removed as often as the counts allow. Repeats of a combination are what one bin after the
other would find, as removing pieces never makes a fuller one. The r-th piece of a length then
finds its sequence and its offset in the plan; ranks within a length come from counts by
(length, bucket), so that no length is ranked in one task.

Cases: a null text is an empty one, of one end id; a null doc_id is kept; equal rows are
packed each by itself; an empty table gives no rows; other columns are dropped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written
from .tokens import default_tokenizer, encoder

CAPACITY, END_ID = 2048, 0
#: Texts of one encoding call, in rows of an Arrow batch.
_ROWS = 2000
#: Rows of one (length, bucket) cell that are ranked together, about.
CELL_ROWS = 50_000


def cut_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, ids_as: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32) and the columns `keep` as _kept_0 and so on.

    ids_as: "<u2" or "<u4" adds the binary column ids, of little-endian numbers.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for whole in batches:
            for at in range(0, max(1, whole.num_rows), _ROWS):
                batch = whole.slice(at, _ROWS)
                ids = [np.append(x, np.uint32(end_id)) for x in enc.encode([t or "" for t in batch.column(1).to_pylist()])]
                pieces = [(row, k, s, x[s : s + capacity]) for row, x in enumerate(ids) for k, s in enumerate(range(0, len(x), capacity))]
                rows = pa.array([p[0] for p in pieces], pa.int64())
                cols = [batch.column(0).take(rows), pa.array([p[1] for p in pieces], pa.int32()), pa.array([p[2] for p in pieces], pa.int64()), pa.array([len(p[3]) for p in pieces], pa.int64())]
                cols.append(pa.array([zlib.crc32(p[3].astype("<u4").tobytes()) for p in pieces], pa.int64()))
                if ids_as:
                    cols.append(pa.array([p[3].astype(ids_as).tobytes() for p in pieces], pa.binary()))
                cols += [c.take(rows) for c in batch.columns[2:]]
                yield pa.RecordBatch.from_arrays(cols, names)

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(f"_kept_{i}") for i, c in enumerate(keep)])
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * bool(ids_as)
    schema += "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[2:])
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * bool(ids_as), *chosen.columns[2:]]
    return chosen.mapInArrow(cut, schema)


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Of the available lengths the combination that leaves the least of a bin, long ones first."""
    lengths = sorted(n for n, c in counts.items() if c)
    reach, after = 1, []
    mask = (1 << capacity + 1) - 1
    for n in lengths:
        left, step = min(counts[n], capacity // n), 1
        while left:
            now = min(step, left)
            reach |= reach << n * now & mask
            left, step = left - now, step * 2
        after.append(reach)
    fill, taken = reach.bit_length() - 1, {}
    for i in range(len(lengths) - 1, -1, -1):
        n, below, most = lengths[i], after[i - 1] if i else 1, min(counts[lengths[i]], capacity // lengths[i])
        # as many of this long length as leave what the shorter ones can fill
        k = next(k for k in range(min(most, fill // n), -1, -1) if below >> fill - n * k & 1)
        if k:
            taken[n], fill = k, fill - n * k
    return taken


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length its runs (first rank, pieces a bin, first sequence, offset in the bin), by rank.

    The number of runs depends on capacity only: each combination leaves a length with fewer
    pieces than it takes, and of a length at most capacity / length fit.
    """
    counts, sequence = dict(histogram), 0
    used: dict[int, int] = dict.fromkeys(counts, 0)
    plan: dict[int, list[tuple[int, int, int, int]]] = {n: [] for n in counts}
    if full := counts.get(capacity, 0):
        plan[capacity].append((0, 1, 0, 0))
        counts[capacity], sequence = 0, full
    while any(counts.values()):
        taken, offset = fullest(counts, capacity), 0
        bins = min(counts[n] // k for n, k in taken.items())
        for n, k in taken.items():
            plan[n].append((used[n], k, sequence, offset))
            used[n] += k * bins
            counts[n] -= k * bins
            offset += n * k
        sequence += bins
    return plan


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (with doc_id, piece, start, length, ids_crc32) with sequence_id and offset; no length over capacity.

    pieces must be cheap to read twice, for instance a written table.
    """
    spark = pieces.sparkSession
    cell = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(1 << 20))
    counted = pieces.groupBy("length", cell.alias("cell")).agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    plan = plan_bins(histogram, capacity)
    spread = max(1, -(-max(histogram.values(), default=0) // CELL_ROWS))
    cells = max(64, 1 << (spread - 1).bit_length() + 2)

    pieces = pieces.withColumn("_cell", cell % cells)
    first = (
        counted.groupBy("length", (F.col("cell") % cells).alias("_cell"))
        .agg(F.sum("n").alias("n"))
        .withColumn("_first", F.sum("n").over(W.partitionBy("length").orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)))
        .select("length", "_cell", F.coalesce("_first", F.lit(0)).alias("_first"))
    )
    order = W.partitionBy("length", "_cell").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = pieces.withColumn("_rank", F.row_number().over(order) - 1).join(first, ["length", "_cell"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_first")).drop("_cell", "_first")

    runs = {n: tuple(np.array(x, np.int64).T) for n, x in plan.items() if x}
    shared = spark.sparkContext.broadcast(runs)  # a bounded number of runs, see plan_bins

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                begin, each, seq, off = shared.value[int(n)]
                run = np.searchsorted(begin, rank[at], "right") - 1
                inside = rank[at] - begin[run]
                sequence[at] = seq[run] + inside // each[run]
                offset[at] = off[run] + inside % each[run] * n
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    kept = [c for c in ranked.columns if c != "_rank"]
    kinds = {f.name: f.dataType.simpleString() for f in ranked.schema.fields}
    return ranked.mapInArrow(place, ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, ids_as: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, and _kept_0... for `keep`)."""
    pieces = written(cut_documents(docs, tokenizer or default_tokenizer(), capacity, end_id, ids_as, keep=keep), "pieces")
    out = pack_pieces(pieces, capacity)
    front = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return out.select(*front, *[c for c in out.columns if c not in front])

"""Product codes of vectors by exact integer k-means over Hilbert-sorted blocks.

A vector's components become integers and are cut into equal parts; each part position has a
codebook. The points of a position are sorted along a Hilbert curve and laid down in blocks of
neighbours, once, each with the box and the sum of its points. A round sends the codebooks (a few
thousand numbers) to the blocks: distances between box and entries leave a short list of entries
that may be nearest to some point; a block with one such entry adds its sum as a whole, the others
compare their points with the short list only, in whole numbers. Tasks send sums of entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, written

#: Points of a block, and points that a task holds while it cuts blocks.
BLOCK_POINTS, HELD_POINTS = 256, 65_536
#: Bits of the Hilbert curve per component.
CURVE_BITS = 7
#: Rows of one partition of blocks, about.
PARTITION_POINTS = 200_000


def hilbert_keys(cells: np.ndarray, bits: int = CURVE_BITS) -> np.ndarray:
    """Places on the Hilbert curve of points with whole coordinates in [0, 2**bits) (Skilling's transform, 2004)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    level = 1 << (bits - 1)
    while level > 1:
        below = level - 1
        for i in range(n):
            flip = (x[i] & level) > 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & below)
            x[0] = np.where(flip, x[0] ^ below, x[0] ^ swap)
            x[i] ^= swap
        level >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    level = 1 << (bits - 1)
    while level > 1:
        turn = np.where((x[n - 1] & level) > 0, turn ^ (level - 1), turn)
        level >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def short_lists(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """(blocks, entries): whether an entry may be nearest to a point of the box [low, high].

    An entry stays unless its least squared distance to the box is over another's greatest one; ties stay.
    """
    e = entries[None]
    gap = np.maximum(np.maximum(low[:, None] - e, e - high[:, None]), 0)
    reach = np.maximum(np.abs(e - low[:, None]), np.abs(high[:, None] - e))
    return (gap * gap).sum(2) <= (reach * reach).sum(2).min(1)[:, None]


def nearest(points: np.ndarray, entries: np.ndarray, listed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each point the listed entry with the least squared distance, the first of equals, and that distance."""
    which = np.flatnonzero(listed)
    gap = points[:, None] - entries[which][None]
    distance = (gap * gap).sum(2)
    best = distance.argmin(1)
    return which[best], distance[np.arange(len(points)), best]


def usable(vector: Column, size: int | None) -> Column:
    """No null or non-finite component, and `size` components; a null vector is not usable."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & fine & ((F.size(vector) == size) if size else F.lit(True)), F.lit(False))


def _integers(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def first_entries(vectors: DataFrame, parts: int, entries: int) -> np.ndarray:
    """(parts, entries, size): the parts of the smallest ids, equal ids by their components; fewer rows give fewer entries."""
    rows = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    return np.array([r.v for r in rows], np.int64).reshape(len(rows), parts, -1).transpose(1, 0, 2)


def blocks_of(vectors: DataFrame, parts: int, spread: list[tuple[int, int]], rows: int) -> DataFrame:
    """Blocks of neighbours on the curve, each of one part position: part, n, low, high, total, points, keys.

    vectors: uid, v (whole numbers). Equal points are told apart by uid in the sort, so no place of the
    curve meets in one task. points and keys are little-endian 64-bit numbers.
    """
    size = len(spread) // parts
    low = np.array([s[0] for s in spread], np.int64).reshape(parts, size)
    width = np.array([s[1] - s[0] for s in spread], np.int64).reshape(parts, size)
    bits = max(1, min(CURVE_BITS, 62 // size))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid = np.asarray(batch.column(0))
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(uid), parts, size)
            cells = ((v - low) << bits) // (width + 1)
            for p in range(parts):
                # a curve over more components than the key has bits takes the first ones
                key = hilbert_keys(cells[:, p, : 62 // bits], bits)
                points = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * size), len(uid), [None, pa.py_buffer(np.ascontiguousarray(v[:, p]).tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(uid), p, np.int32)), pa.array(key), pa.array(uid), points.cast(pa.binary())], ["part", "key", "uid", "point"])

    def block(part: int, points: np.ndarray, uid: np.ndarray) -> dict:
        return {"part": part, "n": len(points), "low": points.min(0), "high": points.max(0), "total": points.sum(0), "points": points.tobytes(), "keys": uid.tobytes()}

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(part: int, points: np.ndarray, uid: np.ndarray) -> pa.RecordBatch:
            made = [block(part, points[i : i + BLOCK_POINTS], uid[i : i + BLOCK_POINTS]) for i in range(0, len(points), BLOCK_POINTS)]
            columns = [pa.array([m["part"] for m in made], pa.int32()), pa.array([m["n"] for m in made], pa.int32())]
            columns += [pa.array([m[k].tolist() for m in made], pa.list_(pa.int64())) for k in ("low", "high", "total")]
            columns += [pa.array([m[k] for m in made], pa.binary()) for k in ("points", "keys")]
            return pa.RecordBatch.from_arrays(columns, ["part", "n", "low", "high", "total", "points", "keys"])

        held: tuple[int, np.ndarray, np.ndarray] | None = None
        for batch in batches:
            part, uid = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            points = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<i8").reshape(len(uid), size)
            for p in np.unique(part):
                at = part == p
                if held and held[0] == p:
                    held = (p, np.concatenate([held[1], points[at]]), np.concatenate([held[2], uid[at]]))
                else:
                    if held:
                        yield told(*held)
                    held = (p, points[at], uid[at])
                if len(held[1]) >= HELD_POINTS:
                    yield told(*held)
                    held = None
        if held:
            yield told(*held)

    points = vectors.select("uid", "v").mapInArrow(cut, "part int, key long, uid long, point binary")
    laid = points.repartitionByRange(max(1, -(-rows * parts // PARTITION_POINTS)), "part", "key", "uid").sortWithinPartitions("part", "key", "uid")
    whole = "array<bigint>"
    return laid.select("part", "uid", "point").mapInArrow(lay, f"part int, n int, low {whole}, high {whole}, total {whole}, points binary, keys binary")


def _blocks(batch: pa.RecordBatch, names: list[str], size: int) -> Iterator[tuple]:
    """Part by part: its number, places in the batch, and low, high and total of its blocks."""
    part = np.asarray(batch.column(names.index("part")))
    boxes = [batch.column(names.index(k)).flatten().to_numpy().reshape(-1, size) for k in ("low", "high", "total")]
    for p in np.unique(part):
        at = np.flatnonzero(part == p)
        yield int(p), at, *(b[at] for b in boxes)


def round_of(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each entry the floor of its points' mean; entries without points stay."""
    parts, entries, size = books.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, size), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            number, stored = np.asarray(batch.column(1)), batch.column(5)
            for p, at, low, high, total in _blocks(batch, ["part", "n", "low", "high", "total"], size):
                listed = short_lists(low, high, books[p])
                alone = listed.sum(1) == 1
                one = listed[alone].argmax(1)
                np.add.at(sums[p], one, total[alone])
                np.add.at(counts[p], one, number[at[alone]])
                for k in np.flatnonzero(~alone):
                    points = np.frombuffer(stored[int(at[k])].as_py(), "<i8").reshape(-1, size)
                    found, _ = nearest(points, books[p], listed[k])
                    np.add.at(sums[p], found, points)
                    counts[p] += np.bincount(found, minlength=entries)
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), pa.array(sums[p, e].tolist(), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    made = blocks.select("part", "n", "low", "high", "total", "points").mapInArrow(add, "part int, entry int, n long, sums array<bigint>")
    total = made.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(size)])
    out = books.copy()
    for r in total.collect():  # one row an entry of a codebook
        out[r.part, r.entry] = [int(r[f"s{i}"]) // int(r.n) for i in range(size)]
    return out


def assigned(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """(uid, part, code, error) of every point, by the same short lists."""
    size = books.shape[2]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, at, low, high, _ in _blocks(batch, ["part", "n", "low", "high", "total"], size):
                listed = short_lists(low, high, books[p])
                for k, i in enumerate(at):
                    points = np.frombuffer(batch.column(5)[int(i)].as_py(), "<i8").reshape(-1, size)
                    code, error = nearest(points, books[p], listed[k])
                    uid = np.frombuffer(batch.column(6)[int(i)].as_py(), "<i8")
                    yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(np.full(len(uid), p, np.int32)), pa.array(code.astype(np.int32)), pa.array(error)], ["uid", "part", "code", "error"])

    return blocks.select("part", "n", "low", "high", "total", "points", "keys").mapInArrow(assign, "uid long, part int, code int, error long")


def _numbered(vectors: DataFrame) -> DataFrame:
    """Adds uid, a number of its own for each row, in the order the rows are met."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 36
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(uid, uid + batch.num_rows)), *batch.columns], ["uid", *batch.schema.names])
            uid += batch.num_rows

    return vectors.mapInArrow(number, "uid long, vec_id long, label long, v array<bigint>")


def compress_vectors(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """Per vector: vec_id, code, error, label_error, codebooks_sha256.

    vectors: vec_id, embedding, label; other columns are not read, whatever their names. Left out are rows
    whose vector is null or holds a null or non-finite component, and rows of another length than the
    smallest kept id's (vectors of two lengths have no common parts); empty vectors have codes of zeros.
    Equal rows give a row each, and ids of equal rows are taken as starting entries as often as they come.
    Null labels are one label. An empty table gives an empty table. Numbers are exact: ValueError if
    components are so large that a squared distance could leave 64 bits, or the length is no multiple of `parts`.
    """
    kept = vectors.where(usable(F.col("embedding"), None)).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), F.size("embedding")).select(F.size("embedding")).first()
    length = first[0] if first else 0
    if length % parts:
        raise ValueError(f"vectors of {length} components can't be cut into {parts} equal parts")
    with scratch() as made:
        numbered = written(_numbered(kept.where(F.size("embedding") == length).withColumn("v", _integers(F.col("embedding"), scale)).drop("embedding")), "vectors")
        size = length // parts
        if size:
            rows, *ends = numbered.agg(F.count(F.lit(1)), *[f(F.col("v")[i]) for i in range(length) for f in (F.min, F.max)]).first()
            spread = [(ends[2 * i] or 0, ends[2 * i + 1] or 0) for i in range(length)]
            reach = max([abs(x) for s in spread for x in s], default=0)
            if length * (2 * reach + 1) ** 2 >= 2**63:
                raise ValueError("components are too large for exact distances of 64 bits")
            books = first_entries(numbered, parts, entries)
            blocks = written(blocks_of(numbered, parts, spread, rows), "blocks")
            for _ in range(rounds):
                books = round_of(blocks, books)
            found = assigned(blocks, books)
        else:
            books = np.zeros((parts, 0, 0), np.int64)
            found = numbered.select("uid", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("code"), F.lit(0).cast("long").alias("error"))
        digest = sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
        digits = F.transform(F.array_sort(F.collect_list(F.struct("part", "code"))), lambda x: F.lower(F.lpad(F.hex(x["code"]), 2, "0")))
        coded = found.groupBy("uid").agg(F.array_join(digits, "").alias("code"), F.sum("error").alias("error"))
        coded = written(numbered.select("uid", "vec_id", "label").join(coded, "uid"), "codes")
        made.remove(coded)
    by_label = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    met = coded.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return met.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))

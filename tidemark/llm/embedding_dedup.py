"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors are rotated by a signed Hadamard transform, which spreads every vector over all
coordinates, and cut into blocks. cos >= c means a squared distance of at most 2 - 2 c; if each
block has a share of that budget in proportion to its width, a linked pair keeps to it in one
block at least. So each block is range-joined by a grid over its first coordinates: a vector is
at home in one cell and visits the cells within its radius. A pair counts in the first block
whose budget it keeps, where the cosine is computed in double precision; each end counts it in
its own home cell. Tasks give sums and spanning edges, never pairs.

Exactly equal vectors are one class before the join. A cell of over `tile_rows` rows is dealt
into tiles of about that many, and every two tiles meet in a task of their own, so a task holds
about 2 * tile_rows rows whatever the size of a cell. A cell of n rows sends n * n / tile_rows
rows to its tasks: near copies that aren't equal still cost the square of their number.
All arithmetic that decides where a pair counts goes coordinate by coordinate, so it does not
depend on how rows are batched.

Cases: a vector that is null, zero, or holds null or non-finite parts, or has no label or no id,
links with nothing (a null id has a null component and is not kept); vectors of different
lengths don't link; repeated rows are vectors of their own; an empty table gives no rows;
other columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, written

MIN_COS, BLOCKS, GRID, TILE_ROWS, SEED = 0.98, 8, 2, 4096, 5
_PAIRS = 100_000
#: Cells to be cut into tiles that are broadcast; more are joined by a shuffle.
FEW_CELLS = 20_000


def _unpack(raw: list[bytes], kind: str) -> np.ndarray:
    """Coordinates by rows: (parts, vectors), in double precision."""
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).T.astype(np.float64)


def _norm(x: np.ndarray) -> np.ndarray:
    total = np.zeros(x.shape[1])
    for part in x:
        total += part * part
    return np.sqrt(total)


def rotate(x: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Unit vectors of x, (parts, vectors), after random signs and a Hadamard transform of the next power of two."""
    size = 1 << max(0, x.shape[0] - 1).bit_length()
    y = np.zeros((size, x.shape[1]))
    y[: x.shape[0]] = x / _norm(x)
    y *= np.random.default_rng(seed).choice([-1.0, 1.0], size)[:, None]
    step = 1
    while step < size:
        z = y.reshape(size // (2 * step), 2, step, -1)
        y = np.stack([z[:, 0] + z[:, 1], z[:, 0] - z[:, 1]], 1).reshape(size, -1)
        step *= 2
    return y / np.sqrt(size)


class Blocks:
    """How a rotated vector of a size is cut, and the squared distance each block may use."""

    def __init__(self, size: int, min_cos: float, blocks: int) -> None:
        cuts = np.linspace(0, size, min(blocks, size) + 1).astype(int)
        self.parts = [slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
        self.budget = [(2 - 2 * min_cos + 1e-9) * (p.stop - p.start) / size for p in self.parts]


def _cells(y: np.ndarray, part: slice, budget: float, grid: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(cell, which vectors, at home?) for a block: the home cells, then those a vector's radius reaches."""
    radius = np.sqrt(budget) * (1 + 1e-9) + 1e-12
    axes = y[part][:grid]
    width = 2 * radius
    home = np.floor(axes / width).astype(np.int64) + 512
    low, high = np.floor((axes - radius) / width).astype(np.int64) + 512, np.floor((axes + radius) / width).astype(np.int64) + 512
    code = lambda c: sum(v << 10 * i for i, v in enumerate(c))
    yield code(home), np.arange(y.shape[1]), True
    for turn in range(3 ** len(axes)):
        move = np.array([turn // 3**i % 3 - 1 for i in range(len(axes))])[:, None]
        there = home + move
        if move.any():
            at = np.flatnonzero(((there >= low) & (there <= high)).all(0))
            yield code(there[:, at]), at, False


def _join_cell(x: np.ndarray, ids: np.ndarray, weight: np.ndarray, home: np.ndarray, tile: np.ndarray, block: int, cut: Blocks, min_cos: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each home vector that count in this block, and the (a, b) of a spanning forest.

    Vectors of one tile meet each other; those of two tiles meet the other tile's only.
    """
    y = rotate(x)
    norm = _norm(x)
    flat = y[cut.parts[block]].astype(np.float32)
    square = (flat * flat).sum(0)
    links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
    tiles = np.unique(tile)
    sides = [(np.flatnonzero(home & (tile == t)), np.flatnonzero(tile == u)) for t, u in zip(tiles, tiles[::-1], strict=True)]
    edges = []
    step = max(1, 4_000_000 // len(ids))
    for mine, others in ((at_home[s : s + step], others) for at_home, others in sides for s in range(0, len(at_home), step)):
        near = square[mine][:, None] + square[others] - 2 * (flat[:, mine].T @ flat[:, others]) <= cut.budget[block] + 1e-5
        left, right = np.nonzero(near)
        left, right = mine[left], others[right]
        keep = left != right
        left, right = left[keep], right[keep]
        for t in range(0, len(left), _PAIRS):
            i, j = left[t : t + _PAIRS], right[t : t + _PAIRS]
            for b in range(block, -1, -1):
                total = np.zeros(len(i))
                for row in y[cut.parts[b]]:
                    total += (row[i] - row[j]) ** 2
                ok = (total <= cut.budget[b]) == (b == block)
                i, j = i[ok], j[ok]
            dot = np.zeros(len(i))
            for row in x:
                dot += row[i] * row[j]
            ok = dot / (norm[i] * norm[j]) >= min_cos
            i, j = i[ok], j[ok]
            np.add.at(links, i, weight[j])
            if len(i):
                edges.append(np.stack([i, j]))
        if edges:
            # hook roots until nothing moves; what is left of many pairs is one edge a vector
            a, b = np.hstack(edges)
            while True:
                low = np.minimum(root[a], root[b])
                new = root.copy()
                np.minimum.at(new, root[a], low)
                np.minimum.at(new, root[b], low)
                new = new[new]
                if (new == root).all():
                    break
                root = new
            edges = []
    moved = np.flatnonzero(root != np.arange(len(ids)))
    return links, np.stack([ids[moved], ids[root[moved]]], 1)


def in_tiles(rows: DataFrame, region: list[str], tile_rows: int) -> DataFrame:
    """Each row once for each tile of its cell: tile is its own, first and second are the two that meet."""
    large = rows.groupBy(*region).agg(F.count("*").alias("n")).where(F.col("n") > tile_rows).withColumn("tiles", F.ceil(F.col("n") / tile_rows).cast("int")).drop("n")
    large = written(large, "large")
    few = large.count() <= FEW_CELLS  # else both sides are shuffled
    rows = rows.join(F.broadcast(large) if few else large, region, "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("rep", "raw"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return rows.withColumns({"first": F.least("tile", "other"), "second": F.greatest("tile", "other")}).drop("tiles", "other")


def dedup_embeddings(vectors: DataFrame, min_cos: float = MIN_COS, blocks: int = BLOCKS, grid: int = GRID, tile_rows: int = TILE_ROWS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept."""

    # single-precision vectors are moved as such; all arithmetic is in double precision
    kind = "<f4" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"
    bytes_each = np.dtype(kind).itemsize

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws, keys = [], []
            for vec, label, vec_id in zip(*(batch.column(i).to_pylist() for i in (1, 2, 0)), strict=True):
                raw = None
                if vec and label is not None and vec_id is not None and None not in vec:
                    x = np.array(vec, "<f8")
                    with np.errstate(over="ignore"):
                        if np.isfinite(x).all() and 0 < (norm := _norm(x[:, None])[0]) < np.inf:
                            raw = x.astype(kind).tobytes()
                        elif np.isfinite(x).all() and x.any():  # so large or small that its square leaves the range
                            raw = (x / np.abs(x).max()).astype(kind).tobytes()
                raws.append(raw)
                keys.append(raw and hashlib.blake2b(raw + repr(label).encode(), digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(keys, pa.binary()), pa.array(raws, pa.binary())], ["vec_id", "label", "key", "raw"])

    chosen = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vec"), F.col(label_col).cast("string").alias("label"))
    packed = written(chosen.mapInArrow(pack, "vec_id long, label string, key binary, raw binary"), "vectors")
    classes = packed.where("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("raw").alias("raw"))
    # a row number that repeats of a vec_id don't share: classes with the same smallest vec_id stay apart
    classes = written(classes, "classes")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(v) for v in batch.column("raw").to_pylist()], np.int64)
            for size in np.unique(sizes):
                part = batch.take(pa.array(np.flatnonzero(sizes == size)))
                y = rotate(_unpack(part.column("raw").to_pylist(), kind))
                cut = Blocks(len(y), min_cos, blocks)
                for b, (span, budget) in enumerate(zip(cut.parts, cut.budget, strict=True)):
                    for cell, at, home in _cells(y, span, budget, grid):
                        rows = part.take(pa.array(at))
                        same = lambda v, t, n=len(at): pa.array(np.full(n, v), t)
                        yield pa.RecordBatch.from_arrays([rows.column("label"), same(size // bytes_each, pa.int32()), same(b, pa.int32()), pa.array(cell), same(home, pa.bool_()), rows.column("rep"), rows.column("weight"), rows.column("raw")], names)

    names = ["label", "size", "block", "cell", "home", "rep", "weight", "raw"]
    region = ["label", "size", "block", "cell"]
    rows = classes.select("label", "rep", "weight", "raw").mapInArrow(spread, "label string, size int, block int, cell long, home boolean, rep long, weight long, raw binary")
    rows = in_tiles(rows, region, tile_rows)
    region = [*region, "first", "second"]
    rows = rows.repartition(*region).sortWithinPartitions(*region)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(table: pa.Table) -> pa.RecordBatch:
            x = _unpack(table.column("raw").to_pylist(), kind)
            home = table.column("home").to_numpy(zero_copy_only=False)
            ids, weight, tile = (table.column(c).to_numpy() for c in ("rep", "weight", "tile"))
            if table.column("first")[0].as_py() != table.column("second")[0].as_py() and (tile == tile[0]).all():
                return pa.RecordBatch.from_pylist([], pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())]))
            cut = Blocks(1 << max(0, len(x) - 1).bit_length(), min_cos, blocks)
            links, forest = _join_cell(x, ids, weight, home, tile, table.column("block")[0].as_py(), cut, min_cos)
            got = np.flatnonzero(links)
            a = np.concatenate([ids[got], forest[:, 0]])
            b = np.concatenate([np.zeros(len(got), np.int64), forest[:, 1]])
            n = np.concatenate([links[got], np.zeros(len(forest), np.int64)])
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], ["a", "b", "n"])

        # regions come one after the other; one ends where any of its columns changes
        pending: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in region), strict=True))
            begin = 0
            for i, key in enumerate(keys):
                if key != last:
                    if last is not None:
                        pending.append(batch.slice(begin, i - begin))
                        table = pa.Table.from_batches(pending)
                        if table.num_rows > 1:
                            yield solve(table)
                    pending, begin, last = [], i, key
            pending.append(batch.slice(begin))
        if last is not None and (table := pa.Table.from_batches(pending)).num_rows > 1:
            yield solve(table)

    found = written(rows.mapInArrow(join, "a long, b long, n long"), "links")
    links = found.where("n > 0").groupBy("a").agg(F.sum("n").alias("links"))
    comps = components(found.where("n = 0").select("a", "b"))
    per_class = (
        classes.select("key", "rep", "weight")
        .join(links, F.col("rep") == F.col("a"), "left")
        .join(comps, F.col("rep") == F.col("node"), "left")
        .select("key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    out = packed.select("vec_id", "key").join(per_class, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))

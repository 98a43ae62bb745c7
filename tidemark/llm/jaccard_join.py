"""N-gram Jaccard join: documents linked by the Jaccard similarity of their word shingles, exactly.

Jaccard distance is a metric, but texts that have nothing in common are all at distance 1, so a
pivot alone does not part a corpus. Regions are therefore begun where they tell something:

1. Texts of equal shingle sets are one class.
2. Of a set of n shingles, n - ceil(c n) + 1 stand for it: similar sets share one of them in
   any common order. The order is by hash, with shingles that very many sets would choose put
   last. The classes that share such a shingle are a region.
3. Each region has a pivot, its least class, and every class is compared with the pivot. Large
   regions that are still in several components meet further pivots: a region of near copies
   becomes one component with a few pairs a member, however large it is.
4. Where members of a region are in different components, the region is joined recursively:
   pivots, a Voronoi cell for each, members within the triangle inequality's window of a cell
   boundary given to both cells, until a cell is small. Cells of over CELL_BYTES are cut by a
   shuffle of their own each time; those that pivots don't part are dealt into tiles, every two
   of which meet in a task; so a task holds about CELL_BYTES, whatever the size of a region. The metric is the Hamming distance of
   parity bitmaps, never above the symmetric difference of the sets, which is at most
   (1 - c) / (1 + c) of the sum of their sizes for linked sets; so no link is lost.
5. Pairs that pass the bitmaps are compared by their whole shingle sets: in large regions first
   a forest of them, so that near copies become one component by a pair a member, then all
   that are still in different components.
6. Components by label minima (common.components).

Cases: a null text or one without words has no shingles and links with nothing; fewer words
than a shingle make one shingle of all words; rows of a null doc_id take part, but name no
component (null if no other id is reachable); equal rows are one class; an empty table gives
no rows; other columns are dropped. Only A-Z is lower-cased; words are as in common.WORD.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, fresh, written
from .windows import BASES, Ranges, Texts, batches_of, mix

WORDS, PERCENT = 5, 75
#: A shingle that more classes would choose goes last in the order; at most so many do (8 bytes each are broadcast).
HOT, MOST_HOT = 16, 1_000_000
#: Regions up to this many classes list their pairs; larger ones, and cells above it, are cut by pivots.
SMALL = 64
#: Further pivots that large regions in several components meet before they are cut.
PIVOTS = 2
#: How often, at most, the components of large regions are joined by forests of pairs before all pairs left are listed.
FORESTS = 2
#: Bytes of bitmaps of the members of a cell that meet in one task, about; pivots of a larger cell, and how often it is cut.
CELL_BYTES, CELL_PIVOTS, CUTS = 4 << 20, 8, 6


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """The set of shingle hashes of each text, sorted."""
    seq = Texts(texts)
    hashes, _, _, at = seq.words(lower=True)
    ranges = Ranges(hashes)
    every = ranges.sliding(words)
    out = []
    for lo, hi in zip(at[:-1], at[1:], strict=True):
        if hi - lo >= words:
            out.append(np.unique(every[lo : hi - words + 1]))
        else:
            out.append(ranges.of(np.array([lo]), np.array([hi])) if hi > lo else np.zeros(0, np.uint64))
    return out


def prefix_of(shingles: np.ndarray, hot: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The shingles that stand for a set: the first in order, hot ones last."""
    n = len(shingles)
    most = n + percent * -n // 100 + 1  # n - ceil(percent n / 100) + 1
    if len(hot) and n:
        at = np.minimum(np.searchsorted(hot, shingles), len(hot) - 1)
        is_hot = hot[at] == shingles
        shingles = np.concatenate([shingles[~is_hot], shingles[is_hot]])
    return shingles[:most] if n else shingles


def bitmap_of(shingles: np.ndarray) -> bytes:
    """Parity bits: 2048, or for large sets the next power of two above twice the size."""
    bits = max(2048, 1 << min(20, (2 * len(shingles) - 1).bit_length())) if len(shingles) else 2048
    ones = np.bincount((shingles >> np.uint64(20)).astype(np.int64) & bits - 1, minlength=bits) & 1
    return np.packbits(ones.astype(np.uint8), bitorder="little").tobytes()


def fold(bitmap: np.ndarray, size: int) -> np.ndarray:
    """The parity bitmap of fewer bytes: its parts added modulo 2."""
    return np.bitwise_xor.reduce(bitmap.reshape(-1, size), 0) if len(bitmap) > size else bitmap


def _similar_sizes(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (np.minimum(n, m) > 0)


def _reach(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The largest symmetric difference of linked sets of these sizes."""
    return (n + m) * (100 - percent) / (100 + percent)


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(-1, dtype=np.int64)


def _within_reach(bits: np.ndarray, i: np.ndarray, j: np.ndarray, ok: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of ok whose bitmaps i[a] and j[b] differ by reach at most.

    A quarter of the words bounds the distance from below and leaves few pairs to compare in full.
    """
    few = max(1, bits.shape[1] // 4)
    x, y = np.ascontiguousarray(bits[i, :few].T), np.ascontiguousarray(bits[j, :few].T)
    far = np.zeros(ok.shape, np.uint32)
    for of_i, of_j in zip(x, y, strict=True):
        far += np.bitwise_count(of_i[:, None] ^ of_j)
    a, b = np.nonzero(ok & (far <= reach))
    step = max(1, CELL_BYTES // (8 * bits.shape[1]))
    keep = [np.flatnonzero(_popcount(bits[i[a[s : s + step]]] ^ bits[j[b[s : s + step]]]) <= reach[a[s : s + step], b[s : s + step]]) + s for s in range(0, len(a), step)]
    kept = np.concatenate(keep) if keep else np.zeros(0, np.int64)
    return a[kept], b[kept]


def _own_pairs(bits: np.ndarray, n: np.ndarray, own: np.ndarray, at: np.ndarray, part: np.ndarray, percent: int) -> Iterator[np.ndarray]:
    """As _cell_pairs, without pivots: the own members meet those of similar sizes in other parts."""
    by_size = np.argsort(n, kind="stable")
    sizes, mine = n[by_size], by_size[own[by_size]]
    for s in range(0, len(mine), SMALL):
        i = mine[s : s + SMALL]  # in order of size
        low = np.searchsorted(100 * sizes, percent * n[i[0]])
        high = np.searchsorted(percent * sizes, 100 * n[i[-1]], "right")
        for t in range(low, high, 4096):
            j = by_size[t : min(t + 4096, high)]
            # two own members meet from the side of the first one
            ok = _similar_sizes(n[i][:, None], n[j], percent) & ((i[:, None] < j) | ~own[j]) & (part[at[i]][:, None] != part[at[j]])
            a, b = _within_reach(bits, i, j, ok, _reach(n[i][:, None], n[j], percent))
            if len(a):
                yield np.stack([i[a], j[b]])


def _cell_pairs(bits: np.ndarray, n: np.ndarray, own: np.ndarray, at: np.ndarray, part: np.ndarray, percent: int, depth: int = 0) -> Iterator[np.ndarray]:
    """Pairs (i, j) of two parts that pass the bitmaps, at least one of them own; bits: (members, 64-bit words).

    part is of the whole cell, in which the members stand at `at`; it may change between two yields.
    """
    k = len(n)
    if k <= SMALL or depth > 12:
        yield from _own_pairs(bits, n, own, at, part, percent)
        return
    picks = np.random.default_rng(depth * 7919 + k).choice(k, 8, replace=False)
    far = np.stack([_popcount(bits ^ bits[p]) for p in picks], 1)
    home = far.argmin(1)
    nearest = far[np.arange(k), home]
    # the partner of x is within reach(x): its nearest pivot is at most 2 reach(x) farther than x's own
    reach = 2 * _reach(n, n * 100 / percent, percent)
    for cell in range(len(picks)):
        mine = home == cell
        if not (mine & own).any():
            continue
        inside = np.flatnonzero(mine | (far[:, cell] - nearest <= reach))
        if len(inside) >= 0.9 * k:  # this pivot parts nothing: the cell is compared as it is
            whole = _own_pairs(bits[inside], n[inside], mine[inside] & own[inside], at[inside], part, percent)
        else:
            whole = _cell_pairs(bits[inside], n[inside], mine[inside] & own[inside], at[inside], part, percent, depth + 1)
        for pair in whole:
            yield inside[pair]


def cell_pairs(bitmaps: list[bytes], n: np.ndarray, own: np.ndarray, percent: int = PERCENT, part: np.ndarray | None = None) -> np.ndarray:
    """All pairs of a cell that pass sizes and bitmaps, at least one of them own, as (2, pairs); bitmaps of one size.

    Members of one part are linked already, and aren't compared: a group of near copies gives no pairs here.
    """
    bits = np.frombuffer(b"".join(bitmaps), np.uint64).reshape(len(bitmaps), -1)
    at = np.arange(len(n))
    found = list(_cell_pairs(bits, n, own, at, at if part is None else part, percent))
    return np.unique(np.sort(np.hstack(found), 0), axis=1) if found else np.zeros((2, 0), np.int64)


def cell_forest(bitmaps: list[bytes], n: np.ndarray, own: np.ndarray, part: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Pairs of cell_pairs that join its parts to the same groups as all of them would: fewer than members, as (2, pairs)."""
    bits, part, kept = np.frombuffer(b"".join(bitmaps), np.uint64).reshape(len(bitmaps), -1), part.copy(), [np.zeros((2, 0), np.int64)]
    for i, j in _cell_pairs(bits, n, own, np.arange(len(n)), part, percent):
        for a in np.unique(i):
            b = j[i == a]
            b = b[part[b] != part[a]]
            labels, first = np.unique(part[b], return_index=True)
            if len(labels):
                kept.append(np.stack([np.full(len(labels), a), b[first]]))
                part[np.isin(part, labels)] = part[a]
    return np.hstack(kept)


_CELL = "cell long, class long, n long, part long, bitmap binary, own boolean"


def _by_bitmap_size(rows: DataFrame) -> DataFrame:
    """rows (shingle, class, n, part, bitmap) in cells of a region and a bitmap size.

    Similar sizes differ by one step of bitmap size at most, so each set is at home where its own
    size is, and a guest, folded, where the next smaller one is.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        smallest = 2048 // 8
        for batch in batches:
            bitmaps = batch.column("bitmap").to_pylist()
            half = np.array([i for i, x in enumerate(bitmaps) if len(x) > smallest], np.int64)
            folded = [fold(np.frombuffer(bitmaps[i], np.uint8), len(bitmaps[i]) // 2).tobytes() for i in half]
            for at, x, own in ((np.arange(len(bitmaps)), bitmaps, True), (half, folded, False)):
                cols = [batch.column(c).take(pa.array(at)) for c in ("shingle", "class", "n", "part")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(x, pa.binary()), pa.array(np.full(len(x), own))], ["cell", "class", "n", "part", "bitmap", "own"])

    out = rows.mapInArrow(work, _CELL)
    return out.withColumn("cell", F.xxhash64("cell", F.length("bitmap")))


def _cut(rows: DataFrame, percent: int) -> DataFrame:
    """rows of cells with the bitmaps p0, p1 ... of their pivots to rows of the pivots' Voronoi cells and windows: at is the pivot."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bitmaps = batch.column("bitmap").to_pylist()
            far = np.empty((batch.num_rows, CELL_PIVOTS), np.int64)
            for k in range(CELL_PIVOTS):
                for i, (x, p) in enumerate(zip(bitmaps, batch.column(f"p{k}").to_pylist(), strict=True)):
                    far[i, k] = _popcount(np.frombuffer(x, np.uint64) ^ np.frombuffer(p, np.uint64))
            home, n = far.argmin(1), batch.column("n").to_numpy()
            # as in _cell_pairs: a partner's cell is at most two reaches farther than the nearest
            inside = far - far.min(1)[:, None] <= 2 * _reach(n, n * 100 / percent, percent)[:, None]
            row, at = np.nonzero(inside)
            cols = [batch.column(c).take(pa.array(row)) for c in ("cell", "bytes", "class", "n", "part", "bitmap")]
            own = batch.column("own").to_numpy(zero_copy_only=False)[row] & (home[row] == at)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(own), pa.array(at.astype(np.int32))], ["cell", "bytes", "class", "n", "part", "bitmap", "own", "at"])

    return rows.mapInArrow(work, "cell long, bytes long, class long, n long, part long, bitmap binary, own boolean, at int")


def bounded_cells(rows: DataFrame, percent: int) -> DataFrame:
    """rows (shingle, class, n, part, bitmap) of regions, in groups of about CELL_BYTES at most.

    (group, class, n, part, bitmap, own, tile, within): two rows of a group are compared if one is
    own, and if their tiles differ or the group is `within` a tile. Every pair of a region that
    is linked meets in some group.
    """
    cells, done = written(_by_bitmap_size(rows), "cells"), []
    for turn in range(CUTS + 1):
        size = cells.groupBy("cell").agg(F.sum(F.length("bitmap")).alias("bytes"), F.bool_or("own").alias("owned")).where("owned").drop("owned")
        if turn:  # a cell that holds nearly all of the one it was cut from isn't cut again
            size = size.join(cells.groupBy("cell").agg(F.first("before").alias("before")), "cell")
        else:
            size = size.withColumn("before", F.lit(None).cast("long"))
        size = written(size, "sizes")
        small = size.where(F.col("bytes") <= CELL_BYTES)
        done.append(cells.join(small.select("cell"), "cell").select(F.col("cell").alias("group"), "class", "n", "part", "bitmap", "own", F.lit(0).alias("tile"), F.lit(True).alias("within")))
        stuck = F.lit(turn == CUTS) | F.coalesce(F.col("bytes") >= 0.9 * F.col("before"), F.lit(False))
        large = size.where(F.col("bytes") > CELL_BYTES)
        if large.isEmpty():
            break
        tiles = F.ceil(F.col("bytes") * 2 / CELL_BYTES).cast("int")
        dealt = cells.join(large.where(stuck).select("cell", tiles.alias("tiles")), "cell").withColumn("tile", F.pmod(F.xxhash64("class"), F.col("tiles")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        group = F.xxhash64("cell", F.least("tile", "other"), F.greatest("tile", "other"))
        met = dealt.withColumn("group", group).withColumn("within", F.col("tile") == F.col("other"))
        done.append(met.select("group", "class", "n", "part", "bitmap", "own", "tile", "within"))
        pick = [F.min_by("bitmap", F.xxhash64("class", F.lit(turn * CELL_PIVOTS + k))).alias(f"p{k}") for k in range(CELL_PIVOTS)]
        open_ = cells.join(large.where(~stuck).select("cell", "bytes"), "cell")
        pivots = written(open_.groupBy("cell").agg(*pick), "pivots")
        if pivots.isEmpty():
            break
        cut = _cut(open_.join(pivots, "cell"), percent)
        cells = written(cut.select(F.xxhash64("cell", F.lit(turn), "at").alias("cell"), F.col("bytes").alias("before"), "class", "n", "part", "bitmap", "own"), "cells")
    return reduce(DataFrame.unionByName, done)


def _grouped(mixed: DataFrame, large: DataFrame, percent: int) -> DataFrame:
    """The rows of large regions in bounded groups; regions that keep to CELL_BYTES are groups as they are, without further tables."""
    bits = F.least(F.lit(float(1 << 20)), F.greatest(F.lit(2048.0), F.pow(F.lit(2.0), F.ceil(F.log2(2.0 * F.col("n"))))))  # as in bitmap_of
    huge = mixed.where(F.col("members") > SMALL).groupBy("shingle").agg(F.sum(bits / 8).alias("bytes")).where(F.col("bytes") > CELL_BYTES).select("shingle")
    whole = lambda rows: _by_bitmap_size(rows).select(F.col("cell").alias("group"), "class", "n", "part", "bitmap", "own", F.lit(0).alias("tile"), F.lit(True).alias("within"))
    if huge.isEmpty():
        return whole(large)
    huge = written(huge, "huge")
    return whole(large.join(huge, "shingle", "left_anti")).unionByName(bounded_cells(large.join(huge, "shingle", "left_semi"), percent))


def _code(shingles: np.ndarray) -> int:
    """The identity of a set."""
    both = np.bitwise_xor.reduce(mix(shingles ^ np.uint64(BASES[0])), keepdims=True) ^ np.uint64(len(shingles))
    return int(mix(both).view(np.int64)[0])


def describe(docs: DataFrame, words: int, percent: int, hot: np.ndarray | None = None) -> DataFrame:
    """docs (doc_id, key, text) to (doc_id, key, class, check, n, bitmap, prefix); class is null without shingles."""
    shared = docs.sparkSession.sparkContext.broadcast(np.zeros(0, np.uint64) if hot is None else hot)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in batches_of(batch.column(2)):
                sets = shingle_sets(texts, words)
                code = [_code(s) if len(s) else None for s in sets]
                check = [int(np.add.reduce(mix(s ^ np.uint64(BASES[1]))).view(np.int64)) if len(s) else None for s in sets]
                prefixes = [prefix_of(s, shared.value, percent) for s in sets]
                flat = np.concatenate(prefixes).view(np.int64)
                offsets = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
                cols = [batch.column(i).slice(row, len(texts)) for i in (0, 1)] + [pa.array(code, pa.int64()), pa.array(check, pa.int64()), pa.array([len(s) for s in sets], pa.int64())]
                cols += [pa.array([bitmap_of(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "key", "class", "check", "n", "bitmap", "prefix"])

    return docs.select("doc_id", "key", "text").mapInArrow(work, "doc_id long, key long, class long, check long, n long, bitmap binary, prefix array<long>")


def _exact(pairs: DataFrame, classes: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The linked ones of pairs (a, b) of classes: first by sizes and bitmaps, then by whole sets."""

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reach = _reach(batch.column("na").to_numpy(), batch.column("nb").to_numpy(), percent)
            keep = []
            for i, (x, y) in enumerate(zip(batch.column("xa").to_pylist(), batch.column("xb").to_pylist(), strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                size = min(len(x), len(y))
                if _popcount(fold(x, size) ^ fold(y, size)) <= reach[i]:
                    keep.append(i)
            if keep:
                yield batch.select(["a", "b", "ka", "kb"]).take(pa.array(keep))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, np.zeros(0, np.uint64)
        for batch in batches:
            keep = []
            for i, (a, b, s, t) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ta", "tb")), strict=True)):
                if t != last:
                    last, known = t, shingle_sets([t.encode()], words)[0]
                mine = shingle_sets([s.encode()], words)[0]
                both = len(np.intersect1d(mine, known, assume_unique=True))
                if 100 * both >= percent * (len(mine) + len(known) - both) and _code(mine) == a and _code(known) == b:
                    keep.append(i)
            if keep:
                yield batch.select(["a", "b"]).take(pa.array(keep))

    side = lambda s: classes.select(F.col("class").alias(s), F.col("n").alias(f"n{s}"), F.col("bitmap").alias(f"x{s}"), F.col("key").alias(f"k{s}"))
    sizes = lambda s: classes.select(F.col("class").alias(s), F.col("n").alias(f"m{s}"))
    alike = pairs.join(sizes("a"), "a").join(sizes("b"), "b").where(f"100 * least(ma, mb) >= {percent} * greatest(ma, mb)").select("a", "b").distinct()
    sized = alike.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "xa", "xb", "ka", "kb")
    near = written(sized.mapInArrow(sift, "a long, b long, ka long, kb long"), "near")
    wanted = near.select(F.explode(F.array("ka", "kb")).alias("key")).distinct()
    found = written(texts.select("key", "text").join(wanted, "key", "left_semi"), "texts")
    text = lambda s: found.select(F.col("key").alias(f"k{s}"), F.col("text").alias(f"t{s}"))
    full = near.join(text("a"), "ka").join(text("b"), "kb").select("a", "b", "ta", "tb")
    links = written(full.mapInArrow(verify, "a long, b long").distinct(), "links")
    discard(near, found)
    return links


def _members(prefixes: DataFrame) -> DataFrame:
    return prefixes.select("class", F.explode("prefix").alias("shingle"))


def _regions(prefixes: DataFrame) -> DataFrame:
    """Shingles that stand for several classes: how many, and the least and the greatest class."""
    found = _members(prefixes).groupBy("shingle").agg(F.count("*").alias("members"), F.min("class").alias("low"), F.max("class").alias("high"))
    return written(found.where("low < high"), "regions")


def _hot_last(regions: DataFrame, classes: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame | None:
    """(class, prefix) in an order that puts hot shingles last; None if there are none."""
    spark = regions.sparkSession
    most = regions.where(F.col("members") > HOT).orderBy(F.col("members").desc(), "shingle").limit(MOST_HOT).select("shingle")
    hot = np.sort(np.array([r["shingle"] for r in most.collect()], np.int64).view(np.uint64))  # at most MOST_HOT numbers
    if not len(hot):
        return None
    table = F.broadcast(spark.createDataFrame(pa.table({"shingle": pa.array(hot.view(np.int64))})))  # at most MOST_HOT rows
    touched = written(_members(classes).join(table, "shingle").select("class").distinct().join(classes.select("class", "key"), "class"), "touched")
    again = describe(texts.join(touched.select("key").distinct(), "key", "left_semi"), words, percent, hot)
    again = written(again.select("class", "prefix").join(touched.select("class").distinct(), "class", "left_semi").dropDuplicates(["class"]), "again")
    rest = classes.select("class", "prefix").join(again.select("class"), "class", "left_anti")
    out = written(rest.unionByName(again), "prefixes")
    discard(touched, again)
    return out


def _placed(members: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    """members with n and part, the component of their class by the links."""
    parts = classes.select("class", "n").join(components(links), F.col("class") == F.col("node"), "left").select("class", "n", F.coalesce("component", "class").alias("part"))
    return members.join(parts, "class").select("shingle", "class", "n", "part", "members")


def _mixed(members: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    """The placed members of regions that are in several components."""
    placed = _placed(members, classes, links)
    several = placed.groupBy("shingle").agg(F.min("part").alias("one"), F.max("part").alias("other")).where("one < other").select("shingle")
    return written(placed.join(several, "shingle"), "mixed")


def join_documents(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, class (equal for equal sets, else null),

    component (equal for linked texts, else null; a component_id may name several where an id
    repeats) and key (of the row's id and text).
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # the text of a class is found by a key of its row, as a doc_id may repeat or be null
    texts = texts.withColumn("key", F.xxhash64("doc_id", "text"))
    whole = written(describe(texts, words, percent), "described")
    described = written(whole.select("doc_id", "key", "n", "class", "check"), "rows")
    of_class = whole.where("class IS NOT NULL").groupBy("class", "check")
    first = written(of_class.agg(F.min("doc_id").alias("least"), F.min("key").alias("key"), F.first("n").alias("n"), F.first("bitmap").alias("bitmap"), F.first("prefix").alias("prefix")), "classes")
    discard(whole)
    regions = _regions(first)
    prefixes = _hot_last(regions, first, texts, words, percent)
    classes = written(first.drop("prefix"), "sets")
    if prefixes is None:
        prefixes = first.select("class", "prefix")
    else:
        discard(first, regions)
        regions = _regions(prefixes)

    # a region of two is a pair; in a larger one each member meets the pivot
    larger = regions.where("members > 2").select("shingle", F.col("low").alias("pivot"), "members")
    members = written(_members(prefixes).join(larger, "shingle").where("class <> pivot"), "members")
    pairs = regions.where("members = 2").select(F.col("high").alias("a"), F.col("low").alias("b"))
    pairs = pairs.unionByName(members.select(F.col("class").alias("a"), F.col("pivot").alias("b")))
    links = _exact(pairs, classes, texts, words, percent)
    for turn in range(PIVOTS):
        placed = _placed(members.where(F.col("members") > SMALL), classes, links)
        pivot = placed.groupBy("shingle").agg(F.min("part").alias("one"), F.max("part").alias("other"), F.min_by(F.struct("class", "part"), F.xxhash64("class", F.lit(turn))).alias("pivot")).where("one < other").select("shingle", "pivot")
        stars = placed.join(pivot, "shingle").where("part <> pivot.part").select(F.col("class").alias("a"), F.col("pivot.class").alias("b")).distinct()
        stars = written(stars, "stars")
        if stars.isEmpty():
            break
        more = _exact(stars, classes, texts, words, percent)
        if more.isEmpty():
            break
        links = links.unionByName(more)

    # what a region has in several components is joined by pivots; its first pivot met everyone
    mixed = _mixed(members, classes, links)

    def list_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_region(batches):
            c, n, part = (table.column(x).to_numpy() for x in ("class", "n", "part"))
            a, b = np.nonzero(_similar_sizes(n[:, None], n, percent) & (part[:, None] != part) & (c[:, None] > c))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(c[a]), pa.array(c[b])], ["a", "b"])

    def cut_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_region(batches, "group"):
            c, part = (table.column(x).to_numpy() for x in ("class", "part"))
            own = table.column("own").to_numpy(zero_copy_only=False)
            i, j = cell_forest(table.column("bitmap").to_pylist(), table.column("n").to_numpy(), own, part, percent)
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(c[i], c[j])), pa.array(np.minimum(c[i], c[j]))], ["a", "b"])

    def cut_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_region(batches, "group"):
            c, part, tile = (table.column(x).to_numpy() for x in ("class", "part", "tile"))
            own, within = (table.column(x).to_numpy(zero_copy_only=False) for x in ("own", "within"))
            i, j = cell_pairs(table.column("bitmap").to_pylist(), table.column("n").to_numpy(), own, percent, part)
            keep = (tile[i] != tile[j]) | within[i]
            a, b = np.maximum(c[i], c[j])[keep], np.minimum(c[i], c[j])[keep]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    # near copies that no pivot met: a forest of each group links them by a pair a member, so that few pairs of two parts are left
    for _ in range(FORESTS):
        large = mixed.where(F.col("members") > SMALL).join(classes.select("class", "bitmap"), "class")
        forest = written(_grouped(mixed, large, percent).repartition("group").sortWithinPartitions("group").mapInArrow(cut_forest, "a long, b long").distinct(), "forest")
        more = _exact(forest, classes, texts, words, percent)
        if more.isEmpty():
            break
        links = links.unionByName(more)
        mixed = _mixed(members, classes, links)

    listed = mixed.where(F.col("members") <= SMALL).repartition("shingle").sortWithinPartitions("shingle").mapInArrow(list_pairs, "a long, b long")
    large = mixed.where(F.col("members") > SMALL).join(classes.select("class", "bitmap"), "class")
    cut = _grouped(mixed, large, percent).repartition("group").sortWithinPartitions("group").mapInArrow(cut_pairs, "a long, b long")
    more = _exact(written(listed.unionByName(cut).distinct(), "rest"), classes, texts, words, percent)

    parts = components(links.unionByName(more))
    whole = classes.select("class", "check", "least").join(parts, F.col("class") == F.col("node"), "left").withColumn("part", F.coalesce("component", "class"))
    whole = whole.join(whole.groupBy("part").agg(F.min("least").alias("component_id")), "part")
    whole = written(whole.select(F.col("class").alias("_class"), F.col("check").alias("_check"), "component_id", F.col("part").alias("component")), "components")
    out = described.join(whole, (F.col("class") == F.col("_class")) & (F.col("check") == F.col("_check")), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "class", "component", "key")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each group of linked texts, that of the smallest id, and all their columns.

    Rows without shingles stay; rows that repeat an id and a text are one. Where several texts of
    a group have the smallest id, or none has an id, one of them stays.
    """
    groups = join_documents(docs, words, percent, id_col, text_col)
    alone = groups.where("component IS NULL").select("key")
    firsts = groups.where("component IS NOT NULL AND component_id <=> doc_id").groupBy("component").agg(F.min("key").alias("key")).select("key")
    key = fresh(docs, "row_key")
    kept = alone.unionByName(firsts).select(F.col("key").alias(key)).distinct()
    out = docs.withColumn(key, F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))).join(kept, key, "left_semi")
    return out.dropDuplicates([key]).drop(key)


def _by_region(batches: Iterator[pa.RecordBatch], by: str = "shingle") -> Iterator[pa.Table]:
    """The rows of one region after the other, from rows in order of region."""
    pending: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        key = batch.column(by).to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if last is not None and key[a] != last:
                yield pa.Table.from_batches(pending)
                pending = []
            pending.append(batch.slice(a, b - a))
            last = key[a]
    if pending:
        yield pa.Table.from_batches(pending)

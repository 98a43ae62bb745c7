"""Codes, errors and codebooks against k-means over all points and entries."""

import itertools
import math
from hashlib import sha256

import numpy as np
import pytest

from tidemark.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, v int"


def direct(rows, parts=8, entries=16, rounds=6):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, [math.floor(4096 * float(np.float32(x))) for x in r[1]]))
    v = np.array([[math.floor(4096 * float(np.float32(x))) for x in r[1]] for r in kept], np.int64).reshape(len(kept), parts, -1)
    books = [[list(map(int, v[i, p])) for i in range(min(entries, len(kept)))] for p in range(parts)]

    def assign():
        out = []
        for i in range(len(kept)):
            row = []
            for p in range(parts):
                far = [sum((int(a) - b) ** 2 for a, b in zip(v[i, p], e, strict=True)) for e in books[p]]
                row.append((far.index(min(far)), min(far)))
            out.append(row)
        return out

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [v[i, p] for i in range(len(kept)) if found[i][p][0] == e]
                if own:
                    books[p][e] = [int(s) // len(own) for s in np.sum(own, axis=0)]
    found = assign()
    error = [sum(d for _, d in row) for row in found]
    by_label = {}
    for r, d in zip(kept, error, strict=True):
        by_label[r[2]] = by_label.get(r[2], 0) + d
    digest = sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(r[0], "".join(f"{c:02x}" for c, _ in row), d, by_label[r[2]], digest) for r, row, d in zip(kept, found, error, strict=True)]


def rows_of(n, size=16, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, size))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 6] + rng.normal(size=size) * 0.1], i % 3 if i % 7 else None, "x", 1) for i in range(n)]
    return rows + [(n, None, 1, "x", 1), (n + 1, [float("nan")] * size, 1, "x", 1), (n + 2, [None, *[0.0] * (size - 1)], 1, "x", 1), (n + 3, [float("inf")] * size, None, "x", 1)]


@pytest.mark.parametrize("make", ["spread", "copies", "ties", "few"])
def test_against_all_points_and_entries(spark, monkeypatch, make):
    monkeypatch.setattr(vector_codes, "BLOCK_POINTS", 7)
    monkeypatch.setattr(vector_codes, "HELD_POINTS", 21)
    monkeypatch.setattr(vector_codes, "PARTITION_POINTS", 100)
    rows = rows_of(5 if make == "few" else 120)
    if make == "copies":
        rows += [(1000 + i, rows[3][1], 2, "x", 1) for i in range(150)] + [rows[5]] * 3 + [(None, rows[8][1], None, "x", 1)]
    if make == "ties":
        rows = [(i, [float((i + k) % 2) for k in range(16)], 1, "x", 1) for i in range(40)]
    got = vector_codes.compress_vectors(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(direct(rows), key=repr)


def test_hard_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert vector_codes.compress_vectors(empty).collect() == []
    odd = spark.createDataFrame([(1, [1.0] * 16, 1, "x", 1), (2, [1.0] * 24, 1, "x", 1), (3, None, 1, "x", 1)], SCHEMA)
    assert [(r.vec_id, r.code, r.error) for r in vector_codes.compress_vectors(odd).collect()] == [(1, "00" * 8, 0)]
    none = spark.createDataFrame([(1, [], 1, "x", 1)], SCHEMA)
    assert [(r.code, r.label_error) for r in vector_codes.compress_vectors(none).collect()] == [("00" * 8, 0)]
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compress_vectors(spark.createDataFrame([(1, [1.0] * 9, 1, "x", 1)], SCHEMA))
    with pytest.raises(ValueError, match="too large"):
        vector_codes.compress_vectors(spark.createDataFrame([(1, [1e30] * 16, 1, "x", 1)], SCHEMA))


def test_the_curve_visits_neighbours_one_after_another():
    cells = np.array(list(itertools.product(range(8), repeat=3)))
    order = np.argsort(vector_codes.hilbert_keys(cells, 3))
    assert sorted(vector_codes.hilbert_keys(cells, 3)) == list(range(512))
    assert (np.abs(np.diff(cells[order], axis=0)).sum(1) == 1).all()


def test_short_lists_keep_every_nearest_entry():
    rng = np.random.default_rng(4)
    for _ in range(50):
        points, entries = rng.integers(-50, 50, (30, 4)), rng.integers(-60, 60, (9, 4))
        listed = vector_codes.short_lists(points.min(0)[None], points.max(0)[None], entries)[0]
        every = ((points[:, None] - entries[None]) ** 2).sum(2)
        code, error = vector_codes.nearest(points, entries, listed)
        assert (code == every.argmin(1)).all() and (error == every.min(1)).all()

"""Pairs and forests of a cell against all pairs."""

import numpy as np
import pytest

from tidemark.llm import jaccard_join as j


def linked(bitmaps, n, own):
    """Every pair that passes sizes and bitmaps, one of them own."""
    bits = np.frombuffer(b"".join(bitmaps), np.uint64).reshape(len(bitmaps), -1)
    far = np.bitwise_count(bits[:, None] ^ bits[None]).sum(-1, dtype=np.int64)
    low, high = np.minimum(n[:, None], n), np.maximum(n[:, None], n)
    ok = (100 * low >= 75 * high) & (low > 0) & (far <= (low + high) * 25 / 175) & (own[:, None] | own)
    return set(zip(*(x.tolist() for x in np.nonzero(np.triu(ok, 1))), strict=True))


def groups(pairs, part):
    part = part.copy()
    for a, b in pairs:
        part[part == part[b]] = part[a]
    return {tuple(np.flatnonzero(part == v)) for v in part}


@pytest.mark.parametrize("k", [1, 2, 64, 65, 400])
def test_cells(k):
    r = np.random.default_rng(k)
    bases, sets = r.integers(0, 2**63, (5, 300)).view(np.uint64), []
    for _ in range(k):
        text = bases[r.integers(5)][: r.integers(0, 300)].copy()
        changed = r.random(len(text)) < r.choice([0, 0.02, 0.1, 0.6])
        text[changed] = r.integers(0, 2**63, changed.sum())
        sets.append(np.unique(text))
    bitmaps, n = [j.bitmap_of(s) for s in sets], np.array([len(s) for s in sets])
    for own in (np.ones(k, bool), r.random(k) < 0.3):
        for part in (np.arange(k), r.integers(0, 1 + k // 3, k)):
            every = {(a, b) for a, b in linked(bitmaps, n, own) if part[a] != part[b]}
            assert set(zip(*j.cell_pairs(bitmaps, n, own, part=part).tolist(), strict=True)) == every
            forest = list(zip(*j.cell_forest(bitmaps, n, own, part).tolist(), strict=True))
            assert groups(forest, part) == groups(every, part) and len(forest) < k

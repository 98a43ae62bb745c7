"""Texts of over 2^24 units."""

import numpy as np

from tidemark.llm import suffix, windows


def test_anchors_beyond_the_bits_of_a_place():
    rng = np.random.default_rng(4)
    n = (1 << 24) + 6000
    x = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    begin = n - 8000
    start, anchor = windows.anchors(windows.Ranges(x), np.array([0]), np.array([n]), 35, 12)
    assert len(start) == n - 34 and ((anchor >= start) & (anchor <= start + 23)).all()
    tail, of_tail = windows.anchors(windows.Ranges(x[begin:]), np.array([0]), np.array([8000]), 35, 12)
    assert (start[begin:] == tail + begin).all() and (anchor[begin:] == of_tail + begin).all()


def test_pieces_do_not_show(monkeypatch):
    x = np.random.default_rng(5).integers(0, 9, 3000).astype(np.uint64)  # few values: many equal fragments
    at = (np.array([0, 40, 1000]), np.array([40, 1000, 3000]))
    whole = windows.anchors(windows.Ranges(x), *at, 35, 2)
    monkeypatch.setattr(windows, "_PIECE", 50)
    assert all((a == b).all() for a, b in zip(whole, windows.anchors(windows.Ranges(x), *at, 35, 2), strict=True))


def test_passage_beyond_the_limit_is_found(spark):
    rng = np.random.default_rng(6)
    passage = bytes(rng.integers(97, 123, 400, dtype=np.uint8)).decode()
    text = bytes(rng.integers(97, 123, (1 << 24) + 1000, dtype=np.uint8)).decode() + passage
    docs = spark.createDataFrame([(1, "one " + passage), (2, text)], "doc_id long, text string")
    got = {r["doc_id"]: r["removed_spans"] for r in suffix.remove_later_copies(docs, spans=True).collect()}
    assert not got[1] and [tuple(s) for s in got[2]] == [(len(text) - 400, len(text))]

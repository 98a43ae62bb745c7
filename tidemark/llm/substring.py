"""Substring dedup by relative Lempel-Ziv factors: what documents share with any other place of the corpus.

Every document is part of the reference. The reference is indexed by anchors (windows.py): a run
of windows of 35 words belongs to the block of its anchor, and all blocks together hold every
window of every document. In each block the runs are parsed greedily against the whole block,
each by the longest match that another place goes on sharing (repeats.factor_windows); runs with
equal text, such as copies, are one run of the index, whose match is another of its places. A
factor that ends where its run does goes on in the next run's block, so factors of one document
that follow each other on one diagonal of one source are joined.

All factors hold a window at least, 35 words: the sufficiently long ones. The parse goes on at
the first window that a factor doesn't hold, not behind its last word, so that the windows over a
factor's end are tried too; hence the factors cover each word of each window that stands
elsewhere, as the test against brute force shows. The words that factors cover are removed.

In an anchor's block of over 5000 different runs, factors begin as single windows of the first
place that has them, so they may be shorter there; they cover the same words.

Cases: a null text is an empty one; a null doc_id is kept and is a document; repeated rows are
duplicates of each other; an empty table gives no rows; other columns are dropped. Words are
runs of bytes other than ASCII white space.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import factored_runs, with_runs

WINDOW, FRAGMENT = 35, 12
_NO_ID = -(2**63)


def joined_factors(runs: pa.StructArray | None, window: int) -> np.ndarray:
    """(begin, words, source document, source begin) of the factors of a text, by begin, those of one diagonal joined."""
    if runs is None or not len(runs):
        return np.zeros((0, 4), np.int64)
    begin, n, doc, source = (runs.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("begin", "n", "source_doc", "source_begin"))
    order = np.argsort(begin, kind="stable")
    begin, n, doc, source = begin[order], n[order], doc[order], source[order]
    goes_on = (begin[1:] == begin[:-1] + n[:-1]) & (doc[1:] == doc[:-1]) & (source[1:] - begin[1:] == source[:-1] - begin[:-1])
    first = np.flatnonzero(np.concatenate([[True], ~goes_on]))
    windows = np.add.reduceat(n, first)
    return np.stack([begin[first], windows + window - 1, doc[first], source[first]], 1)


def remove_repeats(docs: DataFrame, window: int = WINDOW, fragment: int = FRAGMENT, texts: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256, n_factors, and with texts

    kept_text and factors, array<struct<begin, words, source_doc, source_begin>> in words.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for text, runs in zip(batch.column(1), batch.column(2), strict=True):
                words = (text.as_py() or "").encode().split()
                found = joined_factors(runs.values if runs.is_valid else None, window)
                edge = np.zeros(len(words) + 1, np.int32)
                np.add.at(edge, found[:, 0], 1)
                np.add.at(edge, found[:, 0] + found[:, 1], -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g) if len(found) else b" ".join(words)
                where = [{"begin": a, "words": k, "source_doc": None if d == _NO_ID else d, "source_begin": s} for a, k, d, s in found.tolist()] if texts else None
                for col, v in zip(out, (len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), len(found), kept.decode() if texts else None, where), strict=True):
                    col.append(v)
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.struct([(c, pa.int64()) for c in ("begin", "words", "source_doc", "source_begin")]))]
            cols = [pa.array(c, t) for c, t in zip(out, types, strict=True)][: 6 if texts else 4]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names)

    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "n_factors", *["kept_text", "factors"] * texts]
    more = ", kept_text string, factors array<struct<begin:long,words:long,source_doc:long,source_begin:long>>"
    keyed, found = factored_runs(docs, "word", window, fragment)
    return with_runs(keyed, found).mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, n_factors long" + more * texts)

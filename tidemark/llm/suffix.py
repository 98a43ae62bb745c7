"""Exact removal of byte strings that also start earlier in the corpus.

The dealt column-wise construction takes a round for each byte of the longest text and passes over
files of the whole collection in each; README has the figures. Built instead: anchors of 100-byte
windows whose contexts are counted before the shuffle (repeats.py), exact by construction.

Cases: a null text is an empty one; a null doc_id is kept and comes before all others; rows with
an equal doc_id and text stand at the same place, so neither is earlier than the other; different
texts of one doc_id are ordered by place, then by a hash; an empty table gives no rows; other
columns are dropped. Matches never cross texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import covered, repeated_runs, with_runs

WINDOW, FRAGMENT = 100, 32


def remove_later_copies(docs: DataFrame, window: int = WINDOW, fragment: int = FRAGMENT, spans: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with spans

    removed_spans, array<struct<begin, end>> of byte offsets, end exclusive.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for text, runs in zip(batch.column(1), batch.column(2), strict=True):
                data = (text.as_py() or "").encode()
                gone = covered(runs.values if runs.is_valid else None, window, len(data))
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes() if len(edge) else data
                where = [{"begin": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)] if spans else None
                for col, v in zip(out, (len(data), int(gone.sum()), len(edge) // 2, hashlib.sha256(kept).hexdigest(), where), strict=True):
                    col.append(v)
            types = [pa.int64()] * 3 + [pa.string(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))]
            cols = [pa.array(c, t) for c, t in zip(out, types, strict=True)][: 5 if spans else 4]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["removed_spans"] * spans]
    keyed, found = repeated_runs(docs, "byte", window, fragment)
    return with_runs(keyed, found).mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", removed_spans array<struct<begin:long,end:long>>" * spans)

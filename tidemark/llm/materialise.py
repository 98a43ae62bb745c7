"""Token files in training order.

Each text becomes token ids and an end id, cut into records of `stride_ids` ids, the last one
filled up with the end id. The records are written once as a table; a record's number is its
place there, from the row counts of the table's files, so nothing is ranked or moved for it. A
keyed Feistel network over the next even power of two, walked along its cycle until it falls below
N, permutes them, so that record i stands in slot p(i) of the training order: no sort by
random keys, no state, and p can be inverted. Slots are written in `passes` ranges, one after
the other, so that the shuffle of one range is on disk at a time. Range partitions hold a whole number of shards
each and write them as files of fixed-stride records; slot s is at byte
(s mod shard_slots) * stride of file s div shard_slots, so a reader resumes at any slot by one seek.

Files go to a folder that all executors share, through pyarrow's file systems; a task writes
under a name of its own and renames at the end, so a repeated task leaves whole files only.

Cases: a null text is an empty one, of one record; a null doc_id is kept; equal rows have a
record each; an empty table gives no rows and no files; other columns are dropped.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, written
from .packing import cut_documents
from .tokens import default_tokenizer, encoder

STRIDE_IDS, SHARD_SLOTS, KEY, ROUNDS, PASSES = 512, 8192, 20_240_607, 6, 4


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A round function: 64-bit multiply and shift, wrapping around."""
    x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def _round_keys(key: int) -> list[int]:
    return [int(k) for k in _mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95), key % (1 << 63))]


def permute(i: np.ndarray, n: int, key: int = KEY, inverse: bool = False) -> np.ndarray:
    """The slots of record numbers i below n, or with inverse the record numbers of slots i."""
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = _round_keys(key)
    x = i.astype(np.uint64)
    walk = np.arange(len(x))
    while len(walk):
        y = x[walk]
        left, right = y >> half, y & mask
        if inverse:
            for k in reversed(keys):
                left, right = right ^ _mix(left, k) & mask, left
        else:
            for k in keys:
                left, right = right, left ^ _mix(right, k) & mask
        x[walk] = left << half | right
        walk = walk[x[walk] >= np.uint64(n)]
    return x.astype(np.int64)


def _file_starts(records: DataFrame) -> np.ndarray:
    """For each part number the number of its first record: 8 bytes a file, whatever the files hold."""
    rows = records.groupBy(_part().alias("part")).agg(F.count("*").alias("n")).collect()
    counts = np.zeros(max((r["part"] for r in rows), default=0) + 1, np.int64)
    for r in rows:
        counts[r["part"]] = r["n"]
    return np.concatenate([[0], np.cumsum(counts)])


def _qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its scheme, that of Spark's default file system where it has none.

    s3a, the Hadoop name of an S3 bucket, is s3 for pyarrow.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(folder.rstrip("/"))
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    scheme, _, rest = uri.partition(":")
    return f"{ {'s3a': 's3', 's3n': 's3'}.get(scheme, scheme)}:{rest if rest.startswith('//') else '//' + rest}"


def _part() -> Column:
    return F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long")


def materialise(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, stride_ids: int = STRIDE_IDS, shard_slots: int = SHARD_SLOTS, key: int = KEY, end_id: int = 0, passes: int = PASSES) -> DataFrame:
    """Writes the shards and gives one row per record, read back from its file:

    doc_id, piece, start, length (without filling), record, slot, shard, byte_offset, ids_crc32
    (of the ids without filling, little-endian unsigned 32 bits, as read back), path.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or default_tokenizer()
    folder = _qualified(spark, folder or f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}/shards")
    unit = "<u2" if encoder(tokenizer).tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
    stride = stride_ids * np.dtype(unit).itemsize

    records = written(cut_documents(docs, tokenizer, stride_ids, end_id, unit), "records")
    starts = spark.sparkContext.broadcast(_file_starts(records))
    total = int(starts.value[-1])
    shards = max(1, -(-total // shard_slots))

    def slots(part: pd.Series, row: pd.Series) -> pd.Series:
        return pd.Series(permute(starts.value[part.to_numpy()] + row.to_numpy(), total, key))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        fill = np.array([end_id], unit).tobytes()
        shard, file, temp, held = -1, None, "", []

        def closed() -> Iterator[pa.RecordBatch]:
            if file is None:
                return
            file.close()
            path = f"{root}/shard-{shard:08d}.bin"
            store.move(temp, path)
            with store.open_input_file(path) as back:
                stored = back.read()
            for part in held:
                slot, n = part.column("slot").to_numpy(), part.num_rows
                offset = slot % shard_slots * stride
                crc = [zlib.crc32(np.frombuffer(stored, unit, k, at).astype("<u4")) for k, at in zip(part.column("length").to_pylist(), offset.tolist(), strict=True)]
                made = {"record": permute(slot, total, key, inverse=True), "shard": np.full(n, shard), "byte_offset": offset, "ids_crc32": crc, "path": [path] * n}
                yield pa.RecordBatch.from_arrays([part.column(f.name) if f.name not in made else pa.array(made[f.name], f.type) for f in result], schema=result)

        for batch in batches:
            of = batch.column("slot").to_numpy() // shard_slots
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for begin, end in zip(cuts, cuts[1:], strict=False):
                if begin == end:
                    continue
                if of[begin] != shard:
                    yield from closed()
                    shard, held, temp = int(of[begin]), [], f"{root}/.{uuid.uuid4().hex}"
                    file = store.open_output_stream(temp)
                run = batch.slice(begin, end - begin)
                file.write(b"".join(ids if len(ids) == stride else ids + fill * ((stride - len(ids)) // len(fill)) for ids in run.column("ids").to_pylist()))
                held.append(run.drop_columns(["ids"]))
        yield from closed()

    front = ["doc_id", "piece", "start", "length", "ids"]
    longs = ["doc_id", "start", "length", "record", "slot", "shard", "byte_offset", "ids_crc32"]
    result = pa.schema([(c, pa.int64()) for c in longs] + [("piece", pa.int32()), ("path", pa.string())])
    # only file and row numbers go to Python; drawn once a row, though the filter below reads it too
    slot = F.pandas_udf(slots, "long").asNondeterministic()
    placed = records.select(*front, slot(_part(), F.col("_metadata.row_index")).alias("slot"))
    shard_of = F.expr(f"slot div {shard_slots}")
    # a shard is a range of slots and the partition of its number, so no range has to be sampled
    out = []
    for k in range(min(passes, shards)):
        low, high = shards * k // min(passes, shards), shards * (k + 1) // min(passes, shards)
        part = placed.where(shard_of.between(low, high - 1))
        ordered = part.repartitionById(high - low, (shard_of - low).cast("int")).sortWithinPartitions("slot")
        out.append(written(ordered.mapInArrow(write, ", ".join(f"{c} long" for c in longs) + ", piece int, path string"), f"index-{k}"))
    return reduce(DataFrame.unionByName, out)

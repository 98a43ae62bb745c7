"""Media columns: MPEG audio streams that carry a document, and a probe of any MPEG audio column.

The stored form is an MPEG-2 Layer III stream, mono, 16 kHz, 144 kbit/s, with checksums: an
ID3v2 tag with the unpadded length, a frame with the variable-bitrate table (frames, bytes,
100 seek points), then one frame for each 576 bytes of payload. A frame spans 576 samples, so
that a payload byte is one 8-bit sample of the unit; the bytes stand unchanged behind a side
information of zeros, as ancillary data: a player decodes silence.

The probe takes any version, layer, bitrate and padding, skips what is not a frame and goes on
at the next header that another header or the end follows. Tables are Xing, Info and VBRI.
Checksums are verified for all layers; that of Layer II covers the bits that its allocation
tables name. Free-format streams, whose frames have no stated length, give no frames.

Cases: a null text is an empty one and gives one frame of bytes 255; an undecodable or null
media value has 0 frames and null durations, whatever its bytes are; a table or tag that is cut
off is read as far as it goes; repeated rows give equal values.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 576
RATE, KBPS, SIDE = 16_000, 144, 9
FRAME = 72 * KBPS * 1000 // RATE
DATA_AT = 4 + 2 + SIDE

# kbit/s by (MPEG-1?, layer) and Hz by version, as the audio standard lists them.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44_100, 48_000, 32_000), 2: (22_050, 24_000, 16_000), 0: (11_025, 12_000, 8_000)}


@dataclass(frozen=True)
class Header:
    version: int  # 3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5
    layer: int
    checked: bool
    kbps: int
    rate: int
    mono: bool
    length: int
    samples: int
    bound: int = 32  # the first subband that joint stereo shares

    @property
    def side(self) -> int:
        """Bytes between the checksum and the main data of a Layer III frame."""
        if self.layer != 3:
            return 0
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)


@lru_cache(maxsize=4096)
def parse_header(head: bytes) -> Header | None:
    """The four bytes as a frame header; None if they are none, or of free format."""
    if len(head) < 4 or head[0] != 0xFF or head[1] & 0xE0 != 0xE0:
        return None
    version, layer = head[1] >> 3 & 3, 4 - (head[1] >> 1 & 3)
    rate_at, kbps_at, pad = head[2] >> 2 & 3, head[2] >> 4, head[2] >> 1 & 1
    if version == 1 or layer == 4 or rate_at == 3 or kbps_at in (0, 15) or head[3] & 3 == 2:
        return None
    kbps, rate = BITRATES[version == 3, layer][kbps_at], RATES[version][rate_at]
    if layer == 1:
        samples, length = 384, (12 * kbps * 1000 // rate + pad) * 4
    else:
        samples = 576 if layer == 3 and version != 3 else 1152
        length = samples // 8 * kbps * 1000 // rate + pad
    bound = 4 * (head[3] >> 4 & 3) + 4 if head[3] >> 6 == 1 else 32
    return Header(version, layer, not head[1] & 1, kbps, rate, head[3] >> 6 == 3, length, samples, bound)


@lru_cache(maxsize=4096)
def crc16(data: bytes, bits: int | None = None) -> int:
    """The frame checksum of the first bits: polynomial 0x8005, high bit first, started with all ones."""
    crc = 0xFFFF
    for i in range(8 * len(data) if bits is None else bits):
        crc = (crc << 1 ^ (0x8005 if (crc >> 15) ^ (data[i >> 3] >> (7 - i % 8) & 1) else 0)) & 0xFFFF
    return crc


# Bits of each subband's allocation in Layer II, by table, as the audio standard lists them.
_ALLOCATION = {
    "a": (4,) * 11 + (3,) * 12 + (2,) * 4,
    "b": (4,) * 11 + (3,) * 12 + (2,) * 7,
    "c": (4,) * 2 + (3,) * 6,
    "d": (4,) * 2 + (3,) * 10,
    "low": (4,) * 4 + (3,) * 7 + (2,) * 19,
}


def _allocation_table(head: Header) -> tuple[int, ...]:
    """The Layer II table by bitrate a channel and sampling rate."""
    if head.version != 3:
        return _ALLOCATION["low"]
    each = head.kbps if head.mono else head.kbps // 2
    if each <= 48:
        return _ALLOCATION["d" if head.rate == 32_000 else "c"]
    return _ALLOCATION["a" if head.rate == 48_000 or each <= 80 else "b"]


def _checked_bits(head: Header, data: bytes) -> int:
    """How many bits behind the checksum it covers."""
    if head.layer == 3:
        return 8 * head.side
    table = (4,) * 32 if head.layer == 1 else _allocation_table(head)
    channels = 1 if head.mono else 2
    bound = min(head.bound, len(table)) if channels == 2 else len(table)
    if head.layer == 1:
        return 4 * (channels * bound + 32 - bound)
    value, at, chosen = int.from_bytes(data[:64].ljust(64, b"\0"), "big"), 0, 0
    for band, width in enumerate(table):
        for _ in range(channels if band < bound else 1):
            used = value >> (512 - at - width) & (1 << width) - 1
            # a shared allocation still has scale factor choices for either channel
            chosen += (1 if band < bound else channels) * (used > 0)
            at += width
    return at + 2 * chosen


def _frame(data: bytes) -> bytes:
    head = bytes((0xFF, 0xF2, 13 << 4 | 2 << 2, 0xC0))
    side = bytes(SIDE)
    return (head + struct.pack(">H", crc16(head[2:] + side)) + side + data).ljust(FRAME, b"\0")


def encode(payload: bytes, n_bytes: int) -> bytes:
    """The stream for a payload of whole units; n_bytes is kept in the tag."""
    said = b"\0n_bytes\0" + str(n_bytes).encode()
    tag = b"TXXX" + struct.pack(">IH", len(said), 0) + said
    tag = b"ID3\3\0\0" + bytes(len(tag) >> s & 127 for s in (21, 14, 7, 0)) + tag
    n = len(payload) // UNIT
    seek = bytes(min(255, (FRAME * (1 + n * i // 100)) * 256 // (FRAME * (n + 1))) for i in range(100))
    table = b"Xing" + struct.pack(">III", 7, n, FRAME * (n + 1)) + seek
    units = np.zeros((n, FRAME), np.uint8)
    units[:, :DATA_AT] = np.frombuffer(_frame(b"")[:DATA_AT], np.uint8)
    units[:, DATA_AT : DATA_AT + UNIT] = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    return tag + _frame(table) + units.tobytes()


@dataclass
class Stream:
    tags: dict[str, str] = field(default_factory=dict)
    table: dict[str, int] | None = None
    toc: bytes | None = None
    frames: list[tuple[int, Header]] = field(default_factory=list)
    bad_checks: int = 0
    skipped: int = 0

    @property
    def samples(self) -> int:
        return sum(h.samples for _, h in self.frames)


#: How a text frame's first byte says its characters are stored.
_ENCODINGS = {b"\0": "latin-1", b"\1": "utf-16", b"\2": "utf-16-be", b"\3": "utf-8"}


def _tag(media: bytes, out: Stream) -> int:
    """Reads an ID3v2 tag at the begin; where the audio begins."""
    if media[:3] != b"ID3" or len(media) < 10:
        return 0
    end = 10 + sum((b & 127) << s for b, s in zip(media[6:10], (21, 14, 7, 0), strict=True))
    at = 10
    while at + 10 <= min(end, len(media)) and media[at]:
        size = int.from_bytes(media[at + 4 : at + 8], "big")
        if media[3] == 4:
            size = sum((b & 127) << s for b, s in zip(media[at + 4 : at + 8], (21, 14, 7, 0), strict=True))
        name, value = media[at : at + 4].decode("latin-1"), media[at + 10 : at + 10 + size]
        if name[0] == "T":
            text = value[1:].decode(_ENCODINGS.get(value[:1], "latin-1"), "replace")
            if name == "TXXX":
                name, _, text = text.partition("\0")
            out.tags[name] = text.strip("\0\ufeff")
        at += 10 + size
    return end


def _table(media: bytes, at: int, mark: int, out: Stream) -> bool:
    """Reads the table of a variable bitrate from the first frame, if it holds one; what is cut off is left out."""
    number = lambda pos, size: int.from_bytes(media[pos : pos + size], "big") if pos + size <= len(media) else None
    if media[mark : mark + 4] in (b"Xing", b"Info"):
        flags, pos, found = number(mark + 4, 4) or 0, mark + 8, {}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                found[name] = number(pos, 4)
                pos += 4
        toc = media[pos : pos + 100] if flags & 4 else None
    elif media[at + 36 : at + 40] == b"VBRI":
        found = {"bytes": number(at + 46, 4), "frames": number(at + 50, 4)}
        entries, width = number(at + 54, 2) or 0, number(at + 58, 2) or 0
        toc = media[at + 62 : at + 62 + entries * width]
    else:
        return False
    out.table, out.toc = {k: v for k, v in found.items() if v is not None}, toc
    return True


def parse(media: bytes) -> Stream:
    """Frames, tags, seek table and checks of a stream, whatever stands between the frames."""
    out = Stream()
    at, first, end = _tag(media, out), True, len(media)
    if end >= 128 and media[end - 128 : end - 125] == b"TAG":
        end -= 128
        out.tags.setdefault("TIT2", media[end + 3 : end + 33].decode("latin-1").rstrip("\0 "))
    synced = True
    while at + 4 <= end:
        head = parse_header(media[at : at + 4])
        ends = at + head.length if head else 0
        # out of step, a header counts only if a frame or the end follows where it says so
        if not head or ends > end or not synced and ends != end and not parse_header(media[ends : ends + 4]):
            nxt = media.find(b"\xff", at + 1, end)
            out.skipped += (nxt if nxt >= 0 else end) - at
            synced, at = False, nxt if nxt >= 0 else end
            continue
        synced = True
        data = at + 4 + 2 * head.checked
        if head.checked:
            bits = _checked_bits(head, media[data : data + 64])
            if crc16(media[at + 2 : at + 4] + media[data : data + -(-bits // 8)].ljust(-(-bits // 8), b"\0"), 16 + bits) != int.from_bytes(media[at + 4 : at + 6], "big"):
                out.bad_checks += 1
        if not (first and _table(media[:ends], at, data + head.side, out)):
            out.frames.append((at, head))
        first, at = False, ends
    return out


def payload_of(media: bytes, stream: Stream) -> bytes:
    """The bytes that encode() stored, read from the frames found."""
    if not stream.frames:
        return b""
    starts = (at + 4 + 2 * h.checked + h.side for at, h in stream.frames)
    return b"".join(media[s : s + UNIT] for s in starts)


#: Samples of one step of the measures.
_PIECE = 1 << 20


def feature_of(payload: bytes, stream: Stream) -> str:
    """Durations as exact fractions of samples, checks, seek offsets and measures of the samples."""
    # in pieces that share a sample, so that a long text does not take many times its size
    total = energy = crossings = peak = 0
    for s in range(0, len(payload), _PIECE):
        x = np.frombuffer(payload[max(0, s - 1) : s + _PIECE], np.uint8).astype(np.int64) - 128
        crossings += int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
        x = x[1:] if s else x
        total, energy, peak = total + int(x.sum()), energy + int((x * x).sum()), max(peak, int(np.abs(x).max()))
    rate = stream.frames[0][1].rate if stream.frames else 0
    offsets = hashlib.md5(np.array([at for at, _ in stream.frames], "<i8").tobytes()).hexdigest()
    kbps = sum(h.kbps for _, h in stream.frames) / max(1, len(stream.frames))
    return (
        f"frames={len(stream.frames)};samples={stream.samples}/{rate};kbps={kbps:.3f};bad={stream.bad_checks};skipped={stream.skipped};"
        f"table={(stream.table or {}).get('frames', -1)};seek={offsets};sum={total};energy={energy};crossings={crossings};peak={peak}"
    )


def pad(text: str | None) -> tuple[bytes, int]:
    data = (text or "").encode()
    return data.ljust(max(1, -(-len(data) // UNIT)) * UNIT, b"\xff"), len(data)


#: Media bytes of one Arrow batch that leaves a task.
BATCH_BYTES = 4 << 20


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, media): each text as a stream."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("media", pa.binary())])
        for batch in batches:
            ids, media, size = [], [], 0
            for i, text in zip(batch.column(0), batch.column(1), strict=True):
                media.append(encode(*pad(text.as_py())))
                ids.append(i.as_py())
                size += len(media[-1])
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(media, pa.binary())], schema=schema)
                    ids, media, size = [], [], 0
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(media, pa.binary())], schema=schema)

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(write, "doc_id long, media binary")


def probe_media(df: DataFrame, id_col: str = "doc_id", media_col: str = "media", offsets: bool = False) -> DataFrame:
    """One row per media value, with everything read back from the stored bytes.

    offsets adds frame_offsets, array<long>: where each frame begins, for exact seeks.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, value in zip(batch.column(0), batch.column(1), strict=True):
                media = value.as_py() or b""
                stream = parse(media)
                payload = payload_of(media, stream) if all(h.layer == 3 and h.length >= UNIT + 6 + h.side for _, h in stream.frames) else b""
                rate = stream.frames[0][1].rate if stream.frames else None
                row = {
                    "doc_id": doc_id.as_py(),
                    "n_bytes": int(said) if (said := stream.tags.get("n_bytes", "")).isascii() and said.isdigit() and len(said) < 19 else None,
                    "payload_bytes": len(payload),
                    "payload_sha256": hashlib.sha256(payload).hexdigest(),
                    "tail_crc32": zlib.crc32(payload[-32:]),
                    "media_bytes": len(media),
                    "media_sha256": hashlib.sha256(media).hexdigest(),
                    "feature": feature_of(payload, stream),
                    "n_frames": len(stream.frames),
                    "duration_us": stream.samples * 1_000_000 // rate if rate else None,
                    "bad_checks": stream.bad_checks,
                }
                rows.append(row | ({"frame_offsets": [at for at, _ in stream.frames]} if offsets else {}))
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    longs = {"n_bytes", "payload_bytes", "tail_crc32", "media_bytes", "n_frames", "duration_us", "bad_checks", "doc_id"}
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames", "duration_us", "bad_checks"]
    schema = pa.schema([(n, pa.int64() if n in longs else pa.string()) for n in names] + ([("frame_offsets", pa.list_(pa.int64()))] if offsets else []))
    spark_schema = ", ".join(f"{n} {'long' if n in longs else 'string'}" for n in names) + (", frame_offsets array<long>" if offsets else "")
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media")).mapInArrow(read, spark_schema)

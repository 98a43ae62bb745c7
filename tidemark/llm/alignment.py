"""Tokens of two tokenizers over the same bytes: groups between common ends, links, counts of linked ids.

Tokenizer A is a byte-level file of tokenizers, B a byte-fallback model of sentencepiece. A text is
cut at spaces that follow anything but white space: neither tokenizer has a token across such a
place, and both end one there, so each new piece of text between two cuts is encoded and aligned
on its own, and a text's groups are those of its pieces in order. A worker remembers pieces; beyond
a number, or a size, of them it keeps those met most often and aligns the others anew.

Within pieces, the libraries' own spans (character offsets of tokenizers, byte spans of the
sentencepiece proto) are coarse cuts. Tokens that hold part of a character, and byte-fallback
tokens, share a span; their ends come from decoded bytes, counted from the coarse cut before.
(The installed sentencepiece has no immutable proto any more; its plain proto has the same spans.)

Counts of linked id pairs cover all documents. The pairs with more than 2**-18 of all entries, at
most 2**18 of them whatever the corpus, go to every task; the others meet their counts in an
equi-join, where no pair has more rows than that share.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, written
from .tokens import _byte_letters

#: A piece of text: a word before a mark; or white space, words, and what follows up to a space behind anything but white space.
_LETTER, _MARK = r"[^\W\d_²³¹]", "[.,;:!?)]"
_PIECE = re.compile(rf" ?{_LETTER}++(?={_MARK})|\s*\S+(?:[^\S ]\s*\S*)*|\s+")
#: Stands before pieces that begin with a mark while they are encoded.
_CARRIER = " a"
#: White space of Python alone, and the model's own sign for a space; a text with them is one piece.
_ODD_SPACE = re.compile("[\x1c-\x1f▁]")

#: Pieces, entries of their pairs, and characters of them and their groups, that a worker remembers before it forgets all but those met most often.
CACHE_PIECES, CACHE_PAIRS, CACHE_CHARS = 300_000, 2_000_000, 24_000_000
#: Longer pieces, in characters of them and their groups, are forgotten however often they are met.
LONG_PIECE = 4_000
#: Characters that are cut and aligned at once, and of new pieces that the libraries' results are held of at once.
BATCH_CHARS, LEARN_CHARS = 1 << 19, 1 << 17
#: Characters of new pieces in a call of a library, about.
BUNDLE_CHARS = 8_000
#: Pairs with more than this share of all entries are sent to every task.
HOT_SHARE = 2.0**-18
#: Entries that a task counts at once, and whose counts it looks up at once.
COUNT_ENTRIES, SCORE_ENTRIES = 1_000_000, 250_000


def _ends(begin: np.ndarray, end: np.ndarray, sizes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Byte ends of tokens in pieces end to end.

    begin, end: coarse spans; sizes: decoded bytes; first: marks the first token of each piece.
    A coarse end holds where the next token begins no earlier; between such cuts decoded sizes count on.
    """
    if not len(end):
        return end
    cut = np.append((begin[1:] >= end[:-1]) & (end[1:] > end[:-1]) | first[1:], True)
    upto = np.cumsum(sizes)
    last = np.maximum.accumulate(np.where(cut, np.arange(len(end)), -1))
    last = np.concatenate([[-1], last[:-1]])  # the cut before each token
    base = np.where(last < 0, 0, end[last] - upto[last])
    return np.where(cut, end, base + upto)


def _ragged(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run of counts[i] elements."""
    upto = np.cumsum(counts)
    return np.arange(upto[-1] if len(upto) else 0) - np.repeat(upto - counts, counts)


def _tally(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of their weights."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.add.reduceat(np.ones(len(keys), np.int64) if weights is None else weights[order], starts)


class Aligner:
    """Aligned pieces by number: token, group and link counts, linked pairs, and the groups as text."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte_of = {c: bytes([i]) for i, c in enumerate(_byte_letters())}
        entries = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.a_bytes[i] = b"".join(byte_of.get(c, c.encode()) for c in entry)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))
        #: a model with a piece over a cut takes whole texts
        self.cuts = not any(re.search(f"[^▁]▁|{_LETTER}{_MARK}", p) for i, p in enumerate(pieces) if not self.b.is_byte(i))
        self.text = [str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.said: list[str] = []
        self.figures = np.zeros((0, 5), np.int64)  # tokens of A, of B, groups, links, whether bytes differ
        self.codes, self.times, self.start = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)
        self.met, self.chars = np.zeros(0, np.int64), 0

    def forget(self) -> None:
        """Keeps the pieces met most often, of those met more than once, up to half of what a worker remembers."""
        pieces, at = list(self.number), np.fromiter(self.number.values(), np.int64, len(self.number))
        chars = np.array([len(x) + len(self.said[k]) for x, k in self.number.items()], np.int64)
        often = np.argsort(-self.met[at], kind="stable")
        often = often[(self.met[at[often]] > 1) & (chars[often] <= LONG_PIECE)]
        pairs = np.cumsum(self.start[at[often] + 1] - self.start[at[often]])
        often = often[: CACHE_PIECES // 2][((pairs <= CACHE_PAIRS // 2) & (np.cumsum(chars[often]) <= CACHE_CHARS // 2))[: CACHE_PIECES // 2]]
        at = at[often]
        reps = self.start[at + 1] - self.start[at]
        entry = np.repeat(self.start[at], reps) + _ragged(reps)
        self.codes, self.times, self.start = self.codes[entry], self.times[entry], np.append(0, np.cumsum(reps))
        self.figures, self.met, self.chars = self.figures[at], self.met[at], int(chars[often].sum())
        self.said = [self.said[k] for k in at.tolist()]
        self.number = {pieces[i]: k for k, i in enumerate(often.tolist())}

    def pieces(self, text: str) -> list[str]:
        spaced = " " + text
        if not self.cuts or _ODD_SPACE.search(text):
            return [spaced]
        found = _PIECE.findall(spaced)
        if len(found) > 1 and found[-1] == " ":  # the model makes nothing of an empty text, so a last space stays with its word
            found[-2:] = [found[-2] + " "]
        return found

    def _bundles(self, new: list[str]) -> tuple[list[str], list[str]]:
        """Pieces joined again, so that a call of a library has many, and the pieces with carriers as they lie there.

        White space at an end would meet the next piece's space, so it ends a bundle.
        """
        laid, out, held, chars = [], [], [], 0
        for x in new:
            if x[0] != " ":
                held.append(_CARRIER)
            held.append(x)
            chars += len(x)
            if chars > BUNDLE_CHARS or x[-1].isspace() or not self.cuts or x[-1] == "▁":
                laid += held
                out.append("".join(held))
                held, chars = [], 0
        return ([*out, "".join(held)], laid + held) if held else (out, laid)

    def _spans_a(self, bundles: list[str], at: np.ndarray) -> tuple[np.ndarray, ...]:
        """Ids and coarse byte spans; at: byte where each bundle begins."""
        found = self.a.encode_batch(bundles, add_special_tokens=False)
        ids = np.concatenate([np.array(x.ids, np.int64) for x in found])
        raw = np.frombuffer("".join(bundles).encode(), np.uint8)
        byte_of = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        chars = np.concatenate([[0], np.cumsum([len(x) for x in bundles])])
        spans = np.concatenate([np.array(x.offsets, np.int64).reshape(-1, 2) + c for x, c in zip(found, chars, strict=False)])
        return ids, byte_of[spans[:, 0]], byte_of[spans[:, 1]]

    def _spans_b(self, bundles: list[str], at: np.ndarray) -> tuple[np.ndarray, ...]:
        """The model adds the space that every bundle begins with."""
        found = [x.pieces for x in self.b.encode([x[1:] for x in bundles], return_type="proto", num_threads=1)]
        got = np.array([(t.id, t.begin, t.end) for x in found for t in x], np.int64).reshape(-1, 3)
        sizes = np.array([len(x) for x in found])
        first = _ragged(sizes) == 0
        begin = np.repeat(at, sizes)
        return got[:, 0], begin + got[:, 1] + np.where(first, 0, 1), begin + got[:, 2] + 1

    def _side(self, raw: list[bytes], at: np.ndarray, found: tuple[np.ndarray, ...], known: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Ids, their pieces and byte ends, and the pieces whose tokens don't join to their bytes."""
        ids, begin, end = found
        piece = np.searchsorted(at, begin, "right") - 1
        counted = np.bincount(piece, sizes[ids], len(raw)).astype(np.int64)
        differs = counted != [len(x) for x in raw]
        if differs.any() or b"".join([known[i] for i in ids.tolist()]) != b"".join(raw):
            joined = [[] for _ in raw]
            for p, i in zip(piece.tolist(), ids.tolist(), strict=True):
                joined[p].append(known[i])
            differs = np.array([b"".join(j) != r for j, r in zip(joined, raw, strict=True)])
        first = np.concatenate([[True], piece[1:] != piece[:-1]]) if len(piece) else np.zeros(0, bool)
        refined = _ends(begin, end, sizes[ids], first)
        decoded = np.cumsum(sizes[ids]) - np.concatenate([[0], np.cumsum(counted)])[piece] + at[piece]
        wrong = np.bincount(piece, refined != decoded, len(raw)) > 0  # spans that don't tell whole characters
        return ids, piece, np.where(wrong[piece], decoded, refined), differs

    def learn(self, new: list[str]) -> None:
        """Remembers new pieces, a portion at a time."""
        made, at = [], 0
        while at < len(new):
            to, chars = at, 0
            while to < len(new) and (to == at or chars + len(new[to]) <= LEARN_CHARS):
                chars += len(new[to])
                to += 1
            made.append(self._learnt(new[at:to]))
            at = to
        figures, codes, times, sizes = zip(*made, strict=True)
        self.figures = np.concatenate([self.figures, *figures])
        self.codes, self.times = np.concatenate([self.codes, *codes]), np.concatenate([self.times, *times])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(np.concatenate(sizes))])
        self.met = np.concatenate([self.met, np.zeros(len(self.said) - len(self.met), np.int64)])

    def _learnt(self, new: list[str]) -> tuple[np.ndarray, ...]:
        """Numbers new pieces; their figures, pair codes, how often each is linked, and pairs of each piece."""
        bundles, laid = self._bundles(new)
        raw = [x.encode() for x in laid]
        at = np.concatenate([[0], np.cumsum([len(x) for x in raw])])[:-1].astype(np.int64)
        begins = np.concatenate([[0], np.cumsum([len(x.encode()) for x in bundles])])[:-1].astype(np.int64)
        a, a_piece, a_end, a_bad = self._side(raw, at, self._spans_a(bundles, begins), self.a_bytes, self.a_size)
        b, b_piece, b_end, b_bad = self._side(raw, at, self._spans_b(bundles, begins), self.b_bytes, self.b_size)
        bad = a_bad | b_bad
        keep_a, keep_b = ~bad[a_piece], ~bad[b_piece]
        a, a_piece, a_end, b, b_piece, b_end = a[keep_a], a_piece[keep_a], a_end[keep_a], b[keep_b], b_piece[keep_b], b_end[keep_b]
        common = a_end[np.isin(a_end, b_end, assume_unique=True)]
        a_group, b_group = np.searchsorted(common, a_end), np.searchsorted(common, b_end)
        n_a, n_b = (np.bincount(x, minlength=len(common)) for x in (a_group, b_group))
        group_piece = np.zeros(len(common), np.int64)
        group_piece[a_group] = a_piece
        count = lambda x, w=None: np.bincount(x, w, len(laid)).astype(np.int64)
        links = np.zeros(len(laid), np.int64)
        np.add.at(links, group_piece, n_a * n_b)
        figures = np.stack([count(a_piece), count(b_piece), count(group_piece), links, bad.astype(np.int64)], axis=1)

        # distinct ids of each group and side, then their products, then distinct pairs of each piece
        width_a, width_b = len(self.a_bytes), len(self.b_bytes)
        ka, wa = _tally(a_group * width_a + a)
        kb, wb = _tally(b_group * width_b + b)
        ga, gb = ka // width_a, kb // width_b
        in_b = np.bincount(gb, minlength=len(common))
        b_from = np.concatenate([[0], np.cumsum(in_b)])[:-1]
        reps = in_b[ga]
        other = np.repeat(b_from[ga], reps) + _ragged(reps)
        code = np.repeat(ka % width_a, reps) * width_b + kb[other] % width_b
        piece = np.repeat(group_piece[ga], reps)
        times = np.repeat(wa, reps) * wb[other]
        order = np.lexsort((code, piece))
        piece, code, times = piece[order], code[order], times[order]
        starts = np.flatnonzero(np.concatenate([[True], (piece[1:] != piece[:-1]) | (code[1:] != code[:-1])])) if len(code) else np.zeros(0, np.int64)

        text_a, text_b = ([self.text[i] for i in x.tolist()] for x in (a, b))
        a_cut, b_cut = np.concatenate([[0], np.cumsum(n_a)]).tolist(), np.concatenate([[0], np.cumsum(n_b)]).tolist()
        groups = [",".join(text_a[a_cut[g] : a_cut[g + 1]]) + "|" + ",".join(text_b[b_cut[g] : b_cut[g + 1]]) for g in range(len(common))]
        g_cut = np.concatenate([[0], np.cumsum(count(group_piece))]).tolist()
        said = [";".join(groups[g_cut[p] : g_cut[p + 1]]) for p in range(len(laid))]
        self.number.update((x, k) for k, x in enumerate(laid, len(self.said)) if x is not _CARRIER)
        self.said += said
        self.chars += sum(map(len, laid)) + sum(map(len, said))
        return figures, code[starts], np.add.reduceat(times, starts) if len(starts) else times, np.bincount(piece[starts], minlength=len(laid))

    def align(self, texts: list[str]) -> list[tuple]:
        """For each text: tokens of A and B, groups, links, the groups' hash, distinct pair codes and how often each is linked."""
        lists = [self.pieces(t) if t else [] for t in texts]
        new = list(set().union(*lists).difference(self.number))
        if new:
            if len(self.said) + len(new) > CACHE_PIECES or len(self.codes) > CACHE_PAIRS or self.chars > CACHE_CHARS:
                self.forget()
                new = list(set().union(*lists).difference(self.number))
            self.learn(new)
        sizes = np.array([len(x) for x in lists], np.int64)
        numbers = np.fromiter(chain.from_iterable(map(self.number.__getitem__, x) for x in lists), np.int64, int(sizes.sum()))
        self.met += np.bincount(numbers, minlength=len(self.met))
        doc = np.repeat(np.arange(len(texts)), sizes)
        sums = np.zeros((len(texts), 5), np.int64)
        np.add.at(sums, doc, self.figures[numbers])
        sums[sums[:, 4] > 0] = 0
        kept = sums[:, 0] > 0
        used, uses = _tally((doc * len(self.said) + numbers)[kept[doc]])
        used_doc, used_piece = used // len(self.said), used % len(self.said)
        reps = self.start[used_piece + 1] - self.start[used_piece]
        entry = np.repeat(self.start[used_piece], reps) + _ragged(reps)
        space = len(self.a_bytes) * len(self.b_bytes)
        keys, times = _tally(np.repeat(used_doc, reps) * space + self.codes[entry], np.repeat(uses, reps) * self.times[entry])
        cuts = np.searchsorted(keys, np.arange(len(texts) + 1) * space).tolist()
        codes, out, at = keys % space, [], 0
        for i, n in enumerate(sizes.tolist()):
            digest = sha256(";".join([self.said[k] for k in numbers[at : at + n].tolist()]).encode()).hexdigest() if kept[i] else ""
            out.append((*sums[i, :4].tolist(), digest, codes[cuts[i] : cuts[i + 1]], times[cuts[i] : cuts[i + 1]]))
            at += n
        return out


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One aligner a worker."""
    return Aligner(a_path, b_path)


def _portions(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs [at, to) of rows of at most so much in sum, or of one row."""
    upto, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(upto, most + upto[at] - sizes[at], "right")))
        yield at, to
        at = to


def _lengths(column: pa.Array, measure: Callable[[pa.Array], pa.Array]) -> np.ndarray:
    return measure(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


_ALIGNED = "uid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes binary, times binary"


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per document with its linked id pairs: codes (id of A * size of B + id of B, ascending) and times,
    both little-endian unsigned 32-bit numbers (64-bit codes for vocabularies whose product needs them)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it, uid = aligner(a_path, b_path), TaskContext.get().partitionId() << 36
        width = code_type(len(it.a_bytes), len(it.b_bytes))
        schema = pa.schema([(n, {"groups_sha256": pa.string(), "codes": pa.binary(), "times": pa.binary()}.get(n, pa.int64())) for n in _names(_ALIGNED)])
        for batch in batches:
            for at, to in _portions(_lengths(batch.column(1), pc.utf8_length), BATCH_CHARS):
                ids, texts = (batch.column(c).slice(at, to - at).to_pylist() for c in (0, 1))
                rows = it.align([t or "" for t in texts])
                data = [range(uid, uid + len(rows)), ids, *zip(*(r[:5] for r in rows), strict=True)]
                data += [[r[5].astype(width).tobytes() for r in rows], [r[6].astype("<u4").tobytes() for r in rows]]
                yield pa.RecordBatch.from_arrays([pa.array(d, f.type) for d, f in zip(map(list, data), schema, strict=True)], schema=schema)
                uid += len(rows)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, _ALIGNED)


def _names(ddl: str) -> list[str]:
    return [x.split()[0] for x in ddl.split(", ")]


def code_type(a_size: int, b_size: int) -> str:
    return "<u4" if a_size * b_size <= 2**32 else "<u8"


def pair_counts(rows: DataFrame, width: str) -> DataFrame:
    """(code, n): how many documents hold each id pair linked; tasks count theirs before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], ["code", "n"])

        keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held, size = [], 0
        for batch in batches:
            for blob in batch.column(0):
                held.append(np.frombuffer(blob.as_buffer(), width))
                size += len(held[-1])
                if size > COUNT_ENTRIES:
                    new, seen = np.unique(np.concatenate(held), return_counts=True)
                    keys, n = _tally(np.concatenate([keys, new.astype(np.int64)]), np.concatenate([n, seen]))
                    held, size = [], 0
                    if len(keys) > COUNT_ENTRIES:
                        yield told(keys, n)
                        keys, n = keys[:0], n[:0]
        if held:
            new, seen = np.unique(np.concatenate(held), return_counts=True)
            keys, n = _tally(np.concatenate([keys, new.astype(np.int64)]), np.concatenate([n, seen]))
        yield told(keys, n)

    return rows.select("codes").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def with_best(counts: DataFrame, b_size: int) -> DataFrame:
    """Adds whether a pair's count is the highest of its A id. The highest counts are one row an id of A."""
    own = F.floor(F.col("code") / F.lit(b_size))
    highest = counts.groupBy(own.alias("a")).agg(F.max("n").alias("top"))
    return counts.withColumn("a", own).join(F.broadcast(highest), "a").select("code", "n", (F.col("n") == F.col("top")).alias("best"))


def scores(rows: DataFrame, counts: DataFrame, width: str, b_size: int) -> DataFrame:
    """(uid, n_best, count_sum) over the links of each row of aligned()."""
    spark = rows.sparkSession
    known = with_best(counts, b_size)
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot_table = known.where(F.col("n") > F.lit(total * HOT_SHARE)).toArrow().sort_by("code")  # under 2**18 rows: each has over 2**-18 of the total
    hot = spark.sparkContext.broadcast(tuple(hot_table.column(c).to_numpy() for c in ("code", "n", "best")))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row of a document's hot pairs (under a code of its own, that no pair has), and one a cold pair."""
        hot_code, hot_n, hot_best = hot.value
        entry = np.dtype(width).itemsize
        for batch in (b.slice(at, to - at) for b in batches for at, to in _portions(_lengths(b.column(1), pc.binary_length) // entry, SCORE_ENTRIES)):
            uid = batch.column(0).to_numpy()
            codes = [np.frombuffer(x, width).astype(np.int64) for x in batch.column(1).to_pylist()]
            times = [np.frombuffer(x, "<u4").astype(np.int64) for x in batch.column(2).to_pylist()]
            doc = np.repeat(np.arange(len(uid)), [len(x) for x in codes])
            code, time = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (codes, times))
            place = np.minimum(np.searchsorted(hot_code, code), max(len(hot_code) - 1, 0))
            is_hot = hot_code[place] == code if len(hot_code) else np.zeros(len(code), bool)
            sums = np.zeros((2, len(uid)), np.int64)
            np.add.at(sums[0], doc[is_hot], time[is_hot] * hot_best[place[is_hot]])
            np.add.at(sums[1], doc[is_hot], time[is_hot] * hot_n[place[is_hot]])
            nothing = np.zeros(int((~is_hot).sum()), np.int64)
            columns = [(uid, uid[doc[~is_hot]]), (-1 - uid, code[~is_hot]), (uid * 0, time[~is_hot]), (sums[0], nothing), (sums[1], nothing)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in columns], ["uid", "code", "times", "hot_best", "hot_sum"])

    parts = rows.select("uid", "codes", "times").mapInArrow(score, "uid long, code long, times long, hot_best long, hot_sum long")
    cold = known.where(F.col("n") <= F.lit(total * HOT_SHARE))
    met = parts.join(cold, "code", "left")
    return met.groupBy("uid").agg(
        F.sum(F.col("hot_best") + F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("hot_sum") + F.coalesce(F.col("times") * F.col("n"), F.lit(0))).alias("count_sum"),
    )


def align_documents(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    docs: doc_id, text; other columns are not read, whatever their names. Repeated rows and ids give
    one row each and count as documents each. Null and empty texts, and texts whose tokens don't join
    to the text (a literal U+2581), have zeros and an empty hash. An empty table gives an empty table.
    A group's links are counted over distinct ids, so that runs without a common end stay small.
    """
    import public_tokenizers

    a_path, b_path = a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model")
    here = aligner(a_path, b_path)
    width = code_type(len(here.a_bytes), len(here.b_bytes))
    with scratch() as made:
        rows = written(aligned(docs, a_path, b_path), "aligned")
        counts = written(pair_counts(rows, width), "pair_counts")
        out = rows.drop("codes", "times").join(scores(rows, counts, width, len(here.b_bytes)), "uid")
        out = written(out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"), "alignment")
        made.remove(out)
    return out


def token_links(text: str, a_path: str, b_path: str) -> tuple[list[int], list[int], str]:
    """One text's ids by both tokenizers and its groups as `a1,a2|b1;a3|b2`, for a look at a document."""
    it = aligner(a_path, b_path)
    it.align([text])
    said = ";".join(it.said[it.number[p]] for p in it.pieces(text)) if text else ""
    pick = lambda k: [int(i) for g in said.split(";") if g for i in g.split("|")[k].split(",")]
    return pick(0), pick(1), said

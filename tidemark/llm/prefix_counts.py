"""Exact token counts of every prefix of a text, by dynamic programming over prefixes.

For a byte-level BPE file, a token sequence is the encoding of its bytes exactly if each pair of
neighbours is: so the last token of a prefix is the one whose pair with the last token of the
prefix before it holds, and count[i] = count[i - len(token)] + 1. Tokens that end at a byte come
from an automaton of the vocabulary; whether a pair holds is read from the merges that make it.

The table of a text holds, for each of its characters, the step of the count when that character
is added (it can fall, when a merge is completed). Lengths, truncation and budgets are then read
from the table; nothing is encoded again. Texts are cut where the file's own split always cuts, so
that the table of a word is made once a worker; each new word's count is compared with the library.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from operator import sub

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from .common import scratch, written
from .tokens import _byte_letters

# White space as the library's expressions have it, and its split before the merges.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
_SPACES = frozenset(re.findall(f"[{_SPACE}]", "".join(map(chr, range(0x3001)))))
_CONTRACTIONS = {"'re", "'ve", "'ll"}

#: A word before a mark, or white space and what follows up to the next: places where the split always cuts.
_PIECE = re.compile(r" ?[^\W\d_²³¹]++(?=[.,;:!?)])|\s*\S+|\s+")
#: White space of Python alone; a text with it is one piece.
_ODD_SPACE = re.compile("[\x1c-\x1f]")

#: Pieces, and words inside them, that a worker remembers before it starts afresh.
CACHE_PIECES = 600_000
#: Characters that are held at once, and those of new pieces in one call of the library.
BATCH_CHARS, BUNDLE_CHARS = 2 << 20, 8_000

_NEVER = 1 << 30


class PrefixCounter:
    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import ahocorasick
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        made = json.loads(self.library.to_str())
        model, split = made["model"], made["pre_tokenizer"] or {}
        known = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not made["normalizer"]
        if not known or model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("prefix tables are made for byte-level BPE files of the usual split")
        self.words = regex.compile(_SPLIT)
        self.marks = sorted((t["content"] for t in made["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, self.marks)) + ")") if self.marks else None

        letters = {c: chr(i) for i, c in enumerate(_byte_letters())}
        vocabulary = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = {vocabulary[a] << 20 | vocabulary[b]: r for r, (a, b) in enumerate(pairs)}
        #: each token's right and left edges, from the byte up: (symbol, rank of the merge that takes it)
        self.right: dict[int, list[tuple[int, int]]] = {}
        self.left: dict[int, list[tuple[int, int]]] = {}
        for entry in letters:
            if entry in vocabulary:
                self.right[vocabulary[entry]] = self.left[vocabulary[entry]] = [(vocabulary[entry], _NEVER)]
        reached = set(self.right)
        for r, (a, b) in enumerate(pairs):
            token, a, b = vocabulary[a + b], vocabulary[a], vocabulary[b]
            if token in self.right:
                raise ValueError("two merges make one token")
            self.right[token] = [*self.right[b][:-1], (b, r), (token, _NEVER)]
            self.left[token] = [*self.left[a][:-1], (a, r), (token, _NEVER)]
            if a in reached and b in reached and self._crossing(a, b) == (a, b):
                reached.add(token)  # its own bytes give this token and no other
        self.automaton = ahocorasick.Automaton()
        for entry, i in vocabulary.items():
            if i in reached:
                key = "".join(letters[c] for c in entry)
                self.automaton.add_word(key, (len(key), i))
        self.automaton.make_automaton()
        self.holds: dict[int, bool] = {}
        self.clear()

    def clear(self) -> None:
        self.steps: dict[str, bytes] = {}
        self.wide: dict[str, np.ndarray] = {}
        self.counts: dict[str, list[int]] = {}

    def _crossing(self, a: int, b: int) -> tuple[int, int] | None:
        """The first merge over the boundary when tokens a and b stand side by side: merges go by rank, then from the left."""
        xs, ys, i, j = self.right[a], self.left[b], 0, 0
        while True:
            (x, x_ends), (y, y_ends) = xs[i], ys[j]
            r = self.rank.get(x << 20 | y)
            if r is not None and r < x_ends and r <= y_ends:
                return x, y
            if x_ends <= y_ends:
                if x_ends == _NEVER:
                    return None
                i += 1
            else:
                j += 1

    def prefixes(self, word: str) -> list[int]:
        """Token counts of a word's prefixes, one a character: the dynamic programme."""
        found = self.counts.get(word)
        if found is not None:
            return found
        raw = word.encode()
        count, last = [0] * (len(raw) + 1), [0] * (len(raw) + 1)
        holds = self.holds
        for end, (size, token) in self.automaton.iter(raw.decode("latin-1")):
            end += 1
            if count[end]:
                continue
            start = end - size
            if start:
                pair = last[start] << 20 | token
                ok = holds.get(pair)
                if ok is None:
                    if len(holds) > 4_000_000:
                        holds.clear()
                    ok = holds[pair] = self._crossing(last[start], token) is None
                if not ok:
                    continue
            count[end], last[end] = count[start] + 1, token
        found = count[1:]
        if len(raw) > len(word):
            found = [c for c, follows in zip(found, [*raw[1:], 0], strict=True) if follows & 0xC0 != 0x80]
        self.counts[word] = found
        return found

    def _table(self, piece: str) -> list[int]:
        """Counts of a piece's prefixes: words before the last one are whole, but for what the split looks ahead at."""
        out, base, last = [], 0, ""
        for word in self.words.findall(piece):
            found = self.prefixes(word)
            whole = found[-1]
            if last and last[-1] in _SPACES and word[0] in _SPACES:
                found = [self.prefixes(last + word[0])[-1] - self.prefixes(last)[-1], *found[1:]]  # up to here all white space is one word
            elif word in _CONTRACTIONS:
                found = [found[0], self.prefixes(word[0])[-1] + self.prefixes(word[1])[-1], found[2]]
            out += [base + c for c in found] if base else found
            base, last = base + whole, word
        return out

    def learn(self, new: list[str]) -> None:
        """Tables of new pieces; where the library counts another total (other Unicode tables), it counts every prefix."""
        held: list[tuple[list[str], int]] = []
        bundle, chars, total = [], 0, 0
        for piece in new:
            table = self._table(piece)
            self._keep(piece, table)
            if bundle and (chars > BUNDLE_CHARS or not piece[0].isspace() or bundle[-1][-1].isspace()):
                held.append((bundle, total))
                bundle, chars, total = [], 0, 0
            bundle.append(piece)
            chars, total = chars + len(piece), total + table[-1]
        if bundle:
            held.append((bundle, total))
        told = self.library.encode_batch_fast(["".join(b) for b, _ in held], add_special_tokens=False)
        for (pieces, count), x in zip(held, told, strict=True):
            if len(x) != count:
                for piece in pieces:
                    n = len(self.library.encode(piece, add_special_tokens=False).ids)
                    if n != self._table(piece)[-1]:
                        self._keep(piece, [len(x) for x in self.library.encode_batch_fast([piece[:k] for k in range(1, len(piece) + 1)], add_special_tokens=False)])
        if len(self.counts) > CACHE_PIECES:
            self.counts.clear()

    def _keep(self, piece: str, table: list[int]) -> None:
        steps = list(map(sub, table, [0, *table]))
        try:
            self.steps[piece] = array("b", steps).tobytes()
            self.wide.pop(piece, None)
        except OverflowError:
            self.steps[piece], self.wide[piece] = b"", np.array(steps, np.int64)

    def _pieces(self, text: str) -> list[str]:
        return [text] if text and _ODD_SPACE.search(text) else _PIECE.findall(text)

    def tables(self, texts: list[str]) -> list[tuple[int, np.ndarray]]:
        """Token count and steps of each text."""
        parts: list[list[tuple[list[str], int, int]]] = []  # pieces, characters they stand for, whether a special token follows
        for text in texts:
            if self.special is None or not any(m in text for m in self.marks):
                parts.append([(self._pieces(text), len(text), 0)])
                continue
            cut = self.special.split(text)
            own = [(self._pieces(cut[k] + cut[k + 1][:-1]), len(cut[k]), 1) for k in range(0, len(cut) - 1, 2)]
            parts.append([*own, (self._pieces(cut[-1]), len(cut[-1]), 0)])
        new = list(set().union(*(p for x in parts for p, _, _ in x)).difference(self.steps))
        if new:
            if len(self.steps) + len(new) > CACHE_PIECES:
                self.clear()
                new = list(set().union(*(p for x in parts for p, _, _ in x)))
            self.learn(new)
        out = []
        for x in parts:
            segments = []
            for pieces, chars, follows in x:
                if self.wide and any(p in self.wide for p in pieces):
                    steps = np.concatenate([self.wide[p] if p in self.wide else np.frombuffer(self.steps[p], np.int8) for p in pieces])
                else:
                    steps = np.frombuffer(b"".join(map(self.steps.__getitem__, pieces)), np.int8)
                if follows:  # prefixes that end inside the special string are plain text; its last character makes it one token
                    before, inside = int(steps[:chars].sum(dtype=np.int64)), int(steps.sum(dtype=np.int64))
                    steps = np.append(steps.astype(np.int64), before + 1 - inside)
                segments.append(steps)
            steps = segments[0] if len(segments) == 1 else np.concatenate(segments)
            out.append((int(steps.sum(dtype=np.int64)), steps))
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    """One counter a worker."""
    return PrefixCounter(path)


def _stored(steps: np.ndarray) -> tuple[int, bytes]:
    """Bytes of a step, and the steps."""
    if not len(steps) or steps.min() >= -128 and steps.max() <= 127:
        return 1, steps.astype("<i1").tobytes()
    return 8, steps.astype("<i8").tobytes()


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_TABLE = "doc_id long, n_bytes long, n_chars long, n_tokens long, step_bytes int, steps binary"


def prefix_tables(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: doc_id, n_bytes, n_chars, n_tokens, and steps, the change of the token count at each character.

    docs: doc_id, text; other columns are not read, whatever their names. A null text counts as an empty
    one, with no steps and zeros; repeated rows give a row each; an empty table gives an empty table.
    step_bytes: 1, or 8 where a step leaves the range of a byte.
    """
    path = path or default_tokenizer()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it = counter(path)
        for batch in batches:
            ids, texts, at = batch.column(0), [t or "" for t in batch.column(1).to_pylist()], 0
            while at < len(texts):
                to, chars = at, 0
                while to < len(texts) and (to == at or chars + len(texts[to]) <= BATCH_CHARS):
                    chars += len(texts[to])
                    to += 1
                rows = it.tables(texts[at:to])
                kept = [_stored(r[1]) for r in rows]
                data = [ids[at:to], [len(t.encode()) for t in texts[at:to]], [len(t) for t in texts[at:to]], [r[0] for r in rows]]
                arrays = [pa.array(d, pa.int64()) for d in data] + [pa.array([k[0] for k in kept], pa.int32()), pa.array([k[1] for k in kept], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in _TABLE.split(", ")])
                at = to

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, _TABLE)


def _counts(step_bytes: int, steps: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(steps, f"<i{step_bytes}"), dtype=np.int64)


@pandas_udf(LongType())
def _at(step_bytes: pd.Series, steps: pd.Series, chars: pd.Series) -> pd.Series:
    return pd.Series([int(np.frombuffer(s, f"<i{w}")[: max(0, int(c))].sum(dtype=np.int64)) for w, s, c in zip(step_bytes, steps, chars, strict=True)])


@pandas_udf(LongType())
def _within(step_bytes: pd.Series, steps: pd.Series, budget: pd.Series) -> pd.Series:
    out = []
    for w, s, b in zip(step_bytes, steps, budget, strict=True):
        fits = np.flatnonzero(_counts(w, s) <= b)
        out.append(int(fits[-1]) + 1 if len(fits) else 0)
    return pd.Series(out, dtype="int64")


def tokens_of_prefix(chars: Column) -> Column:
    """Over the columns of prefix_tables(): exact tokens of the first `chars` characters; all of them if there are fewer."""
    return _at("step_bytes", "steps", chars.cast("long"))


def longest_prefix(budget: Column) -> Column:
    """Over the columns of prefix_tables(): characters of the longest prefix of at most `budget` tokens."""
    return _within("step_bytes", "steps", budget.cast("long"))


def truncated(docs: DataFrame, tables: DataFrame, budget: int, text: str = "text") -> DataFrame:
    """The texts cut to the longest prefix of at most `budget` tokens, from their stored tables, joined by doc_id (distinct ids)."""
    cut = tables.select("doc_id", longest_prefix(F.lit(budget)).alias("_chars"))
    return docs.join(cut, "doc_id").withColumn(text, F.expr(f"substring({text}, 1, int(_chars))")).drop("_chars")


def count_documents(docs: DataFrame, limit: int = 512, path: str | None = None) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens), from its stored table.

    The tables are written to the shared folder, the count of the whole text is that of its last prefix.
    """
    with scratch() as made:
        tables = written(prefix_tables(docs, path), "prefix_tables")
        made.remove(tables)
    return tables.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

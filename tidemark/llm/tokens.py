"""Token ids of texts by a public tokenizer file, with a cache of words.

The file's word-level tokenizers split a text into words before they merge, so equal words give
equal ids: texts of the usual characters are split here and each new word goes to the model
once. Any other text, and any tokenizer of another make, goes to the library whole. Both give
the ids of Tokenizer.encode(text, add_special_tokens=False).
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import chain, islice

import numpy as np

# How the word-level file normalises and splits; other files take the plain way.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# The same split for characters below U+0250, where letters, numbers and spaces are these.
_LETTER, _NUMBER, _SPACE = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", "\\t-\\r \x85\xa0"
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")
#: Higher characters, and those whose lower case is two characters or a higher one.
_UNUSUAL = re.compile("[^\x00-įı-ȹȻ-Ƚȿ-ɏ]")

#: Words that a worker remembers; beyond that it forgets all but the half met most often.
CACHE_WORDS = 400_000


def _byte_letters() -> list[str]:
    """The letter of each byte in byte-level vocabularies: printable ones stand for themselves, the rest from U+0100."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class _Numbers(dict):
    """Numbers of words from 0, given as they are first looked up."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class _Words:
    """Ids of the words met so far: a number for each word, and the ids of all of them end to end."""

    def __init__(self, tokenizer) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.plain = Tokenizer(tokenizer.model)
        self.plain.pre_tokenizer = WhitespaceSplit()
        self.letters = dict(enumerate(_byte_letters())) | {32: " "}
        vocabulary = tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.number = _Numbers()
        self.flat, self.start = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.met = np.zeros(0, np.int64)

    def forget(self) -> None:
        """Keeps the words met most often, of those met more than once."""
        often = np.argsort(-self.met, kind="stable")[: CACHE_WORDS // 2]
        often = np.sort(often[self.met[often] > 1])
        words = list(self.number)
        self.flat, upto = self.laid(often)
        self.start, self.met = np.append(0, upto), self.met[often]
        self.number = _Numbers(zip([words[i] for i in often.tolist()], range(len(often)), strict=True))

    def learn(self, new: list[str]) -> None:
        """The ids of the words numbered last."""
        joined = " ".join(new).encode().decode("latin-1").translate(self.letters)
        ids = np.array(self.plain.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
        stops = np.flatnonzero(self.ends[ids]) + 1
        assert len(stops) == len(new), "a word has no last token"
        self.start = np.concatenate([self.start, stops + len(self.flat)])
        self.flat = np.concatenate([self.flat, ids])
        self.met = np.concatenate([self.met, np.zeros(len(new), np.int64)])

    def encode(self, lists: list[list[str]]) -> list[np.ndarray]:
        if len(self.number) > CACHE_WORDS:
            self.forget()
        known = len(self.number)
        try:
            at = np.fromiter(map(self.number.__getitem__, chain.from_iterable(lists)), np.int64, sum(map(len, lists)))
            if len(self.number) > known:
                self.learn(list(islice(self.number, known, None)))
        except BaseException:
            self.clear()  # numbers without ids must not stay
            raise
        self.met += np.bincount(at, minlength=len(self.met))
        ids, upto = self.laid(at)
        cuts = np.append(0, upto)[np.cumsum([len(x) for x in lists])]
        return np.split(ids, cuts[:-1])

    def laid(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words of these numbers end to end, where each word's end)."""
        begin = self.start[at]
        sizes = self.start[at + 1] - begin
        upto = np.cumsum(sizes)
        return self.flat[np.repeat(begin - upto + sizes, sizes) + np.arange(upto[-1] if len(upto) else 0)], upto


#: Characters that are split into words at once.
BATCH_CHARS = 2 << 20


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        steps, pre = (made.get("normalizer") or {}), (made.get("pre_tokenizer") or {})
        split = (pre.get("pretokenizers") or [{}])[0]
        wordwise = (
            [x["type"] for x in steps.get("normalizers", [])] == _NORMALIZERS
            and split.get("pattern", {}).get("Regex") == _SPLIT
            and made["model"]["type"] == "BPE"
            and made["model"].get("dropout") is None
            and made["model"].get("end_of_word_suffix") == "</w>"
        )
        self.words = _Words(self.tokenizer) if wordwise else None
        #: text that holds one of these needs the library, which finds them before it splits
        self.marks = [t["content"] for t in made.get("added_tokens", [])]

    def _usual(self, text: str) -> bool:
        return self.words is not None and (text.isascii() or not _UNUSUAL.search(text)) and not ("<" in text and any(m in text for m in self.marks))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text as unsigned 32-bit numbers."""
        out: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            to, chars = at, 0
            while to < len(texts) and (to == at or chars + len(texts[to]) <= BATCH_CHARS):
                chars += len(texts[to])
                to += 1
            usual = [self._usual(t) for t in texts[at:to]]
            ids = iter(self.words.encode([_WORDS.findall(t.lower()) for t, u in zip(texts[at:to], usual, strict=True) if u]) if any(usual) else ())
            for text, plain in zip(texts[at:to], usual, strict=True):
                out.append(next(ids) if plain else np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32))
            at = to
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder a worker."""
    return Encoder(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")

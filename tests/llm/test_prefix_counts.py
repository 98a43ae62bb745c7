"""Prefix tables against the library on every prefix."""

import random

from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import prefix_counts

PARTS = ["a", "b", " ", "  ", "\n", "\r\n", "\t", "é", "😀", "Ⅸ", "　", "漢字", "\x1c", "'re", "'ve", "'ll", "'s", "12", "▁", "<|endoftext|>", "<|endof", "ing", "the",
         "=", "====", "́", "\xa0", "\x85", "don't", "'", "aaaa", "aaaaaaaaa", " the", "Hello", "²", "_", ".", ","]


def told(library, texts):
    return [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]


def test_every_prefix_is_counted_as_the_library_counts_it():
    library, draw = Tokenizer.from_file(prefix_counts.default_tokenizer()), random.Random(7)
    it = prefix_counts.PrefixCounter(prefix_counts.default_tokenizer())
    texts = ["".join(draw.choices(PARTS, k=draw.randint(0, 12))) for _ in range(800)] + [" " * 400 + "b", " " * 301, "=-" * 200, "😀" * 60, "a" * 500]
    for text, (n, steps) in zip(texts, it.tables(texts), strict=True):
        counts = steps.astype("int64").cumsum().tolist()
        assert counts == told(library, [text[:k] for k in range(1, len(text) + 1)]), text[:80]
        assert n == (counts[-1] if counts else 0)


def test_where_the_programme_differs_the_library_counts(monkeypatch):
    """Another split than the library's: every prefix is then counted by the library itself."""
    import regex

    library = Tokenizer.from_file(prefix_counts.default_tokenizer())
    it = prefix_counts.PrefixCounter(prefix_counts.default_tokenizer())
    it.words = regex.compile(r"\S|\s+")
    text = "Hello there, you two."
    assert it.tables([text])[0][1].astype("int64").cumsum().tolist() == told(library, [text[:k] for k in range(1, len(text) + 1)])


def test_documents_budgets_and_hard_rows(spark):
    library = Tokenizer.from_file(prefix_counts.default_tokenizer())
    texts = [None, "", "one two  three", "one two  three", "<|endoftext|>x", "é😀 " * 300, "word " * 3000]
    rows = [(None if i == 2 else i, t, "z", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, steps string, n_tokens int")
    got = prefix_counts.count_documents(docs)
    want = [(r[0], len((t or "").encode()), n, n > 512) for r, t, n in zip(rows, texts, told(library, [t or "" for t in texts]), strict=True)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert prefix_counts.count_documents(docs.limit(0)).collect() == []

    ids = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    tables = prefix_counts.prefix_tables(ids)
    for r in tables.select("doc_id", prefix_counts.tokens_of_prefix(F.lit(9)).alias("n"), prefix_counts.longest_prefix(F.lit(3)).alias("cut")).collect():
        text = texts[r.doc_id] or ""
        counts = [0, *told(library, [text[:k] for k in range(1, min(len(text), 60) + 1)])]
        assert r.n == counts[min(9, len(text))] and r.cut == max(k for k, c in enumerate(counts) if c <= 3)
    cut = {r.doc_id: r.text for r in prefix_counts.truncated(ids, tables, 512).collect()}
    assert len(library.encode(cut[6]).ids) == 512 and texts[6].startswith(cut[6]) and cut[0] is None and cut[3] == texts[3]


def test_steps_that_leave_a_byte(spark):
    import numpy as np

    for steps in ([0, 1, 200], [1, -130], []):
        width, raw = prefix_counts._stored(np.array(steps, np.int64))
        assert np.frombuffer(raw, f"<i{width}").tolist() == steps

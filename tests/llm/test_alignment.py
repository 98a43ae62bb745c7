"""Tokens of two tokenizers against an alignment of whole texts, and corpus-wide counts against plain ones."""

import random
from collections import Counter
from hashlib import sha256

import public_tokenizers
import pytest

from tidemark.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def whole(it, text):
    """Both libraries over the whole text, decoded bytes, common ends, all pairs of each group."""
    ids_a = it.a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
    ids_b = it.b.encode(text) if text else []
    bytes_a, bytes_b = [it.a_bytes[i] for i in ids_a], [it.b_bytes[i] for i in ids_b]
    if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return 0, 0, 0, 0, "", {}

    def ends(tokens):
        at, out = 0, []
        for t in tokens:
            at += len(t)
            out.append(at)
        return out

    ends_a, ends_b = ends(bytes_a), ends(bytes_b)
    groups, i, j = [], 0, 0
    for cut in sorted({*ends_a} & {*ends_b}):
        a, b = [], []
        while i < len(ids_a) and ends_a[i] <= cut:
            a.append(ids_a[i])
            i += 1
        while j < len(ids_b) and ends_b[j] <= cut:
            b.append(ids_b[j])
            j += 1
        groups.append((a, b))
    pairs = Counter((x, y) for a, b in groups for x in a for y in b)
    said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
    return len(ids_a), len(ids_b), len(groups), sum(pairs.values()), sha256(said.encode()).hexdigest(), dict(pairs)


PARTS = ["a", "b", " ", "  ", "\n", "\r\n", "\t", "é", "😀", "Ⅸ", "　", "漢字", "\x1c", "'re", "'s", "12", "▁", "<|endoftext|>", "ing", "the", "=", "====", "́",
         "\xa0", "\x85", "<s>", "</s>", "<0x0A>", "don't", "<unk>", ",", ".", "²", "²."]
LONG = [" " * 5000 + "b", " " * 3001, "=-" * 2000, "😀" * 300, "word, " * 5000]


@pytest.mark.parametrize("batch", [1, 200])
def test_pieces_give_the_groups_of_whole_texts(batch):
    it, draw = alignment.Aligner(A, B), random.Random(5)
    texts = ["".join(draw.choices(PARTS, k=draw.randint(0, 14))) for _ in range(600)] + LONG
    for at in range(0, len(texts), batch):
        some = texts[at : at + batch]
        for text, got in zip(some, it.align(some), strict=True):
            pairs = {(int(c) // len(it.b_bytes), int(c) % len(it.b_bytes)): int(n) for c, n in zip(got[5], got[6], strict=True)}
            assert (*got[:5], pairs) == whole(it, text), text[:80]


def test_a_cache_that_is_cleared_changes_nothing(monkeypatch):
    monkeypatch.setattr(alignment, "CACHE_PIECES", 30)
    it, draw = alignment.Aligner(A, B), random.Random(6)
    for _ in range(20):
        texts = ["".join(draw.choices(PARTS, k=9)) for _ in range(20)]
        assert [g[:5] for g in it.align(texts)] == [whole(it, t)[:5] for t in texts]


@pytest.mark.parametrize("limit", ["CACHE_PIECES", "CACHE_PAIRS", "CACHE_CHARS"])
def test_what_a_worker_remembers_is_bounded_and_holds_the_pieces_met_often(monkeypatch, limit):
    most = 300
    monkeypatch.setattr(alignment, limit, most, raising=False)
    it, draw, learnt = alignment.Aligner(A, B), random.Random(7), Counter()
    learn = it.learn
    monkeypatch.setattr(it, "learn", lambda new: (learnt.update(new), learn(new))[1])
    batch = {"CACHE_PIECES": 0, "CACHE_PAIRS": 0, "CACHE_CHARS": 0}
    for i in range(60):
        texts = ["the cat sat", "the cat sat", *["".join(draw.choices("abcdefghij", k=8)) for _ in range(20)], "x▁" + "yz " * draw.randint(1, 50)]
        assert [g[:5] for g in it.align(texts)] == [whole(it, t)[:5] for t in texts]
        seen = {"CACHE_PIECES": len(it.said), "CACHE_PAIRS": len(it.codes), "CACHE_CHARS": sum(map(len, it.number)) + sum(map(len, it.said))}
        if not i:
            batch = seen
        assert seen[limit] <= most + 3 * batch[limit]
    assert learnt[" cat"] == 1


def test_a_long_piece_is_not_remembered_for_good():
    it = alignment.Aligner(A, B)
    long = "\x1c" + "ab" * 5000
    it.align([long, long, "the cat", "the cat"])
    it.forget()
    assert " " + long not in it.number and " cat" in it.number
    assert [g[:5] for g in it.align([long, "the cat"])] == [whole(it, t)[:5] for t in (long, "the cat")]


def test_libraries_take_few_new_pieces_at_once(monkeypatch):
    monkeypatch.setattr(alignment, "LEARN_CHARS", 500, raising=False)
    it, draw, taken = alignment.Aligner(A, B), random.Random(8), []
    spans = it._spans_a
    monkeypatch.setattr(it, "_spans_a", lambda bundles, at: (taken.append(sum(map(len, bundles))), spans(bundles, at))[1])
    texts = [" ".join("".join(draw.choices("abcdefghij", k=8)) for _ in range(100)) for _ in range(10)]
    assert [g[:5] for g in it.align(texts)] == [whole(it, t)[:5] for t in texts]
    assert len(taken) > 10 and max(taken) < 2 * 500


def test_small_portions_change_nothing(spark, monkeypatch):
    texts = [None, "", "the cat, the hat", "Ⅸ the", "x▁y", "the 😀", *["the end of the cat"] * 9, "word " * 200]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    want = sorted(map(tuple, alignment.align_documents(docs).collect()))
    for name, most in {"BATCH_CHARS": 6, "SCORE_ENTRIES": 3, "COUNT_ENTRIES": 2}.items():
        monkeypatch.setattr(alignment, name, most)
    assert sorted(map(tuple, alignment.align_documents(docs).collect())) == want
    portions = list(alignment._portions(alignment.np.array([3, 0, 4, 9, 1, 5, 0]), 6))
    assert portions == [(0, 2), (2, 3), (3, 4), (4, 7)]


@pytest.mark.parametrize("share", [alignment.HOT_SHARE, 0.02, 2.0])
def test_counts_over_all_documents(spark, monkeypatch, share):
    """Whichever pairs are sent to every task: a few, many, none."""
    monkeypatch.setattr(alignment, "HOT_SHARE", share)
    texts = [None, "", " ", "the cat, the hat", "the cat, the hat", "Ⅸ the", "x▁y", "don't the 😀", "cat" * 50, *["the end"] * 40]
    rows = [(i // 2 if i % 5 else None, t, "en", 7) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, uid string, code int").repartition(3)
    it = alignment.Aligner(A, B)
    found = [whole(it, t) for t in texts]
    count = Counter(p for w in found for p in w[5])
    top = {}
    for (a, _), n in count.items():
        top[a] = max(top.get(a, 0), n)
    want = [(r[0], *w[:4], sum(n for p, n in w[5].items() if count[p] == top[p[0]]), sum(n * count[p] for p, n in w[5].items()), w[4]) for r, w in zip(rows, found, strict=True)]
    got = alignment.align_documents(docs)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert alignment.align_documents(docs.limit(0)).collect() == []


def test_links_of_one_text():
    a, b, said = alignment.token_links("the cat", A, B)
    assert (len(a), len(b)) == (2, 2) and said == f"{a[0]}|{b[0]};{a[1]}|{b[1]}"
    assert alignment.token_links("", A, B) == ([], [], "")

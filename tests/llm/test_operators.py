"""Each operator on hard rows, on no rows, and against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, embedding_dedup, jaccard_join, materialise, mixing, mpeg, packing, pii, quality, substring, suffix, tokens, windows

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard string, key string, class int, word string, label int, _id long, _key string, _hash long, _nth int, _text string, row int, row_key string, taken_text string"
LONG = " ".join(f"w{i % 977}" for i in range(40_000))
PASSAGE = " ".join(f"p{i}" for i in range(60))
ROWS = [
    (None, "a null id " + PASSAGE, "en", "a"),
    (1, None, "en", "a"),
    (2, "", None, None),
    (3, "one", "en", ""),
    (3, "one", "en", ""),
    (4, "one two three", "en", "b"),
    (5, LONG, "en", "b"),
    (6, LONG + " tail", "en", "b"),
    (7, "x " + PASSAGE + " y", "en", "c"),
    (8, "z " + PASSAGE, "en", None),
    (9, "ONE TWO three", "fr", "b"),
    (10, "é" * 300 + " " + PASSAGE[:150], "fr", "c"),
    (11, " \t\n ", "fr", "c"),
    (12, "a " * 500, "fr", "c"),
    (-5, PASSAGE, "fr", "\U0001f600"),
]


@pytest.fixture(scope="module")
def hard(spark):
    rows = [(i, t, la, s, None if t is None else len(t), 1, "x", "k", 2, "w", 1, 7, "k", 9, 1, "t", 3, "r", "u") for i, t, la, s in ROWS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words(text):
    return WORD.findall((text or "").encode())


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def order(doc_id):
    return (doc_id is not None, doc_id or 0)


# 1 mixing


@pytest.mark.parametrize("name", ["hard", "docs"])
def test_mixing_reaches_targets(name, request):
    df = request.getfixturevalue(name)
    got = rows_of(mixing.mix_sources(df, block_tokens=64, shard_tokens=500))
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, len(words(t))) for i, t in texts_of(df))
    by = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by.setdefault(r["source"], []).append(r)
    sizes = {s: sum(r["size"] for r in rs) for s, rs in by.items()}
    everything = sum(sizes.values())
    # water filling by repeated resharing
    places = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(places)}
    target, open_ = {}, set(places)
    while True:
        left = 1.5 * everything - sum(target[s] for s in places if s not in open_)
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_} if open_ else {}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        target |= {s: 2.0 * sizes[s] if s in over else share[s] for s in open_}
        open_ -= over
        if not over:
            break
    for s, rs in by.items():
        assert all(abs(r["target"] - target[s]) < 1e-6 * max(1, target[s]) and r["source_size"] == sizes[s] for r in rs)
        assert abs(sum(r["taken"] for r in rs) - target[s]) <= max(2, 0.02 * target[s])


def test_mixing_takes_effect_and_takes_no_rows(spark, docs, none):
    taken = mixing.mix_sources(docs).agg(F.sum("taken")).first()[0]
    out = mixing.take_documents(docs)
    assert out.columns == docs.columns
    assert out.agg(F.sum(F.regexp_count("text", F.lit(common.WORD)))).first()[0] == taken
    assert mixing.mix_sources(none).count() == 0 and mixing.take_documents(none).count() == 0


def test_sainte_lague_against_highest_quotients(spark):
    rng = np.random.default_rng(3)
    for n, seats in ((1, 7), (5, 3), (12, 1000), (40, 0)):
        w = np.append(rng.integers(0, 500, n), 100_000)
        df = spark.createDataFrame([(0, i, float(x), seats) for i, x in enumerate(w)], "g int, i int, w double, seats long")
        got = {r["i"]: r["q"] for r in mixing.sainte_lague(df, ["g"], "w", "seats", [F.col("i")], "q").collect()}
        want = [0] * len(w)
        for _ in range(seats):
            want[max(range(len(w)), key=lambda i: (w[i] / (2 * want[i] + 1), -i))] += 1
        assert [got[i] for i in range(len(w))] == want


# 2 embeddings


def brute_links(rows, min_cos=0.98):
    good = []
    for i, (vec_id, v, label) in enumerate(rows):
        if vec_id is not None and label is not None and v and None not in v:
            x = np.array(v, float)
            if np.isfinite(x).all() and x.any():
                good.append((i, x / np.linalg.norm(x), label))
    links, up = [0] * len(rows), list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, (i, x, p) in enumerate(good):
        for j, y, q in good[:a]:
            if p == q and len(x) == len(y) and x @ y >= min_cos:
                links[i], links[j] = links[i] + 1, links[j] + 1
                up[top(i)] = top(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[top(i)] = min(least.get(top(i), r[0]), r[0])
    return Counter((r[0], links[i], None if r[0] is None else least[top(i)]) for i, r in enumerate(rows))


def test_embedding_links(spark):
    rng = np.random.default_rng(1)
    rows = [(None, [1.0, 2.0], 1), (1, None, 1), (2, [0.0, 0.0], 1), (3, [1.0, None], 1), (4, [float("nan"), 1.0], 1), (5, [1.0, 2.0], None), (6, [1.0, 2.0], 1), (6, [1.0, 2.0], 1), (7, [2.0, 4.0], 1), (8, [1.0], 1), (9, [], 1)]
    for k in range(40):
        base = rng.normal(size=16)
        rows += [(100 + 10 * k + j, (base + rng.normal(size=16) * 0.11 * j / 3).tolist(), int(k % 3)) for j in range(8)]
    schema = "vec_id long, embedding array<double>, label int, key string, n_links int"
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], schema).repartition(3)
    out = rows_of(embedding_dedup.dedup_embeddings(df, tile_rows=50))
    assert Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in out) == brute_links(rows)
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in out)
    assert embedding_dedup.dedup_embeddings(spark.createDataFrame([], schema)).count() == 0


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100, 102: 100}


# 3 shingles


def shingles(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


@pytest.mark.parametrize("name", ["hard", "docs", "chain"])
def test_jaccard_components(spark, name, request, monkeypatch):
    if name == "chain":
        # near copies that drift: neighbours link, ends don't; and many texts that share a passage
        base = [f"t{i}" for i in range(120)]
        drift = [(k, " ".join(f"u{k}_{i}" if i < 6 * k else w for i, w in enumerate(base))) for k in range(15)]
        shared = [(1000 + k, PASSAGE + " " + " ".join(f"v{k}_{i}" for i in range(k % 90))) for k in range(150)]
        df = spark.createDataFrame(drift + shared, "doc_id long, text string").repartition(3)
        monkeypatch.setattr(jaccard_join, "SMALL", 8)
        monkeypatch.setattr(jaccard_join, "CELL_BYTES", 40 * 256)
    else:
        df = request.getfixturevalue(name)
    rows = texts_of(df)
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, s in enumerate(sets):
        for j in range(i):
            if s and sets[j] and 100 * len(s & sets[j]) >= 75 * len(s | sets[j]):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    want = Counter((d, len(sets[i]), (least.get(top(i)) if sets[i] else d)) for i, (d, _) in enumerate(rows))
    got = rows_of(jaccard_join.join_documents(df))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want


def test_jaccard_of_nothing_and_keeping_one(none, hard):
    assert jaccard_join.join_documents(none).count() == 0
    kept = rows_of(jaccard_join.keep_one(hard))
    ids = Counter(r["doc_id"] for r in kept)
    assert ids[3] == 1 and ids[6] == 0 and ids[5] == 1 and ids[9] == 0 and ids[4] == 1 and ids[2] == 1 and ids[1] == 1


def test_region_pairs_lose_nothing():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    sets = []
    for k in range(300):
        drop = rng.random(400) < rng.choice([0.02, 0.1, 0.5])
        sets.append(np.unique(np.concatenate([base[~drop], rng.integers(0, 1 << 63, int(drop.sum() * rng.random()), dtype=np.uint64)])))
    n = np.array([len(s) for s in sets])
    pairs = {tuple(p) for p in jaccard_join.cell_pairs([jaccard_join.bitmap_of(s) for s in sets], n, np.ones(300, bool)).T.tolist()}
    for i in range(300):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 75 * (n[i] + n[j] - both):
                assert (j, i) in pairs


# 4 packing


@pytest.mark.parametrize("name", ["hard", "docs"])
def test_packing(name, request):
    df = request.getfixturevalue(name)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_tokenizer())
    want = Counter()
    for d, text in texts_of(df):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want.update((d, k, s, len(p := ids[s : s + 2048]), zlib.crc32(p.tobytes())) for k, s in enumerate(range(0, len(ids), 2048)))
    got = rows_of(packing.pack_documents(df))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r["length"] for r in got)
    assert len(bins) <= -(-total // 2048) * 1.02 + 1


def test_packing_nothing_and_fullest(none):
    assert packing.pack_documents(none).count() == 0
    rng = np.random.default_rng(2)
    for _ in range(30):
        counts = {int(n): int(rng.integers(1, 4)) for n in rng.integers(1, 60, 6)}
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1) if s + n * k <= 100}
        taken = packing.fullest(counts, 100)
        assert sum(n * k for n, k in taken.items()) == max(sums) and all(k <= counts[n] for n, k in taken.items())


def test_encoder_equals_library():
    from tokenizers import Tokenizer

    texts = [t or "" for _, t, *_ in ROWS] + ["<|endoftext|> a", "İstanbul don't I'LL x", "Ωσς ΣΑΣ", "a\x85b\xa0c\x1cd ²³ ½ ǅ", "日本 語 12.5 a_b'rex'd"]
    plain = Tokenizer.from_file(tokens.default_tokenizer())
    for text, ids in zip(texts, tokens.Encoder(tokens.default_tokenizer()).encode(texts), strict=True):
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids


# 5 quality


def test_words_met_often_are_learned_once(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "CACHE_WORDS", 8)
    enc, learned = tokens.Encoder(tokens.default_tokenizer()), Counter()
    learn = enc.words.learn
    enc.words.learn = lambda new: (learned.update(new), learn(new))
    plain = Tokenizer.from_file(tokens.default_tokenizer())
    for i in range(20):
        texts = [f"the of the {chr(97 + i) * 5} and", f"x{chr(97 + i)} of and", ""]
        for text, ids in zip(texts, enc.encode(texts), strict=True):
            assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids
    assert learned["the"] == learned["of"] == learned["and"] == 1 and len(learned) > 40


def test_quality_is_accurate_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r for r in rows_of(quality.score_documents(docs, labels))}
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [(got[r["doc_id"]]["predicted"], r["quality"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    assert np.mean([p == q for p, q in held]) > 0.95
    kept = {r["doc_id"] for r in quality.keep_good(docs, labels).collect()}
    assert kept == {i for i, r in got.items() if r["predicted"]}


def test_quality_on_hard_rows(spark, hard, none):
    labels = spark.createDataFrame([(None, 1), (5, None), (5, 1), (6, 0), (7, 1), (8, 1), (9, 0)], "doc_id long, quality int")
    out = rows_of(quality.score_documents(hard, labels))
    assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in ROWS) and all(0 <= r["score"] <= 1 for r in out)
    assert quality.score_documents(none, labels).count() == 0
    assert {r["score"] for r in rows_of(quality.score_documents(hard, labels.where("false")))} == {0.5}
    assert all(np.isfinite(quality.statistics(t)).all() for _, t, *_ in ROWS)


def test_isotonic_is_monotone_and_pools():
    x, y = quality.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([10.0, 10, 10, 10]), np.array([1.0, 5, 3, 9]))
    assert len(x) == 3 and (np.diff(y) > 0).all()


# 6 and 7 repeats


@pytest.mark.parametrize("name", ["hard", "docs"])
def test_substring_dedup(name, request):
    df = request.getfixturevalue(name)
    rows = [(d, words(t)) for d, t in texts_of(df)]
    seen = Counter(tuple(w[i : i + 35]) for _, w in rows for i in range(len(w) - 34))
    want = Counter()
    for d, w in rows:
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = True
        want[d, len(w), int(gone.sum()), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()] += 1
    got = rows_of(substring.remove_repeats(df))
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == want
    assert all((r["n_factors"] > 0) == (r["n_removed"] > 0) for r in got)


@pytest.mark.parametrize("name", ["hard", "docs"])
def test_suffix_dedup(name, request):
    df = request.getfixturevalue(name)
    rows = [(d, (t or "").encode()) for d, t in texts_of(df)]
    first = {}
    for d, b in rows:
        for i in range(len(b) - 99):
            k = b[i : i + 100]
            first[k] = min(first.get(k, (order(d), i)), (order(d), i))
    want = Counter()
    for d, b in rows:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 99):
            if first[b[i : i + 100]] < (order(d), i):
                gone[i : i + 100] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[d, len(b), int(gone.sum()), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()] += 1
    got = rows_of(suffix.remove_later_copies(df))
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want


def test_repeats_of_nothing(none):
    assert substring.remove_repeats(none).count() == 0 and suffix.remove_later_copies(none).count() == 0


def test_anchors_depend_on_content_alone():
    rng = np.random.default_rng(9)
    inner = rng.integers(0, 9, 60).astype(np.uint64)
    found = []
    for pad in (0, 7, 31):
        x = np.concatenate([rng.integers(0, 9, pad).astype(np.uint64), inner, rng.integers(0, 9, 20).astype(np.uint64)])
        start, anchor = windows.anchors(windows.Ranges(windows.mix(x)), np.array([0]), np.array([len(x)]), 35, 12)
        found.append([(s - pad, a - pad) for s, a in zip(start, anchor, strict=True) if pad <= s <= pad + 25])
    assert found[0] == found[1] == found[2]


# 8 media


def test_media_round_trip(hard, none):
    df = mpeg.probe_media(mpeg.encode_documents(hard), offsets=True)
    got = Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows_of(df))
    want = Counter()
    for d, t, *_ in ROWS:
        b = (t or "").encode()
        p = b + b"\xff" * (-len(b) % 576 or (576 if not b else 0))
        want[d, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])] += 1
    assert got == want
    assert all(r["bad_checks"] == 0 and r["duration_us"] == r["n_frames"] * 36_000 and len(r["frame_offsets"]) == r["n_frames"] for r in rows_of(df))
    assert mpeg.probe_media(mpeg.encode_documents(none)).count() == 0


def test_media_parser_resynchronises():
    payload, n = mpeg.pad("x" * 2000)
    media = mpeg.encode(payload, n)
    first = mpeg.parse(media).frames[0][0]
    junk = media[:first] + b"\xff\xfb\x90junk" * 5 + media[first:] + b"TAG" + b"title".ljust(125, b"\0")
    s = mpeg.parse(junk)
    assert len(s.frames) == 4 and s.skipped == 35 and s.tags["TIT2"] == "title" and mpeg.payload_of(junk, s) == payload
    broken = bytearray(media)
    broken[first + 8] ^= 1
    assert mpeg.parse(bytes(broken)).bad_checks == 1
    for value in (b"", b"\xff", b"ID3", b"\xff\xfb" * 50, bytes(500)):
        assert mpeg.parse(value).samples == 0
    assert mpeg.parse_header(bytes((0xFF, 0xFB, 0x90, 0x00))).length == 417 and mpeg.parse_header(bytes((0xFF, 0xFD, 0x90, 0x00))).samples == 1152


# 9 personal data


def plain_spans(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_personal_data(spark, docs, hard, none):
    made = ["a@b.c@d.e.f", "@x.y a@b", "x" * 500 + "@", "1.2.3.4.5.6.7.8 999.1.1.1 01.002.3.255", "4111 1111 1111 1111-", "4111-1111 11111112", "+1 (555) 010-9999 ext +12", "+((((", "é mail: ü@ä.b o.k@x-y.zz.", "1" * 3000 + ".1.1.1"]
    for text in [t for _, t in texts_of(docs)] + made + [t for _, t, *_ in ROWS]:
        assert [s[:3] for s in pii.find_spans(text) if s[0] in pii.BASE_KINDS] == plain_spans(text)
    out = rows_of(pii.scan_documents(docs))
    for r, text in ((r, dict(texts_of(docs))[r["doc_id"]]) for r in out[:50]):
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in plain_spans(text))
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
    assert pii.scan_documents(hard).count() == len(ROWS) and pii.scan_documents(none).count() == 0
    assert pii.redact_documents(hard).columns == hard.columns
    assert [s[0] for s in pii.find_spans("iban GB82 WEST 1234 5698 7654 32 and my social security 123-45-6789")] == ["iban", "national_id"]
    assert pii.find_spans("GB82 WEST 1234 5698 7654 33, part 123-45-6789") == []
    assert pii.redact("mail a@b.co now", pii.find_spans("mail a@b.co now")) == "mail <EMAIL> now"


# 10 training order


def test_permutation():
    for n in (1, 2, 3, 10, 1000, 4097):
        slots = materialise.permute(np.arange(n), n, 7)
        assert sorted(slots.tolist()) == list(range(n))
        assert (materialise.permute(slots, n, 7, inverse=True) == np.arange(n)).all()
    assert (materialise.permute(np.arange(100), 100, 1) != materialise.permute(np.arange(100), 100, 2)).any()


def test_training_order_files(hard, none, tmp_path):
    rows = rows_of(materialise.materialise(hard, f"file://{tmp_path}/out", stride_ids=64, shard_slots=100))
    assert sorted(r["slot"] for r in rows) == sorted(r["record"] for r in rows) == list(range(len(rows)))
    enc = tokens.Encoder(tokens.default_tokenizer())
    want = Counter()
    for d, t, *_ in ROWS:
        ids = np.append(enc.encode([t or ""])[0], np.uint32(0))
        want.update((d, k, ids[s : s + 64].tobytes()) for k, s in enumerate(range(0, len(ids), 64)))
    got = Counter()
    for r in rows:
        with open(r["path"], "rb") as f:
            f.seek(r["byte_offset"])
            ids = np.frombuffer(f.read(128), "<u2").astype(np.uint32)
        assert r["byte_offset"] == r["slot"] % 100 * 128 and not ids[r["length"] :].any()
        ids = ids[: r["length"]]
        assert zlib.crc32(ids.tobytes()) == r["ids_crc32"]
        got[r["doc_id"], r["piece"], ids.tobytes()] += 1
    assert got == want
    assert materialise.materialise(none).count() == 0


def test_training_order_sends_no_ids_through_python_to_number_them(hard, tmp_path, monkeypatch):
    plans, written = {}, materialise.written
    monkeypatch.setattr(materialise, "written", lambda df, name: plans.update({name: df._jdf.queryExecution().optimizedPlan().toString()}) or written(df, name))
    assert materialise.materialise(hard, f"file://{tmp_path}/out", stride_ids=64, shard_slots=10).count() > 40
    assert len(plans) == 5 and all(p.count("MapInArrow") == 1 and p.count("ArrowEvalPython") == (name != "records") for name, p in plans.items())

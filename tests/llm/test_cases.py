"""Cases that were once wrong, and models against direct computations."""

import struct
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import jaccard_join, mixing, mpeg, pii, quality, substring, suffix

from .test_operators import docs, hard, none, rows_of  # noqa: F401

SF = "/root/testdata/sf0.001"


def test_one_row_of_each_group_where_ids_repeat(spark):
    df = spark.createDataFrame([(1, "a b c d e f g"), (3, "a b c d e f g"), (3, "other words that stand alone here"), (None, "x y z x y z q"), (None, "x y z x y z q"), (5, None), (5, "")], "doc_id long, text string")
    got = Counter((r["doc_id"], r["text"]) for r in rows_of(jaccard_join.keep_one(df)))
    assert got == {(1, "a b c d e f g"): 1, (3, "other words that stand alone here"): 1, (None, "x y z x y z q"): 1, (5, None): 1, (5, ""): 1}


def test_stages_keep_columns_whatever_they_are_called(spark, hard):  # noqa: F811
    labels = spark.createDataFrame([(5, 1), (6, 0), (7, 1), (8, 1), (9, 0)], "doc_id long, quality int")
    for out in (quality.keep_good(hard, labels), jaccard_join.keep_one(hard), pii.redact_documents(hard), mixing.take_documents(hard)):
        assert out.columns == hard.columns
        out.collect()


def test_mixing_is_the_same_on_any_partitioning(spark, docs):  # noqa: F811
    seen = [Counter((r["doc_id"], r["taken"], r["shard"]) for r in rows_of(mixing.mix_sources(d, block_tokens=64, shard_tokens=500))) for d in (docs.repartition(2), docs.repartition(7).orderBy(F.rand(3)))]
    assert seen[0] == seen[1]


def test_mixing_spreads_rows_without_an_id(spark):
    df = spark.createDataFrame([(None, f"one two three {i}", "a") for i in range(400)], "doc_id long, text string, source string")
    got = rows_of(mixing.mix_sources(df, shard_tokens=100))
    assert len({r["shard"] for r in got}) > 5


def test_mixing_takes_what_a_plain_version_takes(spark, docs):  # noqa: F811
    """From the shards' quotas on: blocks in seeded order over the seeded order of each shard."""
    rows = rows_of(mixing.mix_sources(docs, block_tokens=64, shard_tokens=500, ranges=True))
    by_shard = {}
    for r in rows:
        by_shard.setdefault((r["source"], r["shard"]), []).append(r)
    for shard in by_shard.values():
        # whole passes are of the shard, and what is taken besides stands inside the text without overlap
        assert len({r["passes"] for r in shard}) == 1
        for r in shard:
            spans = sorted((x["start"], x["start"] + x["words"]) for x in r["ranges"])
            assert all(a <= b and b <= r["size"] for a, b in spans) and all(b <= c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))
            assert r["taken"] == r["passes"] * r["size"] + sum(b - a for a, b in spans)
        # all blocks but one are taken whole or not at all: at most one block is cut
        partly = sum(0 < r["taken"] - r["passes"] * r["size"] < r["size"] for r in shard)
        assert partly <= 3 * sum(r["size"] for r in shard) // 64 + 3


def test_quality_model_against_a_direct_one(spark):
    rng = np.random.default_rng(3)
    width = len(quality.STATISTICS)
    x = rng.normal(size=(400, width)).astype(np.float32)
    y = (x[:, 0] + x[:, 3] ** 2 + rng.normal(size=400) * 0.3 > 1).astype(int)
    table = spark.createDataFrame([(row.tolist(), int(v)) for row, v in zip(x, y, strict=True)], "stats array<float>, label int").repartition(5)
    model = quality.fit(table, table, features=64)
    z = (x.astype(float) - x.mean(0, dtype=float)) / x.std(0, dtype=float)
    lifted = model.lift(x.astype(float))
    assert np.allclose(lifted[:, :-1], np.sqrt(2 / 64) * np.cos(np.clip(z, -8, 8) @ model.turn + model.shift), atol=1e-5)
    penalty = np.eye(65)
    penalty[-1, -1] = 1e-6
    assert np.allclose(model.weights, np.linalg.solve(lifted.T @ lifted + penalty, lifted.T @ y), atol=1e-6)
    # many features approach the Gaussian kernel
    wide = quality.Model(np.zeros(width), np.ones(width), 20_000, 0.02, 5).lift(x[:30].astype(float))[:, :-1]
    exact = np.exp(-0.02 * ((x[:30, None].astype(float) - x[None, :30]) ** 2).sum(-1))
    assert np.abs(wide @ wide.T - exact).max() < 0.05


def test_isotonic_is_the_least_squares_fit():
    rng = np.random.default_rng(4)
    n = rng.integers(1, 9, 40).astype(float)
    k = np.array([rng.integers(0, m + 1) for m in n], float)
    share = k / n
    # max over begins of min over ends of the mean between: the closed form of the monotone fit
    mean = lambda a, b: k[a : b + 1].sum() / n[a : b + 1].sum()
    want = [max(min(mean(a, b) for b in range(i, 40)) for a in range(i + 1)) for i in range(40)]
    at, value = quality.isotonic(np.arange(40.0), n, k)
    pools = np.unique(np.round(want, 9), return_counts=False)
    assert len(at) == len(pools) and share.min() <= min(want) and (np.diff(value) > 0).all()


def test_context_words_stand_alone():
    score = lambda text, kind: next(s[3] for s in pii.find_spans(text) if s[0] == kind)
    assert score("the ship sailed 10.1.2.3 away", "ip") == pii.SCORE["ip"] < score("the ip is 10.1.2.3 now", "ip")
    assert score("hotel +1 555 010 9999", "phone") == pii.SCORE["phone"] < score("tel +1 555 010 9999", "phone")


def test_probe_survives_any_bytes(spark):
    rng = np.random.default_rng(8)
    payload, n = mpeg.pad("some text " * 300)
    media = mpeg.encode(payload, n)
    values = [media[:24] + b"Xing", media.replace(b"n_bytes\0" + str(n).encode(), "n_bytes\0²²".encode("latin-1"))]
    for k in range(4000):
        x = bytearray(media[: rng.integers(1, 2000)] if k % 2 else rng.integers(0, 256, 400, dtype=np.uint8).tobytes())
        for at in rng.integers(0, len(x), 6):
            x[at] = rng.choice([0, 255, 0xFB, 0xFD, 0xFF, 73, rng.integers(256)])
        values.append(bytes(x))
    got = mpeg.probe_media(spark.createDataFrame([(i, bytearray(v)) for i, v in enumerate(values)], "doc_id long, media binary")).collect()
    assert len(got) == len(values) and sum(r["n_frames"] for r in got) > 0


def frame_of(head, bits, rest):
    data = bytes(rest)
    crc = mpeg.crc16(head[2:] + data, 16 + bits)
    parsed = mpeg.parse_header(head)
    return (head + struct.pack(">H", crc) + data).ljust(parsed.length, b"\0")


def test_other_layers_and_tables():
    one = bytes((0xFF, 0xFE, 0x50, 0xC0))  # MPEG-1 Layer I, mono, with a checksum
    good = frame_of(one, 128, range(16, 32))
    assert mpeg.parse(good * 3).bad_checks == 0 and len(mpeg.parse(good * 3).frames) == 3
    bad = bytearray(good)
    bad[8] ^= 1
    assert mpeg.parse(bytes(bad) + good).bad_checks == 1
    two = bytes((0xFF, 0xFC, 0xA4, 0xC0))  # MPEG-1 Layer II, mono, 48 kHz, 192 kbit/s: table a
    rest = bytes([0x10] + [0] * 30)  # one subband with an allocation: its scale factor choice is covered
    good = frame_of(two, 11 * 4 + 12 * 3 + 4 * 2 + 2, rest)
    assert mpeg.parse(good * 2).bad_checks == 0
    table = mpeg.parse(mpeg.encode(*mpeg.pad("x" * 5000)))
    assert table.table["frames"] == len(table.frames)
    vbri = bytearray(mpeg._frame(b""))
    vbri[36:62] = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 0, 999, 7, 2, 1, 1, 1)
    s = mpeg.parse(bytes(vbri) + mpeg._frame(b"") * 3)
    assert s.table == {"bytes": 999, "frames": 7} and len(s.frames) == 3


def test_repeats_of_many_rows_without_an_id(spark):
    passage = " ".join(f"p{i}" for i in range(50))
    rows = [(None, f"n{i} {i * 7} " + (passage if i % 2 else f"only {i}")) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter((r["n_words"], r["n_removed"]) for r in substring.remove_repeats(df).collect())
    assert got == {(52, 50): 1000, (4, 0): 1000}
    assert suffix.remove_later_copies(df).where("n_removed > 0").count() == 999


def test_factors_are_the_longest_matches(spark, monkeypatch):
    """Each factor stands at its source, and no other place goes on longer from its begin."""
    from tidemark.llm import repeats

    rng = np.random.default_rng(12)
    passages = [[f"p{k}_{i}" for i in range(int(rng.integers(30, 140)))] for k in range(6)]
    texts = {}
    for d in range(40):
        out = []
        for _ in range(4):
            p = passages[rng.integers(6)]
            a = int(rng.integers(0, len(p) // 2))
            out += [f"x{rng.integers(10**9)}" for _ in range(rng.integers(0, 9))] + p[a : a + int(rng.integers(20, 120))]
        texts[d] = out
    for crowd in (5000, 2):
        monkeypatch.setattr(repeats, "CROWD", crowd)
        df = spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id long, text string").repartition(3)
        got = {r["doc_id"]: r for r in substring.remove_repeats(df, texts=True).collect()}
        seen = Counter(tuple(w[i : i + 35]) for w in texts.values() for i in range(len(w) - 34))
        for d, w in texts.items():
            gone = set()
            for i in range(len(w) - 34):
                if seen[tuple(w[i : i + 35])] > 1:
                    gone.update(range(i, i + 35))
            assert got[d]["kept_text"] == " ".join(x for i, x in enumerate(w) if i not in gone)
            assert got[d]["n_factors"] == len(got[d]["factors"])
            for f in got[d]["factors"]:
                source = texts[f["source_doc"]][f["source_begin"] : f["source_begin"] + f["words"]]
                assert source == w[f["begin"] : f["begin"] + f["words"]] and len(source) >= 35
                assert (f["source_doc"], f["source_begin"]) != (d, f["begin"])


def test_large_regions_are_cut_and_tiled(spark, monkeypatch):
    """Groups of about 20 members: every pair that passes the bitmaps meets once or more, in a bounded group."""
    monkeypatch.setattr(jaccard_join, "CELL_BYTES", 20 * 256)
    rng = np.random.default_rng(6)
    base = [rng.integers(0, 1 << 63, 300, dtype=np.uint64) for _ in range(12)]
    sets = []
    for k in range(400):  # clusters that pivots part, and a scattered rest that they don't
        b = base[k % 12]
        drop = rng.random(300) < rng.choice([0.01, 0.08, 0.4])
        sets.append(np.unique(np.concatenate([b[~drop], rng.integers(0, 1 << 63, int(drop.sum()), dtype=np.uint64)])))
    sets += [np.unique(rng.integers(0, 1 << 63, 3000, dtype=np.uint64)) for _ in range(5)]
    sets += [np.unique(np.concatenate([sets[-1][:2900], rng.integers(0, 1 << 63, 90, dtype=np.uint64)]))]
    rows = [(7, i, len(x), i, jaccard_join.bitmap_of(x)) for i, x in enumerate(sets)]
    table = spark.createDataFrame(rows, "shingle long, class long, n long, part long, bitmap binary").repartition(4)
    groups = {}
    for r in jaccard_join.bounded_cells(table, 75).collect():
        groups.setdefault(r["group"], []).append(r)
    assert max(sum(len(r["bitmap"]) for r in g) for g in groups.values() if len(g) > 4) <= 3 * 20 * 256 + 4096
    met = set()
    for g in groups.values():
        met |= {(min(a["class"], b["class"]), max(a["class"], b["class"])) for a in g for b in g if a["class"] != b["class"] and (a["own"] or b["own"]) and (a["tile"] != b["tile"] or a["within"])}
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                assert (j, i) in met

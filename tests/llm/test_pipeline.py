"""The pipeline stage by stage against plain Python, and the registered SQL of the subpackage."""

import os
from collections import Counter

import duckdb
from pyspark.sql import functions as F
from .test_operators import WORD, shingles

import corpus_pipeline
from tidemark.llm import pii, quality, queries, tokens
from tidemark.llm.common import written

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, SF), name)
        kept[name] = docs.collect()
        old = before.collect()
        if name != "packing":
            assert docs.columns == columns
        if name == "quality":
            scores = quality.score_documents(before, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1")
            assert sorted(r.doc_id for r in kept[name]) == sorted(r.doc_id for r in scores.collect())
        if name == "near_duplicates":
            sets = {r.doc_id: shingles(r.text) for r in old}
            up = {d: d for d in sets}

            def top(d, up=up):
                while up[d] != d:
                    d = up[d]
                return d

            for a in sets:
                for b in sets:
                    if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                        x, y = sorted((top(a), top(b)))
                        up[y] = x
            assert sorted(r.doc_id for r in kept[name]) == sorted(d for d in sets if top(d) == d)
        if name == "personal_data":
            want = {r.doc_id: pii.redact(r.text, pii.find_spans(r.text)) for r in old}
            assert {r.doc_id: (r.text, r.n_chars) for r in kept[name]} == {d: (t, len(t)) for d, t in want.items()}
        if name == "mixing":
            size = lambda rows: sum(len(WORD.findall(r.text.encode())) for r in rows)
            assert abs(size(kept[name]) - 1.5 * size(old)) <= 20
            have, source = {r.doc_id: WORD.findall(r.text.encode()) for r in old}, {r.doc_id: r.source for r in old}
            for r in kept[name]:
                assert set(WORD.findall(r.text.encode())) <= set(have[r.doc_id]) and r.source == source[r.doc_id] and r.n_chars == len(r.text)
        if name == "packing":
            ids = tokens.Encoder(tokens.default_tokenizer()).encode([r.text for r in old])
            assert sum(r["length"] for r in kept[name]) == sum(len(x) + 1 for x in ids)
            assert Counter(r.doc_id for r in kept[name] if r.piece == 0) == Counter(r.doc_id for r in old)


def test_registered_sql(spark):
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, SF)
        found = con.execute(sql)
        columns = [d[0] for d in found.description]
        assert Counter(tuple(r) for r in df.select(*columns).collect()) == Counter(found.fetchall()), name


def test_run_writes_every_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.agg(F.max("length")).first()[0] <= 2048 and out.count() > 0

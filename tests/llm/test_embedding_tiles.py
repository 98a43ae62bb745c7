"""Cells of many rows: bounded tasks, every pair once."""

from collections import Counter

import numpy as np

from tidemark.llm import embedding_dedup

from .test_operators import brute_links


def test_tasks_of_a_large_cell_are_bounded(spark):
    rows = spark.range(3000).selectExpr("if(id < 2990, 0, 1) AS cell", "id AS rep", "CAST(CAST(id AS STRING) AS BINARY) AS raw")
    got = embedding_dedup.in_tiles(rows, ["cell"], 100).select("cell", "rep", "tile", "first", "second").collect()
    tasks = {}
    for r in got:
        tasks.setdefault((r["cell"], r["first"], r["second"]), []).append((r["rep"], r["tile"]))
    assert max(map(len, tasks.values())) <= 300
    met = Counter()
    for (_, a, b), members in tasks.items():
        one, two = sum(t == a for _, t in members), sum(t == b for _, t in members)
        met["pairs"] += one * two if a != b else one * (one - 1) // 2
    assert met["pairs"] == 2990 * 2989 // 2 + 10 * 9 // 2


def test_links_across_tiles(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=16)
    rows = [(i, (base + rng.normal(size=16) * 0.12).tolist(), 1) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    out = embedding_dedup.dedup_embeddings(df, tile_rows=20).collect()
    assert Counter((r["vec_id"], r["n_links"]) for r in out) == Counter((v, n) for v, n, _ in brute_links(rows).elements())

"""The registered queries of this package, each over whole tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, embedding_dedup, jaccard_join, materialise, mixing, mpeg, packing, pii, prefix_counts, quality, substring, suffix, vector_codes
from .common import read_documents


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read_documents(spark, sf_dir))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.dedup_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_documents(read_documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_documents(spark, sf_dir))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(read_documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_later_copies(read_documents(spark, sf_dir))


def op8_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg.probe_media(mpeg.encode_documents(read_documents(spark, sf_dir)))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan_documents(read_documents(spark, sf_dir))


def op10_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise.materialise(read_documents(spark, sf_dir))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(read_documents(spark, sf_dir))


def op12_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_counts.count_documents(read_documents(spark, sf_dir))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mix_sources": op1_mix_sources,
        "op2_embedding_dedup": op2_embedding_dedup,
        "op3_jaccard_join": op3_jaccard_join,
        "op4_best_fit_packing": op4_best_fit_packing,
        "op5_quality_classifier": op5_quality_classifier,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_suffix_dedup": op7_suffix_dedup,
        "op8_mpeg_audio": op8_mpeg_audio,
        "op9_personal_data": op9_personal_data,
        "op10_training_order": op10_training_order,
        "op11_tokenizer_alignment": op11_tokenizer_alignment,
        "op12_prefix_token_counts": op12_prefix_token_counts,
        "op13_vector_codes": op13_vector_codes,
    }


_WORDS = r"list_filter(string_split_regex(coalesce({text}, ''), '[ \x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_REACH = """reach AS (SELECT DISTINCT a AS s, a AS t FROM links UNION SELECT s, b FROM reach JOIN links ON t = a),
    least_of AS (SELECT s, min(t) AS component FROM reach GROUP BY 1)"""

_SQL = {
    "op2_embedding_dedup": f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.label = q.label AND p.vec_id <> q.vec_id
        WHERE list_inner_product(p.e, q.e) / (sqrt(list_inner_product(p.e, p.e)) * sqrt(list_inner_product(q.e, q.e))) >= 0.98),
    {_REACH}, n AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
    SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component, vec_id) AS component_id, vec_id = coalesce(component, vec_id) AS kept
    FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN least_of ON s = vec_id""",
    "op3_jaccard_join": f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(text=_LOWER)} AS w FROM documents),
    sh AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)),
    sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
    common AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM sh p JOIN sh q ON p.g = q.g AND p.doc_id <> q.doc_id GROUP BY 1, 2),
    links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
    {_REACH}
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN least_of ON s = d.doc_id""",
    "op6_substring_dedup": f"""WITH d AS (SELECT doc_id, {_WORDS.format(text='text')} AS w FROM documents),
    win AS (SELECT doc_id, i, array_to_string(w[i : i + 34], ' ') AS k FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d WHERE len(w) >= 35)),
    again AS (SELECT k FROM win GROUP BY 1 HAVING count(*) > 1),
    gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(generate_series(i, i + 34)) AS p FROM win JOIN again USING (k)) GROUP BY 1)
    SELECT doc_id, len(w) AS n_words, coalesce(len(ps), 0) AS n_removed,
        sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256 FROM d LEFT JOIN gone USING (doc_id)""",
}


def _vector_codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6, size: int = 8) -> str:
    """The rounds written out, over vectors of parts * size components."""
    gap = " + ".join(f"(x[{i}] - c[{i}]) * (x[{i}] - c[{i}])" for i in range(1, size + 1))
    mean = ", ".join(f"CAST(floor(sum(x[{i}]) / count(*)) AS BIGINT)" for i in range(1, size + 1))
    steps = [
        f"""k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"p AS (SELECT vec_id, label, q, v[q * {size} + 1 : q * {size} + {size}] AS x FROM k, range({parts}) t(q))",
        f"b0 AS (SELECT q, row_number() OVER (PARTITION BY q ORDER BY vec_id) - 1 AS e, x AS c FROM p QUALIFY e < {entries})",
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS (SELECT vec_id, label, p.q, e, x, {gap} AS d FROM p JOIN b{r} USING (q) QUALIFY row_number() OVER (PARTITION BY vec_id, p.q ORDER BY d, e) = 1)")
        if r < rounds:
            steps.append(f"b{r + 1} AS (SELECT o.q, o.e, coalesce(n.c, o.c) AS c FROM b{r} o LEFT JOIN (SELECT q, e, [{mean}] AS c FROM a{r} GROUP BY q, e) n ON n.q = o.q AND n.e = o.e)")
    return f"""WITH {", ".join(steps)},
    v AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY q) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY 1, 2)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
        (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY q, e)) FROM b{rounds}) AS codebooks_sha256 FROM v"""


_SQL["op13_vector_codes"] = _vector_codes_sql()


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

"""Mixing sources to target weights, with DataFrame operations only.

1. Targets: the total is shared by weight; a source's target stops at `repeat` times its size
   and the excess goes to the others by weight (water filling over a table of sources).
2. Sainte-Lague: equal-token blocks go to the sources, then the blocks of a source to its
   shards, by highest quotients target / (2 k + 1). The quota of a shard is an integer.
3. Selection: a shard's documents stand in a seeded order and are cut into blocks; whole
   passes over the shard come first, then blocks in seeded order until the quota, the last
   one cut to fit, so that a source's words differ from its target by rounding only.

A shard holds about `shard_tokens` words, more only if that made over `max_shards` shards, so a
source with a third of all rows is spread over many tasks and quotas stay a small table.

Cases: a null or empty text has size 0 and takes 0; the null source is a source of its own,
last in order; repeated rows count and return each by itself, and share a shard; a null doc_id is
kept, and rows of one id are spread over the shards by their texts; an empty table gives no rows;
if every size is 0, all targets are 0; columns other than those named are dropped by mix_sources
and kept by take_documents, whatever they are called. Sources are ordered and filled in one task:
they are kinds of origin, tens to thousands, not hosts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, written

SEED, BLOCK_TOKENS, SHARD_TOKENS, MAX_SHARDS = "mix-1", 1024, 65_536, 20_000
WEIGHTS, SHARE, REPEAT = (3, 1, 2), 1.5, 2


def _draw(*parts: Column | str) -> Column:
    """A seeded draw that other engines can repeat: hexadecimal digits."""
    return F.md5(F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))


def fill_targets(sources: DataFrame, share: float = SHARE, repeat: int = REPEAT) -> DataFrame:
    """sources (source, source_size, weight) with target double; one row per source.

    Sorted by cap / weight, the sources that reach their cap come first; below the first that
    doesn't, each takes level * weight.
    """
    by_fill = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(W.unboundedPreceding, -1)
    after = by_fill.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.partitionBy()
    level = (F.lit(float(share)) * F.col("total") - F.col("capped")) / F.col("open_weight")
    x = (
        sources.withColumn("cap", F.lit(repeat) * F.col("source_size"))
        .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("open_weight", F.sum("weight").over(after))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("level", level)
        .withColumn("is_open", F.col("level") * F.col("weight") <= F.col("cap"))
        .withColumn("final_level", F.min(F.when(F.col("is_open"), F.struct(F.col("source_size") / F.col("weight"), F.col("level")))).over(everything)["level"])
    )
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("final_level") * F.col("weight"), F.col("cap").cast("double")))
    return x.select("source", "source_size", "weight", target.alias("target"))


def sainte_lague(rows: DataFrame, group: list[str], weight: str, seats: str, order: list[Column], out: str) -> DataFrame:
    """rows with `out`: the seats (long) that each row of a group gets, by highest quotients.

    The quotients between weight * (seats - n / 2) / total - 1 and weight * (seats + n / 2) / total
    + 1 decide, n being the rows of the group, as a divisor moves the sum of n roundings by n / 2
    at most; so only about 3 n quotients are ranked, however many seats there are.
    """
    of_group = W.partitionBy(*group)
    key = [F.col(c) for c in group]
    x = rows.withColumn("_n", F.count("*").over(of_group)).withColumn("_sum", F.sum(F.col(weight).cast("double")).over(of_group))
    x = x.withColumn("_place", F.row_number().over(of_group.orderBy(*order)))
    part = F.when(F.col("_sum") > 0, F.col(weight) / F.col("_sum")).otherwise(F.lit(0.0))
    x = x.withColumn("_low", F.greatest(F.lit(0), F.floor(part * (F.col(seats) - F.col("_n") / 2)) - 1))
    x = x.withColumn("_high", F.when(F.col(weight) > 0, F.ceil(part * (F.col(seats) + F.col("_n") / 2)) + 1).otherwise(F.lit(0)))
    x = x.withColumn("_left", F.col(seats) - F.sum("_low").over(of_group))
    quotient = F.col(weight) / (2 * F.col("_k") + 1)
    ranked = (
        x.where("_high > _low")
        .select(*key, "_place", "_left", F.explode(F.sequence(F.col("_low"), F.col("_high") - 1)).alias("_k"), F.col(weight))
        .withColumn("_rank", F.row_number().over(of_group.orderBy(quotient.desc(), "_place", "_k")))
        .where("_rank <= _left")
        .groupBy(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("_place").alias("_p"))
        .agg(F.count("*").alias("_won"))
    )
    on = F.col("_place") == F.col("_p")
    for i, c in enumerate(group):
        on = on & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return x.join(ranked, on, "left").select(*rows.columns, (F.col("_low") + F.coalesce("_won", F.lit(0))).cast("long").alias(out))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    repeat: int = REPEAT,
    block_tokens: int = BLOCK_TOKENS,
    shard_tokens: int = SHARD_TOKENS,
    max_shards: int = MAX_SHARDS,
    seed: str = SEED,
    keep: tuple[str, ...] = (),
    ranges: bool = False,
) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken, source, shard, and `keep`.

    The columns in `keep` are carried along. ranges adds what take_documents needs: passes, how
    often the whole text is taken, and ranges, array<struct<start, words>>, what is taken besides.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), F.xxhash64(F.col(text_col)).alias("text_hash"), *[F.col(c).alias(f"_kept_{i}") for i, c in enumerate(keep)])
    slim = written(slim, "sizes")

    order = [F.col("source").asc_nulls_last()]
    place = F.row_number().over(W.orderBy(*order)) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    sources = fill_targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", weight.cast("long")), share, repeat)
    everything = W.partitionBy()
    unit = F.greatest(F.lit(shard_tokens).cast("double"), F.ceil(F.sum("source_size").over(everything) / max_shards).cast("double"))
    seats = F.round(F.sum("target").over(everything) / block_tokens).cast("long")
    sources = sources.withColumn("n_shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / unit)).cast("long")).withColumn("_seats", seats)
    sources = written(sainte_lague(sources.withColumn("_all", F.lit(0)), ["_all"], "target", "_seats", order, "quota").drop("_all", "_seats"), "sources")

    # sources is small as a rule; Spark checks its size and else joins by hash, splitting hot keys
    renamed = sources.withColumnRenamed("source", "_of")
    number = F.conv(F.substring(_draw(seed, F.col("doc_id"), F.col("text_hash")), 1, 8), 16, 10).cast("long")
    dealt = slim.join(renamed, F.col("source").eqNullSafe(F.col("_of"))).drop("_of").withColumn("shard", number % F.col("n_shards"))

    shards = dealt.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("quota").alias("quota"), F.first("target").alias("of_target"))
    shards = sainte_lague(shards, ["source"], "shard_size", "quota", [F.col("shard")], "blocks")
    # what whole blocks leave of the source's target goes over its shards in proportion, by rounded running sums
    by_shard = W.partitionBy("source").orderBy("shard")
    rest = F.col("of_target") - F.col("quota") * block_tokens
    run = F.sum("shard_size").over(by_shard)
    total = F.sum("shard_size").over(W.partitionBy("source"))
    upto = F.when(total > 0, F.round(rest * run / total)).otherwise(F.lit(0.0)).cast("long")
    words = F.col("blocks") * block_tokens + F.col("upto") - F.lag("upto", 1, 0).over(by_shard)
    shards = shards.withColumn("upto", upto).withColumn("words", F.greatest(F.lit(0), F.least(F.lit(repeat) * F.col("shard_size"), words)))
    shards = shards.select(F.col("source").alias("_of"), F.col("shard").alias("_sh"), "shard_size", "words")

    x = dealt.join(shards, F.col("source").eqNullSafe(F.col("_of")) & (F.col("shard") == F.col("_sh"))).drop("_of", "_sh")
    passes = F.when(F.col("shard_size") > 0, F.floor(F.col("words") / F.col("shard_size"))).otherwise(F.lit(0)).cast("long")
    x = x.withColumn("passes", passes).withColumn("more", F.col("words") - F.col("passes") * F.col("shard_size"))

    seeded = W.partitionBy("source", "shard").orderBy(_draw(seed, F.col("doc_id"), F.col("text_hash")), F.col("doc_id"), F.col("size"), F.col("text_hash"))
    x = x.withColumn("pos", F.row_number().over(seeded)).withColumn("begin", F.sum("size").over(seeded.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    first, last = F.floor(F.col("begin") / block_tokens), F.floor((F.col("begin") + F.greatest(F.col("size"), F.lit(1)) - 1) / block_tokens)
    pieces = x.withColumn("block", F.explode(F.sequence(first, last)))
    piece = F.least(F.col("begin") + F.col("size"), (F.col("block") + 1) * block_tokens) - F.greatest(F.col("begin"), F.col("block") * block_tokens)
    chosen = W.partitionBy("source", "shard").orderBy(_draw(seed, F.col("source"), F.col("shard"), F.col("block")), "block", "pos")
    pieces = pieces.withColumn("piece", piece).withColumn("ahead", F.sum("piece").over(chosen.rowsBetween(W.unboundedPreceding, 0)) - F.col("piece"))
    got = F.greatest(F.lit(0), F.least(F.col("piece"), F.col("more") - F.col("ahead")))
    one = [c for c in x.columns if c not in ("source", "shard", "pos", "begin", "words", "more", "n_shards", "quota", "weight", "shard_size", "text_hash")]
    out = pieces.groupBy("source", "shard", "pos").agg(*[F.first(c).alias(c) for c in one], F.sum(got).alias("_got"), *[F.array_sort(F.collect_list(F.when(got > 0, F.struct((F.greatest(F.col("begin"), F.col("block") * block_tokens) - F.col("begin")).cast("int").alias("start"), got.cast("int").alias("words"))))).alias("ranges")] * ranges)
    taken = (F.col("passes") * F.col("size") + F.col("_got")).cast("long")
    return out.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "source", "shard", *[F.col(f"_kept_{i}").alias(c) for i, c in enumerate(keep)], *["passes", "ranges"] * ranges)


def take_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str = "n_chars", **settings) -> DataFrame:
    """docs as the mix takes them: a text as often as it is taken whole, then the words taken besides.

    Texts are moved once. A part of a text is its words joined by a space, with its length in
    length_col; a text of which nothing is taken goes. The columns are those of docs.
    """
    key = F.xxhash64(id_col, text_col)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"), key.alias("key"))
    taken = mix_sources(slim, keep=("key",), ranges=True, **settings).where("taken > 0")
    # rows equal in id and text have a decision each and share a row, of which the columns are under `row`
    first = docs.select(key.alias("key"), F.struct("*").alias("row")).withColumn("nth", F.row_number().over(W.partitionBy("key").orderBy("key"))).where("nth = 1").drop("nth")
    x = first.join(taken.select("key", "size", "passes", "ranges"), "key")
    text, length = F.col("row")[text_col], F.col("row")[length_col]
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    rest = F.aggregate("ranges", F.lit(0), lambda n, r: n + r["words"])
    part = F.array_join(F.transform("ranges", lambda r: F.array_join(F.slice(words, r["start"] + 1, r["words"]), " ")), " ")
    whole = (F.col("passes") + F.when(rest == F.col("size"), F.lit(1)).otherwise(F.lit(0))).cast("int")
    texts = F.array_repeat(text, whole)
    texts = F.when((rest > 0) & (rest < F.col("size")), F.concat(texts, F.array(part))).otherwise(texts)
    out = x.select("row", F.explode(texts).alias("taken_text"))
    length = F.when(F.col("taken_text") == text, length).otherwise(F.char_length("taken_text").cast("long"))
    values = {text_col: F.col("taken_text"), length_col: length.cast(docs.schema[length_col].dataType)}
    return out.select(*[values.get(c, F.col("row")[c]).alias(c) for c in docs.columns])

"""The report of landed provider tables: orders written as lines of every data set, and read back through the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.registry import query
from tidemark.sources.landed import CATALOGUE, landing_marks, landing_report, read_landed
from tidemark.sources.views import table

#: Each order is a line of one data set, under one of the names of each column; column j is a dash where (order + j) % 10 = 0, and broken where it is 1.
_SETS = list(CATALOGUE)


def _lines(orders: DataFrame, k: int) -> DataFrame:
    mine = orders.where(F.col("o_orderkey") % len(_SETS) == k)
    key = F.col("o_orderkey")
    entries = []
    for j, (kind, names) in enumerate(CATALOGUE[_SETS[k]].values()):
        day = F.when(key % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(key % 3 == 1, F.date_format("o_orderdate", "yyyyMMdd")).otherwise(F.concat(F.lpad((F.year("o_orderdate") - 1911).cast("string"), 3, "0"), F.date_format("o_orderdate", "MMdd")))
        number = F.when(key % 3 == 0, F.format_number(key * 7 + j, 0)).otherwise((key * 7 + j).cast("string"))
        good = day if kind == "date" else F.concat(F.lit("t"), key) if kind == "string" else number
        text = F.when((key + j) % 10 == 0, F.lit("--")).when((key + j) % 10 == 1, F.lit("x!")).otherwise(good)
        name = F.element_at(F.array(*[F.lit(n) for n in names]), (key % len(names) + 1).cast("int"))
        entries.append(F.struct(name.alias("key"), text.alias("value")))
    note = F.when(key % 4 == 0, F.array(F.struct(F.lit("note").alias("key"), F.lit("n").alias("value")))).otherwise(F.array().cast("array<struct<key:string,value:string>>"))
    whole = F.to_json(F.map_from_entries(F.concat(F.array(*entries), note)))
    return mine.select(F.when(key % 50 == 0, F.substring(whole, 2, 9)).otherwise(whole).alias("line"))


def _report_sql() -> str:
    parts = []
    for k, name in enumerate(_SETS):
        mine = f"o_orderkey % {len(_SETS)} = {k}"
        for j, (column, (kind, _)) in enumerate(CATALOGUE[name].items()):
            broken = "0" if kind == "string" else f"count(*) FILTER (o_orderkey % 50 <> 0 AND (o_orderkey + {j}) % 10 = 1)"
            read = f"count(*) FILTER (o_orderkey % 50 <> 0{'' if kind == 'string' else f' AND (o_orderkey + {j}) % 10 > 1'})"
            parts.append(f"SELECT '{name}' AS dataset, '{column}' AS \"column\", {read} AS n, {broken} AS bad FROM orders WHERE {mine}")
        parts.append(f"SELECT '{name}', '(line)', count(*) FILTER (o_orderkey % 50 <> 0), count(*) FILTER (o_orderkey % 50 = 0) FROM orders WHERE {mine}")
        parts.append(f"SELECT '{name}', '?note', count(*), 0 FROM orders WHERE {mine} AND o_orderkey % 50 <> 0 AND o_orderkey % 4 = 0 HAVING count(*) > 0")
    return " UNION ALL ".join(parts)


@query(_report_sql())
def landed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return landing_report(*[landing_marks(read_landed(_lines(orders, k), name), name) for k, name in enumerate(_SETS)])

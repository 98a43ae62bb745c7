"""Provider tables as they landed, one JSON object a line, read into typed columns by a catalogue of names.

A line is parsed once, as a variant; each column takes the first of its names that the object has. What the
catalogue doesn't know is kept in `rescued`, values that don't fit their type are named in `bad`, and a
line that is no JSON object is kept whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CODE = ("string", ("stock_id", "Code", "SecuritiesCompanyCode", "公司代號", "ticker"))
_DATE = ("date", ("date", "Date", "出表日期", "report_period"))
_STATEMENT = {"code": _CODE, "date": _DATE, "type": ("string", ("type",)), "value": ("double", ("value",)), "origin_name": ("string", ("origin_name",))}

# The columns of each data set, their types, and the names that providers give them.
CATALOGUE: dict[str, dict[str, tuple[str, tuple[str, ...]]]] = {
    "price": {
        "code": _CODE, "date": _DATE, "open": ("double", ("open", "OpeningPrice", "Open")), "high": ("double", ("max", "HighestPrice", "High")), "low": ("double", ("min", "LowestPrice", "Low")),
        "close": ("double", ("close", "ClosingPrice", "Close")), "volume": ("long", ("Trading_Volume", "TradeVolume", "TradingShares")), "turnover": ("double", ("Trading_money", "TradeValue", "TransactionAmount")), "change": ("double", ("spread", "Change")),
    },
    "revenue": {"code": _CODE, "date": _DATE, "country": ("string", ("country",)), "revenue": ("double", ("revenue",)), "revenue_month": ("long", ("revenue_month",)), "revenue_year": ("long", ("revenue_year",))},
    "financials": _STATEMENT,
    "balance": _STATEMENT,
    "cashflow": _STATEMENT,
    "institutional": {"code": _CODE, "date": _DATE, "name": ("string", ("name",)), "buy": ("long", ("buy",)), "sell": ("long", ("sell",))},
    "holding_shares": {"code": _CODE, "date": _DATE, "level": ("string", ("HoldingSharesLevel",)), "people": ("long", ("people",)), "percent": ("double", ("percent",)), "unit": ("long", ("unit",))},
    "valuation": {"code": _CODE, "date": _DATE, "dividend_yield": ("double", ("dividend_yield", "DividendYield", "YieldRatio")), "pe": ("double", ("PER", "PEratio", "PriceEarningRatio")), "pb": ("double", ("PBR", "PBratio", "PriceBookRatio"))},
    "dividend": {"code": _CODE, "date": _DATE, "year": ("string", ("year",)), "cash": ("double", ("CashEarningsDistribution",)), "stock": ("double", ("StockEarningsDistribution",))},
    "company": {"code": _CODE, "date": _DATE, "name": ("string", ("stock_name", "公司名稱", "CompanyName")), "industry": ("string", ("industry_category", "產業別", "SecuritiesIndustryCode"))},
    "news": {"code": _CODE, "date": _DATE, "title": ("string", ("title",)), "link": ("string", ("link", "url")), "source": ("string", ("source",))},
    "announcements": {"code": _CODE, "date": _DATE, "subject": ("string", ("主旨 ", "主旨")), "text": ("string", ("說明",))},
    "us_statement": {"code": _CODE, "date": _DATE, "period": ("string", ("period",)), "currency": ("string", ("currency",)), "revenue": ("double", ("revenue", "total_revenue")), "net_income": ("double", ("net_income",))},
}


def number_text(text: Column) -> Column:
    """A number in text, with separators of thousands or not; null if there is none, or it isn't finite."""
    n = F.regexp_replace(F.trim(text), ",", "").try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) != float("inf")), n)


def date_text(text: Column) -> Column:
    """YYYY-MM-DD, YYYY/MM/DD, YYYYMMDD, or YYYMMDD of the Republic's years; null otherwise."""
    t = F.trim(text)
    plain = F.when(t.rlike("^[0-9]{8}$"), F.regexp_replace(t, "^(....)(..)(..)$", "$1-$2-$3")).when(t.rlike("^[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}"), F.regexp_replace(F.substring(t, 1, 10), "/", "-"))
    local = F.when(t.rlike("^[0-9]{7}$"), F.concat(F.format_string("%04d", F.substring(t, 1, 3).try_cast("int") + 1911), F.lit("-"), F.substring(t, 4, 2), F.lit("-"), F.substring(t, 6, 2)))
    return F.coalesce(plain, local).try_cast("date")


def _typed(text: Column, kind: str) -> Column:
    if kind == "date":
        return date_text(text)
    if kind == "string":
        return text
    n = number_text(text)
    return n if kind == "double" else F.when(n == F.floor(n), n.try_cast("long"))


def read_landed(lines: DataFrame, dataset: str, line: str = "line") -> DataFrame:
    """lines (with a JSON object in `line`) as the columns of the data set, and rescued, bad and whether the line was readable.

    rescued: map of the names that the catalogue lacks to their values as text. bad: the columns whose
    value is there, is neither null nor blank nor a dash, and doesn't fit. Other columns of lines stay; one with a
    name of the data set's gives way.
    """
    columns = CATALOGUE[dataset]
    known = {n for _, names in columns.values() for n in names}
    x = lines.withColumn("_v", F.try_parse_json(line))
    x = x.withColumn("readable", F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False)))
    x = x.withColumn("_all", F.when(F.col("readable"), F.from_json(line, "map<string,string>")))
    value = lambda names: F.coalesce(*[F.try_variant_get("_v", f"$['{n}']", "string") for n in names])
    for i, (_, names) in enumerate(columns.values()):
        x = x.withColumn(f"_t{i}", F.when(F.col("readable"), value(names)))
    typed = [_typed(F.col(f"_t{i}"), kind).alias(name) for i, (name, (kind, _)) in enumerate(columns.items())]
    x = x.select("*", *[t.alias(f"_c{i}") for i, t in enumerate(typed)])
    blank = lambda t: t.isNull() | F.trim(t).isin("", "-", "--", "N/A")
    bad = F.array_compact(F.array(*[F.when(~blank(F.col(f"_t{i}")) & F.col(f"_c{i}").isNull(), F.lit(name)) for i, name in enumerate(columns)]))
    rescued = F.map_filter("_all", lambda k, _: ~k.isin(*sorted(known)))
    kept = [c for c in lines.columns if c not in columns and c not in ("rescued", "bad", "readable")]
    return x.select(*kept, *[F.col(f"_c{i}").alias(name) for i, name in enumerate(columns)], rescued.alias("rescued"), bad.alias("bad"), "readable")


def landing_marks(read: DataFrame, dataset: str) -> DataFrame:
    """(dataset, column, n, bad): for each line and column whether a value was read and whether one didn't fit; (line) for the line itself, ?name for unknown names."""
    mark = lambda name, n, bad: F.struct(name.alias("column"), n.cast("int").alias("n"), bad.cast("int").alias("bad"))
    own = [mark(F.lit(n), F.col(n).isNotNull(), F.array_contains("bad", n)) for n in CATALOGUE[dataset]]
    line = mark(F.lit("(line)"), F.col("readable"), ~F.col("readable"))
    unknown = F.transform(F.coalesce(F.map_keys("rescued"), F.array().cast("array<string>")), lambda k: mark(F.concat(F.lit("?"), k), F.lit(1), F.lit(0)))
    return read.select(F.lit(dataset).alias("dataset"), F.explode(F.concat(F.array(*own, line), unknown)).alias("_m")).select("dataset", "_m.*")


def landing_report(*marks: DataFrame) -> DataFrame:
    """(dataset, column, n, bad): the marks of several data sets, summed in one aggregate."""
    return reduce(DataFrame.unionByName, marks).groupBy("dataset", "column").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))

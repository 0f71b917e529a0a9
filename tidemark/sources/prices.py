"""Archived chart responses and index pages (SRC-18, SRC-20)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUOTE = "open: array<double>, high: array<double>, low: array<double>, close: array<double>, volume: array<double>"
CHART = f"chart struct<result: array<struct<meta: struct<gmtoffset: long>, timestamp: array<long>, indicators: struct<quote: array<struct<{QUOTE}>>>, events: struct<dividends: map<string, struct<date: long, amount: double>>, splits: map<string, struct<date: long, numerator: double, denominator: double>>>>>>"


def _result(raw: DataFrame) -> DataFrame:
    return raw.select("symbol", F.from_json("body", CHART).getField("chart").getField("result")[0].alias("r")).withColumn("off", F.coalesce("r.meta.gmtoffset", F.lit(0)))


def _day(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd")


def daily_bars(raw: DataFrame) -> DataFrame:
    """(symbol, date, open, high, low, close, volume) in ten-thousandths, from (symbol, body); bars with a null price go, null volume is 0."""
    names = ("open", "high", "low", "close", "volume")
    x = _result(raw).select("symbol", "off", F.explode(F.arrays_zip(F.col("r.timestamp").alias("ts"), *[F.col("r.indicators.quote")[0].getField(n).alias(n) for n in names])).alias("b"))
    x = x.where(F.greatest(*[F.col(f"b.{n}").isNull() for n in names[:4]]) == F.lit(False))
    return x.select("symbol", _day(F.col("b.ts") + F.col("off")).alias("date"), *[F.rint(F.col(f"b.{n}") * 10_000).cast("long").alias(n) for n in names[:4]], F.coalesce(F.col("b.volume"), F.lit(0)).cast("long").alias("volume"))


def actions(raw: DataFrame) -> DataFrame:
    """(symbol, date, kind, value) of dividends and splits."""
    r = _result(raw)
    paid = r.select("symbol", "off", F.explode(F.map_values("r.events.dividends")).alias("e")).select("symbol", _day(F.col("e.date") + F.col("off")).alias("date"), F.lit("dividend").alias("kind"), F.col("e.amount").alias("value"))
    cut = r.select("symbol", "off", F.explode(F.map_values("r.events.splits")).alias("e")).select("symbol", _day(F.col("e.date") + F.col("off")).alias("date"), F.lit("split").alias("kind"), (F.col("e.numerator") / F.col("e.denominator")).alias("value"))
    return paid.unionByName(cut)


def _matches(pages: DataFrame, pattern: str, *groups: int) -> DataFrame:
    """The groups of every match, in order: all groups' lists have one entry for each match."""
    return pages.select(F.explode(F.arrays_zip(*[F.regexp_extract_all("value", F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in groups])).alias("m")).select("m.*")


def bullet_members(pages: DataFrame) -> DataFrame:
    """(symbol) of list lines that end in a comma and a symbol. pages: value is a whole page of wikitext."""
    return _matches(pages, "(?m)^\\*\\s.*,\\s*([A-Z]{1,5})\\s*$", 1).select(F.col("g1").alias("symbol"))


def sector_members(pages: DataFrame, sector: str = "Utilities") -> DataFrame:
    """(symbol) of table rows of a sector, dots as dashes."""
    return _matches(pages, "\\{\\{(?:NyseSymbol|NasdaqSymbol)\\|([A-Z.]+)\\}\\}\\s*\\n\\|[^\\n]*?\\|\\|\\s*" + sector + "\\s*\\|\\|", 1).select(F.regexp_replace("g1", "\\.", "-").alias("symbol"))


def constituents(pages: DataFrame) -> DataFrame:
    """(symbol, sector) of the table marked as constituents."""
    table = pages.select(F.regexp_extract("value", '(?s)id="constituents"(.*?)\\n\\|\\}', 1).alias("value"))
    return _matches(table, "(?m)^\\|\\s*\\[\\[[^\\]]*\\]\\][^|\\n]*\\|\\|\\s*([A-Z.]+)\\s*\\|\\|\\s*([^|\\n]+?)\\s*\\|\\|", 1, 2).select(F.col("g1").alias("symbol"), F.col("g2").alias("sector"))

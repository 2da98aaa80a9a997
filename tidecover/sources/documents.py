"""Text and JSON sources as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUOTE_SCHEMA = "companies map<string, struct<baseline_t1: double, baseline_t2: double, actuals: array<struct<year: int, tipo: string, actual_ton: double>>>>, sst array<struct<year: int, tipo: string, sst: double>>"


def climate_index(lines: DataFrame) -> DataFrame:
    """season, year, oni of lines (value) with four tokens at least and a number for a year; others go."""
    t = F.split(F.trim("value"), r"\s+")
    df = lines.select(t.alias("t")).filter((F.size("t") >= 4) & F.get("t", F.lit(1)).rlike(r"^\d+$"))
    return df.select(F.get("t", F.lit(0)).alias("season"), F.get("t", F.lit(1)).cast("int").alias("year"), F.get("t", F.lit(3)).try_cast("double").alias("oni"))


def quote_tables(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Companies with their baselines, their actual catches, and the seasonal index, of JSON documents (value)."""
    doc = documents.select(F.from_json("value", QUOTE_SCHEMA).alias("d"))
    each = doc.select(F.explode("d.companies").alias("company", "c"))
    companies = each.select("company", "c.baseline_t1", "c.baseline_t2")
    actuals = each.select("company", F.explode("c.actuals").alias("a")).select("company", "a.year", "a.tipo", F.col("a.actual_ton").alias("actual"))
    index = doc.select(F.inline("d.sst"))
    return companies, actuals, index

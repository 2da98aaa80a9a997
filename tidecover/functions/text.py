"""Names, codes and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal_companies(df: DataFrame, company: str, aliases: DataFrame) -> DataFrame:
    """company trimmed, in capitals, and by its main name where aliases(alias, name) has one; null stays null."""
    known = F.broadcast(aliases.select(F.upper(F.trim("alias")).alias("_a"), F.col("name").alias("_name")))  # a hand-kept list
    bare = df.withColumn(company, F.upper(F.trim(company)))
    return bare.join(known, bare[company] == F.col("_a"), "left").withColumn(company, F.coalesce("_name", company)).drop("_a", "_name")


def company_token(name: Column) -> Column:
    """The second word, else the whole name."""
    return F.coalesce(F.get(F.split(F.trim(name), r"\s+"), F.lit(1)), F.trim(name))


def mentions(name: Column, token: Column) -> Column:
    return F.contains(F.lower(name), F.lower(token))


def vessel_code(code: Column) -> Column:
    """T12 as TASA 12; hard spaces as spaces; capitals."""
    plain = F.upper(F.trim(F.translate(code, " ", " ")))
    return F.regexp_replace(plain, r"^T\s*(\d+)$", "TASA $1")


def slug(name: Column) -> Column:
    """Lower case, no dots, an underscore for each space; s_a_a and s_a_c as saa and sac; no underscores at the ends."""
    plain = F.replace(F.replace(F.lower(name), F.lit("."), F.lit("")), F.lit(" "), F.lit("_"))
    return F.trim(F.replace(F.replace(plain, F.lit("s_a_a"), F.lit("saa")), F.lit("s_a_c"), F.lit("sac")), F.lit("_"))


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def trigger_tag(x: Column, p90: Column, p95: Column, p99: Column) -> Column:
    """The triggers that x has reached."""
    return F.concat_ws(" ", F.when(x >= p90, "p90"), F.when(x >= p95, "p95"), F.when(x >= p99, "p99"))

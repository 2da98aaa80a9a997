"""Calendar keys and fishing seasons as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Season windows by day of the year (both ends included) and by month.
DOY_WINDOWS = {"T1": (91, 212), "T2": (305, 365)}
MONTHS = {"T1": [4, 5, 6, 7], "T2": [11, 12]}


def season_by_doy(d: Column) -> Column:
    """T1, T2 or null; day 366 is in no season."""
    doy = F.dayofyear(d)
    out = F.lit(None).cast("string")
    for tipo, (a, b) in DOY_WINDOWS.items():
        out = F.when(doy.between(a, b), tipo).otherwise(out)
    return out


def season_by_month(d: Column) -> Column:
    out = F.lit(None).cast("string")
    for tipo, months in MONTHS.items():
        out = F.when(F.month(d).isin(months), tipo).otherwise(out)
    return out


def season_type(label: Column) -> Column:
    """T1 or T2 of a season label: it starts with 1ra or 2da, or ends in CN-I or CN-II; else null."""
    s = F.trim(label)
    first = s.startswith("1ra") | s.endswith("CN-I")
    second = s.startswith("2da") | s.endswith("CN-II")
    return F.when(first, "T1").when(second, "T2")


def iso_week(d: Column) -> Column:
    """YYYY-Www by the ISO calendar."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), d).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(d).cast("string"), 2, "0"))


def calendar_keys(df: DataFrame, d: str) -> DataFrame:
    c = F.col(d)
    return df.withColumns({"year": F.year(c), "iso_year": F.extract(F.lit("YEAROFWEEK"), c).cast("int"), "iso_week": F.weekofyear(c), "week_key": iso_week(c), "month_key": F.date_format(c, "yyyy-MM"), "doy": F.dayofyear(c)})


def complete_years(df: DataFrame, keys: list[str], d: str, least: int = 200) -> DataFrame:
    """Rows of years with so many valid days at least."""
    from pyspark.sql import Window

    n = F.count(F.lit(1)).over(Window.partitionBy(*keys, F.year(d)))
    return df.withColumn("_days", n).filter(F.col("_days") >= least).drop("_days")

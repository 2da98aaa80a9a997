"""Positions of rows within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def positions(rows: DataFrame, keys: list[str], place: Column, order: list[Column], width: int) -> DataFrame:
    """rows with at: each row's position (from 1) within its group by order.

    place is the first number that order goes by; rows are ranked within stretches of width of it and start from the
    number of rows in the stretches before, so that a large group is ranked by many tasks.  A null place comes first.
    """
    cut = rows.withColumn("_cut", F.floor(place / width))
    per = cut.groupBy(*keys, "_cut").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("_cut")).rowsBetween(Window.unboundedPreceding, -1)
    start = per.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0))).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_cut").alias("_d"), "_before")
    own = cut.withColumn("_own", F.row_number().over(Window.partitionBy(*keys, "_cut").orderBy(*order)))
    on = F.col("_cut").eqNullSafe(F.col("_d"))
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return own.join(start, on).select(*rows.columns, (F.col("_own") + F.col("_before")).alias("at"))

"""Statistics that Spark lacks, as column expressions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import written

NORMAL_FROM = 20_000  # degrees of freedom from which on the normal distribution stands for Student's
Z975 = 1.959963984540054


def t_p_value(t: Column, nu: Column) -> Column:
    """Two-sided p of Student's t for whole degrees of freedom, by the finite series in the cosine of atan(t / sqrt(nu)).

    Error about 1e-16, so tiny values are not exact relatively; above NORMAL_FROM by a polynomial for the normal tail
    (error below 1e-7).
    """
    a = F.abs(t)
    theta = F.atan(a / F.sqrt(nu))
    c2 = F.pow(F.cos(theta), F.lit(2.0))
    odd = nu % 2 == 1
    n = F.when(odd, F.floor((nu - 3) / 2)).otherwise(F.floor((nu - 2) / 2)).cast("int")
    ratio = lambda j: F.when(odd, 2 * j / (2 * j + 1)).otherwise((2 * j - 1) / (2 * j))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(acc: Column, j: Column) -> Column:
        term = acc["term"] * c2 * ratio(j)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    js = F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    series = F.aggregate(js, start, add, lambda acc: acc["sum"])
    inside = F.when(nu == 1, 2 * theta / math.pi).when(odd, 2 / math.pi * (theta + F.sin(theta) * F.cos(theta) * series)).otherwise(F.sin(theta) * series)
    k = 1 / (1 + 0.2316419 * a)
    tail = F.exp(-a * a / 2) / math.sqrt(2 * math.pi) * k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429))))
    return F.when(nu > NORMAL_FROM, 2 * tail).when(nu >= 1, F.greatest(F.lit(0.0), 1 - inside))


def t_quantile_975(nu: Column) -> Column:
    """The .975 quantile of Student's t, by its expansion in 1 / nu (error below 1e-5 from 10 degrees of freedom on)."""
    z = Z975
    g = [
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    ]
    return sum((F.lit(x) / F.pow(nu, F.lit(float(i + 1))) for i, x in enumerate(g)), F.lit(z))


def normal_density(x: Column, mu: Column, sd: Column) -> Column:
    return F.exp(-F.pow((x - mu) / sd, F.lit(2.0)) / 2) / (sd * math.sqrt(2 * math.pi))


def percentiles(x: str, at: list[float]) -> Column:
    """Exact percentiles by linear interpolation, as an array."""
    return F.percentile(F.col(x), [float(p) for p in at])


def dealt_counts(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """keys, x, c, _p: the count of each distinct value (nulls left out), dealt out by ranges of (keys, x), numbered _p.

    Counts are combined before the shuffle.  A group's values lie in as many ranges as its share of them asks for, so no
    task sorts a whole group.  The table is written, so that every reader sees the same ranges.
    """
    per = df.filter(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count(F.lit(1)).alias("c"))
    return written(per.repartitionByRange(*keys, x).withColumn("_p", F.spark_partition_id()), "counts")


def range_offsets(counts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, _p, _start, _rows, n: of each group's ranges the values before it and in it, and the group's; one row a range."""
    own = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = own.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    per = counts.groupBy(*keys, "_p").agg(F.sum("c").alias("_rows"))
    return per.select(*keys, "_p", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"), "_rows", F.sum("_rows").over(own).alias("n"))


def within_ranges(counts: DataFrame, offsets: DataFrame, keys: list[str], x: str) -> DataFrame:
    """keys, x, c, below, n and the other columns of offsets: running sums of each range alone, from its offset on."""
    on = [F.col(f"_k{i}").eqNullSafe(F.col(k)) for i, k in enumerate(keys)]
    named = offsets.select(F.col("_p").alias("_q"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in offsets.columns if c not in (*keys, "_p")])
    joined = counts.join(named, reduce(Column.__and__, on, F.col("_p") == F.col("_q")))
    to = Window.partitionBy(*keys, "_p").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumn("below", F.col("_start") + F.coalesce(F.sum("c").over(to), F.lit(0))).drop("_q", *[f"_k{i}" for i in range(len(keys))])


def cumulative_counts(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """keys, x, c, below, n: of each distinct value its count, that of smaller values, and the group's; nulls left out."""
    counts = dealt_counts(df, keys, x)
    return within_ranges(counts, range_offsets(counts, keys), keys, x).select(*keys, x, "c", "below", "n")


def exact_percentiles(df: DataFrame, keys: list[str], x: str, shares: dict[str, float]) -> DataFrame:
    """keys, n and a column per share: exact percentiles, linear between neighbours.

    Each share's two positions are looked for in the one range that holds them; the other ranges aren't sorted.
    """
    counts = dealt_counts(df, keys, x)
    offsets = range_offsets(counts, keys)
    at = lambda p: F.lit(float(p)) * (F.col("n") - 1)
    held = lambda i: (F.col("_start") <= i) & (i < F.col("_start") + F.col("_rows"))
    wanted = reduce(Column.__or__, [held(f(at(p))) for p in shares.values() for f in (F.floor, F.ceil)])
    found = within_ranges(counts, offsets.filter(wanted), keys, x)
    value = lambda i: F.max(F.when((F.col("below") <= i) & (i < F.col("below") + F.col("c")), F.col(x)))
    picked = [value(f(at(p))).alias(f"_{side}_{name}") for name, p in shares.items() for side, f in (("lo", F.floor), ("hi", F.ceil))]
    out = found.groupBy(*keys).agg(F.max("n").alias("n"), *picked)
    mixed = lambda n, p: (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * (at(p) - F.floor(at(p)))).alias(n)
    return out.select(*keys, "n", *[mixed(n, p) for n, p in shares.items()])

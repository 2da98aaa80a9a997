"""Synthetic years, payouts per scenario, and exceedance curves."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

M = 2147483647


def uniform(sim: Column, k: int, seed: int) -> Column:
    """A number in (0, 1) from whole numbers alone, so it doesn't depend on partitions; squaring breaks the line."""
    m = F.lit(M).cast("long")
    h = (sim.cast("long") * 48271 + k * 69621 + seed * 16807) % m
    for j in range(3):
        h = (((h * h + k * 40692 + j * 12345 + 1) % m) * 48271) % m
    return (h + 1.0) / F.lit(2.147483648e9)


def draws(spark: SparkSession, n: int = 4000, seed: int = 42) -> DataFrame:
    """sim_id, tipo, z: standard normal draws (Box-Muller), the same for every region."""
    ids = spark.range(n).withColumnRenamed("id", "sim_id")
    z = lambda a, b: F.sqrt(-2 * F.log(uniform(F.col("sim_id"), a, seed))) * F.cos(2 * math.pi * uniform(F.col("sim_id"), b, seed))
    both = F.array(F.struct(F.lit("T1").alias("tipo"), z(1, 2).alias("z")), F.struct(F.lit("T2").alias("tipo"), z(3, 4).alias("z")))
    return ids.select("sim_id", F.explode(both).alias("d")).select("sim_id", "d.tipo", "d.z")


def scenarios(draws: DataFrame, fit: DataFrame) -> DataFrame:
    """region, sim_id, t1, t2: mu + z sd of each region and season; the fit is a row per region and season."""
    df = draws.join(F.broadcast(fit.select("region", "tipo", "mu", "sd")), "tipo").withColumn("idx", F.col("mu") + F.col("z") * F.col("sd"))
    of = lambda t: F.max(F.when(F.col("tipo") == t, F.col("idx")))
    return df.groupBy("region", "sim_id").agg(of("T1").alias("t1"), of("T2").alias("t2"))


def portfolio(payouts: DataFrame, keys: list[str], cap: Column) -> DataFrame:
    """keys, payout: the sum over regions, capped."""
    return payouts.groupBy(*keys).agg(F.sum("payout").alias("payout"), F.sum(cap).alias("cap")).withColumn("payout", F.least("payout", "cap"))


def exceedance(df: DataFrame, keys: list[str], value: str, tie: str) -> DataFrame:
    """Adds rank and ep = (n + 1 - rank) / (n + 1), by ascending value, per group; tie orders equals."""
    w = Window.partitionBy(*keys).orderBy(value, tie)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return df.withColumns({"rank": F.row_number().over(w), "_n": n}).withColumn("ep", (F.col("_n") + 1 - F.col("rank")) / (F.col("_n") + 1)).drop("_n")


def event_labels(ranked: DataFrame, keys: list[str], value: str, years: list[int]) -> DataFrame:
    """keys, year, rank, ep, value: for each event year its first rank on the curve that pays; years that never pay have none."""
    own = ranked.filter(F.col("year").isin(years) & (F.col(value) > 0))
    first = own.groupBy(*keys, "year").agg(F.min(F.struct("rank", "ep", F.col(value).alias("_v"))).alias("f"))
    return first.select(*keys, "year", F.col("f.rank").alias("rank"), F.col("f.ep").alias("ep"), F.col("f._v").alias(value))


def interpolated(curve: DataFrame, keys: list[str], value: str, lo: float, hi: float, points: int = 300) -> DataFrame:
    """keys, grid_id, ep, value: the curve (ep, value) at points probabilities from lo to hi, straight between its own
    points, ends held.

    The first point of each curve brings the grid along; curve and grid are then one order, in which a grid point finds its
    neighbours by looking back and ahead, so nothing is joined and the partitioning by keys is kept.
    """
    own = F.struct(F.lit(None).cast("int").alias("grid_id"), F.col("ep").alias("at"), F.col(value).alias("v"))
    grid = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.struct(i.alias("grid_id"), (lo + (hi - lo) * i / (points - 1)).alias("at"), F.lit(None).cast("double").alias("v")))
    numbered = curve.select(*keys, "ep", value, F.row_number().over(Window.partitionBy(*keys).orderBy("ep")).alias("_nth"))
    rows = numbered.select(*keys, F.explode(F.when(F.col("_nth") == 1, F.concat(F.array(own), grid)).otherwise(F.array(own))).alias("r")).select(*keys, "r.*")
    point = F.when(F.col("grid_id").isNull(), F.struct("at", "v"))
    up = Window.partitionBy(*keys).orderBy("at", F.col("grid_id").isNotNull())  # a point of the curve before a grid point there
    down = Window.partitionBy(*keys).orderBy(F.desc("at"), F.col("grid_id").isNull())
    met = rows.select("*", F.last(point, True).over(up).alias("a"), F.last(point, True).over(down).alias("b")).filter("grid_id is not null")
    between = F.col("a.v") + (F.col("b.v") - F.col("a.v")) * (F.col("at") - F.col("a.at")) / (F.col("b.at") - F.col("a.at"))
    y = F.when(F.col("a").isNull(), F.col("b.v")).when(F.col("b").isNull(), F.col("a.v")).otherwise(between)
    return met.select(*keys, "grid_id", F.col("at").alias("ep"), y.alias(value))


def sampling_band(values: DataFrame, keys: list[str], value: str, n: int, chunks: int = 20, points: int = 300) -> DataFrame:
    """keys, grid_id, lower, upper: 5th and 95th percentiles of the curves of contiguous chunks, at each probability."""
    size = n // chunks
    part = values.withColumn("chunk", F.floor(F.col("sim_id") / size).cast("int")).filter(F.col("chunk") < chunks)
    curve = exceedance(part, [*keys, "chunk"], value, "sim_id")
    at = interpolated(curve, [*keys, "chunk"], value, 1 / (n + 1), n / (n + 1), points)
    band = at.groupBy(*keys, "grid_id").agg(F.percentile(value, [0.05, 0.95]).alias("p"))
    return band.select(*keys, "grid_id", F.get("p", F.lit(0)).alias("lower"), F.get("p", F.lit(1)).alias("upper"))

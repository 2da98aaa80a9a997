"""Gridded series: means over time, climatologies and anomalies on the long table (time, lat, lon, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = ["lat", "lon"]


def daily_means(df: DataFrame, ts: str, value: str, cell: list[str]) -> DataFrame:
    """Means per day and cell; nulls and NaN don't count."""
    return df.groupBy(F.to_date(ts).alias("time"), *cell).agg(F.avg(F.nanvl(F.col(value), F.lit(None).cast("double"))).alias("value"))


def climatology(grid: DataFrame, key: Column, name: str, years: tuple[int, int] | None = None) -> DataFrame:
    """Mean per key (day of the year, month) and cell over the baseline years, both included; all years if none given."""
    base = grid if years is None else grid.filter(F.year("time").between(*years))
    return base.groupBy(key.alias(name), *CELL).agg(F.avg("value").alias("clim"))


def anomalies(grid: DataFrame, clim: DataFrame, key: Column, name: str) -> DataFrame:
    """value less the climatology of its key and cell; cells without a climatology go."""
    return grid.withColumn(name, key).join(clim, [name, *CELL]).select("time", *CELL, (F.col("value") - F.col("clim")).alias("anom"))


def doy_anomalies(grid: DataFrame, years: tuple[int, int] | None = None) -> DataFrame:
    key = F.dayofyear("time")
    return anomalies(grid, climatology(grid, key, "doy", years), key, "doy")


def crop(grid: DataFrame, south: float, north: float, west: float, east: float) -> DataFrame:
    """The box, bounds included; a plain filter, so it reaches the scan."""
    return grid.filter(F.col("lat").between(south, north) & F.col("lon").between(west, east))


def wrap_longitude(lon: Column) -> Column:
    return F.when(lon > 180, lon - 360).otherwise(lon)


def mask_sentinel(value: Column, limit: float = 1e6) -> Column:
    return F.when(value < limit, value)


def surface(df: DataFrame, keys: list[str], depth: str = "depth", value: str = "value") -> DataFrame:
    """The value at the least depth of each cell; of equals the least value."""
    return df.groupBy(*keys).agg(F.min(F.struct(depth, value)).alias("_m")).select(*keys, F.col("_m")[value].alias(value))


def season_map(grid: DataFrame, tipo: Column, least_steps: int) -> DataFrame:
    """Mean per year, season and cell; seasons of fewer time steps (not cells) than least_steps go."""
    df = grid.withColumns({"tipo": tipo, "year": F.year("time")}).filter("tipo is not null")
    steps = df.groupBy("year", "tipo").agg(F.count_distinct("time").alias("steps")).filter(F.col("steps") >= least_steps)
    return df.groupBy("year", "tipo", *CELL).agg(F.avg("value").alias("value")).join(steps.drop("steps"), ["year", "tipo"])


def band_series(grid: DataFrame) -> DataFrame:
    """Per month and 1-degree band: mean of means, month per cell, then over longitudes, then over latitudes."""
    month = F.date_format("time", "yyyy-MM").alias("month")
    per_cell = grid.groupBy(month, *CELL).agg(F.avg("value").alias("v"))
    per_lat = per_cell.groupBy("month", "lat").agg(F.avg("v").alias("v"))
    return per_lat.groupBy("month", F.floor("lat").cast("int").alias("band")).agg(F.avg("v").alias("v"))


def band_correlations(bands: DataFrame) -> DataFrame:
    """band_a, band_b, r: Pearson's r of each pair of bands over the months in which every band has a value.

    A month's bands are one array (a band is a degree of latitude, so 180 at most), and the co-moments of its pairs are
    merged by how many bands of the month have a value; of these sums only the one that has all bands is kept.
    """
    month = bands.groupBy("month").agg(F.collect_list(F.struct("band", "v")).alias("m"), F.count("v").alias("k"))
    pairs = F.flatten(F.transform("m", lambda a: F.transform(F.filter("m", lambda b: b["band"] >= a["band"]), lambda b: F.struct(a["band"].alias("band_a"), b["band"].alias("band_b"), a["v"].alias("va"), b["v"].alias("vb")))))
    each = month.select("k", F.explode(pairs).alias("p")).select("k", "p.*")
    fullest = each.groupBy("k", "band_a", "band_b").agg(F.corr("va", "vb").alias("r")).groupBy("band_a", "band_b").agg(F.max(F.struct("k", "r")).alias("f"))
    every = F.sum((F.col("band_a") == F.col("band_b")).cast("int")).over(Window.partitionBy(F.lit(0)))  # a row per pair
    return fullest.withColumn("n", every).filter((F.col("f.k") == F.col("n")) & (F.col("band_a") < F.col("band_b"))).select("band_a", "band_b", F.col("f.r").alias("r"))

"""Catch totals, baselines and densities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.seasons import season_type
from ..functions.stats import exact_percentiles
from .corridor import assign_regions


def usable(df: DataFrame, *needed: str) -> DataFrame:
    """Rows with a catch and all needed columns."""
    return df.dropna(subset=list(needed)).filter(F.col("catch_tm") > 0)


def vessel_days(events: DataFrame) -> DataFrame:
    """Sum of catch and mean place per day, season, company and vessel; rows without one of these keys go."""
    keys = ["event_date", "season", "company", "vessel"]
    return events.dropna(subset=keys).groupBy(*keys).agg(F.coalesce(F.sum("catch_tm"), F.lit(0.0)).alias("catch_tm"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


def region_seasons(events: DataFrame, regions: DataFrame) -> DataFrame:
    """Catch per region and season label, with its year and type."""
    df = assign_regions(events.filter("season is not null"), regions)
    per = df.groupBy("region", "season").agg(F.sum("catch_tm").alias("catch_tm"))
    return per.withColumns({"year": F.regexp_extract("season", r"(\d{4})", 1).cast("int"), "tipo": season_type(F.col("season"))})


def region_summary(seasons: DataFrame) -> DataFrame:
    """Per region: mean T1 and T2, mean, least and largest year, and the (earliest) years of these; whole tonnes."""
    annual = seasons.groupBy("region", "year").agg(F.sum("catch_tm").alias("total"))
    by_year = annual.groupBy("region").agg(F.avg("total").alias("mean"), F.min(F.struct("total", "year")).alias("lo"), F.max(F.struct("total", (-F.col("year")).alias("y"))).alias("hi"))
    tipo = lambda t: F.avg(F.when(F.col("tipo") == t, F.col("catch_tm")))
    by_type = seasons.groupBy("region").agg(tipo("T1").alias("t1"), tipo("T2").alias("t2"))
    whole = lambda c, n: c.cast("long").alias(n)
    return by_type.join(by_year, "region").select("region", whole(F.col("t1"), "mean_t1"), whole(F.col("t2"), "mean_t2"), whole(F.col("mean"), "mean_year"), whole(F.col("lo.total"), "min_year_tm"), F.col("lo.year").alias("min_year"), whole(F.col("hi.total"), "max_year_tm"), (-F.col("hi.y")).alias("max_year"))


def baselines(seasons: DataFrame, keys: list[str]) -> DataFrame:
    """keys, base_t1, base_t2, max_t1, max_t2: means and maxima of season catches; a type without a season gives 0."""
    of = lambda f, t: F.coalesce(f(F.when(F.col("tipo") == t, F.col("catch_tm"))), F.lit(0.0))
    return seasons.groupBy(*keys).agg(of(F.avg, "T1").alias("base_t1"), of(F.avg, "T2").alias("base_t2"), of(F.max, "T1").alias("max_t1"), of(F.max, "T2").alias("max_t2"))


def company_seasons(events: DataFrame, regions: DataFrame) -> DataFrame:
    df = assign_regions(events.filter("season is not null"), regions)
    return df.groupBy("company", "region", "season").agg(F.sum("catch_tm").alias("catch_tm")).withColumn("tipo", season_type(F.col("season")))


def best_year(events: DataFrame, key: str, before: int | None = None) -> DataFrame:
    """key, best_year, best_tm: the year of the largest catch (the earliest of equals), of years before a given one."""
    df = events if before is None else events.filter(F.year("event_date") < before)
    per = df.groupBy(key, F.year("event_date").alias("year")).agg(F.sum("catch_tm").alias("tm"))
    return per.groupBy(key).agg(F.max(F.struct("tm", (-F.col("year")).alias("y"))).alias("m")).select(key, (-F.col("m.y")).alias("best_year"), F.col("m.tm").alias("best_tm"))


def monthly_baseline(base: DataFrame) -> DataFrame:
    """Season means per month (four in T1, two in T2) by region, their Total, and shares of the total in percent."""
    per = base.select("region", (F.col("base_t1") / 4).alias("m1"), (F.col("base_t2") / 2).alias("m2"))
    rolled = per.rollup("region").agg(F.sum("m1").alias("m1"), F.sum("m2").alias("m2"))
    rows = rolled.select(F.coalesce("region", F.lit("Total")).alias("region"), "m1", "m2")
    total = Window.partitionBy()
    own = F.when(F.col("region") != "Total", F.col("m1") + F.col("m2"))
    return rows.withColumn("share", 100 * (F.col("m1") + F.col("m2")) / F.sum(own).over(total))


def density(events: DataFrame, keys: list[str], nx: int = 80, ny: int = 110, box: tuple[float, float, float, float] = (-82.0, -74.0, -16.0, -5.0)) -> DataFrame:
    """Counts per bin of a lon-lat histogram; bins are half open but the last, which is closed."""
    west, east, south, north = box

    def index(x: Column, lo: float, hi: float, n: int) -> Column:
        return F.least(F.floor((x - lo) * n / (hi - lo)), F.lit(n - 1)).cast("int")

    inside = F.col("lon").between(west, east) & F.col("lat").between(south, north)
    return events.filter(inside).groupBy(*keys, index(F.col("lon"), west, east, nx).alias("ix"), index(F.col("lat"), south, north, ny).alias("iy")).agg(F.count(F.lit(1)).alias("n"))


def smoothed(cells: DataFrame, sigma: float = 1.5, radius: int = 6, nx: int = 80, ny: int = 110) -> DataFrame:
    """Gaussian smoothing of counts (ix, iy, n) over the grid, edges reflected; empty bins count as 0.

    Each bin gives its weighted share to (2 radius + 1)^2 places, so the work grows with the bins that hold something.
    """
    import math

    w = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-radius, radius + 1)]
    total = sum(w)
    offsets = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(w[d + radius] / total).alias("w")) for d in range(-radius, radius + 1)])

    def spread(df: DataFrame, c: str, size: int) -> DataFrame:
        # An output place p takes from p + d, mirrored at the edges: so a bin gives to each p whose mirrored p + d it is.
        places = F.filter(F.flatten(F.transform(offsets, lambda o: F.transform(F.array(F.col(c) - o["d"], -F.col(c) - 1 - o["d"], 2 * size - 1 - F.col(c) - o["d"]), lambda p: F.struct(p.alias("p"), o["w"].alias("w"))))), lambda x: x["p"].between(0, size - 1))
        return df.select(*[x for x in df.columns if x not in (c, "n")], F.explode(places).alias("o"), "n").select(*[x for x in df.columns if x not in (c, "n")], F.col("o.p").alias(c), (F.col("n") * F.col("o.w")).alias("n"))

    keys = [c for c in cells.columns if c not in ("ix", "iy", "n")]
    once = spread(cells, "ix", nx).groupBy(*keys, "ix", "iy").agg(F.sum("n").alias("n"))
    return spread(once, "iy", ny).groupBy(*keys, "ix", "iy").agg(F.sum("n").alias("n"))


def without_outliers(df: DataFrame, keys: list[str], x: str, reach: float = 1.5) -> DataFrame:
    """Rows with x within reach quartile ranges of its group's quartiles."""
    q = exact_percentiles(df, keys, x, {"_lo": 0.25, "_hi": 0.75}).drop("n")
    lo, hi = F.col("_lo"), F.col("_hi")
    return df.join(q, keys).filter(F.col(x).between(lo - reach * (hi - lo), hi + reach * (hi - lo))).drop("_lo", "_hi")

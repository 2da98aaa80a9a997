"""Activity corridors: percentile longitudes per latitude band, their polygon, the cells inside, and means over these."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import exact_percentiles
from ..sources.files import written

WEST, EAST, PAD = -82.0, -74.0, 0.1


def in_region(lat: Column, lo: Column, hi: Column) -> Column:
    """lat > lo and lat <= hi; an open bound is no test, so a region open on both sides also holds rows without lat."""
    return (lo.isNull() | F.coalesce(lat > lo, F.lit(False))) & (hi.isNull() | F.coalesce(lat <= hi, F.lit(False)))


def assign_regions(df: DataFrame, regions: DataFrame) -> DataFrame:
    """A row per row and region that holds it; regions may overlap.  The region table is a handful of rows."""
    r = F.broadcast(regions)
    return df.join(r, in_region(F.col("lat"), F.col("lat_min"), F.col("lat_max"))).drop("lat_min", "lat_max")


def bands(events: DataFrame, regions: DataFrame, least: int = 20) -> DataFrame:
    """region, band (its southern edge), west and east (5th and 95th percentile of lon), of bands with least events."""
    df = assign_regions(events.filter("lat is not null and lon is not null"), regions)
    per = exact_percentiles(df.withColumn("band", F.floor("lat").cast("int")), ["region", "band"], "lon", {"west": 0.05, "east": 0.95})
    return per.filter(F.col("n") >= least).select("region", "band", "west", "east")


def extents(events: DataFrame, regions: DataFrame) -> DataFrame:
    df = assign_regions(events.filter("lat is not null and lon is not null"), regions)
    return df.groupBy("region").agg(F.min("lat").alias("south"), F.max("lat").alias("north"))


def caps_at_bounds(regions: DataFrame, extents: DataFrame) -> DataFrame:
    """extents with a region's own bounds for its southernmost and northernmost event; an open bound keeps the event."""
    both = extents.join(F.broadcast(regions), "region")
    return both.select("region", F.coalesce("lat_min", "south").alias("south"), F.coalesce("lat_max", "north").alias("north"))


def caps_at_bands(bands: DataFrame) -> DataFrame:
    """region, south, north: the outer edges of its first and last band."""
    return bands.groupBy("region").agg(F.min("band").cast("double").alias("south"), (F.max("band") + 1).cast("double").alias("north"))


def edges(bands: DataFrame, extents: DataFrame) -> DataFrame:
    """region, x1, y1, x2, y2: the closed polygon through the bands' centres, up in the west and down in the east.

    Its caps lie at extents (region, south, north), such as the southernmost and northernmost event, the region's bounds or
    the outer bands' edges, and repeat the nearest band's longitudes.
    """
    mid = F.array_sort(F.collect_list(F.struct((F.col("band") + 0.5).alias("lat"), "west", "east"))).alias("mid")
    per = bands.groupBy("region").agg(mid).join(F.broadcast(extents), "region")  # a row per region, an array of its bands
    cap = lambda lat, at: F.array(F.struct(F.col(lat).alias("lat"), F.element_at("mid", at)["west"].alias("west"), F.element_at("mid", at)["east"].alias("east")))
    side = lambda c: F.transform("all", lambda p: F.struct(p[c].alias("x"), p["lat"].alias("y")))
    ring = per.select("region", F.concat(cap("south", 1), "mid", cap("north", -1)).alias("all")).select("region", F.concat(side("west"), F.reverse(side("east"))).alias("ring"))
    to = F.transform("ring", lambda p, i: F.struct(p.alias("p"), F.get("ring", (i + 1) % F.size("ring")).alias("q")))
    return ring.select("region", F.explode(to).alias("e")).select("region", F.col("e.p.x").alias("x1"), F.col("e.p.y").alias("y1"), F.col("e.q.x").alias("x2"), F.col("e.q.y").alias("y2"))


def members(cells: DataFrame, edges: DataFrame, extents: DataFrame) -> DataFrame:
    """region, lat, lon of the cells inside each polygon: an edge to the east is crossed an odd number of times.

    By scanlines: edges meet each distinct latitude by its whole degree, which gives the places where a region's outline
    crosses it; a cell counts those east of it.  Points on an edge may go either way.  A polygon that folds over itself is
    read by the same even-odd rule.
    """
    degrees = F.sequence(F.floor(F.least("y1", "y2")), F.floor(F.greatest("y1", "y2")))
    cut = edges.select("*", F.explode(degrees).alias("_d"))
    places = cells.select("lat", "lon").distinct().filter(F.col("lon").between(WEST, EAST))
    lines = places.select("lat").distinct().withColumn("_d", F.floor("lat"))
    met = lines.join(cut, "_d").filter((F.col("y1") > F.col("lat")) != (F.col("y2") > F.col("lat")))
    x = (F.col("x2") - F.col("x1")) * (F.col("lat") - F.col("y1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0)) + F.col("x1")
    crossed = met.groupBy("region", "lat").agg(F.collect_list(x).alias("xs"))  # as many as a polygon's edges at most
    hit = places.join(crossed, "lat").filter(F.size(F.filter("xs", lambda v: F.col("lon") < v)) % 2 == 1)
    pad = (F.col("lat") > F.col("south") - PAD) & (F.col("lat") <= F.col("north") + PAD)
    return hit.join(F.broadcast(extents), "region").filter(pad).select("region", "lat", "lon")


def corridor_daily(events: DataFrame, anomaly: DataFrame, regions: DataFrame, least: int = 20, places: DataFrame | None = None) -> DataFrame:
    """region, time, idx: the unweighted mean anomaly of the corridor's cells per day, days without a value left out.

    places: a table with the anomaly's places that is cheaper to read, such as the grid that it was made from.
    """
    ext = written(extents(events, regions), "extents")
    cells = members(anomaly if places is None else places, edges(bands(events, regions, least), ext), ext)
    return anomaly.join(F.broadcast(cells), ["lat", "lon"]).groupBy("region", "time").agg(F.avg("anom").alias("idx")).filter("idx is not null")


def season_means(daily: DataFrame, tipo: Column, keys: list[str]) -> DataFrame:
    """keys, year, tipo, idx: means of daily values."""
    df = daily.withColumns({"tipo": tipo, "year": F.year("time")}).filter("tipo is not null")
    return df.groupBy(*keys, "year", "tipo").agg(F.avg("idx").alias("idx"))


def complete_season_means(daily: DataFrame, tipo: Column, keys: list[str]) -> DataFrame:
    """Means of monthly means, of seasons with all their months: four in T1, two in T2."""
    month = daily.groupBy(*keys, F.trunc("time", "MM").alias("time")).agg(F.avg("idx").alias("idx"))
    df = month.withColumns({"tipo": tipo, "year": F.year("time")}).filter("tipo is not null")
    per = df.groupBy(*keys, "year", "tipo").agg(F.avg("idx").alias("idx"), F.count("idx").alias("months"))
    return per.filter(F.col("months") == F.when(F.col("tipo") == "T1", 4).otherwise(2)).drop("months")


def both_seasons(seasons: DataFrame, keys: list[str]) -> DataFrame:
    """keys, year, t1, t2 of years with both seasons."""
    of = lambda t: F.max(F.when(F.col("tipo") == t, F.col("idx"))).alias(t.lower())
    has = lambda t: F.bool_or(F.col("tipo") == t).alias(f"_{t}")
    per = seasons.groupBy(*keys, "year").agg(of("T1"), of("T2"), has("T1"), has("T2"))
    return per.filter("_T1 and _T2").select(*keys, "year", "t1", "t2")

"""Points to their nearest grid cells, and one sensor to another."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import written


def number(x: Column, kind: str) -> Column:
    return F.unix_date(x).cast("double") if kind == "date" else x.cast("double")


def bucket(x: Column, scale: Column) -> Column:
    return F.least(F.greatest(F.floor((x - scale["lo"]) / scale["step"]), F.lit(0)), scale["n"]).cast("int")


def stretches(axis: DataFrame, keys: list[str]) -> DataFrame:
    """keys, v, w, scale, b: the stretches between neighbouring values v and w of an axis (keys, v), for each bucket b that
    they reach.

    scale (lo, step, n) tells a number's bucket: an axis of n values has n of them, of equal width.  The first and the last
    stretch are open (null), so that every number is in one.
    """
    w, whole = Window.partitionBy(*keys).orderBy("v"), Window.partitionBy(*keys)
    n, lo, hi = F.count(F.lit(1)).over(whole), F.min("v").over(whole), F.max("v").over(whole)
    scale = F.struct(lo.alias("lo"), F.greatest((hi - lo) / n, F.lit(1e-9)).alias("step"), n.alias("n"))
    values = axis.filter("v is not null").select(*keys, "v").distinct().select(*keys, "v", F.lead("v").over(w).alias("w"), F.lag("v").over(w).alias("u"), scale.alias("scale"))
    first = F.when(F.col("u").isNull(), F.array(F.struct(F.lit(None).cast("double").alias("v"), F.col("v").alias("w"))))
    every = values.select(*keys, "scale", F.explode(F.concat(F.array(F.struct("v", "w")), F.coalesce(first, F.array().cast("array<struct<v: double, w: double>>")))).alias("s"))
    own = every.select(*keys, "scale", "s.v", "s.w")
    low = F.when(F.col("v").isNull(), 0).otherwise(bucket(F.col("v"), F.col("scale")))
    high = F.when(F.col("w").isNull(), F.col("scale.n").cast("int")).otherwise(bucket(F.col("w"), F.col("scale")))
    return own.select("*", F.explode(F.sequence(low, high)).alias("b"))


def nearer_end(points: DataFrame, ends: DataFrame, keys: list[str], x: str, scale: Column, out: str, falling: bool) -> DataFrame:
    """points with out, the nearer end of the stretch of ends (keys, v, w, b) that holds x."""
    kind = dict(points.dtypes)[x]
    at = number(F.col(x), kind)
    named = ends.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("b").alias("_b"), F.col("v").alias("_v"), F.col("w").alias("_w"))
    low, high = F.col("_v"), F.col("_w")
    on = [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)]
    on += [bucket(at, scale) == F.col("_b"), low.isNull() | (low <= at), high.isNull() | (at < high)]
    gap = lambda v: F.abs(v - at)
    first = gap(high) <= gap(low) if falling else gap(high) < gap(low)
    best = F.when(low.isNull() | (high.isNotNull() & first), high).otherwise(low)
    typed = F.date_from_unix_date(best.cast("int")) if kind == "date" else best
    return points.join(named, reduce(Column.__and__, on), "left").select(*points.columns, typed.alias(out))


def with_nearest(points: DataFrame, axis: DataFrame, keys: list[str], x: str, out: str, falling: bool = False) -> DataFrame:
    """points with out, the nearest value of axis(keys..., x); the axis's first one wins ties, null without an axis.

    That is the smallest of them, or the largest where the axis is falling.  A point meets the stretch between two values
    of the axis by its bucket, an equal join, and takes the nearer end; so neither distinct coordinates nor the axis's
    length matter.
    """
    ends = stretches(axis.select(*keys, number(F.col(x), dict(axis.dtypes)[x]).alias("v")), keys)
    scales = ends.groupBy(*keys).agg(F.max("scale").alias("_scale"))
    own = points.join(scales, keys, "left").select(*points.columns, "_scale")
    return nearer_end(own, ends, keys, x, F.col("_scale"), out, falling).drop("_scale")


def nearest_cells(points: DataFrame, grid: DataFrame, names: list[str], falling: tuple[str, ...] = ()) -> DataFrame:
    """Adds names, columns of the grid (time, lat, lon, names) at the nearest day, latitude and longitude, each by itself,
    within the point's year.

    points has event_date, lat, lon and year.  Years without a grid, and cells without a value, give null.  falling: those
    of time, lat and lon whose axis is stored from its largest value down, which decides ties.  The axes' stretches are
    written once, so the grid is read for them once; with axes below the broadcast threshold the points are shuffled once,
    to meet their cells.
    """
    g = grid.withColumn("year", F.year("time"))
    value = lambda c: F.struct(F.lit(c).alias("axis"), number(F.col(c), "date" if c == "time" else "double").alias("v"))
    axes = g.select("year", F.explode(F.array(value("time"), value("lat"), value("lon"))).alias("a")).select("year", "a.axis", "a.v")
    ends = written(stretches(axes, ["axis", "year"]), "axes")
    scale = lambda c: F.max(F.when(F.col("axis") == c, F.col("scale"))).alias(f"_s_{c}")
    df = points.join(ends.groupBy("year").agg(*[scale(c) for c in ("time", "lat", "lon")]), "year", "left")
    for x, src, out in (("event_date", "time", "_t"), ("lat", "lat", "_la"), ("lon", "lon", "_lo")):
        df = nearer_end(df, ends.filter(F.col("axis") == src), ["year"], x, F.col(f"_s_{src}"), out, src in falling)
    cells = g.select(F.col("year"), F.col("time").alias("_t"), F.col("lat").alias("_la"), F.col("lon").alias("_lo"), *names)
    return df.join(cells, ["year", "_t", "_la", "_lo"], "left").select(*points.columns, *names)


def nearest_grid(points: DataFrame, grid: DataFrame, name: str, falling: tuple[str, ...] = ()) -> DataFrame:
    """nearest_cells for a grid of one variable (value), named name."""
    return nearest_cells(points, grid.withColumnRenamed("value", name), [name], falling)


def enrich(points: DataFrame, grids: dict[tuple[str, ...], DataFrame], required: list[str], constant: tuple[str, float, str] | None = None) -> DataFrame:
    """Adds a column per variable of grids, whose keys name the variables of a source and whose grids have (time, lat, lon)
    and a column for each.

    Variables of one source share its axes, so the points meet its cells once.  A variable that its grid has no column for
    is null, as is one in a year or cell without a value.  Rows of years in which a required variable has no value at all
    go.  constant: (column, reference, new column).
    """
    df = points.withColumn("year", F.year("event_date"))
    for names, grid in grids.items():
        for n in (n for n in names if n in required):
            has = grid.filter(F.col(n).isNotNull() if n in grid.columns else F.lit(False))
            df = df.join(F.broadcast(has.select(F.year("time").alias("year")).distinct()), "year", "left_semi")  # a row per year
    for names, grid in grids.items():
        here = [n for n in names if n in grid.columns]
        df = nearest_cells(df, grid, here) if here else df
        df = df.withColumns({n: F.lit(None).cast("double") for n in names if n not in here})
    if constant:
        df = df.withColumn(constant[2], F.col(constant[0]) - constant[1])
    return df


def colocate(coarse: DataFrame, fine: DataFrame) -> DataFrame:
    """time, lat, lon (of the coarse cell), coarse, fine: a row for each fine cell with a value, on a day that both have.

    Each fine cell goes to its nearest coarse cell, so a coarse cell has several rows a day.  The coarse grid is regular,
    so its nearest latitude and longitude give the nearest cell; coarse cells without a value give no row.
    """
    one = F.lit(1).alias("k")
    near = fine.filter("value is not null").select(one, "time", "lat", "lon", F.col("value").alias("fine"))
    near = with_nearest(near, coarse.select(one, "lat"), ["k"], "lat", "_la")
    near = with_nearest(near, coarse.select(one, "lon"), ["k"], "lon", "_lo").select("time", "_la", "_lo", "fine")
    c = coarse.filter("value is not null").select("time", F.col("lat").alias("_la"), F.col("lon").alias("_lo"), F.col("value").alias("coarse"))
    return near.join(c, ["time", "_la", "_lo"]).select("time", F.col("_la").alias("lat"), F.col("_lo").alias("lon"), "coarse", "fine")


def nearest_places(places: DataFrame, cells: DataFrame, tile: float) -> DataFrame:
    """lat, lon, c_lat, c_lon: for each distinct place the nearest of cells (lat, lon), which need not form a grid.

    Of cells as near the southernmost, then westernmost one.  Cells are found by tiles of so many degrees: a place asks the
    tiles around it ring by ring, until its best cell is nearer than any in the next ring could be.  Every ring is written,
    so a place stays in the work only as long as it needs; tiles should hold a few cells.
    """
    where = lambda c: F.floor(F.col(c) / tile).cast("int")
    known = written(cells.select(F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon")).dropna().distinct().withColumns({"_y": where("c_lat"), "_x": where("c_lon")}), "tiles")
    best_type = "struct<d: double, c_lat: double, c_lon: double>"
    left = written(places.select("lat", "lon").dropna().distinct().withColumns({"_ty": where("lat"), "_tx": where("lon"), "best": F.lit(None).cast(best_type)}), "places")
    done: list[DataFrame] = []
    if known.isEmpty():
        return left.select("lat", "lon", F.col("best.c_lat"), F.col("best.c_lon")).limit(0)
    ring = 0
    while True:
        side = F.sequence(F.lit(-ring), F.lit(ring))
        around = F.filter(F.flatten(F.transform(side, lambda i: F.transform(side, lambda j: F.struct(i.alias("i"), j.alias("j"))))), lambda o: F.greatest(F.abs(o["i"]), F.abs(o["j"])) == ring)
        asked = left.select("lat", "lon", "_ty", "_tx", "best", F.explode(around).alias("o")).withColumns({"_y": F.col("_ty") + F.col("o.i"), "_x": F.col("_tx") + F.col("o.j")})
        d = (F.col("c_lat") - F.col("lat")) * (F.col("c_lat") - F.col("lat")) + (F.col("c_lon") - F.col("lon")) * (F.col("c_lon") - F.col("lon"))
        met = asked.join(known, ["_y", "_x"], "left").withColumn("new", F.when(F.col("c_lat").isNotNull(), F.struct(d.alias("d"), "c_lat", "c_lon")))
        per = met.groupBy("lat", "lon", "_ty", "_tx").agg(F.min(F.least("best", "new")).alias("best"))
        state = written(per, "ring")
        settled = F.coalesce(F.sqrt("best.d") <= ring * tile, F.lit(False))
        done.append(state.filter(settled))
        left = state.filter(~settled)
        if left.isEmpty():
            return reduce(DataFrame.unionByName, done).select("lat", "lon", F.col("best.c_lat"), F.col("best.c_lon"))
        ring += 1


def colocate_places(coarse: DataFrame, fine: DataFrame, tile: float) -> DataFrame:
    """colocate for grids of any shape: each fine place goes to the coarse place that is nearest in the plane."""
    near = nearest_places(fine.select("lat", "lon"), coarse.select("lat", "lon"), tile)
    f = fine.filter("value is not null").join(near, ["lat", "lon"]).select("time", F.col("c_lat").alias("lat"), F.col("c_lon").alias("lon"), F.col("value").alias("fine"))
    return f.join(coarse.filter("value is not null").select("time", "lat", "lon", F.col("value").alias("coarse")), ["time", "lat", "lon"]).select("time", "lat", "lon", "coarse", "fine")


def cell_quality(pairs: DataFrame, least: int = 3) -> DataFrame:
    """lat, lon, n, r, bias (coarse - fine) of the coarse cells with so many pairs at least; r is null where one is constant."""
    r = F.covar_pop("coarse", "fine") / F.nullif(F.stddev_pop("coarse") * F.stddev_pop("fine"), F.lit(0.0))
    per = pairs.groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("n"), r.alias("r"), F.avg(F.col("coarse") - F.col("fine")).alias("bias"))
    return per.filter(F.col("n") >= least)

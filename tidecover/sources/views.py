"""The driver's tables as events, grids and a second sensor (FIXTURES.md, section B), and small dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Regions as (name, southern bound, northern bound); they overlap, and an open bound is None.
REGIONS = [("Todo el mar", None, None), ("Norte", -7.1, None), ("Centro Norte", -11.0, -7.1), ("Centro Sur", -15.8, -11.0), ("Centro", -15.8, -7.1)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def regions(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    rows = [r for r in REGIONS if names is None or r[0] in names]
    return spark.createDataFrame(rows, "region string, lat_min double, lat_max double")


def catch_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, su, na = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation"))
    d = F.to_date("l_shipdate")
    year = F.year(d).cast("string")
    season = F.when(F.month(d).between(4, 7), F.concat(F.lit("1ra "), year)).when(F.month(d) >= 11, F.concat(F.lit("2da "), year))
    lat = (-160 + (F.col("l_suppkey") * 37 + F.col("l_orderkey") * 11) % 110).cast("double") / 10
    lon = (-820 + (F.col("l_partkey") * 13 + F.col("l_suppkey") * 7) % 80).cast("double") / 10
    return li.join(su, li.l_suppkey == su.s_suppkey).join(na, su.s_nationkey == na.n_nationkey).select(d.alias("event_date"), season.alias("season"), F.col("n_name").alias("company"), F.col("s_name").alias("vessel"), F.col("l_quantity").alias("catch_tm"), lat.alias("lat"), lon.alias("lon"))


def fleet_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """catch_events with vessels of a fleet by number, and every seventh one sold to the next company at the end of 1997."""
    ev, na = catch_events(spark, sf_dir), table(spark, sf_dir, "nation").orderBy("n_nationkey")
    number = F.regexp_extract("vessel", r"(\d+)$", 1).cast("int")
    next_ = F.broadcast(na.select(F.col("n_name").alias("company"), "n_nationkey").join(na.select(F.col("n_name").alias("_next"), ((F.col("n_nationkey") + 24) % 25).alias("n_nationkey")), "n_nationkey").drop("n_nationkey"))
    df = ev.withColumn("_v", number).join(next_, "company")
    sold = (F.col("_v") % 7 == 3) & (F.year("event_date") > 1997)
    name = F.when(F.col("_v") % 2 == 0, F.concat(F.lit("TASA "), F.col("_v").cast("string"))).otherwise(F.col("vessel"))
    return df.select("event_date", "season", F.when(sold, F.col("_next")).otherwise(F.col("company")).alias("company"), name.alias("vessel"), "catch_tm", "lat", "lon")


def pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, ts, file_year, file_season: a ping a lineitem, up to four days off its date, in a file of the date's season.

    Codes are written as a tracking system does; those of every ninth vessel are of no known one.
    """
    li = table(spark, sf_dir, "lineitem")
    d = F.to_date("l_shipdate")
    tipo = F.when(F.month(d).between(4, 7), "1ra").when(F.month(d) >= 11, "2da")
    code = F.when(F.col("l_suppkey") % 9 == 4, F.concat(F.lit("X"), F.col("l_suppkey").cast("string"))).when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("t"), F.col("l_suppkey").cast("string"))).otherwise(F.concat(F.lit("supplier#"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0"), F.lit("\u00a0")))
    ts = F.timestamp_add("minute", F.col("l_linenumber") * 9, F.date_add(d, (F.col("l_orderkey") % 5).cast("int")).cast("timestamp"))
    return li.select(code.alias("code"), ts.alias("ts"), F.year(d).alias("file_year"), tipo.alias("file_season")).filter("file_season is not null")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    keys = [F.to_date("l_shipdate").alias("time"), ((-155 + 10 * (F.col("l_suppkey") % 11)).cast("double") / 10).alias("lat"), ((-815 + 10 * (F.col("l_partkey") % 8)).cast("double") / 10).alias("lon")]
    return li.groupBy(*keys).agg(F.avg(14 + 100 * F.col("l_discount")).alias("value"))


def grid_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct places of grid, without its values."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(((-155 + 10 * (F.col("l_suppkey") % 11)).cast("double") / 10).alias("lat"), ((-815 + 10 * (F.col("l_partkey") % 8)).cast("double") / 10).alias("lon")).distinct()


def fine_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    keys = [F.to_date("o_orderdate").alias("time"), ((-1575 + 50 * (F.col("o_custkey") % 21)).cast("double") / 100).alias("lat"), ((-8175 + 50 * (F.col("o_orderkey") % 15)).cast("double") / 100).alias("lon")]
    return o.groupBy(*keys).agg(F.avg(14 + F.col("o_totalprice") / 50000).alias("value"))

"""A climatology kept on disk as sums that merge: new and changed years are brought in, the others aren't summed again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .grid import CELL

SUMS = "doy int, lat double, lon double, total double, n bigint, year int"
MARKS = "mark string, year int"


def year_marks(grid: DataFrame) -> DataFrame:
    """year, mark: a digest of each year's rows (time, lat, lon, value), whatever their order."""
    h = F.xxhash64("time", "lat", "lon", "value")
    parts = F.count(F.lit(1)), F.bit_xor(h), F.sum(F.shiftright(h, 40))
    return grid.groupBy(F.year("time").alias("year")).agg(F.concat_ws(" ", *[p.cast("string") for p in parts]).alias("mark")).filter("year is not null")


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def refresh(grid: DataFrame, path: str, rebuild: bool = False) -> list[int]:
    """Brings the sums below path up to the grid (time, lat, lon, value); gives the years that were written.

    A year is summed if its rows differ from those at its last refresh; its folder is replaced as a whole and the others
    stay.  Marks follow the sums, so a run that is lost in between sums the year again.  Years that the grid no longer has
    stay until rebuild, which writes all anew.  The driver has a line per changed year.
    """
    spark = grid.sparkSession
    marks = year_marks(grid)
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/marks")
    fresh = rebuild or not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    stale = marks if fresh else marks.join(F.broadcast(stored(spark, f"{path}/marks", MARKS)), ["year", "mark"], "left_anti")
    rows = stale.orderBy("year").collect()
    years = [r.year for r in rows]
    if years or fresh:
        own = grid.filter(F.year("time").isin(years))
        sums = own.groupBy(F.dayofyear("time").alias("doy"), *CELL, F.year("time").alias("year")).agg(F.sum("value").alias("total"), F.count("value").alias("n"))
        done = spark.createDataFrame([(r.mark, r.year) for r in rows], MARKS)
        for df, name in ((sums.select("doy", *CELL, "total", "n", "year"), "sums"), (done, "marks")):
            df.write.mode("overwrite").option("partitionOverwriteMode", "static" if fresh else "dynamic").partitionBy("year").parquet(f"{path}/{name}")
    return years


def climatology(spark: SparkSession, path: str, years: tuple[int, int] | None = None) -> DataFrame:
    """doy, lat, lon, clim: the mean over the baseline years, both included; all years if none given.  Null without a value."""
    sums = stored(spark, f"{path}/sums", SUMS)
    base = sums if years is None else sums.filter(F.col("year").between(*years))
    return base.groupBy("doy", *CELL).agg((F.sum("total") / F.nullif(F.sum("n"), F.lit(0))).alias("clim"))

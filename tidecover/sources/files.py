"""Event files of mixed encodings, headers and columns, and partitioned outputs."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NAME_PATTERN = r"(?i)calas.*anchoveta.*(primera|segunda).*temporada[^/]*\.csv$"


_own: dict[str, str] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder that driver and executors share; local runs without one get an own folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _own.setdefault(spark.sparkContext.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="tidecover-")
        _own[spark.sparkContext.applicationId] = base
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to a scratch folder and read back, for plans that use it more than once; the folder goes with the session."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def path_columns(df: DataFrame, path: Column) -> DataFrame:
    """Adds year (of the folder) and season ("1ra 2019") from a file's path."""
    plain = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    year = F.regexp_extract(plain, r"/(\d{4})/", 1)
    part = F.when(F.lower(plain).contains("primera"), "1ra").otherwise("2da")
    return df.withColumns({"year": year.try_cast("int"), "season": F.concat_ws(" ", part, year)})


def discover(spark: SparkSession, root: str) -> DataFrame:
    """path, utf8 and header of the event files below root, whatever the case of their names; a row per file, in one job."""
    lines = spark.read.option("recursiveFileLookup", "true").text(root)  # bytes as they are, which may not be UTF-8
    own = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("i"), "value").filter(F.col("path").rlike(NAME_PATTERN))
    # A file's first line is the first of its first block; within a block lines come in order.
    first = F.min(F.struct("at", "i", "value"))
    per = own.groupBy("path").agg(F.bool_and(F.is_valid_utf8("value")).alias("utf8"), first.alias("f"))
    latin = F.decode(F.col("f.value").cast("binary"), "ISO-8859-1")
    path = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))  # a path as metadata has it is a URL
    return per.select(path.alias("path"), "utf8", F.when(F.col("utf8"), F.col("f.value")).otherwise(latin).alias("header"))


def clean_header(names: list[str]) -> list[tuple[int, str]]:
    """Positions and trimmed names, each name once: the first column of that name."""
    seen: dict[str, int] = {}
    for i, n in enumerate(names):
        seen.setdefault(n.replace("\ufeff", "").strip().lower(), i)
    return [(i, n) for n, i in seen.items()]


def read_events(spark: SparkSession, root: str) -> DataFrame:
    """All event files as one table: dates, numbers or null, path columns, absent columns null.

    Files are few next to their rows, so the driver has a line for each; those of the same encoding and header are one scan.
    """
    groups: dict[tuple[str, tuple[str, ...]], list[str]] = {}
    for r in discover(spark, root).orderBy("path").collect():
        groups.setdefault(("UTF-8" if r.utf8 else "ISO-8859-1", tuple((r.header or "").split(","))), []).append(r.path)
    frames = []
    for (encoding, header), paths in groups.items():
        raw = spark.read.schema(", ".join(f"c{i} string" for i in range(len(header)))).option("header", "true").option("enforceSchema", "true").option("encoding", encoding).csv(paths)
        named = raw.select(*[F.col(f"c{i}").alias(n) for i, n in clean_header(list(header))], F.col("_metadata.file_path").alias("_path"))
        frames.append(path_columns(named, F.col("_path")).drop("_path"))
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return typed_events(df)


def typed_events(df: DataFrame) -> DataFrame:
    """Dates as d/m/Y and numbers of raw events; what can't be read becomes null."""
    number = {c: F.col(c).try_cast("double") for c in ("latitud", "longitud", "declarado_tm", "porcentaje_juvenil") if c in df.columns}
    return df.withColumns({"fecha_cala": F.try_to_timestamp(F.trim("fecha_cala"), F.lit("d/M/yyyy")).cast("date"), **number})


def write_event_files(df: DataFrame, root: str, header: str) -> None:
    """A file per folder (year) and part (Primera, segunda) of df(folder, part, value), each with the header line."""
    spark = df.sparkSession
    lines = df.select("folder", "part", F.lit(1).alias("o"), "value").unionByName(df.select("folder", "part").distinct().select("folder", "part", F.lit(0).alias("o"), F.lit(header).alias("value")))
    placed = lines.repartition("folder", "part").sortWithinPartitions("folder", "part", "o")
    placed.select("folder", "part", "value").write.partitionBy("folder", "part").text(f"{root}/_new")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(path(f"{root}/_new/folder=*/part=*/part-*"))
    for status in found:  # one per folder and part; Spark names files itself
        folder, part = (status.getPath().getParent().getParent().getName().split("=")[1], status.getPath().getParent().getName().split("=")[1])
        fs.mkdirs(path(f"{root}/{folder}"))
        fs.rename(status.getPath(), path(f"{root}/{folder}/calas anchoveta {part} temporada.csv"))
    fs.delete(path(f"{root}/_new"), True)


def missing(wanted: DataFrame, written: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are wanted but not yet written."""
    return wanted.select(*keys).distinct().join(written.select(*keys).distinct(), keys, "left_anti")


def append_missing(df: DataFrame, path: str, keys: list[str]) -> None:
    """Writes the partitions of df that path lacks; those already there stay as they are."""
    spark = df.sparkSession
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    if location.getFileSystem(spark._jsc.hadoopConfiguration()).exists(location):
        df = df.join(F.broadcast(missing(df, spark.read.parquet(path), keys)), keys, "left_semi")  # a row per partition
    df.write.mode("append").partitionBy(*keys).parquet(path)


def write_grids(grids: dict[str, DataFrame], path: str, tile: float = 2.0) -> None:
    """Long grids (time, lat, lon, value), each variable under its name, in folders by variable and year.

    Rows are dealt out by ranges and lie by tiles of so many degrees, so a large year has several files, and a crop passes
    over the row groups and pages of the other tiles.
    """
    both = reduce(DataFrame.unionByName, [g.withColumn("var", F.lit(v)) for v, g in grids.items()]).withColumn("year", F.year("time"))
    order = ["var", "year", F.floor(F.col("lat") / tile), F.floor(F.col("lon") / tile)]
    placed = both.repartitionByRange(*order).sortWithinPartitions(*order, "lat", "lon", "time")
    placed.write.mode("append").partitionBy("var", "year").parquet(path)


def scan_grid(spark: SparkSession, path: str, var: str, years: tuple[int, int]) -> DataFrame:
    """time, lat, lon, value of one variable, of the years from first to last; other folders aren't read."""
    df = spark.read.parquet(path).filter((F.col("var") == var) & F.col("year").between(*years))
    return df.select("time", "lat", "lon", "value")


def date_of_name(path: Column) -> Column:
    """The first date of eight digits in a file's name; null where there is none."""
    digits = F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"(?<![0-9])([0-9]{8})(?![0-9])", 1)
    return F.try_to_timestamp(digits, F.lit("yyyyMMdd")).cast("date")


def with_variables(df: DataFrame, keys: list[str], var: str, required: list[str]) -> DataFrame:
    """Rows of the groups in which each of the required variables has a value; inputs that lack one are skipped."""
    has = df.filter(F.col("value").isNotNull() & F.col(var).isin(required)).groupBy(*keys).agg(F.count_distinct(var).alias("_n")).filter(F.col("_n") == len(required))
    return df.join(has.select(*keys), keys, "left_semi")


def write_csv(df: DataFrame, path: str, decimals: int = 6) -> None:
    """CSV with a header; fractions with a fixed number of decimals, nulls empty."""
    number = lambda c: F.when(F.col(c).isNotNull(), F.format_string(f"%.{decimals}f", F.col(c))).alias(c)
    df.select(*[number(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]).write.option("header", "true").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str, columns: list[str]) -> DataFrame:
    """Some columns of a CSV with a header; the others aren't parsed."""
    return spark.read.schema(schema).option("header", "true").csv(path).select(*columns)

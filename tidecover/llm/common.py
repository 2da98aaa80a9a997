"""Small shared helpers: input tables, words, content keys and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"

_own_dirs: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or an own one where that is unset (local runs)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_dirs:
            _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="tidecover-")
        base = _own_dirs[app]
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: cuts lineage and survives the loss of any executor.

    Once written, nothing needs the shuffle files any more, so Spark removes them at the end of the write.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    with set_conf(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Removes the files of stored tables that nothing reads any more; others are left alone."""
    for df in frames:
        if where := getattr(df, "stored_at", None):
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(where)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def set_conf(spark: SparkSession, own: dict[str, str]):
    """Session settings that hold within only."""
    old = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def set_aside(df: DataFrame, used: list[str], made: list[str]) -> DataFrame:
    """df with the columns used as they are and all others in one struct, where their names can't clash with an operator's.

    Columns named as those that the operator makes go.
    """
    gone = {c.lower() for c in [*used, *made]}
    rest = [c for c in df.columns if c.lower() not in gone]
    return df.select(*used, *([F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_rest")] if rest else []))


def put_back(df: DataFrame, columns: list[str], made: list[str]) -> DataFrame:
    """The columns that set_aside was given, in their order, then those made; used ones that df lacks are left out."""
    gone, here = {c.lower() for c in made}, {c.lower() for c in df.columns}
    rest = {c.lower() for c in df.schema["_rest"].dataType.names} if "_rest" in df.columns else set()
    held = [F.col("_rest")[c].alias(c) if c.lower() in rest else F.col(c) for c in columns if c.lower() not in gone and (c.lower() in rest or c.lower() in here)]
    return df.select(*held, *made)


def filter_once(df: DataFrame, condition: Column) -> DataFrame:
    """df.filter(condition), but the condition stays above the columns it uses.

    Spark moves a plain filter below a projection by putting the projection's expressions into it, there to be computed
    again, and within lambdas for every element.  A filter on what a generator makes isn't moved.
    """
    return df.select("*", F.explode_outer(F.array(condition)).alias("_ok")).filter("_ok").drop("_ok")


def or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def folded(text: Column) -> Column:
    """A key for text with A-Z read as a-z: equal exactly where the texts so lowered are equal, and with the same words.

    ``lower`` would also change letters beyond ASCII.  So a text with such letters is first read byte by byte as
    Latin-1: then ``lower`` may only move the first byte of a UTF-8 sequence, which stays apart from all others by the
    number of bytes that follow.
    """
    by_byte = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    return F.lower(F.when(F.octet_length(text) == F.length(text), text).otherwise(by_byte))


def words(text: Column, separators: str = SPACES) -> Column:
    """The words between separators (a pattern of one or more of them); an empty text has none.

    text should be a column, not a costly expression, as it is read several times.
    """
    if separators != SPACES:
        return F.array_remove(F.split(text, separators, -1), "")
    # A split at one plain character needs no pattern, so all white space is made that first, where there is other.
    has = lambda chars: reduce(Column.__or__, [F.contains(text, F.lit(c)) for c in chars])
    plain = F.when(has("\t\x0b\x0c\r"), F.regexp_replace(text, SPACES, " ")).when(has("\n"), F.replace(text, F.lit("\n"), F.lit(" "))).otherwise(text)
    return F.array_remove(F.split(plain, " ", -1), "")


def shingles(word_array: Column, k: int) -> Column:
    """64-bit hashes of the distinct k-word shingles; fewer words: the whole sequence as one; no words: none.

    word_array must be a column, not an expression, as it is read for every shingle.
    """
    n = F.size(word_array)
    many = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(word_array, i + j) for j in range(k)]))
    return F.when(n >= k, F.array_distinct(many)).when(n > 0, F.array(F.xxhash64(word_array))).otherwise(F.array().cast("array<bigint>"))


def row_keys(doc_id: Column, text: Column) -> list[Column]:
    """128 bits that name a row by id and content, so that repeated ids and null ids need no special care."""
    return [F.xxhash64(doc_id, text).alias("k1"), F.xxhash64(text, F.lit(1), doc_id).alias("k2")]


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)

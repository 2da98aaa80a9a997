"""A corpus from documents: quality rules, line dedup, one document of each group of near copies, no benchmark passages,
packed sequences.  Each stage takes (spark, docs, sf_dir), is written as Parquet and read again by the next.  All but the
last return the columns of docs, whatever the others are named; null texts are empty, rows are told apart by id and content,
and an empty table gives an empty one."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecover.llm.common import discard, filter_once, or_empty, put_back, row_keys, set_aside, stored, table
from tidecover.llm.decontam import contamination
from tidecover.llm.jaccard import near_rows
from tidecover.llm.lines import repeated_lines, without_lines
from tidecover.llm.packing import pack
from tidecover.llm.quality import quality_verdict


def other_columns_aside(stage):
    """stage, with the columns that it doesn't read in a struct, so that none clashes with what an operator adds."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        used = [c for c in ("doc_id", "text", "lang", "n_chars") if c in docs.columns]
        return put_back(stage(spark, set_aside(docs, used, []), sf_dir), docs.columns, [])

    return run


@other_columns_aside
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, those without text among them; repeated rows go or stay together."""
    return filter_once(quality_verdict(docs, with_text=True), F.col("kept")).select(docs.columns)


@other_columns_aside
def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line go; a document goes if that leaves no word of it.  n_chars follows the text.

    Earlier is by doc_id (null first), then line.  Rows repeated with their doc_id and text are one document, so they stay.
    """
    found = without_lines(repeated_lines(docs))
    some = (F.size("removed") == 0) | or_empty(F.col("text")).rlike(r"[^\x20\x09-\x0D]")
    left = filter_once(found, some)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.size("removed") > 0, F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return left.select(docs.columns)


@other_columns_aside
def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, 0.8) the row with the smallest doc_id stays, ties by content.

    Null doc_ids come last; of rows repeated with their doc_id one stays.  Texts without words are no copies.
    """
    rows = near_rows(docs).select("id.k1", "id.k2", (F.col("id") != F.col("least")).alias("later"))
    per = rows.groupBy("k1", "k2").agg(F.max("later").alias("later"), F.count(F.lit(1)).alias("c"))
    marked = stored(per.filter("later or c > 1").select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "later"), "marked")
    again = stored(marked.filter("not later").select("_k1", "_k2"), "again")
    k1, k2 = row_keys(F.col("doc_id"), F.col("text"))
    keyed = docs.withColumns({"_k1": k1, "_k2": k2})
    keys = ["_k1", "_k2"]
    one = keyed.join(again, keys).dropDuplicates(keys)
    return keyed.join(marked.select(keys), keys, "left_anti").select(docs.columns).unionByName(one.select(docs.columns))


@other_columns_aside
def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go; null and empty texts have none."""
    return filter_once(contamination(docs, table(spark, sf_dir, "benchmark")), ~F.col("contaminated")).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 2048 tokens."""
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_copy_stage),
    ("benchmark decontamination", benchmark_stage),
    ("packing", packing_stage),
]

#: SQL can't express the tokenizer; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)

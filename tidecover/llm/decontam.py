"""Benchmark decontamination: windows of test words, hashed and broadcast, are looked up at every position of a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import folded, or_empty, put_back, row_keys, set_aside, table, words

# Fixed value: everything in ASCII that isn't a digit or a lower-case letter separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normal_words(text: Column) -> Column:
    return words(folded(or_empty(text)), SEPARATORS)


def window_at(word_array: Column, i: Column, n: int) -> Column:
    return F.xxhash64(*[F.get(word_array, i + j) for j in range(n)])


def windows(df: DataFrame, lengths: list[int]) -> DataFrame:
    """Explodes _w into all windows of the lengths, in one pass: position _at, words _n, hash _h (null where there is none).

    Outer, as a plain explode makes Spark filter on the array first, which computes it twice and from the text.
    """
    least = min(lengths)
    at = F.sequence(F.lit(0), F.size("_w") - least)
    if len(lengths) == 1:
        each = F.transform(at, lambda i: window_at(F.col("_w"), i, least))
        return df.withColumn("_hashes", F.when(F.size("_w") >= least, each)).select(*df.columns, F.lit(least).alias("_n"), F.posexplode_outer("_hashes").alias("_at", "_h"))
    of = lambda i, n: F.struct(F.lit(n).alias("_n"), F.when(i + n <= F.size("_w"), window_at(F.col("_w"), i, n)).alias("_h"))
    each = F.transform(at, lambda i: F.array(*[of(i, n) for n in lengths]))
    first = df.withColumn("_hashes", F.when(F.size("_w") >= least, each)).select(*df.columns, F.posexplode_outer("_hashes").alias("_at", "_hs"))
    return first.select(*df.columns, "_at", F.explode_outer("_hs").alias("_s")).select(*df.columns, "_at", "_s._n", "_s._h")


def benchmark_windows(benchmark: DataFrame, n: int = 10) -> DataFrame:
    """One row per distinct window: _n words, hash _h, the words and the items that hold it.

    An item with fewer than n words, but not none, is one window; null or empty items have none.
    """
    items = benchmark.select(F.col("item_id"), normal_words(F.col("text")).alias("_w"))
    each = F.when(F.size("_w") >= n, F.transform(F.sequence(F.lit(0), F.size("_w") - n), lambda i: F.slice("_w", i + 1, n))).when(F.size("_w") > 0, F.array("_w"))
    rows = items.select("item_id", F.explode(each).alias("_win"))
    return rows.groupBy("_win").agg(F.collect_set("item_id").alias("_items")).select(F.size("_win").alias("_n"), F.xxhash64(*[F.get("_win", F.lit(j)) for j in range(n)]).alias("_h"), "_win", "_items")


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", *, n: int = 10, broadcast_windows: int = 1_000_000, broadcast_bytes: int = 256 << 20) -> DataFrame:
    """Adds n_words, hit_at (sorted positions of hit words), hit_items (sorted) and contaminated.

    Every window of every whole text is looked up by its hash, and a hit is then verified word by word.  The windows of the
    benchmark are broadcast where they are at most broadcast_windows and, with their words and items, broadcast_bytes
    (both counted first); else both sides are shuffled.
    Null and empty texts have no words; rows with equal ids and null ids are told apart by their content.  Other columns
    stay; those named as the added ones are replaced.
    """
    columns, made = docs.columns, ["n_words", "hit_at", "hit_items", "contaminated"]
    docs = set_aside(docs, list(dict.fromkeys(["doc_id", text])), made)
    bench = benchmark_windows(benchmark, n)
    held = F.octet_length(F.array_join("_win", " ")) + 16 * F.size("_win") + F.octet_length(F.array_join(F.transform("_items", lambda x: x.cast("string")), " ")) + 16 * F.size("_items") + 64
    counted = bench.filter("_n is not null").groupBy("_n").agg(F.count(F.lit(1)).alias("c"), F.sum(held).alias("b")).orderBy("_n").collect()  # n rows at most
    lengths = [r["_n"] for r in counted]
    small = sum(r["c"] for r in counted) <= broadcast_windows and sum(r["b"] for r in counted) <= broadcast_bytes
    known = F.broadcast(bench) if small else bench
    k1, k2 = row_keys(F.col("doc_id"), F.col(text))
    keyed = docs.withColumns({"_k1": k1, "_k2": k2})
    lists = keyed.select("_k1", "_k2", normal_words(F.col(text)).alias("_w"))
    kind = f"array<struct<_at:int,_win:array<string>,_items:array<{dict(benchmark.dtypes)['item_id']}>>>"
    if lengths:
        here = known.withColumnsRenamed({"_h": "_bh", "_n": "_bn"})
        # Only keys, position and hash leave a text's row; hits are few and meet their text again below.
        hits = windows(lists, lengths).select("_k1", "_k2", "_at", "_n", "_h").join(here, (F.col("_h") == F.col("_bh")) & (F.col("_n") == F.col("_bn")))
        per = hits.select("_k1", "_k2", F.struct("_at", "_win", "_items").alias("_hit")).groupBy("_k1", "_k2").agg(F.collect_set("_hit").alias("_hits"))  # a row's words at most
        out = keyed.join(per, ["_k1", "_k2"], "left")
    else:
        out = keyed.withColumn("_hits", F.lit(None).cast(kind))
    out = out.withColumn("_w", normal_words(F.col(text)))
    right = F.filter(F.coalesce("_hits", F.array().cast(kind)), lambda x: F.slice("_w", x["_at"] + 1, F.size(x["_win"])) == x["_win"])
    out = out.withColumns({"n_words": F.size("_w").cast("long"), "_hits": right})
    at = F.array_distinct(F.flatten(F.transform("_hits", lambda x: F.sequence(x["_at"], x["_at"] + F.size(x["_win"]) - 1))))
    out = out.withColumns({"hit_at": F.sort_array(at), "hit_items": F.sort_array(F.array_distinct(F.flatten(F.transform("_hits", lambda x: x["_items"]))))})
    return put_back(out.withColumn("contaminated", F.size("hit_at") > 0), columns, made)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    ids = F.array_join(F.array_sort(F.transform("hit_items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", F.size("hit_at").cast("long").alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), "contaminated")

"""Line dedup: an exact set-similarity join of lines.

A line's tokens are its five-word shingles, ordered by rarity; lines that can be similar share one of their rarest ones
(prefix filter), at places that leave enough tokens (positional filter), and have similar lengths (length filter); what is
left is verified by the whole sets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, or_empty, row_keys, stored, table
from .jaccard import Rule, linkable, live_rows, prefixes, single_texts, verified


def resembling_earlier(sets: DataFrame, rule: Rule) -> DataFrame:
    """node: those of sets (node, first, n, toks) that link to one whose first is smaller."""
    prefix = prefixes(sets, rule)
    pair = (F.col("node").alias("a"), F.col("y").alias("b"))
    # Most have a match among a few earlier ones: per token, the earliest of all its lines, of a half of them (by hash), of
    # a quarter and so on.  Only lines without such a match are held against all earlier ones.
    key = F.xxhash64("node", F.lit(7))
    zeros = F.bit_count(key.bitwiseAND(-key) - 1)
    levels = prefix.select("tok", F.explode_outer(F.sequence(F.lit(0), zeros)).alias("level"), F.struct("first", "node", "n", "rank").alias("l"))
    some = levels.groupBy("tok", "level").agg(F.min("l").alias("l")).select("tok", "l").distinct()
    early = some.select("tok", F.col("l.first").alias("f"), F.col("l.node").alias("y"), F.col("l.n").alias("m"), F.col("l.rank").alias("j"))
    before = (F.col("f") < F.col("first")) & rule.meets(F.col("n"), F.col("rank"), F.col("m"), F.col("j"))
    tried = stored(prefix.join(early, "tok").filter(before).select(*pair).distinct(), "tried")
    near = verified(tried, sets, rule)
    found = stored(near.select(F.col("a").alias("node")).distinct(), "found")
    others = prefix.select("tok", F.col("first").alias("f"), F.col("node").alias("y"), F.col("n").alias("m"), F.col("rank").alias("j"))
    rest = prefix.join(found, "node", "left_anti").join(others, "tok").filter(before).select(*pair).distinct()
    pairs = stored(rest.join(tried, ["a", "b"], "left_anti"), "pairs")
    more = verified(pairs, sets, rule).select(F.col("a").alias("node")).distinct()
    discard(prefix, tried, pairs, near)
    return found.union(more)


def repeated_lines(docs: DataFrame, text: str = "text", rule: Rule = Rule()) -> DataFrame:  # noqa: B008
    """Adds n_lines, removed (sorted numbers, from 0, of the lines that repeat an earlier one) to docs.

    Lines are parts between newlines; those without words are left alone, those with fewer than rule.k words are alike
    only where all words are the same.  A line is removed if it is like an earlier one, by (doc_id, line), itself (Jaccard
    of their shingles), whether that one stays or not; so every line removed has a like one before it.  Null and empty
    texts have one empty line; a null doc_id comes first; rows with the same doc_id and text count as one document.  An
    empty table gives an empty one.  Other columns stay as they are, but for earlier ones named n_lines or removed.
    """
    docs = docs.drop("n_lines", "removed")
    t = or_empty(F.col(text))
    k1, k2 = row_keys(F.col("doc_id"), F.col(text))
    # The keys come first, in a projection of their own: beside the generator Spark would compute them again for every line.
    keyed = docs.select("doc_id", k1, k2, t.alias("_t"))
    each = keyed.select("doc_id", "k1", "k2", F.posexplode_outer(F.split("_t", "\n", -1)).alias("line", "s"))
    live = live_rows(each.select(F.struct("doc_id", "line", "k1", "k2").alias("id"), "s"), rule)
    texts = single_texts(live)
    able = linkable(texts, rule)
    again = resembling_earlier(able, rule).withColumn("again", F.lit(True))
    flags = texts.select("node", "first").join(again, "node", "left")
    out = live.select("id", "node").join(flags, "node").filter((F.col("id") != F.col("first")) | F.col("again"))
    per = stored(out.groupBy(F.col("id")["k1"].alias("_k1"), F.col("id")["k2"].alias("_k2")).agg(F.sort_array(F.collect_set(F.col("id")["line"])).alias("removed")), "removed")
    discard(live, texts, able)
    held = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    n_lines = (F.octet_length(t) - F.octet_length(F.replace(t, F.lit("\n"), F.lit(""))) + 1).cast("long")
    joined = docs.select(held, k1.alias("_k1"), k2.alias("_k2"), n_lines.alias("_n")).join(per, ["_k1", "_k2"], "left")
    return joined.select("_row.*", F.col("_n").alias("n_lines"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def without_lines(found: DataFrame, text: str = "text") -> DataFrame:
    """The texts without their removed lines."""
    kept = F.filter(F.split(or_empty(F.col(text)), "\n", -1), lambda s, i: ~F.array_contains("removed", i))
    return found.withColumn(text, F.when(F.size("removed") > 0, F.array_join(kept, "\n")).otherwise(F.col(text)))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join(F.transform("removed", lambda x: x.cast("string")), ",").alias("removed_lines"))

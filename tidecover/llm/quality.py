"""Quality rules: base counts per document and Jensen-Shannon distance to language references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, or_empty, put_back, set_aside, stored, table, words

# Frequent function words of each reference language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "it", "with", "as", "was"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "des", "für", "ist"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "que", "pour", "qui"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "del", "se", "las", "por", "para"],
}
# Character classes as (name, pattern of one character); all other characters are one class more.
CHAR_CLASSES = [("space", r"[\x20\x09-\x0D]"), ("symbol", r"[#*$%&|<>]"), ("upper", r"[A-Z]"), ("digit", r"[0-9]"), ("stop", r"[.,;:!?]")]
N_WORDS = 12
MADE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "js_chars", "js_words", "kept"]


def language(lang: Column) -> Column:
    return F.when(lang.isin(list(COMMON_WORDS)), lang).otherwise("other")


def counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Adds, for every whole text, the base counts (long) and two histograms, in one pass and without a shuffle.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; _chars by CHAR_CLASSES and the rest; _common by the
    language's common words and the rest (null for other languages).  A null text counts as empty.
    """
    df = docs.withColumns({"_t": or_empty(F.col(text)), "_key": language(F.col(lang) if lang in docs.columns else F.lit(None).cast("string"))})
    # The classes hold no a-z, so they are counted in what is left without these: a quarter of the text or so.
    df = df.withColumns({"_w": words(F.col("_t")), "_few": F.regexp_replace("_t", "[a-z]+", ""), "_lines": F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    n = F.size("_w")
    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))
    df = df.withColumn("_h", F.when(n >= 3, hashes))
    few = {name: (F.length("_few") - F.length(F.regexp_replace("_few", f"{p}+", ""))).cast("long") for name, p in CHAR_CLASSES}
    listed = F.lit(None).cast("array<string>")
    for key, ws in COMMON_WORDS.items():
        listed = F.when(F.col("_key") == key, F.array(*map(F.lit, ws))).otherwise(listed)
    common = F.transform(listed, lambda w: (n - F.size(F.array_remove("_w", w))).cast("long"))
    df = df.select(
        *docs.columns, "_key", n.cast("long").alias("n_words"), F.length("_t").cast("long").alias("_len"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("_h")) < F.size("_h"), repeated_words(F.col("_h"))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        *[c.alias(f"_{k}") for k, c in few.items()], common.alias("_cw"),
    )
    total = lambda cols: sum(map(F.col, cols[1:]), F.col(cols[0]))
    classes = [f"_{k}" for k in few]
    return df.select(
        *docs.columns, "n_words", (F.col("_len") - F.col("_space")).alias("word_chars"), F.col("_symbol").alias("n_symbols"), "n_dup_lines", "n_repeat_words", "_key",
        F.array(*classes, F.col("_len") - total(classes)).alias("_chars"),
        F.concat("_cw", F.array(F.col("n_words") - F.aggregate("_cw", F.lit(0).cast("long"), lambda a, x: a + x))).alias("_common"),
    )


def repeated_words(hashes: Column) -> Column:
    """Words in 3-word windows that occur twice or more, from the windows' hashes: equal neighbours once sorted."""

    def covered(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        hit = F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1))
        return F.size(F.array_distinct(F.flatten(F.transform(hit, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    return let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), covered)


def base_failed(min_words: int = 50, max_repeat_percent: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def references(counted: DataFrame) -> DataFrame:
    """One row per language key (five at most): the histograms summed over the rows of counted; "other" pools all of them."""
    nc, nw = len(CHAR_CLASSES) + 1, N_WORDS + 1
    cols = [f"s{i}" for i in range(nc + nw)]
    sums = [F.sum(F.get("_chars", F.lit(i))).alias(cols[i]) for i in range(nc)] + [F.sum(F.get("_common", F.lit(i))).alias(cols[nc + i]) for i in range(nw)]
    per = counted.groupBy("_key").agg(*sums)
    pooled = per.agg(*[F.sum(c).alias(c) for c in cols]).select(F.lit("other").alias("_key"), *cols)
    both = per.filter("_key <> 'other'").unionByName(pooled)
    return both.select("_key", F.array(*cols[:nc]).alias("_ref_chars"), F.array(*cols[nc:]).alias("_ref_common"))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two count histograms; null where either is null or empty."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0)).cast("double"))
    share = lambda v, t: F.coalesce(v, F.lit(0)).cast("double") / t
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)

    def term(a: Column, b: Column) -> Column:
        m = (a + b) / 2
        return (part(a, m) + part(b, m)) / 2

    terms = F.zip_with(p, q, lambda a, b: term(share(a, total(p)), share(b, total(q))))
    d = F.aggregate(terms, F.lit(0.0), lambda a, v: a + v)
    return F.when((total(p) > 0) & (total(q) > 0), F.sqrt(F.greatest(d, F.lit(0.0))))


def quality_verdict(docs: DataFrame, text: str = "text", lang: str = "lang", *, min_words: int = 50, min_common_words: int = 100, max_char_distance: float = 0.285, max_word_distance: float = 0.27, with_text: bool = False) -> DataFrame:
    """Adds the base counts, base_failed, js_chars, js_words and kept; one pass over the texts.

    kept is false where the base rules fail, or where a histogram lies further (Jensen-Shannon distance) from its
    language's reference than allowed.  Guards: characters are judged from min_words words on, common words from
    min_common_words on.  The references are sums over all documents that pass the base rules; where a language has none, its
    documents are judged by the base rules alone.  Null text: no words, so not kept.  Unknown or
    null language: characters are held against all languages together and common words aren't judged.  An empty table
    gives an empty table; all other columns of docs stay, and the texts too if with_text; columns named as the added ones
    are replaced.  Repeated rows are judged alike.  Without a column lang every language is null.
    """
    columns = docs.columns
    docs = set_aside(docs, [c for c in dict.fromkeys(["doc_id", text, lang]) if c in columns], MADE)
    keep = [c for c in docs.columns if c != text or with_text]
    # Written once, as both the references and the verdict read them; without the texts the counted rows are small.
    counted = stored(counts(docs, text, lang).select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "_key", "_chars", "_common", *keep), "quality")
    # Junk that the base rules know doesn't move the references.
    ref = F.broadcast(references(counted.filter(~base_failed(min_words))))  # five rows at most
    out = judged(counted.join(ref, "_key", "left"), min_words, min_common_words, max_char_distance, max_word_distance)
    return put_back(out, columns, MADE)


def judged(df: DataFrame, min_words: int, min_common_words: int, max_char_distance: float, max_word_distance: float) -> DataFrame:
    df = df.withColumns({"base_failed": base_failed(min_words), "js_chars": js_distance(F.col("_chars"), F.col("_ref_chars")), "js_words": js_distance(F.col("_common"), F.col("_ref_common"))})
    far = (F.col("n_words") >= min_words) & (F.coalesce("js_chars", F.lit(0.0)) > max_char_distance)
    odd = (F.col("n_words") >= min_common_words) & (F.coalesce("js_words", F.lit(0.0)) > max_word_distance)
    return df.withColumn("kept", ~(F.col("base_failed") | far | odd)).drop("_key", "_chars", "_common", "_ref_chars", "_ref_common")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality_verdict(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")

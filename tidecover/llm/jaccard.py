"""N-gram Jaccard join with a token-group matrix.

Tokens are hashes of word shingles.  First the texts go that have more tokens to themselves than a similar text allows,
by a sample of shorter shingles, then by all tokens.  What is left is ordered by rarity and cut down to the tokens of which similar
texts must share one.  Texts found to be alike form a group; the matrix holds each group's union of such tokens with the
range of its sizes and the most that its texts have left from there on.  A text is held against the groups' unions, and
only the groups that can hold a similar text are opened.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, filter_once, folded, or_empty, row_keys, shingles, stored, table, words
from .components import components


@dataclass(frozen=True)
class Rule:
    """Two texts link when percent * union <= 100 * intersection of their sets of k-word shingles."""

    k: int = 5
    percent: int = 80
    wide: float = 1.75  # the first sample is so many times the share of tokens that a text may have to itself

    def need(self, n: Column) -> Column:
        """The least overlap of a set of n with any set it links to."""
        return F.ceil(n * self.percent / F.lit(100)).cast("int")

    def own(self, n: Column) -> Column:
        """So many tokens a set of n may have to itself, and still link."""
        return n - self.need(n)

    def overlap(self, n: Column, m: Column) -> Column:
        """The least overlap of sets of n and m that link."""
        return F.ceil((n + m) * self.percent / F.lit(100 + self.percent)).cast("int")

    def fits(self, n: Column, m: Column) -> Column:
        return (100 * n >= self.percent * m) & (100 * m >= self.percent * n)

    def meets(self, n: Column, i: Column, m: Column, j: Column) -> Column:
        """Length and positional filter: can sets of n and m link whose first common token is their i-th and j-th (from 0)?"""
        return self.fits(n, m) & (F.least(n - i, m - j) >= self.overlap(n, m))

    def linked(self, inter: Column, n: Column, m: Column) -> Column:
        return (inter > 0) & (100 * inter >= self.percent * (n + m - inter))


def with_words(df: DataFrame, text: str, *kept: str | Column) -> DataFrame:
    """kept, _w: the words of text in lower case; folded in a projection of its own, so that it is done once."""
    names = [F.col(c) if isinstance(c, str) else c for c in kept]
    made = df.select(*names, folded(or_empty(F.col(text))).alias("_folded"))
    return made.select(*[c for c in made.columns if c != "_folded"], words(F.col("_folded")).alias("_w"))


def sampled_grams(texts: DataFrame, k: int, size: int, share: float) -> DataFrame:
    """tok, node, m, i, w of a share of the grams of size words (k or one less) of texts (node, s) of at least k words.

    i is the gram's place, m the number of k-word shingles, w how many of them hold it but not the sampled gram before it.
    """
    named = with_words(texts, "s", "node")
    starts = F.when(F.size("_w") >= k, F.sequence(F.lit(0), F.size("_w") - size))
    spread = named.select("node", "_w", F.explode_outer(starts).alias("i"))
    word = lambda j: F.get("_w", F.col("i") + j)
    limit = int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1
    taken = lambda j: F.xxhash64(word(j), word(j + min(2, size - 1))) <= limit
    m = F.size("_w") - k + 1
    w = (F.col("i") < m).cast("int") + ((F.col("i") > 0) & ~taken(-1)).cast("int") * (k - size)
    some = spread.filter(F.col("i").isNotNull() & taken(0))
    return some.select(F.xxhash64(*[word(j) for j in range(size)]).alias("tok"), "node", m.alias("m"), "i", w.alias("w"))


def own_spans(grams: DataFrame) -> DataFrame:
    """node, m, own, copies: the tokens that a text has to itself for sure, by its grams (tok, node, m, i, w).

    A gram at one place i of one text makes the w tokens own that it alone accounts for; texts with copies are one text.
    """
    place = F.shiftleft(F.col("m").cast("long"), 33) + F.shiftleft(F.col("i").cast("long"), 2) + F.col("w")
    # One number names text and place, so two of them tell whether a gram stands anywhere else.
    at = F.col("node").bitwiseXOR(F.xxhash64("i")).alias("at")
    per = grams.select("tok", at, place.alias("place")).groupBy("tok").agg(F.min("at").alias("at"), F.max("at").alias("to"), F.min("place").alias("place"), F.count(F.lit(1)).alias("c")).filter("at = to")
    i = F.shiftright("place", 2).bitwiseAND(2**31 - 1).cast("int")
    one = per.select(F.col("at").bitwiseXOR(F.xxhash64(i)).alias("node"), F.shiftright("place", 33).cast("int").alias("m"), F.col("place").bitwiseAND(3).alias("w"), "c")
    return one.groupBy("node").agg(F.max("m").alias("m"), F.sum("w").alias("own"), F.max("c").alias("copies"))


def apart(texts: DataFrame, rule: Rule, size: int, share: float) -> DataFrame:
    """node, copied (do several rows have it) of the texts (node, s) that have more tokens to themselves than a similar text allows.

    That is as far as a share of their grams of size words shows.  A gram may be one word shorter than a token: if it stands
    nowhere else, neither do the two tokens around it, so a sample covers nearly twice its share of the tokens.  A gram is
    sampled by its first and third word, which is the same in every text; texts of fewer words than a token have tokens of
    their own kind, so their grams don't matter.
    """
    # Repeated shingles make a row look longer than its set, which only lets it have more tokens to itself.
    own = own_spans(sampled_grams(texts, rule.k, size, share)).filter(F.col("own") > rule.own(F.col("m")))
    return stored(own.select("node", (F.col("copies") > 1).alias("copied")), "apart")


def live_rows(rows: DataFrame, rule: Rule) -> DataFrame:
    """id, node (hash of the text), s of the rows (id, s) that may link or equal others; s is null if they only equal some.

    Rows without words go, and those apart from all others; where such a text has copies, its rows stay without s.
    """
    named = rows.select("id", F.xxhash64("s").alias("node"), "s")
    size = max(rule.k - 1, 1)
    share = min(1.0, (100 - rule.percent) / 100 * rule.wide / (rule.k - size + 1) ** 0.5)
    gone = apart(named, rule, size, share)
    some = named.filter(F.ltrim("s", F.lit(" \t\n\x0b\x0c\r")) != "").join(gone, "node", "left")
    left = some.filter(F.col("copied").isNull() | F.col("copied"))
    out = stored(left.select("id", "node", F.when(F.col("copied").isNull(), F.col("s")).alias("s")), "live")
    discard(gone)
    return out


def single_texts(live: DataFrame) -> DataFrame:
    """node, first (the smallest id), s of each node of live."""
    return stored(live.groupBy("node").agg(F.min("id").alias("first"), F.first("s").alias("s")), "texts")


def linkable(texts: DataFrame, rule: Rule) -> DataFrame:
    """node, first, n, toks of the texts with s that are not apart from all others, now by all tokens and without copies."""
    some = texts.filter(F.col("s").isNotNull())
    gone = apart(some, rule, rule.k, 1.0)
    df = with_words(some.join(gone, "node", "left_anti"), "s", "node", "first").select("node", "first", shingles(F.col("_w"), rule.k).alias("toks"))
    out = stored(df.select("node", "first", F.size("toks").alias("n"), "toks"), "linkable")
    discard(gone)
    return out


def prefixes(sets: DataFrame, rule: Rule) -> DataFrame:
    """tok, node, first, n, rank, score: the tokens of each text, rarest first, of which a similar text must have one.

    rank counts from 0 among all of the text's tokens; those that no other text has come first and can be left out.
    score is higher for a text whose tokens more others have.
    """
    postings = sets.select("node", F.explode_outer("toks").alias("tok"))
    common = stored(postings.groupBy("tok").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "common")
    shared = postings.join(common, "tok").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "tok"))).alias("shared"), F.sum(F.log("df")).alias("sum"))
    per = shared.join(sets.select("node", "first", "n"), "node").select("node", "first", "n", "shared", (F.col("sum") / F.col("n")).alias("score"), (F.col("n") - F.size("shared")).alias("own"))
    take = F.greatest(rule.own(F.col("n")) + 1 - F.col("own"), F.lit(0))
    each = per.select("node", "first", "n", "score", "own", F.posexplode_outer(F.slice("shared", F.lit(1), take)).alias("at", "x")).filter("at is not null")
    out = stored(each.select(F.col("x")["tok"].alias("tok"), "node", "first", "n", (F.col("own") + F.col("at")).alias("rank"), "score"), "prefixes")
    discard(common)
    return out


def verified(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) of nodes that link, by their whole sets."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("toks").alias(f"t{x}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    df = both.select("a", "b", "na", "nb", F.size(F.array_intersect("ta", "tb")).alias("i"))
    return stored(filter_once(df, rule.linked(F.col("i"), F.col("na"), F.col("nb"))).select("a", "b"), "near")


def links(sets: DataFrame, rule: Rule) -> DataFrame:
    """(node, label): the components of all links between the sets (node, first, n, toks)."""
    prefix = prefixes(sets, rule)
    couple = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    # A token's leader is its text with the highest score; held against the leaders of their tokens, most copies of a text
    # come together.  What then hangs together is a group.
    lead = prefix.groupBy("tok").agg(F.max(F.struct("score", "node", "n", "rank")).alias("l"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("tok", "l")
    led = prefix.join(lead, "tok").filter((F.col("node") != F.col("l.node")) & rule.meets(F.col("n"), F.col("rank"), F.col("l.n"), F.col("l.rank")))
    tried = stored(led.select(*couple(F.col("node"), F.col("l.node"))).distinct(), "tried")
    near = verified(tried, sets, rule)
    label = components(near)
    member = stored(prefix.join(label, "node", "left").select("tok", "node", "n", "rank", F.coalesce("label", "node").alias("g")), "member")
    matrix = member.groupBy("tok", F.col("g").alias("h")).agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.col("n") - F.col("rank")).alias("room"))
    # Each pair is looked for from its smaller text, whose place of the token must leave the overlap of two of its size.
    n, left = F.col("n"), F.col("n") - F.col("rank")
    least = rule.overlap(n, F.greatest(n, F.col("lo")))
    small = member.filter(left >= rule.overlap(n, n))
    reach = small.join(matrix, "tok").filter((F.col("g") != F.col("h")) & (F.col("hi") >= n) & (100 * n >= rule.percent * F.col("lo")) & (F.least(left, F.col("room")) >= least))
    large = member.select("tok", F.col("g").alias("h"), F.col("node").alias("y"), F.col("n").alias("m"), F.col("rank").alias("j"))
    opened = reach.select("tok", "h", "node", "n", "rank").join(large, ["tok", "h"]).filter((F.struct("n", "node") < F.struct("m", "y")) & rule.meets(n, F.col("rank"), F.col("m"), F.col("j")))
    pairs = stored(opened.select(*couple(F.col("node"), F.col("y"))).distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
    out = components(near.union(verified(pairs, sets, rule)))
    discard(prefix, tried, member, pairs)
    return out


def near_rows(docs: DataFrame, text: str = "text", rule: Rule = Rule()) -> DataFrame:  # noqa: B008
    """id, least (the smallest id that links reach) of the rows of docs that equal or link to others, and some more.

    An id is struct<none, doc_id, k1, k2>: null doc_ids come last, rows with the same doc_id are told apart by content;
    rows that are repeated with their doc_id have one id and come as often as they are there.  Equal texts are one node.
    An empty table gives an empty one.
    """
    k1, k2 = row_keys(F.col("doc_id"), F.col(text))
    id_ = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), k1, k2)
    live = live_rows(docs.select(id_.alias("id"), or_empty(F.col(text)).alias("s")), rule)
    texts = single_texts(live)
    able = linkable(texts, rule)
    label = links(able, rule)
    named = stored(texts.select("node", "first").join(label, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "first"), "named")
    # Written before it is joined, so that Spark can split a large component's rows.
    least = stored(named.groupBy("label").agg(F.min("first").alias("least")), "least")
    by_node = stored(named.join(least, "label").select("node", "least"), "by-node")
    out = stored(live.select("id", "node").join(by_node, "node").select("id", "least"), "rows")
    discard(live, texts, able, named, least, by_node)
    return out


def near_duplicates(docs: DataFrame, text: str = "text", rule: Rule = Rule()) -> DataFrame:  # noqa: B008
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach, itself included), one row per row of docs.

    Null and empty texts have no shingles and link with nothing: their component is their own doc_id.  Fewer than k
    words: the whole sequence is the one shingle.  A row without a doc_id gets the smallest one of its component, null
    if there is none.
    """
    found = near_rows(docs, text, rule)
    moved = found.filter("id <> least").select(F.col("id.k1").alias("_k1"), F.col("id.k2").alias("_k2"), F.col("least.doc_id").alias("_least")).distinct()
    k1, k2 = row_keys(F.col("doc_id"), F.col(text))
    split = with_words(docs, text, "doc_id", k1.alias("_k1"), k2.alias("_k2"))
    rows = split.select("doc_id", "_k1", "_k2", F.size(shingles(F.col("_w"), rule.k)).cast("long").alias("n_shingles"))
    return rows.join(moved, ["_k1", "_k2"], "left").select("doc_id", "n_shingles", F.coalesce("_least", "doc_id").alias("component_id"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, rule=Rule(k=4, percent=85))

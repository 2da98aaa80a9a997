"""Document fingerprints: invertible Bloom lookup sketches of a text's paragraphs.

A sketch has three tables of cells; each paragraph digest goes into one cell of each, by its own bits, and a cell holds the
xor of its digests.  A digest's last CHECK bits are a hash of the others, so a cell that holds one digest alone shows it.
Sketches of two versions subtract cell by cell (by xor); what then stands alone is taken out of its other cells, and so on
(peeling), until all differing digests are known or none is left to take.  Native expressions on one row, so nothing is
shuffled but what the rows are joined by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, or_empty, row_keys, stored, table

WORDS = 16  # a line is cut into paragraphs of so many words
BASE = 8  # cells of each table of a fingerprint
PART = 4  # differing digests to expect in a part of a larger sketch
SIZES = (4, 8, 32)  # cells of each table of a part, first and after failures
CHECK, TABLE, SPLIT = 20, 8, 44  # a digest's bits: check, three times a place in a table, the part of a larger sketch

PIECE = r"(?:[^ \n]{1,64}+ *+){1,%d}+" % WORDS


def shifted(d: Column, by: Column) -> Column:
    return F.call_function("shiftrightunsigned", d, by)


def power(bits: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), bits)


def check(d: Column) -> Column:
    return F.xxhash64(shifted(d, F.lit(CHECK))).bitwiseAND(2**CHECK - 1)


def paragraph_digests(text: Column) -> Column:
    """Digests of a text's paragraphs: its lines, longer ones cut every WORDS words (and words every 64 characters).

    A paragraph's further occurrences have digests of their own, so a text's digests are a set; null and empty texts have none.
    """
    pieces = F.regexp_extract_all(or_empty(text), F.lit(PIECE), F.lit(0))
    hashed = F.array_sort(F.transform(pieces, lambda p: F.xxhash64(p)))

    def numbered(a: Column) -> Column:
        """Sorted hashes, each of several equal ones hashed with its number among them."""
        start = F.transform(a, lambda d, i: F.when((i == 0) | (F.get(a, i - 1) != d), i))
        last = F.aggregate(start, F.array().cast("array<int>"), lambda s, i: F.concat(s, F.array(F.coalesce(i, F.element_at(s, -1)))))
        return F.zip_with(F.transform(a, lambda d, i: F.struct(d.alias("d"), i.alias("i"))), last, lambda x, f: F.when(x["i"] == f, x["d"]).otherwise(F.xxhash64(x["d"], x["i"] - f)))

    apart = let(hashed, lambda a: F.when(F.size(F.array_distinct(a)) == F.size(a), a).otherwise(numbered(a)))
    return F.transform(apart, lambda d: d.bitwiseAND(-(2**CHECK)).bitwiseOR(check(d)))


def places(size: int) -> Column:
    """The cells of a sketch: a digest is in a cell if its bits from s on are w; z masks as many bits as count."""
    return F.array(*[F.struct(F.lit(CHECK + TABLE * j).alias("s"), F.lit(i).cast("bigint").alias("w"), F.lit(size - 1).cast("bigint").alias("z")) for j in range(3) for i in range(size)])


def held(start: Column, digests: Column, place: Column) -> Column:
    """start with those of digests that are in a cell."""
    return F.aggregate(digests, start, lambda c, d: F.when(shifted(d, place["s"]).bitwiseAND(place["z"]) == place["w"], c.bitwiseXOR(d)).otherwise(c))


def sketch(digests: Column, cells: Column) -> Column:
    return F.transform(cells, lambda p: held(F.lit(0).cast("bigint"), digests, p))


def subtracted(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))


def peeled(difference: Column, cells: Column) -> Column:
    """The digests that a difference of two sketches holds; null on failure."""

    def once(state: Column, _: Column) -> Column:
        alone = F.array_distinct(F.filter(state["left"], lambda c: (c != 0) & (c.bitwiseAND(2**CHECK - 1) == check(c))))
        without = lambda p: F.struct(F.zip_with(state["left"], cells, lambda c, u: held(c, p, u)).alias("left"), F.concat(state["found"], p).alias("found"), (F.size(p) > 0).alias("on"))
        return F.when(state["on"], let(alone, without)).otherwise(state)

    start = F.struct(difference.alias("left"), F.array().cast("array<bigint>").alias("found"), F.lit(True).alias("on"))
    end = F.aggregate(cells, start, once)  # no more rounds than cells
    return let(end, lambda s: F.when(~F.exists(s["left"], lambda c: c != 0), s["found"]))


def differing(a: Column, b: Column) -> Column:
    """How many digests sets a and b don't share: the first sketch failed, so they are split by their first bits into parts
    of some PART digests, and each part has a sketch of its own, with more cells after a failure (in the end, with a
    chance of next to none, the sets themselves are compared)."""
    sizes = F.array(*[places(m) for m in SIZES])

    def part(x: Column, y: Column) -> Column:
        tried = lambda cells: F.size(peeled(subtracted(sketch(x, cells), sketch(y, cells)), cells))
        found = F.aggregate(sizes, F.lit(None).cast("int"), lambda n, cells: F.when(n.isNull(), tried(cells)).otherwise(n))
        return F.coalesce(found, F.size(F.array_except(x, y)) + F.size(F.array_except(y, x)))

    def split(x: Column, y: Column, shift: int, parts: Column, body) -> Column:
        own = lambda a, i: F.filter(a, lambda d: shifted(d, F.lit(shift)).bitwiseAND(parts - 1) == i)
        each = F.transform(F.sequence(F.lit(0).cast("bigint"), parts - 1), lambda i: let(F.struct(own(x, i).alias("x"), own(y, i).alias("y")), lambda p: body(p["x"], p["y"])))
        return F.aggregate(each, F.lit(0), lambda s, v: s + v)

    n = F.greatest(F.size(a) + F.size(b), F.lit(1)) / PART
    bits = F.least(F.greatest(F.ceil(F.log2(n)), F.lit(0)), F.lit(64 - SPLIT)).cast("int")
    # Two steps, so that a long text isn't read once for each of its parts.
    return let(bits, lambda z: split(a, b, SPLIT + 6, power(F.greatest(z - 6, F.lit(0))), lambda x, y: split(x, y, SPLIT, power(F.least(z, F.lit(6))), part)))


def likeness(a: Column, b: Column, fa: Column, fb: Column) -> Column:
    """Jaccard likeness of sets a and b with sketches fa and fb: of shared digests to all; 1 where both are empty."""
    d = F.coalesce(F.size(peeled(subtracted(fa, fb), places(BASE))), differing(a, b))
    n = F.size(a) + F.size(b)
    return F.when(n == 0, 1.0).otherwise(let(d, lambda x: (n - x) / (n + x)))


def written(cells: Column) -> Column:
    """A sketch as text: its cells in hex between bars, empty ones as nothing."""
    return F.array_join(F.transform(cells, lambda c: F.when(c == 0, "").otherwise(F.lower(F.hex(c)))), "|")


def changed_paragraphs(fingerprint: Column, other: Column) -> Column:
    """The digests in which the texts of two fingerprints differ; null where these are more than fingerprints can tell."""
    read = lambda f: F.transform(F.split(f, r"\|", -1), lambda c: F.when(c == "", F.lit(0).cast("bigint")).otherwise(F.conv(c, 16, -10).cast("bigint")))
    return peeled(subtracted(read(fingerprint), read(other)), places(BASE))


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with fingerprint: equal for equal texts; null and empty texts have one without any paragraph."""
    held = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "fingerprint"]).alias("_row")
    digests = docs.select(held, paragraph_digests(F.col(text)).alias("_d"))
    return digests.select("_row.*", written(sketch(F.col("_d"), places(BASE))).alias("fingerprint"))


def successors(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, k1, k2 (the row's keys), c (how often the row is there), p1, p2, n: keys and number of characters of the row before
    it, by doc_id (null first), then keys; before the first comes the last.

    Rows are dealt out by ranges, each of which is sorted on its own; the ends of ranges meet in a table of one row a range.
    """
    k1, k2 = row_keys(F.col("doc_id"), F.col(text))
    rows = docs.select("doc_id", k1, k2, F.length(or_empty(F.col(text))).alias("n")).groupBy("doc_id", "k1", "k2", "n").agg(F.count(F.lit(1)).alias("c"))
    dealt = stored(rows.repartitionByRange("doc_id", "k1", "k2").withColumn("_p", F.spark_partition_id()), "order")
    row = F.struct("doc_id", "k1", "k2", "n")
    ends = dealt.groupBy("_p").agg(F.max(row).alias("last"))
    before = F.lag("last").over(Window.orderBy("_p"))
    whole = F.max("last").over(Window.partitionBy())
    start = ends.select("_p", F.coalesce(before, whole).alias("start"))
    per = dealt.select("_p", "doc_id", "k1", "k2", "c", F.lag(row).over(Window.partitionBy("_p").orderBy(F.asc_nulls_first("doc_id"), "k1", "k2")).alias("before"))
    both = per.join(start, "_p").select("doc_id", "k1", "k2", "c", F.coalesce("before", "start").alias("b"))
    return both.select("doc_id", "k1", "k2", "c", F.col("b.k1").alias("p1"), F.col("b.k2").alias("p2"), F.col("b.n").alias("n"))


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    k1, k2 = row_keys(F.col("doc_id"), F.col("text"))
    # Each branch below reads the same columns of this side, so that its texts are shuffled once for all.
    keyed = docs.select(or_empty(F.col("text")).alias("text"), k1, k2)
    keys = ["k1", "k2"]
    rows = keyed.join(successors(docs).withColumnRenamed("n", "before"), keys)
    # Rows that are there several times stay once until the end.
    rows = rows.filter("c = 1").unionByName(rows.filter("c > 1").dropDuplicates(keys))
    rows = rows.withColumns({"n": F.length("text"), "digests": paragraph_digests(F.col("text"))})
    part = lambda n: F.substring(F.col("text"), F.lit(1), n)
    nexts = rows.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), part(F.floor(F.col("before") / 2).cast("int")).alias("tail"), F.col("digests").alias("following"), F.lit(1).cast("bigint").alias("times"))
    half = F.floor(F.col("n") / 2).cast("int")
    own = rows.select(*keys, "doc_id", "n", "c", part(F.col("n") - half).alias("head"), part(half).alias("again"), "digests")
    last = own.drop("c", "again").join(nexts, keys)
    # All but the last of rows that are there several times are followed by themselves.
    same = own.filter("c > 1").select(*keys, "doc_id", "n", "head", "digests", F.col("again").alias("tail"), F.col("digests").alias("following"), (F.col("c") - 1).alias("times"))
    both = last.unionByName(same).select("doc_id", "n", "digests", "following", "times", F.concat("head", "tail").alias("edited"))
    both = both.withColumn("changed", paragraph_digests(F.col("edited")))
    for name, of in (("f", "digests"), ("g", "changed"), ("h", "following")):
        both = both.withColumn(name, sketch(F.col(of), places(BASE)))
    others = F.array(F.struct(F.col("changed").alias("d"), F.col("g").alias("s")), F.struct(F.col("following").alias("d"), F.col("h").alias("s")))
    both = both.withColumn("near", F.transform(others, lambda x: likeness(F.col("digests"), x["d"], F.col("f"), x["s"])))
    found = both.select("doc_id", F.col("n").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), written(F.col("f")).alias("fingerprint"), written(F.col("g")).alias("edited_fingerprint"), F.col("near")[0].alias("near_edited"), F.col("near")[1].alias("near_next"), "times")
    out = found.select("*", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))).alias("_i"))
    return out.drop("times", "_i")

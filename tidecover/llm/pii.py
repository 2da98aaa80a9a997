"""PII: patterns propose spans, checksums confirm them, nearby context words adjust the score.  Native expressions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import or_empty, table


@dataclass(frozen=True)
class Kind:
    """A kind of personal data.

    pattern: possessive, so that long runs cost linear time.  quick: a text without it has no match.  base: score of a
    confirmed match before context; context words within WINDOW characters add BONUS.  always: kept whatever its score.
    """

    name: str
    pattern: str
    quick: str
    base: float
    context: str
    always: bool


WINDOW, BONUS, KEEP_FROM = 40, 0.3, 0.6
LEAST_DISTINCT = 10

# Kinds in the order in which spans are listed.  A match starts where the last one ended (\G) or where no
# longer run of the same characters begins, which is where the leftmost search would start it too.
KINDS = [
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.7, "mail|contact|write|kontakt|correo|courriel", True),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 0.6, "ip|host|server|address|serveur|adresse", True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9][\x20-]?[0-9]", 0.7, "card|visa|credit|karte|carte|tarjeta", True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.6, "phone|call|tel|mobile|fon|appel|llame", True),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}", 0.8, "iban|account|bank|konto|compte|cuenta", False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 0.4, "ssn|social security", False),
    Kind("secret", r"(?<![A-Za-z0-9_])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![A-Za-z0-9_])", r"[0-9A-Fa-f]{32}", 0.4, "key|token|secret|password|passwd|auth|credential", False),
]


def bare_digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def mod97(m: Column) -> Column:
    """The ISO 7064 remainder of an account number, letters read as 10 to 35; 1 for a right one."""
    bare = F.replace(m, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(bare, F.lit(5)), F.substr(bare, F.lit(1), F.lit(4)))
    step = lambda r, c: F.when(F.ascii(c) < 58, (r * 10 + F.ascii(c) - 48) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.regexp_extract_all(turned, F.lit("."), F.lit(0)), F.lit(0), step)


def confirmed(kind: str, m: Column) -> Column:
    """Whether the checksum or the rule of a kind holds for a match."""
    digits = bare_digits(m)
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^([0-9]?[0-9]?|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), F.call_function("luhn_check", digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return mod97(m) == 1
    if kind == "secret":  # of 16 digits a random key of 32 has 14 on average
        return (F.size(F.array_distinct(F.split(m, ""))) >= LEAST_DISTINCT) & m.rlike("[0-9]") & m.rlike("[A-Fa-f]")
    if kind == "ssn":
        return ~m.rlike("^(000|666|9)|-00-|-0000$")
    return F.lit(True)


def spans_of(text: Column, kind: Kind) -> Column:
    """array<struct<kind, start, end, score>> of one kind, in code points, end exclusive, by start.

    The text between matches (split) and the matches (extract) give all positions by a running sum.
    """
    none = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    hits = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    parts = F.split(text, kind.pattern, -1)
    sides = F.zip_with(parts, F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda a, b: F.struct(a.alias("left"), b.alias("right")))
    rows = F.filter(F.zip_with(sides, hits, lambda s, m: F.struct(F.length(s["left"]).alias("gap"), m.alias("m"), F.concat(F.right(s["left"], F.lit(WINDOW)), F.lit(" "), F.left(F.coalesce(s["right"], F.lit("")), F.lit(WINDOW))).alias("near"))), lambda x: x["m"].isNotNull())

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        score = F.lit(kind.base) + F.when(F.lower(x["near"]).rlike(rf"(?<![a-z])(?:{kind.context})"), BONUS).otherwise(0.0)
        span = F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), (start + F.length(x["m"])).alias("end"), score.alias("score"))
        good = confirmed(kind.name, x["m"]) & (F.lit(kind.always) | (score >= KEEP_FROM))
        return F.struct((start + F.length(x["m"])).alias("at"), F.when(good, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(rows, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(text.rlike(kind.quick), found).otherwise(none)


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds pii: array<struct<kind, start, end, score>> of every whole text, by kind (order of KINDS), then start.

    Kinds email, ip, card and phone are kept whenever their rule or checksum holds; iban, ssn and secret only from a score
    of KEEP_FROM on, which ssn and secret reach by context alone.  A null or empty text has no spans.  No shuffle, no other rows; other
    columns stay, but for one named pii.
    """
    t = or_empty(F.col(text))
    return docs.drop("pii").withColumn("pii", F.concat(*[spans_of(t, k) for k in KINDS]))


def masked(found: DataFrame, text: str = "text") -> DataFrame:
    """Texts with each span of pii replaced by its kind in angle brackets; of overlapping spans the first counts."""
    t = or_empty(F.col(text))
    ordered = F.array_sort(F.transform("pii", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    step = lambda a, s: F.when(s["start"] >= a["at"], F.struct(s["end"].alias("at"), F.concat(a["out"], F.substr(t, a["at"] + 1, s["start"] - a["at"]), F.lit("<"), s["kind"], F.lit(">")).alias("out"))).otherwise(a)
    done = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substr(t, a["at"] + 1, F.length(t))))
    return found.withColumn(text, done)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("pii", lambda s: s["kind"].isin("email", "ip", "card", "phone"))
    of = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [of(k) for k in ("email", "ip", "card", "phone")]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"), F.size("pii").cast("long").alias("n_spans"))

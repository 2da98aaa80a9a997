"""Conversation structure repair: the cheapest edits that make the turns' roles follow ``(s?(ua)+)?``.

The turns are aligned to each feasible length of the grammar's string by Wagner and Fischer's table.  Only cells from which
the incumbent cost can still be reached or met are filled (Ukkonen's band), lengths next to the number of usable turns come
first, and of alignments that cost the same the ASCII-least audit wins.  A conversation of more than PART turns is cut into
parts: each is aligned from every state of the grammar to every other, a fold over the parts' costs picks the states between
them, and parts are then edited on their own, so no task holds a whole conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, stored, table
from .positions import positions

PART = 64
WHITE = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
FAR = float("inf")
NEXT = {"E": "u", "S": "u", "A": "u", "U": "a"}  # what must come next, but for an s at the start
ROLE = {"u": "user", "a": "assistant"}

Kind = tuple[str, bool, bool]  # role initial, must be deleted, truncated


def aligned(kinds: tuple[Kind, ...], target: str, most: float, lead: bool) -> tuple[int, str] | None:
    """Cost and ASCII-least audit of turning kinds into target; None where that costs more than most.

    lead: insertions may come before the first turn.
    """
    n, m = len(kinds), len(target)
    usable, cut = [0], [0]
    for _, gone, truncated in kinds:
        usable.append(usable[-1] + (not gone))
        cut.append(cut[-1] + (truncated and not gone))
    base = DELETE * (n - usable[n]) + TRUNCATED * cut[n]

    def change(turns: int, places: int, truncated: int) -> int:
        d = turns - places
        return INSERT * -d if d < 0 else d * (DELETE - TRUNCATED) if d <= truncated else truncated * (DELETE - TRUNCATED) + (d - truncated) * DELETE

    def reach(i: int, j: int) -> bool:
        return base + change(usable[i], j, cut[i]) + change(usable[n] - usable[i], m - j, cut[n] - cut[i]) <= most

    rows: list[dict[int, float]] = [{}] * (n + 1)
    for i in range(n, -1, -1):
        # The bound is convex in j and least between as many places as turns to the left and as turns to the right.
        ends = sorted((min(usable[i], m), min(max(0, m - usable[n] + usable[i]), m)))
        some = next((j for j in range(ends[0], ends[1] + 1) if reach(i, j)), None)
        if some is None:
            return None
        low = high = some
        while low > 0 and reach(i, low - 1):
            low -= 1
        while high < m and reach(i, high + 1):
            high += 1
        row: dict[int, float] = {}
        below = rows[i + 1] if i < n else {}
        initial, gone, truncated = kinds[i] if i < n else ("", True, False)
        more = TRUNCATED * truncated
        for j in range(high, low - 1, -1):
            best = 0 if i == n and j == m else FAR
            if i < n:
                best = min(best, below.get(j, FAR) + DELETE)
                if not gone and j < m and (initial == target[j] or target[j] != "s"):
                    best = min(best, below.get(j + 1, FAR) + more + REROLE * (initial != target[j]))
            if j < m and target[j] != "s" and (i or lead):
                best = min(best, row.get(j + 1, FAR) + INSERT)
            row[j] = best
        rows[i] = row
    total = rows[0].get(0, FAR)
    if total > most or total == FAR:
        return None
    i = j = 0
    audit = []
    while i < n or j < m:
        here = rows[i][j]
        below = rows[i + 1] if i < n else {}
        if i < n and below.get(j, FAR) + DELETE == here:
            audit.append("D")
            i += 1
        elif j < m and target[j] != "s" and (i or lead) and rows[i].get(j + 1, FAR) + INSERT == here:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if kinds[i][0] == target[j] else "R")
            i, j = i + 1, j + 1
    return int(total), "".join(audit)


def targets(start: str, length: int) -> list[tuple[str, str]]:
    """The grammar's strings of a length from a state, with the state that each leads to."""
    first = NEXT[start]
    plain = "".join("ua"[(k + (first == "a")) % 2] for k in range(length))
    found = [plain, "s" + plain[:-1]] if start == "E" and length else [plain]
    return [(t, t[-1].upper() if t else start) for t in found]


@lru_cache(maxsize=1 << 16)
def cheapest(kinds: tuple[Kind, ...], start: str, whole: bool, lead: bool) -> dict[str, tuple[int, str]]:
    """By the state it ends in (whole: by "" for all accepting ones), the least (cost, audit) of aligning kinds."""
    usable = sum(not gone for _, gone, _ in kinds)
    found: dict[str, tuple[int, str]] = {}
    base = DELETE * (len(kinds) - usable)

    def tried(length: int, least: int) -> bool:
        """Were there targets of this length that may cost no more than what is found?  least: no such one costs less."""
        some = False
        for target, end in targets(start, length) if length >= 0 else []:
            name = "" if whole and end in "EA" else end
            most = found.get(name, (FAR, ""))[0]
            if least <= most and not (whole and name):
                some = True
                got = aligned(kinds, target, most, lead)
                if got and (name not in found or got < found[name]):
                    found[name] = got
        return some

    for length in () if whole else (0, 1):  # the only ones that end where nothing, or an s alone, is left
        tried(length, 0)
    for far in count():
        fewer, more = tried(usable - far, base + (DELETE - TRUNCATED) * far), far > 0 and tried(usable + far, base + INSERT * far)
        if far > 1 and not fewer and not more:
            return found


def edited(rows: list[tuple[str, str]], audit: str, state: str) -> tuple[list[dict], str]:
    """The rows (role, text) with the audit's edits; the state after them."""
    out, at = [], 0
    for edit in audit:
        role, text = rows[at] if edit != "I" else ("", "")
        at += edit != "I"
        if edit in "RI":
            role = ROLE[NEXT[state]]
        if edit != "D":
            state = role[0].upper()
        out.append({"edit": edit, "role": role, "text": text})
    return out, state


def runs(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """The rows of each run of equal leading columns."""
    group: list[tuple] = []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if group and group[0][:keys] != row[:keys]:
                yield group
                group = []
            group.append(row)
    if group:
        yield group


def counted(rows: list[tuple]) -> tuple[dict, tuple[Kind, ...]]:
    """Counts of a part's rows (turn, role, text, seen in an earlier part) and what each row is to the alignment."""
    seen: set[tuple[str, str]] = set()
    faults, kinds = {"blank": 0, "duplicate": 0, "truncated": 0}, []
    for _, role, text, earlier in rows:
        core = text.rstrip(WHITE)
        fault = "blank" if not core else "duplicate" if earlier or (role, text) in seen else "truncated" if core[-1] not in ".!?" else ""
        seen.add((role, text))
        if fault:
            faults[fault] += 1
        kinds.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
    turns = [t for t, *_ in rows if t is not None]
    first = [k[0] for k in kinds]
    wrong = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
    return faults | {"illegal": wrong, "n_turns": len(set(turns)), "first_turn": min(turns, default=None), "last_turn": max(turns, default=None)}, tuple(kinds)


COUNTS = "blank bigint, duplicate bigint, truncated bigint, illegal bigint, n_turns bigint, first_turn bigint, last_turn bigint"
EDITS = "turns array<struct<edit: string, role: string, text: string>>"


def named(conv: T.StructField, rest: str) -> T.StructType:
    return T.StructType([T.StructField("conv_id", conv.dataType), *T.StructType.fromDDL(rest)])


def batch_of(rows: list[dict], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    return pa.RecordBatch.from_pylist(rows, to_arrow_schema(schema))


def in_batches(rows: Iterable[dict], schema: T.StructType) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for r in rows:
        held.append(r)
        if len(held) == 512:
            yield batch_of(held, schema)
            held = []
    if held:
        yield batch_of(held, schema)


def short_repairs(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Whole conversations of PART turns at most: rows (conv_id, turn, role, text)."""

    def run(batches):
        def each():
            for group in runs(batches, 1):
                own = [(t, r, x, False) for _, t, r, x in group]
                counts, kinds = counted(own)
                cost, audit = cheapest(kinds, "E", True, True)[""]
                yield {"conv_id": group[0][0], "part": 0, "parts": 1, "cost": cost, "audit": audit, "turns": edited([x[1:3] for x in own], audit, "E")[0]} | counts

        yield from in_batches(each(), schema)

    df = rows.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    return df.mapInArrow(run, schema)


Options = dict[str, dict[str, tuple[int, str]]]


def chosen(parts: list[Options]) -> list[tuple[str, int, str]]:
    """The state before, cost and audit of each part on the cheapest way through all, of these the ASCII-least.

    A part never begins with an insertion (these come last in the part before), so its audit and the first letter of the
    next part's decide between ways that cost the same.
    """

    def ways(k: int, state: str) -> list[tuple[int, str, str]]:
        return [(cost, audit, end) for end, (cost, audit) in parts[k][state].items()]

    left: list[dict[str, float]] = [{}] * len(parts) + [{"E": 0, "A": 0, "S": FAR, "U": FAR}]
    for k in range(len(parts) - 1, -1, -1):
        left[k] = {s: min((c + left[k + 1][e] for c, _, e in ways(k, s)), default=FAR) for s in ("ESUA" if k else "E")}

    def best(k: int, state: str) -> list[tuple[int, str, str]]:
        return [w for w in ways(k, state) if w[0] + left[k + 1][w[2]] == left[k][state]]

    def letter(k: int, state: str) -> str:
        return min(w[1][0] for w in best(k, state)) if k < len(parts) else ""

    state, out = "E", []
    for k in range(len(parts)):
        cost, audit, end = min(best(k, state), key=lambda w: w[1] + letter(k + 1, w[2]))
        out.append((state, cost, audit))
        state = end
    return out


def long_repairs(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Conversations of more than PART turns, part by part."""
    conv = schema["conv_id"]
    placed = positions(rows, ["conv_id"], F.col("turn"), [F.asc_nulls_first("turn"), F.col("role"), F.col("text")], PART)
    placed = placed.withColumn("part", ((F.col("at") - 1) / PART).cast("bigint"))
    same = [F.xxhash64("role", "text").alias("h1"), F.xxhash64("text", "role", F.lit(1)).alias("h2")]
    keyed = stored(placed.select("conv_id", "part", "at", "turn", "role", "text", *same), "placed")
    first = keyed.groupBy(F.col("conv_id").alias("_c"), "h1", "h2").agg(F.min("part").alias("_p"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    again = keyed.join(first.withColumnsRenamed({"h1": "_h1", "h2": "_h2"}), F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")), "left")
    flagged = again.select("conv_id", "part", "at", "turn", "role", "text", (F.coalesce("_p", "part") < F.col("part")).alias("earlier"))
    own = "part bigint, first string, last string, " + COUNTS + ", rows array<struct<role: string, text: string>>, options map<string, map<string, struct<cost: bigint, audit: string>>>"
    parted = named(conv, own)

    def costs(batches):
        def each():
            for group in runs(batches, 2):
                counts, kinds = counted([g[3:] for g in group])
                start = group[0][1] == 0
                options = {s: cheapest(kinds, s, False, start) for s in ("E" if start else "ESAU")}
                packed = [(s, [(e, {"cost": c, "audit": a}) for e, (c, a) in o.items()]) for s, o in options.items()]
                yield {"conv_id": group[0][0], "part": group[0][1], "first": kinds[0][0], "last": kinds[-1][0], "rows": [{"role": g[4], "text": g[5]} for g in group], "options": packed} | counts

        yield from in_batches(each(), parted)

    parts = stored(flagged.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "at").mapInArrow(costs, parted), "parts")
    ways = named(conv, "part bigint, state string, cost bigint, audit string, wrong bigint, joined bigint, parts bigint")

    def fold(batches):
        def each():
            for group in runs(batches, 1):
                options = [{s: {e: (x["cost"], x["audit"]) for e, x in o} for s, o in g[6]} for g in group]
                for k, (state, cost, audit) in enumerate(chosen(options)):
                    before = group[k - 1] if k else None
                    wrong = before is not None and before[3] + group[k][2] not in ("su", "ua", "au")
                    joined = before is not None and before[5] is not None and before[5] == group[k][4]
                    yield {"conv_id": group[k][0], "part": group[k][1], "state": state, "cost": cost, "audit": audit, "wrong": int(wrong), "joined": int(joined), "parts": len(group)}

        yield from in_batches(each(), ways)

    narrow = parts.select("conv_id", "part", "first", "last", "first_turn", "last_turn", "options")
    picked = narrow.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(fold, ways).withColumnsRenamed({"conv_id": "_c", "part": "_p"})
    both = parts.join(picked, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("part") == F.col("_p")))

    def apply(batches):
        def each():
            for b in batches:
                for r in b.to_pylist():
                    turns = edited([(x["role"], x["text"]) for x in r.pop("rows")], r["audit"], r.pop("state"))[0]
                    yield r | {"turns": turns}

        yield from in_batches(each(), schema)

    counts = [F.col(c) for c in ("blank", "duplicate", "truncated", "first_turn", "last_turn")]
    ready = both.select("conv_id", "part", "parts", "cost", "audit", "state", "rows", *counts, (F.col("illegal") + F.col("wrong")).alias("illegal"), (F.col("n_turns") - F.col("joined")).alias("n_turns"))
    out = stored(ready.mapInArrow(apply, schema), "long")
    discard(keyed, parts)
    return out


def repair(turns: DataFrame) -> DataFrame:
    """The repaired conversations of turns (conv_id, turn, role, text), in parts of at most PART turns.

    conv_id, part, parts; blank, duplicate, truncated (each turn's first fault), illegal (pairs of neighbours whose role
    initials don't alternate), n_turns (different turn numbers), first_turn, last_turn; cost, audit (K, R, D, I) and turns
    (edit, role, text; those with D are the deleted ones).  A pair of turns that two parts part counts with the second.
    Turns are taken in the order of turn (null first), role, text; a null role or text is one space, null conv_ids are one
    conversation, an empty role has no initial and is never kept.  Repeated rows are duplicates of each other.  Other
    columns are left out; an empty table gives an empty one.
    """
    own = turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    sizes = own.groupBy(F.col("conv_id").alias("_c")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > PART)
    large = stored(sizes.select("_c", F.lit(True).alias("_large")), "large")
    schema = named(own.schema["conv_id"], f"part bigint, parts bigint, {COUNTS}, cost bigint, audit string, {EDITS}")
    marked = own.join(large, F.col("conv_id").eqNullSafe(F.col("_c")), "left")
    short = short_repairs(marked.filter("_large is null"), schema)
    return short if large.isEmpty() else short.unionByName(long_repairs(marked.filter("_large").select(own.columns), schema))


def kept_lines(turns: Column) -> Column:
    """``role:text`` of the turns that are left."""
    return F.transform(F.filter(turns, lambda x: x["edit"] != "D"), lambda x: F.concat(x["role"], F.lit(":"), x["text"]))


def whole_reports(fixed: DataFrame) -> DataFrame:
    """One row of counts, audit and SHA-256 of the repaired text for each conversation of repair().

    Conversations of several parts are read part by part in order, as their hash is one stream.
    """
    counts = ["blank", "duplicate", "truncated", "illegal", "n_turns", "first_turn", "last_turn", "cost", "audit"]
    digest = F.sha2(F.array_join(kept_lines(F.col("turns")), "\n"), 256).alias("repaired_sha256")
    single = fixed.filter("parts = 1").select("conv_id", *counts, digest)
    several = fixed.filter("parts > 1").select("conv_id", *counts, kept_lines(F.col("turns")).alias("lines"), "part").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    schema = single.schema

    def run(batches):
        key, told = None, None

        def done():
            return {**told, "audit": "".join(told["audit"]), "repaired_sha256": told["repaired_sha256"].hexdigest()}

        for b in batches:
            out = []
            for r in b.to_pylist():
                if told is None or key != r["conv_id"]:
                    if told is not None:
                        out.append(done())
                    key, told, begun = r["conv_id"], dict.fromkeys(schema.names, 0), False
                    told |= {"conv_id": key, "audit": [], "first_turn": None, "last_turn": None, "repaired_sha256": hashlib.sha256()}
                for c in ("blank", "duplicate", "truncated", "illegal", "n_turns", "cost"):
                    told[c] += r[c]
                told["audit"].append(r["audit"])
                told["first_turn"] = r["first_turn"] if told["first_turn"] is None else told["first_turn"]
                told["last_turn"] = told["last_turn"] if r["last_turn"] is None else r["last_turn"]
                for line in r["lines"]:
                    told["repaired_sha256"].update((("\n" if begun else "") + line).encode())
                    begun = True
            if out:
                yield batch_of(out, schema)
        if told is not None:
            yield batch_of([done()], schema)

    return single.unionByName(several.mapInArrow(run, schema))


def damaged(turns: DataFrame) -> DataFrame:
    """turns with the faults that crc32(conv_id:turn) % 20 names: 0 dropped, 1 emptied, 2 without ``.!?``, 3 repeated, 4 user."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    own = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("_k")).filter("_k <> 0")
    said = F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("_k") == 3, 2).otherwise(1)))
    return own.select("conv_id", "turn", F.when(F.col("_k") == 4, "user").otherwise(F.col("role")).alias("role"), said.alias("text"), times.alias("_i")).drop("_i")


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = whole_reports(stored(repair(damaged(turns)), "repaired")).withColumnRenamed("conv_id", "_c")
    every = turns.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("_c")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    gaps = zero(F.col("last_turn") - F.col("first_turn") + 1 - F.col("n_turns")).alias("gaps")
    counts = [zero(F.col(c)).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", gaps, *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))

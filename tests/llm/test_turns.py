"""Conversation repair and the prefix trie against plain versions, and the fingerprints against sets of paragraphs."""

import random
import re
from collections import Counter, defaultdict
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecover.llm import repair, sketches, trie
from tidecover.llm.common import row_keys

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
WHITE = " \t\n\x0b\x0c\r"


def first_null(x):
    return (x is not None, x or 0)


def made_up(rng, n=40):
    """Conversations with faults of all kinds, null columns, ties, repeated rows, one of more turns than a part holds."""
    rows = []
    for c in range(n):
        for t in range(rng.choice([1, 2, 3, 4, 7, 9]) if c != 7 else 400):
            role = rng.choice(["user", "assistant", "system", "tool"]) if rng.random() < 0.2 else ("user", "assistant")[t % 2]
            text = rng.choice(["Same.", "one", " \t", "", "é ends! ", "two. "]) if rng.random() < 0.3 else f"text {rng.randint(0, 10**6)}{rng.choice(['.', '?', '!', '', ' '])}"
            rows.append((c, t if rng.random() > 0.03 else None, role if rng.random() > 0.02 else None, text if rng.random() > 0.02 else None))
            if rng.random() < 0.04:
                rows.append(rows[-1])
            if rng.random() < 0.04:
                rows.append((c, t, "user", "tied."))
    return rows + [(None, 0, "user", "a."), (None, 1, "assistant", "b."), (1000, None, None, None), (1001, 0, "", ".")]


def plain_audit(kinds):
    """(cost, audit) by the grammar's states: the least over all edits, with no table of lengths."""

    def inserted(found):
        for _ in range(4):
            for s, (c, a) in list(found.items()):
                to, now = ("U" if s != "U" else "A"), (c + 3, a + "I")
                found[to] = min(found.get(to, now), now)
        return found

    found = inserted({"E": (0, "")})
    for initial, gone, truncated in kinds:
        new: dict = {}
        for s, (c, a) in found.items():
            to = "U" if s != "U" else "A"
            ways = [(s, (c + 4, a + "D"))]
            if not gone:
                ways.append((to, (c + 3 * truncated, a + "K") if initial == to.lower() else (c + 3 * truncated + 3, a + "R")))
                if initial == "s" and s == "E":
                    ways.append(("S", (c + 3 * truncated, a + "K")))
            for t, v in ways:
                new[t] = min(new.get(t, v), v)
        found = inserted(new)
    return min(found[s] for s in "EA" if s in found)


def plain_repair(rows):
    """By conv_id: counts, cost, audit and hash of rows as they are."""
    own = defaultdict(list)
    for c, t, r, x in rows:
        own[c].append((t, " " if r is None else r, " " if x is None else x))
    out = {}
    for c, turns in own.items():
        turns.sort(key=lambda x: (first_null(x[0]), x[1].encode(), x[2].encode()))
        seen, kinds, faults = set(), [], []
        for _, r, x in turns:
            core = x.strip(WHITE)
            faults.append("blank" if not core else "duplicate" if (r, x) in seen else "truncated" if core[-1] not in ".!?" else "")
            seen.add((r, x))
            kinds.append((r[:1], faults[-1] in ("blank", "duplicate"), faults[-1] == "truncated"))
        cost, audit = plain_audit(kinds)
        lines, at = [], 0
        for e in audit:
            r, x = turns[at][1:] if e != "I" else ("", "")
            at += e != "I"
            if e in "RI":
                r = "assistant" if lines and lines[-1][0] == "u" else "user"
            if e != "D":
                lines.append(f"{r}:{x}")
        known = [t for t, *_ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:]))
        out[c] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, sha256("\n".join(lines).encode()).hexdigest())
    return out


def plain_damage(rows):
    show = lambda x: " " if x is None else str(x)
    out = []
    for c, t, r, x in rows:
        k, r, x = crc32(f"{show(c)}:{show(t)}".encode()) % 20, show(r), show(x)
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        out += [(c, t, "user" if k == 4 else r, x)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def reports(df):
    return {r.conv_id: tuple(r[c] for c in REPORT) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_repair_against_states(spark, seed):
    rows = made_up(random.Random(seed))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("edit", F.lit("x")).withColumn("part", F.lit("y"))
    fixed = repair.repair(df)
    parts = fixed.select("conv_id", "part", F.size("turns").alias("n"), F.length("audit").alias("m")).collect()
    assert all(p.n == p.m <= 3 * repair.PART for p in parts) and max(p.part for p in parts) >= 5
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("n_turns"), F.lit(0)).alias("gaps")
    got = reports(repair.whole_reports(fixed).withColumn("gaps", gaps))
    assert got == plain_repair(rows)


def test_repair_query(spark, tmp_path):
    rows = made_up(random.Random(3), 60)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    want = {c: (0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest()) for c, *_ in rows} | plain_repair(plain_damage(rows))
    assert reports(repair.op11_structure_repair(spark, str(tmp_path))) == want


def test_repair_of_nothing(spark):
    assert repair.repair(spark.createDataFrame([], SCHEMA)).count() == 0
    long = "word " * 200_000
    got = repair.repair(spark.createDataFrame([(1, 0, "user", long + "."), (1, 1, "assistant", long + ".")], SCHEMA)).first()
    assert got.audit == "KK" and got.turns[1].text == long + "."


def plain_trie(convs):
    """convs: conv_id -> list of (role, text)."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for p, ids in members.items():
        under = [q for q in members if q[: len(p)] == p]
        children = [q for q in under if len(q) == len(p) + 1]
        leaves = [q for q in under if not any(r[: len(q)] == q and len(r) > len(q) for r in under)]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in under if q)
        last = ",".join(map(str, sorted(c for c in ids if len(convs[c]) == len(p))))
        out.append((min(ids), len(p), min(members[p[:-1]]) if p else None, len(ids), len(children), len(leaves), saved, sha256(last.encode()).hexdigest()))
    return sorted(out, key=str)


def shared_starts(rng, n=90):
    rows = []
    for c in range(n):
        size = rng.choice([1, 2, 3, 5, 12]) if c != 11 else 300
        for t in range(size):
            text = rng.choice(["a", "bb", "é", ""]) if t < 3 or rng.random() < 0.3 else f"t{rng.randint(0, 3)}"
            rows.append((c * 3 if c % 7 else c, t if t else None, rng.choice(["user", None]) if t % 2 else "system", text if rng.random() < 0.9 else None))
    rows += [(1000 + 5 * i + j, t, "user", "same") for i in range(5) for j in range(5) for t in range(4)]
    return list({(r[0], r[1]): r for r in rows}.values())


def plain_rebuilt(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        own[c].append((t, r or "", x or ""))
    own = {c: [(r, x) for _, r, x in sorted(v, key=lambda y: first_null(y[0]))] for c, v in own.items()}
    h = {c: crc32(str(c).encode()) % 9 for c in own}
    return {c: own.get(c - c % 5, [])[: h[c]] + own[c][h[c] :] for c in own}


@pytest.mark.parametrize("shard", [trie.SHARD, 40, 3])
def test_trie_against_all_prefixes(spark, tmp_path, monkeypatch, shard):
    monkeypatch.setattr(trie, "SHARD", shard)
    monkeypatch.setattr(trie, "BLOCK", 4 if shard < 100 else 1024)
    rows = shared_starts(random.Random(4))
    df = spark.createDataFrame(rows + [(None, 0, "user", "x")], SCHEMA).repartition(6).withColumn("k1", F.lit("x")).withColumn("depth", F.lit(1))
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    got = sorted((tuple(r[c] for c in names) for r in trie.op12_prefix_trie(spark, str(tmp_path)).collect()), key=str)
    assert got == plain_trie(plain_rebuilt(rows))


def test_trie_of_ties_and_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert trie.trie(*trie.rebuilt(none)).count() == 0
    tied = spark.createDataFrame([(5, 0, "user", "x" * 10**6), (5, 0, "user", "b"), (5, 0, "assistant", "c"), (5, 0, "user", "b")], SCHEMA)
    runs = [sorted(map(str, trie.trie(*trie.rebuilt(tied.repartition(n))).collect())) for n in (1, 4)]
    assert runs[0] == runs[1] and len(runs[0]) == 5


def test_slots_are_minimal_and_verified():
    rng = random.Random(5)
    keys = [(rng.getrandbits(63), rng.getrandbits(63) - 2**62) for _ in range(5000)]
    k1, k2 = (np.array(x, np.int64) for x in zip(*keys))
    slots = trie.Slots(k1, k2)
    assert sorted(slots.at(k1, k2)) == list(range(5000))
    assert (slots.at(k2, k1) == -1).all() and len(trie.Slots(k1[:0], k2[:0]).at(k1, k2)) == 5000


def plain_paragraphs(text):
    words = [re.findall("[^ ]{1,64} *", line) for line in (text or "").split("\n")]
    return Counter("".join(w[i : i + sketches.WORDS]) for w in words for i in range(0, len(w), sketches.WORDS))


def alike(a, b):
    a, b = plain_paragraphs(a), plain_paragraphs(b)
    every = sum((a | b).values())
    return sum((a & b).values()) / every if every else 1.0


def test_fingerprints_against_sets(spark, tmp_path):
    rng = random.Random(6)
    say = lambda n: " ".join(f"w{rng.randint(0, 400)}" for _ in range(n))
    texts = ["\n".join(say(rng.randint(1, 60)) for _ in range(rng.choice([1, 3, 9, 40]))) for _ in range(50)]
    texts += ["", None, texts[3], texts[3], "x", "é😀" * 300, "same line\n" * 500, "\n".join(say(5) for _ in range(6000)), "z" * 100_000, texts[4] + "\nmore."]
    rows = [(i * 3 if i != 8 else None, t) for i, t in enumerate(texts)] + [(9, texts[3]), (9, texts[3]), (9, "another text")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7).withColumn("k1", F.lit("x")).withColumn("n", F.lit(1))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = sketches.op13_document_fingerprints(spark, str(tmp_path)).collect()
    k1, k2 = row_keys(F.col("doc_id"), F.col("text"))
    order = {(r.doc_id, r.text): (r.k1, r.k2) for r in df.select("doc_id", "text", k1, k2).collect()}
    rows.sort(key=lambda r: (first_null(r[0]), order[r]))
    want = []
    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1]):
        t, u = t or "", u or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + u[:half]
        want.append((i, len(t), sha256(edited.encode()).hexdigest(), alike(t, edited), alike(t, u)))
    key = lambda r: (first_null(r[0]), r[1:3], r[4])
    have = sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got), key=key)
    for a, b in zip(have, sorted(want, key=key), strict=True):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:])
    assert len({r.fingerprint for r in got if r.doc_id in (156, 159)}) == 1


def test_fingerprints_tell_small_changes(spark):
    rng = random.Random(7)
    lines = [f"line {i} " + " ".join(str(rng.random()) for _ in range(9)) for i in range(300)]
    other = [*lines[:100], "new", *lines[101:250]]
    df = sketches.fingerprints(spark.createDataFrame([(1, "\n".join(lines[:252])), (2, "\n".join(other))], "id int, text string"))
    both = df.filter("id = 1").select(F.col("fingerprint").alias("a")).crossJoin(df.filter("id = 2").select(F.col("fingerprint").alias("b")))
    assert both.select(F.size(sketches.changed_paragraphs(F.col("a"), F.col("b")))).first()[0] == 4
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert sketches.fingerprints(empty).count() == 0

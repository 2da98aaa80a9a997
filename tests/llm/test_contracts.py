"""Column names that clash, ids of other types, very long texts, and plain versions of chunks, sharding and the pipeline."""

import random
import time
from collections import Counter
from hashlib import blake2b

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.llm.test_llm import classes, plain_hits, plain_lines, plain_quality, prose, shingle_set
from tidecover.llm import chunks, decontam, jaccard, lines, pii, quality, repeats, sharding
from tidecover.llm.common import fresh_path, stored

CLASHING = ["k1", "k2", "_k1", "_k2", "n_words", "kept", "removed", "pii", "batch", "_w", "_t", "_key", "_row", "_rest", "n", "node", "label", "t", "id", "N_Bytes", "_n", "line"]


@pytest.fixture(scope="module")
def wide(spark):
    rng = random.Random(21)
    passage = prose(rng, 120)
    texts = [prose(rng, 60) + "\n" + passage if i % 3 else prose(rng, 80) for i in range(12)]
    texts += [texts[1], None, "", prose(rng, 30_000), "word " * 100_000, "é" * 5000]
    rows = [(f"d{i:03}" if i != 5 else None, t, "en", *[f"{c}{i}" for c in CLASHING]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id string, text string, lang string, " + ", ".join(f"`{c}` string" for c in CLASHING)).repartition(4)


OPERATORS = {
    "pii": (pii.find_pii, ["pii"]),
    "chunks": (chunks.repeated_spans, ["n_bytes", "n_chunks", "n_dup_chunks", "removed"]),
    "quality": (lambda d: quality.quality_verdict(d, with_text=True), quality.MADE),
    "lines": (lines.repeated_lines, ["n_lines", "removed"]),
    "decontamination": (lambda d: decontam.contamination(d, d.sparkSession.createDataFrame([(1, prose(random.Random(3), 12))], "item_id bigint, text string")), ["n_words", "hit_at", "hit_items", "contaminated"]),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_clashing_columns_stay(wide, name):
    operator, made = OPERATORS[name]
    own = [c for c in wide.columns if c.lower() not in made]
    out = stored(operator(wide), "out")
    assert out.columns == [*own, *made]
    assert sorted(map(str, out.select(own).collect())) == sorted(map(str, wide.select(own).collect()))


def test_joins_with_text_ids(wide):
    n = wide.count()
    assert jaccard.near_duplicates(wide).count() == n and repeats.without_repeats(wide).count() == n
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(wide).collect()}
    assert got["d012"] == "d001" and got["d000"] == "d000" and got["d013"] == "d013"


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES[:-1]])
def test_stages_keep_all_columns(spark, wide, name):
    bench = "/root/testdata/sf0.001"
    out = stored(dict(P.STAGES)[name](spark, wide, bench), "stage")
    assert out.columns == wide.columns
    rows = Counter(map(str, wide.drop("text").collect()))
    assert not Counter(map(str, out.drop("text").collect())) - rows


def test_chunks_against_a_plain_version(spark):
    rng = random.Random(22)
    passage = prose(rng, 70)
    texts = [prose(rng, rng.randint(5, 90)) for _ in range(30)]
    texts = [t if i % 3 else f"{t[:40]} {passage} {t[40:]} {passage}" for i, t in enumerate(texts)]
    texts += [texts[0], "", None, "ü" * 3000, texts[3] + "€" + texts[6]]
    holders: dict = {}
    parts = []
    for i, t in enumerate(texts):
        data, a, own = (t or "").encode(), 0, []
        for b in chunks.cuts(data) if data else []:
            own.append((a, b, blake2b(data[a:b], digest_size=16).digest()))
            a = b
        parts.append(own)
        for a, b, d in own:
            holders.setdefault(d, []).append((i, a))
    want = {}
    for i, own in enumerate(parts):
        dup = [(a, b) for a, b, d in own if len(holders[d]) > 1 and min(holders[d]) != (i, a)]
        runs: list[list[int]] = []
        for a, b in dup:
            if runs and runs[-1][1] == a:
                runs[-1][1] = b
            else:
                runs.append([a, b])
        want[i] = (len(own), len(dup), [tuple(r) for r in runs if r[1] - r[0] >= chunks.MIN_RUN])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = chunks.repeated_spans(df)
    assert {r.doc_id: (r.n_chunks, r.n_dup_chunks, [tuple(s) for s in r.removed]) for r in found.collect()} == want
    left = {r.doc_id: r.text for r in chunks.without_spans(found).collect()}
    assert all("�" not in t for t in left.values())
    for i, t in enumerate(texts):
        data, at, out = (t or "").encode(), 0, b""
        for a, b in want[i][2]:
            out, at = out + data[at:a], b
        assert len(left[i].encode()) - len(out + data[at:]) in range(4 * 2 * len(want[i][2]) + 1)


def store_of(spark, n=6):
    store = sharding.Store(spark, fresh_path(spark, "store"))
    df = spark.range(600).select("id", F.repeat(F.lit("x"), F.lit(50)).alias("text"), (F.col("id") % n).alias("b"))
    return store, df


def names(store, folder):
    return {s.getPath().getName() for s in store.fs.listStatus(store.path(folder) if folder else store.path())}


def test_what_lost_writers_leave_goes(spark, monkeypatch):
    store, df = store_of(spark)
    store.append(df, "b")
    monkeypatch.setattr(store, "commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))  # lost between write and commit
    for lost in (store.compact, lambda: store.append(df, "b")):
        with pytest.raises(KeyboardInterrupt):
            lost()
    monkeypatch.undo()
    df.write.parquet(f"{store.root}/arriving-lost")
    df.write.parquet(f"{store.root}/manifest/_lost")
    rows = sorted(r.id for r in spark.read.parquet(*[f"{store.root}/runs/{r}" for r in store.runs()]).collect())
    store.sweep()
    assert len(names(store, "runs")) > len(store.runs()) and "arriving-lost" in names(store, "")  # too young to be lost
    store.orphan_s = 0
    store.compact()
    assert {r for v in (store.version() - 1, store.version()) for r in store.runs(v)} == names(store, "runs")
    assert names(store, "") == {"runs", "manifest"} and not any(n.startswith("_lost") for n in names(store, "manifest"))
    assert sorted(r.id for r in spark.read.parquet(*[f"{store.root}/runs/{r}" for r in store.runs()]).collect()) == rows


def test_of_two_publishers_one_fails(spark, monkeypatch):
    store, df = store_of(spark)
    store.append(df, "b")
    other = store.manifest()
    late = store.claims  # the other publishes between this one's check and its rename

    def slow(v):
        found = late(v)
        if not store.fs.exists(store.path("manifest", f"v{v:08d}")):
            other.coalesce(1).write.parquet(f"{store.root}/manifest/v{v:08d}")
        return found

    base = store.version()
    attempt = store.claim(base + 1)
    monkeypatch.setattr(store, "claim", lambda v: attempt)
    monkeypatch.setattr(store, "claims", slow)
    with pytest.raises(RuntimeError):
        store.commit(other, base)
    assert not any(n.startswith("_") and not n.startswith("_SUCCESS") for n in names(store, f"manifest/v{base + 1:08d}"))


def test_repeats_of_rows_with_one_id(spark):
    rng = random.Random(31)
    passage = prose(rng, 100)
    for same in (7, None, "x"):
        kind = "string" if same == "x" else "bigint"
        df = spark.createDataFrame([(same, f"{prose(rng, 30)} {passage} {prose(rng, 30)}") for _ in range(3)] + [(None, "other"), (None, "other")], f"doc_id {kind}, text string")
        gone = [sum(s.end - s.start for s in r.removed) for r in chunks.repeated_spans(df).collect()]
        assert sorted(g > 0.6 * len(passage) for g in gone) == [False, False, False, True, True]


def test_benchmark_windows_of_many_lengths(spark):
    rng = random.Random(32)
    items = [(i, " ".join(f"w{rng.randint(0, 30)}" for _ in range(n))) for i, n in enumerate([1, 2, 3, 5, 7, 9, 10, 11, 12])]
    texts = [" ".join(f"w{rng.randint(0, 30)}" for _ in range(rng.randint(0, 60))) for _ in range(40)]
    texts += [f"a {t} b {t}" for _, t in items] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    known = [(i, w[j : j + 10]) for i, t in items for w in [t.split()] for j in range(max(1, len(w) - 9))]
    for limit in (1_000_000, 0):
        out = decontam.contamination(docs, bench, broadcast_windows=limit)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("generate") + plan.count("Generate") <= 3
        for r in out.collect():
            w = (r.text or "").split()
            hits = [(j, i, len(k)) for j in range(len(w)) for i, k in known if w[j : j + len(k)] == k]
            assert r.hit_at == sorted({x for j, _, n in hits for x in range(j, j + n)}) and r.hit_items == sorted({i for _, i, _ in hits})
    assert decontam.contamination(docs, bench, broadcast_bytes=0).filter("contaminated").count() == decontam.contamination(docs, bench).filter("contaminated").count()


def test_quality_without_languages(spark):
    df = spark.createDataFrame([(1, prose(random.Random(33), 80))], "doc_id bigint, text string")
    assert quality.quality_verdict(df).columns[:1] == ["doc_id"] and quality.quality_verdict(df).first().n_words == 80


def test_a_lost_writer_is_replaced(spark):
    store, df = store_of(spark)
    store.append(df, "b")
    store.fs.createNewFile(store.path("manifest", "_claim00000002-0"))  # its writer was lost before the rename
    store.spark.range(3).write.parquet(f"{store.root}/manifest/_lost")  # what it had written aside
    with pytest.raises(RuntimeError):
        store.append(df, "b")
    assert store.version() == 1 and store.manifest().agg(F.sum("n_rows")).first()[0] == 600
    store.lease_s = 0
    time.sleep(1.1)
    assert store.append(df, "b") == 2 and store.manifest().agg(F.sum("n_rows")).first()[0] == 1200


def test_readers_of_the_version_before_find_their_runs(spark):
    store, df = store_of(spark)
    store.append(df, "b")
    first = store.runs()
    store.compact()
    assert store.version() == 2 and len(store.runs()) == 1
    assert spark.read.parquet(*[f"{store.root}/runs/{r}" for r in first]).count() == 600
    store.append(df, "b")
    store.compact()
    assert store.version() == 4 and not any(store.fs.exists(store.path("runs", r)) for r in first)
    back = spark.read.parquet(*[f"{store.root}/runs/{r}" for r in store.runs()])
    assert Counter(r.id for r in back.collect()) == Counter({i: 2 for i in range(600)})


def test_a_tiny_arrival_leaves_the_tiers(spark, monkeypatch):
    monkeypatch.setattr(sharding, "UNIT_BYTES", 500)
    store, df = store_of(spark, 2)
    store.append(df, "b")
    tiers = {r.run: r.tier for r in store.manifest().collect()}
    store.append(df.limit(1), "b")
    assert {r.run: r.tier for r in store.manifest().collect() if r.run in tiers} == tiers


def test_pipeline_against_plain_stages(spark):
    """Each stage on what the one before kept, against its plain version; packing has a test of its own."""
    docs = P.table(spark, "/root/testdata/sf0.001", "documents")
    bench = [tuple(r) for r in P.table(spark, "/root/testdata/sf0.001", "benchmark").select("item_id", "text").collect()]
    step = dict(P.STAGES)
    run = lambda name, df: stored(step[name](spark, df, "/root/testdata/sf0.001"), "stage")
    good = run("quality rules", docs)
    for r in good.collect():
        n, *_, repeated = plain_quality(r.text)
        assert n >= 50 and 100 * repeated <= 50 * n
    kept = {r.doc_id for r in quality.quality_verdict(docs).filter("kept").collect()}
    assert {r.doc_id for r in good.collect()} == kept
    rows = [(r.doc_id, r.text) for r in good.collect()]
    gone = plain_lines(rows, jaccard.Rule())
    want = {}
    for i, t in rows:
        left = "\n".join(s for j, s in enumerate(t.split("\n")) if (i, j) not in gone)
        if left.split() or not any(g[0] == i for g in gone):
            want[i] = left
    thin = run("line dedup", good)
    assert {r.doc_id: r.text for r in thin.collect()} == want
    sets = {i: shingle_set(t, 5) for i, t in want.items()}
    of = classes(sets, [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) > 0])
    one = run("n-gram Jaccard join", thin)
    assert {r.doc_id for r in one.collect()} == {i for i, c in of.items() if c == i}
    clean = run("benchmark decontamination", one)
    assert {r.doc_id for r in clean.collect()} == {i for i, _, hit, _ in plain_hits([(r.doc_id, r.text) for r in one.collect()], bench) if not hit}

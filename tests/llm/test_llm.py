"""Operators for training corpora against plain versions, and edge cases: nulls, empty and long texts, ties and repeated
rows, empty tables, extra columns with clashing names."""

import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecover.llm import chunks, components, decontam, jaccard, lines, packing, pii, quality, repeats, sharding, toxicity
from tidecover.llm.common import words

WORDS = [f"{a}{b}{c}" for a in ("ba", "co", "du", "fi") for b in ("ra", "no", "ti") for c in ("l", "m", "st", "")]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    passage = prose(rng, 90)
    out = []
    for i in range(40):
        body = [prose(rng, rng.randint(8, 40)) for _ in range(rng.randint(1, 6))]
        if i % 5 == 0:
            body.insert(1, passage)
        out.append("\n".join(body))
    for i in range(20):  # near copies of the first text, of which copies differ from one another
        w = out[0].split(" ")
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = rng.choice(WORDS).upper()
        out.append(" ".join(w))
    out += [out[3], out[3], None, "", "x", "É ß é", "a " * 3000, "\n\n \t\n", out[4] + "\n" + out[4]]
    table = [(i, t, "en" if i % 3 else None, None if i % 7 else "s", len(t or "")) for i, t in enumerate(out)]
    return table + [table[5], (None, out[6], None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    # Names that the operators use within must not matter.
    return spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", n int, node int").repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words(spark):
    df = spark.createDataFrame([(" a  b\tc\n",), ("",), (" ",), ("é\x0bf",), ("\n\na\r\n b\x0c\x0c\n",), ("a\u00a0b\u2028c",)], "t string")
    assert [r[0] for r in df.select(words(F.col("t"))).collect()] == [["a", "b", "c"], [], [], ["é", "f"], ["a", "b"], ["a\u00a0b\u2028c"]]


def test_pii_against_plain_patterns(spark, docs, none):
    texts = ["mail a@b.c@d.e or x.y+z@host.example.org.", "1.2.3.4.5.6.7.8 256.1.1.1 0001.002.3.4", "4111 1111 1111 1111, 4111-1111-1111-1112 12", "+1 (234) 567-8901 and +49 30 12", "é😀 me@x.de IBAN DE89370400440532013000 ssn 123-45-6789 api_key = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" ", None, "", "no", "a@b.c" * 50, "1" * 5000, "9.9.9.9" * 400, "x" * 200_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.pii] for r in pii.find_pii(df).collect()}

    def luhn(m):
        total = 0
        for i, c in enumerate(reversed(re.sub("[^0-9]", "", m))):
            d = int(c) * (1 + i % 2)
            total += d - 9 * (d > 9)
        return total % 10 == 0

    digits = lambda m: len(re.sub("[^0-9]", "", m))
    plain = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= digits(m) <= 19 and luhn(m)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= digits(m) <= 15),
    }
    for i, t in enumerate(texts):
        if t and len(t) < 100_000:
            want = [(k, m.start(), m.end()) for k, (p, good) in plain.items() for m in re.finditer(p, t) if good(m[0])]
            assert [s for s in got[i] if s[0] in plain] == want
    assert [s[0] for s in got[4]] == ["email", "iban", "ssn", "secret"]
    assert got[5] == got[6] == got[7] == got[11] == []
    assert pii.masked(pii.find_pii(df)).filter("doc_id = 4").first().text == "é😀 <email> IBAN <iban> ssn <ssn> api_key = \"<secret>\" "
    assert pii.find_pii(docs).count() == docs.count() and pii.find_pii(none).count() == 0


def plain_quality(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often, hit = Counter(grams), set()
    for i, g in enumerate(grams):
        if often[g] > 1:
            hit |= {i, i + 1, i + 2}
    own = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(own) - len(set(own)), len(hit)


def test_quality_counts(docs, rows, none):
    got = quality.quality_verdict(docs)
    key = lambda r: (r is None, r)
    want = sorted(((r[0], *plain_quality(r[1])) for r in rows), key=lambda r: (key(r[0]), r[1:]))
    out = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got.collect()), key=lambda r: (key(r[0]), r[1:]))
    assert out == want
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) for r in got.collect())
    assert quality.quality_verdict(none).count() == 0


def test_quality_tells_junk_from_prose(spark):
    rng = random.Random(1)
    good = [" ".join(rng.choice(["the", "of", "and", "to", *WORDS]) for _ in range(200)) + "." for _ in range(60)]
    junk = ["!! ".join(x.upper() for x in good[0].split()), "%%% ".join(good[1].split()), " | ".join(w for w in good[2].split() if len(w) > 3)]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(good + junk)], "doc_id bigint, text string, lang string")
    kept = {r.doc_id for r in quality.quality_verdict(df).filter("kept").collect()}
    assert kept == set(range(60))


def plain_hits(docs_, bench, n=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(AZ))
    items = defaultdict(set)
    for i, t in bench:
        w = cut(t)
        for a in range(max(1, len(w) - n + 1) if w else 0):
            items[tuple(w[a : a + n])].add(i)
    sizes, out = {len(k) for k in items}, []
    for i, t in docs_:
        w, hit, ids = cut(t), set(), set()
        for m in sizes:
            for a in range(len(w) - m + 1):
                if tuple(w[a : a + m]) in items:
                    hit |= set(range(a, a + m))
                    ids |= items[tuple(w[a : a + m])]
        out.append((i, len(w), sorted(hit), sorted(ids)))
    return out


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_decontamination(spark, docs, rows, none, limit):
    bench = [(1, " ".join(rows[2][1].split()[3:18]).upper()), (2, "cotim fitil"), (3, None), (4, ""), (5, rows[2][1][:300]), (5, "again " + rows[9][1])]
    b = spark.createDataFrame(bench, "item_id bigint, text string")
    got = sorted(((r.doc_id, r.n_words, r.hit_at, r.hit_items) for r in decontam.contamination(docs, b, broadcast_windows=limit).collect()), key=str)
    assert got == sorted(plain_hits([(r[0], r[1]) for r in rows], bench), key=str)
    assert decontam.contamination(none, b).count() == 0
    assert not decontam.contamination(docs, b.limit(0)).filter("contaminated").count()


def classes(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingle_set(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(AZ))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


@pytest.mark.parametrize("rule", [jaccard.Rule(4, 85), jaccard.Rule()])
def test_jaccard_join(docs, rows, none, rule):
    sets = {r[0]: shingle_set(r[1], rule.k) for r in rows if r[0] is not None}
    pairs = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= rule.percent * len(sets[a] | sets[b]) > 0]
    want = classes(sets, pairs)
    got = [r for r in jaccard.near_duplicates(docs, rule=rule).collect() if r.doc_id is not None]
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(s) for i, s in sets.items()}
    assert len(got) == len(rows) - 1
    assert jaccard.near_duplicates(none).count() == 0


def test_jaccard_join_on_many_near_copies(spark):
    """Groups of copies that differ from one another more than the rule allows, joined by others between them."""
    rng = random.Random(3)
    base, texts = prose(rng, 120), []
    for i in range(300):
        w = (base if i % 3 else prose(rng, 100) + " " + " ".join(base.split()[:30])).split()
        for _ in range(rng.randint(0, 4)):
            j = rng.randrange(len(w))
            w[j : j + 1] = [rng.choice(WORDS)] * rng.randint(0, 2)
        texts.append(" ".join(w))
    rng.shuffle(texts)
    rule = jaccard.Rule(4, 85)
    sets = {i: shingle_set(t, 4) for i, t in enumerate(texts)}
    want = classes(sets, [(a, b) for a in sets for b in range(a + 1, len(texts)) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(df, rule=rule).collect()} == want


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 99), (5, 5)]
    df = spark.createDataFrame(chain, "a bigint, b bigint")
    got = {r.node: r.label for r in components.components(df).collect()}
    assert got == {i: 0 for i in range(61)} | {99: 99, 100: 99}
    assert components.components(df.limit(0)).count() == 0


def plain_lines(rows, rule):
    """(doc_id, line) of the lines like an earlier one; of fewer than rule.k words only equal ones are alike."""
    ids = {}
    for i, t in rows:
        for j, s in enumerate((t or "").split("\n")):
            if sh := shingle_set(s, rule.k):
                ids[(i, j)] = sh
    order = sorted(ids)
    return {y for n, y in enumerate(order) for x in order[:n] if 100 * len(ids[x] & ids[y]) >= rule.percent * len(ids[x] | ids[y])}


def test_line_dedup(docs, rows, none):
    rule = jaccard.Rule()
    found = lines.repeated_lines(docs.filter("doc_id is not null"))
    gone = {r.doc_id: r.removed for r in found.collect()}
    assert {(i, j) for i, js in gone.items() for j in js} == plain_lines({r[:2] for r in rows if r[0] is not None}, rule)
    left = {r.doc_id: r.text for r in lines.without_lines(found).collect()}
    for r in rows[:-1]:
        kept = [s for j, s in enumerate((r[1] or "").split("\n")) if j not in gone[r[0]]]
        assert left[r[0]] == (r[1] if not gone[r[0]] else "\n".join(kept))
    assert lines.repeated_lines(docs).count() == len(rows)
    assert lines.repeated_lines(none).count() == 0


def test_lines_like_a_later_one_only_stay(spark):
    """Lines 0 and 1 are like line 2 but not like each other; short lines repeat; many near copies in random order."""
    w = prose(random.Random(12), 60).split()
    a, c = w[:50], w[8:58]
    texts = [" ".join(a), " ".join(c), " ".join(w[4:54]), "one two three\none two three", "One  two three", "one two"]
    rng = random.Random(13)
    for _ in range(120):
        v = list(w)
        for _ in range(rng.randint(0, 4)):
            v[rng.randrange(60)] = rng.choice(WORDS)
        texts.append(prose(rng, 9) + "\n" + " ".join(v))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {(r.doc_id, j) for r in lines.repeated_lines(df).collect() for j in r.removed}
    assert got == plain_lines(list(enumerate(texts)), jaccard.Rule())
    assert {(2, 0), (3, 1), (4, 0)} <= got and not got & {(0, 0), (1, 0), (3, 0), (5, 0)}


def plain_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    often = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    for b in raw:
        mark = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if often[b[i : i + length]] > 1:
                mark[i : i + length] = True
        data = np.frombuffer(b, np.uint8)
        yield len(b), int(mark.sum()), int((np.diff(np.concatenate([[False], mark]).astype(int)) == 1).sum()), sha256(data[~mark].tobytes()).hexdigest()


@pytest.mark.parametrize("huge", [False, True])
def test_repeated_bytes(docs, rows, none, huge, monkeypatch):
    if huge:
        monkeypatch.setattr(repeats, "GROUP_BYTES", 3000)
    found = repeats.without_repeats(docs).collect()
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, sha256(r.kept).hexdigest()) for r in found) == sorted(plain_repeats([r[1] for r in rows], 400))
    # A repeat of MARK bytes has a mark, and marks hold nothing that stands in one place only.
    texts = [r[1] for r in rows]
    stretch = repeats.MARK - (repeats.MARK - repeats.K) // 2
    most, least = (dict(zip(texts, plain_repeats(texts, n))) for n in (stretch, repeats.MARK))
    by_size = defaultdict(list)
    for t in texts:
        by_size[most[t][0]].append((least[t][1], most[t][1]))
    for r in found:
        assert any((r.n_marked > 0 or not lo) and r.n_marked <= hi for lo, hi in by_size[r.n_bytes])
    assert repeats.without_repeats(none).count() == 0


def test_matching_statistics():
    rng = np.random.RandomState(0)
    t = rng.randint(0, 3, 300)
    best = repeats.matching_statistics(t)
    for i in range(300):
        n = 0
        while i + n < 300 and any((t[j : j + n + 1] == t[i : i + n + 1]).all() for j in range(300 - n) if j != i):
            n += 1
        assert best[i] == n


def test_chunks(docs, rows, none):
    text = prose(random.Random(5), 3000).encode()
    ends = chunks.cuts(text)
    assert ends[-1] == len(text) and ends == sorted(set(ends)) and all(b - a <= chunks.MAX_CHUNK for a, b in zip([0, *ends], ends))
    moved = set(x - 11 for x in chunks.cuts(text[:1000] + b"inserted!!!" + text[1000:]))
    assert len(set(ends) - moved) <= 25 + sum(e <= 1000 for e in ends)
    found = {r.doc_id: r for r in chunks.repeated_spans(docs).collect() if r.doc_id is not None}
    assert len(found) == len(rows) - 2
    first = [i for i in range(0, 40, 5)]
    assert all(found[i].n_dup_chunks > 0 for i in first[1:])  # the passage came before
    assert found[60].n_bytes == sum(s.end - s.start for s in found[60].removed) == found[61].n_bytes  # copies of text 3
    assert found[62].n_chunks == found[63].n_chunks == 0
    left = {r.doc_id: r.text for r in chunks.without_spans(chunks.repeated_spans(docs)).collect()}
    assert left[60] == "" and left[1] == rows[1][1]
    assert chunks.repeated_spans(none).count() == 0


def test_packing(docs, rows, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter(tuple([*tok.encode(r[1] or "", add_special_tokens=False).ids, 1]) for r in rows)
    seqs = defaultdict(list)
    pieces = packing.pack(docs, seq_len=256).collect()
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4")
        assert len(ids) == p.length
        seqs[p.sequence_id].append((p.offset, p.start, p.doc_tokens, ids))
    whole, out, last = [], Counter(), max(seqs)
    for s in range(last + 1):
        at = 0
        for offset, start, n, ids in sorted(seqs[s], key=lambda x: x[0]):
            assert offset == at
            at += len(ids)
            whole.append((start, n, ids))
        assert at == 256 or s == last
    own = []
    for start, n, ids in whole:
        own = own if start else []
        assert len(own) == start
        own = [*own, *ids.tolist()]
        if len(own) == n:
            out[tuple(own)] += 1
    assert out == want
    assert packing.pack(none).count() == 0
    p = next(x for x in pieces if x.length == 1)
    assert zlib.crc32(p.ids) == zlib.crc32(np.array([1], "<u4").tobytes())


def test_sharding(spark, docs, none):
    from tidecover.llm.common import fresh_path

    store = sharding.Store(spark, fresh_path(spark, "store"))
    store.append(docs.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text"), F.lit(6))), "batch")
    before = store.manifest().agg(F.sum("n_rows"), F.bit_xor("digest")).first()
    store.compact()
    assert len(store.runs()) < sharding.FAN_IN and store.manifest().agg(F.sum("n_rows"), F.bit_xor("digest")).first() == before
    back = spark.read.parquet(*[f"{store.root}/runs/{r}" for r in store.runs()])
    assert sorted(map(str, back.select(docs.columns).collect())) == sorted(map(str, docs.collect()))
    with pytest.raises(RuntimeError):
        store.commit(store.manifest(), store.version() - 1)
    assert store.manifest().agg(F.sum("n_rows"), F.bit_xor("digest")).first() == before
    empty = sharding.Store(spark, fresh_path(spark, "store"))
    assert empty.append(none.withColumn("batch", F.lit(1)), "batch") == 0 and empty.compact() == 0 and empty.manifest().count() == 0


def test_automaton():
    auto = toxicity.Automaton(["stupid ", "lowei", "idiot "])
    cases = {"stupid": 2, "stupd": 1, "stuppid": 1, "stxpid": 1, "xtupid": 0, "stupidly": 0, "loweiheit": 2, "loweheit": 0, "idiot": 2, "idiots": 0, "idot": 0, "the": 0, "st": 0}
    data = np.frombuffer(" ".join(cases).encode(), np.uint8)
    sizes = np.array([len(w) for w in cases])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    assert dict(zip(cases, auto.run(data, starts, sizes).tolist())) == cases


def test_toxicity_on_held_out_rows(spark, none):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        t = prose(rng, 60).split()
        if bad:
            for w in rng.sample(["mordant", "vilifyx", "scumbagg"], 2):
                t.insert(rng.randrange(60), w)
        rows.append((i, " ".join(t)))
        labels.append((i, int(bad)))
    rows += [(None, "x"), (1000, None), (1001, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = toxicity.toxicity(docs, spark.createDataFrame(labels + [(5000, None)], "doc_id bigint, toxic int")).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert len(held) > 80 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert toxicity.toxicity(none, spark.createDataFrame(labels, "doc_id bigint, toxic int")).count() == 0


def test_quotation_counts_apart(spark):
    texts = [(0, 'he said the word "stupid " twice'), (1, "you are stupid indeed")]
    rows = toxicity.features(spark.createDataFrame(texts, "doc_id bigint, text string"), [("stupid ", 1.0)]).collect()
    by = {r.doc_id: r for r in rows}
    assert by[0].quoted > 0 and by[0].plain == 0 and by[1].plain > 0 and by[1].quoted == 0 and by[1].address > 0

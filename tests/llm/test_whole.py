"""Inputs on which an operator once did less than its whole job, or more."""

import random
import re
from hashlib import sha256

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_llm import plain_repeats, prose
from tidecover.llm import jaccard, lines, packing, repeats, toxicity


@pytest.mark.parametrize("huge", [False, True])
def test_repeats_whose_surroundings_overlap(spark, huge, monkeypatch):
    """A line that stands twice within the reach of one anchor, in unlike contexts: no window of 400 bytes repeats."""
    rng = random.Random(11)
    line = prose(rng, 40)[:200]
    texts = [" ".join([prose(rng, 60), line, prose(rng, 8), line, prose(rng, 60)]) for _ in range(30)]
    texts += [texts[0] + " " + prose(rng, 90), "x" + texts[1][150:]]
    if huge:
        monkeypatch.setattr(repeats, "GROUP_BYTES", 3000)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, sha256(r.kept).hexdigest()) for r in repeats.without_repeats(df).collect())
    assert got == sorted(plain_repeats(texts, 400))


def test_packing_of_added_tokens(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [f"a {end} b", end, f"{end}{end} \n {end}", f"x  \n{end}\t y", "<|endoftext", f"<|{end}|>", f"é{end}é", end.upper()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in packing.pack(df, seq_len=10_000).collect()}
    assert got == {i: [*tok.encode(t, add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}


def test_near_copies_of_rows_without_own_ids(spark):
    rng = random.Random(12)
    a, b, c, d, e = (prose(rng, 60) for _ in range(5))
    near = lambda t: t + " end"
    rows = [
        (1, a), (5, near(a)), (5, b),  # b is clean, though its doc_id also names a later copy
        (7, c), (7, c), (7, near(c)),  # a repeated row, and a near copy under the same doc_id
        (None, d), (None, d), (None, near(d)), (None, near(b)),
        (8, e), (9, near(e)), (10, ""), (11, None),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_copy_stage(spark, df, "").collect()), key=str)
    groups = [{(1, a)}, {(5, b)}, {(7, c), (7, near(c))}, {(None, d), (None, near(d))}, {(8, e)}, {(10, "")}, {(11, None)}]
    assert len(kept) == len(groups) and all(len(g & set(kept)) == 1 for g in groups)


def test_links_through_a_row_without_id(spark):
    """Two texts with ids that differ by more than the rule allows hang together by one that only a null-id row holds."""
    rng = random.Random(13)
    w = prose(rng, 100).split()
    texts = [(4, " ".join(["x1", "x2", "x3", *w])), (None, " ".join(w)), (6, " ".join([*w, "y1", "y2", "y3", "y4"]))]
    rule = jaccard.Rule(4, 95)
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(df, rule=rule).collect()} == {4: 4, None: 4, 6: 4}


def test_repeats_of_short_lines(spark):
    rng = random.Random(14)
    a, b = prose(rng, 30), prose(rng, 30)
    texts = [f"Home\n{a}\nBy A. Writer\n\nhome page", f"home\n\n{b}\n by  a.  WRITER ", "one two three four\none two three four five\none two three five", "one two three\nHOME\n \none two three four"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.removed for r in lines.repeated_lines(df).collect()}
    assert got == {0: [], 1: [0, 3], 2: [], 3: [1, 3]}


def test_terms_next_to_typographic_marks(spark):
    plain = ["\u00bfstupid\u2026", "no\u2014stupid\u2014no", "a\u00a0stupid\u00a0b", "don\u2019t be stupid, isn\u2019t it", "the dogs\u2019 stupid bowl"]
    quoted = ["\u201cstupid\u201d x", "\u00abstupid\u00bb", "\u201estupid\u201c", "\u2018so stupid, don\u2019t\u2019 x", "\u201astupid\u2018 x"]
    fuzzy = ["d\u00e9bilx\u00e9s", "d\u00e9b\u00fcl\u00e9s", "d\u00e9bil\u00e9\u00e9s"]
    texts = plain + quoted + fuzzy
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in toxicity.features(df, [("stupid ", 1.0), ("d\u00e9bil\u00e9s ", 1.0)]).collect()}
    kinds = [next(k for k in ("plain", "quoted", "fuzzy", "fuzzy_quoted", "none") if k == "none" or got[i][k] > 0) for i in range(len(texts))]
    assert kinds == ["plain"] * 5 + ["quoted"] * 5 + ["fuzzy"] * 3


def one_edit(a: str, b: str) -> bool:
    """Whether a becomes b by one letter more, less or other at most."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y)))
        rows.append(row)
    return rows[-1][-1] <= 1


def plain_kind(word: str, terms: list[str]) -> int:
    """2 exact, 1 with one edit after the first letter (terms of FUZZY_FROM letters), 0 none; starts match any word's start."""
    best = 0
    for t in terms:
        if t.endswith(" "):
            heads = [word]
        else:
            heads = [word[:n] for n in range(1, len(word) + 1)]
        bare = t.strip()
        if bare in heads:
            return 2
        if len(bare) >= toxicity.FUZZY_FROM and any(h[0] == bare[0] and one_edit(h[1:], bare[1:]) for h in heads):
            best = 1
    return best


def plain_features(text: str | None, terms: list[str]) -> list[float]:
    t = re.sub(r'[^a-z0-9@$*"]', " ", (text or "").lower())
    found = [(m.group(), m.start()) for m in re.finditer(r'[^ "]+', t)]
    x = [0.0] * 5
    for i, (word, at) in enumerate(found):
        kind = plain_kind(word, terms)
        if kind:
            near = {w for j, (w, _) in enumerate(found) if j != i and abs(j - i) <= toxicity.CONTEXT}
            quoted = bool(near & toxicity.REPORTING) or (t[:at].count('"') % 2 == 1 and '"' in t[at:])
            x[(0 if kind == 2 else 2) + quoted] += 1
            x[4] += bool(near & toxicity.ADDRESS) and not quoted
    return [*np.log1p(x), (x[0] + 0.5 * x[2]) / max(1, len(found)) * 20]


def test_toxicity_features_against_a_plain_version(spark):
    """Every word against every term by edit distance, quotation by counting marks; long, empty, null and repeated texts too."""
    rng = random.Random(15)
    terms = ["stupid ", "idiot ", "vermin", "scumbag", "loud"]
    around = ["you", "he", "said", "quoted", "the", "dog", "ran", "word", "your", "verse", "stop", "lo", "v"]

    def damaged(w: str) -> str:
        i, c = rng.randrange(len(w)), rng.choice("aeidst")
        return rng.choice([w, w, w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w + "s", w + c + "ly"])

    def made(n: int) -> str:
        talk = rng.random() < 0.5  # half of the texts quote nobody
        ws = [damaged(rng.choice(terms).strip()) if rng.random() < 0.2 else rng.choice(around) for _ in range(n)]
        ws = [w for w in ws if talk or w not in toxicity.REPORTING]
        return "".join(w + rng.choice([" ", " ", " ", ", ", "\n", "-", *([' "', '" '] if talk else [])]) for w in ws)

    texts = [made(rng.randint(1, 40)) for _ in range(150)] + [made(6000), "", None, '"', "stupid"]
    texts += texts[:3]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    rows = toxicity.features(df, [(t, 1.0) for t in terms]).collect()
    got = {r.doc_id: [r[f] for f in toxicity.FEATURES] for r in rows}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(plain_features(t, terms)), t
    assert sum(g[0] > 0 for g in got.values()) > 50 and sum(g[2] > 0 for g in got.values()) > 50 and sum(g[3] > 0 for g in got.values()) > 10


def test_copies_of_a_text_that_nothing_is_like_need_no_tokens(spark):
    """They only equal each other, so their tokens aren't made; a near copy keeps both texts."""
    rng = random.Random(21)
    one, two, near = ([f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(3))
    texts = [" ".join(one)] * 3 + [" ".join(two), " ".join(near), " ".join([*near[:59], "other"]), "a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, s string")
    live = {r.id: r.s for r in jaccard.live_rows(df, jaccard.Rule()).collect()}
    assert live == {0: None, 1: None, 2: None, 4: texts[4], 5: texts[5], 6: "a b"}


@pytest.mark.parametrize(("k", "size", "share"), [(5, 4, 1.0), (5, 4, 0.4), (5, 5, 1.0), (4, 3, 0.5), (1, 1, 1.0)])
def test_texts_have_at_least_the_tokens_counted_as_their_own(spark, k, size, share):
    rng = random.Random(22)
    texts = ["".join(rng.choice(["a", "B", "b ", "\u00e9", " ", "\t\x0b", "c", " d "]) for _ in range(rng.randint(0, 90))) for _ in range(60)]
    texts += texts[:9] + ["", " ", "x " * 40, "long" * 300_000 + " a b c d e f"]
    words = [tuple(t.encode().lower().split()) for t in texts]
    sets = {t: {w[i : i + k] for i in range(len(w) - k + 1)} for t, w in zip(texts, words)}
    own = {hash_: sum(all(x not in o for u, o in sets.items() if u != t) for x in sets[t]) for hash_, t in enumerate(sets)}
    ids = {t: i for i, t in enumerate(sets)}
    df = spark.createDataFrame([(ids[t], t) for t in texts], "node bigint, s string")
    got = {r.node: r for r in jaccard.own_spans(jaccard.sampled_grams(df, k, size, share)).collect()}
    assert got and all(r.own <= own[i] for i, r in got.items())
    assert all(r.copies == texts.count(list(sets)[i]) for i, r in got.items() if r.own)
    assert share < 1 or sum(r.own for r in got.values()) > 0.5 * sum(own.values())

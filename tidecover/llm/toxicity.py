"""Toxicity: a Levenshtein automaton run over the trie of a learned lexicon finds its terms, misspelled ones too; the
words around a hit tell quotation from abuse; a logistic model, fitted on labelled rows, weighs the hits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import or_empty, stored, table

# Words near a hit that speak of words (quotation), and words that address somebody.
REPORTING = {"said", "says", "quote", "quoted", "word", "called", "wrote", "zitat", "sagte", "wort", "mot", "citation", "dit", "dijo", "palabra", "cita"}
ADDRESS = {"you", "your", "youre", "du", "dein", "tu", "toi", "vous", "usted", "eres"}
CONTEXT = 6  # words on each side
STEMS = (4, 5, 6, 7)  # lengths of word starts that may become terms, besides whole words
MIN_DOCS, MIN_SHARE, MIN_PRECISION = 3, 0.01, 0.94
FUZZY_FROM = 6  # terms of so many letters also match with one edit
MAX_TRAIN = 200_000  # labelled rows to learn from, about 3 MB of ids
FEATURES = ("plain", "quoted", "fuzzy", "fuzzy_quoted", "address", "rate")


def terms_of(text: str = "text") -> Column:
    """Distinct whole words (ending in a space) and word starts of a text, lower case."""
    ws = F.array_distinct(F.split(F.lower(or_empty(F.col(text))), r"[^\p{L}\p{N}@$*]+"))
    starts = [F.transform(F.filter(ws, lambda w: F.length(w) >= n), lambda w: F.left(w, F.lit(n))) for n in STEMS]
    whole = F.transform(F.filter(ws, lambda w: F.length(w) >= 3), lambda w: F.concat(w, F.lit(" ")))
    return F.array_distinct(F.concat(whole, *starts))


def learn_lexicon(train: DataFrame, text: str = "text") -> list[tuple[str, float]]:
    """Terms of toxic training rows with their weights; train has text and toxic.

    A term occurs in MIN_SHARE of the toxic rows at least (so there are 1 / MIN_SHARE times a row's terms at most), and
    MIN_PRECISION of the rows with it (balanced for the sizes of both classes) are toxic.  Of a start and a longer term
    that nearly always comes with it the longer one stays.
    """
    n_tox, n_clean = train.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    if not n_tox or not n_clean:
        return []
    least = max(MIN_DOCS, MIN_SHARE * n_tox)
    of = lambda toxic: train.filter(F.col("toxic") == toxic).select(terms_of(text).alias("ts")).select(F.explode_outer("ts").alias("term"))
    often = stored(of(1).groupBy("term").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least), "terms")
    clean = of(0).join(often.select("term"), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("m"))
    both = often.join(clean, "term", "left").select("term", "n", F.coalesce("m", F.lit(0)).alias("m"))
    precise = both.filter(F.col("n") / n_tox >= MIN_PRECISION / (1 - MIN_PRECISION) * (F.col("m") / n_clean))
    rows = precise.orderBy(F.desc("n"), "term").collect()
    counts = {r.term: r.n for r in rows}
    kept: dict[str, float] = {}
    for r in rows:
        longer = [t for t in counts if t != r.term and t.startswith(r.term) and counts[t] >= 0.95 * r.n]
        if not longer:
            kept[r.term] = float(np.log((r.n + 0.5) / n_tox) - np.log((r.m + 0.5) / n_clean))
    return sorted((t, w) for t, w in kept.items() if not any(t != u and not u.endswith(" ") and t.startswith(u) for u in kept))


class Automaton:
    """Terms within one edit, as a table of states by letter: the trie of the terms walked with one edit to spare.

    A state holds the trie nodes reachable for what was read, each with the edits used.  Whole words end in a space,
    which is read after a word's last letter; starts of words match at once.  kind: 0 none, 1 one edit, 2 exact.
    """

    def __init__(self, terms: list[str]):
        nodes, ends, fuzzy = [{}], {}, set()
        for t in terms:
            at, path = 0, [0]
            for b in map(ord, t):
                at = nodes[at].setdefault(b, len(nodes))
                if at == len(nodes):
                    nodes.append({})
                path.append(at)
            ends[at] = True
            if len(t.strip()) >= FUZZY_FROM:
                fuzzy.update(path)
        letters = sorted({b for n in nodes for b in n} | {32})

        def close(pairs: dict[int, int]) -> frozenset:
            for n, e in list(pairs.items()):  # a letter left out
                if e == 0:
                    for b, m in nodes[n].items():
                        if m in fuzzy and b != 32:
                            pairs[m] = min(pairs.get(m, 9), 1)
            return frozenset(pairs.items())

        def move(state: frozenset, b: int) -> frozenset:
            out: dict[int, int] = {}
            for n, e in state:
                if b in nodes[n]:
                    m = nodes[n][b]
                    if e == 0 or m in fuzzy:
                        out[m] = min(out.get(m, 9), e)
                if e == 0 and b != 32:
                    if n in fuzzy and n:  # a letter too many; the first one must be right
                        out[n] = min(out.get(n, 9), 1)
                    for c, m in nodes[n].items():  # another letter
                        if m in fuzzy and n and c != 32:
                            out[m] = min(out.get(m, 9), 1)
            return close(out)

        start = close({0: 0})
        start = frozenset((n, e) for n, e in start if n == 0)
        index, todo, rows, kinds = {frozenset(): 0, start: 1}, [start], [[0] * (len(letters) + 1), None], [0, 0]
        while todo:
            s = todo.pop()
            row = []
            for b in (-1, *letters):  # -1: any letter that no term has
                t = move(s, b)
                if t not in index:
                    index[t] = len(index)
                    rows.append(None)
                    kinds.append(2 if any(n in ends and e == 0 for n, e in t) else 1 if any(n in ends for n, e in t) else 0)
                    todo.append(t)
                row.append(index[t])
            rows[index[s]] = row
        self.code = np.zeros(letters[-1] + 2, dtype=np.int32)  # a letter's column; the last one stands for all beyond
        self.code[letters] = np.arange(1, len(letters) + 1)
        self.table, self.kind = np.array(rows, dtype=np.int32), np.array(kinds, dtype=np.int8)

    def run(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The best kind of match of each word of data (code points): all words take a step at once, and most have ended after three."""
        best = np.zeros(len(start), np.int8)
        live, state, i = np.arange(len(start)), np.ones(len(start), np.int32), 0
        while len(live):
            at = start[live] + i
            letter = np.where(i < size[live], data[np.minimum(at, len(data) - 1)], 32)
            state = self.table[state, self.code[np.minimum(letter, len(self.code) - 1)]]
            best[live] = np.maximum(best[live], self.kind[state])
            on = (state > 0) & (i < size[live]) & (best[live] < 2)
            live, state, i = live[on], state[on], i + 1
        return best


def scanned(text: Column) -> Column:
    """text in lower case with a space for what isn't a letter, digit, @, $ or * and with " for every quotation mark.

    Single marks count in pairs only, and not between letters, where they are apostrophes.
    """
    low = F.lower(or_empty(text))
    own = F.regexp_replace(low, r"(?<=\p{L})\u2019(?=\p{L})", " ")
    for pair in (r"\u201A([^\u201A\u2018\u2019]*+)[\u2018\u2019]", r"[\u2018\u201B]([^\u2018\u2019\u201B]*+)\u2019"):
        own = F.regexp_replace(own, pair, '"$1"')
    own = F.regexp_replace(own, r"[\u201C-\u201F\u00AB\u00BB\u2039\u203A\u300C-\u300F\u301D-\u301F\uFF02]", '"')
    plain = F.octet_length(low) == F.length(low)
    return F.regexp_replace(F.when(plain, low).otherwise(own), r"[^\p{L}\p{N}@$*\"]", " ")


def features(docs: DataFrame, lexicon: list[tuple[str, float]], text: str = "text") -> DataFrame:
    """doc_id and FEATURES of every whole text: logarithms of the numbers of hits by kind, and hits per word."""
    kind = dict(docs.dtypes)["doc_id"]
    auto = Automaton([t for t, _ in lexicon])  # built once; its two tables go to the tasks with the function

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 128):
                part = batch.slice(begin, 128)
                raws = [t.as_py() for t in part.column(1)]
                data = np.frombuffer((" ".join(raws) + " ").encode("utf-32-le"), dtype="<u4")
                is_word = (data != 32) & (data != 34)
                edge = np.flatnonzero(np.diff(np.concatenate([[False], is_word, [False]]).astype(np.int8)))
                start, size = edge[::2], edge[1::2] - edge[::2]
                best = auto.run(data, start, size)
                first = np.cumsum([0, *(len(r) + 1 for r in raws)])
                words = np.searchsorted(start, first)
                marks = np.flatnonzero(data == 34)
                x = np.zeros((len(raws), len(FEATURES)))
                of = np.searchsorted(first, start[np.flatnonzero(best)], side="right") - 1
                for w, d in zip(np.flatnonzero(best), of):
                    a, b = max(words[d], w - CONTEXT), min(words[d + 1], w + CONTEXT + 1)
                    around = {raws[d][start[j] - first[d] : start[j] - first[d] + size[j]] for j in range(a, b) if j != w}
                    open_marks = np.searchsorted(marks, start[w]) - np.searchsorted(marks, first[d])
                    shut = np.searchsorted(marks, first[d + 1]) > np.searchsorted(marks, start[w])
                    quoted = bool(around & REPORTING) or (open_marks % 2 == 1 and shut)
                    x[d, (0 if best[w] == 2 else 2) + quoted] += 1
                    x[d, 4] += bool(around & ADDRESS) and not quoted
                x[:, 5] = (x[:, 0] + 0.5 * x[:, 2]) / np.maximum(1, np.diff(words)) * 20
                x[:, :5] = np.log1p(x[:, :5])
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x[:, j].copy()) for j in range(len(FEATURES)))], names=["doc_id", *FEATURES])

    return docs.select("doc_id", scanned(F.col(text)).alias("t")).mapInArrow(scan, f"doc_id {kind}, " + ", ".join(f"{f} double" for f in FEATURES))


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 0.5) -> np.ndarray:
    """Weights of a logistic model, the constant last, by Newton's steps with a penalty on all but the constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", *, from_score: float = 0.3, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted, one row per row of docs.

    Lexicon and model are learned from max_train of the labelled rows that aren't held out, those of the smallest hashes
    (about so many: a share of all hashes), at every size; their ids are broadcast.  Null and empty texts get the score of
    a text without hits; null doc_ids aren't held out and have no label; a doc_id that is labelled twice is toxic if one
    label says so; without labels of both classes every score is 0.  Repeated rows are scored alike.
    """
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    usable = known.filter(~held_out(F.col("doc_id")))
    share = min(1.0, max_train / max(1, usable.count()))
    train = stored(usable.filter(F.xxhash64("doc_id") <= int(-(2**63) + share * (2**64 - 1) - 1)) if share < 1 else usable, "train")
    near = F.broadcast(train)
    lexicon = learn_lexicon(docs.select("doc_id", text).join(near, "doc_id"), text)
    scored = stored(features(docs, lexicon, text), "features")
    # Documents with one doc_id give one row, so the driver gets no more rows than ids were broadcast.
    seen = scored.join(near, "doc_id").groupBy("doc_id").agg(*[F.max(f).alias(f) for f in FEATURES], F.max("toxic").alias("toxic"))
    rows = seen.select(*FEATURES, "toxic").toPandas()
    if rows["toxic"].nunique() < 2:
        score = F.lit(0.0)
    else:
        w = fit(rows[list(FEATURES)].to_numpy(), rows["toxic"].to_numpy(dtype=float))
        z = sum((F.col(f) * float(a) for f, a in zip(FEATURES, w)), F.lit(float(w[-1])))
        score = 1 / (1 + F.exp(-z))
    out = scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= from_score).cast("int"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))

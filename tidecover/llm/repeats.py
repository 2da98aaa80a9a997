"""Suffix-array dedup by a run-length index.

Every window of LENGTH bytes is led by one of its k-grams (the one of the smallest hash), its anchor; equal windows have
equal anchors.  So only texts around anchors that occur more than once can repeat, and only if what they repeat goes on far
enough to the left or to the right of the anchor.  Equal surroundings are counted; those that differ are dealt out by
anchor, and each bucket gets a run-compressed Burrows-Wheeler transform.  Common-prefix lengths are computed at the sampled
ends of runs only; streamed along the text, where a length falls by one per byte at most, they are the matching statistics
of all positions, and matches of LENGTH bytes are marked.  Shorter repeats, from MARK bytes on, are reported by the anchors
of shorter windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, or_empty, row_keys, stored, table

K = 64  # bytes of an anchor
MARK = 280  # repeats from so many bytes on, about 45 words, are reported
CHUNK = 1 << 16  # window starts handled at once, so memory doesn't grow with a text
PART_BYTES = 1 << 20  # short texts are handled together up to so many bytes
BUCKET_BYTES = 2 << 20
GROUP_BYTES = 16 << 20  # an anchor with more text around it than this is counted window by window instead


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of all K-grams, by doubling."""
    h = data.astype(np.uint64)
    h += np.uint64(1)
    step = 1
    while step < K:
        ahead = h[step:] + np.uint64(0xC2B2AE3D27D4EB4F)
        h = h[:-step] * np.uint64(0x9E3779B97F4A7C15)
        h ^= ahead
        np.right_shift(h, np.uint64(29), out=ahead)
        h ^= ahead
        h *= np.uint64(0xBF58476D1CE4E5B9)
        step *= 2
    return h ^ (h >> np.uint64(32))


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minima of all windows of w values: of each block's rest and of the next block's start."""
    n = len(v)
    pad = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    pad[:n] = v
    blocks = pad.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(blocks, axis=1).ravel()
    return np.minimum(ahead[: n - w + 1], behind[w - 1 : n])


def mixed(h: np.ndarray, at: np.ndarray, begin: int, end: int) -> np.ndarray:
    """Hashes of the stretches from begin to end bytes after each place, from the K-grams h that cover them."""
    out = np.full(len(at), begin & 0xFFFF, dtype=np.uint64)
    for off in sorted({*range(begin, end - K, K), end - K}):
        out = (out ^ h[at + off]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


def anchors(data: np.ndarray, ends: np.ndarray, length: int, mark: int) -> tuple[np.ndarray, ...]:
    """pos, h, large, left, right, far_left, far_right of the anchors of all windows of mark bytes of the texts that data
    holds one after the other, each up to its place in ends; windows never cross ends.

    large: whether one leads a window of length bytes too.  The leftmost of equals leads a window, so an anchor of a window
    also leads the shorter ones within that hold it, and a later window never has an earlier anchor.  The stretches of half
    of mark, and of half of length, that end or begin with the anchor have hashes where the text is long enough, else 0 and
    a false in the masks that follow.
    """
    half, far, n = (mark - K) // 2, (length - K) // 2, len(data)
    sides = ((-half, K), (0, mark - half), (-far, K), (0, length - far))
    begins = np.concatenate([[0], ends[:-1]])
    found: list[list[np.ndarray]] = [[] for _ in range(3 + 2 * len(sides))]
    for a in range(0, n - mark + 1, CHUNK):
        # Windows that begin in the chunk; their anchors' stretches go on by far before it, and by length after.
        before = min(a, far)
        h = gram_hashes(data[a - before : a + CHUNK + 2 * length])
        own = h[before : before + CHUNK + length - K]
        order = (own >> np.uint64(20) << np.uint64(20)) | np.arange(len(own), dtype=np.uint64)
        cut = ends[np.searchsorted(ends, a, side="right") : np.searchsorted(ends, a + len(own) + K)] - a

        def led(w: int) -> np.ndarray:
            by = (sliding_min(order, w - K + 1) & np.uint64((1 << 20) - 1)).astype(np.int64)  # noqa: B023
            whole = np.ones(len(by), bool)
            for e in cut.tolist():  # noqa: B023
                whole[max(0, e - w + 1) : e] = False
            by = by[whole]
            return by[np.concatenate([by[:1] == by[:1], by[1:] != by[:-1]])]

        at = led(mark)
        large = np.zeros(len(own), bool)
        if len(own) >= length - K + 1:
            large[led(length)] = True
        large = large[at]
        cells = [at + a, own[at], large]
        of = np.searchsorted(ends, at + a, side="right")
        for begin, end in sides:
            inside = (at + a + begin >= begins[of]) & (at + a + end <= ends[of])
            if end > K and begin == 0 and end > mark - half or begin < -half:
                inside &= large
            value = np.zeros(len(at), np.uint64)
            value[inside] = mixed(h, at[inside] + before, begin, end)
            cells += [value, inside]
        for out, x in zip(found, cells):
            out.append(x)
    if not found[0]:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, bool, *[np.uint64, bool] * len(sides)))
    joined = [np.concatenate(x) for x in found]
    order = np.lexsort((~joined[2], joined[0]))  # an anchor of two chunks: large if one says so
    keep = order[np.concatenate([joined[0][:1] == joined[0][:1], joined[0][order][1:] != joined[0][order][:-1]])]
    return tuple(x[keep] for x in joined)


def anchor_table(docs: DataFrame, text: str, length: int, mark: int) -> DataFrame:
    """h (anchor), k1, k2, doc_id (row), pos, left and right (hashes of the stretches of mark's half that end, or begin,
    with the anchor); of anchors that lead windows of length bytes also lo, hi (their surroundings), ctx (hash of these),
    far_left and far_right (hashes of the stretches of length's half).  Null where the text ends before."""
    reach = length - K
    names = ["h", "left", "right", "ctx", "far_left", "far_right", "k1", "k2", "doc_id", "lo", "pos", "hi"]
    digest = xxhash.xxh3_64_intdigest

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column(3)).to_numpy(zero_copy_only=False)) // PART_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), batch.num_rows]
            for begin, end in zip(cuts, cuts[1:]):
                part = batch.slice(begin, end - begin)
                raws = [t.as_py().encode() for t in part.column(3)]
                ends = np.cumsum([len(r) for r in raws])
                joined = b"".join(raws)
                at, h, large, *sides = anchors(np.frombuffer(joined, dtype=np.uint8), ends, length, mark)
                if not len(at):
                    continue
                of = np.searchsorted(ends, at, side="right")
                first = (ends - [len(r) for r in raws])[of]
                lo, hi = np.maximum(at - reach, first), np.minimum(at + length, ends[of])
                view = memoryview(joined)
                ctx = [digest(view[x:y], seed=p - x) for x, y, p in zip(lo[large].tolist(), hi[large].tolist(), at[large].tolist())]
                at, lo, hi, of = at - first, lo - first, hi - first, pa.array(of)
                long = lambda x, there: pa.array(x.view(np.int64), mask=~there)
                whole = np.zeros(len(at), np.uint64)
                whole[large] = np.array(ctx, dtype=np.uint64)
                hashes = [long(sides[2 * j], sides[2 * j + 1]) for j in range(4)]
                place = lambda x: pa.array(x.astype(np.int32), mask=~large)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), hashes[0], hashes[1], long(whole, large), hashes[2], hashes[3], *(part.column(j).take(of) for j in range(3)), place(lo), pa.array(at.astype(np.int32)), place(hi)], names=names)

    k1, k2 = row_keys(F.col("doc_id"), F.col(text))
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select(k1, k2, "doc_id", or_empty(F.col(text)).alias("t")).mapInArrow(find, ", ".join(f"{c} bigint" for c in names[:8]) + f", doc_id {kind}, lo int, pos int, hi int")


def suffix_array(t: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffixes of t (values from 0 on) in order, by doubling what the ranks cover until all differ; and these ranks.

    A rank of a length is the same for all suffixes that begin with the same values over that length.
    """
    n = len(t)
    bits = int(t.max() + 1).bit_length()
    k = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for j in range(k):  # the first ranks cover as many values as fit into a number
        key = (key << bits) | np.concatenate([t[j:] + 1, np.zeros(min(j, n), np.int64)])[:n]
    sa = np.argsort(key)
    s, slots, levels = key[sa], np.arange(n), []
    rank = np.empty(n, np.int64)
    while True:
        # A rank is the first slot of the suffixes that are equal so far; only where there are several these are sorted on.
        head = np.concatenate([[True], s[1:] != s[:-1]])
        rank[sa[slots]] = slots[np.maximum.accumulate(np.where(head, np.arange(len(slots)), 0))]
        slots = slots[~(head & np.concatenate([head[1:], [True]]))]
        if not len(slots):
            return sa, levels
        levels.append((k, rank.astype(np.int32)))
        at = sa[slots]
        key = rank[at] * (n + 1) + np.where(at + k < n, rank[np.minimum(at + k, n - 1)] + 1, 0)
        order = np.argsort(key)
        sa[slots], s = at[order], key[order]
        k *= 2


def common_prefix(t: np.ndarray, levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of the suffixes at a and b: where ranks of a length are equal, on by that length."""
    n = len(t)
    to = np.zeros(len(a), np.int64)
    for k, rank in reversed(levels):
        x, y = a + to, b + to
        to += k * ((x < n) & (y < n) & (rank[np.minimum(x, n - 1)] == rank[np.minimum(y, n - 1)]))
    live = np.arange(len(a))
    while len(live):
        x, y = a[live] + to[live], b[live] + to[live]
        live = live[(x < n) & (y < n) & (t[np.minimum(x, n - 1)] == t[np.minimum(y, n - 1)])]
        to[live] += 1
    return to


def matching_statistics(t: np.ndarray) -> np.ndarray:
    """For each position, the longest match of what starts there with what starts anywhere else.

    Within a run of the transform the lengths of the row before are one more than the next byte's, so they are needed at
    the heads of runs (match with the suffix before) and at their tails (with the suffix after) only.
    """
    n = len(t)
    sa, levels = suffix_array(t)
    bwt = t[sa - 1]
    ends = np.flatnonzero((bwt[1:] != bwt[:-1]) | (sa[1:] == 0) | (sa[:-1] == 0)) + 1
    lcp = common_prefix(t, levels, sa[ends], sa[ends - 1])
    best = np.zeros(n, np.int64)
    for at in (sa[ends], sa[ends - 1]):
        reached = np.zeros(n, np.int64)
        reached[at] = lcp + at
        best = np.maximum(best, np.maximum.accumulate(reached) - np.arange(n))
    return best


def runs_of(hit: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Intervals that windows of length at the sorted places hit cover."""
    cut = np.flatnonzero(np.diff(hit) > length)
    return [(int(hit[a]), int(hit[b]) + length) for a, b in zip(np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(hit) - 1]]))]


def bucket_matches(rows: pd.DataFrame, length: int) -> pd.DataFrame:
    """Intervals (k1, k2, start, end) of windows of length bytes that occur twice in a bucket.

    Surroundings that overlap in one text are joined first, so no byte of a text comes twice.
    """
    rows = rows.sort_values(["k1", "k2", "lo"], kind="stable")
    places, parts, size = [], [], 0
    last, base, end = None, 0, 0
    for r in rows.itertuples(index=False):
        key = (r.k1, r.k2)
        if key != last or r.lo > end:
            parts.append(np.array([256 + len(parts)], dtype=np.int64))  # a separator that equals no other
            size += 1
            base, last = size - r.lo, key
            end = r.lo
        if r.hi > end:
            more = np.frombuffer(r.seg, dtype=np.uint8)[end - r.lo :].astype(np.int64)
            parts.append(more)
            size += len(more)
            end = r.hi
        places.append((r.k1, r.k2, r.lo, r.hi, base))
    t = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    out = []
    if len(t) > 1:
        long = matching_statistics(np.unique(t, return_inverse=True)[1]) >= length
        for k1, k2, lo, hi, base in places:
            hit = np.flatnonzero(long[base + lo : base + hi - length + 1])
            if len(hit):
                out.extend((k1, k2, lo + a, lo + b) for a, b in runs_of(hit, length))
    return pd.DataFrame(out, columns=["k1", "k2", "start", "end"]).astype("int64")


def repeated_bytes(docs: DataFrame, text: str = "text", *, length: int = 400, mark: int = MARK) -> DataFrame:
    """k1, k2 (the row's keys), spans and marks: array<struct<start, end>>, sorted but perhaps overlapping, of repeats.

    A byte is in a span if a string of length bytes that covers it also starts anywhere else in the texts, all of them
    whole.  Marks are stretches of some 0.6 mark bytes that also stand elsewhere; a repeat of mark bytes has one at least.
    Null, empty and shorter texts have none.  Repeated rows are repeats of each other.
    """
    if not K < mark <= length:
        raise ValueError(f"mark must be over {K} and length at most")
    all_ = stored(anchor_table(docs, text, length, mark), "anchors")
    # Tables of frequent keys are written before they are joined, so that Spark can split a frequent anchor's rows.
    met = stored(all_.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("h"), "often")
    found = stored(all_.join(met, "h"), "met")
    discard(all_, met)
    half, pos = (mark - K) // 2, F.col("pos").cast("long")
    stretch = lambda side, v, a, b: F.struct(F.lit(side).alias("side"), F.col(v).alias("v"), a.alias("start"), b.alias("end"))
    both = found.select("h", "k1", "k2", F.explode_outer(F.array(stretch(0, "left", pos - half, pos + K), stretch(1, "right", pos, pos + mark - half))).alias("s")).select("h", "k1", "k2", "s.*").filter("v is not null")
    twice = stored(both.groupBy("h", "side", "v").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c"), "stretches")
    marks = both.join(twice, ["h", "side", "v"]).select("k1", "k2", F.lit(False).alias("whole"), "start", "end")
    least = F.min(F.struct("k1", "k2", "lo", "pos", "hi", "doc_id"))
    large = found.filter("ctx is not null")
    ctx = stored(large.groupBy("h", "ctx", "far_left", "far_right").agg(F.count(F.lit(1)).alias("n"), least.alias("rep")), "surroundings")
    same_ctx = stored(ctx.filter("n > 1").select("h", "ctx"), "equal")
    copies = large.join(same_ctx, ["h", "ctx"]).select("k1", "k2", F.col("lo").cast("long").alias("start"), F.col("hi").cast("long").alias("end"))
    # Anchors with surroundings that differ: each of these is looked at once, if it goes on like another one.
    side = lambda x: ctx.filter(F.col(x).isNotNull()).groupBy("h", x).agg(F.count(F.lit(1)).alias(f"c_{x}")).filter(f"c_{x} > 1")
    alike = ctx.join(side("far_left"), ["h", "far_left"], "left").join(side("far_right"), ["h", "far_right"], "left").filter("c_far_left is not null or c_far_right is not null")
    asked = stored(alike.select("h", "rep.*"), "asked")
    several = asked.groupBy("h").agg(F.sum(F.col("hi") - F.col("lo")).alias("bytes"))
    wanted = stored(asked.join(several, "h").groupBy("k1", "k2", "doc_id").agg(F.collect_list(F.struct("h", "lo", "pos", "hi", "bytes")).alias("segs")), "wanted")
    k1, k2 = row_keys(F.col("doc_id"), F.col(text))
    plain = docs.select(F.col("doc_id").alias("d"), k1.alias("_k1"), k2.alias("_k2"), F.encode(or_empty(F.col(text)), "UTF-8").alias("raw"))
    same = F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("_k1") == F.col("k1")) & (F.col("_k2") == F.col("k2"))
    one = plain.join(wanted, same).select("k1", "k2", "raw", F.explode_outer("segs").alias("s"))
    segs = one.select("k1", "k2", "s.*", F.substring("raw", F.col("s")["lo"] + 1, F.col("s")["hi"] - F.col("s")["lo"]).alias("seg")).dropDuplicates(["h", "k1", "k2", "pos"])
    segs = stored(segs, "segments")
    total = segs.filter(F.col("bytes") <= GROUP_BYTES).agg(F.sum(F.octet_length("seg"))).first()[0] or 0
    buckets = max(1, total // BUCKET_BYTES)
    usual = segs.filter(F.col("bytes") <= GROUP_BYTES).withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(buckets)))
    near = usual.groupBy("bucket").applyInPandas(lambda rows: bucket_matches(rows, length), "k1 bigint, k2 bigint, start bigint, end bigint")
    # A group too large for one task: all its windows are counted, by hash, wherever they are.
    huge = segs.filter(F.col("bytes") > GROUP_BYTES).select("h", "k1", "k2", "seg", "lo", F.explode_outer(F.sequence(F.col("lo"), F.col("hi") - length)).alias("start"))
    huge = stored(huge.select("k1", "k2", F.col("start").cast("long").alias("start"), F.xxhash64(F.substring("seg", F.col("start") - F.col("lo") + 1, F.lit(length)), F.col("h")).alias("w")), "windows")
    # Surroundings that overlap in one text hold the same starts, so a window is a repeat only where its places differ.
    place = ("k1", "k2", "start")
    apart = " or ".join(f"{x}_lo <> {x}_hi" for x in place)
    often = stored(huge.groupBy("w").agg(*[f(x).alias(f"{x}_{end}") for x in place for f, end in ((F.min, "lo"), (F.max, "hi"))]).filter(apart).select("w"), "often")
    far = huge.join(often, "w").select("k1", "k2", "start", (F.col("start") + length).alias("end"))
    spans = copies.unionByName(near).unionByName(far).select("k1", "k2", F.lit(True).alias("whole"), "start", "end")
    of = lambda whole: F.sort_array(F.collect_set(F.when(F.col("whole") == whole, F.struct("start", "end"))))
    out = stored(spans.unionByName(marks).groupBy("k1", "k2").agg(of(True).alias("spans"), of(False).alias("marks")), "repeats")
    discard(found, twice, ctx, same_ctx, asked, wanted, segs, huge, often)
    return out


def without_repeats(docs: DataFrame, text: str = "text", *, length: int = 400, mark: int = MARK) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, n_marked (bytes in marks), kept (the bytes left) per row of docs."""
    k1, k2 = row_keys(F.col("doc_id"), F.col(text))
    found = repeated_bytes(docs, text, length=length, mark=mark)
    rows = docs.select("doc_id", k1, k2, or_empty(F.col(text)).alias("t")).join(found, ["k1", "k2"], "left").select("doc_id", F.encode("t", "UTF-8").alias("raw"), "spans.start", "spans.end", F.col("marks.start").alias("m_start"), F.col("marks.end").alias("m_end"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                sizes, removed, spans, marked, kept = [], [], [], [], []
                for raw, starts, ends, m_starts, m_ends in zip(*(part.column(i).to_pylist() for i in (1, 2, 3, 4, 5))):
                    at, n, gone, out = 0, 0, 0, []
                    last = -1
                    for a, b in zip(starts or [], ends or []):
                        n += a > last
                        if a > at:
                            out.append(raw[at:a])
                        gone += max(0, b - max(a, at))
                        at, last = max(at, b), max(last, b)
                    out.append(raw[at:])
                    seen, to = 0, 0
                    for a, b in zip(m_starts or [], m_ends or []):
                        seen += max(0, b - max(a, to))
                        to = max(to, b)
                    sizes.append(len(raw))
                    removed.append(gone)
                    spans.append(n)
                    marked.append(seen)
                    kept.append(b"".join(out))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.int64()) for x in (sizes, removed, spans, marked)), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "n_marked", "kept"])

    return rows.mapInArrow(cut, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes bigint, n_removed bigint, n_spans bigint, n_marked bigint, kept binary")


def op4_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "n_marked", F.sha2("kept", 256).alias("kept_sha256"))

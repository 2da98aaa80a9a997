"""Substring dedup: content-defined chunks by a gear rolling hash, deduplicated by digest."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, or_empty, put_back, row_keys, set_aside, stored, table

MIN_CHUNK, MASK_BITS, MAX_CHUNK = 24, 5, 256
MIN_RUN = 64  # bytes of neighbouring repeated chunks from which on they are removed
GEAR = np.random.RandomState(20240229).randint(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of data.  A cut may follow each byte at which the hash of the 32 bytes so far has MASK_BITS zero
    bits on top; then MIN_CHUNK and MAX_CHUNK are kept to.  So an insertion moves the cuts near it and no others."""
    h = GEAR[np.frombuffer(data, dtype=np.uint8)]
    for s in (1, 2, 4, 8, 16):  # h = sum of GEAR[b[i - j]] << j over 32 bytes, by doubling
        more = h.copy()
        more[s:] += h[:-s] << np.uint32(s)
        h = more
    ends, last = [], 0
    for c in (np.flatnonzero((h >> np.uint32(32 - MASK_BITS)) == 0) + 1).tolist():
        while c - last > MAX_CHUNK:
            last += MAX_CHUNK
            ends.append(last)
        if c - last >= MIN_CHUNK:
            ends.append(c)
            last = c
    while len(data) - last > MAX_CHUNK:
        last += MAX_CHUNK
        ends.append(last)
    if last < len(data):
        ends.append(len(data))
    return ends


def chunk_table(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per chunk of every whole text: doc_id, k1, k2 (the row), nth, start, size (bytes), d1, d2 (digest)."""
    names = ["doc_id", "k1", "k2", "nth", "start", "size", "d1", "d2"]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                rows, nths, starts, sizes, digests = [], [], [], [], []
                for i, t in enumerate(part.column(3)):
                    data = t.as_py().encode()
                    if not data:
                        continue
                    a = 0
                    for nth, b in enumerate(cuts(data)):
                        rows.append(i)
                        nths.append(nth)
                        starts.append(a)
                        sizes.append(b - a)
                        digests.append(blake2b(data[a:b], digest_size=16).digest())
                        a = b
                d = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(j).take(at) for j in range(3)), pa.array(nths, pa.int32()), pa.array(starts, pa.int32()), pa.array(sizes, pa.int32()), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy())], names=names)

    k1, k2 = row_keys(F.col("doc_id"), F.col(text))
    return docs.select("doc_id", k1, k2, or_empty(F.col(text)).alias("t")).mapInArrow(split, f"doc_id {dict(docs.dtypes)['doc_id']}, k1 bigint, k2 bigint, nth int, start int, size int, d1 bigint, d2 bigint")


def repeated_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_bytes, n_chunks, n_dup_chunks and removed: array<struct<start, end>> in bytes of the UTF-8 text.

    Of equal chunks the one in the row with the smallest doc_id stays, there the first; the others are repeats.
    Runs of neighbouring repeats of MIN_RUN bytes or more are removed, shorter ones stay.  Null and empty texts have no
    chunks.  Rows with the same doc_id are told apart by content; rows that are repeated whole are one and each keeps its
    first chunk; a null doc_id counts last.
    Other columns stay; those named as the added ones are replaced.
    """
    columns, made = docs.columns, ["n_bytes", "n_chunks", "n_dup_chunks", "removed"]
    docs = set_aside(docs, list(dict.fromkeys(["doc_id", text])), made)
    chunks = stored(chunk_table(docs, text), "chunks")
    if dict(docs.dtypes)["doc_id"] in ("tinyint", "smallint", "int", "bigint"):
        # One number, so that the least is kept in a hash table: the doc_id, then 60 bits of the row's key.
        number = lambda c: c.cast("decimal(19,0)")
        last = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))
        rank = (number(last) * number(F.lit(2**60)) + number(F.shiftrightunsigned("k1", 4))).cast("decimal(38,0)")
    else:
        rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("k1"), F.col("k2"))
    # Counts are combined before the shuffle.
    often = chunks.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n"), F.min(rank).alias("first")).filter("n > 1").select("d1", "d2", "first")
    # Written right after the join, as Spark can split a frequent digest only where nothing above needs its rows together.
    dups = stored(chunks.join(often, ["d1", "d2"]).select("k1", "k2", "start", "size", "d1", "d2", (rank == F.col("first")).alias("home")), "repeated")
    by_row = dups.repartition("k1", "k2").distinct()
    first = F.row_number().over(Window.partitionBy("k1", "k2", "d1", "d2").orderBy("start")) == 1
    gone = by_row.withColumn("_stays", F.col("home") & first).filter(~F.col("_stays"))
    row = Window.partitionBy("k1", "k2").orderBy("start")
    apart = F.coalesce((F.lag(F.col("start") + F.col("size")).over(row) != F.col("start")).cast("int"), F.lit(1))
    runs = gone.withColumn("_apart", apart).withColumn("_run", F.sum("_apart").over(row))
    spans = runs.groupBy("k1", "k2", "_run").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("size")).alias("end"), F.count(F.lit(1)).alias("n"))
    long = F.col("end") - F.col("start") >= MIN_RUN
    per = spans.groupBy("k1", "k2").agg(F.sum("n").alias("n_dup_chunks"), F.array_sort(F.collect_list(F.when(long, F.struct("start", "end")))).alias("removed"))
    n_chunks = chunks.groupBy("k1", "k2").agg((F.max("nth") + 1).cast("long").alias("n_chunks"))
    both = stored(n_chunks.join(per, ["k1", "k2"], "left").select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "n_chunks", "n_dup_chunks", "removed"), "spans")
    discard(chunks, dups)
    k1, k2 = row_keys(F.col("doc_id"), F.col(text))
    out = docs.withColumns({"_k1": k1, "_k2": k2, "n_bytes": F.octet_length(or_empty(F.col(text))).cast("long")}).join(both, ["_k1", "_k2"], "left")
    none = F.array().cast("array<struct<start:int,end:int>>")
    return put_back(out.withColumns({"n_chunks": F.coalesce("n_chunks", F.lit(0)), "n_dup_chunks": F.coalesce("n_dup_chunks", F.lit(0)), "removed": F.coalesce("removed", none)}), columns, made)


def without_spans(found: DataFrame, text: str = "text") -> DataFrame:
    """The texts without their removed bytes; a character of which a span holds only a part stays."""
    raw = F.encode(or_empty(F.col(text)), "UTF-8")
    within = lambda at: F.conv(F.hex(F.substring(raw, at + 1, F.lit(1))), 16, 10).cast("int").between(128, 191)
    moved = lambda at, by: F.when(~F.coalesce(within(at), F.lit(False)), at).when(~within(at + by), at + by).when(~within(at + 2 * by), at + 2 * by).otherwise(at + 3 * by)
    whole = F.filter(F.transform("removed", lambda s: F.struct(moved(s["start"], 1).alias("start"), moved(s["end"], -1).alias("end"))), lambda s: s["start"] < s["end"])
    step = lambda a, s: F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(raw, a["at"] + 1, s["start"] - a["at"])).alias("out"))
    done = F.aggregate(whole, F.struct(F.lit(0).alias("at"), F.lit(b"").alias("out")), step, lambda a: F.concat(a["out"], F.substring(raw, a["at"] + 1, F.octet_length(raw))))
    return found.withColumn(text, F.decode(done, "UTF-8"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    size = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", "n_chunks", "n_dup_chunks", size.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans"))

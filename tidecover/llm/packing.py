"""Packing: concatenate and cut.

Pass 1 turns each text into token ids and notes, per partition, where each document starts; the partitions' totals,
summed up, give every document its place in one long row of tokens; pass 2 cuts that row every seq_len tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import or_empty, stored, table

ROWS = 64  # texts that are tokenised before their tokens go on, so memory doesn't grow with a batch


def default_ranks() -> str:
    """The vocabulary of byte_bpe_50k.json as ranks: the same ids, tokenised three times as fast."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_added() -> dict[str, int]:
    """The added tokens of byte_bpe_50k.json with their ids; ranks don't hold them, and tokenizers finds them in any text."""
    import json

    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


def encoder(ranks: str, added: dict[str, int]):
    """A byte-level BPE from a file of ranks; texts are split at the added tokens first."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        by_bytes = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=by_bytes, special_tokens=added)


def token_table(docs: DataFrame, text: str, ranks: str, added: dict[str, int], end_id: int) -> DataFrame:
    """doc_id, part, local_start, n, ids (little-endian uint32) per document, written to the shared folder once."""
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, part int, local_start bigint, n bigint, ids binary"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, at = encoder(ranks, added), TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                rows = batch.slice(begin, ROWS)
                ids = [enc.encode_to_numpy(t.as_py(), allowed_special="all").astype("<u4").tobytes() + end for t in rows.column(1)]
                n = np.array([len(x) // 4 for x in ids], dtype=np.int64)
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([part] * len(n), pa.int32()), pa.array(starts), pa.array(n), pa.array(ids, pa.binary())], names=["doc_id", "part", "local_start", "n", "ids"])

    return stored(docs.select("doc_id", or_empty(F.col(text)).alias("text")).mapInArrow(encode, schema), "tokens")


def pack(docs: DataFrame, text: str = "text", *, seq_len: int = 2048, ranks: str | None = None, added: dict[str, int] | None = None, end_id: int = 1) -> DataFrame:
    """One row per piece of a document in a sequence: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    ids are little-endian uint32.  Each document is its token ids and end_id; null and empty texts are end_id alone.
    added are tokens besides the ranks, found in any text; without own ranks those of byte_bpe_50k.json.
    Documents follow one another without gaps, in the order of the input's partitions, and every seq_len tokens are a
    sequence: only the last one can be short.  Repeated rows are packed as often as they come.  doc_id may be null.
    """
    if added is None:
        added = {} if ranks else default_added()
    tokens = token_table(docs, text, ranks or default_ranks(), added, end_id)
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # A row per input partition: 100 TB in splits of 128 MB are 800,000 rows or 13 MB.
    bases = F.broadcast(totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base")))
    placed = tokens.join(bases, "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("at"), "n", "ids")
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                at, n = (part.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
                first, last = at // seq_len, (at + n - 1) // seq_len
                count = last - first + 1
                row = np.repeat(np.arange(len(n)), count)
                seq = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[row]
                lo = np.maximum(seq * seq_len, at[row])
                hi = np.minimum((seq + 1) * seq_len, at[row] + n[row])
                raw = [x.as_py() for x in part.column(3)]
                ids = [raw[r][4 * s : 4 * e] for r, s, e in zip(row, lo - at[row], hi - at[row])]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(lo - at[row]), pa.array(hi - lo), pa.array(ids, pa.binary()), pa.array(n[row]), pa.array(seq), pa.array(lo - seq * seq_len)], names=names)

    return placed.mapInArrow(cut, schema)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

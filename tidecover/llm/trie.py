"""Conversation prefix trie: a node for each distinct sequence of first turns, with counts summed over subtrees.

Prefixes are named by 128 bits: the xor of hashes of each turn with its depth, so a prefix of any length comes from sums
over stretches of a conversation.  Nodes that only one conversation has hang in a chain, whose sums are plain; the others
are the shared nodes, which go to shards by the highest node above them whose subtree is small enough.  A shard gives each
digest its slot by a minimal perfect hash, checked against the digest kept there, scatters the counts into flat arrays and
adds them up through an array of parent slots, deepest first.  What shards find meets in the crown, the nodes above.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, stored, table
from .positions import positions

STRETCH = 128  # turns of a conversation that are ranked and summed at once
SHARD = 200_000  # nodes that a shard has at most, but for what hangs on one node alone
BLOCK = 1024  # ids that end at a node are joined in blocks of so many numbers
KEY = ["k1", "k2"]


class Slots:
    """A minimal perfect hash of 128-bit digests: level by level, those that meet no other in a bit array twice as long get
    their bit's rank as slot.  at() gives -1 for digests that aren't among them, as each slot keeps its digest."""

    def __init__(self, k1: np.ndarray, k2: np.ndarray):
        self.levels: list[tuple[np.ndarray, int]] = []
        left, base = np.arange(len(k1)), 0
        while len(left):
            bits = self.bit(k1[left], k2[left], len(self.levels), 2 * len(left) + 1)
            alone = np.bincount(bits, minlength=2 * len(left) + 1) == 1
            rank = np.where(alone, np.cumsum(alone) - 1, -1)
            self.levels.append((rank, base))
            base += int(alone.sum())
            left = left[~alone[bits]]
            if len(self.levels) > 200:
                raise ValueError("digests of a shard repeat")
        self.k1, self.k2 = np.empty(base, np.int64), np.empty(base, np.int64)
        slot = self.at(k1, k2, verify=False)
        self.k1[slot], self.k2[slot] = k1, k2

    @staticmethod
    def bit(k1: np.ndarray, k2: np.ndarray, level: int, size: int) -> np.ndarray:
        x = k1.astype(np.uint64) + k2.astype(np.uint64) * np.uint64(2 * level + 1)
        for shift, by in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53), (33, 1)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
        return (x % np.uint64(size)).astype(np.int64)

    def at(self, k1: np.ndarray, k2: np.ndarray, verify: bool = True) -> np.ndarray:
        slot = np.full(len(k1), -1, np.int64)
        for level, (rank, base) in enumerate(self.levels):
            open_ = np.flatnonzero(slot < 0)
            found = rank[self.bit(k1[open_], k2[open_], level, len(rank))]
            slot[open_] = np.where(found >= 0, found + base, -1)
        if verify and len(self.k1):
            held = np.maximum(slot, 0)
            slot[(self.k1[held] != k1) | (self.k2[held] != k2)] = -1
        return slot


OF_SHARD = "k1 bigint, k2 bigint, n_children bigint, n_leaves bigint, saved bigint, parent_conv bigint"


def summed(nodes: pd.DataFrame) -> pd.DataFrame:
    """A shard's nodes (k1, k2, p1, p2, depth, conv_id, n_convs, bytes, children, leaves, below) with sums over subtrees.

    children, leaves and below are what nodes outside the shard have added: children, and their subtrees' sums.
    """
    k1, k2, p1, p2, depth = (nodes[c].to_numpy() for c in ("k1", "k2", "p1", "p2", "depth"))
    slots = Slots(k1, k2)
    slot, above = slots.at(k1, k2), slots.at(p1, p2)
    above[depth == 0] = -1
    n = len(nodes)
    flat = {c: np.empty(n, np.int64) for c in ("depth", "conv_id", "children", "leaves", "saved", "parent")}
    flat["parent"][slot] = above
    for c in ("depth", "conv_id", "children", "leaves"):
        flat[c][slot] = nodes[c].to_numpy()
    flat["saved"][slot] = nodes["below"].to_numpy() + (nodes["n_convs"].to_numpy() - 1) * nodes["bytes"].to_numpy()
    inside = flat["parent"] >= 0
    np.add.at(flat["children"], flat["parent"][inside], 1)
    flat["leaves"][flat["children"] == 0] = 1
    order = np.argsort(-flat["depth"], kind="stable")
    for same in np.split(order, np.flatnonzero(np.diff(flat["depth"][order])) + 1):
        own = same[flat["parent"][same] >= 0]
        for c in ("leaves", "saved"):
            np.add.at(flat[c], flat["parent"][own], flat[c][own])
    conv = np.where(inside, flat["conv_id"][np.maximum(flat["parent"], 0)], -1)
    out = pd.DataFrame({"k1": slots.k1, "k2": slots.k2, "n_children": flat["children"], "n_leaves": flat["leaves"], "saved": flat["saved"], "parent_conv": pd.Series(conv, dtype="Int64")})
    out.loc[~inside, "parent_conv"] = pd.NA
    return out


def prefixes(turns: DataFrame) -> DataFrame:
    """c, d, last, k1, k2, p1, p2, bytes: the prefixes (digest, the one before it) of conversations given as turns
    (c, d from 1 without gaps, x1, x2: hashes of the turn, bytes) with last, the conversation's number of turns."""
    mixed = turns.select("c", "d", "last", "bytes", F.xxhash64("d", "x1", "x2").alias("z1"), F.xxhash64("x2", "x1", "d").alias("z2"), F.floor((F.col("d") - 1) / STRETCH).alias("s"))
    ahead = Window.partitionBy("c").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    sums = mixed.groupBy("c", "s").agg(*[F.bit_xor(f"z{i}").alias(f"t{i}") for i in (1, 2)])
    starts = sums.select("c", "s", *[F.coalesce(F.bit_xor(f"t{i}").over(ahead), zero).alias(f"t{i}") for i in (1, 2)])
    upto = Window.partitionBy("c", "s").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    own = mixed.select("*", *[F.bit_xor(f"z{i}").over(upto).alias(f"o{i}") for i in (1, 2)]).join(starts, ["c", "s"])
    keys = [F.col(f"o{i}").bitwiseXOR(F.col(f"t{i}")).alias(f"k{i}") for i in (1, 2)]
    return own.select("c", "d", "last", "bytes", *keys, "z1", "z2").select("c", "d", "last", "bytes", *KEY, F.col("k1").bitwiseXOR(F.col("z1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("z2")).alias("p2"))


def ends(members: DataFrame) -> DataFrame:
    """k1, k2, ends_sha256: hash of the comma-joined, ascending ids c of each digest.

    Ids are joined by blocks of numbers first; a digest with several blocks is read block by block, as its hash is one stream.
    """
    block = members.groupBy(*KEY, F.floor(F.col("c") / BLOCK).alias("b")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda x: x.cast("string")), ",").alias("ids"))
    blocks = stored(block, "ends")
    several = stored(blocks.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*KEY), "several")
    single = blocks.join(several, KEY, "left_anti").select(*KEY, F.sha2("ids", 256).alias("ends_sha256"))

    def run(batches):
        key, h = None, None
        for df in batches:
            out = []
            for k1, k2, ids in zip(df["k1"], df["k2"], df["ids"], strict=True):
                if (k1, k2) != key:
                    if key:
                        out.append((*key, h.hexdigest()))
                    key, h = (k1, k2), hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            if out:
                yield pd.DataFrame(out, columns=["k1", "k2", "ends_sha256"])
        if key:
            yield pd.DataFrame([(*key, h.hexdigest())], columns=["k1", "k2", "ends_sha256"])

    rest = blocks.join(several, KEY).repartition(*KEY).sortWithinPartitions(*KEY, "b")
    return single.unionByName(rest.select(*KEY, "ids").mapInPandas(run, "k1 bigint, k2 bigint, ends_sha256 string"))


def trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """The trie's nodes: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256 (of the ids of members that end there).

    turns: c (an integer), d (1 to last without gaps), last, x1, x2 (two hashes of the turn's content), bytes; conversations:
    c, last of every conversation, those without turns too.  saved_tokens sums, over the subtree, what all members but one of
    each node need not store.  No conversations: no nodes.
    """
    zero = F.lit(0).cast("bigint")
    rows = stored(prefixes(turns), "prefixes")
    per = rows.groupBy(*KEY).agg(F.max("d").alias("depth"), F.count(F.lit(1)).alias("n_convs"), F.min("c").alias("conv_id"), F.max("bytes").alias("bytes"), F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.sum(F.col("last") - F.col("d") + 1).alias("weight"), F.max("last").alias("last"))
    root = conversations.agg(F.count(F.lit(1)).alias("n_convs"), F.min("c").alias("conv_id")).filter("n_convs > 0")
    top = root.select(zero.alias("k1"), zero.alias("k2"), zero.alias("depth"), "n_convs", "conv_id", zero.alias("bytes"), zero.alias("p1"), zero.alias("p2"), F.lit(2**62).alias("weight"), zero.alias("last"))
    nodes = stored(per.select(top.columns).unionByName(top), "nodes")
    told = ends(rows.filter("d = last").select(*KEY, "c").unionByName(conversations.filter("last = 0").select(zero.alias("k1"), zero.alias("k2"), "c")))
    # The root counts as shared, as it belongs to no chain.
    shared = nodes.filter("n_convs > 1 or depth = 0")
    lone = nodes.filter("n_convs = 1 and depth > 0")
    chains = lone.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("children"))
    base = stored(shared.join(chains, KEY, "left").withColumn("children", F.coalesce("children", zero)).withColumns({"leaves": F.col("children"), "below": zero}), "shared")
    # Above the cut of a conversation its nodes have subtrees too large for a shard; the node below it names the shard.
    heavy = base.filter(F.col("weight") > SHARD).select(*KEY)
    cut = rows.join(heavy, KEY).groupBy("c").agg(F.max("d").alias("cut"))
    tops = rows.join(cut, "c", "left").filter(F.col("d") == F.coalesce("cut", F.lit(0)) + 1).select(F.col("c").alias("conv_id"), F.xxhash64(*KEY).alias("top"))
    light = base.filter(F.col("weight") <= SHARD)
    bins = max(1, -(-2 * light.count() // SHARD))
    placed = light.join(tops, "conv_id").withColumn("shard", F.pmod("top", F.lit(bins)))
    columns = ["k1", "k2", "p1", "p2", "depth", "conv_id", "n_convs", "bytes", "children", "leaves", "below"]
    low = stored(placed.select("shard", *columns).groupBy("shard").applyInPandas(lambda df: summed(df), OF_SHARD), "shards")
    # What hangs on the crown: the shards' highest nodes, by the crown's node above them.
    parents = light.select(*KEY, "p1", "p2").join(low, KEY).filter("parent_conv is null")
    hung = parents.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("c"), F.sum("n_leaves").alias("l"), F.sum("saved").alias("s"))
    more = base.filter(F.col("weight") > SHARD).join(hung, KEY, "left")
    crown = more.select(*columns[:8], *[(F.col(a) + F.coalesce(b, zero)).alias(a) for a, b in (("children", "c"), ("leaves", "l"), ("below", "s"))])
    high = stored(crown.withColumn("shard", F.lit(0)).select("shard", *columns).groupBy("shard").applyInPandas(lambda df: summed(df), OF_SHARD), "crown")
    sums = low.unionByName(high)
    kept = base.select(*KEY, "p1", "p2", "depth", "conv_id", "n_convs").join(sums, KEY)
    names = base.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("of_parent"))
    known = F.col("parent_conv").isNotNull() | (F.col("depth") == 0)
    inner = kept.filter(known).select(*KEY, "conv_id", "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved")
    outer = kept.filter(~known).join(names, ["p1", "p2"]).select(*KEY, "conv_id", "depth", F.col("of_parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved")
    # A chain's node has one child but for the last, and the parent of its first is shared.
    one = F.lit(1).cast("bigint")
    chain = lone.join(names, ["p1", "p2"], "left").select(*KEY, "conv_id", "depth", F.coalesce("of_parent", "conv_id").alias("parent_conv_id"), "n_convs", F.when(F.col("depth") < F.col("last"), one).otherwise(zero).alias("n_children"), one.alias("n_leaves"), zero.alias("saved"))
    every = inner.unionByName(outer).unionByName(chain).join(told, KEY, "left")
    return every.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def rebuilt(table_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """turns and conversations for trie(): each conversation c begins with the first h = crc32(c) % 9 turns of c - c % 5.

    Turns are ordered by turn (null first), role, then a hash of the text; null roles and texts are empty; rows with a null
    conv_id belong to no conversation and go.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = table_.filter("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("c"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"), F.xxhash64(role, text).alias("x1"), F.xxhash64(text, role, F.lit(1)).alias("x2"), F.octet_length(text).cast("bigint").alias("bytes"))
    placed = stored(positions(turns, ["c"], F.col("turn"), [F.asc_nulls_first("turn"), F.col("role"), F.col("x1"), F.col("x2")], STRETCH).select("c", "at", "x1", "x2", "bytes"), "placed")
    h = (F.crc32(F.col("c").cast("string")) % 9).alias("h")
    sizes = placed.groupBy("c").agg(F.count(F.lit(1)).alias("n")).select("c", "n", h, (F.col("c") - F.col("c") % 5).alias("base"))
    bases = sizes.select(F.col("c").alias("base"), F.col("n").alias("m"))
    kept = F.least("h", F.coalesce("m", F.lit(0).cast("bigint"))).alias("kept")
    per = stored(sizes.join(bases, "base", "left").select("c", "h", "base", kept, "n").select("c", "h", "base", "kept", (F.col("kept") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("last")), "sizes")
    own = placed.filter("at > 0").join(per.select("c", "h", "kept", "last"), "c").filter("at > h").select("c", (F.col("at") - F.col("h") + F.col("kept")).alias("d"), "last", "x1", "x2", "bytes")
    first = placed.filter("at <= 8").withColumnRenamed("c", "base").join(per, "base").filter("at <= h").select("c", F.col("at").alias("d"), "last", "x1", "x2", "bytes")
    return own.unionByName(first), per.select("c", "last")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, conversations = rebuilt(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return trie(turns, conversations)

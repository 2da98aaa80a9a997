"""Sharding: size-tiered compaction of immutable runs under an atomically committed, versioned manifest."""

from __future__ import annotations

import time
import uuid
from math import floor, log

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, set_conf, table

FAN_IN = 4  # so many runs of one tier become one run of the next
TARGET_BYTES = 128 << 20
UNIT_BYTES = 1 << 20  # runs of up to FAN_IN times this are of tier 0
KEEP_VERSIONS = 2  # the live version and those before it whose runs stay for their readers
LEASE_S = 600  # a claim that is older is taken over
ORPHAN_S = 86_400  # what no version names goes once nothing in it has changed for so long


def packed_reads(spark: SparkSession, target: int):
    """Within, a scan puts whole small files together, by size, until a task has target bytes."""
    return set_conf(spark, {"spark.sql.files.maxPartitionBytes": str(target), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"})


class Store:
    """A folder of runs (folders of Parquet shards, never changed once written) and versions of a manifest.

    A version is a folder of Parquet with a row per live shard.  It is written aside; of two writers who both follow the
    same version, one can create the next one's claim file, and that one renames its folder into place, which is atomic.
    So readers see whole versions only.  A writer lost between claim and rename leaves a claim that others take over, by
    the file of the next attempt, once it is LEASE_S old; a writer whose claim was taken over doesn't publish.  Readers of
    the last KEEP_VERSIONS versions find all their runs.  Texts of any length are rows like others: they are never read in
    one piece but by Spark's own reader and writer.  What a lost writer leaves goes with a later compaction (sweep).
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.lease_s, self.orphan_s = spark, root, LEASE_S, ORPHAN_S
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def version(self) -> int:
        folder = self.path("manifest")
        if not self.fs.exists(folder):
            return 0
        return max([0, *(int(s.getPath().getName()[1:]) for s in self.fs.listStatus(folder) if s.getPath().getName().startswith("v"))])

    def manifest(self, version: int | None = None) -> DataFrame:
        v = self.version() if version is None else version
        if not v:
            return self.spark.createDataFrame([], "run string, tier int, shard string, n_bytes bigint, n_rows bigint, digest bigint")
        return self.spark.read.parquet(f"{self.root}/manifest/v{v:08d}")

    def runs(self, version: int | None = None) -> list[str]:
        """Live runs: FAN_IN per tier at most once compacted, however large the data."""
        return sorted(r[0] for r in self.manifest(version).select("run").distinct().collect())

    def size(self, run: str) -> int:
        return self.fs.getContentSummary(self.path("runs", run)).getLength()

    def describe(self, runs: list[str], tiers: dict[str, int]) -> DataFrame:
        """A row per shard: run, tier, shard, n_bytes, n_rows and the sum (exclusive or) of the rows' hashes."""
        df = self.spark.read.parquet(*[f"{self.root}/runs/{r}" for r in runs])
        cols = df.columns
        at = F.col("_metadata.file_path")
        rows = df.select(F.regexp_extract(at, r"/runs/([^/]+)/", 1).alias("run"), F.col("_metadata.file_name").alias("shard"), F.col("_metadata.file_size").alias("n_bytes"), F.xxhash64(*cols).alias("h"))
        tier = F.create_map(*[x for r in runs for x in (F.lit(r), F.lit(tiers[r]))])
        per = rows.groupBy("run", "shard", "n_bytes").agg(F.count(F.lit(1)).alias("n_rows"), F.bit_xor("h").alias("digest"))
        return per.select("run", F.element_at(tier, F.col("run")).alias("tier"), "shard", "n_bytes", "n_rows", "digest")

    def commit(self, shards: DataFrame, base: int) -> int:
        """Publishes shards as the version after base, the one that they were made from; fails where that is taken."""
        v = base + 1
        aside = f"_{uuid.uuid4().hex}"
        shards.coalesce(1).write.parquet(f"{self.root}/manifest/{aside}")
        attempt = self.claim(v)
        if self.claims(v)[-1][0] != attempt:
            raise RuntimeError(f"version {v} was taken over by another writer")
        at = f"v{v:08d}"
        done = not self.fs.exists(self.path("manifest", at)) and self.fs.rename(self.path("manifest", aside), self.path("manifest", at))
        # A file system may move a folder into one that came into being meanwhile and call that a success.
        inside = self.path("manifest", at, aside)
        if self.fs.exists(inside):
            self.fs.delete(inside, True)
            done = False
        if not done:
            raise RuntimeError(f"version {v} was published by another writer")
        return v

    def claims(self, v: int) -> list[tuple[int, float]]:
        """Attempts to publish version v, with the seconds since each began."""
        names = [(s.getPath().getName(), s.getModificationTime()) for s in self.fs.listStatus(self.path("manifest"))]
        return sorted((int(n.rpartition("-")[2]), time.time() - at / 1000) for n, at in names if n.startswith(f"_claim{v:08d}-"))

    def claim(self, v: int) -> int:
        """The number of the own attempt; of all writers one gets each number, and a new one only once the last ran out."""
        known = self.claims(v)
        taken = self.fs.exists(self.path("manifest", f"v{v:08d}")) or (known and known[-1][1] < self.lease_s)
        attempt = known[-1][0] + 1 if known else 0
        if taken or not self.fs.createNewFile(self.path("manifest", f"_claim{v:08d}-{attempt}")):
            raise RuntimeError(f"version {v} was committed by another writer")
        return attempt

    def tier_of(self, run: str) -> int:
        """The power of FAN_IN of a run's size over UNIT_BYTES, whatever other runs there are."""
        return max(0, floor(log(max(self.size(run), 1) / UNIT_BYTES, FAN_IN)))

    def age(self, status) -> float:
        """Seconds since the last change of a file or of anything in a folder."""
        last, files = status.getModificationTime(), self.fs.listFiles(status.getPath(), True) if status.isDirectory() else None
        while files is not None and files.hasNext():
            last = max(last, files.next().getModificationTime())
        return time.time() - last / 1000

    def sweep(self) -> None:
        """Removes what lost writers have left: runs that no kept version names, arrivals, manifests set aside and claims of
        published versions, each once it is orphan_s old."""
        last = self.version()
        kept = {r for v in range(max(1, last - KEEP_VERSIONS + 1), last + 1) for r in self.runs(v)}

        def lost(folder: str, is_lost) -> None:
            where = self.path(folder) if folder else self.path()
            for s in self.fs.listStatus(where) if self.fs.exists(where) else []:
                if is_lost(s.getPath().getName()) and self.age(s) >= self.orphan_s:
                    self.fs.delete(s.getPath(), True)

        lost("runs", lambda n: n not in kept)
        lost("", lambda n: n.startswith("arriving-"))
        lost("manifest", lambda n: n.startswith("_") and not (n.startswith("_claim") and int(n[6:14]) > last))

    def expire(self) -> None:
        """Removes the manifests before the last KEEP_VERSIONS and the runs that only they have, then what writers lost."""
        last = self.version()
        old = [v for v in range(1, last - KEEP_VERSIONS + 1) if self.fs.exists(self.path("manifest", f"v{v:08d}"))]
        kept = {r for v in range(max(1, last - KEEP_VERSIONS + 1), last + 1) for r in self.runs(v)}
        for v in old:
            for r in self.runs(v):
                if r not in kept:
                    self.fs.delete(self.path("runs", r), True)
            self.fs.delete(self.path("manifest", f"v{v:08d}"), True)
        self.sweep()

    def append(self, arrivals: DataFrame, batch: str) -> int:
        """Adds arrivals as one run per value of the column batch, of small shards: a job without a shuffle.

        batch isn't stored; a null is a batch too.  Rows may be repeated or null in any column; an empty table adds none.
        """
        name = uuid.uuid4().hex[:12]
        arrivals.write.partitionBy(batch).parquet(f"{self.root}/arriving-{name}")
        new = []
        self.fs.mkdirs(self.path("runs"))
        for s in sorted(self.fs.listStatus(self.path(f"arriving-{name}")), key=lambda s: s.getPath().getName()):
            if s.isDirectory():
                run = f"{name}-{s.getPath().getName().split('=')[1]}"
                self.fs.rename(s.getPath(), self.path("runs", run))
                new.append(run)
        self.fs.delete(self.path(f"arriving-{name}"), True)
        if not new:  # an empty table
            return self.version()
        fresh = self.describe(new, {r: self.tier_of(r) for r in new})
        base = self.version()
        return self.commit(self.manifest().unionByName(fresh) if base else fresh, base)

    def compact(self, target: int = TARGET_BYTES) -> int:
        """Merges FAN_IN or more runs of one tier into one run of shards of about target bytes, until no tier has as many.

        A run's tier is the power of FAN_IN of its size over UNIT_BYTES.  Each merge is checked (rows and digest) before its
        version is committed; the merged runs go once no kept version has them.
        """
        while True:
            base = self.version()
            tiers: dict[int, list[str]] = {}
            for r in self.runs():
                tiers.setdefault(self.tier_of(r), []).append(r)
            full = [(t, rs) for t, rs in sorted(tiers.items()) if len(rs) >= FAN_IN]
            if not full:
                return self.version()
            tier, old = full[0]
            run = f"t{tier + 1}-{uuid.uuid4().hex[:12]}"
            with packed_reads(self.spark, target):
                self.spark.read.parquet(*[f"{self.root}/runs/{r}" for r in old]).write.parquet(f"{self.root}/runs/{run}")
            manifest = self.manifest()
            gone = F.col("run").isin(old)
            made = self.describe([run], {run: self.tier_of(run)})
            total = lambda df: df.agg(F.sum("n_rows"), F.bit_xor("digest")).first()
            if tuple(total(made)) != tuple(total(manifest.filter(gone))):
                raise RuntimeError("a merge lost or changed rows")
            self.commit(manifest.filter(~gone).unionByName(made), base)
            self.expire()


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in eight batches and are compacted; the last manifest, a row per live shard."""
    store = Store(spark, fresh_path(spark, "store"))
    docs = table(spark, sf_dir, "documents")
    batch = "_arrival"
    while batch in docs.columns:
        batch += "_"
    store.append(docs.withColumn(batch, F.pmod(F.xxhash64("doc_id", "text"), F.lit(2 * FAN_IN))), batch)
    store.compact()
    version = store.version()
    return store.manifest().select(F.lit(version).alias("version"), "run", "tier", "shard", "n_bytes", "n_rows", "digest")

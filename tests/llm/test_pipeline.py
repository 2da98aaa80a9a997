import re

from pyspark.sql import functions as F

import corpus_pipeline as P
from tidecover.llm.common import stored

DATA = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = P.table(spark, DATA, "documents")
    seen = {}
    for name, stage in P.STAGES:
        out = stored(stage(spark, docs, DATA), "stage")
        seen[name] = (docs, out)
        if name != "packing":
            assert out.columns == docs.columns and out.count() <= docs.count()
        docs = out
    before, after = seen["quality rules"]
    kept = {r.doc_id for r in after.select("doc_id").collect()}
    for r in before.collect():
        if len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) < 50:
            assert r.doc_id not in kept
    packed = seen["packing"][1].groupBy("sequence_id").agg(F.sum("length").alias("n")).orderBy(F.desc("sequence_id")).collect()
    assert all(r.n == 2048 for r in packed[1:])
    assert [len(f) for f in P.STAGES] == [2] * 5


def test_empty_table(spark):
    docs = P.table(spark, DATA, "documents").limit(0)
    for _, stage in P.STAGES:
        docs = stored(stage(spark, docs, DATA), "stage")
    assert docs.count() == 0

"""The corpus pipeline: stages on odd inputs, and the whole against brute force."""

from __future__ import annotations

import re
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F
from test_dealt import SCHEMA, brute_components, odd_rows

from driftloom.llm import mixing, oracle, queries, toxicity

DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "n-gram Jaccard join", "mixing sources", "BPE encoding"]
    names = list(queries.queries())
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))
    assert set(oracle.oracle_sql()) <= set(names)


def test_every_stage_takes_odd_and_empty_documents(spark, sf):
    odd = spark.createDataFrame(odd_rows(), SCHEMA).withColumn("copies", F.lit(1)).withColumn("text_sha256", F.lit("x"))
    for df in (odd, odd.filter("false")):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, df, sf)
            rows = out.collect()
            assert bool(rows) == bool(df.count())
            if k < 4:
                assert out.columns == df.columns


def test_run_equals_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter(~toxicity.held_out("doc_id"))
    scores = toxicity.score(spark.read.parquet(f"{sf}/documents.parquet"), toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), labels))
    toxic = {r["doc_id"] for r in scores.filter("predicted = 1").collect()}
    left = [r for r in docs if r["doc_id"] not in toxic]
    groups = {}
    for r in left:
        key = re.sub(r"[\x20\x09-\x0D]+", "", r["text"])
        best = groups.get(key)
        if best is None or (-len(r["text"]), r["doc_id"]) < (-len(best["text"]), best["doc_id"]):
            groups[key] = r
    left = list(groups.values())
    stay = {d for d, _, c in brute_components([(r["doc_id"], r["text"]) for r in left]) if d == c}
    left = [r for r in left if r["doc_id"] in stay]
    plan = mixing.plan(spark.createDataFrame(left, SCHEMA))
    want = Counter({r["doc_id"]: r["copies"] for r in plan.collect() if r["copies"]})
    got = corpus_pipeline.run(spark, sf).collect()
    assert Counter(r["doc_id"] for r in got) == want
    assert all(len(r["ids"]) == 4 * r["n_tokens"] for r in got)

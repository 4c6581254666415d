"""The corpus pipeline: stages that each apply one operator to all that the stage before kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from driftloom.llm import bpe, exact_dedup, jaccard, mixing, toxicity
from driftloom.llm.scratch import materialise, release

#: Group of the written tables that a stage needs only until its own output is written.
OWNER = "pipeline"


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the multiple-instance model, learnt from the labels' training part, calls toxic go."""
    release(OWNER)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~toxicity.held_out("doc_id"))
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels, owner=OWNER))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space one stays."""
    release(OWNER)
    return exact_dedup.keep_one(docs, owner=OWNER)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id."""
    release(OWNER)
    return jaccard.keep_one(docs, owner=OWNER)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document comes as often as the mix takes it."""
    release(OWNER)
    return mixing.mix(docs, owner=OWNER)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the decoded text."""
    release(OWNER)
    return bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), keep=("ids",))


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact dedup", exact_dedup_stage),
    ("n-gram Jaccard join", jaccard_stage),
    ("mixing sources", mixing_stage),
    ("BPE encoding", bpe_stage),
]

#: SQL can express neither the learnt classifier nor the tokenizer: tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "pipeline output")
    return STAGES[-1][1](spark, docs, sf_dir)

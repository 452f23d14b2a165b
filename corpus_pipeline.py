"""Corpus pipeline: classify, deduplicate, decontaminate, mix and shard ``documents``.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the
next one's docs, after which the one before it is removed.  All but the last return the columns
of ``documents``.

Defined results: the first stage judges null and empty texts as texts without words, all alike,
and no other stage drops them for being so; rows that repeat an id are rows of their own, and of equal rows one stays; no text is too
long for a stage; an empty table passes through as an empty one; other columns fall away.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.decontaminate import decontaminate
from quern.llm.mixing import mix_sources, number_domain
from quern.llm.near_dedup import drop_near_duplicates
from quern.llm.quality import classify, train
from quern.llm.queries import MIX_DOMAINS, MIX_LANGS, bad_labels, table
from quern.llm.sharding import shard
from quern.llm.state import checkpoint_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    model = train(docs, bad_labels(spark, sf_dir))
    return classify(docs, model).where("accepted").select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (5-word shingles, similarity 0.8) stays: the one with the smallest id."""
    return drop_near_duplicates(docs.select(*COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).where("NOT contaminated").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document is repeated for each epoch that uses it."""
    return mix_sources(docs, number_domain(F.col("source")), domain_weights=MIX_DOMAINS, lang_weights=MIX_LANGS, budget_share=0.8, max_epochs=2, seed=17).select(*COLUMNS)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The compacted store's rows with the shard that holds them."""
    return shard(docs).read(shard_col="shard")


STAGES = [
    ("quality classifier", quality_stage),
    ("near-duplicate removal", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("source mixing", mixing_stage),
    ("sharding", sharding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    files = spark._jvm.org.apache.hadoop.fs.Path(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        if k:
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{k - 1}"), True)
    return docs


#: The stages train, sign and hash beyond what SQL can state; tests/llm/test_pipeline.py holds each against a plain version.
ORACLE_SQL = None

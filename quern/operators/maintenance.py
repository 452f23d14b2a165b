"""Idempotent appends, work lists, prune plans, versioned BM25 artefacts, guarded results."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.config import Config
from quern.functions.text import is_noise
from quern.operators.retrieval import Index, postings, term_bucket


def new_rows(stored: DataFrame, arriving: DataFrame, key: str = "chunk_id", order: str | None = None) -> DataFrame:
    """Arriving rows whose key is not stored, each key once (the first in order)."""
    by = [F.col(order)] if order else [F.xxhash64(*[F.col(f"`{c}`") for c in arriving.columns])]  # no order given: any, but the same on every run
    once = arriving.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*by))).where("_n = 1").drop("_n")
    return once.join(stored.select(key), key, "left_anti")


def append(stored: DataFrame, arriving: DataFrame, key: str = "chunk_id", section: str = "section", order: str | None = None) -> DataFrame:
    """The stored rows and the new ones, without noise sections."""
    return stored.unionByName(new_rows(stored, arriving.where(~is_noise(F.col(section))), key, order))


def todo(items: DataFrame, done: DataFrame, key: str, only: list | None = None, within: str | None = None, limit: int | None = None) -> DataFrame:
    """Items without a result yet, perhaps of some groups only and the first few."""
    rest = items.join(done.select(key), key, "left_anti")
    if only is not None:
        rest = rest.where(F.col(within).isin(*only))
    return rest.orderBy(key).limit(limit) if limit else rest


def reindex_figures(chunks: DataFrame, figures: DataFrame, key: str = "chunk_id", paper: str = "doc_id") -> DataFrame:
    """Chunks with the figures put in anew: old figure chunks go first, then figures of papers that have text come in."""
    text = chunks.join(figures.select(key), key, "left_anti")
    known = figures.join(text.select(paper).distinct(), paper, "left_semi")
    return text.unionByName(known.select(text.columns))


def prune_plan(files: DataFrame, indexed: DataFrame, figured: DataFrame | None = None) -> DataFrame:
    """files(doc_id, bytes): what could go and why, with counts and bytes. Nothing is removed here."""
    unused = files.join(indexed, "doc_id", "left_anti").withColumn("reason", F.lit("not indexed"))
    if figured is not None:
        unused = unused.unionByName(files.join(indexed, "doc_id", "left_semi").join(figured, "doc_id", "left_anti").withColumn("reason", F.lit("no figures")))
    return unused.groupBy("reason").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))


def augmented(base: DataFrame, extra: DataFrame, name: str = "augmented") -> DataFrame:
    """Two corpora in one table: the base, and the base with more rows."""
    return base.withColumn("corpus_id", F.lit("base")).unionByName(base.unionByName(extra).withColumn("corpus_id", F.lit(name)))


# --- BM25 artefacts ---
#: About so many bytes of text make a posting.
BYTES_A_POSTING = 8


def write_index(docs: DataFrame, path: str, cfg: Config, stemmed: bool, rows_a_bucket: int = 4_000_000) -> None:
    """Postings, term statistics and the stamp of a corpus that is stored elsewhere."""
    spark = docs.sparkSession
    stamp_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_meta")
    stamp_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(stamp_path, True)
    n, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    buckets = max(1, min(4096, size // BYTES_A_POSTING // rows_a_bucket))
    keyed = postings(docs, stemmed=stemmed).withColumn("bucket", term_bucket(buckets))
    spread = keyed.repartition(buckets, "bucket") if buckets > 1 else keyed
    spread.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    index = Index.of(spark.read.parquet(f"{path}/postings"), n, cfg, stemmed)
    index.terms.write.mode("overwrite").parquet(f"{path}/term_stats")
    stamp = {"tokenizer": cfg.tokenizer_version, "n_docs": n, "stemmed": stemmed, "avgdl": index.avgdl, "buckets": buckets}
    spark.createDataFrame([(json.dumps(stamp),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_meta")


def save_bm25(docs: DataFrame, path: str, cfg: Config | None = None, stemmed: bool = True, rows_a_bucket: int = 4_000_000) -> None:
    """Writes the corpus, postings (a folder for each bucket of terms, sorted by term), term statistics and a stamp.

    The stamp goes first and is written last: without it the artefact counts as missing."""
    docs.write.mode("overwrite").parquet(f"{path}/corpus")
    write_index(docs.sparkSession.read.parquet(f"{path}/corpus"), path, cfg or Config(), stemmed, rows_a_bucket)


def read_stamp(spark: SparkSession, path: str) -> dict:
    """The stamp, or none: an artefact without one is of the first tokenizer."""
    from pyspark.errors import AnalysisException

    try:
        return json.loads(spark.read.text(f"{path}/_meta").first()[0])
    except AnalysisException:
        return {"tokenizer": "1-split", "n_docs": None, "stemmed": False}


def open_bm25(spark: SparkSession, path: str, cfg: Config | None = None) -> tuple[Index, bool]:
    """(index, whether it was rebuilt). A stamp of another tokenizer, or none, rebuilds all but the stored corpus."""
    cfg = cfg or Config()
    stamp = read_stamp(spark, path)
    rebuilt = stamp["tokenizer"] != cfg.tokenizer_version or "buckets" not in stamp
    if rebuilt:
        write_index(spark.read.parquet(f"{path}/corpus"), path, cfg, True)
        stamp = read_stamp(spark, path)
    return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/term_stats"), stamp["n_docs"], stamp["avgdl"], stamp["stemmed"], stamp["buckets"]), rebuilt


def load_bm25(spark: SparkSession, path: str, cfg: Config | None = None) -> tuple[DataFrame, DataFrame, int, bool]:
    """(postings, term statistics, documents, whether it was rebuilt)."""
    index, rebuilt = open_bm25(spark, path, cfg)
    return index.postings.drop("bucket"), index.terms, index.n, rebuilt


def write_guarded(rows: DataFrame, path: str, size: int, limited: bool = False, force: bool = False) -> str:
    """Writes results as JSON beside their size; a limited run goes elsewhere, and a smaller one never replaces a larger one unless forced."""
    from pyspark.errors import AnalysisException

    spark = rows.sparkSession
    to = f"{path}_limited" if limited else path
    try:
        before = spark.read.json(f"{to}/_size").first()["size"]
    except AnalysisException:
        before = 0
    if before > size and not force:
        raise ValueError(f"{to} holds a run of {before}; {size} is smaller")
    rows.write.mode("overwrite").json(f"{to}/rows")
    spark.createDataFrame([(size,)], "size long").coalesce(1).write.mode("overwrite").json(f"{to}/_size")
    return to

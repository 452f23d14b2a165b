"""Readers and writers of retrieval corpora, cases and results. Schemas are given, never inferred."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.types as T
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions.text import as_list, collapse

PAPER = "arxiv_id string, title string, authors array<string>, abstract string, categories array<string>, published string, pdf_url string, entry_url string"
CASE = "id string, tag string, query string, relevant array<string>, source string, answer_anchors array<string>"
FIGURE = "figure_id string, arxiv_id string, page int, kind string, label string, caption string, image_path string, bbox array<double>, n_drawings int, n_images int, ink double"
CORPUS = "_id string, title string, text string"
QUERY = "_id string, text string"
QREL = "query_id string, corpus_id string, score int"


def papers(spark: SparkSession, path: str, ids: list[str] | None = None) -> DataFrame:
    """Paper metadata as JSON lines; the id is the last part of the entry's address, newlines in abstracts become spaces."""
    rows = spark.read.schema(PAPER).json(path)
    rows = rows.withColumn("arxiv_id", F.coalesce("arxiv_id", F.element_at(F.split("entry_url", "/"), -1))).withColumn("abstract", F.translate("abstract", "\n", " "))
    return rows.where(F.col("arxiv_id").isin(*ids)) if ids is not None else rows


def binary_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def benchmark(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(corpus, queries, qrels) of a benchmark folder: two JSON-lines files and a tab-separated one."""
    corpus = spark.read.schema(CORPUS).json(f"{path}/corpus.jsonl").select(F.col("_id").alias("doc_id"), "title", "text")
    queries = spark.read.schema(QUERY).json(f"{path}/queries.jsonl").select(F.col("_id").alias("query_id"), "text")
    qrels = spark.read.schema(QREL).option("sep", "\t").csv(f"{path}/qrels.tsv").where("score IS NOT NULL")
    return corpus, queries, qrels.select("query_id", F.col("corpus_id").alias("doc_id"), F.col("score").alias("rel"))


def write_benchmark(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, path: str) -> int:
    """Writes the three parts and returns the number of judged queries."""
    corpus.select(F.col("doc_id").alias("_id"), "title", "text").write.mode("overwrite").json(f"{path}/corpus.jsonl")
    queries.select(F.col("query_id").alias("_id"), "text").write.mode("overwrite").json(f"{path}/queries.jsonl")
    qrels.select("query_id", F.col("doc_id").alias("corpus_id"), F.col("rel").alias("score")).write.mode("overwrite").option("sep", "\t").csv(f"{path}/qrels.tsv")
    return qrels.agg(F.count_distinct("query_id")).first()[0]


def gold_lists(questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queries, qrels) of questions(pos, query, gold array): one qrel of grade 1 for each gold id, query ids by position."""
    named = questions.select(F.concat(F.lit("q"), F.col("pos").cast("string")).alias("query_id"), F.col("query").alias("text"), "gold")
    return named.select("query_id", "text"), named.select("query_id", F.explode(F.col("gold").cast("array<string>")).alias("doc_id"), F.lit(1).alias("rel"))


def excluded(questions: DataFrame) -> DataFrame:
    """(query_id, doc_id) that must not count, of questions(query_id, excluded string or list)."""
    listed = questions.select("query_id", F.explode(as_list(F.col("excluded"))).alias("doc_id"))
    return listed.where((F.col("doc_id") != "") & (F.col("doc_id") != "N/A"))


def without_excluded(runs: DataFrame, left_out: DataFrame) -> DataFrame:
    return runs.join(left_out, ["query_id", "doc_id"], "left_anti")


def paragraphs(documents: DataFrame, least: int = 40) -> DataFrame:
    """(paper_id, doc_id, title, text) of documents(paper_id, full_text array<struct<section_name, paragraphs>>)."""
    secs = documents.select("paper_id", F.posexplode("full_text").alias("s", "sec"))
    paras = secs.select("paper_id", "s", F.col("sec.section_name").alias("title"), F.posexplode("sec.paragraphs").alias("p", "text"))
    return paras.where(F.length("text") >= least).select("paper_id", F.concat("paper_id", F.lit("-s"), "s", F.lit("-p"), "p").alias("doc_id"), "title", "text")


def evidence_qrels(paras: DataFrame, evidence: DataFrame, prefix: int = 120) -> DataFrame:
    """(query_id, doc_id, rel) where the beginning of an evidence text stands in a paragraph of the same paper."""
    asked = evidence.withColumn("head", F.substring("evidence", 1, prefix)).where(F.col("head") != "").select("paper_id", "query_id", "head").distinct()
    met = asked.join(paras, "paper_id").where(F.contains(F.col("text"), F.col("head")))
    return met.select("query_id", "doc_id", F.lit(1).alias("rel")).distinct()


def cases(spark: SparkSession, path: str, tag: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(positives, negatives): a JSON array of labelled cases; those without relevant sources are negatives."""
    rows = spark.read.option("multiLine", True).schema(CASE).json(path)
    rows = rows.where(F.col("tag") == tag) if tag else rows
    some = F.size(F.coalesce("relevant", F.array().cast("array<string>"))) > 0
    return rows.where(some), rows.where(~some)


SPAN = "doc_id string, page int, block_no int, line_no int, span_no int, text string, size double, bold boolean"


_LINE = ["doc_id", "page", "block_no", "line_no"]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring spans of one line, in ascending order, as one row: the size and weight of the first, numbers and texts of all."""
    for b in batches:
        if not b.num_rows:
            continue
        after, before = b.slice(1), b.slice(0, b.num_rows - 1)
        new = pc.fill_null(pc.less_equal(after["span_no"], before["span_no"]), True)
        for c in _LINE:
            new = pc.or_(new, pc.fill_null(pc.not_equal(after[c], before[c]), True))
        start = np.concatenate([[0], np.flatnonzero(new.to_numpy(zero_copy_only=False)) + 1])
        ends = pa.array(np.append(start, b.num_rows), pa.int32())
        first = b.select([*_LINE, "size", "bold"]).take(pa.array(start))
        yield pa.RecordBatch.from_arrays([*first.columns, *(pa.ListArray.from_arrays(ends, b[c]) for c in ("span_no", "text"))], [*first.schema.names, "span_no", "text"])


def lines(spans: DataFrame) -> DataFrame:
    """(doc_id, line_no, text, size, bold) of spans(doc_id, page, block_no, line_no, span_no, text, size, bold), as a PDF
    reader gives them: texts joined in order, size and weight of the first span, empty lines out, numbered through the document."""
    kind = spans.schema
    piece = T.StructType([*(kind[c] for c in (*_LINE, "size", "bold")), T.StructField("span_no", T.ArrayType(kind["span_no"].dataType)), T.StructField("text", T.ArrayType(T.StringType()))])
    met = spans.select(*_LINE, "span_no", "text", "size", "bold").mapInArrow(_pieces, T.StructType([T.StructField(f.name, f.dataType) for f in piece])).repartition("doc_id")  # for both steps
    first = F.struct(F.col("span_no")[0], F.col("text")[0], "size", "bold")
    parts = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("span_no", "text"))))
    grouped = met.groupBy(*_LINE).agg(F.min_by("size", first).alias("size"), F.min_by("bold", first).alias("bold"), parts.alias("s"))
    joined = grouped.select(*_LINE, F.trim(F.array_join(F.transform("s", lambda x: x["text"]), "")).alias("text"), "size", "bold")
    order = Window.partitionBy("doc_id").orderBy("page", "block_no", "line_no")
    return joined.where("text <> ''").select("doc_id", (F.row_number().over(order) - 1).alias("n"), "text", "size", "bold").withColumnRenamed("n", "line_no")


def parse_many(files: DataFrame, parse: Callable[[str, bytes], list[str]], id_col: str = "path", data_col: str = "content") -> DataFrame:
    """(id, chunks, error): ``parse`` on each input by itself; one that raises gives its error, not the end of the run."""
    schema = T.StructType([T.StructField("id", files.schema[id_col].dataType), T.StructField("chunks", T.ArrayType(T.StringType())), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            chunks, errors = [], []
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    chunks.append(list(parse(name, data)))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 - whatever a parser does is a result here
                    chunks.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(chunks, pa.list_(pa.string())), pa.array(errors, pa.string())], ["id", "chunks", "error"])

    return files.select(id_col, data_col).mapInArrow(run, schema)


def write_json(rows: DataFrame, path: str, key: str) -> None:
    """A table of results (figure manifests, descriptions, measurements) as JSON lines, sorted by its key within files."""
    rows.repartitionByRange(F.col(key)).sortWithinPartitions(key).write.mode("overwrite").json(path)


def review_report(drafts: DataFrame) -> DataFrame:
    """(place, value): a review file of drafts(id, query, verdict), the doubtful ones first; ``review_rows`` reads it back once KEEP or DROP is decided."""
    order = F.when(F.col("verdict") == "MISS", 0).when(F.col("verdict") == "AMBIG", 1).otherwise(2)
    mark = F.when(F.col("verdict") == "OK", "KEEP").otherwise("DROP")
    return drafts.select(F.struct(order.alias("o"), "id").alias("place"), F.concat(F.lit("- ["), mark, F.lit("] "), "id", F.lit("  ("), "verdict", F.lit(") "), "query").alias("value"))


def figures(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).schema(FIGURE).json(path).dropDuplicates(["figure_id"])


def keyed_cache(spark: SparkSession, path: str, value: str) -> DataFrame:
    """A JSON object of results by key as rows (figure_id, value...)."""
    whole = spark.read.option("wholetext", True).text(path)
    entry = F.explode(F.map_entries(F.from_json("value", f"map<string,struct<{value}>>"))).alias("e")
    return whole.select(entry).select(F.col("e.key").alias("figure_id"), "e.value.*")


def export_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks as JSON lines in order of their ids."""
    chunks.orderBy("chunk_id").write.mode("overwrite").json(path)


def parse_cases(drafts: DataFrame) -> DataFrame:
    """Drafted cases in a model's answer: the first JSON list of it; malformed ones give no rows."""
    found = F.from_json(F.regexp_extract("answer", r"(?s)(\[.*\])", 1), "array<struct<tag:string,query:string>>")
    return drafts.select("doc_id", F.posexplode(found).alias("pos", "c")).select("doc_id", "pos", "c.tag", collapse(F.col("c.query")).alias("query"))


def review_rows(report: DataFrame) -> DataFrame:
    """(id, keep) of a review file's lines ``KEEP id`` and ``DROP id``."""
    mark = r"^\s*[-*]?\s*\[?(KEEP|DROP)\]?\s+(\S+)"
    return report.where(F.col("value").rlike(mark)).select(F.regexp_extract("value", mark, 2).alias("id"), (F.regexp_extract("value", mark, 1) == "KEEP").alias("keep"))


def promote(cases_now: DataFrame, drafts: DataFrame, reviewed: DataFrame) -> DataFrame:
    """The cases and the drafts marked to keep whose ids are new."""
    fresh = drafts.join(reviewed.where("keep").select("id"), "id", "left_semi").join(cases_now.select("id"), "id", "left_anti")
    return cases_now.unionByName(fresh, allowMissingColumns=True)

"""Context blocks, citation checks, response payloads, corpus reports."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.config import Config
from quern.functions.text import strip_cites

UNTRUSTED = ("<<<untrusted excerpt>>>", "<<<end of excerpt>>>")


def context_block(hits: DataFrame) -> DataFrame:
    """(query_id, context) of hits(query_id, rank, title, published, section, text): numbered excerpts in order of rank."""
    part = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("title", F.lit("")), F.lit(" ("), F.coalesce("published", F.lit("")), F.lit(") — "), F.coalesce("section", F.lit("")), F.lit("\n"), strip_cites(F.coalesce("text", F.lit(""))))
    listed = F.array_sort(F.collect_list(F.struct("rank", part.alias("part"))))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(listed, lambda x: x["part"]), "\n\n---\n\n").alias("context"))


def citations(answer: Column, n_hits: Column) -> Column:
    """The distinct excerpt numbers that an answer cites and that exist, ascending."""
    found = F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d{1,2})\]"), F.lit(1)), lambda x: x.cast("int"))
    return F.array_sort(F.filter(F.array_distinct(found), lambda x: (x >= 1) & (x <= n_hits)))


def check_answers(answers: DataFrame) -> DataFrame:
    """answers(query_id, answer, n_hits) with the citations and whether there is any."""
    cited = answers.withColumn("cited", citations(F.col("answer"), F.col("n_hits")))
    return cited.withColumn("grounded", F.size("cited") > 0)


def clamp_k(k: Column, most: int = 20) -> Column:
    return F.greatest(F.lit(1), F.least(k, F.lit(most)))


def wrapped(text: Column) -> Column:
    """An excerpt between marks that say it is not to be obeyed."""
    return F.concat(F.lit(UNTRUSTED[0] + "\n"), text, F.lit("\n" + UNTRUSTED[1]))


def search_payload(hits: DataFrame) -> DataFrame:
    """One JSON document for each query: its hits in order, relevance to four places."""
    row = F.struct("rank", "doc_id", F.round("score", 4).alias("score"), wrapped(F.col("text")).alias("excerpt"))
    return hits.groupBy("query_id").agg(F.to_json(F.struct(F.round(F.max("relevance"), 4).alias("relevance"), F.array_sort(F.collect_list(row)).alias("hits"))).alias("payload"))


def event(name: str, data: Column) -> Column:
    """A server-sent event frame."""
    return F.concat(F.lit(f"event: {name}\ndata: "), F.to_json(data), F.lit("\n\n"))


def index_health(chunks: DataFrame, source: str = "source", exact_max: int = 80_000) -> DataFrame:
    return chunks.agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct(source).alias("sources")).withColumn("status", F.when(F.col("chunks") > 0, "ok").otherwise("empty")).withColumn("exact_search", F.col("chunks") <= exact_max)


def list_sources(chunks: DataFrame, source: str, title: str, order: str) -> DataFrame:
    """Each source with the title of its first chunk."""
    return chunks.groupBy(source).agg(F.min_by(title, order).alias("title"), F.count(F.lit(1)).alias("chunks"))


def escaped(text: Column) -> Column:
    """Text for a web page."""
    out = F.coalesce(text, F.lit(""))
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(name))
    return out


def page_of_hits(hits: DataFrame) -> DataFrame:
    """(query_id, html): the hits of each query as a list with where they come from, escaped; hits(query_id, rank, title, section, text)."""
    item = F.concat(F.lit("<li><cite>"), escaped(F.col("title")), F.lit(" \u2014 "), escaped(F.col("section")), F.lit("</cite><p>"), escaped(F.substring("text", 1, 240)), F.lit("</p></li>"))
    listed = F.array_sort(F.collect_list(F.struct("rank", item.alias("item"))))
    return hits.groupBy("query_id").agg(F.concat(F.lit("<ol>"), F.array_join(F.transform(listed, lambda x: x["item"]), ""), F.lit("</ol>")).alias("html"))


def full_fingerprint(chunks: DataFrame, cfg: Config, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """The fingerprint with the corpus' size and what the results depend on: tokenizer and settings."""
    sizes = chunks.agg(F.coalesce(F.sum(F.length(text_col)), F.lit(0)).alias("chars"), F.max(F.length(text_col)).alias("longest"))
    settings = json.dumps(asdict(cfg), sort_keys=True)
    return fingerprint(chunks, id_col).crossJoin(sizes).withColumn("tokenizer", F.lit(cfg.tokenizer_version)).withColumn("settings", F.lit(settings)).withColumn("stamp", F.sha2(F.concat_ws("|", "chunks", "digest", "chars", "tokenizer", "settings"), 256))


def fingerprint(chunks: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """Count and an order-free digest of the ids."""
    return chunks.agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 8), 16, 10).cast("long")).alias("digest"))

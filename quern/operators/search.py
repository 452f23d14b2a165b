"""One entry for all retrieval modes, request checks, prompts and gates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.config import Config
from quern.operators import retrieval as r
from quern.operators.answers import context_block

MODES = ("hybrid", "dense", "bm25", "expand", "hyde")
MOST_QUERY = 1000
REFUSAL = "The indexed documents do not cover this question."
NOTHING = "No documents are indexed."


def dense_search(queries: DataFrame, vectors: DataFrame, k: int, cfg: Config | None = None) -> DataFrame:
    """Exact up to ``exact_search_max`` vectors, hashed buckets with exact re-scoring beyond."""
    cfg = cfg or Config()
    exact = vectors.limit(cfg.exact_search_max + 1).count() <= cfg.exact_search_max
    return r.dense_topk(queries, vectors, k) if exact else r.dense_topk_lsh(queries, vectors, k)


def valid(queries: DataFrame, k: int) -> DataFrame:
    """Requests as they may come: k from 1 to 20, texts of 1 to 1000 characters."""
    if not 1 <= k <= 20:
        raise ValueError("k must be from 1 to 20")
    return queries.where(F.length("text").between(1, MOST_QUERY))


def one_arm(ranked: DataFrame, arm: str, cfg: Config) -> DataFrame:
    """A single arm's list in the shape of a fused one; the other arm's columns are NULL."""
    other = "bm25" if arm == "dense" else "dense"
    kept = ranked.where(F.col("rank") <= cfg.final_k)
    typed = kept.select("query_id", "rank", "doc_id", F.col("rank").alias(f"{arm}_rank"), F.col("score").alias(f"{arm}_score"), F.lit(None).cast("int").alias(f"{other}_rank"), F.lit(None).cast("double").alias(f"{other}_score"), "score")
    return typed.select("query_id", "rank", "doc_id", "dense_rank", "bm25_rank", "dense_score", "bm25_score", "score")


def retrieve(mode: str, queries: DataFrame, posted: DataFrame, n_docs: int, vectors: DataFrame, embed: Callable[[DataFrame], DataFrame], cfg: Config | None = None, variants: DataFrame | None = None, reranker: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Hits of queries(query_id, text) with ranks, scores and relevance.

    vectors(doc_id, vector); ``embed`` turns (query_id, text) into (query_id, vector). ``variants``
    (query_id, pos, text) feeds the modes expand and hyde; relevance is always that of the
    original query. ``reranker`` gives (query_id, doc_id, rerank_score) of the fused hits."""
    cfg = cfg or Config()
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    vec = vectors.withColumnRenamed("doc_id", "vec_id")
    dense = lambda q: dense_search(embed(q), vec, cfg.top_k, cfg).withColumnRenamed("vec_id", "doc_id")
    own = dense(queries)
    relevance = r.relevance(own, queries)
    if mode == "dense":
        return one_arm(own, "dense", cfg).join(relevance, "query_id")
    if mode in ("expand", "hyde"):
        if variants is None:
            raise ValueError("this mode needs variants")
        every = r.expand_queries(queries, variants)
        keyed = every.select(F.concat_ws("#", F.col("query_id").cast("string"), "variant").alias("query_id"), "text", F.col("query_id").alias("own"), "variant")
        names = keyed.select("query_id", "own", "variant")
        arms = [("dense", dense(keyed.select("query_id", "text"))), ("bm25", r.bm25_topk(keyed.select("query_id", "text"), posted, n_docs, cfg.top_k, cfg))]
        lists = None
        for arm, ranked in arms:
            part = ranked.join(names, "query_id").select(F.col("own").alias("query_id"), "variant", F.lit(arm).alias("arm"), "rank", "doc_id", "score")
            lists = part if lists is None else lists.unionByName(part)
        return r.multi_variant_rrf(lists, cfg.final_k, cfg.rrf_k).join(relevance, "query_id")
    sparse = r.bm25_topk(queries, posted, n_docs, cfg.top_k, cfg)
    if mode == "bm25":
        return one_arm(sparse, "bm25", cfg).join(relevance, "query_id")
    fused = r.hybrid_rrf(own, sparse, cfg)
    return r.rerank(fused, reranker(fused), cfg.final_k) if cfg.rerank and reranker else fused


def max_dense_score(hits: DataFrame) -> DataFrame:
    """(query_id, best): the stamped relevance, else the best cosine among the hits, else 0."""
    return hits.groupBy("query_id").agg(F.coalesce(F.max("relevance"), F.max(F.when(F.col("dense_rank").isNotNull(), F.col("dense_score"))), F.lit(0.0)).alias("best"))


def max_rerank_score(hits: DataFrame) -> DataFrame:
    return hits.groupBy("query_id").agg(F.coalesce(F.max("rerank_score"), F.lit(float("-inf"))).alias("best"))


def hydrate(hits: DataFrame, chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Texts and metadata of the winners only; hits without a chunk go."""
    return hits.join(chunks, key)


def prompts(queries: DataFrame, hits: DataFrame, cfg: Config | None = None) -> DataFrame:
    """(query_id, answer, prompt): a fixed answer where nothing was found or the gate is not passed, else the prompt for a model."""
    cfg = cfg or Config()
    best = hits.groupBy("query_id").agg(F.max("relevance").alias("best"))
    joined = queries.join(best, "query_id", "left").join(context_block(hits), "query_id", "left")
    fixed = F.when(F.col("best").isNull(), NOTHING).when(F.col("best") < cfg.min_relevance, REFUSAL)
    text = F.concat(F.lit("Answer from these numbered excerpts, citing them as [n].\n\n"), "context", F.lit("\n\nQuestion: "), "text")
    return joined.select("query_id", fixed.alias("answer"), F.when(fixed.isNull(), text).alias("prompt"))


def containing(docs: DataFrame, needles: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(query_id, needle, doc_id, text) of each document that holds a needle(query_id, needle).

    A word between two spaces of the needle must be a word between spaces or ends of the text, so
    the longest such word of each needle is met by equality first; needles without one, which
    have no more than two words, are compared with every text in blocks."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    parts = F.split("needle", " ")
    inner = F.filter(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), lambda w: w != "")
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    asked = needles.where("needle <> ''").select("query_id", "needle", longest.alias("anchor"))
    anchored, short = asked.where("anchor IS NOT NULL"), asked.where("anchor IS NULL").drop("anchor")
    words = F.explode(F.array_distinct(F.split("text", " "))).alias("anchor")
    if anchored.limit(r.MOST_BROADCAST + 1).count() <= r.MOST_BROADCAST:  # a text stays where it is
        every = own.select("doc_id", "text", words).join(F.broadcast(anchored), "anchor").where(F.contains("text", "needle")).select("query_id", "needle", "doc_id", "text")
    else:
        met = r.cut(own.select("doc_id", words).join(anchored.select("query_id", "anchor"), "anchor").select("query_id", "doc_id").distinct())
        every = own.join(r.small(met), "doc_id").join(anchored.drop("anchor"), "query_id").select("query_id", "needle", "doc_id", "text").where(F.contains("text", "needle"))
    if short.isEmpty():
        return every
    return every.union(own.join(r.small(short), F.contains(F.col("text"), F.col("needle"))).select("query_id", "needle", "doc_id", "text"))


def determinism(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows that two runs do not share; none if they agree."""
    return first.exceptAll(second).union(second.exceptAll(first))


def ink_fraction(samples: Column) -> Column:
    """Share of the bytes of a raw greyscale or RGB image that are not nearly white, without Python."""
    code = F.hex(samples)
    light = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.length(code) - 1, F.lit(1)), F.lit(2)), lambda i: F.substr(code, i, F.lit(2)) >= "FA"))
    n = F.octet_length(samples)
    return F.when(n > 0, 1 - light / n).otherwise(0.0)


def figure_summary(figures: DataFrame, papers: DataFrame) -> DataFrame:
    """Papers without figures, and least, middle and greatest ink."""
    none = papers.join(figures.select("doc_id"), "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("papers_without"))
    return figures.agg(F.min("ink").alias("least"), F.percentile_approx("ink", 0.5).alias("middle"), F.max("ink").alias("most")).join(none)


def top_ink(figures: DataFrame, k: int = 3) -> DataFrame:
    order = [F.col("ink").desc(), F.col("figure_id")]
    return figures.orderBy(*order).limit(k).withColumn("place", F.row_number().over(Window.orderBy(*order)))  # k rows

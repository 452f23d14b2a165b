"""Scoring where the rows lie: nothing that grows as queries times rows is moved or held."""

from __future__ import annotations

import os
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.operators import retrieval, search
from quern.plans import registry
from quern.sources import corpora


def many(spark, sf, times=12):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return docs.crossJoin(spark.range(times)).select((F.col("doc_id") + 1000 * F.col("id")).alias("doc_id"), F.expr("substring(text, 1 + cast(id AS int) * 7)").alias("text")).coalesce(1)


def listed(df):
    return [(r.query_id, r["rank"], r.doc_id, round(r.score, 6)) for r in df.orderBy("query_id", "rank").collect()]


@pytest.mark.parametrize("kind", ["int", "string"])
def test_the_best_of_many_blocks(kind):
    """Blocks that touch some queries only, with many ties."""
    rng = np.random.default_rng(3)
    s = rng.integers(0, 40, (23, 900)) / 7
    names = rng.permutation(900)
    best = retrieval.Best(23, 5, pa.int64() if kind == "int" else pa.string(), np.full(23, 1e-300))
    for at in range(0, 900, 60):
        block, own = s[:, at : at + 60].copy(), names[at : at + 60]
        block[rng.random(23) < 0.5] *= 0.5
        s[:, at : at + 60] = block
        for lo in (0, 11):
            best.add(lo, block[lo : lo + (11 if lo == 0 else 12)], own if kind == "int" else np.array([str(x) for x in own], object))
    name = (lambda x: int(x)) if kind == "int" else str
    want = [sorted((-round(v, 9), name(n)) for v, n in zip(row, names, strict=True) if v > 0)[:5] for row in s]
    got: dict = {}
    for b in best.rows(pa.array(np.arange(23)), "doc_id"):
        for q, n, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
            got.setdefault(q, []).append((-round(v, 9), n))
    assert [got[q] for q in range(23)] == want


@pytest.mark.parametrize("stemmed", [False, True])
def test_texts_and_postings_give_the_same_lists(spark, sf, stemmed):
    """Enough text for several slices of a task."""
    docs, q = many(spark, sf), registry._queries(spark, sf)
    index = retrieval.Texts.of(docs, stemmed=stemmed)
    assert docs.count() == index.n and index.avgdl * index.n > 1.2 * retrieval.SLICE_TOKENS
    posted = retrieval.postings(docs, stemmed=stemmed).checkpoint()
    assert listed(retrieval.bm25_topk(q, index, k=9)) == listed(retrieval.bm25_topk(q, posted, index.n, 9, stemmed=stemmed))


def test_terms_are_counted_as_in_postings(spark):
    docs = spark.createDataFrame([(1, "cat cat Dog"), (2, None), (3, ""), (4, "dog bird_1 éa the")], "doc_id long, text string")
    index = retrieval.Texts.of(docs)
    assert index.n == 4 and index.avgdl == 6 / 4 and {r.term: r.df for r in index.terms.collect()} == {"cat": 1, "dog": 2, "bird_1": 1, "éa": 1}
    posted = retrieval.postings(docs)
    assert sorted(map(tuple, posted.collect())) == [(1, "cat", 2, 3), (1, "dog", 1, 3), (4, "bird_1", 1, 3), (4, "dog", 1, 3), (4, "éa", 1, 3)]
    assert "Exchange" not in posted._jdf.queryExecution().executedPlan().toString()
    assert retrieval.Texts.of(docs.limit(0)).n == 0


def test_term_statistics_write_no_postings(spark, sf, tmp_path):
    """What a query keeps in the shared folder is less than the documents' text."""
    def size():
        base = spark.conf.get("spark.checkpoint.dir")
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(base) for f in names)

    registry._STORED.clear()
    before, text = size(), spark.read.parquet(f"{sf}/documents.parquet").agg(F.sum(F.octet_length("text"))).first()[0]
    registry.bm25_term_stats(spark, sf).collect()
    assert size() - before < text


def test_known_items_are_found_at_the_places_of_the_whole_list(spark, sf):
    docs = many(spark, sf, 3)
    asked = docs.where("doc_id % 9 = 0").select(F.col("doc_id").alias("query_id"), F.substring("text", 1, 60).alias("text"))
    index = retrieval.Texts.of(docs)
    own = lambda df: sorted((r.query_id, r["rank"]) for r in df.where("query_id = doc_id").collect())
    hits = retrieval.known_item_topk(asked, index, 5)
    assert own(hits) == own(retrieval.bm25_topk(asked, index, k=5)) and len(own(hits)) > 30
    lower = hits.join(hits.where("query_id = doc_id").select("query_id", F.col("score").alias("own")), "query_id").where("score < own - 1e-8")
    assert lower.isEmpty()  # what scores less than the item itself is not moved


def test_dense_scores_are_held_in_blocks_of_a_bounded_size():
    rng = np.random.default_rng(1)
    q, v = rng.standard_normal((2000, 16)), rng.standard_normal((9000, 16))
    asked = pa.table({"query_id": pa.array(range(2000)), "vector": pa.array(list(q), pa.list_(pa.float64()))})
    rows = pa.record_batch({"vec_id": pa.array(range(9000)), "vector": pa.array(list(v), pa.list_(pa.float64()))})
    tracemalloc.start()
    got = pa.Table.from_batches(list(retrieval.nearest(asked, iter([rows]), 4, pa.int64())))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * 8 * retrieval.CELLS  # eight arrays of a block
    want = np.argsort(-(q[:50] @ v.T), axis=1)[:, :4]
    assert np.array_equal(got["vec_id"].to_numpy().reshape(2000, 4)[:50], want)


def test_a_text_is_not_moved_to_be_searched(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    asked = spark.createDataFrame([(1, "of this is said"), (2, "re the and in")], "query_id long, needle string")
    assert "Exchange hash" not in search.containing(docs, asked)._jdf.queryExecution().executedPlan().toString()


def test_hits_go_to_the_texts(spark, sf):
    """A ranked list is sent to the documents; they are not dealt out by id."""
    from quern.plans import more

    for q in (registry.context_block, more.hydrated_hits, registry.reranked):
        plan = q(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan, q.__name__


def test_lines_are_dealt_out_once(spark):
    """Spans in any order, repeated numbers, nulls; all in one exchange."""
    rows = [("d", 0, 0, 0, k, f"w{k} ", 9.0 + k, k % 2 == 0) for k in (2, 0, 1)] + [("d", 0, 0, 1, None, "n ", 1.0, None), ("d", 0, 0, 1, 0, "m", None, True), ("d", 0, 0, 3, 0, " ", 1.0, True)]
    rows += [("e", 1, 2, 0, 0, "b ", 2.0, True), ("e", 1, 2, 0, 0, "a ", 3.0, False), ("e", 0, 5, 9, 7, "first", 4.0, True), ("d", 0, 0, 0, 3, "w3", 0.0, True)]
    out = corpora.lines(spark.createDataFrame(rows, corpora.SPAN).coalesce(1))
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hash") == 1
    got = sorted(map(tuple, out.collect()))
    assert got == [("d", 0, "w0 w1 w2 w3", 9.0, True), ("d", 1, "n m", 1.0, None), ("e", 0, "first", 4.0, True), ("e", 1, "a b", 3.0, False)]

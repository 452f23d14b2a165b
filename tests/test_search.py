from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quern.config import Config
from quern.functions import text as tx
from quern.operators import answers, maintenance, metrics, retrieval, search
from quern.sources import corpora

TEXTS = [(0, "object hallucination evaluation in vision models"), (1, "retrieval augmented generation"), (2, "policy optimisation for language models"), (3, "cats and dogs")]


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    vectors = docs.select("doc_id", retrieval.hashed_embedding(F.col("text")).alias("vector"))
    embed = lambda q: q.select("query_id", retrieval.hashed_embedding(F.col("text")).alias("vector"))
    return docs, retrieval.postings(docs), vectors, embed


@pytest.mark.parametrize("mode", search.MODES)
def test_modes(spark, corpus, mode):
    docs, posted, vectors, embed = corpus
    q = spark.createDataFrame([(7, "hallucination evaluation")], "query_id long, text string")
    v = spark.createDataFrame([(7, 0, "Hallucination Evaluation"), (7, 1, "vision models")], "query_id long, pos int, text string")
    hits = search.retrieve(mode, q, posted, 4, vectors, embed, variants=v)
    first = hits.orderBy("rank").first()
    assert first.doc_id == 0 and 0 < first.relevance <= 1
    if mode in ("expand", "hyde"):
        assert first.n_variants == 2  # the variant that differs only in case is not counted
    assert search.determinism(hits, hits).isEmpty()


def test_bm25_only_answers_are_not_refused(spark, corpus):
    docs, posted, vectors, embed = corpus
    q = spark.createDataFrame([(7, "hallucination evaluation"), (8, "zebra")], "query_id long, text string")
    hits = search.hydrate(search.retrieve("bm25", q, posted, 4, vectors, embed), docs.withColumns({"title": F.lit("T"), "published": F.lit("2024"), "section": F.lit("S")}))
    got = {r.query_id: r for r in search.prompts(q, hits).collect()}
    assert got[7].answer is None and "[1] T (2024) — S\nobject hallucination" in got[7].prompt and got[8].answer == search.NOTHING
    assert {r.query_id for r in search.max_dense_score(hits).collect()} == {7}


def test_request_checks(spark):
    q = spark.createDataFrame([(1, ""), (2, "x" * 1001), (3, "ok")], "query_id long, text string")
    assert [r.query_id for r in search.valid(q, 5).collect()] == [3]
    with pytest.raises(ValueError, match="k must"):
        search.valid(q, 21)
    assert [r.k for r in spark.range(-1, 30, 15).select(answers.clamp_k(F.col("id")).alias("k")).collect()] == [1, 14, 20]


def test_dense_beyond_the_exact_limit(spark, corpus):
    _, _, vectors, _ = corpus
    v = vectors.withColumnRenamed("doc_id", "vec_id")
    q = v.select(F.col("vec_id").alias("query_id"), "vector")
    got = search.dense_search(q, v, 1, Config(exact_search_max=1)).collect()
    assert {(r.query_id, r.vec_id) for r in got} == {(i, i) for i in range(4)}


def test_payloads(spark):
    hits = spark.createDataFrame([(1, 1, 5, 0.123456, "text", 0.98765)], "query_id long, rank int, doc_id long, score double, text string, relevance double")
    body = json.loads(answers.search_payload(hits).first().payload)
    assert body["relevance"] == 0.9877 and body["hits"][0]["score"] == 0.1235 and body["hits"][0]["excerpt"].startswith("<<<untrusted")
    frame = hits.select(answers.event("sources", F.struct("doc_id")).alias("e")).first().e
    assert frame == 'event: sources\ndata: {"doc_id":5}\n\n'


def test_ink(spark):
    rows = spark.createDataFrame([(bytearray([0, 255, 249, 250]),), (bytearray(),), (bytearray([255] * 4),)], "b binary")
    assert [r.x for r in rows.select(search.ink_fraction(F.col("b")).alias("x")).collect()] == [0.5, 0.0, 0.0]


def test_lists_lines_and_ids(spark):
    row = spark.createDataFrame([('["a","b"]', "c", '1. one two three four\n- "short"\n• five words are in here\n', "2401.1v3")], "l string, s string, t string, i string")
    r = row.select(tx.as_list(F.col("l")).alias("l"), tx.as_list(F.col("s")).alias("s"), tx.clean_lines(F.col("t"), 5).alias("t"), tx.base_id(F.col("i")).alias("i")).first()
    assert (r.l, r.s, r.t, r.i) == (["a", "b"], ["c"], ["one two three four", "five words are in here"], "2401.1")


def test_readers(spark, tmp_path):
    (tmp_path / "cases.json").write_text(json.dumps([{"id": "1", "tag": "easy", "query": "q", "relevant": ["2401.1"]}, {"id": "2", "tag": "negative", "query": "n", "relevant": []}]))
    pos, neg = corpora.cases(spark, str(tmp_path / "cases.json"))
    assert [r.id for r in pos.collect()] == ["1"] and [r.id for r in neg.collect()] == ["2"]
    (tmp_path / "cache.json").write_text(json.dumps({"f1": {"text": "d", "model": "m", "seconds": 1.5}}))
    assert tuple(corpora.keyed_cache(spark, str(tmp_path / "cache.json"), "text:string,model:string,seconds:double").first()) == ("f1", "d", "m", 1.5)
    (tmp_path / "papers.json").write_text(json.dumps({"title": "T", "abstract": "a\nb", "entry_url": "http://x/abs/2401.1v1"}))
    p = corpora.papers(spark, str(tmp_path / "papers.json"), ["2401.1v1"]).first()
    assert (p.arxiv_id, p.abstract) == ("2401.1v1", "a b")


def test_benchmark_adapters(spark):
    q = spark.createDataFrame([(0, "what", ["d1", "d2"]), (1, "why", [])], "pos int, query string, gold array<string>")
    queries, qrels = corpora.gold_lists(q)
    assert queries.count() == 2 and {(r.query_id, r.doc_id) for r in qrels.collect()} == {("q0", "d1"), ("q0", "d2")}
    out = corpora.excluded(spark.createDataFrame([("q0", '["d1","N/A",""]')], "query_id string, excluded string"))
    assert [r.doc_id for r in out.collect()] == ["d1"] and [r.doc_id for r in corpora.without_excluded(qrels, out).collect()] == ["d2"]
    text = "A paragraph that is long enough to be kept as a unit of text."
    d = spark.createDataFrame([("p", [("Intro", [text, "short"])])], "paper_id string, full_text array<struct<section_name:string,paragraphs:array<string>>>")
    paras = corpora.paragraphs(d)
    ev = spark.createDataFrame([("p", "p-q0", text[2:30]), ("p", "p-q1", ""), ("x", "x-q0", text)], "paper_id string, query_id string, evidence string")
    assert [tuple(r) for r in corpora.evidence_qrels(paras, ev).collect()] == [("p-q0", "p-s0-p0", 1)]
    assert metrics.judged_only(queries, qrels).count() == 1


def test_drafts(spark):
    drafts = corpora.parse_cases(spark.createDataFrame([(1, 'Here: [{"tag":"easy","query":"what  is\\nit"}] ok'), (2, "no list")], "doc_id long, answer string"))
    assert [tuple(r) for r in drafts.collect()] == [(1, 0, "easy", "what is it")]
    review = corpora.review_rows(spark.createDataFrame([("- [KEEP] a",), ("DROP b",), ("text",)], "value string"))
    now, new = spark.createDataFrame([("z",)], "id string"), spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    assert sorted(r.id for r in corpora.promote(now, new, review).collect()) == ["a", "z"]


def test_append_counts_a_key_once(spark):
    s = "chunk_id string, section string"
    stored, new = spark.createDataFrame([("a", "x")], s), spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "x"), ("c", "24\nREFERENCES")], s)
    assert sorted(r.chunk_id for r in maintenance.append(stored, new).collect()) == ["a", "b"]


def test_models_are_made_once_in_a_worker(spark):
    from quern.functions.workers import embed, once

    assert once("x", lambda: [1]) is once("x", lambda: [2])
    rows = spark.createDataFrame([(k, "t" * k if k else None) for k in range(130)], "query_id long, text string").coalesce(1)

    def make():
        made = []

        def model(texts):
            made.append(len(texts))
            return [[float(len(t)), float(len(made) > 0)] for t in texts]

        return model

    assert sorted((r.query_id, r.vector[0]) for r in embed(rows, make).collect()) == [(k, float(k)) for k in range(130)]


def test_one_bad_input_does_not_end_the_run(spark):
    def parse(name, data):
        return [data.decode()] if name != "b" else 1 / 0

    files = spark.createDataFrame([("a", b"one"), ("b", b"two"), ("c", None)], "path string, content binary")
    got = {r.id: (r.chunks, r.error) for r in corpora.parse_many(files, parse).collect()}
    assert got["a"] == (["one"], None) and got["b"] == (None, "ZeroDivisionError: division by zero") and got["c"][0] is None and got["c"][1].startswith("AttributeError")


def test_command_line(spark, sf, tmp_path, capsys):
    from quern.__main__ import main

    word = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) > 400").first().text.split()[5]
    main([word, "--docs", f"{sf}/documents.parquet", "--index", str(tmp_path / "i")])
    assert "[1] " in capsys.readouterr().out


def test_pages_are_escaped(spark):
    from quern.operators.answers import page_of_hits

    hits = spark.createDataFrame([(1, 2, "b", "s", "x"), (1, 1, "<a>", "s & t", "it's")], "query_id int, rank int, title string, section string, text string")
    assert page_of_hits(hits).first().html == "<ol><li><cite>&lt;a&gt; — s &amp; t</cite><p>it&#39;s</p></li><li><cite>b — s</cite><p>x</p></li></ol>"


def test_figure_search_without_figures(spark):
    from quern.operators.retrieval import figure_status

    asked = spark.createDataFrame([(1,), (2,)], "query_id int")
    found = spark.createDataFrame([(1, "f")], "query_id int, doc_id string")
    figs = found.select("doc_id")
    assert {r.query_id: r.status for r in figure_status(asked, found, figs).collect()} == {1: "ok", 2: "no hit"}
    assert {r.status for r in figure_status(asked, found.limit(0), figs.limit(0)).collect()} == {"no figures indexed"}

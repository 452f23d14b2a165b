"""More registered queries, each beside the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.config import Config
from quern.functions import text as tx
from quern.operators import answers, geometry, maintenance, measurements, metrics, retrieval, search
from quern.plans import oracle as o
from quern.plans import registry as reg
from quern.sources import corpora


def _r(c, places=6):
    return F.round(c, places).alias(c)


def papers_by_id(s, d):
    """Documents whose ids are listed in labels as of low quality."""
    bad = reg.table(s, d, "labels").where("quality = 0").select("doc_id")
    return reg._docs(s, d).join(bad, "doc_id", "left_semi").select("doc_id", F.md5(F.translate("text", "\n", " ")).alias("text_md5"))


def reading_order(s, d):
    return geometry.reading_order(reg._blocks(s, d)).select("doc_id", F.col("page").cast("long").alias("page"), F.col("block_no").cast("long").alias("block_no"), F.col("place").cast("long").alias("place"))


def without_excluded(s, d):
    """BM25 hits without the documents that a list per query excludes."""
    left_out = corpora.excluded(reg._queries(s, d).select("query_id", F.concat(F.lit('["'), (F.col("query_id") * 7).cast("string"), F.lit('", "", "N/A"]')).alias("excluded")).union(reg._docs(s, d).where("doc_id % 5 = 0").select(F.pmod("doc_id", F.lit(40)).alias("query_id"), F.col("doc_id").cast("string"))))
    runs = reg._sparse(s, d, 20)
    return corpora.without_excluded(runs, left_out.withColumn("doc_id", F.col("doc_id").cast("long"))).select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id")


def gold_lists(s, d):
    """Conversations as questions: the first turn asks, all turns are gold."""
    asked = reg.table(s, d, "conversations").groupBy(F.col("conv_id").alias("pos")).agg(F.min_by("text", "turn").alias("query"), F.array_sort(F.collect_list(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")))).alias("gold"))
    return corpora.gold_lists(asked)[1].select("query_id", "doc_id", F.col("rel").cast("long").alias("rel"))


def list_values(s, d):
    """JSON lists of strings and plain values, as lists."""
    raw = F.when(F.pmod("doc_id", F.lit(3)) == 0, F.concat(F.lit('["a'), F.col("doc_id").cast("string"), F.lit('", "b"]'))).otherwise(F.concat(F.lit("x"), F.col("doc_id").cast("string")))
    return reg._docs(s, d).select("doc_id", F.array_join(tx.as_list(raw), "|").alias("listed"))


def case_split(s, d):
    """Items that some document holds are positive cases, the others negative."""
    rel = reg._qrels(s, d).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    both = reg._queries(s, d).join(rel, "query_id", "left")
    return both.select("query_id", F.when(F.col("n") > 0, "positive").otherwise("negative").alias("side"), F.coalesce("n", F.lit(0)).cast("long").alias("relevant"))


def authors_line(s, d):
    names = F.slice(F.split("text", " "), F.lit(1), F.pmod("doc_id", F.lit(8)).cast("int") + 1)
    return reg._docs(s, d).where("text IS NOT NULL").select("doc_id", tx.authors_line(names).alias("authors"))


def clean_lines(s, d):
    return reg._docs(s, d).where("text IS NOT NULL").select("doc_id", F.md5(F.array_join(tx.clean_lines(F.concat(F.lit("1. a first line with words\n- \"another line of some words\"\n"), F.col("text")), 12), "\n")).alias("lines_md5"))


def previews(s, d):
    return reg._docs(s, d).select("doc_id", tx.preview(F.col("text"), 200).alias("preview"))


def band_growth(s, d):
    """The width of the band of text below each caption."""
    blocks, box = reg._blocks(s, d), reg._boxes(s, d)
    caps = geometry.captions(blocks, tables=True)
    band = caps.join(geometry.floors(caps, blocks, box), "figure_id").select("figure_id", "doc_id", "page", F.col("y1").alias("y0"), F.col("floor").alias("y1"), "x0", "x1", F.lit(0.0).alias("lo"), F.lit(600.0).alias("hi"))
    return geometry.band_extents(band, blocks, gap=45.0)


def hydrated_hits(s, d):
    chunks = reg._docs(s, d).where("lang <> 'fr'").select("doc_id", "source", F.md5("text").alias("text_md5"))
    return search.hydrate(reg._sparse(s, d), chunks).select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "source", "text_md5")


def one_arm(s, d):
    cfg = Config()
    both = search.one_arm(reg._sparse(s, d), "bm25", cfg).withColumn("arm", F.lit("bm25")).unionByName(search.one_arm(reg._dense(s, d), "dense", cfg).withColumn("arm", F.lit("dense")))
    return both.select("arm", "query_id", *[F.col(c).cast("long").alias(c) for c in ("rank", "doc_id", "dense_rank", "bm25_rank")], _r("score"))


def best_scores(s, d):
    return search.max_dense_score(retrieval.hybrid_rrf(reg._dense(s, d), reg._sparse(s, d))).select("query_id", _r("best"))


def answers_or_prompts(s, d):
    """What is answered without a model, and the length of the other prompts."""
    hits = retrieval.hybrid_rrf(reg._dense(s, d).where("doc_id % 3 <> 0"), reg._sparse(s, d).where("query_id % 4 <> 1"))
    shown = search.hydrate(hits, reg._docs(s, d).select("doc_id", F.col("source").alias("title"), F.lit("2024").alias("published"), F.col("lang").alias("section"), "text"))
    return search.prompts(reg._queries(s, d), shown, Config(min_relevance=0.5)).select("query_id", "answer", F.length("prompt").cast("long").alias("n_prompt"))


def valid_requests(s, d):
    asked = reg._docs(s, d).select(F.col("doc_id").alias("query_id"), "text")
    return search.valid(asked, 5).select("query_id", F.pmod("query_id", F.lit(30)).alias("asked_k"), answers.clamp_k(F.pmod("query_id", F.lit(30))).cast("long").alias("k"))


def wrapped_excerpts(s, d):
    return reg._docs(s, d).where("text IS NOT NULL").select("doc_id", F.md5(answers.wrapped(F.col("text"))).alias("excerpt_md5"), F.md5(answers.escaped(F.concat(F.lit("<a href='x'>&\""), F.col("text")))).alias("html_md5"))


def repeated_run(s, d):
    """Rows that two runs of one search do not share: none."""
    diff = search.determinism(*[reg._sparse(s, d).select("query_id", "rank", "doc_id") for _ in range(2)])
    return diff.agg(F.count(F.lit(1)).alias("unstable"))


def draft_pool(s, d):
    """Documents without a label and outside a list of drafts."""
    drafted = reg._docs(s, d).where("doc_id % 11 = 0").select("doc_id")
    pool = metrics.draft_pool(reg._docs(s, d).select("doc_id"), reg.table(s, d, "labels").select("doc_id"), drafted, 1 << 30)
    return pool.select("doc_id")


def ink_summary(s, d):
    """A document's share of spaces stands for ink, its source for the paper."""
    ink = reg._docs(s, d).where("lang <> 'de' AND n_chars > 0").select(F.concat_ws("-", "source", F.col("doc_id").cast("string")).alias("figure_id"), F.col("source").alias("doc_id"), (F.col("n_chars") / 1000.0).alias("ink"))
    papers = reg._docs(s, d).select(F.concat(F.col("source"), F.when(F.col("lang") == "de", "x").otherwise("")).alias("doc_id")).distinct()
    return search.figure_summary(ink, papers).select(_r("least"), _r("most"), "papers_without")


def darkest(s, d):
    ink = reg._docs(s, d).where("n_chars > 0").select(F.concat_ws("-", "source", F.col("doc_id").cast("string")).alias("figure_id"), (F.col("n_chars") / 1000.0).alias("ink"))
    return search.top_ink(ink).select("figure_id", _r("ink"), F.col("place").cast("long").alias("place"))


def drafted_cases(s, d):
    """Cases in a model's answer; every fourth answer is malformed."""
    answer = F.concat(F.lit('Here: [{"tag": "'), F.col("lang"), F.lit('", "query": "what  is '), F.col("doc_id").cast("string"), F.when(F.pmod("doc_id", F.lit(4)) == 0, F.lit('"')).otherwise(F.lit('"}] done')))
    return corpora.parse_cases(reg._docs(s, d).select("doc_id", answer.alias("answer"))).select("doc_id", F.col("pos").cast("long").alias("pos"), "tag", "query")


def review_decisions(s, d):
    verdict = F.element_at(F.array(F.lit("OK"), F.lit("AMBIG"), F.lit("MISS")), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))
    report = corpora.review_report(reg._docs(s, d).select(F.concat(F.lit("case"), F.col("doc_id").cast("string")).alias("id"), F.col("source").alias("query"), verdict.alias("verdict")))
    return corpora.review_rows(report.select("value"))


def negative_cases(s, d):
    """Best cosines of items that no document holds."""
    none = reg._queries(s, d).join(reg._qrels(s, d), "query_id", "left_anti")
    return metrics.negatives(reg._dense(s, d).where("doc_id <> query_id"), none).select("negatives", _r("mean_top_score"))


def framework_arms(s, d):
    """Several retrievers over the same documents and cases."""
    dense, sparse = reg._dense(s, d), reg._sparse(s, d)
    arms = {"dense": reg._hits(dense), "bm25": reg._hits(sparse), "hybrid": reg._hits(retrieval.hybrid_rrf(dense, sparse))}
    return metrics.arms_table(arms, reg._cases(s, d)).select("arm", "tag", "n", "hits", _r("recall"), _r("mrr"))


def known_item_verdict(s, d):
    """Known-item recall of every document whose id is divisible by 50 over all documents, and over those and conversations."""
    asked = reg._docs(s, d).where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.array_join(F.slice(tx.tokens(F.col("text")), 1, 7), " ").alias("text"))
    more = reg._docs(s, d).select("doc_id", "text").unionByName(reg.table(s, d, "conversations").select((-F.col("conv_id") * 1000 - F.col("turn") - 1).alias("doc_id"), "text"))
    base, other = (metrics.known_item(asked, retrieval.known_item_topk(asked, index, 5)) for index in (reg._index(s, d), retrieval.Texts.of(more)))
    return metrics.known_item_verdict(base, other).select(*[_r(c) for c in ("base_recall_1", "base_recall_5", "other_recall_1", "other_recall_5", "delta_1", "delta_5")], "verdict")


def full_fingerprint(s, d):
    return answers.full_fingerprint(reg._docs(s, d), Config(), "doc_id").select("chunks", "digest", "chars", "longest", "tokenizer")


def figure_status(s, d):
    es = reg._docs(s, d).where("lang = 'es'").select("doc_id")
    return retrieval.figure_status(reg._queries(s, d), retrieval.only_kind(reg._sparse(s, d, 100), es, 3), es)


def page_lines(s, d):
    """Spans of lines, four words each, joined back."""
    words = reg._docs(s, d).where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).select("doc_id", "line_no", F.posexplode(F.split("line", " ")).alias("span_no", "w"))
    spans = words.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(0).alias("page"), F.lit(0).alias("block_no"), "line_no", "span_no", F.concat("w", F.lit(" ")).alias("text"), (9.0 + F.col("span_no") % 3).alias("size"), (F.col("span_no") % 2 == 0).alias("bold"))
    return corpora.lines(spans).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.md5("text").alias("text_md5"), "size", "bold")


def parsed_files(s, d):
    """Documents parsed one by one; those of an odd kind fail by themselves."""

    def parse(name: int, data: str) -> list[str]:
        if name % 7 == 3:
            raise ValueError(f"cannot read {name}")
        return [x for x in (data or "").split("\n") if x]

    return corpora.parse_many(reg._docs(s, d), parse, "doc_id", "text").select(F.col("id").alias("doc_id"), F.when(F.col("chunks").isNull(), -1).otherwise(F.size("chunks")).cast("long").alias("n_chunks"), "error")


def _tables(s, d):
    """A table in markdown for each document: rows named by its first long word, an average, an empty label."""
    word = F.regexp_extract("text", "[a-z]{4,}", 0)
    last = F.col("n_chars") % 150
    mark = F.concat(F.lit("| Method | Acc | F1 |\n|---|---|---|\n| **"), word, F.lit("** (ours) | "), last.cast("string"), F.lit("% | 1,204 |\n| Average | 1 | 2 |\n| 12 | 5 | 6 |\n|  | 1 | 1 |\n| net-"), (F.col("doc_id") % 9).cast("string"), F.lit(" | 3/4 | - | "), (F.col("n_chars") / 4).cast("string"), F.lit(" |"))
    return reg._docs(s, d).where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("figure_id"), F.concat("source", F.lit("v1")).alias("arxiv_id"), F.concat(F.lit("Table  of "), F.col("lang")).alias("caption"), mark.alias("markdown"))


def measured(s, d):
    return measurements.measurements(_tables(s, d))


def measured_drops(s, d):
    known = _tables(s, d)
    listed, unknown = measurements.with_manifest(known.select("figure_id", "markdown"), known.where("figure_id NOT LIKE '%7'"))
    return measurements.drop_reasons(listed, unknown)


def shared_methods(s, d):
    return measurements.joinable(measurements.measurements(_tables(s, d)))


def queries():
    named = [
        papers_by_id, reading_order, without_excluded, gold_lists, list_values, case_split, authors_line, clean_lines, previews, band_growth, hydrated_hits, one_arm, best_scores, answers_or_prompts, valid_requests,
        wrapped_excerpts, repeated_run, draft_pool, ink_summary, darkest, drafted_cases, review_decisions, negative_cases, framework_arms, known_item_verdict, full_fingerprint, figure_status, page_lines, parsed_files,
        measured, measured_drops, shared_methods,
    ]
    return {f.__name__: f for f in named}


def sql() -> dict[str, str]:
    both = f"WITH RECURSIVE {o._bm25(8)}, {o._dense(8)}"
    out = {}
    out["papers_by_id"] = "SELECT doc_id, md5(replace(text, chr(10), ' ')) AS text_md5 FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)"
    out["reading_order"] = f"WITH {o._BLOCKS} SELECT doc_id, page, block_no, row_number() OVER (PARTITION BY doc_id, page ORDER BY round(y0, 1), x0) AS place FROM blocks WHERE trim(text, ' ') <> ''"
    out["without_excluded"] = f"WITH {o._bm25(20)}, x AS (SELECT item_id AS query_id, item_id * 7 AS doc_id FROM benchmark UNION SELECT doc_id % 40, doc_id FROM documents WHERE doc_id % 5 = 0) SELECT query_id, rank, doc_id FROM sparse WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.query_id = sparse.query_id AND x.doc_id = sparse.doc_id)"
    out["gold_lists"] = "SELECT 'q' || conv_id AS query_id, conv_id || '-' || turn AS doc_id, CAST(1 AS BIGINT) AS rel FROM conversations"
    out["list_values"] = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'a' || doc_id || '|b' ELSE 'x' || doc_id END AS listed FROM documents"
    out["case_split"] = f"WITH {o._QRELS} SELECT item_id AS query_id, CASE WHEN count(doc_id) > 0 THEN 'positive' ELSE 'negative' END AS side, count(doc_id) AS relevant FROM benchmark LEFT JOIN qrels ON query_id = item_id GROUP BY item_id"
    out["authors_line"] = "SELECT doc_id, array_to_string(list_slice(a, 1, 5), ', ') || CASE WHEN len(a) > 5 THEN ' et al.' ELSE '' END AS authors FROM (SELECT doc_id, list_slice(string_split(text, ' '), 1, doc_id % 8 + 1) AS a FROM documents WHERE text IS NOT NULL)"
    words = r"len(list_filter(string_split_regex(x, '\s+'), lambda y: y <> ''))"
    out["clean_lines"] = rf"""WITH l AS (SELECT doc_id, list_transform(string_split_regex('1. a first line with words' || chr(10) || '- "another line of some words"' || chr(10) || text, '\r\n|[\n\r]'), lambda x: trim(trim(regexp_replace(x, '^\s*(?:\d+[.)]|[-*•])\s*', ''), ' '), '"''')) AS l FROM documents WHERE text IS NOT NULL)
SELECT doc_id, md5(array_to_string(list_slice(list_filter(l, lambda x: {words} > 3 AND {words} <= 25), 1, 12), chr(10))) AS lines_md5 FROM l"""
    out["previews"] = "SELECT doc_id, substr(text, 1, 200) AS preview FROM documents"
    beside = "JOIN blocks b ON b.doc_id = c.doc_id AND b.page = c.page"
    out["band_growth"] = f"""WITH RECURSIVE {o._BLOCKS},
down AS (SELECT figure_id, min(b.y0) AS f FROM caps c {beside} AND b.x1 > c.x0 AND b.x0 < c.x1 AND b.y0 >= c.y1 AND b.sentence GROUP BY figure_id),
band AS (SELECT figure_id, doc_id, page, y1 AS y0, coalesce(f, 800) AS y1, x0, x1 FROM caps LEFT JOIN down USING (figure_id)),
near AS (SELECT c.figure_id, b.x0 AS bx0, b.x1 AS bx1 FROM band c {beside} AND b.y1 > c.y0 AND b.y0 < c.y1 AND b.x1 > 0 AND b.x0 < 600),
grow AS (SELECT figure_id, x0, x1 FROM band UNION SELECT g.figure_id, least(g.x0, bx0), greatest(g.x1, bx1) FROM grow g JOIN near n ON n.figure_id = g.figure_id AND bx1 >= g.x0 - 45 AND bx0 <= g.x1 + 45)
SELECT figure_id, min(x0) AS x0, max(x1) AS x1 FROM grow GROUP BY figure_id"""
    out["hydrated_hits"] = f"WITH {o._bm25(8)} SELECT query_id, rank, doc_id, source, md5(text) AS text_md5 FROM sparse JOIN documents USING (doc_id) WHERE lang <> 'fr'"
    out["one_arm"] = f"{both} SELECT 'bm25' AS arm, query_id, rank, doc_id, NULL::BIGINT AS dense_rank, rank AS bm25_rank, round(score, 6) AS score FROM sparse WHERE rank <= 5 UNION ALL SELECT 'dense', query_id, rank, doc_id, rank, NULL, round(score, 6) FROM dense WHERE rank <= 5"
    out["best_scores"] = f"{both}, {o._hybrid(5)} SELECT query_id, round(max(relevance), 6) AS best FROM hybrid GROUP BY query_id"
    part = "'[' || rank || '] ' || source || ' (2024) — ' || lang || chr(10) || regexp_replace(coalesce(text, ''), '\\[\\d+(?:\\s*,\\s*\\d+)*\\]', '', 'g')"
    out["answers_or_prompts"] = f"""WITH RECURSIVE {o._bm25(8, name="sparse0")}, {o._dense(8, name="dense0")}, sparse AS (SELECT * FROM sparse0 WHERE query_id % 4 <> 1), dense AS (SELECT * FROM dense0 WHERE doc_id % 3 <> 0), {o._hybrid(5)},
c AS (SELECT query_id, max(relevance) AS best, string_agg({part}, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM hybrid JOIN documents USING (doc_id) GROUP BY query_id),
j AS (SELECT item_id AS query_id, text, best, context, CASE WHEN best IS NULL THEN '{search.NOTHING}' WHEN best < 0.5 THEN '{search.REFUSAL}' END AS answer FROM benchmark LEFT JOIN c ON query_id = item_id)
SELECT query_id, answer, CASE WHEN answer IS NULL THEN length('Answer from these numbered excerpts, citing them as [n].' || chr(10) || chr(10) || context || chr(10) || chr(10) || 'Question: ' || text) END AS n_prompt FROM j"""
    out["valid_requests"] = "SELECT doc_id AS query_id, doc_id % 30 AS asked_k, greatest(1, least(doc_id % 30, 20)) AS k FROM documents WHERE length(text) BETWEEN 1 AND 1000"
    out["wrapped_excerpts"] = "SELECT doc_id, md5('<<<untrusted excerpt>>>' || chr(10) || text || chr(10) || '<<<end of excerpt>>>') AS excerpt_md5, md5(replace(replace(replace(replace(replace('<a href=''x''>&\"' || text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS html_md5 FROM documents WHERE text IS NOT NULL"
    out["repeated_run"] = "SELECT CAST(0 AS BIGINT) AS unstable"
    out["draft_pool"] = "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) AND doc_id % 11 <> 0"
    out["ink_summary"] = "SELECT round(min(n_chars) / 1000, 6) AS least, round(max(n_chars) / 1000, 6) AS most, (SELECT count(DISTINCT source || 'x') FROM documents WHERE lang = 'de') + (SELECT count(DISTINCT source) FROM documents WHERE lang <> 'de' AND source NOT IN (SELECT source FROM documents WHERE lang <> 'de' AND n_chars > 0)) AS papers_without FROM documents WHERE lang <> 'de' AND n_chars > 0"
    out["darkest"] = "SELECT * FROM (SELECT source || '-' || doc_id AS figure_id, round(n_chars / 1000, 6) AS ink, row_number() OVER (ORDER BY n_chars DESC, source || '-' || doc_id) AS place FROM documents WHERE n_chars > 0) WHERE place <= 3"
    out["drafted_cases"] = "SELECT doc_id, CAST(0 AS BIGINT) AS pos, lang AS tag, 'what is ' || doc_id AS query FROM documents WHERE doc_id % 4 <> 0"
    out["review_decisions"] = "SELECT 'case' || doc_id AS id, doc_id % 3 = 0 AS keep FROM documents"
    out["negative_cases"] = f"WITH {o._dense(8)}, {o._QRELS}, n AS (SELECT item_id AS query_id FROM benchmark WHERE item_id NOT IN (SELECT query_id FROM qrels)), b AS (SELECT query_id, max(score) AS best FROM dense WHERE rank <= 5 AND doc_id <> query_id GROUP BY query_id) SELECT count(*) AS negatives, round(avg(coalesce(best, 0)), 6) AS mean_top_score FROM n LEFT JOIN b USING (query_id)"
    cols = "count(*) AS n, CAST(sum(CASE WHEN chunk_rank <= 5 THEN 1 ELSE 0 END) AS BIGINT) AS hits, round(avg(CASE WHEN chunk_rank <= 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall, round(avg(coalesce(1.0::DOUBLE / chunk_rank, 0)), 6) AS mrr"
    out["framework_arms"] = f"{both}, {o._QRELS}, {o._CASES}, {o._hybrid(5)}, {o._ranks('dense', 'r1')}, {o._ranks('sparse', 'r2')}, {o._ranks('hybrid', 'r3')}, every AS (SELECT 'dense' AS arm, * FROM r1 UNION ALL SELECT 'bm25', * FROM r2 UNION ALL SELECT 'hybrid', * FROM r3) SELECT arm, NULL::VARCHAR AS tag, {cols} FROM every GROUP BY arm UNION ALL SELECT arm, tag, {cols} FROM every GROUP BY arm, tag"
    known = f"asked AS (SELECT doc_id AS query_id, array_to_string(list_slice({o._TOK}, 1, 7), ' ') AS text FROM docs0 WHERE doc_id >= 0 AND doc_id % 50 = 0)"
    shares = "SELECT avg(CASE WHEN rank <= 1 THEN 1.0::DOUBLE ELSE 0 END) AS r1, avg(CASE WHEN rank <= 5 THEN 1.0::DOUBLE ELSE 0 END) AS r5 FROM asked LEFT JOIN (SELECT query_id, rank FROM sparse WHERE query_id = doc_id) USING (query_id)"
    one = f"(WITH docs0 AS (SELECT doc_id, text FROM documents), {o._bm25(5, known).replace('FROM documents', 'FROM docs0')} {shares})"
    two = f"(WITH docs0 AS (SELECT doc_id, text FROM documents UNION ALL SELECT -conv_id * 1000 - turn - 1, text FROM conversations), {o._bm25(5, known).replace('FROM documents', 'FROM docs0')} {shares})"
    out["known_item_verdict"] = f"SELECT round(b.r1, 6) AS base_recall_1, round(b.r5, 6) AS base_recall_5, round(x.r1, 6) AS other_recall_1, round(x.r5, 6) AS other_recall_5, round(x.r1 - b.r1, 6) AS delta_1, round(x.r5 - b.r5, 6) AS delta_5, CASE WHEN least(x.r1 - b.r1, x.r5 - b.r5) < -0.005 THEN 'harms' ELSE 'harmless' END AS verdict FROM {one} b, {two} x"
    out["full_fingerprint"] = f"SELECT count(*) AS chunks, CAST(sum(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT)) AS BIGINT) AS digest, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(max(length(text)) AS INTEGER) AS longest, '{Config().tokenizer_version}' AS tokenizer FROM documents"
    out["figure_status"] = f"WITH {o._bm25(100)} SELECT item_id AS query_id, CASE WHEN item_id IN (SELECT query_id FROM sparse JOIN documents USING (doc_id) WHERE lang = 'es') THEN 'ok' ELSE 'no hit' END AS status FROM benchmark"
    out["page_lines"] = "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents WHERE text IS NOT NULL) SELECT CAST(doc_id AS VARCHAR) AS doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY no) - 1 AS line_no, md5(trim(t, ' ')) AS text_md5, 9.0::DOUBLE AS size, true AS bold FROM l WHERE trim(t, ' ') <> ''"
    out["parsed_files"] = "SELECT doc_id, CASE WHEN doc_id % 7 = 3 THEN -1 ELSE coalesce(len(list_filter(string_split(text, chr(10)), lambda x: x <> '')), 0) END AS n_chunks, CASE WHEN doc_id % 7 = 3 THEN 'ValueError: cannot read ' || doc_id END AS error FROM documents"
    no = ", ".join(f"'{w}'" for w in measurements.NOT_METHODS)
    rows = f"""t AS (SELECT doc_id, source, lang, n_chars, regexp_extract(text, '[a-z]{{4,}}', 0) AS w FROM documents WHERE text IS NOT NULL),
m AS (SELECT source AS paper, w AS method, w || ' (ours)' AS method_raw, 'Acc' AS "column", CAST(n_chars % 150 AS DOUBLE) AS value, true AS is_percent, doc_id, lang FROM t WHERE w <> '' AND w NOT IN ({no}) AND n_chars % 150 <= 100
  UNION ALL SELECT source, w, w || ' (ours)', 'F1', 1204, false, doc_id, lang FROM t WHERE w <> '' AND w NOT IN ({no})
  UNION ALL SELECT source, 'net-' || doc_id % 9, 'net-' || doc_id % 9, 'col3', n_chars / 4, false, doc_id, lang FROM t)"""
    out["measured"] = f"""WITH {rows} SELECT paper, method, method_raw, "column", value, is_percent, 'table:' || doc_id AS source, 'Table of ' || lang AS caption FROM m"""
    kept = "t WHERE doc_id % 10 <> 7"
    out["measured_drops"] = f"""WITH {rows}, r AS (
SELECT 'non-entity row label' AS drop_reason FROM {kept} UNION ALL SELECT 'numeric row label' FROM {kept} UNION ALL SELECT 'empty row label' FROM {kept} UNION ALL SELECT 'ambiguous cell' FROM {kept} UNION ALL SELECT 'non-numeric cell' FROM {kept}
UNION ALL SELECT 'no manifest entry' FROM t WHERE doc_id % 10 = 7 UNION ALL SELECT CASE WHEN w = '' THEN 'empty row label' ELSE 'non-entity row label' END FROM {kept} AND (w = '' OR w IN ({no})) UNION ALL SELECT 'percent out of range' FROM {kept} AND w <> '' AND w NOT IN ({no}) AND n_chars % 150 > 100)
SELECT drop_reason, count(*) AS "count" FROM r GROUP BY drop_reason"""
    out["shared_methods"] = f"WITH {rows} SELECT method, count(DISTINCT paper) AS papers FROM m GROUP BY method HAVING count(DISTINCT paper) >= 2 ORDER BY papers DESC, method LIMIT 15"
    return out

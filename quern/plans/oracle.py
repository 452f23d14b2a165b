"""SQL counterparts of the registered queries, for DuckDB."""

from __future__ import annotations

from quern.functions.text import STOPWORDS

_STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"
_TOK = rf"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda w: NOT list_contains({_STOP}, w))"

_POSTED = f"""
tok AS (SELECT doc_id, {_TOK} AS t FROM documents),
dl AS (SELECT doc_id, len(t) AS dl FROM tok WHERE len(t) > 0),
post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM tok) GROUP BY ALL),
corp AS (SELECT (SELECT count(*) FROM documents) AS n, CAST((SELECT sum(dl) FROM dl) AS DOUBLE) / (SELECT count(*) FROM documents) AS avgdl),
raw AS (SELECT term, count(*) AS df, ln(n - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS raw FROM post, corp GROUP BY term, n),
term AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""

_ITEMS = "asked AS (SELECT item_id AS query_id, text FROM benchmark)"


def _bm25(k: int, asked: str = _ITEMS, name: str = "sparse") -> str:
    return f"""{_POSTED}, {asked},
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_TOK}) AS term FROM asked) GROUP BY ALL),
sc AS (SELECT query_id, post.doc_id, sum(qtf * idf * (tf * 2.5::DOUBLE) / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score
  FROM qt JOIN term USING (term) JOIN post USING (term) JOIN dl USING (doc_id), corp GROUP BY ALL),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc WHERE score > 0) WHERE rank <= {k})"""


_COS = "list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))"


def _dense(k: int, shift: int = 0, name: str = "dense") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT item_id AS query_id, v.vec_id AS doc_id, {_COS} AS score,
  row_number() OVER (PARTITION BY item_id ORDER BY round({_COS}, 9) DESC, v.vec_id) AS rank
  FROM benchmark JOIN embeddings q ON q.vec_id = item_id + {shift}, embeddings v) WHERE rank <= {k})"""


_QRELS = """qrels AS (SELECT b.item_id AS query_id, d.doc_id, CASE WHEN contains(d.text, b.text) THEN 2 ELSE 1 END AS rel
  FROM documents d JOIN benchmark b ON length(b.text) > 0 AND contains(d.text, substr(b.text, 1, 24)))"""
_CASES = """cases AS (SELECT query_id, min_by(lang, doc_id) AS tag, list(doc_id ORDER BY doc_id) AS relevant FROM qrels JOIN documents USING (doc_id) WHERE rel = 2 GROUP BY query_id)"""


def _ranks(run: str, name: str = "ranks") -> str:
    return f"""{name} AS (SELECT c.query_id, c.tag, min(r.rank) AS chunk_rank FROM cases c LEFT JOIN {run} r ON r.query_id = c.query_id AND list_contains(c.relevant, r.doc_id) GROUP BY ALL)"""


_FUSED = """merged AS (SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.doc_id, s.doc_id) AS doc_id, d.rank AS dense_rank, s.rank AS bm25_rank, d.score AS dense_score, s.score AS bm25_score
  FROM dense d FULL JOIN sparse s ON s.query_id = d.query_id AND s.doc_id = d.doc_id)"""
_RRF = "(coalesce(1.0::DOUBLE / (60 + dense_rank), 0) + coalesce(1.0::DOUBLE / (60 + bm25_rank), 0))"


def _hybrid(keep: int) -> str:
    return f"""{_FUSED}, hybrid AS (SELECT * FROM (SELECT *, {_RRF} AS rrf, coalesce(max(dense_score) OVER (PARTITION BY query_id), 0) AS relevance,
  row_number() OVER (PARTITION BY query_id ORDER BY round({_RRF}, 12) DESC, dense_rank ASC NULLS LAST, bm25_rank ASC NULLS LAST) AS rank FROM merged) WHERE rank <= {keep})"""


_W = "(w * coalesce(1.0::DOUBLE / (60 + bm25_rank), 0) + (1.0::DOUBLE - w) * coalesce(1.0::DOUBLE / (60 + dense_rank), 0))"
_WEIGHTED = f"""{_FUSED}, ws AS (SELECT CAST(unnest([0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS DOUBLE) AS w),
weighted AS (SELECT * FROM (SELECT w AS weight, query_id, doc_id, {_W} AS rrf,
  row_number() OVER (PARTITION BY w, query_id ORDER BY round({_W}, 12) DESC, bm25_rank ASC NULLS LAST, dense_rank ASC NULLS LAST) AS rank FROM merged, ws) WHERE rank <= 100)"""


def _graded(run: str, arms: str, by: str) -> str:
    """Metrics of ``run`` for each arm (a table with the columns ``by``)."""
    b = f"{by}, " if by else ""
    return f"""ideal AS (SELECT query_id, sum(CASE WHEN pos <= 10 THEN rel / log2(pos + 1) END) AS ideal, count(*) AS n_rel
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, doc_id) AS pos FROM qrels) GROUP BY query_id),
hit AS (SELECT {b}query_id, rank, rel, count(*) OVER (PARTITION BY {b}query_id ORDER BY rank) AS cum FROM {run} JOIN qrels USING (query_id, doc_id) WHERE rank <= 100),
per AS (SELECT {b}query_id, sum(CASE WHEN rank <= 10 THEN rel / log2(rank + 1) ELSE 0 END) AS dcg, count(*) AS got, sum(cum / rank) AS ap FROM hit GROUP BY ALL),
graded AS (SELECT {b}count(*) AS queries, avg(coalesce(dcg / ideal, 0)) AS ndcg, avg(coalesce(got / n_rel, 0)) AS recall, avg(coalesce(ap / n_rel, 0)) AS map
  FROM (SELECT * FROM ideal{arms}) LEFT JOIN per USING ({b}query_id) GROUP BY {by or "ALL"})"""


def _recall(ranks: str) -> str:
    cols = "count(*) AS n, CAST(sum(CASE WHEN chunk_rank <= 5 THEN 1 ELSE 0 END) AS BIGINT) AS hits, round(avg(CASE WHEN chunk_rank <= 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall, round(avg(coalesce(1.0::DOUBLE / chunk_rank, 0)), 6) AS mrr"
    return f"SELECT NULL::VARCHAR AS tag, {cols} FROM {ranks} UNION ALL SELECT tag, {cols} FROM {ranks} GROUP BY tag"


_GATED = f"""near AS (SELECT item_id AS query_id, v.vec_id, {_COS} AS score, row_number() OVER (PARTITION BY item_id ORDER BY round({_COS}, 9) DESC, v.vec_id) AS rank FROM benchmark JOIN embeddings q ON q.vec_id = item_id, embeddings v),
gated AS (SELECT item_id AS query_id, round(coalesce(max(score), 0), 6) AS relevance, item_id IN (SELECT query_id FROM qrels WHERE rel = 2) AS positive FROM benchmark LEFT JOIN near ON near.query_id = item_id AND rank <= 2 AND vec_id <> item_id GROUP BY item_id)"""

_WORDS = r"list_filter(string_split_regex(trim(text, E' \t\n\r'), '[ \t\n\r\x0B\f]+'), lambda x: x <> '')"
_SPLIT = r"string_split_regex(text, '\s+')"
_VARIANTS = rf"""vars AS (
  SELECT query_id, 0 AS variant, text FROM asked0 UNION ALL
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY pos) AS INTEGER), v FROM (
    SELECT query_id, text, 0 AS pos, array_to_string(list_slice(w, 1, CAST(ceil(len(w) / 2) AS INTEGER)), ' ') AS v FROM (SELECT *, list_filter({_SPLIT}, lambda x: x <> '') AS w FROM asked0)
    UNION ALL SELECT query_id, text, 1, lower(text) FROM asked0) WHERE lower(v) <> lower(text))"""
_ASKED0 = "asked0 AS (SELECT item_id AS query_id, text FROM benchmark)"


_BLOCKS = r"""line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents WHERE text IS NOT NULL),
raw AS (SELECT doc_id, n // 12 AS page, n AS block_no, CAST(50 + 270 * (n % 12 % 2) AS DOUBLE) AS x0, CAST(40 + 110 * (n % 12 // 2) AS DOUBLE) AS y0, line,
  CASE WHEN (n * 7 + doc_id) % 5 = 0 THEN CASE WHEN n % 2 = 0 THEN 'Figure ' ELSE 'Table ' END || n % 3 || ': ' ELSE '' END || line AS text FROM line),
sized AS (SELECT * EXCLUDE (line), x0 + 230 - (length(line) * 7) % 40 AS x1, y0 + 20 + length(line) % 60 AS y1, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) >= 8 AS prose FROM raw),
blocks AS (SELECT *, prose AND length(regexp_replace(text, '[^\p{Nd}✓✗×√±%|]', '', 'g')) / greatest(length(text), 1) <= 0.10 AND (length(text) - length(replace(text, '. ', ''))) + (length(text) - length(replace(text, ', ', ''))) >= 2 AS sentence FROM sized),
cand AS (SELECT *, CASE WHEN starts_with(lower(regexp_extract(text, '^\s*(fig(?:ure)?\.?|table)\s*(\d+)\s*[:.]\s*(\S.*)', 1, 'is')), 'fig') THEN 'figure' ELSE 'table' END AS kind, regexp_extract(text, '^\s*(fig(?:ure)?\.?|table)\s*(\d+)\s*[:.]\s*(\S.*)', 2, 'is') AS number,
  trim(regexp_replace(regexp_extract(text, '^\s*(fig(?:ure)?\.?|table)\s*(\d+)\s*[:.]\s*(\S.*)', 3, 'is'), '\s+', ' ', 'g')) AS caption FROM blocks WHERE regexp_matches(text, '^\s*(fig(?:ure)?\.?|table)\s*(\d+)\s*[:.]\s*(\S.*)', 'is')),
caps AS (SELECT * FROM (SELECT *, doc_id || '-p' || page || '-' || kind || number AS figure_id, row_number() OVER (PARTITION BY doc_id, page, kind, number ORDER BY round(y0, 1), x0, block_no) AS place FROM cand WHERE length(caption) >= 25) WHERE place = 1)"""


def _answered() -> str:
    return f"""blob AS (SELECT query_id, string_agg(text, ' ' ORDER BY rank) AS blob, min(CASE WHEN lang = 'en' THEN rank END) AS table_rank FROM sparse JOIN documents USING (doc_id) GROUP BY query_id),
ans AS (SELECT item_id AS query_id, coalesce(contains(blob, substr(text, 1, 30)) OR contains(blob, 'no such anchor'), false) AS answerable, table_rank FROM benchmark LEFT JOIN blob ON query_id = item_id)"""


def sql() -> dict[str, str]:
    out = {}
    out["doc_tokens_stats"] = f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_terms FROM (SELECT doc_id, {_TOK} AS t FROM documents)"
    out["bm25_term_stats"] = f"WITH {_POSTED} SELECT term, df, round(idf, 6) AS idf FROM term"
    out["bm25_topk"] = f"WITH {_bm25(8)} SELECT query_id, rank, doc_id, round(score, 6) AS score FROM sparse"
    known = f"asked AS (SELECT doc_id AS query_id, array_to_string(list_slice(h, 1, greatest(3, CAST(floor(len(h) * 0.6) AS INTEGER))), ' ') AS text FROM (SELECT doc_id, list_slice({_TOK}, 1, 12) AS h FROM documents WHERE doc_id % 50 = 0))"
    out["bm25_known_item"] = f"WITH {_bm25(5, known)} SELECT count(*) AS queries, round(avg(CASE WHEN rank <= 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_1, round(avg(CASE WHEN rank <= 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_5 FROM asked LEFT JOIN (SELECT query_id, rank FROM sparse WHERE query_id = doc_id) USING (query_id)"
    near = f"SELECT q.vec_id AS query_id, v.vec_id, {_COS} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COS}, 9) DESC, v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0"
    out["dense_topk"] = f"SELECT query_id, rank, vec_id, round(score, 6) AS score FROM ({near}) WHERE rank <= 8"
    out["dense_relevance_gate"] = f"SELECT query_id, round(relevance, 6) AS relevance, relevance < 0.35 AS below_gate FROM (SELECT e.vec_id AS query_id, coalesce(max(score), 0) AS relevance FROM embeddings e LEFT JOIN (SELECT * FROM ({near}) WHERE rank <= 2 AND vec_id <> query_id) n ON n.query_id = e.vec_id WHERE e.vec_id % 50 = 0 GROUP BY e.vec_id)"
    both = f"WITH RECURSIVE {_bm25(8)}, {_dense(8)}"
    out["hybrid_rrf"] = f"{both}, {_hybrid(5)} SELECT query_id, rank, doc_id, dense_rank, bm25_rank, round(coalesce(dense_score, bm25_score), 6) AS score, round(rrf, 5) AS rrf_score, round(relevance, 6) AS relevance FROM hybrid"
    kr = "(coalesce(1.0::DOUBLE / (k + dense_rank), 0) + coalesce(1.0::DOUBLE / (k + bm25_rank), 0))"
    out["hybrid_rrf_k_sweep"] = f"{both}, {_FUSED} SELECT rrf_k, query_id, rank, doc_id FROM (SELECT CAST(k AS BIGINT) AS rrf_k, query_id, doc_id, row_number() OVER (PARTITION BY k, query_id ORDER BY round({kr}, 12) DESC, dense_rank ASC NULLS LAST, bm25_rank ASC NULLS LAST) AS rank FROM merged, (SELECT unnest([10, 60, 100]) AS k)) WHERE rank <= 5"
    out["weighted_rrf"] = f"{both}, {_WEIGHTED} SELECT weight, query_id, rank, doc_id, round(rrf, 9) AS rrf FROM weighted"
    sweep = f"WITH {_bm25(100)}, {_dense(100)}, {_WEIGHTED}, {_QRELS}, {_graded('weighted', ', (SELECT DISTINCT weight FROM weighted)', 'weight')}"
    out["weighted_rrf_sweep_ndcg"] = f"{sweep} SELECT weight, round(ndcg, 6) AS ndcg FROM graded"
    out["best_fusion_weight"] = f"{sweep}, best AS (SELECT * FROM graded ORDER BY round(ndcg, 12) DESC, weight LIMIT 1), one AS (SELECT max(ndcg) AS m FROM graded WHERE weight IN (0, 1)) SELECT weight, round(ndcg, 6) AS ndcg, round(ndcg - m, 6) AS gain, ndcg - m > 0.005 AS meaningful FROM best, one"
    out["expanded_queries"] = f"WITH {_ASKED0}, {_VARIANTS} SELECT query_id, CAST(variant AS BIGINT) AS variant, text FROM vars"
    multi = f"{_ASKED0}, {_VARIANTS}, asked AS (SELECT query_id * 10 + variant AS query_id, text FROM vars)"
    out["multi_variant_rrf"] = f"""WITH {_bm25(8, multi)}, {_dense(8)}, {_dense(8, 100, "dense1")},
lists AS (SELECT query_id // 10 AS query_id, query_id % 10 AS variant, 1 AS arm, rank, doc_id, score FROM sparse UNION ALL SELECT query_id, 0, 0, rank, doc_id, score FROM dense UNION ALL SELECT query_id, 1, 0, rank, doc_id, score FROM dense1),
f AS (SELECT query_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS rrf, min(CASE WHEN variant = 0 AND arm = 0 THEN rank END) AS dense_rank, min(CASE WHEN variant = 0 AND arm = 1 THEN rank END) AS bm25_rank,
  min(CASE WHEN variant = 0 AND arm = 0 THEN score END) AS dense_score, min(CASE WHEN variant = 0 AND arm = 1 THEN score END) AS bm25_score, count(DISTINCT variant) AS n_variants, min(variant * 1000 + arm * 500 + rank) AS first FROM lists GROUP BY ALL)
SELECT query_id, rank, doc_id, round(rrf, 9) AS rrf, dense_rank, bm25_rank, round(dense_score, 6) AS dense_score, round(bm25_score, 6) AS bm25_score, n_variants
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, first) AS rank FROM f) WHERE rank <= 5"""
    out["reranked"] = f"{both}, {_hybrid(20)} SELECT query_id, place AS rank, doc_id, rerank_score, rank AS fusion_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS place FROM (SELECT h.*, round(CAST(n_chars AS DOUBLE) / 1000, 4) AS rerank_score FROM hybrid h JOIN documents USING (doc_id))) WHERE place <= 5"
    out["figure_search"] = f"WITH {_bm25(100)} SELECT query_id, place AS rank, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM sparse JOIN documents USING (doc_id) WHERE lang = 'es') WHERE place <= 3"
    judged = f"WITH {_bm25(8)}, {_dense(8)}, {_QRELS}, {_CASES}"
    out["paper_vs_chunk_mrr"] = f"""{judged}, want AS (SELECT query_id, list(DISTINCT source) AS papers FROM qrels JOIN documents USING (doc_id) WHERE rel = 2 GROUP BY query_id),
src AS (SELECT query_id, source, min(rank) AS chunk_rank FROM sparse JOIN documents USING (doc_id) GROUP BY ALL), pl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY chunk_rank) AS paper_rank FROM src)
SELECT w.query_id, min(chunk_rank) AS chunk_rank, min(paper_rank) AS paper_rank FROM want w LEFT JOIN pl ON pl.query_id = w.query_id AND list_contains(papers, source) GROUP BY w.query_id"""
    out["recall_mrr_by_tag"] = f"{judged}, {_ranks('sparse')} SELECT *, recall AS paper_recall, mrr AS paper_mrr FROM ({_recall('ranks')})"
    modes = f"{judged}, {_hybrid(5)}, {_ranks('dense', 'r1')}, {_ranks('sparse', 'r2')}, {_ranks('hybrid', 'r3')}, every AS (SELECT 'dense' AS mode, * FROM r1 UNION ALL SELECT 'bm25', * FROM r2 UNION ALL SELECT 'hybrid', * FROM r3)"
    tags = ", ".join(f"round(avg(CASE WHEN tag = '{t}' THEN CASE WHEN chunk_rank <= 5 THEN 1.0::DOUBLE ELSE 0 END END), 6) AS {t}" for t in ("de", "en", "es", "fr"))
    out["ablation_pivot"] = f"{modes} SELECT mode, {tags} FROM every GROUP BY mode"
    out["ndcg_map_recall"] = f"WITH {_bm25(100)}, {_QRELS}, {_graded('sparse', '', '')} SELECT queries, round(ndcg, 6) AS ndcg, round(recall, 6) AS recall, round(map, 6) AS map, CASE WHEN round(ndcg, 6) > 0.665 * 1.25 THEN 'suspect: above published' WHEN round(ndcg, 6) < 0.665 * 0.6 THEN 'suspect: below published' ELSE 'plausible' END AS verdict FROM graded"
    out["judged_queries"] = f"WITH {_QRELS} SELECT DISTINCT query_id FROM qrels"
    gated = f"WITH {_QRELS}, {_GATED}"
    out["gate_threshold_sweep"] = f"{gated} SELECT t AS threshold, count(*) FILTER (positive AND relevance < t) AS false_abstain, count(*) FILTER (positive) AS positives, count(*) FILTER (NOT positive AND relevance < t) AS caught, count(*) FILTER (NOT positive) AS negatives FROM gated, (SELECT CAST(unnest([0.25, 0.30, 0.35, 0.37, 0.40, 0.45, 0.50]) AS DOUBLE) AS t) GROUP BY t"
    out["gate_separation"] = f"{gated} SELECT round(min(relevance) FILTER (positive), 6) AS least_positive, round(max(relevance) FILTER (NOT positive), 6) AS most_negative, round(min(relevance) FILTER (positive) - max(relevance) FILTER (NOT positive), 6) AS separation FROM gated"
    out["gate_extremes"] = f"{gated} SELECT query_id, positive, relevance, place FROM (SELECT *, row_number() OVER (PARTITION BY positive ORDER BY CASE WHEN positive THEN relevance ELSE -relevance END, query_id) AS place FROM gated) WHERE place <= 4"
    trimmed = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
    w = r"list_filter(string_split_regex(t, '\s+'), lambda x: x <> '')"
    out["chunk_windows"] = f"""WITH a AS (SELECT doc_id, {trimmed} AS t FROM documents WHERE text IS NOT NULL), b AS (SELECT doc_id, t, {w} AS w FROM a), c AS (SELECT * FROM b WHERE len(w) >= 20),
e AS (SELECT doc_id, unnest(CASE WHEN len(w) <= 512 THEN [t] ELSE list_transform(range(0, len(w), 448), lambda i: array_to_string(list_slice(w, i + 1, i + 512), ' ')) END) AS x, generate_subscripts(CASE WHEN len(w) <= 512 THEN [t] ELSE list_transform(range(0, len(w), 448), lambda i: '') END, 1) - 1 AS i FROM c)
SELECT doc_id, doc_id || '_' || i AS chunk_id, CAST(i AS BIGINT) AS chunk_index, md5(x) AS text_md5 FROM e"""
    out["section_segments"] = r"""WITH m AS (SELECT page_id AS doc_id, regexp_replace(regexp_replace(coalesce(html, ''), '<h[1-6][^>]*>', chr(1) || '#', 'gi'), '</?(?:h[1-6]|p|li|ul|div|nav|footer|article|head|title|body|html|br)(?:\s[^>]*)?>', chr(1), 'gi') AS x FROM pages),
l AS (SELECT doc_id, unnest(string_split(x, chr(1))) AS raw, generate_subscripts(string_split(x, chr(1)), 1) AS no FROM m),
n AS (SELECT doc_id, no, starts_with(raw, '#') AS head, trim(regexp_replace(regexp_replace(regexp_replace(raw, '^#', ''), '<[^>]*>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g')) AS text FROM l),
s AS (SELECT *, sum(CAST(head AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY no) AS seg FROM n WHERE text <> '')
SELECT doc_id, CAST(seg AS BIGINT) AS seg_no, coalesce(max(text) FILTER (head), 'body') AS section, md5(string_agg(text, chr(10) ORDER BY no) FILTER (NOT head)) AS text_md5 FROM s GROUP BY doc_id, seg HAVING count(*) FILTER (NOT head) > 0"""
    out["noise_filter"] = "SELECT doc_id, CASE doc_id % 6 WHEN 2 THEN 'Method' ELSE 'Results' END AS section FROM documents WHERE doc_id % 6 IN (2, 5)"
    out["body_sizes"] = "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents), g AS (SELECT doc_id, CAST(length(t) % 3 + 9 AS DOUBLE) AS size, sum(length(t)) AS chars, min(no) AS first FROM l GROUP BY 1, 2) SELECT doc_id, body FROM (SELECT doc_id, size AS body, row_number() OVER (PARTITION BY doc_id ORDER BY chars DESC, first) AS r FROM g) WHERE r = 1"
    out["idempotent_append"] = "SELECT doc_id, lang, n_chars FROM documents"
    out["todo_anti_join"] = "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)"
    out["prune_plan"] = "SELECT reason, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes FROM (SELECT n_chars, CASE WHEN doc_id NOT IN (SELECT doc_id FROM labels) THEN 'not indexed' WHEN doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 'no figures' END AS reason FROM documents) WHERE reason IS NOT NULL GROUP BY reason"
    out["figure_reindex"] = "WITH t AS (SELECT doc_id, source FROM documents WHERE lang <> 'es') SELECT * FROM t UNION ALL SELECT doc_id, source FROM documents WHERE lang = 'es' AND doc_id % 2 = 0 AND source IN (SELECT source FROM t)"
    out["augmented_corpora"] = "SELECT 'base' AS corpus_id, count(*) AS chunks, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE lang <> 'es' UNION ALL SELECT 'augmented', count(*), CAST(sum(n_chars) AS BIGINT) FROM documents"
    out["index_health"] = "SELECT count(*) AS chunks, count(DISTINCT source) AS sources, CASE WHEN count(*) > 0 THEN 'ok' ELSE 'empty' END AS status, count(*) <= 80000 AS exact_search FROM documents"
    out["corpus_fingerprint"] = "SELECT count(*) AS chunks, CAST(sum(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT)) AS BIGINT) AS digest FROM documents"
    out["list_sources_first_title"] = "SELECT source, min_by(md5(text), doc_id) AS title, count(*) AS chunks FROM documents GROUP BY source"
    out["context_block"] = f"WITH {_bm25(5)}, c AS (SELECT query_id, string_agg('[' || rank || '] ' || source || ' (2024) — ' || lang || chr(10) || regexp_replace('as [6, 14] say ' || coalesce(text, ''), '\\[\\d+(?:\\s*,\\s*\\d+)*\\]', '', 'g'), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM sparse JOIN documents USING (doc_id) GROUP BY query_id) SELECT query_id, md5(context) AS context_md5, length(context) AS n_chars FROM c"
    out["citation_check"] = "WITH a AS (SELECT doc_id, doc_id % 6 AS n, list_sort(list_distinct(list_filter([doc_id % 9, 2, 99, n_chars % 30], lambda x: x >= 1 AND x <= doc_id % 6))) AS c FROM documents) SELECT doc_id AS query_id, coalesce(array_to_string(c, ','), '') AS cited, len(c) > 0 AS grounded FROM a"
    out["strip_cites"] = r"SELECT doc_id, md5(regexp_replace('POPE [17] and refs [6, 14, 17, 28] ' || text || ' [x] [1,2] [3 , 4]', '\[\d+(?:\s*,\s*\d+)*\]', '', 'g')) AS text_md5 FROM documents"
    out["token_dilution"] = r"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(substr(text, 1, 100)), '[a-z0-9][a-z0-9\-]{2,}') AS c, len(regexp_extract_all(lower(substr(text, 101)), '[a-z0-9][a-z0-9\-]{2,}')) AS d FROM documents),
df AS (SELECT w, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(c) AS w FROM t) GROUP BY w), rare AS (SELECT list(w) AS ws FROM df WHERE df / (SELECT count(*) FROM documents) < 0.05),
p AS (SELECT len(c) AS k, d, len(list_filter(c, lambda w: list_contains(ws, w))) AS r FROM t, rare)
SELECT round(avg(k), 6) AS caption_tokens, round(avg(d), 6) AS description_tokens, round(avg(k / greatest(k + d, 1)), 6) AS caption_share, round(avg(r / greatest(k, 1)), 6) AS rare_caption, round(avg(r / greatest(k + d, 1)), 6) AS rare_both FROM p"""
    answered = f"WITH {_bm25(5)}, {_answered()}"
    out["answerability"] = f"{answered} SELECT query_id, answerable, table_rank FROM ans"
    out["failure_diagnosis"] = f"WITH {_bm25(8, name='sparse8')}, sparse AS (SELECT * FROM sparse8 WHERE rank <= 5), {_answered()}, {_QRELS}, {_CASES}, {_ranks('sparse8')} SELECT CASE WHEN answerable THEN 'ok' WHEN chunk_rank IS NULL THEN 'not found' WHEN table_rank IS NOT NULL THEN 'structure' ELSE 'ranking' END AS diagnosis, count(*) AS cases FROM ans LEFT JOIN ranks USING (query_id) GROUP BY 1"
    out["figure_displacement"] = f"WITH {_bm25(5)} SELECT round(sum(CASE WHEN lang = 'es' THEN 1 ELSE 0 END) / (count(DISTINCT query_id) * 5), 6) AS share FROM sparse JOIN documents USING (doc_id)"
    out["metric_deltas"] = f"{judged}, {_ranks('dense', 'r1')}, {_ranks('sparse', 'r2')}, a AS ({_recall('r1').replace('round(avg', '(avg').replace(', 6)', ')')}), b AS ({_recall('r2').replace('round(avg', '(avg').replace(', 6)', ')')}) SELECT a.tag, round(b.recall - a.recall, 6) AS recall_delta, round(b.mrr - a.mrr, 6) AS mrr_delta FROM a JOIN b ON a.tag IS NOT DISTINCT FROM b.tag"
    out["candidate_audit"] = f"{judged}, p AS (SELECT c.query_id, min(CASE WHEN list_contains(relevant, s.doc_id) THEN rank END) AS place, count(*) FILTER (NOT list_contains(relevant, s.doc_id)) AS others FROM cases c LEFT JOIN sparse s USING (query_id) GROUP BY c.query_id) SELECT query_id, place, CASE WHEN place IS NULL THEN 'MISS' WHEN place = 1 THEN 'OK' WHEN others >= 3 THEN 'AMBIG' ELSE 'OK' END AS verdict FROM p"
    out["corpus_overlap_substring"] = "SELECT DISTINCT item_id AS query_id, doc_id, CAST(1 AS BIGINT) AS rel FROM documents d JOIN benchmark b ON substr(b.text, 1, 120) <> '' AND d.lang = 'en' AND length(d.text) >= 40 AND contains(d.text, substr(b.text, 1, 120))"
    out["longest_per_group"] = "SELECT source, md5(text) AS text_md5 FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC NULLS LAST, doc_id) AS r FROM documents) WHERE r = 1"
    rank = "(SELECT value FROM (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events WHERE value IS NOT NULL) WHERE i = CAST(round_even({0} * (n - 1), 0) AS BIGINT))"
    out["latency_percentiles"] = f"SELECT {rank.format('0.5::DOUBLE')} AS value, 0.5::DOUBLE AS share UNION ALL SELECT {rank.format('0.95::DOUBLE')}, 0.95::DOUBLE"
    out["interval_merge"] = """WITH e AS (SELECT user_id, epoch_us(ts) / 1e6 AS x0, epoch_us(ts) / 1e6 + value AS x1 FROM events WHERE value IS NOT NULL AND ts IS NOT NULL),
m AS (SELECT *, max(x1) OVER (PARTITION BY user_id ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR x0 > reach + 12 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM m)
SELECT user_id, CAST(island AS BIGINT) AS island, round(min(x0), 3) AS lo, round(max(x1), 3) AS hi FROM i GROUP BY user_id, island"""
    out["rejoined_lines"] = r"SELECT doc_id, md5(replace(regexp_replace(regexp_replace(regexp_replace('frac-' || chr(10) || 'tion of' || chr(10) || 'the' || chr(10) || 'Thing' || repeat(chr(10), 4) || 'End' || chr(10) || text, '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1\2', 'g'), '\n([a-z])', ' \1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '', '')) AS text_md5 FROM documents"
    out["figure_captions"] = f"WITH {_BLOCKS} SELECT figure_id, kind, number, md5(caption) AS caption_md5, block_no FROM caps"
    beside = "JOIN blocks b ON b.doc_id = c.doc_id AND b.page = c.page AND b.x1 > c.x0 AND b.x0 < c.x1"
    out["band_overlap"] = f"""WITH {_BLOCKS},
up AS (SELECT figure_id, max(b.y1) FILTER (b.prose) AS a, max(b.y1) FILTER (b.sentence) AS t FROM caps c {beside} AND b.y1 <= c.y0 GROUP BY figure_id),
down AS (SELECT figure_id, min(b.y0) FILTER (b.sentence) AS f FROM caps c {beside} AND b.y0 >= c.y1 GROUP BY figure_id),
cols AS (SELECT doc_id, page, count(*) FILTER (x1 <= 300) >= 3 AND count(*) FILTER (x1 > 300 AND x0 >= 300) >= 3 AS two FROM blocks WHERE sentence GROUP BY ALL)
SELECT figure_id, coalesce(a, 0) AS ceiling, coalesce(t, 0) AS table_ceiling, coalesce(f, 800) AS floor,
  CASE WHEN two AND x1 - x0 <= 360 AND (x0 + x1) / 2 > 300 THEN 300::DOUBLE ELSE 0 END AS lo, CASE WHEN two AND x1 - x0 <= 360 AND (x0 + x1) / 2 <= 300 THEN 300::DOUBLE ELSE 600 END AS hi
FROM caps LEFT JOIN up USING (figure_id) LEFT JOIN down USING (figure_id) LEFT JOIN cols USING (doc_id, page)"""
    out["band_contents"] = f"""WITH {_BLOCKS},
up AS (SELECT figure_id, max(b.y1) AS a FROM caps c {beside} AND b.y1 <= c.y0 AND b.prose GROUP BY figure_id),
band AS (SELECT figure_id, doc_id, page, x0 - 6 AS x0, coalesce(a, 0) AS y0, x1 + 6 AS x1, y0 AS y1 FROM caps LEFT JOIN up USING (figure_id) WHERE y0 - coalesce(a, 0) >= 40),
g AS (SELECT doc_id, page, CASE WHEN block_no % 3 = 0 THEN 'drawing' ELSE 'image' END AS kind, x0 + 15 AS x0, y0 + 15 AS y0, x1 + 15 AS x1, y1 + 15 AS y1 FROM blocks WHERE block_no % 3 = 0 OR block_no % 7 = 0),
t AS (SELECT figure_id, CAST(sum(length(text)) AS BIGINT) AS chars FROM band c JOIN blocks b ON b.doc_id = c.doc_id AND b.page = c.page AND b.x0 < c.x1 AND b.x1 > c.x0 AND b.y0 < c.y1 AND b.y1 > c.y0 AND b.x1 > b.x0 AND b.y1 > b.y0 GROUP BY figure_id),
e AS (SELECT figure_id, min(b.x0) AS gx0, min(b.y0) AS gy0, max(b.x1) AS gx1, max(b.y1) AS gy1, count(*) FILTER (kind = 'drawing') AS n_drawings, count(*) FILTER (kind = 'image') AS n_images FROM band c JOIN g b ON b.doc_id = c.doc_id AND b.page = c.page AND b.x0 < c.x1 AND b.x1 > c.x0 AND b.y0 < c.y1 AND b.y1 > c.y0 GROUP BY figure_id)
SELECT figure_id, coalesce(chars, 0) AS chars, gx0, gy0, gx1, gy1, coalesce(n_drawings, 0) AS n_drawings, coalesce(n_images, 0) AS n_images FROM band LEFT JOIN t USING (figure_id) LEFT JOIN e USING (figure_id)"""
    out["section_pattern"] = "SELECT * FROM (VALUES ('a', 'body', 'front matter'), ('a', 'Abstract', 'short text'), ('a', '1. Introduction', 'some words, 12 more.'), ('b', 'body', 'nothing here')) t(doc_id, section, text)"
    return out

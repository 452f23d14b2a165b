"""The registered queries ``opN_<name>`` of this subpackage, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import decontaminate
from .html_text import extract
from .lm_score import score_texts
from .mixing import mix_sources, number_domain
from .near_dedup import near_duplicates
from .quality import classify, train
from .secret_scan import scan
from .secret_scan import train as train_field
from .sharding import shard
from .spotsigs import fingerprints
from .substring_dedup import remove_repeats

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(generate_series(1, len(w) - 49)) AS p, w FROM d WHERE len(w) >= 50
), k AS (
  SELECT doc_id, p, md5(array_to_string(list_slice(w, p, p + 49), ' ')) AS h FROM s
), f AS (
  SELECT h, min(doc_id) AS least FROM k GROUP BY h
), g AS (
  SELECT DISTINCT doc_id, unnest(generate_series(p, p + 49)) AS pos FROM k JOIN f USING (h) WHERE doc_id > least
), r AS (
  SELECT doc_id, list(pos) AS gone FROM g GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=2, similarity=(80, 100))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM d
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 80 * (na.n + nb.n - shared)
), r AS (
  SELECT doc_id, doc_id AS c FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.c = l.a
), m AS (
  SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents read back from the compacted store."""
    kept = shard(table(spark, sf_dir, "documents")).read()
    return kept.select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("text_sha256"))


OP1_SQL = "SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256 FROM documents"

MIX_DOMAINS = {"domain0": 40, "domain1": 30, "domain2": 20, "domain3": 10}
MIX_LANGS = {"en": 55, "fr": 15, "de": 15, "es": 15}


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mix_sources(docs, number_domain(F.col("source")), domain_weights=MIX_DOMAINS, lang_weights=MIX_LANGS, budget_share=0.6, max_epochs=2, seed=17)
    return mixed.select("doc_id", "domain", "lang", "source", "n_tokens", "epoch")


def _share_sql(nodes: str, parent: str) -> str:
    """SQL for the parts of a family: nodes(<parent>, name, capacity, weight, budget)."""
    by = f"PARTITION BY {parent}" if parent else ""
    order = f"{by} ORDER BY CASE WHEN weight > 0 THEN capacity / weight END ASC NULLS LAST, name"
    return f"""
      SELECT *, CASE WHEN is_full THEN capacity ELSE least(capacity, CASE WHEN weight_open > 0 THEN ((budget - full_sum) * weight) // weight_open ELSE 0 END) END AS given FROM (
        SELECT *, sum(CASE WHEN is_full THEN capacity ELSE 0 END) OVER ({by}) AS full_sum, sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ({by}) AS weight_open FROM (
          SELECT *, weight > 0 AND capacity * weight_on <= (budget - full_before) * weight AS is_full FROM (
            SELECT *, coalesce(sum(capacity) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
              sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_on FROM {nodes})))"""


def _weight_sql(column: str, given: dict[str, int]) -> str:
    return "CASE " + column + "".join(f" WHEN '{k}' THEN {v}" for k, v in given.items()) + " ELSE 100 END"


OP4_SQL = rf"""
WITH t AS (
  SELECT doc_id, lang, source, coalesce(lang, '(none)') AS l, coalesce(source, '(none)') AS s,
    coalesce('domain' || (TRY_CAST(nullif(regexp_extract(source, '([0-9]{{1,9}})', 1), '') AS INT) % 4), '(none)') AS d,
    coalesce(len(regexp_extract_all(text, '[^ 	-
]+')), 0)::BIGINT AS n FROM documents
), leaf AS (
  SELECT d, l, s, sum(n) AS tokens, sum(n) * 2 AS capacity FROM t GROUP BY ALL
), total AS (
  SELECT sum(tokens) * 600000 // 1000000 AS budget FROM leaf
), d1 AS (
  SELECT d AS name, sum(capacity) AS capacity, {_weight_sql("d", MIX_DOMAINS)} AS weight, (SELECT budget FROM total) AS budget FROM leaf GROUP BY d
), d2 AS ({_share_sql("d1", "")}), l1 AS (
  SELECT leaf.d, l AS name, sum(leaf.capacity) AS capacity, {_weight_sql("l", MIX_LANGS)} AS weight, any_value(given) AS budget FROM leaf JOIN d2 ON d2.name = leaf.d GROUP BY leaf.d, l
), l2 AS ({_share_sql("l1", "d")}), s1 AS (
  SELECT leaf.d, leaf.l, s AS name, leaf.tokens, leaf.capacity, 100 AS weight, given AS budget FROM leaf JOIN l2 ON l2.d = leaf.d AND l2.name = leaf.l
), s2 AS ({_share_sql("s1", "d, l")}), p AS (
  SELECT d, l, name AS s, tokens, CASE WHEN tokens > 0 THEN given // tokens ELSE 0 END AS whole, CASE WHEN tokens > 0 THEN given % tokens ELSE 0 END AS rest FROM s2
), o AS (
  SELECT t.*, whole, rest, md5('17:' || whole || ':' || doc_id) AS place FROM t JOIN p USING (d, l, s)
), c AS (
  SELECT *, sum(n) OVER (PARTITION BY d, l, s ORDER BY place) AS upto FROM o
), e AS (
  SELECT *, whole + CASE WHEN rest > 0 AND place < coalesce(min(CASE WHEN upto > rest THEN place END) OVER (PARTITION BY d, l, s), 'z') THEN 1 ELSE 0 END AS times FROM c
)
SELECT doc_id, d AS domain, lang, source, n AS n_tokens, CAST(unnest(range(CAST(times AS BIGINT))) AS BIGINT) AS epoch FROM e WHERE times > 0
"""


def op6_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).withColumn("n_chars", F.length("text").cast("long"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    best = F.aggregate("found", F.lit(0.0), lambda acc, x: F.greatest(acc, x["coverage"]))
    return judged.select("doc_id", "contaminated", F.transform("found", lambda x: x["item_id"]).alias("item_ids"), F.round(best, 6).alias("coverage"))


def bad_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given labels: bad is low quality or toxic."""
    return table(spark, sf_dir, "labels").select("doc_id", ((F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)).alias("bad"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, train(docs, bad_labels(spark, sf_dir))).select("doc_id", F.round("weak_bad", 6).alias("weak_bad"), F.round("score", 6).alias("score"), "accepted")


def op8_spotsigs_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, train_field(docs))
    base = F.filter("spans", lambda x: x["kind"] != "field")

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_sharding": op1_sharding,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_quality_classifier": op3_quality_classifier,
        "op4_source_mixing": op4_source_mixing,
        "op5_lm_score": op5_lm_score,
        "op6_html_main_text": op6_html_main_text,
        "op7_secret_scan": op7_secret_scan,
        "op8_spotsigs_fingerprints": op8_spotsigs_fingerprints,
        "op9_benchmark_decontamination": op9_benchmark_decontamination,
        "op10_minhash_near_dedup": op10_minhash_near_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": OP1_SQL, "op2_substring_dedup": OP2_SQL, "op4_source_mixing": OP4_SQL, "op10_minhash_near_dedup": OP10_SQL}

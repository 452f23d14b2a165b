"""Retrieval metrics and evaluation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions.text import base_id


def first_ranks(cases: DataFrame, hits: DataFrame, paper: Column | None = None) -> DataFrame:
    """(query_id, tag, chunk_rank, paper_rank) of cases(query_id, tag, relevant) against hits(query_id, rank, source).

    Both sides lose their version suffix. chunk_rank: first hit of a relevant source; paper_rank:
    the same after each source is counted once, at its first appearance."""
    src = base_id(F.col("source")) if paper is None else paper
    want = cases.select("query_id", F.explode(F.array_distinct(F.transform("relevant", base_id))).alias("src"))
    seen = hits.select("query_id", "rank", src.alias("src")).groupBy("query_id", "src").agg(F.min("rank").alias("chunk_rank"))
    placed = seen.withColumn("paper_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("chunk_rank")))
    best = placed.join(want, ["query_id", "src"]).groupBy("query_id").agg(F.min("chunk_rank").alias("chunk_rank"), F.min("paper_rank").alias("paper_rank"))
    return cases.where(F.size("relevant") > 0).select("query_id", "tag").join(best, "query_id", "left")


def recall_mrr(ranks: DataFrame, k: int = 5, by: list[str] | None = None) -> DataFrame:
    """Recall at k and mean reciprocal rank, for chunks and for papers; total (tag NULL) and by tag in one pass."""
    by = by or []
    hit = lambda c: F.when(F.col(c) <= k, 1.0).otherwise(0.0)
    rr = lambda c: F.coalesce(F.lit(1.0) / F.col(c), F.lit(0.0))
    aggs = [
        F.count(F.lit(1)).alias("n"), F.sum(hit("chunk_rank")).cast("long").alias("hits"), F.avg(hit("chunk_rank")).alias("recall"), F.avg(rr("chunk_rank")).alias("mrr"),
        F.avg(hit("paper_rank")).alias("paper_recall"), F.avg(rr("paper_rank")).alias("paper_mrr"),
    ]
    total = ranks.groupBy(*by).agg(*aggs).withColumn("tag", F.lit(None).cast("string"))
    tagged = ranks.groupBy(*by, "tag").agg(*aggs)
    return total.unionByName(tagged)


def ablation(ranks: DataFrame, tags: list[str], k: int = 5) -> DataFrame:
    """Recall of each mode (row) for each tag (column)."""
    share = F.avg(F.when(F.col("chunk_rank") <= k, 1.0).otherwise(0.0))
    return ranks.groupBy("mode").pivot("tag", tags).agg(F.round(share, 6))


def graded_metrics(qrels: DataFrame, runs: DataFrame, by: list[str] | None = None, depth: int = 100, cut: int = 10) -> DataFrame:
    """Mean nDCG at ``cut``, recall at ``depth`` and average precision over judged queries.

    qrels(query_id, doc_id, rel), runs(by..., query_id, doc_id, rank). Linear gain; relevance of 1 or
    more counts for recall and precision; a judged query without results scores 0."""
    by = by or []
    judged = qrels.where("rel > 0")
    order = Window.partitionBy("query_id").orderBy(F.col("rel").desc(), "doc_id")
    ideal = judged.withColumn("pos", F.row_number().over(order)).groupBy("query_id").agg(F.sum(F.when(F.col("pos") <= cut, F.col("rel") / F.log2(F.col("pos") + F.lit(1.0)))).alias("ideal"), F.count(F.lit(1)).alias("n_rel"))
    hit = runs.where(F.col("rank") <= depth).join(judged, ["query_id", "doc_id"])
    found = Window.partitionBy(*by, "query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hit = hit.withColumn("cum", F.count(F.lit(1)).over(found))
    per = hit.groupBy(*by, "query_id").agg(F.sum(F.when(F.col("rank") <= cut, F.col("rel") / F.log2(F.col("rank") + F.lit(1.0))).otherwise(0.0)).alias("dcg"), F.count(F.lit(1)).alias("got"), F.sum(F.col("cum") / F.col("rank")).alias("ap"))
    if by:
        arms = runs.agg(F.collect_set(F.struct(*by)).alias("arms"))  # one row: the few settings that are compared
        base = ideal.join(F.broadcast(arms)).select(*ideal.columns, F.explode("arms").alias("arm")).select(*ideal.columns, "arm.*")
        scored = base.join(per, [*by, "query_id"], "left")
    else:
        scored = ideal.join(per, "query_id", "left")
    part = lambda c: F.coalesce(c, F.lit(0.0))
    return scored.groupBy(*by).agg(F.count(F.lit(1)).alias("queries"), F.avg(part(F.col("dcg") / F.col("ideal"))).alias("ndcg"), F.avg(part(F.col("got") / F.col("n_rel"))).alias("recall"), F.avg(part(F.col("ap") / F.col("n_rel"))).alias("map"))


def judged_only(queries: DataFrame, qrels: DataFrame, limit: int | None = None) -> DataFrame:
    kept = queries.join(qrels.select("query_id").distinct(), "query_id", "left_semi")
    return kept.orderBy("query_id").limit(limit) if limit else kept


def verdict(got: Column, published: Column) -> Column:
    """Plausibility of a score against a published one."""
    return F.when(published.isNull(), F.lit(None)).when(got > published * 1.25, "suspect: above published").when(got < published * 0.6, "suspect: below published").otherwise("plausible")


def gate_sweep(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """scored(query_id, positive, relevance): for each threshold, positives refused and negatives caught."""
    each = scored.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    below = F.col("relevance") < F.col("threshold")
    return each.groupBy("threshold").agg(F.count_if(F.col("positive") & below).alias("false_abstain"), F.count_if(F.col("positive")).alias("positives"), F.count_if(~F.col("positive") & below).alias("caught"), F.count_if(~F.col("positive")).alias("negatives"))


def separation(scored: DataFrame) -> DataFrame:
    low = F.min(F.when(F.col("positive"), F.col("relevance")))
    high = F.max(F.when(~F.col("positive"), F.col("relevance")))
    return scored.agg(low.alias("least_positive"), high.alias("most_negative"), (low - high).alias("separation"))


def extremes(scored: DataFrame, k: int = 4) -> DataFrame:
    """The k lowest positives and the k highest negatives."""
    key = F.when(F.col("positive"), F.col("relevance")).otherwise(-F.col("relevance"))
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("positive").orderBy(key, "query_id"))).where(F.col("place") <= k)


def best_weight(metrics: DataFrame, meaningful: float = 0.005) -> DataFrame:
    """metrics(weight, ndcg): the best weight (the first on ties), its gain over the better single arm, and whether that is meaningful."""
    top = F.max_by("weight", F.struct(F.round("ndcg", 12), -F.col("weight")))
    single = F.max(F.when(F.col("weight").isin(0.0, 1.0), F.col("ndcg")))
    return metrics.agg(top.alias("weight"), F.max("ndcg").alias("ndcg"), (F.max("ndcg") - single).alias("gain")).withColumn("meaningful", F.col("gain") > meaningful)


def displacement(hits: DataFrame, figures: DataFrame, k: int = 5) -> DataFrame:
    """Share of the first k places that figures take."""
    flagged = hits.where(F.col("rank") <= k).join(figures.select("doc_id").distinct().withColumn("is_figure", F.lit(1)), "doc_id", "left")
    return flagged.agg((F.sum(F.coalesce("is_figure", F.lit(0))) / (F.count_distinct("query_id") * k)).alias("share"))


def deltas(base: DataFrame, other: DataFrame, on: str = "tag") -> DataFrame:
    """Differences of recall and mrr between two metric tables."""
    b = base.select(F.col(on).alias("k"), F.col("recall").alias("r0"), F.col("mrr").alias("m0"))
    o = other.select(F.col(on).alias("k2"), F.col("recall").alias("r1"), F.col("mrr").alias("m1"))
    return b.join(o, F.col("k").eqNullSafe(F.col("k2"))).select(F.col("k").alias(on), (F.col("r1") - F.col("r0")).alias("recall_delta"), (F.col("m1") - F.col("m0")).alias("mrr_delta"))


def answerability(cases: DataFrame, hits: DataFrame, k: int = 5) -> DataFrame:
    """cases(query_id, answer_anchors), hits(query_id, rank, doc_id, section, text): whether an anchor is in the first k texts, and the first table's rank."""
    scored = cases.where(F.size("answer_anchors") > 0)
    blob = hits.where(F.col("rank") <= k).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), " ").alias("blob"), F.min(F.when(F.col("doc_id").cast("string").contains("-table") | F.lower("section").startswith("table"), F.col("rank"))).alias("table_rank"))
    return scored.join(blob, "query_id", "left").withColumn("answerable", F.exists("answer_anchors", lambda a: F.coalesce(F.contains(F.col("blob"), a), F.lit(False)))).drop("blob")


def diagnose(answered: DataFrame) -> DataFrame:
    """answered(query_id, answerable, chunk_rank, table_rank) with a diagnosis."""
    return answered.withColumn("diagnosis", F.when(F.col("answerable"), "ok").when(F.col("chunk_rank").isNull(), "not found").when(F.col("table_rank").isNotNull(), "structure").otherwise("ranking"))


def dilution(pairs: DataFrame) -> DataFrame:
    """pairs(doc_id, caption, description): mean lengths, the caption's share and the density of rare caption tokens with and without the description."""
    toks = lambda c: F.regexp_extract_all(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(r"[a-z0-9][a-z0-9\-]{2,}"), F.lit(0))
    listed = pairs.select("doc_id", toks("caption").alias("c"), F.size(toks("description")).alias("d"))
    n = listed.agg(F.count(F.lit(1)).alias("n"))
    words = listed.select("doc_id", "d", F.size("c").alias("k"), F.posexplode_outer("c").alias("p", "w"))
    df = words.where("w IS NOT NULL").groupBy("w").agg(F.count_distinct("doc_id").alias("df")).join(F.broadcast(n)).select("w", (F.col("df") / F.col("n") < 0.05).alias("rare"))
    per = words.join(df, "w", "left").groupBy("doc_id", "k", "d").agg(F.sum(F.when(F.col("rare"), 1).otherwise(0)).alias("r"))
    most = lambda x: F.greatest(x, F.lit(1))
    both = F.col("k") + F.col("d")
    return per.agg(F.avg("k").alias("caption_tokens"), F.avg("d").alias("description_tokens"), F.avg(F.col("k") / most(both)).alias("caption_share"), F.avg(F.col("r") / most(F.col("k"))).alias("rare_caption"), F.avg(F.col("r") / most(both)).alias("rare_both"))


def audit(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """Verdict on drafted cases: OK, AMBIG or MISS by the place of the source among distinct papers."""
    seen = hits.select("query_id", "rank", base_id(F.col("source")).alias("src")).groupBy("query_id", "src").agg(F.min("rank").alias("r"))
    placed = seen.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("r")))
    want = cases.select("query_id", F.explode("relevant").alias("src")).withColumn("wanted", F.lit(True))
    per = placed.join(want, ["query_id", "src"], "left").groupBy("query_id").agg(F.min(F.when(F.col("wanted"), F.col("place"))).alias("place"), F.count_if(F.col("wanted").isNull()).alias("others"))
    out = cases.select("query_id").join(per, "query_id", "left")
    return out.withColumn("verdict", F.when(F.col("place").isNull(), "MISS").when(F.col("place") == 1, "OK").when(F.col("others") >= 3, "AMBIG").otherwise("OK"))


def longest(chunks: DataFrame, group: str, text: str, order: str) -> DataFrame:
    """The longest text of each group, the first in order on ties."""
    return chunks.groupBy(group).agg(F.max_by(text, F.struct(F.length(text), -F.col(order))).alias(text))


def draft_pool(indexed: DataFrame, labelled: DataFrame, drafted: DataFrame, n: int, seed: int = 7) -> DataFrame:
    rest = indexed.join(labelled, "doc_id", "left_anti").join(drafted, "doc_id", "left_anti")
    return rest.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(n)


def nearest_rank(values: DataFrame, column: str, share: float, cells: int = 1000) -> DataFrame:
    """Percentile by nearest rank: index round(share * (n - 1)) of the sorted values, halves to even.

    Values are counted by cells between approximate quantiles; only the values of the cell where
    the index falls are put in order, so no task sees all of them."""
    some = values.where(F.col(column).isNotNull()).select(F.col(column).alias("v"))
    n, edges = some.agg(F.count(F.lit(1)), F.percentile_approx("v", [k / cells for k in range(1, cells)], 10 * cells)).first()
    if not n:
        return some.agg(F.min("v").alias("value"))
    index = round(share * (n - 1))
    cell = F.size(F.filter(F.array(*[F.lit(e) for e in sorted(set(edges))]), lambda e: e < F.col("v")))
    counted = some.withColumn("cell", cell).groupBy("cell").count().collect()  # at most ``cells`` rows
    before, own = 0, 0
    for r in sorted(counted, key=lambda r: r.cell):
        if before + r["count"] > index:
            own = r.cell
            break
        before += r["count"]
    inside = some.withColumn("cell", cell).where(F.col("cell") == own).groupBy("v").count()
    upto = F.sum("count").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return inside.withColumn("upto", upto).where(F.col("upto") > index - before).agg(F.min("v").alias("value"))


def negatives(hits: DataFrame, cases: DataFrame, k: int = 5) -> DataFrame:
    """Of cases without a relevant source: how many, and the mean of their best scores (0 where nothing was found)."""
    best = hits.where(F.col("rank") <= k).groupBy("query_id").agg(F.max("score").alias("best"))
    return cases.select("query_id").join(best, "query_id", "left").agg(F.count(F.lit(1)).alias("negatives"), F.avg(F.coalesce("best", F.lit(0.0))).alias("mean_top_score"))


def known_item(asked: DataFrame, hits: DataFrame) -> DataFrame:
    """Recall at 1 and 5 of asked(query_id), where a query's own document is the one to find."""
    place = hits.where("query_id = doc_id").select("query_id", "rank")
    share = lambda k: F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0))
    return asked.select("query_id").join(place, "query_id", "left").agg(F.count(F.lit(1)).alias("queries"), share(1).alias("recall_1"), share(5).alias("recall_5"))


def known_item_verdict(base: DataFrame, other: DataFrame, least: float = -0.005) -> DataFrame:
    """Both recalls of two corpora (a row each), their differences, and whether the second one harms."""
    b, o = (x.select(*[F.col(c).alias(f"{n}_{c}") for c in ("recall_1", "recall_5")]) for n, x in (("base", base), ("other", other)))
    both = b.crossJoin(o).withColumn("delta_1", F.col("other_recall_1") - F.col("base_recall_1")).withColumn("delta_5", F.col("other_recall_5") - F.col("base_recall_5"))
    return both.withColumn("verdict", F.when(F.least("delta_1", "delta_5") < least, "harms").otherwise("harmless"))


def arms_table(arms: dict[str, DataFrame], cases: DataFrame, k: int = 5) -> DataFrame:
    """Recall and reciprocal ranks of several retrievers over the same cases and export, total and by tag: a column ``arm``."""
    ranks = None
    for name, hits in arms.items():
        part = first_ranks(cases, hits).withColumn("arm", F.lit(name))
        ranks = part if ranks is None else ranks.unionByName(part)
    return recall_mrr(ranks, k, ["arm"])

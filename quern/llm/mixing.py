"""Mixing sources to target weights by hierarchical budgets (DataFrame operations only).

The tree is domain / language / source.  A node's capacity is the tokens below it times
``max_epochs``, those under a weight of 0 left out.  From the root down, a node's budget is shared among its children by weight;
what a child cannot take goes to its siblings, by weight, and leaves the parent only when all
siblings are full -- and then the parent's own capacity, which its parent has already used,
was the limit.  The level of a family is found in one window pass over the children in order
of capacity / weight (exact, in whole tokens, rounded down).

A leaf with budget b and t tokens gives b div t whole epochs and then a prefix, of at most
b mod t tokens, of its documents in the order of a seeded hash for that epoch.  Running sums
never pass through one task for a hot leaf: token sums for each of 256 ranges of the hash find
the range where the prefix ends, those of 256 and 65536 ranges inside it the next ones, and only
the last range (a 2**32th of the leaf) is ordered row by row.  The result
is a cut-off for each leaf, applied to the documents in a map-side filter.

Defined results: a null or empty text has no tokens, costs nothing and goes where its place
in its leaf's epochs falls; a leaf without tokens gives nothing; null language or source is the node ``(none)``; rows that
repeat an id share its place in the order and are all taken or, at the cut, all left; an
empty table gives an empty result; columns of the input pass through, and the new ones
(domain, n_tokens, epoch) replace any of those names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .state import cut

NONE = "(none)"
LEAF = ["_domain", "_lang", "_source"]
#: Leaves up to this many are sent to every executor; more are joined by a shuffle.
MOST_BROADCAST = 20_000
#: Hexadecimal digits of a place by which the end of a prefix is narrowed down.
RANGES = (2, 4, 8)


def word_count(text: Column) -> Column:
    """Runs of characters other than space, \\t, \\n, \\x0b, \\f, \\r; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def number_domain(source: Column, domains: int = 4) -> Column:
    """``domain<k>`` from the number in a source's name."""
    number = F.nullif(F.regexp_extract(source, r"([0-9]{1,9})", 1), F.lit("")).cast("int")
    return F.coalesce(F.concat(F.lit("domain"), (number % domains).cast("string")), F.lit(NONE))


def _weight(name: Column, given: dict[str, int] | None, default: int) -> Column:
    if not given:
        return F.lit(default).cast("long")
    pairs = [F.lit(x) for k, v in given.items() for x in (k, int(v))]
    return F.coalesce(F.create_map(*pairs)[name], F.lit(default)).cast("long")


def _wide(name: str) -> Column:
    """A number whose products with weights stay exact."""
    return F.col(name).cast("decimal(38,0)")


def _usable(name: str = "capacity") -> Column:
    """Capacity that a node can give its parent."""
    return F.sum(F.when(F.col("weight") > 0, F.col(name)).otherwise(0))


def _share(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """``given`` of each node: its part of ``budget`` (the parent's), at most ``capacity``, by ``weight``."""
    order = Window.partitionBy(*parent).orderBy(F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).asc_nulls_last(), name) if parent else Window.partitionBy(F.lit(0)).orderBy(F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).asc_nulls_last(), name)
    family = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    n = nodes.withColumn("full_before", F.coalesce(F.sum("capacity").over(before), F.lit(0))).withColumn("weight_on", F.sum("weight").over(onward))
    n = n.withColumn("is_full", (F.col("weight") > 0) & (_wide("capacity") * _wide("weight_on") <= (_wide("budget") - _wide("full_before")) * _wide("weight")))
    n = n.withColumn("full", F.sum(F.when(F.col("is_full"), F.col("capacity")).otherwise(0)).over(family)).withColumn("weight_open", F.sum(F.when(F.col("is_full"), 0).otherwise(F.col("weight"))).over(family))
    open_share = F.expr("CASE WHEN weight_open > 0 THEN (CAST(budget - full AS DECIMAL(38,0)) * CAST(weight AS DECIMAL(38,0))) div CAST(weight_open AS DECIMAL(38,0)) ELSE 0L END")
    return n.withColumn("given", F.when(F.col("is_full"), F.col("capacity")).otherwise(F.least(open_share, F.col("capacity"))).cast("long")).drop("full_before", "weight_on", "is_full", "full", "weight_open")


def budgets(leaves: DataFrame, total: int, domain_weights: dict[str, int] | None, lang_weights: dict[str, int] | None, source_weights: dict[str, int] | None, default_weight: int, max_epochs: int) -> DataFrame:
    """``leaves(_domain, _lang, _source, tokens)`` with ``target``, the tokens each may give."""
    sources = leaves.withColumn("capacity", F.col("tokens") * max_epochs).withColumn("weight", _weight(F.col("_source"), source_weights, default_weight))
    langs = sources.groupBy("_domain", "_lang").agg(_usable().alias("capacity")).withColumn("weight", _weight(F.col("_lang"), lang_weights, default_weight))
    domains = langs.groupBy("_domain").agg(_usable().alias("capacity")).withColumn("weight", _weight(F.col("_domain"), domain_weights, default_weight))
    top = _share(domains.withColumn("budget", F.lit(int(total)).cast("long")), [], "_domain").select("_domain", F.col("given").alias("budget"))
    middle = _share(langs.join(top, "_domain"), ["_domain"], "_lang").select("_domain", "_lang", F.col("given").alias("budget"))
    return _share(sources.join(middle, ["_domain", "_lang"]), ["_domain", "_lang"], "_source").select(*LEAF, "tokens", F.col("given").alias("target"))


def _place(seed: int, epoch: Column, key: Column) -> Column:
    """Place of a document in an epoch's order: 32 hexadecimal digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit(NONE))))


def mix_sources(docs: DataFrame, domain: Column, lang: Column | None = None, source: Column | None = None, text_col: str = "text", id_col: str = "doc_id", budget_share: float = 0.6, budget_tokens: int | None = None, domain_weights: dict[str, int] | None = None, lang_weights: dict[str, int] | None = None, source_weights: dict[str, int] | None = None, default_weight: int = 100, max_epochs: int = 2, seed: int = 17) -> DataFrame:
    """The chosen rows of ``docs`` with domain, n_tokens and epoch (from 0), one for each time a document is used."""
    lang = F.col("lang") if lang is None else lang
    source = F.col("source") if source is None else source
    named = [F.coalesce(c.cast("string"), F.lit(NONE)).alias(n) for c, n in zip((domain, lang, source), LEAF, strict=True)]
    narrow = cut(docs.select(*named, F.col(id_col).alias("_id"), word_count(F.col(text_col)).alias("_tokens")))
    leaves = narrow.groupBy(*LEAF).agg(F.sum("_tokens").alias("tokens"))
    if budget_tokens is None:
        have = narrow.agg(F.sum("_tokens")).first()[0] or 0
        budget_tokens = have * round(budget_share * 1_000_000) // 1_000_000
    plan = budgets(leaves, budget_tokens, domain_weights, lang_weights, source_weights, default_weight, max_epochs)
    plan = cut(plan.withColumn("whole", F.expr("CASE WHEN tokens > 0 THEN target div tokens ELSE 0L END")).withColumn("rest", F.expr("CASE WHEN tokens > 0 THEN target % tokens ELSE 0L END")))
    few = plan.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    side = F.broadcast(plan) if few else plan

    placed = narrow.join(side, LEAF).where("rest > 0").withColumn("place", _place(seed, F.col("whole"), F.col("_id"))).select(*LEAF, "_tokens", "place")
    # where the prefix ends, by longer and longer beginnings of the place; what comes before is taken whole
    reached = plan.where("rest > 0").select(*LEAF, "rest", F.lit("").alias("range"), F.lit(0).cast("long").alias("taken"))
    for digits in (*RANGES, 32):
        inside = placed.join(F.broadcast(reached) if few else reached, LEAF).where(F.col("place").startswith(F.col("range")))
        sums = inside.groupBy(*LEAF, "rest", "taken", F.substring("place", 1, digits).alias("next")).agg(F.sum("_tokens").alias("sum"))
        run = Window.partitionBy(*LEAF).orderBy("next").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        beyond = sums.withColumn("upto", F.col("taken") + F.sum("sum").over(run)).where("upto > rest")
        first = beyond.groupBy(*LEAF, "rest").agg(F.min(F.struct("next", (F.col("upto") - F.col("sum")).alias("taken"))).alias("c"))
        reached = first.select(*LEAF, "rest", F.col("c.next").alias("range"), F.col("c.taken").alias("taken"))
    last = reached.select(*LEAF, F.col("range").alias("stop"))
    # every place below ``stop`` is in the partial epoch
    kept = [f"`{c}`" for c in docs.drop("domain", "n_tokens", "epoch").columns]
    # names of our own that no column of the input has
    mark = "_" * (2 + max((len(c) - len(c.lstrip("_")) for c in docs.columns), default=0))
    own = [f"{mark}{c}" for c in LEAF]
    ends = plan.join(last, LEAF, "left").select(*[F.col(c).alias(n) for c, n in zip(LEAF, own, strict=True)], F.struct("whole", "rest", "stop").alias(f"{mark}end"))
    tagged = docs.select(*kept, *[c.alias(n) for c, n in zip(named, own, strict=True)], word_count(F.col(text_col)).alias("n_tokens")).join(F.broadcast(ends) if few else ends, own)
    end = F.col(f"{mark}end")
    partial = (end.rest > 0) & (end.stop.isNull() | (_place(seed, end.whole, F.col(id_col)) < end.stop))
    used = tagged.withColumn(f"{mark}n", end.whole + F.when(partial, 1).otherwise(0)).where(F.col(f"{mark}n") > 0)
    return used.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{mark}n") - 1))).select(*kept, F.col(own[0]).alias("domain"), "n_tokens", "epoch")

"""Sharding and mixing."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quern.llm.mixing import budgets, mix_sources, number_domain
from quern.llm.sharding import Conflict, ShardStore, shard

DOCS = "doc_id long, text string, lang string, source string, path string, epoch int"


def water(budget, nodes):
    """Level of a family by repeated capping."""
    given = {k: 0 for k in nodes}
    open_ = {k for k, (w, c) in nodes.items() if w > 0}
    left = budget
    while open_:
        total = sum(nodes[k][0] for k in open_)
        full = {k for k in open_ if nodes[k][1] * total <= left * nodes[k][0]}
        if not full:
            for k in open_:
                given[k] = left * nodes[k][0] // total
            break
        for k in full:
            given[k] = nodes[k][1]
        left -= sum(nodes[k][1] for k in full)
        open_ -= full
    return given


def test_budgets(spark):
    leaves = [("a", "en", "s1", 100), ("a", "en", "s2", 5), ("a", "fr", "s3", 40), ("b", "en", "s4", 1000), ("b", "de", "s5", 0)]
    got = {(r._domain, r._lang, r._source): r.target for r in budgets(spark.createDataFrame(leaves, "_domain string, _lang string, _source string, tokens long"), 600, {"a": 60, "b": 40}, {"fr": 300}, None, 100, 2).collect()}
    top = water(600, {"a": (60, 290), "b": (40, 2000)})
    mid = {("a", k): v for k, v in water(top["a"], {"en": (100, 210), "fr": (300, 80)}).items()} | {("b", k): v for k, v in water(top["b"], {"en": (100, 2000), "de": (100, 0)}).items()}
    want = {("a", "en", k): v for k, v in water(mid["a", "en"], {"s1": (100, 200), "s2": (100, 10)}).items()} | {("a", "fr", "s3"): mid["a", "fr"], ("b", "en", "s4"): mid["b", "en"], ("b", "de", "s5"): 0}
    assert got == want and top == {"a": 290, "b": 310}


def test_budget_past_a_weight_of_nothing(spark):
    """What a child of weight 0 holds is no capacity of its parent; the budget goes to the others."""
    leaves = spark.createDataFrame([("a", "en", "s1", 100), ("a", "xx", "s2", 10_000), ("b", "en", "s3", 1_000)], "_domain string, _lang string, _source string, tokens long")
    got = {(r._domain, r._source): r.target for r in budgets(leaves, 900, None, {"xx": 0}, None, 100, 1).collect()}
    assert got == {("a", "s1"): 100, ("a", "s2"): 0, ("b", "s3"): 800}


def test_budgets_of_large_numbers(spark):
    leaves = spark.createDataFrame([("a", "en", f"s{k}", 17_000_000_000 + k) for k in range(1000)], "_domain string, _lang string, _source string, tokens long")
    got = budgets(leaves, 10**13, None, None, None, 1_000_000, 4).agg(F.sum("target"), F.max("target")).first()
    assert 10**13 - 1000 <= got[0] <= 10**13 and got[1] == 10**10


def test_mixing_beside_clashing_columns(spark):
    names = ["rest", "whole", "stop", "_domain", "_lang", "_source", "_n", "__n", "place", "range", "a.b", "epoch", "n_tokens"]
    rows = [(i, f"{'w ' * (i % 9)}", "en", f"src{i % 3}", *[f"v{i}"] * len(names)) for i in range(120)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", *names])
    got = mix_sources(docs, number_domain(F.col("source")), budget_share=0.5)
    assert got.columns == ["doc_id", "text", "lang", "source", *names[:-2], "domain", "n_tokens", "epoch"]
    assert all(r.rest == f"v{r.doc_id}" for r in got.collect()) and got.count() > 0
    plain = mix_sources(docs.select("doc_id", "text", "lang", "source"), number_domain(F.col("source")), budget_share=0.5)
    assert sorted(map(str, got.select("doc_id", "epoch").collect())) == sorted(map(str, plain.select("doc_id", "epoch").collect()))


def test_mixing_ties_at_the_cut(spark):
    """Rows of one id have one place: all of them are in the partial epoch, or none."""
    rows = [(i // 4, "w w w", "en", "src1", "p", 1) for i in range(400)]
    got = mix_sources(spark.createDataFrame(rows, DOCS), number_domain(F.col("source")), budget_share=0.37).groupBy("doc_id").count().collect()
    assert {r["count"] for r in got} == {4} and len(got) == 37


def test_mixing(spark):
    rows = [(i, "w " * (i % 7), "en" if i % 2 else None, f"src{i % 5}", "p", 9) for i in range(300)] + [(1, "w w", "en", None, None, None)] * 2 + [(400, None, "en", "src1", "p", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mix_sources(docs, number_domain(F.col("source")), budget_share=0.7, max_epochs=3, seed=3)
    assert got.columns == ["doc_id", "text", "lang", "source", "path", "domain", "n_tokens", "epoch"]
    used = got.agg(F.sum("n_tokens")).first()[0]
    total = docs.select(F.sum(F.size(F.filter(F.split("text", " "), lambda x: x != "")))).first()[0]
    assert used <= 0.7 * total and used > 0.7 * total - 7 * 12
    assert sorted(map(str, got.collect())) == sorted(map(str, mix_sources(docs, number_domain(F.col("source")), budget_share=0.7, max_epochs=3, seed=3).collect()))
    everything = mix_sources(docs, number_domain(F.col("source")), budget_share=5.0, max_epochs=2)
    assert everything.where("n_tokens > 0").groupBy("epoch").count().count() == 2
    assert mix_sources(docs.limit(0), number_domain(F.col("source"))).count() == 0


@pytest.mark.parametrize("target", [1 << 30, 20_000])
def test_round_trip(spark, tmp_path, target):
    rows = [(i, f"text {i} " * (i % 50), "en", "s", "p", i) for i in range(2000)] + [(None, None, None, None, None, None), (7, "again", "en", "s", "p", 1), (7, "again", "en", "s", "p", 1)]
    docs = spark.createDataFrame(rows, DOCS).repartition(6)
    store = shard(docs, arrivals=3, target_bytes=target, root=str(tmp_path / "s"))
    assert sorted(map(str, store.read().collect())) == sorted(map(str, docs.collect()))
    m = store.manifest()
    assert m.agg(F.sum("rows")).first()[0] == len(rows)
    small = m.where(F.col("bytes") * 2 < target).groupBy("tier").count().collect()
    assert all(r["count"] < store.fanout for r in small)
    before = store.version()
    assert store.compact() == before


def test_commits_do_not_overwrite(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a", "en", "s", "p", 1)], DOCS)
    one = ShardStore(spark, str(tmp_path / "s"), docs.schema)
    assert one.version() == 0 and one.read().count() == 0
    one.append(docs)
    with pytest.raises(RuntimeError, match="another writer"):
        one._commit(one.manifest(), 0)
    assert one.version() == 1 and one.read().count() == 1
    one.append(docs.limit(0))
    assert one.version() == 2 and one.read().count() == 1


def test_two_writers(spark, tmp_path):
    """One that looked before another's commit loses its number, not its rows; readers of the version before can finish."""
    docs = spark.createDataFrame([(k, f"t{k}", "en", "s", "p", 1) for k in range(20)], DOCS)
    one, two = (ShardStore(spark, str(tmp_path / "s"), docs.schema, fanout=2) for _ in range(2))
    one.append(docs.where("doc_id < 10"))
    stale = two._listed(two._write(docs.where("doc_id >= 10")), 1)
    with pytest.raises(Conflict):
        two._commit(stale, 0)
    old = one.read(1)
    two.append(docs.where("doc_id >= 10"))
    one.compact()
    one.vacuum()
    assert old.count() == 10 and one.read().count() == 20 and one.version() >= 3
    one.vacuum(0)
    assert one.versions() == [one.version()] and one.read().count() == 20
    assert len(one._files("shards")) == 1


def test_an_append_takes_the_next_number(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a", "en", "s", "p", 1)], DOCS)
    one = ShardStore(spark, str(tmp_path / "s"), docs.schema)
    stale, true = [0], one.version
    one.version = lambda: stale.pop() if stale else true()
    ShardStore(spark, str(tmp_path / "s"), docs.schema).append(docs)
    assert one.append(docs) == 2 and one.read().count() == 2


def test_shards_keep_clashing_columns_and_long_texts(spark):
    rows = [(1, "x " * 1_000_000, "mine", 7, "b"), (2, None, None, None, None), (2, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, tier int, _metadata string")
    store = shard(docs, arrivals=2)
    assert sorted(map(str, store.read().collect())) == sorted(map(str, docs.collect()))
    got = store.read(shard_col="shard").collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 2] and all(r.shard.endswith(".parquet") for r in got)
    assert {len(r.text or "") for r in got} == {2_000_000, 0}

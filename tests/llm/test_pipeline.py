"""Each stage of the pipeline against a plain version of it, and on hostile rows."""

from __future__ import annotations

import sys
from collections import Counter
from pathlib import Path

import corpus_pipeline as pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import quality

sys.path.insert(0, str(Path(__file__).parent))
from test_decontamination import WORD, low  # noqa: E402
from test_decontamination import want as want_items  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def plain_stats(text):
    """The shape statistics of one text, word by word."""
    marks = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum())
    words = [m[0] for m in WORD.finditer(text or "")]
    n, some = len(words), max(len(words), 1)
    bare = [low(w).strip(marks) for w in words]
    odd = "#$%&*@^~|<>{}[]\\=+_"
    upper, alpha = sum("A" <= c <= "Z" for w in words for c in w), sum("a" <= c.lower() <= "z" and c.isascii() for w in words for c in w)
    lines = [tuple(low(m[0]).strip(marks) for m in WORD.finditer(x)) for x in (text or "").split("\n")]
    lines = [x for x in lines if x]
    room = min(max(max((some * 40) ** 0.5, some * 0.55), 1), some)
    return [
        sum(w[-1] in odd and w[-2:-1] in odd and len(w.encode()) > 2 for w in words) / some,
        sum(w == "|" for w in words) / some,
        upper / max(alpha, 1) if alpha >= 30 else 0,
        sum(w.endswith("!!") for w in words) / some,
        min(max(1 - len(set(bare)) / room, 0), 1) if n >= 25 else 0,
        sum(a == b for a, b in zip(bare, bare[1:], strict=False)) / some if n >= 10 else 0,
        1 - len(set(lines)) / max(len(lines), 1) if len(lines) >= 5 else 0,
        sum(w[-1] in "0123456789" and w[0] in "0123456789" for w in words) / some,
    ]


def test_quality_stage(spark, sf, docs):
    """Statistics, votes, posterior and linear score from plain loops; a document stays if its score is 0.5 or more."""
    model = quality.train(docs, pipeline.bad_labels(spark, sf))
    rows = docs.select("doc_id", "text").collect()
    kept = {r.doc_id for r in pipeline.quality_stage(spark, docs, sf).collect()}
    for r in rows:
        f = quality.features(pa.array([r.text]))
        assert np.allclose(f.stats[0], plain_stats(r.text)), r.doc_id
        votes = [int(x >= b and f.words[0] >= 10) for x, b in zip(plain_stats(r.text), quality.BAD_FROM, strict=True)]
        hits = len(set(f.hash.tolist()) & set(model.lexicon.tolist()))
        votes += [int(hits > 0), -int(hits == 0 and all(x <= g for x, g in zip(plain_stats(r.text), quality.GOOD_TO, strict=True))), 0]
        v = quality.votes(f, model.lexicon)
        assert v[0].tolist() == votes
        z = model.scorer.bias + sum(model.scorer.weight[c] for c in quality.slots(f, v, model.scorer.bits)[1].tolist())
        assert (z >= 0) == (r.doc_id in kept)


def test_plain_label_model():
    """Expectation-maximisation by loops over votes."""
    patterns = np.array([[1, 0, -1], [1, 1, 0], [-1, 0, -1], [0, 1, 0], [-1, -1, -1]])
    counts = np.array([4.0, 30, 50, 7, 60])
    accuracy = [0.9] * 3
    for _ in range(200):
        bad = []
        for v in patterns.tolist():
            odds = 0.4 / 0.6
            for x, a in zip(v, accuracy, strict=True):
                odds *= (a / (1 - a)) ** x
            bad.append(odds / (1 + odds))
        for k in range(3):
            right = sum(c * (b if v[k] == 1 else 1 - b) for v, b, c in zip(patterns, bad, counts, strict=True) if v[k])
            voted = sum(c for v, c in zip(patterns, counts, strict=True) if v[k])
            accuracy[k] = min(max((right + 0.9 * 20) / (voted + 20), 0.55), 0.995)
    assert np.allclose(quality.fit_label_model(patterns, counts).accuracy, accuracy, atol=1e-5)


def test_near_duplicate_stage(spark, sf, docs):
    """All pairs of five-word shingle sets."""
    rows = docs.collect()
    sets = []
    for r in rows:
        w = WORD.findall(low(r.text or ""))
        sets.append(frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)]))
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                group[max(x, y)] = min(x, y)
    least = {}
    for k, r in enumerate(rows):
        least[find(k)] = min(least.get(find(k), r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in pipeline.near_dedup_stage(spark, docs, sf).collect()) == sorted(least.values())
    assert len(least) < len(rows)


def test_decontamination_stage(spark, sf, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = docs.where("length(text) < 3000").orderBy("doc_id").limit(70).collect()
    some = docs.where(F.col("doc_id").isin([r.doc_id for r in rows]))
    found = want_items([r.text for r in rows], items)
    kept = {r.doc_id for r in pipeline.decontamination_stage(spark, some, sf).collect()}
    assert kept == {r.doc_id for r, f in zip(rows, found, strict=True) if not f}


def test_mixing_stage(spark, sf, docs):
    """Against SQL over the same rows."""
    import duckdb

    from quern.llm.queries import OP4_SQL

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert "600000" in OP4_SQL
    want = Counter(r[0] for r in con.execute(f"SELECT doc_id FROM ({OP4_SQL.replace('600000', '800000')})").fetchall())
    assert Counter(r.doc_id for r in pipeline.mixing_stage(spark, docs, sf).collect()) == want


def test_sharding_stage(spark, sf, docs):
    got = pipeline.sharding_stage(spark, docs, sf)
    assert got.columns == [*docs.columns, "shard"]
    assert sorted(map(str, got.drop("shard").collect())) == sorted(map(str, docs.collect()))


def test_hostile_rows(spark, sf, docs):
    good = docs.where("lang = 'en' AND length(text) BETWEEN 600 AND 3000").orderBy("doc_id").limit(30).collect()
    text = good[0].text
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, "x", "y") for r in good]
    rows += [(None, None, None, None, None, None, None), (1000, "", "en", "s", 0, "x", "y"), (1001, " \n", None, None, 2, "x", "y"), (5000, text, "en", "src1", 5, "x", "y"), (5000, good[1].text + " and more of it", "en", "src1", 5, "x", "y")]
    rows += [(6000, " ".join(x.text for x in good) * 12, "en", "src2", 5, "x", "y")] * 2 + [(None, good[2].text, "en", "src3", None, None, None)]
    hostile = spark.createDataFrame(rows, SCHEMA + ", shard string, whole string")
    for name, stage in pipeline.STAGES:
        out = stage(spark, hostile, sf)
        assert set(pipeline.COLUMNS) <= set(out.columns)
        assert out.count() <= len(rows) * 2, name
        assert stage(spark, hostile.limit(0), sf).count() == 0, name
    kept = pipeline.near_dedup_stage(spark, hostile, sf).collect()
    assert sum(r.doc_id == 6000 for r in kept) == 1 and sum(r.doc_id == 5000 for r in kept) == 0
    assert sum(r.text is None for r in kept) == 1 and {1000, 1001} <= {r.doc_id for r in kept}
    assert sum(not (r.text or "").strip() for r in pipeline.quality_stage(spark, hostile, sf).collect()) in (0, 3)


def test_run(spark, sf, docs):
    labels = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1 AND toxic = 0").collect()}
    kept = {r.doc_id for r in pipeline.quality_stage(spark, docs, sf).collect()}
    assert len(labels - kept) <= 0.1 * len(labels)
    assert [n for n, _ in pipeline.STAGES] == ["quality classifier", "near-duplicate removal", "benchmark decontamination", "source mixing", "sharding"]
    out = pipeline.run(spark, sf)
    assert set(pipeline.COLUMNS) <= set(out.columns) and 0 < out.count() <= docs.count()
    assert {r.doc_id for r in out.collect()} <= kept

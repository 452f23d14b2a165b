from __future__ import annotations

import math
import random
import re

from pyspark.sql import functions as F

from quern.functions.text import STOPWORDS
from quern.operators import geometry, maintenance, measurements, metrics, retrieval, search
from quern.sources import corpora

BLOCK = "doc_id string, page int, block_no int, x0 double, y0 double, x1 double, y1 double, text string"

DOCS = [(0, "cat sat mat"), (1, "cat cat dog"), (2, "bird sings"), (3, None), (4, "")]


def brute_bm25(docs, query):
    tok = lambda t: [w for w in re.findall(r"\w\w+", (t or "").lower()) if w not in STOPWORDS]
    bag = {i: tok(t) for i, t in docs}
    n, avg = len(docs), sum(map(len, bag.values())) / len(docs)
    vocab = {w for b in bag.values() for w in b}
    df = {w: sum(w in b for b in bag.values()) for w in vocab}
    idf = {w: math.log(n - k + 0.5) - math.log(k + 0.5) for w, k in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: 0.25 * mean if v < 0 else v for w, v in idf.items()}
    return {i: sum(idf[w] * b.count(w) * 2.5 / (b.count(w) + 1.5 * (0.25 + 0.75 * len(b) / avg)) for w in tok(query) if w in vocab) for i, b in bag.items()}


def test_bm25_matches_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(60).collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    query = rows[3][1][:200]
    got = retrieval.bm25_topk(spark.createDataFrame([(7, query)], "query_id long, text string"), retrieval.postings(docs), len(rows), 10).orderBy("rank").collect()
    want = sorted(((-round(v, 9), i) for i, v in brute_bm25(rows, query).items() if v > 0))[:10]
    assert [r.doc_id for r in got] == [i for _, i in want]
    assert all(abs(r.score + s) < 1e-6 for r, (s, _) in zip(got, want, strict=True))


def test_bm25_nulls(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    q = spark.createDataFrame([(1, "cat"), (2, None), (3, "")], "query_id long, text string")
    got = retrieval.bm25_topk(q, retrieval.postings(docs), 5).collect()
    assert {(r.query_id, r.doc_id) for r in got} == {(1, 0), (1, 1)}


def lists(spark, rows):
    return spark.createDataFrame(rows, "query_id long, doc_id long, rank int, score double")


def test_rrf_ties(spark):
    dense, sparse = lists(spark, [(1, 10, 1, 0.9), (1, 11, 2, 0.8)]), lists(spark, [(1, 20, 1, 5.0), (1, 11, 2, 4.0)])
    got = [(r.doc_id, r.score) for r in retrieval.hybrid_rrf(dense, sparse).orderBy("rank").collect()]
    assert got == [(11, 0.8), (10, 0.9), (20, 5.0)]  # a document of both lists first, then dense before BM25
    w = retrieval.weighted_rrf(dense, sparse, [0.0, 0.5, 1.0])
    order = {x: [r.doc_id for r in w.where(F.col("weight") == x).orderBy("rank").collect()] for x in (0.0, 0.5, 1.0)}
    assert order[0.5] == [11, 20, 10] and order[1.0][:2] == [20, 11] and len(order[1.0]) == 3


def test_rrf_of_a_list_with_itself_keeps_its_order(spark):
    a = lists(spark, [(1, i, i + 1, 1.0 - i / 10) for i in range(5)])
    assert [r.doc_id for r in retrieval.hybrid_rrf(a, a).orderBy("rank").collect()] == [0, 1, 2, 3, 4]


def test_equal_vectors_go_by_id(spark):
    """Of copies in any number of batches and tasks the smallest ids win; string ids, too."""
    rows = [(i, [1.0, 0.0] if i % 3 else [0.6, 0.8]) for i in range(12_000, 0, -1)]
    for kind in ("long", "string"):
        v = spark.createDataFrame(rows, "vec_id long, vector array<float>").withColumn("vec_id", F.col("vec_id").cast(kind)).repartition(3)
        q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<float>")
        got = [r.vec_id for r in retrieval.dense_topk(q, v, 8).orderBy("rank").collect()]
        want = sorted((i if kind == "long" else str(i)) for i, x in rows if x[0] == 1)[:8]
        assert got == want


def test_containing_is_contains(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    some = [r.text for r in docs.where("length(text) > 200").limit(40).collect()]
    needles = [(i, t[7 * (i % 9) : 7 * (i % 9) + 5 + i]) for i, t in enumerate(some)] + [(100, ""), (101, None), (102, "the"), (103, some[0][:40] + "x")]
    asked = spark.createDataFrame(needles, "query_id long, needle string")
    got = sorted((r.query_id, r.doc_id) for r in search.containing(docs, asked).collect())
    assert got == sorted((i, r.doc_id) for r in docs.collect() for i, n in needles if n and n in (r.text or ""))


def test_dense_and_lsh(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.col("embedding").alias("vector"))
    q = v.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    exact = {(r.query_id, r.vec_id) for r in retrieval.dense_topk(q, v, 8).collect()}
    near = {(r.query_id, r.vec_id) for r in retrieval.dense_topk_lsh(q, v, 8).collect()}
    assert len(exact) == 80 and {(i, i) for i, _ in exact} <= near


def test_lsh_finds_the_neighbours_of_the_exact_search(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.col("embedding").alias("vector"))
    q = v.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")
    exact, near = ({(r.query_id, r.vec_id) for r in f(q, v, 8).where("query_id <> vec_id").collect()} for f in (retrieval.dense_topk, retrieval.dense_topk_lsh))
    assert len(exact) == 350 and len(exact & near) >= 0.9 * len(exact)


def test_graded_metrics_by_hand(spark):
    qrels = spark.createDataFrame([("q", "a", 2), ("q", "b", 1), ("r", "z", 1)], "query_id string, doc_id string, rel int")
    runs = spark.createDataFrame([("q", "x", 1), ("q", "b", 2), ("q", "a", 3)], "query_id string, doc_id string, rank int")
    m = metrics.graded_metrics(qrels, runs).first()
    ndcg = (1 / math.log2(3) + 2 / math.log2(4)) / (2 + 1 / math.log2(3))
    assert abs(m.ndcg - ndcg / 2) < 1e-9 and abs(m.map - (1 / 2 + 2 / 3) / 4) < 1e-9 and m.recall == 0.5 and m.queries == 2


def test_ranks(spark):
    cases = spark.createDataFrame([("q", "t", ["2v1"])], "query_id string, tag string, relevant array<string>")
    hits = spark.createDataFrame([("q", 1, "1v1"), ("q", 2, "1v3"), ("q", 3, "2v9")], "query_id string, rank int, source string")
    r = metrics.first_ranks(cases, hits).first()
    assert (r.chunk_rank, r.paper_rank) == (3, 2)


def test_number_cells(spark):
    rows = spark.createDataFrame([(c,) for c in ("71.2%", "1,204", "3/4", "-", "abc", ".5", "12.3.4")], "c string")
    got = {r.c: r.k for r in rows.select("c", measurements.cell_kind(F.col("c")).alias("k")).collect()}
    assert got == {"71.2%": "number", "1,204": "number", "3/4": "ambiguous", "-": "none", "abc": "none", ".5": "number", "12.3.4": "none"}


def test_band_growth_stops_at_gutters(spark):
    blocks = spark.createDataFrame([("p", 1, i, x0, 10.0, x1, 20.0, "t") for i, (x0, x1) in enumerate([(10.0, 50.0), (58.0, 90.0), (130.0, 200.0)])], "doc_id string, page int, block_no int, x0 double, y0 double, x1 double, y1 double, text string")
    bands = spark.createDataFrame([("f", "p", 1, 0.0, 30.0, 40.0, 60.0, 0.0, 300.0)], "figure_id string, doc_id string, page int, y0 double, y1 double, x0 double, x1 double, lo double, hi double")
    r = geometry.band_extents(bands, blocks).first()
    assert (r.x0, r.x1) == (10.0, 90.0)


def plain_figures(number, blocks, graphics, page=(0.0, 0.0, 600.0, 800.0)):
    """One page's figures and tables, block by block."""
    def prose(t):
        return len(t.split()) >= 8

    def sentence(t):
        signs = sum(c.isdigit() or c in "✓✗×√±%|" for c in t)
        return prose(t) and signs / max(len(t), 1) <= 0.10 and t.count(". ") + t.count(", ") >= 1

    def meets(r, s):
        return r[0] < r[2] and r[1] < r[3] and r[0] < s[2] and r[2] > s[0] and r[1] < s[3] and r[3] > s[1]

    def dense(band):
        return sum(len(t) for r, t in blocks if meets(r, band))

    blocks = sorted(blocks, key=lambda b: (round(b[0][1], 1), b[0][0]))
    out, seen = [], set()
    for r, t in blocks:
        m = re.match(r"(?is)^\s*(fig(?:ure)?\.?|table)\s*(\d+)\s*[:.]\s*(\S.*)", t)
        if not m or len(" ".join(m[3].split())) < 25:
            continue
        kind = "table" if m[1].lower().startswith("tab") else "figure"
        ident = f"p-p{number}-{kind}{m[2]}"
        if ident in seen:
            continue
        x0, x1, drawn, images = max(page[0], r[0] - 6), min(page[2], r[2] + 6), 0, 0
        column = [(q, s) for q, s in blocks if q[2] > r[0] and q[0] < r[2]]
        if kind == "table":
            top = max([page[1], *(q[3] for q, s in column if q[3] <= r[1] and sentence(s))])
            floor = min([page[3], *(q[1] for q, s in column if q[1] >= r[3] and sentence(s))])
            bands = [b for b in ((x0, top, x1, r[1]), (x0, r[3], x1, floor)) if b[3] - b[1] >= 40]
            if not bands:
                continue
            band = max(bands, key=dense)
            mid, said = 300, [q for q, s in blocks if sentence(s)]
            two = sum(q[2] <= mid for q in said) >= 3 and sum(q[0] >= mid for q in said if q[2] > mid) >= 3 and r[2] - r[0] <= 360
            lo, hi = ((0.0, 300.0) if (r[0] + r[2]) / 2 <= mid else (300.0, 600.0)) if two else (0.0, 600.0)
            a, b = max(band[0], lo), min(band[2], hi)
            inside = [q for q, _ in blocks if q[3] > band[1] and q[1] < band[3] and q[2] > lo and q[0] < hi]
            for _ in inside:
                for q in inside:
                    if not (q[2] < a - 12 or q[0] > b + 12):
                        a, b = max(min(a, q[0]), lo), min(max(b, q[2]), hi)
            box = (a, band[1], b, band[3])
            if dense(box) < 80:
                continue
        else:
            top = max([page[1], *(q[3] for q, s in column if q[3] <= r[1] and prose(s))])
            band = (x0, top, x1, r[1])
            if band[3] - band[1] < 40:
                continue
            met = [(k, q) for k, q in graphics if meets(q, band)]
            drawn, images = sum(k == "drawing" for k, _ in met), sum(k == "image" for k, _ in met)
            if not (drawn >= 8 or images) and not (band[3] - band[1] >= 80 and not any(prose(s) and meets(q, band) for q, s in blocks)):
                continue
            box = band
            if met:
                u = (min(q[0] for _, q in met), min(q[1] for _, q in met), max(q[2] for _, q in met), max(q[3] for _, q in met))
                both = (max(u[0], band[0]), max(u[1], band[1]), min(u[2], band[2]), min(u[3], band[3]))
                box = both if both[0] < both[2] and both[1] < both[3] else band
        if box[3] - box[1] < 40 or box[2] - box[0] < 40:
            continue
        seen.add(ident)
        out.append((ident, " ".join(m[3].split()), *(round(v, 6) for v in box), drawn, images))
    return out


def test_figures(spark):
    """Random pages against a plain version: repeated numbers, two columns, tables above and below, strokes without area."""
    rng = random.Random(12)
    said = "the results of this run are close to those before, which had more steps in them"
    texts = [said, "0.75", "axis label", "1 2 3 | 4 ✓ ✗ 5 6 7 8 9 10, 11", "Net A 71 72 73", "Figure 1: accuracy of all the systems over time", "Table 2: scores of all the systems on the tasks", "Fig. 3. how the loss of a model falls with its steps", "figure 1: too short", "Table 2. what is left when each of the parts is out"]
    lines, strokes, want, pages = [], [], [], 16
    for page in range(pages):
        blocks = []
        for _ in range(rng.randint(8, 26)):
            x, y, w, h = rng.choice([40, 50, 320, 330, 200]) + rng.random() * 20, rng.random() * 740, rng.choice([60, 200, 230, 420]), rng.choice([10, 20, 60])
            blocks.append(((x, y, min(x + w, 600.0), min(y + h, 800.0)), rng.choice(texts)))
        graphics = []
        for _ in range(rng.choice([0, 3, 25, 60])):
            x, y = rng.random() * 500, rng.random() * 700
            graphics.append((rng.choice(["drawing"] * 6 + ["image"]), (x, y, x + rng.choice([0, 30, 80]), y + rng.choice([0, 20, 50]))))
        lines += [("p", page, i, *r, t) for i, (r, t) in enumerate(blocks)]
        strokes += [("p", page, k, *r) for k, r in graphics]
        want += plain_figures(page, blocks, graphics)
    b = spark.createDataFrame(lines, BLOCK)
    g = spark.createDataFrame(strokes, "doc_id string, page int, kind string, x0 double, y0 double, x1 double, y1 double")
    box = spark.createDataFrame([("p", k, 0.0, 0.0, 600.0, 800.0) for k in range(pages)], "doc_id string, page int, px0 double, py0 double, px1 double, py1 double")
    got = [(f.figure_id, f.caption, *(round(v, 6) for v in (f.x0, f.y0, f.x1, f.y1)), f.n_drawings, f.n_images) for f in geometry.extract_figures(b, g, box).collect()]
    assert sorted(got) == sorted(want) and len(want) >= 12


def test_figures_of_two_pages_and_blank_ones(spark):
    """The same number on two pages is two figures; the prefix is in the label alone; blank renders go."""
    text = "Figure 1: accuracy of all the systems over time"
    blocks = spark.createDataFrame([("p", k, 0, 50.0, 400.0, 280.0, 420.0, text) for k in (0, 1)], BLOCK)
    box = spark.createDataFrame([("p", k, 0.0, 0.0, 600.0, 800.0) for k in (0, 1)], "doc_id string, page int, px0 double, py0 double, px1 double, py1 double")
    none = spark.createDataFrame([], "doc_id string, page int, kind string, x0 double, y0 double, x1 double, y1 double")
    both = geometry.extract_figures(blocks, none, box)
    assert sorted(r.figure_id for r in both.collect()) == ["p-p0-figure1", "p-p1-figure1"]
    inks = both.select("candidate", F.when(F.col("page") == 0, 0.2).otherwise(0.001).alias("ink"))
    kept = geometry.extract_figures(blocks, none, box, inks=inks)
    assert [r.figure_id for r in kept.collect()] == ["p-p0-figure1"]
    chunk = geometry.figure_chunks(kept, spark.createDataFrame([("p-p0-figure1", "A plot.")], "figure_id string, description string")).first()
    assert chunk.text == "Figure 1: accuracy of all the systems over time\nA plot."


def test_artefact_is_rebuilt_on_an_old_stamp(spark, tmp_path):
    docs = spark.createDataFrame([(1, "object hallucination evaluation"), (2, "retrieval augmented generation")], "doc_id long, text string")
    path = str(tmp_path / "bm25")
    maintenance.save_bm25(docs, path)
    assert maintenance.load_bm25(spark, path)[3] is False
    spark.createDataFrame([('{"tokenizer": "1-split", "n_docs": 2, "stemmed": false}',)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_meta")
    posted, _, n, rebuilt = maintenance.load_bm25(spark, path)
    assert rebuilt and n == 2 and {r.term for r in posted.collect()} >= {"hallucin", "retriev"}
    assert maintenance.load_bm25(spark, path)[3] is False


def test_guarded_results(spark, tmp_path):
    rows = spark.createDataFrame([(1,)], "x int")
    path = str(tmp_path / "r")
    maintenance.write_guarded(rows, path, 10)
    try:
        maintenance.write_guarded(rows, path, 5)
        raise AssertionError("a smaller run replaced a larger one")
    except ValueError:
        pass
    assert maintenance.write_guarded(rows, path, 5, limited=True).endswith("_limited")
    assert maintenance.write_guarded(rows, path, 5, force=True) == path


def test_benchmark_round_trip(spark, tmp_path):
    corpus = spark.createDataFrame([("d1", "t", "x"), ("d2", None, "y")], "doc_id string, title string, text string")
    queries = spark.createDataFrame([("q1", "x?")], "query_id string, text string")
    qrels = spark.createDataFrame([("q1", "d1", 1)], "query_id string, doc_id string, rel int")
    assert corpora.write_benchmark(corpus, queries, qrels, str(tmp_path / "b")) == 1
    c, q, r = corpora.benchmark(spark, str(tmp_path / "b"))
    assert c.count() == 2 and q.first().text == "x?" and tuple(r.first()) == ("q1", "d1", 1)


def test_streamed_ingest_is_idempotent(spark, tmp_path):
    from quern.streaming.ingest import ingest

    schema = "chunk_id string, section string, text string"
    src = str(tmp_path / "in")
    rows = [(f"c{i}", "Method", "t") for i in range(10)] + [("n", "References", "t"), ("c1", "Method", "again")]
    spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
    args = (spark, src, schema, str(tmp_path / "out"), str(tmp_path / "ck"))
    ingest(*args).awaitTermination()
    spark.createDataFrame(rows[5:] + [("d", "Method", "t")], schema).write.mode("append").parquet(src)
    ingest(*args).awaitTermination()
    got = [r.chunk_id for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == sorted({f"c{i}" for i in range(10)} | {"d"})


def test_registry_and_oracle_agree(spark, sf):
    """A sample of the registered queries against their SQL; the driver compares them all."""
    import duckdb

    from quern.plans import registry

    db = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "pages", "labels", "events"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    q, o = registry.queries(), registry.oracle_sql()
    for name in ("bm25_topk", "hybrid_rrf", "chunk_windows", "section_segments", "multi_variant_rrf", "measured"):
        df = q[name](spark, sf)
        cols = sorted(df.columns)
        r = db.execute(o[name])
        names = [c[0] for c in r.description]
        assert sorted(names) == cols
        want = sorted(str([str(x[names.index(c)]) for c in cols]) for x in r.fetchall())
        assert sorted(str([str(x[c]) for c in cols]) for x in df.collect()) == want, name

"""Substring deduplication and near duplicates against brute force, with hostile rows."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm.near_dedup import drop_near_duplicates, near_duplicates
from quern.llm.substring_dedup import _slots, remove_repeats

SCHEMA = "doc_id long, text string, g int, bucket string, n_words long, text2 string"
WORD = re.compile("[^\x20\x09-\x0d]+")


def corpus(seed=0, docs=60):
    """Passages shared at odd places, exact and near copies, repeated rows, nulls, long and empty texts."""
    rng = random.Random(seed)
    vocab = [f"{a}{b}" for a in "abcdefgh" for b in ("x", "é", "y,", "Z")]
    shared = [[rng.choice(vocab) for _ in range(rng.randint(40, 130))] for _ in range(4)]
    rows = []
    for i in range(docs):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 160))]
        if i % 3 == 0:
            at = rng.randint(0, len(w))
            p = shared[i % 4]
            lo = rng.randint(0, 5)
            w[at:at] = p[lo:]
        if i % 7 == 0:
            w = ["same"] * rng.randint(45, 140)
        rows.append((i * 3, rng.choice((" ", "\n", "\t ")).join(w)))
    rows += [(1000, rows[3][1]), (1001, rows[3][1].upper()), (1002, None), (1003, ""), (1004, " \n "), (None, rows[3][1]), (5, rows[5][1] + " tail"), (5, rows[5][1] + " tail")]
    rows += [(2000 + k, " ".join(rows[9][1].split()[: -1 - k])) for k in range(6)] + [(3000, " ".join(vocab * 700)), (3001, "single"), (3002, "single"), (3003, "w" * 50_000)]
    return [(i, t, 1, "b", 7, "z") for i, t in rows]


def want_repeats(rows, window):
    first, words = {}, [(i, WORD.findall(t or "")) for i, t, *_ in rows]
    for i, w in words:
        if i is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        if i is not None:
            for k in range(len(w) - window + 1):
                if first[tuple(w[k : k + window])] < i:
                    gone[k : k + window] = [True] * window
        out.append((str(i), len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out)


@pytest.mark.parametrize(("window", "sizes"), [(50, {}), (20, {"group_bytes": 3000, "bucket_hashes": 500}), (7, {"group_bytes": 1000, "bucket_hashes": 300})])
def test_repeats(spark, window, sizes):
    rows = corpus()
    got = remove_repeats(spark.createDataFrame(rows, SCHEMA), window=window, **sizes).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.text) for r in got) == want_repeats(rows, window)
    for r in got:
        assert sum(s.end - s.start for s in r.removed) == r.n_removed


def test_windows_are_told_apart_by_both_hashes():
    h, k = np.array([3, 7, 7, 7, 9], np.uint64), np.array([1, 1, 4, 5, 2], np.uint64)
    at, known = _slots(h, k, np.array([7, 7, 7, 9, 2, 11, 7], np.uint64), np.array([4, 1, 9, 2, 1, 1, 5], np.uint64))
    assert known.tolist() == [True, True, False, True, False, False, True] and at[known].tolist() == [2, 1, 4, 3]


def test_repeats_of_nothing(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def want_components(rows, size):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    sets = []
    for i, t, *_ in rows:
        w = WORD.findall(low(t or ""))
        sets.append((i, frozenset([tuple(w)] if 0 < len(w) < size else [tuple(w[k : k + size]) for k in range(len(w) - size + 1)])))
    least = {}
    for n, (_, s) in enumerate(sets):
        if not s:
            continue
        linked = [m for m, (_, t) in enumerate(sets) if t and 100 * len(s & t) >= 80 * len(s | t)]
        least[n] = linked
    comp = list(range(len(sets)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for n, linked in least.items():
        for m in linked:
            a, b = find(n), find(m)
            comp[max(a, b)] = min(a, b)
    ids = {}
    for n, (i, s) in enumerate(sets):
        if s and i is not None:
            ids[find(n)] = min(ids.get(find(n), i), i)
    return sorted((str(i), len(s), str(None if i is None else ids[find(n)] if s else i)) for n, (i, s) in enumerate(sets))


@pytest.mark.parametrize(("size", "limits"), [(2, {}), (5, {}), (2, {"hot_rows": 2, "cluster_bytes": 1500, "cell_bytes": 500})])
def test_components(spark, size, limits):
    rows = corpus()
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA), shingle=size, **limits).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == want_components(rows, size)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


def test_chains_of_near_copies(spark):
    """Each links only with its neighbours; the component is the whole chain."""
    words = [f"w{i}" for i in range(260)]
    rows = [(k, " ".join(words[5 * k : 5 * k + 100]), 0, "", 0, "") for k in range(30)]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA), shingle=2).collect()
    assert {r.component_id for r in got} == {0}


def test_borderline_links(spark):
    """Pairs around the similarity: recall of the true links, as components hold them (brute force)."""
    rng = random.Random(8)
    rows = []
    for base in range(12):
        words = [f"b{base}w{rng.randint(0, 10**6)}" for _ in range(rng.randint(30, 200))]
        for v in range(30):
            w = list(words)
            for _ in range(round(len(w) * rng.uniform(0, 0.12))):
                w[rng.randrange(len(w))] = f"x{rng.randint(0, 10**9)}"
            rows.append((100 * base + v, " ".join(w), 0, "", 0, ""))
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, SCHEMA), shingle=2).collect()}
    sets = {i: {*zip(t.split(), t.split()[1:], strict=False)} for i, t, *_ in rows}
    true = [(a, b) for a in sets for b in sets if a < b and a // 100 == b // 100 and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert len(true) > 700
    assert sum(got[a] == got[b] for a, b in true) >= 0.999 * len(true)
    assert sorted((str(i), c) for i, c in got.items()) == sorted((i, int(c)) for i, _, c in want_components(rows, 2))


def test_repeated_id_with_many_texts(spark):
    """Each row is judged by its own text; the texts of one id are not multiplied."""
    rows = [(1, f"a{k} b{k} c{k} d{k} e{k} f{k}", 0, "", 0, "") for k in range(40)] * 2 + [(2, "a3 b3 c3 d3 e3 f3", 0, "", 0, "")]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA), shingle=2).collect()
    assert len(got) == 81 and {r.component_id for r in got} == {1}


def test_one_row_of_each_component_stays(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(40)) for k in "abc")
    rows = [(3, a), (5, a + " tail"), (5, b), (5, b), (7, c), (7, c + " more"), (8, None), (8, None), (9, ""), (None, a), (10, "x"), (2, "y")]
    frame = spark.createDataFrame([(i, t, "v") for i, t in rows], "doc_id long, text string, __id string")
    got = drop_near_duplicates(frame, shingle=2).collect()
    assert {r["__id"] for r in got} == {"v"}
    kept = sorted((str(r.doc_id), str(r.text)[:3], len(r.text or "")) for r in got)
    assert [k[:2] for k in kept] == sorted([("3", a[:3]), ("5", b[:3]), ("7", c[:3]), ("8", "Non"), ("8", "Non"), ("9", ""), ("None", a[:3]), ("10", "x"), ("2", "y")])
    assert drop_near_duplicates(frame.limit(0), shingle=2).count() == 0


def test_no_documents(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_digest_query(spark, sf):
    from quern.llm.queries import op2_substring_dedup

    r = op2_substring_dedup(spark, sf).orderBy("doc_id").first()
    text = spark.read.parquet(f"{sf}/documents.parquet").where(F.col("doc_id") == r.doc_id).first().text
    if not r.n_removed:
        assert r.kept_sha256 == hashlib.sha256(" ".join(WORD.findall(text)).encode()).hexdigest()

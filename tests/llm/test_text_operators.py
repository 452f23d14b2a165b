"""HTML, secrets, fingerprints, decontamination, quality, language model."""

from __future__ import annotations

import collections
import hashlib
import inspect
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import decontaminate as dec
from quern.llm import html_text, lm_score, quality, secret_scan, spotsigs

PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site head</header><nav><ul><li><a href="/">Menu</a></li></ul></nav><!-- ad -->'
    '<div class="ad">Buy now</div><article><header><h1>Big   title</h1></header><p><b>First &amp; foremost<br><p>Second\n line &eacute;&#8364;</p><form><input>Mail me</form><aside>See also</aside><p>To.</p>'
    '<div id="comments"><p>Reader says hi</p></div></article><div class="sidebar">Side</div><footer>&copy; x</footer></body></html>'
)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (PAGE, "Big title\nFirst & foremost\nSecond line é€\nTo."),
        (None, ""), ("", ""), ("<p></p><!-- x", ""), ("<script>x</script>", ""), ("<nav>menu</nav>", ""),
        ("<article><p>a &am", "a &am"), ("<article>one<p>two</article>", "one\ntwo"), ("<article><p>1 < 2 &lt; 3</p></article>", "1 < 2 < 3"),
        ("<body><div><a>home</a></div>" + "".join(f"<p>{'long text ' * 12}{i}</p>" for i in range(4)) + "<div><a>next</a></div></body>", "\n".join(f"{'long text ' * 12}{i}" for i in range(4))),
    ],
)
def test_main_text(page, want):
    assert html_text.main_text(page) == want


LONG = "long text " * 12 + "end"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<body><div>Short title</div><p>A short article.</p></body>", "Short title\nA short article."),
        (f"<body><p>Title</p><p>By me</p><p>Today</p><p>{LONG}</p><p><a>{LONG}</a></p><p>{LONG}</p></body>", f"Title\nBy me\nToday\n{LONG}\n{LONG}\n{LONG}"),
        (f"<article><p>Title</p><p>{LONG}</p><p><a>see here</a></p><p>Bye</p>" + "<p><a>more</a></p>" * 5 + "</article>", f"Title\n{LONG}\nsee here\nBye"),
    ],
)
def test_surges_and_dives(page, want):
    assert html_text.main_text(page) == want


def plain_distribution(blocks, window=3, threshold=86):
    """blocks: (text, linked characters). Runs of windows that are not empty, without the empty lines they begin with."""
    length = [max(0, len(t) - 2 * n) for t, n in blocks]
    total = [sum(length[k : k + window]) for k in range(len(blocks))]
    runs, run = [], []
    for k in range(len(blocks)):
        if total[k] == 0:
            runs.append(run)
            run = []
        elif run or length[k]:
            run.append(k)
    runs = [r for r in [*runs, run] if r]
    over = [r for r in runs if max(total[k] for k in r) > threshold]
    if not over and runs:
        top = max(max(total[k] for k in r) for r in runs)
        over = [r for r in runs if max(total[k] for k in r) == top]
    return [blocks[k][0] for r in over for k in r]


def test_distribution_against_a_plain_version():
    """Random pages without and with a named article; pages whose article is only a teaser keep their body."""
    rng = random.Random(6)
    teasers = 0
    for _ in range(400):
        blocks, html = [], []
        for _ in range(rng.randint(1, 25)):
            text = " ".join(rng.choice(PROSE) for _ in range(rng.choice([1, 2, 5, 20, 40])))
            linked = rng.random() < 0.45
            blocks.append((text, len(text) if linked else 0))
            html.append(f"<p><a href='/x'>{text}</a></p>" if linked else f"<p>{text}</p>")
        assert html_text.main_text("<body>" + "".join(html) + "</body>").split("\n") == (plain_distribution(blocks) or [""])
        cut = rng.randint(0, len(blocks))
        inner, outer = plain_distribution(blocks[:cut]), plain_distribution(blocks)
        mass = lambda kept, at: sum(max(0, len(t) - 2 * n) for t, n in at if t in kept)  # noqa: B023, E731
        page = "<body><article>" + "".join(html[:cut]) + "</article>" + "".join(html[cut:]) + "</body>"
        if len({t for t, _ in blocks}) < len(blocks) or not cut:
            continue
        teaser = mass(outer, blocks[cut:]) > 2 * mass(inner, blocks[:cut])
        teasers += teaser
        assert html_text.main_text(page).split("\n") == ((outer if teaser else inner) or [""])
    assert teasers > 20
    body = "".join(f"<p>{'long text ' * 12}{i}</p>" for i in range(5))
    assert html_text.main_text(f"<body><article><p>Short teaser</p></article>{body}</body>").endswith("4")


def test_very_long_pages_are_done_whole():
    page = "<article>" + "".join(f"<p>{'word ' * 200}{i}</p>" for i in range(3000)) + "</article>"
    assert html_text.main_text(page).count("\n") == 2999


def test_extract_keeps_columns(spark):
    rows = [(1, "u", PAGE, "old"), (1, None, None, None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert html_text.extract(frame.withColumnRenamed("url", "_html")).columns == ["page_id", "_html", "text"]
    got = html_text.extract(frame).collect()
    assert [r.text for r in got] == ["Big title\nFirst & foremost\nSecond line é€\nTo.", ""]
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


SECRETS = [
    "x token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" y", "API-KEY none; api_key:abc12", "Password='hunter22' PASSWD=ab.cd/ef+12", "é AKIA" + "Z" * 16 + " AKIA" + "Z" * 15, "deadbeef" * 3 + "g" + "a" * 23, "", None,
    "ſecret=longenough1", " \n token : abcdef ", "secret token=abcdefg secret=secret=abcdef",
]


def brute_spans(t):
    out = [("assign", m.start(), m.end()) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_secrets(spark, sf):
    rows = [(i, t, "x") for i, t in enumerate(SECRETS)] + [(r.doc_id + 100, r.text, "x") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    field = secret_scan.train(docs)
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secret_scan.scan(docs, field).collect()}
    for i, t, _ in rows:
        assert [s for s in got[i] if s[0] != "field"] == brute_spans(t or ""), t
    assert secret_scan.scan(docs.limit(0), field).count() == 0


PROSE = "the river ran past old mills and nobody in town could say when it had last been clear of reeds".split()


def test_the_field_adds_secrets_that_no_pattern_knows(spark):
    """Planted: values under names that are no keywords of the patterns, beside harmless assignments and numbers. Recall and precision of the added spans."""
    rng = random.Random(4)
    some = lambda n: " ".join(rng.choice(PROSE) for _ in range(n))
    chars = "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghjkmnpqrstuvwxyz0123456789"
    key = lambda n=32: "".join(rng.choice(chars) for _ in range(n - 2)) + "x7"
    taught = [f'{some(30)} {rng.choice(["token", "api_key", "secret"])} = "{rng.getrandbits(160):040x}" {some(20)}' for _ in range(60)]
    plain = [f"{some(25)} {x} {some(20)}" for x in ("size = 40", 'name = "Anna"', "anna.lee42@mail7.example.org", "2669109448945250", "+49 151 2345678", "https://example.org/path/page?id=123456789", "count = 1200 and more", "version 12.4.5-beta2", "x = 3.14159", 'title = "Notes"') for _ in range(20)]
    planted = [(f'{some(15)} {name} = "', key(), f'" {some(15)}') for name in ("credential", "auth", "bearer", "licence", "signing_id") for _ in range(20)]
    rows = list(enumerate([*taught, *plain]))
    field = secret_scan.train(spark.createDataFrame(rows, "doc_id long, text string"))
    texts = [a + b + c for a, b, c in planted]
    found = secret_scan.find(pa.array(texts), field)
    caught = sum(any(k == "field" and s <= len(a) and e >= len(a) + len(b) for k, s, e in f) for (a, b, _), f in zip(planted, found, strict=True))
    false = sum(len(f) for f in secret_scan.find(pa.array(plain), field))
    assert not any(k != "field" for f in found for k, _, _ in f)
    assert caught >= 0.95 * len(planted)
    assert caught / (caught + false) >= 0.95
    untaught = secret_scan.Field()
    assert not any(secret_scan.find(pa.array(texts), untaught))


def test_secrets_in_repeated_and_very_long_texts(spark):
    """A long text is scanned whole, rows of one id each; nulls are empty; other columns stay."""
    text = "word " * 200_000 + 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'
    rows = [(1, text, "a", 5), (1, text, "b", 6), (1, "other", None, 7), (None, None, "c", None), (2, "", "", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, x string, tid int")
    got = secret_scan.scan(docs, secret_scan.train(docs)).collect()
    assert sorted((len(r.spans), str(r.x), str(r.tid)) for r in got) == sorted([(2, "a", "5"), (2, "b", "6"), (0, "None", "7"), (0, "c", "None"), (0, "", "8")])
    assert [(s.kind, s.end) for s in next(r for r in got if r.x == "a").spans] == [("assign", len(text) - 1), ("hex", len(text) - 1)]


def test_hex_runs_end_with_their_text():
    texts = pa.array(["ends in a digest cafe", "0123456789abcdef01234567 first", None, "", "f" * 24, "g"])
    assert secret_scan.candidates(secret_scan.tokenize(texts)).tolist() == [False, True, False, False, True, False]
    found = secret_scan.find(texts, secret_scan.Field())
    assert [[tuple(s.values() if isinstance(s, dict) else s)[:3] for s in r if "hex" in str(s)] for r in found] == [[], [("hex", 0, 24)], [], [], [("hex", 0, 24)], []]


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    f = secret_scan.Field()
    f.emit, f.move = rng.normal(size=f.emit.shape), rng.normal(size=(3, 3))
    x = np.stack([rng.integers(0, w, 6) for w in secret_scan.WIDTHS], 1)
    tags = f.viterbi(x, np.array([0, 4]))
    for a, b in ((0, 4), (4, 6)):
        e, m = f.scores(x[a:b]), f.steps
        best = max(np.ndindex(*(3,) * (b - a)), key=lambda p: m[0, p[0]] + sum(e[k, t] for k, t in enumerate(p)) + sum(m[s, t] for s, t in zip(p, p[1:], strict=False)) + m[p[-1], 0])
        assert tags[a:b].tolist() == list(best)


def test_fingerprints(spark, sf):
    base = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = base + [(9000, None), (9001, ""), (9002, "é"), (9003, "the cat and the dog " * 3000), (9004, base[0][1]), (None, "last one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    prints = collections.defaultdict(set)
    for size in (12 << 20, 20_000):
        got = {r.doc_id: r for r in spotsigs.fingerprints(docs, part_bytes=size).collect()}
        assert len(got) == len(rows)
        for k, (i, t) in enumerate(order):
            t, follow = t or "", order[(k + 1) % len(order)][1] or ""
            n = len(t) // 2
            edited = t[: len(t) - n] + follow[:n]
            assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
            assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
            prints[t].add(got[i].fingerprint)
    assert all(len(v) == 1 for v in prints.values())
    assert spotsigs.fingerprints(docs.limit(0)).count() == 0


def test_likeness_of_large_sets_is_exact(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"the w{a} v{b}" for a, b in rng.integers(0, 25, (n, 2))) for n in (700, 500, 30)]
    got = spotsigs.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    sets = {i: {t[k : k + 3] for t in [tuple(x.split())] for k in range(0, len(t), 3)} for i, x in enumerate(texts)}
    for r in got:
        a, b = sets[r.doc_id], sets[(r.doc_id - 1) % 3]
        assert abs(r.near_next - len(a & b) / len(a | b)) < 1e-12
        assert int(r.fingerprint[2:10], 16) == len(a) and len(r.fingerprint) == 10 + 16 * len(a)
        x, y = ({p[k : k + 16] for k in range(10, len(p), 16)} for p in (r.fingerprint, r.edited_fingerprint))
        assert abs(r.near_edited - len(x & y) / len(x | y)) < 1e-12


def test_pruned_jaccard():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = np.unique(rng.integers(0, 300, rng.integers(1, 200))), np.unique(rng.integers(0, 300, rng.integers(1, 200)))
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        got = spotsigs.pruned_jaccard(a, b, 0.3)
        assert (got is None and j < 0.3) or abs(got - j) < 1e-12


ITEM = "If Ann has 4 apples and gives 2 apples to Bob, how many apples does Ann keep for lunch today ?"
ASKED = [
    (1, ITEM, True), (2, "Before. " + ITEM.replace("Ann", "Maria").replace("Bob", "Peter").replace("4", "12") + " After", True), (3, ITEM.replace("Bob", "Ann", 1).replace("does Ann", "does Bob"), False),
    (4, None, False), (5, "", False), (6, "If you have many apples and give some to a friend how many do you keep for lunch", False), (7, ITEM + " " + "filler words " * 30_000, True), (7, ITEM, True),
]


@pytest.mark.parametrize("most", [2_000_000, -1])
def test_decontamination(spark, most):
    docs = spark.createDataFrame([(i, t, "f", 3) for i, t, _ in ASKED], "doc_id long, text string, found string, item_id int")
    bench = spark.createDataFrame([(9, ITEM), (10, None), (11, ""), (12, "too short")], "item_id long, text string")
    got = sorted((r.doc_id, r.contaminated) for r in dec.decontaminate(docs, bench, most_broadcast=most).collect())
    assert got == sorted((i, c) for i, _, c in ASKED)
    assert not dec.decontaminate(docs, bench.limit(0), most_broadcast=most).where("contaminated").count()
    assert dec.decontaminate(docs.limit(0), bench, most_broadcast=most).count() == 0


NUMBERS = "Lisa , Anna and Otto had 3 , 5 and 7 of 12 + 30 + 41 in Rome , Oslo and Bonn by 1990"


@pytest.mark.parametrize("most", [2_000_000, -1])
def test_decontamination_of_items_with_few_literals(spark, most):
    items = ["Who painted the Mona Lisa?", "How much is 3 + 4?", NUMBERS]
    asked = [(i, f"One more question is {x} and so on", True) for i, x in enumerate(items)] + [(10, items[0].lower(), True), (11, "Who painted the Last Supper?", False), (12, "How much is 3 + 5?", False), (13, NUMBERS.replace("7", "8").replace("30", "31").replace("Rome", "Riga").replace("Anna", "Emma"), False)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in asked], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = sorted((r.doc_id, r.contaminated) for r in dec.decontaminate(docs, bench, most_broadcast=most).collect())
    assert got == [(i, c) for i, _, c in asked]


def test_quality_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/labels.parquet").selectExpr("doc_id", "quality = 0 OR toxic = 1 AS bad")
    model = quality.train(docs, labels.where("doc_id % 2 = 0"))
    judged = quality.classify(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").select("accepted", "bad").collect()
    right = sum(r.accepted != r.bad for r in judged)
    clean = [r for r in judged if not r.bad]
    assert right / len(judged) > 0.85 and sum(r.accepted for r in clean) / len(clean) > 0.93
    odd = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "word " * 90_000, None)], "doc_id long, text string, score string")
    assert [r.accepted for r in quality.classify(odd, model).orderBy("doc_id").collect()][0] is False
    assert quality.classify(odd.limit(0), model).count() == 0
    assert quality.classify(odd, quality.train(odd.limit(0), None)).count() == 3


def test_bound_of_the_training_rows():
    assert inspect.signature(quality.train).parameters["train_rows"].default == 8_000


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(3)
    truth = rng.random(20_000) < 0.4
    accuracy = np.array([0.95, 0.9, 0.8, 0.7])
    v = np.where(rng.random((20_000, 4)) < 0.3, 0, np.where((rng.random((20_000, 4)) < accuracy) == truth[:, None], 1, -1)).astype(np.int8)
    patterns, count = np.unique(v, axis=0, return_counts=True)
    got = quality.fit_label_model(patterns, count.astype(float), first=0.8)
    assert np.abs(got.accuracy - accuracy).max() < 0.04


@pytest.mark.parametrize("sizes", [{}, {"slice_bytes": 30_000, "bucket_hashes": 2_000}])
def test_language_model(spark, sf, sizes):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(80).collect()]
    rows += [(9000, None), (9001, ""), (9002, "zzqqxx ÉÉ " + "w" * 3000), (9003, "the " * 20_000), (9003, "the"), (None, "null id")]
    got = lm_score.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), **sizes).collect()
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    toks = [(i, re.findall("[^\x20\x09-\x0d]+", low(t or "")) + [None]) for i, t in rows]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = collections.Counter(w for i, ws in toks if not held(i) for w in ws)
    n = sum(c.values())
    want = sorted((str(i), held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + len(c) + 1)) for w in ws), 4)) for i, ws in toks)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 for r in got)
    for r in got:
        coded = sum(len(w.encode()) + 1 for w in next(ws for i, ws in toks if i == r.doc_id and len(ws) == r.n_tokens) if w) + 1
        assert abs(r.bits_per_byte + r.score / math.log10(2) / coded) < 1e-9


def test_language_model_is_a_distribution():
    """Probabilities of all strings of one byte, with or without more behind, cannot exceed one."""
    words = [b"ab", b"abc", b"b", b""]
    types = lm_score.Types(np.frombuffer(b"".join(words), np.uint8), np.cumsum([0, *map(len, words)]))
    count = np.array([5, 3, 2, 4])
    table = lm_score.count_contexts(types, count)
    m = lm_score.Mixer()
    m.learn(table, types, count, 14.0)
    every = lm_score.Types(np.delete(np.arange(256), 32).astype(np.uint8), np.arange(256))
    one = 10 ** m.score(table, every, np.zeros(255), 0.0)
    none = 10 ** m.score(table, lm_score.Types(np.zeros(0, np.uint8), np.array([0, 0])), np.zeros(1), 0.0)
    assert 0 < one.sum() + none.sum() <= 1 + 1e-6
    assert lm_score.count_contexts(types, count).sum() == sum(c * (len(w) + 1) * 8 * len(lm_score.BITS) for w, c in zip(words, count, strict=True))


def test_weights_are_learnt_from_all_words():
    words = [b"%d" % i for i in range(100_000, 150_000)]
    types = lm_score.Types(np.frombuffer(b"".join(words), np.uint8), np.cumsum([0, *map(len, words)]))
    count = np.arange(len(words)) % 60
    m = lm_score.Mixer()
    m.learn(lm_score.count_contexts(types, count), types, count, float(count.sum()))
    assert m.seen.sum() == np.minimum(count, 50).sum() * 7 * 8


def test_no_texts(spark):
    assert lm_score.score_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_scores_of_words_against_a_scalar_version():
    """Counts, contexts, mixing and refinement, bit by bit in plain numbers."""
    mask = (1 << 64) - 1
    words = [b"the", b"then", b"a", b"", "\u00e9t\u00e9".encode(), b"longer-than-eight-bytes"]
    count = np.array([5, 2, 9, 7, 1, 0])
    begin = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    types = lm_score.Types(np.frombuffer(b"".join(words), np.uint8), begin)

    def bits(word):
        """(slots of the five contexts, bit, node) of each bit."""
        data, whole = word + b" ", 99
        for place, byte in enumerate(data):
            h, ctx = (77 + (min(place, 8) << 20)) & mask, []
            for k in range(5):
                if k < place:
                    h = (h + data[place - 1 - k] + 1) * 0x9E3779B97F4A7C15 & mask
                    h ^= h >> 29
                if k + 1 in lm_score.ORDERS:
                    ctx.append(h)
            ctx.append(whole)
            node = 1
            for k in range(7, -1, -1):
                bit = byte >> k & 1
                key = node * 0xD6E8FEB86659FD93 & mask
                yield [((c ^ key) * 0xC2B2AE3D27D4EB4F & mask) >> (64 - b) for c, b in zip(ctx, lm_score.BITS, strict=True)], bit, node
                node = node * 2 + bit
            whole = (whole + byte + 1) * 0x9E3779B97F4A7C15 & mask
            whole ^= whole >> 29

    seen = collections.Counter()
    for w, c in zip(words, count.tolist(), strict=True):
        for slots, bit, _ in bits(w):
            for t, s in enumerate(slots):
                seen[t, s, bit] += c
    table = lm_score.count_contexts(types, count)
    assert {k: v for k, v in seen.items() if v} == {(t, s, b): table[b, lm_score.BASES[t] + s] for (t, s, b), v in seen.items() if v}
    assert table.sum() == sum(seen.values())
    mixer = lm_score.Mixer()
    mixer.learn(table, types, count, float(count.sum()))
    mixer.share = 0.5
    got = mixer.score(table, types, count, float(count.sum()))
    refined = mixer.refined()
    level = lambda n: sum(n >= e for e in lm_score.SEEN)
    for i, w in enumerate(words):
        p = 1.0
        for slots, bit, node in bits(w):
            n = [(seen[t, s, 0], seen[t, s, 1]) for t, s in enumerate(slots)]
            gate = level(sum(n[3])) * 5 + level(sum(n[4]))
            z = sum(mixer.weight[gate, t] * math.log((b + lm_score.PRIOR) / (a + lm_score.PRIOR)) for t, (a, b) in enumerate(n)) + mixer.weight[gate, 5]
            one = 1 / (1 + math.exp(-max(-16, min(16, z))))
            q = 0.5 * one + 0.5 * refined[node, min(max(round(z * 2) + 16, 0), 32)]
            p *= q if bit else 1 - q
        assert abs(got[i] - math.log10(0.5 * p + 0.5 * count[i] / count.sum())) < 1e-3


def test_score_depends_on_the_words_before(spark):
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 == 2]
    rows = [(i, "aaaa x1 bbbb y2 " * 3) for i in range(400) if i not in held]
    rows += [(held[0], "aaaa x1 bbbb y2"), (held[1], "aaaa y2 bbbb x1"), (held[2], "y2 bbbb x1 aaaa")]
    got = {r.doc_id: r for r in lm_score.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    seen, swapped, turned = (got[i] for i in held[:3])
    assert abs(seen.base_score - swapped.base_score) < 1e-9 and abs(seen.base_score - turned.base_score) < 1e-9
    assert seen.score > swapped.score + 0.5 and seen.score > turned.score + 0.5
    assert seen.bits_per_byte < swapped.bits_per_byte


def test_contexts_against_a_walk_along_the_text():
    """Counts of the heads' and the rests' contexts, bit by bit along whole texts."""
    mask = (1 << 64) - 1
    texts = ["The cat sat on a mat", "", "été a longer-than-eight-bytes b ab", "a", "a the  cat", None, "on a longer mat"]
    own = lm_score.Slice(pa.array(texts), lm_score._bounds(3))
    start, end = own.start[own.sample], own.end[own.sample]
    words = b"".join(own.buf[a:b].tobytes() for a, b in zip(start, end, strict=True))
    rests = lm_score.Types(np.frombuffer(words, np.uint8), np.concatenate([[0], np.cumsum(end - start)]), lm_score.HEAD)
    tables = lm_score.count_contexts(lm_score.Heads(own.heads), np.bincount(own.head)), lm_score.count_contexts(rests, np.bincount(own.word))
    seen = collections.Counter()
    for text in texts:
        coded = b""
        for word in [*(text or "").lower().encode().split(), b""]:
            before, whole = (b"\0" * 5 + coded)[-5:] if coded else b"\0\0\0\0 ", 99
            for place, byte in enumerate(word + b" "):
                data = (before if place < lm_score.HEAD else b"") + word[:place]
                h, ctx = (77 + (min(place, 8) << 20)) & mask, []
                for k in range(5):
                    if k < len(data):
                        h = (h + data[-1 - k] + 1) * 0x9E3779B97F4A7C15 & mask
                        h ^= h >> 29
                    if k + 1 in lm_score.ORDERS:
                        ctx.append(h)
                node = 1
                for k in range(7, -1, -1):
                    bit, key = byte >> k & 1, node * 0xD6E8FEB86659FD93 & mask
                    for t, (c, b) in enumerate(zip([*ctx, whole], lm_score.BITS, strict=True)):
                        seen[place >= lm_score.HEAD, t, ((c ^ key) * 0xC2B2AE3D27D4EB4F & mask) >> (64 - b), bit] += 1
                    node = node * 2 + bit
                whole = (whole + byte + 1) * 0x9E3779B97F4A7C15 & mask
                whole ^= whole >> 29
            coded += word + b" "
    assert {k: v for k, v in seen.items()} == {(r, t, s, b): tables[r][b, lm_score.BASES[t] + s] for r, t, s, b in seen}
    assert sum(t.sum() for t in tables) == sum(seen.values())

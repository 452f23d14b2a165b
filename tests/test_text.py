from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quern.config import Config
from quern.functions import text as tx
from quern.functions.stemmer import stem
from quern.operators import chunking


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("a", "b"), [("hallucinations", "hallucination"), ("evaluating", "evaluation"), ("caresses", "caress"), ("ponies", "poni"), ("running", "run"), ("generously", "generous"), ("skies", "sky"), ("hoping", "hope"), ("conditional", "condit")])
def test_stems_agree(a, b):
    assert stem(a) == stem(b) or stem(a) == b


def test_tokens(spark):
    assert one(spark, tx.tokens, "GRPO, LoRA.") == ["grpo", "lora"]
    assert one(spark, tx.tokens, "the model") == ["model"]
    assert one(spark, tx.tokens, "a b model") == ["model"]
    assert one(spark, tx.tokens, "été naïve") == ["été", "naïve"]
    for empty in ("", "   ", None):
        assert one(spark, tx.tokens, empty) == []


def test_cites(spark):
    assert one(spark, tx.strip_cites, "POPE [17] and refs [6, 14, 17, 28] evaluate hallucination.") == "POPE  and refs  evaluate hallucination."


def test_clean(spark):
    assert one(spark, tx.clean, "frac-\ntion of\nthe\nThing\n\n\n\nEnd") == "fraction of the\nThing\n\nEnd"
    assert one(spark, tx.clean, "ﬁne") == "fine"


@pytest.mark.parametrize(("n", "size", "overlap"), [(100, 30, 5), (20, 10, 3), (7, 50, 5), (960, 512, 64)])
def test_windows(spark, n, size, overlap):
    words = [str(i) for i in range(n)]
    got = one(spark, lambda c: chunking.windows(c, size, overlap), " ".join(words))
    stride = size - overlap
    want = [" ".join(words)] if n <= size else [" ".join(words[i : i + size]) for i in range(0, n, stride)]
    assert got == want


def test_segments(spark):
    lines = [("d", 0, "intro words", 10.0, False), ("d", 1, "Heading", 14.0, True), ("d", 2, "Second", 14.0, True), ("d", 3, "body one", 10.0, False), ("d", 4, "body two", 10.0, False)]
    got = chunking.segments(spark.createDataFrame(lines, "doc_id string, line_no int, text string, size double, bold boolean"))
    assert [(r.section, r.text) for r in got.orderBy("seg_no").collect()] == [("body", "intro words"), ("Second", "body one\nbody two")]


def test_papers(spark):
    text = " ".join(f"w{i}" for i in range(25))
    papers = spark.createDataFrame([("1v1", "T", list("abcdef"), text, "2024")], "arxiv_id string, title string, authors array<string>, abstract string, published string")
    lines = spark.createDataFrame([("1v1", 0, "Head", 14.0, True), ("1v1", 1, text, 10.0, False), ("1v1", 2, "Next", 14.0, True), ("1v1", 3, text, 10.0, False), ("1v1", 4, "Short", 14.0, True), ("1v1", 5, "too few", 10.0, False)], "doc_id string, line_no int, text string, size double, bold boolean")
    got = chunking.parse_papers(papers, lines).orderBy("chunk_index").collect()
    assert [(r.chunk_id, r.section) for r in got] == [("1v1_0", "Abstract"), ("1v1_1", "Head"), ("1v1_2", "Next")]
    assert got[0].authors == "a, b, c, d, e et al."


def test_config():
    c = Config()
    assert c.chunk_overlap < c.chunk_size and c.final_k <= c.top_k
    with pytest.raises(ValueError, match="chunk_overlap"):
        Config(chunk_size=10, chunk_overlap=10)

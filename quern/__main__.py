"""Command line: ``python -m quern --docs documents.parquet [question ...]``; without questions, one a line from the terminal."""

from __future__ import annotations

import argparse
import sys
import tempfile

from pyspark.sql import functions as F

from quern.config import Config
from quern.operators import maintenance, retrieval, search
from quern.session import session


def main(args: list[str] | None = None) -> None:
    ask = argparse.ArgumentParser(prog="quern", description="Answers questions with excerpts of a table of documents.")
    ask.add_argument("questions", nargs="*")
    ask.add_argument("--docs", required=True, help="Parquet with doc_id and text (title, section where there are)")
    ask.add_argument("--index", help="folder of a stored index; made there if it is missing")
    ask.add_argument("-k", type=int, default=Config().final_k)
    given = ask.parse_args(args)
    spark = session("quern query")
    docs = spark.read.parquet(given.docs)
    path = given.index or tempfile.mkdtemp(prefix="quern-index-")
    if "buckets" not in maintenance.read_stamp(spark, path):
        maintenance.save_bm25(docs, path)
    index, _ = maintenance.open_bm25(spark, path)
    columns = docs.columns
    chunks = docs.select("doc_id", "text", *[(F.col(c) if c in columns else F.lit("")).cast("string").alias(c) for c in ("title", "published", "section")])
    for question in given.questions or (line.strip() for line in sys.stdin):
        if not question:
            continue
        asked = spark.createDataFrame([(1, question)], "query_id int, text string")
        hits = retrieval.bm25_topk(search.valid(asked, given.k), index, k=given.k)
        shown = search.hydrate(hits, chunks).withColumn("relevance", F.lit(1.0)).orderBy("rank").collect()
        for h in shown:
            print(f"[{h.rank}] {h.title or h.doc_id}  {h.section}  score {h.score:.3f}\n    {h.text[:200]}")
        table = spark.createDataFrame(shown) if shown else hits.withColumn("relevance", F.lit(0.0)).join(chunks, "doc_id")
        answer = search.prompts(asked, table).first()
        print(answer.answer or answer.prompt)


if __name__ == "__main__":
    main()

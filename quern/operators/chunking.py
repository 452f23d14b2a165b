"""Segments of typed lines, overlapping word windows, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.config import Config
from quern.functions.text import WORD, authors_line, clean, heading, is_noise, word_count, words

#: Headings recognised without fonts, one to a line.
# --- fixed values: section names ---
SECTION = (
    r"(?m)^\s*(\d{1,2}(?:\.\d{1,2})*\.?\s+[A-Z][A-Za-z\s]{3,50}|Abstract|Introduction|Related Work|Background|Method(?:ology|s)?|Approach|"
    r"Experiment(?:s|al Setup)?|Results?|Discussion|Conclusions?|Limitations?|Appendix|References|Bibliography)\s*$"
)
MARK = "\u0001"


def body_size(lines: DataFrame) -> DataFrame:
    """(doc_id, body): the font size that most characters have; ties go to the size seen first. 10 without lines."""
    by_size = lines.groupBy("doc_id", "size").agg(F.sum(F.length("text")).alias("chars"), F.min("line_no").alias("first"))
    return by_size.groupBy("doc_id").agg(F.coalesce(F.max_by("size", F.struct("chars", -F.col("first"))), F.lit(10.0)).alias("body"))


def islands(rows: DataFrame, heading_flag: Column, order: str, group: str = "doc_id", text: str = "text") -> DataFrame:
    """(group, seg_no, section, text): a heading opens a segment; headings without text below leave only the last of them."""
    run = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = rows.withColumn("_head", heading_flag).withColumn("_seg", F.sum(F.col("_head").cast("int")).over(run))
    named = marked.groupBy(group, "_seg").agg(
        F.max(F.when(F.col("_head"), F.col(text))).alias("section"),
        F.array_sort(F.collect_list(F.when(~F.col("_head"), F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))).alias("body"),
    )
    kept = named.where(F.size("body") > 0)
    return kept.select(group, F.col("_seg").alias("seg_no"), F.coalesce("section", F.lit("body")).alias("section"), F.array_join(F.transform("body", lambda x: x["t"]), "\n").alias("text"))


def segments(lines: DataFrame, tolerance: float = 0.3, most_words: int = 12) -> DataFrame:
    """Segments of lines(doc_id, line_no, text, size, bold) by typography."""
    sized = lines.join(body_size(lines), "doc_id")
    flag = F.coalesce(F.col("bold") & (F.col("size") > F.col("body") + tolerance) & (word_count(F.col("text")) <= most_words), F.lit(False))
    return islands(sized, flag, "line_no")


def segments_by_pattern(docs: DataFrame) -> DataFrame:
    """Segments of plain texts(doc_id, text) at lines that are section names."""
    marked = F.regexp_replace(F.coalesce("text", F.lit("")), SECTION, f"{MARK}#$1{MARK}")
    parts = docs.select("doc_id", F.posexplode(F.split(marked, MARK)).alias("pos", "part")).where(F.col("part") != "")
    head = F.col("part").startswith("#")
    rows = parts.select("doc_id", "pos", F.when(head, F.trim(F.substring("part", 2, 1 << 30))).otherwise(F.concat(F.lit(" "), F.col("part"))).alias("text"), head.alias("head"))
    return islands(rows, F.col("head"), "pos")


def segments_or_pattern(lines: DataFrame) -> DataFrame:
    """By typography; documents where that finds one segment at most fall back to the pattern."""
    typed = segments(lines)
    many = typed.groupBy("doc_id").count().where("count > 1").select("doc_id")
    flat = lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("text"))
    rest = segments_by_pattern(flat.join(many, "doc_id", "left_anti").withColumn("text", clean(F.col("text"))))
    return typed.join(many, "doc_id", "left_semi").unionByName(rest)


def html_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, line_no, text, head) of web pages: the text between block tags in order, headings marked."""
    marked = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?i)<h[1-6][^>]*>", MARK + "#")
    marked = F.regexp_replace(marked, r"(?i)</?(?:h[1-6]|p|li|ul|div|nav|footer|article|head|title|body|html|br)(?:\s[^>]*)?>", MARK)
    rows = pages.select(F.col("page_id").alias("doc_id"), F.posexplode(F.split(marked, MARK)).alias("line_no", "raw"))
    head = F.col("raw").startswith("#")
    bare = F.regexp_replace(F.regexp_replace("raw", r"^#", ""), r"<[^>]*>", " ")
    return rows.select("doc_id", "line_no", F.trim(F.regexp_replace(bare, r"[ \t\n\r]+", " ")).alias("text"), head.alias("head")).where(F.col("text") != "")


def windows(text: Column, size: int, overlap: int) -> Column:
    """Array of word windows: ceil(n / stride) of them; a text within the size is kept as it is."""
    w = words(text)
    stride = size - overlap
    return F.when(F.size(w) <= size, F.array(text)).otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - 1, F.lit(stride)), lambda i: F.array_join(F.slice(w, i + 1, F.lit(size)), " ")))


def chunk(parts: DataFrame, cfg: Config | None = None) -> DataFrame:
    """(doc_id, chunk_id, chunk_index, section, text) of segments(doc_id, seg_no, section, text).

    Texts under ``min_words`` go; the running number counts what is left."""
    cfg = cfg or Config()
    trimmed = parts.withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", ""))
    kept = trimmed.where(word_count(F.col("text")) >= cfg.min_words)
    cut = kept.select("doc_id", "seg_no", "section", F.posexplode(windows(F.col("text"), cfg.chunk_size, cfg.chunk_overlap)).alias("win_no", "text"))
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("seg_no", "win_no")) - 1
    return cut.withColumn("chunk_index", index).select("doc_id", F.concat_ws("_", F.col("doc_id").cast("string"), "chunk_index").alias("chunk_id"), "chunk_index", "section", "text")


def parse_papers(papers: DataFrame, lines: DataFrame, cfg: Config | None = None) -> DataFrame:
    """Chunks of papers(arxiv_id, title, authors, abstract, published) from their lines: the abstract first, then the cleaned segments."""
    abstract = papers.select(F.col("arxiv_id").alias("doc_id"), F.lit(-1).cast("long").alias("seg_no"), F.lit("Abstract").alias("section"), F.col("abstract").alias("text")).where("text IS NOT NULL")
    body = segments_or_pattern(lines).select("doc_id", F.col("seg_no").cast("long"), heading(F.col("section")).alias("section"), clean(F.col("text")).alias("text"))
    named = papers.select(F.col("arxiv_id").alias("doc_id"), "title", authors_line(F.col("authors")).alias("authors"), "published")
    return chunk(abstract.unionByName(body), cfg).join(named, "doc_id")


def drop_noise(chunks: DataFrame) -> DataFrame:
    return chunks.where(~is_noise(F.col("section")))


__all__ = ["WORD", "body_size", "chunk", "drop_noise", "html_lines", "islands", "parse_papers", "segments", "segments_by_pattern", "segments_or_pattern", "windows"]

"""Facts (paper, method, column, value) from tables in markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: row labels that name no method, cells that are empty, patterns of cells ---
NOT_METHODS = (
    "total", "average", "avg", "mean", "overall", "all", "sum", "ours", "baseline", "random", "human", "others", "other", "none", "-", "n/a", "na", "chance", "majority", "std", "sd",
    "count", "number", "our method", "our model", "random baseline", "human expert",
)
EMPTY = ("", "-", "--", "n/a", "N/A", "—")


def clean_cell(cell: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(cell, r"[*_`]", ""), r"\s+", " "))


def cell_kind(cell: Column) -> Column:
    """number, ambiguous or none, of a cleaned cell."""
    bare = F.replace(cell, F.lit(","), F.lit(""))
    return F.when(cell.isin(*EMPTY), "none").when(cell.rlike(r"\d.*[/±].*\d"), "ambiguous").when(bare.rlike(r"^[+-]?\d*\.?\d+%?$"), "number").otherwise("none")


def cell_value(cell: Column) -> Column:
    return F.regexp_replace(F.replace(cell, F.lit(","), F.lit("")), "%+$", "").try_cast("double")


def _cells(line: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(line, r"^\|+|\|+$", ""), r"\|"), clean_cell)


def parsed_rows(tables: DataFrame) -> DataFrame:
    """(figure_id, arxiv_id, caption, headers, row_no, cells) of tables(figure_id, arxiv_id, caption, markdown); row_no NULL: not a table."""
    lines = F.filter(F.split(F.coalesce("markdown", F.lit("")), "\r\n|[\n\r]"), lambda x: F.ltrim(x).startswith("|") & F.regexp_replace(clean_cell(x), r"[|\-: ]", "").rlike("."))
    listed = tables.withColumn("_l", lines)
    headers = F.when(F.size("_l") >= 2, _cells(F.get("_l", F.lit(0))))
    body = F.when(F.size("_l") >= 2, F.filter(F.transform(F.slice("_l", 2, 1 << 30), _cells), lambda c: F.size(c) >= 2))
    return listed.select("figure_id", "arxiv_id", "caption", headers.alias("headers"), F.posexplode_outer(body).alias("row_no", "cells"))


def candidates(tables: DataFrame) -> DataFrame:
    """Every cell or row with the reason it is dropped, or NULL where it is a measurement."""
    rows = parsed_rows(tables)
    label = F.get("cells", F.lit(0))
    name = F.trim(F.regexp_replace(F.lower(F.trim(F.regexp_replace(label, r"\s*\([^)]*\)", ""))), r"[^a-z0-9.\- ]", ""))
    row_reason = F.when(F.col("row_no").isNull(), "unparseable table").when(name == "", "empty row label").when(name.isin(*NOT_METHODS), "non-entity row label").when(cell_kind(label) != "none", "numeric row label")
    marked = rows.withColumn("method_raw", label).withColumn("method", name).withColumn("row_reason", row_reason)
    bad = marked.where("row_reason IS NOT NULL").select("figure_id", "arxiv_id", "caption", "method", "method_raw", F.lit(None).cast("string").alias("column"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("boolean").alias("is_percent"), F.col("row_reason").alias("drop_reason"))
    cells = marked.where("row_reason IS NULL").select("figure_id", "arxiv_id", "caption", "method", "method_raw", "headers", F.posexplode(F.slice("cells", 2, 1 << 30)).alias("j", "cell"))
    kind, value, percent = cell_kind(F.col("cell")), cell_value(F.col("cell")), F.col("cell").endswith("%")
    reason = F.when(kind == "none", "non-numeric cell").when(kind == "ambiguous", "ambiguous cell").when(value.isNull(), "non-numeric cell").when(percent & ~value.between(0, 100), "percent out of range")
    good = cells.select("figure_id", "arxiv_id", "caption", "method", "method_raw", F.coalesce(F.get("headers", F.col("j") + 1), F.concat(F.lit("col"), (F.col("j") + 1).cast("string"))).alias("column"), value.alias("value"), percent.alias("is_percent"), reason.alias("drop_reason"))
    return good.unionByName(bad)


def measurements(tables: DataFrame) -> DataFrame:
    caption = F.substring(F.trim(F.regexp_replace(F.coalesce("caption", F.lit("")), r"\s+", " ")), 1, 160)
    return candidates(tables).where("drop_reason IS NULL").select(F.substring_index("arxiv_id", "v", 1).alias("paper"), "method", "method_raw", "column", "value", "is_percent", F.concat(F.lit("table:"), "figure_id").alias("source"), caption.alias("caption"))


def with_manifest(transcripts: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tables, unknown) of transcripts(figure_id, markdown): those that the manifest(figure_id, arxiv_id, caption) lists, and the rest."""
    return transcripts.join(manifest.select("figure_id", "arxiv_id", "caption"), "figure_id").select("figure_id", "arxiv_id", "caption", "markdown"), transcripts.join(manifest, "figure_id", "left_anti").select("figure_id")


def drop_reasons(tables: DataFrame, unknown: DataFrame | None = None) -> DataFrame:
    """Why cells, rows and tables were left out, with counts; ``unknown`` transcripts have no manifest entry."""
    reasons = candidates(tables).where("drop_reason IS NOT NULL").select("drop_reason")
    if unknown is not None:
        reasons = reasons.union(unknown.select(F.lit("no manifest entry")))
    return reasons.groupBy("drop_reason").count()


def joinable(measured: DataFrame, papers: int = 2, most: int = 15) -> DataFrame:
    """Methods in several papers, the most widespread first."""
    spread = measured.groupBy("method").agg(F.count_distinct("paper").alias("papers"))
    return spread.where(F.col("papers") >= papers).orderBy(F.col("papers").desc(), "method").limit(most)

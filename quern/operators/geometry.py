"""Page geometry: captions, columns, bands; interval joins within a page.

blocks(doc_id, page, block_no, x0, y0, x1, y1, text); captions(doc_id, page, figure_id, x0, y0, x1, y1);
page_box(doc_id, page, px0, py0, px1, py1); graphics(doc_id, page, kind, x0, y0, x1, y1).
Every join has (doc_id, page) as its key; the overlap is a residual condition, so nothing is joined across pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions.text import collapse, word_count

# --- fixed values: the caption pattern; least characters of a caption; least sides, strokes, heights, characters and ink of a region ---
CAPTION = r"(?is)^\s*(fig(?:ure)?\.?|table)\s*(\d+)\s*[:.]\s*(\S.*)"
CAPTION_CHARS = 25
REGION, STROKES, TALL, TABLE_CHARS, INK = 40.0, 8, 80.0, 80, 0.005
PAD, GAP = 6.0, 12.0
PAGE = ["doc_id", "page"]


def reading_order(blocks: DataFrame) -> DataFrame:
    return blocks.where(F.trim("text") != "").withColumn("place", F.row_number().over(Window.partitionBy(*PAGE).orderBy(F.round("y0", 1), "x0")))


def caption_candidates(blocks: DataFrame, tables: bool = False) -> DataFrame:
    """Every block that opens with a caption, under an id of its own: figure_id is ``<doc>-p<page>-<kind><number>``,
    which several may share; ``candidate`` tells them apart, ``place`` is their reading order.  ``caption`` is what follows the prefix."""
    kind = F.when(F.lower(F.regexp_extract("text", CAPTION, 1)).startswith("fig"), "figure").otherwise("table")
    found = blocks.where(F.col("text").rlike(CAPTION)).select("doc_id", "page", "block_no", "x0", "y0", "x1", "y1", kind.alias("kind"), F.regexp_extract("text", CAPTION, 2).alias("number"), collapse(F.regexp_extract("text", CAPTION, 3)).alias("caption"))
    found = found.where(F.length("caption") >= CAPTION_CHARS)
    if not tables:
        found = found.where("kind = 'figure'")
    page = F.concat(F.col("doc_id").cast("string"), F.lit("-p"), F.col("page").cast("string"))
    place = F.struct(F.round("y0", 1).alias("y"), F.col("x0").alias("x"), "block_no")
    return found.select("*", F.concat(page, F.lit("-"), "kind", "number").alias("figure_id"), F.concat(page, F.lit("-b"), F.col("block_no").cast("string")).alias("candidate"), place.alias("place"), F.concat(F.initcap("kind"), F.lit(" "), "number").alias("label"))


def _first(found: DataFrame) -> DataFrame:
    """Of the rows of one figure the first in reading order."""
    order = Window.partitionBy("figure_id").orderBy("place")
    return found.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def captions(blocks: DataFrame, tables: bool = False) -> DataFrame:
    """Blocks that open with a caption; of a figure found twice on a page, the first."""
    return _first(caption_candidates(blocks, tables))


def is_prose(text: Column) -> Column:
    return word_count(text) >= 8


def is_sentence(text: Column) -> Column:
    """Running prose: eight words, few digits and table signs, some sentence punctuation (fixed values: the signs and shares)."""
    signs = F.length(text) - F.length(F.regexp_replace(text, r"[\p{Nd}✓✗×√±%|]", ""))
    stops = F.regexp_count(text, F.lit(r"\. ")) + F.regexp_count(text, F.lit(", "))
    return is_prose(text) & (signs / F.greatest(F.length(text), F.lit(1)) <= 0.10) & (stops >= 1)


def _beside(caps: DataFrame, blocks: DataFrame, condition: Column) -> DataFrame:
    c, b = caps.alias("c"), blocks.alias("b")
    key = (F.col("c.doc_id") == F.col("b.doc_id")) & (F.col("c.page") == F.col("b.page"))
    return c.join(b, key & condition, "left")



def _same_column() -> Column:
    return (F.col("b.x1") > F.col("c.x0")) & (F.col("b.x0") < F.col("c.x1"))


def ceilings(caps: DataFrame, blocks: DataFrame, page_box: DataFrame, sentences: bool = False) -> DataFrame:
    """(figure_id, ceiling): the lowest edge of prose (of body sentences, for tables) above the caption in its column, or the page's top."""
    met = _beside(caps, blocks.where(is_sentence(F.col("text")) if sentences else is_prose(F.col("text"))), (F.col("b.y1") <= F.col("c.y0")) & _same_column())
    near = met.groupBy("c.figure_id", "c.doc_id", "c.page").agg(F.max("b.y1").alias("edge"))
    return near.join(page_box, PAGE).select("figure_id", F.greatest(F.coalesce("edge", "py0"), "py0").alias("ceiling"))


def floors(caps: DataFrame, blocks: DataFrame, page_box: DataFrame) -> DataFrame:
    """(figure_id, floor): the highest edge of a body sentence below the caption in its column, or the page's bottom."""
    met = _beside(caps, blocks.where(is_sentence(F.col("text"))), (F.col("b.y0") >= F.col("c.y1")) & _same_column())
    near = met.groupBy("c.figure_id", "c.doc_id", "c.page").agg(F.min("b.y0").alias("edge"))
    return near.join(page_box, PAGE).select("figure_id", F.least(F.coalesce("edge", "py1"), "py1").alias("floor"))


def column_spans(caps: DataFrame, blocks: DataFrame, page_box: DataFrame) -> DataFrame:
    """(figure_id, lo, hi): the caption's column on a two-column page, else the page's width."""
    mid = (F.col("px0") + F.col("px1")) / 2
    sides = blocks.where(is_sentence(F.col("text"))).join(page_box, PAGE).groupBy(*PAGE).agg(F.count_if(F.col("x1") <= mid).alias("left"), F.count_if((F.col("x0") >= mid) & (F.col("x1") > mid)).alias("right"))
    c = caps.join(page_box, PAGE).join(sides, PAGE, "left")
    wide = (F.col("x1") - F.col("x0")) > 0.60 * (F.col("px1") - F.col("px0"))
    two = ~wide & (F.coalesce("left", F.lit(0)) >= 3) & (F.coalesce("right", F.lit(0)) >= 3)
    on_left = (F.col("x0") + F.col("x1")) / 2 <= mid
    return c.select("figure_id", F.when(two & ~on_left, mid).otherwise(F.col("px0")).alias("lo"), F.when(two & on_left, mid).otherwise(F.col("px1")).alias("hi"))


def merged_intervals(rows: DataFrame, group: list[str], lo: str = "x0", hi: str = "x1", gap: float = GAP) -> DataFrame:
    """Islands of intervals no more than ``gap`` apart: (group, island, lo, hi)."""
    order = Window.partitionBy(*group).orderBy(lo, hi)
    reach = F.max(hi).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col(lo) > reach + gap), 1).otherwise(0)
    marked = rows.withColumn("_new", new).withColumn("island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return marked.groupBy(*group, "island").agg(F.min(lo).alias("lo"), F.max(hi).alias("hi"))


def band_extents(bands: DataFrame, blocks: DataFrame, gap: float = GAP) -> DataFrame:
    """(figure_id, x0, x1): bands(figure_id, doc_id, page, y0, y1, x0, x1, lo, hi) grown over the blocks they touch.

    Growing step by step reaches exactly the island of intervals that holds the start, so the
    start joins the blocks as one more interval and its island is the answer."""
    c = bands.withColumn("sx0", F.greatest("x0", "lo")).withColumn("sx1", F.least("x1", "hi"))
    key = (F.col("c.doc_id") == F.col("b.doc_id")) & (F.col("c.page") == F.col("b.page"))
    inside = (F.col("b.y1") > F.col("c.y0")) & (F.col("b.y0") < F.col("c.y1")) & (F.col("b.x1") > F.col("c.lo")) & (F.col("b.x0") < F.col("c.hi"))
    near = c.alias("c").join(blocks.alias("b"), key & inside).select("c.figure_id", F.greatest("b.x0", "c.lo").alias("x0"), F.least("b.x1", "c.hi").alias("x1"), F.lit(False).alias("seed"))
    every = near.unionByName(c.select("figure_id", F.col("sx0").alias("x0"), F.col("sx1").alias("x1"), F.lit(True).alias("seed")))
    found = merged_intervals(every.select("figure_id", "x0", "x1"), ["figure_id"], gap=gap)
    start = c.select("figure_id", "sx0", "sx1")
    return found.join(start, "figure_id").where("lo <= sx0 AND hi >= sx1").select("figure_id", F.col("lo").alias("x0"), F.col("hi").alias("x1"))


def _within(bands: DataFrame, rows: DataFrame) -> DataFrame:
    key = (F.col("c.doc_id") == F.col("b.doc_id")) & (F.col("c.page") == F.col("b.page"))
    solid = (F.col("b.x1") > F.col("b.x0")) & (F.col("b.y1") > F.col("b.y0"))  # an empty box touches nothing
    touch = solid & (F.col("b.x0") < F.col("c.x1")) & (F.col("b.x1") > F.col("c.x0")) & (F.col("b.y0") < F.col("c.y1")) & (F.col("b.y1") > F.col("c.y0"))
    return bands.alias("c").join(rows.alias("b"), key & touch, "left")


def text_density(bands: DataFrame, blocks: DataFrame) -> DataFrame:
    """(figure_id, chars): characters of the blocks that touch the band."""
    return _within(bands, blocks).groupBy("c.figure_id").agg(F.coalesce(F.sum(F.length("b.text")), F.lit(0)).alias("chars"))


def graphic_extents(bands: DataFrame, graphics: DataFrame) -> DataFrame:
    """(figure_id, gx0..gy1, n_drawings, n_images): union of the graphics that touch the band."""
    return _within(bands, graphics).groupBy("c.figure_id").agg(F.min("b.x0").alias("gx0"), F.min("b.y0").alias("gy0"), F.max("b.x1").alias("gx1"), F.max("b.y1").alias("gy1"), F.count_if(F.col("b.kind") == "drawing").alias("n_drawings"), F.count_if(F.col("b.kind") == "image").alias("n_images"))


def extract_figures(blocks: DataFrame, graphics: DataFrame, page_box: DataFrame, tables: bool = True, inks: DataFrame | None = None) -> DataFrame:
    """Figures and tables with their boxes: figure_id, doc_id, page, kind, number, label, caption, x0, y0, x1, y1, n_drawings, n_images.

    A figure's band lies between the prose above and its caption, as wide as the caption; it counts if
    it has enough strokes or an image, or is tall without prose; its box is what is drawn in the band.  A
    table is the band above or below its caption with more text in it (above on ties), then as wide
    as its text.  Of candidates for one figure the first that counts stays.  ``inks`` (candidate, ink), from
    rendered boxes, drops blank ones."""
    every = caption_candidates(blocks, tables).join(page_box, PAGE)
    head = ["figure_id", "candidate", "place", "doc_id", "page", "kind", "number", "label", "caption"]
    # each candidate is a figure of its own until the last step
    named = every.withColumn("figure_id", F.col("candidate"))
    sides = [F.greatest(F.col("x0") - PAD, "px0").alias("x0"), F.least(F.col("x1") + PAD, "px1").alias("x1")]

    fig = named.where("kind = 'figure'")
    band = fig.join(ceilings(fig, blocks, page_box), "figure_id").select("figure_id", "doc_id", "page", *sides, F.col("ceiling").alias("y0"), F.col("y0").alias("y1")).where(F.col("y1") - F.col("y0") >= REGION)
    prose = _within(band, blocks.where(is_prose(F.col("text")))).groupBy("c.figure_id").agg(F.count("b.text").alias("prose"))
    drawn = band.join(graphic_extents(band, graphics), "figure_id").join(prose, "figure_id")
    counts = (F.col("n_drawings") >= STROKES) | (F.col("n_images") > 0) | ((F.col("y1") - F.col("y0") >= TALL) & (F.col("prose") == 0))
    cut_box = [F.greatest("x0", "gx0"), F.greatest("y0", "gy0"), F.least("x1", "gx1"), F.least("y1", "gy1")]
    some = F.col("gx0").isNotNull() & (cut_box[2] > cut_box[0]) & (cut_box[3] > cut_box[1])
    boxed = drawn.where(counts).select("figure_id", *[F.when(some, c).otherwise(F.col(n)).alias(n) for c, n in zip(cut_box, ("x0", "y0", "x1", "y1"), strict=True)], "n_drawings", "n_images")

    tab = named.where("kind = 'table'")
    spans = tab.join(ceilings(tab, blocks, page_box, sentences=True), "figure_id").join(floors(tab, blocks, page_box), "figure_id").join(column_spans(tab.drop("px0", "py0", "px1", "py1"), blocks, page_box), "figure_id")
    bands = [spans.select(F.concat_ws("#", "figure_id", F.lit(n)).alias("figure_id"), "doc_id", "page", *sides, top.alias("y0"), bottom.alias("y1"), "lo", "hi") for n, top, bottom in ((0, F.col("ceiling"), F.col("y0")), (1, F.col("y1"), F.col("floor")))]
    both = bands[0].unionByName(bands[1]).where((F.col("y1") - F.col("y0") >= REGION) & (F.col("x1") > F.col("x0")))
    dense = both.join(text_density(both, blocks), "figure_id").withColumn("own", F.substring_index("figure_id", "#", 1)).withColumn("side", F.substring_index("figure_id", "#", -1).cast("int"))
    best = dense.groupBy("own").agg(F.max_by(F.struct("doc_id", "page", "x0", "y0", "x1", "y1", "lo", "hi"), F.struct("chars", -F.col("side"))).alias("t")).select(F.col("own").alias("figure_id"), "t.*")
    wide = best.drop("x0", "x1").join(band_extents(best, blocks), "figure_id")
    full = wide.join(text_density(wide, blocks), "figure_id").where(F.col("chars") >= TABLE_CHARS).select("figure_id", "x0", "y0", "x1", "y1", F.lit(0).cast("long").alias("n_drawings"), F.lit(0).cast("long").alias("n_images"))

    out = boxed.unionByName(full).where((F.col("x1") - F.col("x0") >= REGION) & (F.col("y1") - F.col("y0") >= REGION)).withColumnRenamed("figure_id", "candidate")
    if inks is not None:
        out = out.join(inks.where(F.col("ink") >= INK), "candidate")
    return _first(every.select(*head).join(out, "candidate")).drop("place")


def figure_text(label: Column, caption: Column, description: Column) -> Column:
    """Caption first, then the description if there is one."""
    return F.concat_ws("\n", F.concat(label, F.lit(": "), caption), description)


def figure_chunks(figures: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Figures as ordinary chunks, with their descriptions where known."""
    label = F.col("label")
    return figures.join(descriptions, "figure_id", "left").select(F.col("figure_id").alias("chunk_id"), "doc_id", label.alias("section"), figure_text(label, F.col("caption"), F.col("description")).alias("text"))

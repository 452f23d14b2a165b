"""Benchmark decontamination by template canonicalisation.

Every word becomes a template token: punctuation at its ends goes, letters A-Z are lowered,
and numbers, names (a capital that does not begin a sentence) and units of measure turn into
typed placeholders.  A question asked again with other figures, people or units has the same
template.  Windows of ``window`` template tokens are hash-joined with those of the benchmark;
hits of one document and item on one diagonal (document position minus item position) form an
alignment.  Its *slots* -- placeholder positions -- are then checked: within an alignment,
equal values in the item must meet equal values in the document and different values
different ones, or the hit that breaks this is dropped.  A document is contaminated by an item
if the windows left on a diagonal cover ``coverage`` of the item's tokens.

The benchmark's windows go to all executors only if there are at most ``most_broadcast`` of
them; beyond, windows of the distinct texts meet them in a shuffle join, with the same result.  Nothing depends on the number of
documents: each is judged by itself.

Defined results: null or empty texts and items have no windows; an item shorter than a window
is one window of its whole length, and needs ``least_literal`` words that are no placeholders
like any other; rows that repeat an id are judged alone; so are items that repeat an item id
(with another text; equal rows are one item), and an item id may be null; an empty benchmark
contaminates nothing; columns of the documents pass through, save those named as the results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from .near_dedup import slices
from .state import cut
from .tokens import LOWER, Tokens, hash_slices, join_hash, mix, rolling, tokenize

U = np.uint64
NUMBER, NAME, UNIT = (mix(np.array([k], U))[0] for k in (101, 102, 103))
# --- fixed values: names of units of measure and currencies ---
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg gram grams kilogram kilograms tonne tonnes ton tons oz ounce ounces lb lbs pound pounds "
    "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "dollar dollars euro euros cent cents usd eur gbp percent mph kph km/h m/s hz khz mhz ghz w kw mw v a k kb mb gb tb degrees celsius fahrenheit"
)
PUNCT = np.zeros(256, bool)
PUNCT[[i for i in range(33, 127) if not chr(i).isalnum()]] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
NUMERIC = DIGIT.copy()
NUMERIC[[ord(c) for c in ".,/:+-%^"]] = True
ENDS = np.zeros(256, bool)
ENDS[[ord(c) for c in ".!?:"]] = True


def _unit_hashes() -> np.ndarray:
    t = tokenize(pa.array([UNITS]))
    return np.sort(hash_slices(t.buf, t.start, t.end))


@dataclass
class Template:
    tokens: Tokens
    code: np.ndarray  # template token
    slot: np.ndarray  # is a placeholder
    value: np.ndarray  # hash of the word behind it


def template(col: pa.Array | pa.ChunkedArray) -> Template:
    t = tokenize(col)
    n = len(t.start)
    if not n:
        return Template(t, np.zeros(0, U), np.zeros(0, bool), np.zeros(0, U))
    a, b = t.start.copy(), t.end.copy()
    for at, step, edge in ((a, 1, 0), (b, -1, -1)):
        live = np.arange(n)
        while len(live):
            live = live[(a[live] < b[live])]
            live = live[PUNCT[t.buf[at[live] + edge]]]
            at[live] += step
    bare = a >= b  # nothing but punctuation: kept as it is
    a[bare], b[bare] = t.start[bare], t.end[bare]
    first = t.buf[a]
    upper = (first >= 65) & (first <= 90) | (first == 195) & (t.buf[np.minimum(a + 1, len(t.buf) - 1)] < 158)
    opens = np.ones(n, bool)
    opens[1:] = ENDS[t.buf[t.end[:-1] - 1]]
    opens[t.first[:-1][t.first[:-1] < n]] = True
    newline = np.zeros(n, bool)
    newline[1:] = t.buf[t.start[1:] - 1] == 10
    low = LOWER[t.buf]
    value = hash_slices(low, a, b)
    odd = np.concatenate([[0], np.cumsum(~NUMERIC[t.buf], dtype=np.int64)])
    has = np.concatenate([[0], np.cumsum(DIGIT[t.buf], dtype=np.int64)])
    number = (odd[b] == odd[a]) & (has[b] > has[a]) & ~bare
    units = _unit_hashes()
    at = np.minimum(np.searchsorted(units, value), len(units) - 1)
    unit = (units[at] == value) & np.concatenate([[False], number[:-1]]) & (t.doc == np.concatenate([[-1], t.doc[:-1]]))
    name = upper & ~opens & ~newline & ~number & ~unit
    code = value.copy()
    code[number], code[name], code[unit] = NUMBER, NAME, UNIT
    return Template(t, code, number | name | unit, value)


@dataclass
class Items:
    """The benchmark: its windows sorted by hash, and the tokens of all items."""

    ids: list
    first: np.ndarray
    value: np.ndarray
    slot: np.ndarray
    sizes: list[int]
    hash: np.ndarray
    item: np.ndarray
    pos: np.ndarray
    size: np.ndarray


def windows(t: Template, size: int, least_literal: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the windows of that many tokens that have enough literal words."""
    at, enough = _starts(t, size, least_literal)
    at = at[enough]
    return at, join_hash(rolling(t.code, size, 21)[at], np.full(len(at), size, U), 21) if len(at) else np.zeros(0, U)


def exact_windows(t: Template, size: int, least_literal: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) over the words themselves: of the windows without enough literal words, or of all."""
    at, enough = _starts(t, size, least_literal or 0)
    at = at if least_literal is None else at[~enough]
    return at, join_hash(rolling(t.value, size, 22)[at], np.full(len(at), size, U), 22) if len(at) else np.zeros(0, U)


def _starts(t: Template, size: int, least_literal: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows inside one text, and whether they have enough literal words."""
    n = len(t.code) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    plain = np.concatenate([[0], np.cumsum(~t.slot, dtype=np.int64)])
    at = np.flatnonzero(t.tokens.doc[:n] == t.tokens.doc[size - 1 :])
    return at, (plain[size:] - plain[:n])[at] >= min(least_literal, size)


def both_windows(t: Template, size: int, least_literal: int, indexed: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """Windows of the template and of the words themselves. Items are indexed by the one or the other; texts are asked for both, as their case and punctuation may make other slots."""
    return [windows(t, size, least_literal), exact_windows(t, size, least_literal if indexed else None)]


def index_items(table: pa.Table, window: int, least_literal: int) -> Items:
    t = template(table["text"])
    n = t.tokens.counts
    sizes = sorted({int(min(window, k)) for k in n if k > 0})
    hs, pos = [], []
    for s in sizes:
        at, h = (np.concatenate(v) for v in zip(*both_windows(t, s, least_literal, True), strict=True))
        whole = n[t.tokens.doc[at]] if len(at) else at
        fit = np.minimum(whole, window) == s
        hs.append(h[fit])
        pos.append(at[fit])
    h = np.concatenate(hs) if hs else np.zeros(0, U)
    p = np.concatenate(pos) if pos else np.zeros(0, np.int64)
    o = np.argsort(h, kind="stable")
    h, p = h[o], p[o]
    item = t.tokens.doc[p] if len(p) else p
    return Items(table["item_id"].to_pylist(), t.tokens.first, t.value, t.slot, sizes, h, item, p - t.tokens.first[item] if len(p) else p, np.minimum(n, window)[item] if len(p) else p)


def align(doc: np.ndarray, pos: np.ndarray, item: np.ndarray, at: np.ndarray, size: np.ndarray, slots, length: np.ndarray) -> list[tuple[int, int, float, bool]]:
    """(document, item, covered share, changed) of each pair of a document and an item that meet; ``slots(doc, item, diagonal)`` gives pairs of values at an offset."""
    diagonal = pos - at
    o = np.lexsort((at, diagonal, item, doc))
    doc, item, at, size, diagonal = doc[o], item[o], at[o], size[o], diagonal[o]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1])])
    begin = np.concatenate([np.flatnonzero(new), [len(doc)]])
    best: dict[tuple[int, int], tuple[float, bool]] = {}
    for s, e in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        d, i, g = int(doc[s]), int(item[s]), int(diagonal[s])
        there: dict[int, int] = {}
        back: dict[int, int] = {}
        covered, done, changed = 0, 0, False
        for k in range(s, e):
            a, b = int(at[k]), int(at[k] + size[k])
            pairs = slots(d, i, g, a, b)
            if any(there.get(x, y) != y or back.get(y, x) != x for x, y in pairs):
                continue
            fresh: dict[int, int] = {}
            if any(fresh.setdefault(x, y) != y for x, y in pairs) or len(set(fresh.values())) < len(fresh):
                continue
            for x, y in pairs:
                there[x], back[y] = y, x
                changed |= x != y
            covered += b - max(a, done)
            done = b
        share = covered / length[i] if length[i] else 0.0
        if share > best.get((d, i), (0.0, False))[0]:
            best[d, i] = share, changed
    return [(d, i, share, changed) for (d, i), (share, changed) in best.items()]


FOUND = ArrayType(StructType().add("item_id", "long").add("coverage", "double").add("changed", "boolean"))
FOUND_TYPE = pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64()), ("changed", pa.bool_())]))


def judge(col: pa.ChunkedArray, items: Items, least_literal: int, coverage: float) -> list[list[dict]]:
    t = template(col)
    rows: list[list[dict]] = [[] for _ in range(len(col))]
    doc, pos, item, at, size = [], [], [], [], []
    for s in items.sizes:
        start, h = (np.concatenate(v) for v in zip(*both_windows(t, s, least_literal, False), strict=True))
        lo = np.searchsorted(items.hash, h)
        hit = np.flatnonzero(items.hash[np.minimum(lo, len(items.hash) - 1)] == h) if len(items.hash) else np.zeros(0, np.int64)
        if not len(hit):
            continue
        lo, hi = lo[hit], np.searchsorted(items.hash, h[hit], side="right")
        k = hi - lo
        which = np.repeat(lo, k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        word = np.repeat(start[hit], k)
        doc.append(t.tokens.doc[word])
        pos.append(word)
        item.append(items.item[which])
        at.append(items.pos[which])
        size.append(items.size[which])
    if not doc:
        return rows
    length = np.diff(items.first)

    def slots(d: int, i: int, diagonal: int, a: int, b: int) -> list[tuple[int, int]]:
        f = int(items.first[i])
        k = np.flatnonzero(items.slot[f + a : f + b]) + a
        return list(zip(items.value[f + k].tolist(), t.value[diagonal + k].tolist(), strict=True)) if len(k) else []

    for d, i, share, changed in align(*(np.concatenate(v) for v in (doc, pos, item, at, size)), slots, length):
        if share >= coverage:
            rows[d].append({"item_id": items.ids[i], "coverage": share, "changed": changed})
    for r in rows:
        r.sort(key=lambda x: (x["item_id"] is None, x["item_id"] or 0, x["coverage"], x["changed"]))
    return rows


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 8, least_literal: int = 5, coverage: float = 0.5, most_broadcast: int = 2_000_000) -> DataFrame:
    """``docs`` with ``found`` (items, each with its covered share and whether slots differ) and ``contaminated``."""
    spark = docs.sparkSession
    bench = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).distinct()
    words = bench.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    kept = [c for c in docs.columns if c not in ("found", "contaminated")]
    source = docs.select(*kept)
    if words // 2 <= most_broadcast:
        held = spark.sparkContext.broadcast(bench.toArrow())
        schema = StructType([*source.schema.fields, StructField("found", FOUND)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = index_items(held.value, window, least_literal)
            for part in slices(batches, text_col):
                found = judge(part[text_col], items, least_literal, coverage)
                yield from part.append_column("found", pa.array(found, FOUND_TYPE)).combine_chunks().to_batches()

        out = source.mapInArrow(run, schema)
    else:
        out = _by_shuffle(source, cut(bench), text_col, window, least_literal, coverage)
    return out.withColumn("contaminated", F.size("found") > 0)


SLOTS = pa.list_(pa.struct([("k", pa.int32()), ("v", pa.int64())]))
WINDOWS = "h long, {}, pos long, size int, length long, slots array<struct<k: int, v: long>>"


def _exploded(keys: list[str], sizes: list[int], window: int, least_literal: int, indexed: bool):
    """Rows of windows of these sizes: hash, keys, place, number of tokens, slots with their values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            t = template(part["text"])
            n = t.tokens.counts
            for s in sizes:
                for exact, (at, h) in enumerate(both_windows(t, s, least_literal, indexed)):
                    if indexed and len(at):
                        fit = np.minimum(n[t.tokens.doc[at]], window) == s
                        at, h = at[fit], h[fit]
                    if not len(at):
                        continue
                    doc = t.tokens.doc[at]
                    grid = at[:, None] + np.arange(s)
                    slot = t.slot[grid] & (indexed or not exact)  # an exact window of a text has the values of the item's
                    offset = np.concatenate([[0], np.cumsum(slot.sum(axis=1))]).astype(np.int32)
                    held = pa.StructArray.from_arrays([pa.array(np.nonzero(slot)[1].astype(np.int32)), pa.array(t.value[grid][slot].view(np.int64))], fields=list(SLOTS.value_type))
                    own = {k: part[k].combine_chunks().take(pa.array(doc)) for k in keys}
                    yield from pa.table({"h": pa.array(h.view(np.int64)), **own, "pos": pa.array(at - t.tokens.first[doc]), "size": pa.array(np.full(len(at), s, np.int32)), "length": pa.array(n[doc], pa.int64()), "slots": pa.ListArray.from_arrays(pa.array(offset), held)}).to_batches()

    return run


def _by_shuffle(source: DataFrame, bench: DataFrame, text_col: str, window: int, least_literal: int, coverage: float) -> DataFrame:
    """The same result for a benchmark of any size: windows of both sides meet in a shuffle join, those of equal texts once."""
    mark = "_" * (2 + max((len(c) - len(c.lstrip("_")) for c in source.columns), default=0)) + "text"
    keyed = source.withColumn(mark, F.sha2(F.col(text_col), 256))
    texts = keyed.select(F.col(mark).alias("key"), F.col(text_col).alias("text")).where("key IS NOT NULL").dropDuplicates(["key"])
    items = bench.withColumn("item", F.sha2("text", 256)).where("item IS NOT NULL")
    counted = items.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"size": pa.array(np.unique(np.minimum(template(b["text"]).tokens.counts, window)), pa.int64())}) for b in batches), "size long")
    sizes = sorted(r.size for r in counted.where("size > 0").distinct().collect())  # at most ``window`` of them
    probes = texts.mapInArrow(_exploded(["key"], sizes, window, least_literal, False), WINDOWS.format("key string"))
    indexed = items.mapInArrow(_exploded(["item_id", "item"], sizes, window, least_literal, True), WINDOWS.format("item_id long, item string"))
    hits = probes.selectExpr("h", "size", "key", "pos", "slots AS doc_slots").join(indexed.selectExpr("h", "size", "item_id", "item", "pos AS at", "length", "slots AS item_slots"), ["h", "size"])

    def verify(part: pa.Table) -> pa.Table:
        rows = part.to_pylist()
        pair = {}
        for r in rows:
            own = {x["k"]: x["v"] for x in r["doc_slots"]}
            for x in r["item_slots"]:
                pair[r["pos"] - r["at"], r["at"] + x["k"]] = x["v"], own.get(x["k"], x["v"])
        arr = lambda c: np.array([r[c] for r in rows], np.int64)
        zero = np.zeros(len(rows), np.int64)
        best = align(zero, arr("pos"), zero, arr("at"), arr("size"), lambda d, i, g, a, b: [pair[g, k] for k in range(a, b) if (g, k) in pair], np.array([rows[0]["length"]]))
        good = [(s, c) for _, _, s, c in best if s >= coverage]
        return pa.table({"key": pa.array([rows[0]["key"]] * len(good), pa.string()), "item_id": pa.array([rows[0]["item_id"]] * len(good), pa.int64()), "coverage": pa.array([s for s, _ in good], pa.float64()), "changed": pa.array([c for _, c in good], pa.bool_())})

    good = hits.groupBy("key", "item_id", "item").applyInArrow(verify, "key string, item_id long, coverage double, changed boolean")
    listed = F.array_sort(F.collect_list(F.struct(F.col("item_id").isNull().alias("none"), F.coalesce("item_id", F.lit(0)).alias("by"), "coverage", "changed", "item_id")))
    found = good.groupBy(F.col("key").alias(mark)).agg(F.transform(listed, lambda x: F.struct(x["item_id"].alias("item_id"), x["coverage"].alias("coverage"), x["changed"].alias("changed"))).alias("found"))
    return keyed.join(found, mark, "left").select(*[f"`{c}`" for c in source.columns], F.coalesce("found", F.array().cast(FOUND)).alias("found"))

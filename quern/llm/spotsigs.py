"""Document fingerprints by SpotSigs.

A *spot* is an anchor, a very common word, followed by a chain of ``chain`` content words
(words that are no anchors), each ``distance`` content words after the one before.  The
chains of a document form a set of signatures.  Likeness of two documents is the Jaccard
similarity of their sets.  Two sets can only be alike by t if their sizes are within a factor
of t: sets are partitioned by size, and a comparison stops as soon as the signatures left
cannot lift it to the threshold.

A fingerprint is the whole sorted set, packed: its size class (partition), the number of
signatures, and the signatures, so that likeness is exact at any size.  A text without spots
falls back to the chains of all its words, and a text without words has the empty fingerprint.

Defined results: null is the empty text; two empty fingerprints have likeness 1, an empty and
another 0; rows that repeat an id follow each other in the order of their text hashes; the
next document of the last one in descending id order is the first; a null id sorts last; one
row alone is its own next; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tokens import U, hash_slices, join_hash, tokenize

# --- fixed values: very common words (articles, conjunctions, prepositions, pronouns, auxiliaries) of English, French, German and Spanish ---
ANCHORS = (
    "the a an of and to in is it that for on with as was are be by this at from or which have has had not but he she they we you his her its their i "
    "le la les l un une des du de et à au aux en dans que qui est sont pour par sur avec ne pas ce cette il elle ils nous vous se sa son ses ou mais "
    "der die das den dem des ein eine einer einen und oder zu im in ist sind von mit auf für nicht es er sie wir ihr sich als auch an aus bei "
    "el los las un una unos de del y o a al en que es son por para con no se su sus lo como más pero"
)


def anchor_hashes(words: str = ANCHORS) -> np.ndarray:
    t = tokenize(pa.array([words]), lower=True)
    return np.unique(hash_slices(t.buf, t.start, t.end))


_PUNCT = np.zeros(256, bool)
_PUNCT[[i for i in range(33, 127) if not chr(i).isalnum()]] = True


def signatures(col: pa.Array | pa.ChunkedArray, anchors: np.ndarray, chain: int = 2, distance: int = 1) -> tuple[np.ndarray, np.ndarray, int]:
    """(row, hash), distinct and sorted, of the spot signatures of each row; number of rows."""
    t = tokenize(col, lower=True)
    rows = len(t.first) - 1
    if not len(t.start):
        return np.zeros(0, np.int64), np.zeros(0, U), rows
    end, live = t.end.copy(), np.arange(len(t.end))
    while len(live):  # punctuation at the end of a word is not part of it
        live = live[end[live] - t.start[live] > 1]
        live = live[_PUNCT[t.buf[end[live] - 1]]]
        end[live] -= 1
    h = hash_slices(t.buf, t.start, end)
    at = np.minimum(np.searchsorted(anchors, h), len(anchors) - 1)
    anchor = anchors[at] == h
    content = np.flatnonzero(~anchor)
    order = np.cumsum(~anchor)  # content words up to and with each word
    spot = np.flatnonzero(anchor)
    key, ok = h[spot], np.ones(len(spot), bool)
    for c in range(chain):
        k = order[spot] + c * distance
        good = k < len(content)
        w = content[np.minimum(k, max(len(content) - 1, 0))] if len(content) else np.zeros(len(spot), np.int64)
        ok &= good & (t.doc[w] == t.doc[spot]) if len(content) else False
        key = join_hash(key, h[w], 41 + c)
    row, sig = t.doc[spot][ok], key[ok]
    bare = np.ones(rows, bool)
    bare[row] = False
    rest = np.flatnonzero(bare[t.doc])
    if len(rest):  # rows without a spot: chains of all their words
        nxt = np.minimum(rest + 1, len(h) - 1)
        follow = np.where((t.doc[nxt] == t.doc[rest]) & (nxt > rest), h[nxt], U(1))
        row, sig = np.concatenate([row, t.doc[rest]]), np.concatenate([sig, join_hash(h[rest], follow, 51)])
    o = np.lexsort((sig, row))
    row, sig = row[o], sig[o]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (sig[1:] != sig[:-1])]) if len(row) else np.zeros(0, bool)
    return row[new], sig[new], rows


class Prints:
    """Fingerprints of the rows of a column: the whole sorted set of signatures of each row."""

    def __init__(self, col: pa.Array | pa.ChunkedArray, anchors: np.ndarray):
        row, self.sig, rows = signatures(col, anchors)
        self.size = np.bincount(row, minlength=rows)
        self.begin = np.concatenate([[0], np.cumsum(self.size)])

    def of(self, i: int) -> np.ndarray:
        return self.sig[self.begin[i] : self.begin[i + 1]]

    def text(self) -> list[str]:
        """Hexadecimal: size class, size, then the set itself."""
        return [f"{n.bit_length():02x}{n:08x}" + self.of(i).astype(">u8").tobytes().hex() for i, n in enumerate(self.size.tolist())]

    def likeness(self, i: np.ndarray, other: Prints, j: np.ndarray) -> np.ndarray:
        """Jaccard similarity of rows i here and rows j there, over the whole sets; all are asked for, so the threshold is 0."""
        return np.array([pruned_jaccard(self.of(a), other.of(b), 0.0) for a, b in zip(i.tolist(), j.tolist(), strict=True)], float)


def pruned_jaccard(a: np.ndarray, b: np.ndarray, threshold: float) -> float | None:
    """Jaccard similarity of two sorted sets of signatures, or None as soon as it cannot reach the threshold."""
    n, m = len(a), len(b)
    if not n and not m:
        return 1.0
    if min(n, m) < threshold * max(n, m):
        return None
    if not n or not m:
        return 0.0
    step, both = 64 if threshold > 0 else n, 0
    for s in range(0, n, step):
        part = a[s : s + step]
        both += int((b[np.minimum(np.searchsorted(b, part), m - 1)] == part).sum())
        left = n - min(n, s + step)
        most = both + left
        if most < threshold * (n + m - most):
            return None
    return both / (n + m - both)


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edit(text: str, following: str) -> str:
    """The last half (rounded down) gives way to as many code points of the next text."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k] if k else text


def _fingerprinted(ids: list, texts: list[str], anchors: np.ndarray, hold_last: bool) -> pa.Table:
    """Results for each row but the last, whose next one is the row after it."""
    n = len(ids) - hold_last
    edited = [_edit(texts[i], texts[i + 1]) for i in range(n)]
    own = Prints(pa.array(texts, pa.large_string()), anchors)
    changed = Prints(pa.array(edited, pa.large_string()), anchors)
    k = np.arange(n)
    names = own.text()
    return pa.table({
        "doc_id": pa.array(ids[:n], pa.int64()), "n_chars": pa.array([len(x) for x in texts[:n]], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()),
        "fingerprint": pa.array(names[:n], pa.string()), "edited_fingerprint": pa.array(changed.text(), pa.string()),
        "near_edited": pa.array(own.likeness(k, changed, k)), "near_next": pa.array(own.likeness(k, own, k + 1)),
    })


CHUNK_CHARS, CHUNK_ROWS = 1 << 20, 20_000


def _within(anchors: np.ndarray):
    """Rows of a sorted partition whose next row is in it too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        size = 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append(t)
                size += len(t)
                if (size >= CHUNK_CHARS or len(ids) >= CHUNK_ROWS) and len(ids) > 1:
                    yield from _fingerprinted(ids, texts, anchors, True).to_batches()
                    ids, texts, size = ids[-1:], texts[-1:], len(texts[-1])
        if len(ids) > 1:
            yield from _fingerprinted(ids, texts, anchors, True).to_batches()

    return run


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First and last row of a partition that has rows."""
    first = last = None
    part = 0
    for b in batches:
        if b.num_rows:
            row = lambda k: (b.column(0)[k].as_py(), b.column(1)[k].as_py(), b.column(2)[k].as_py())  # noqa: B023, E731
            if first is None:
                first = row(0)
                part = first[2]
            last = row(b.num_rows - 1)
    if first is not None:
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "first_text": pa.array([first[1]], pa.string()), "last_id": pa.array([last[0]], pa.int64()), "last_text": pa.array([last[1]], pa.string())})


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = 12 << 20) -> DataFrame:
    """One row for each row of ``docs``: n_chars, fingerprint, the same of the edited text, and likenesses.

    One range exchange puts the documents in descending order of id; a task then meets each
    document beside the next one.  Only the last row of each partition needs a row of another:
    those meet by partition number, two texts for each partition."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = own.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(1, -(-size // part_bytes))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    placed = own.repartitionByRange(parts, F.col("doc_id").desc_nulls_last()).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    anchors = anchor_hashes()
    inner = placed.select("doc_id", "text").mapInArrow(_within(anchors), RESULT)
    ends = placed.select("doc_id", "text", "part").mapInArrow(_edges, "part int, first_text string, last_id long, last_text string")
    every = Window.partitionBy(F.lit(0))
    line = ends.select("part").select("part", F.coalesce(F.lead("part").over(every.orderBy("part")), F.min("part").over(every)).alias("next"))
    pairs = ends.join(line, "part").select("next", "last_id", "last_text").join(ends.select(F.col("part").alias("next"), "first_text"), "next").select("last_id", "last_text", "first_text")

    def last_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t, f in zip(*(c.to_pylist() for c in b.columns), strict=True):
                yield from _fingerprinted([i, None], [t, f], anchors, True).to_batches()

    return inner.union(pairs.mapInArrow(last_rows, RESULT))

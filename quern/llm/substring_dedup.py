"""Exact substring deduplication by fixed-block anchors.

A passage of ``window`` (50) words that two documents share covers, whole, at least one of
the non-overlapping ``block`` (25) word blocks of either.  So:

1. *index and probe*: each group of documents sends the hashes of its blocks and of every
   rolling 25-word window to hash buckets; a bucket answers, a bit for each hash, which are a
   block somewhere and occur in two documents or more (an anchor hit);
2. *extend*: around each hit, the 50-word windows that hold it are the candidates.  Their
   96-bit hashes, compared whole at every step (two of 1e13 different windows agree with a
   probability of 6e-4), meet in buckets, which find the smallest document that has each; runs of
   windows found elsewhere are the maximal exact repeats;
3. *remove*: a word goes if a window over it also starts in a document with a smaller id.

Windows are judged on the input.  Nothing is pair-wise: a passage in n documents costs at most
one hash for each group of documents.

Defined results: a null or empty text has no words; a null id is kept as it is, neither source
nor target; rows with equal ids are one document's copies and do not remove each other; an
empty table gives an empty result; other columns of the input play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import exchange as x
from .tokens import Tokens, join_hash, join_kept, rolling, tokenize, word_hashes

U = np.uint64
BITS = 48  # of an anchor's hash; a false hit only makes a candidate that the extension rejects
SENT = "bucket int, g int, n long, payload binary"


def _groups_of(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts, and where each run of equal keys starts in it."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    return order, np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)


def _pairs_of(h: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same by both hashes of a window."""
    order = np.lexsort((k, h))
    hh, kk = h[order], k[order]
    return order, np.flatnonzero(np.concatenate([[True], (hh[1:] != hh[:-1]) | (kk[1:] != kk[:-1])])) if len(h) else np.zeros(0, np.int64)


def _slots(h: np.ndarray, k: np.ndarray, mine: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where windows (mine, own) stand among sorted (h, k), and whether they do."""
    slot = np.searchsorted(h, mine)
    last = len(h) - 1
    while True:
        at = np.minimum(slot, last)
        other = (slot <= last) & (h[at] == mine) & (k[at] != own)
        if not other.any():
            return at, (slot <= last) & (h[at] == mine)
        slot[other] += 1


def _several(doc: np.ndarray, order: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """For each run, whether it has two documents or more."""
    d = doc[order]
    return np.minimum.reduceat(d, runs) != np.maximum.reduceat(d, runs) if len(runs) else np.zeros(0, bool)


def _split(values: np.ndarray, bounds: np.ndarray):
    cut = np.searchsorted(values, bounds[1:-1])
    return zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(values)]]), strict=True)


class _Group:
    """The documents of a group that are long enough, and their rolling hashes."""

    def __init__(self, table: pa.Table, window: int, block: int):
        ids = table["doc_id"].combine_chunks() if table.num_rows else pa.array([], pa.int64())
        self.tokens: Tokens = tokenize(table["text"])
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False) if len(ids) else np.zeros(0, np.int64)
        t = self.tokens
        fit = (t.counts >= window) & ~np.asarray(ids.is_null() if len(ids) else np.zeros(0, bool))
        self.wh = word_hashes(t)
        self.block, self.window = block, window
        left = t.first[t.doc + 1] - np.arange(len(t.doc)) if len(t.doc) else np.zeros(0, np.int64)  # words from here to the end of the document
        ok = fit[t.doc] if len(t.doc) else np.zeros(0, bool)
        self.at = np.flatnonzero(ok & (left >= block))  # starts of anchors' windows
        self.left = left
        self.rolled = rolling(self.wh, block)
        self.anchor = self.rolled[self.at] >> U(64 - BITS) if len(self.at) else np.zeros(0, U)
        self.doc = t.doc[self.at] if len(self.at) else np.zeros(0, np.int64)

    def aligned(self) -> np.ndarray:
        return (self.at - self.tokens.first[self.doc]) % self.block == 0

    def candidates(self, hit: np.ndarray) -> np.ndarray:
        """Starts of windows that hold a hit."""
        n = len(self.wh)
        mark = np.zeros(n + 1, np.int32)
        p = self.at[hit]
        lo = np.maximum(p - (self.window - self.block), self.tokens.first[self.doc[hit]])
        np.add.at(mark, lo, 1)
        np.add.at(mark, p + 1, -1)
        return np.flatnonzero((np.cumsum(mark[:-1]) > 0) & (self.left >= self.window))

    def window_hashes(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of the windows at these starts, of 64 and 32 bits."""
        half, rest = self.block, self.window - 2 * self.block
        a, b = self.rolled[at], self.rolled[at + half]
        h, k = join_hash(a, b, 5), join_hash(a, b, 9)
        for i in range(rest):
            w = self.wh[at + 2 * half + i]
            h, k = join_hash(h, w, 5), join_hash(k, w, 9)
        return h, k >> U(32)


def _sender(layout: x.Layout, window: int, block: int):
    bounds = x.bucket_bounds(layout.buckets, BITS)

    def send(table: pa.Table) -> pa.Table:
        g = table["g"][0].as_py()
        own = _Group(table, window, block)
        order, runs = _groups_of(own.anchor)
        h = own.anchor[order][runs] if len(runs) else own.anchor
        several = _several(own.doc, order, runs)
        blocks = np.logical_or.reduceat(own.aligned()[order], runs) if len(runs) else several
        out = []
        for k, (lo, hi) in enumerate(_split(h, bounds)):
            if hi > lo:
                out.append((k, g, int(hi - lo), x.pack_bits(several[lo:hi]) + x.pack_bits(blocks[lo:hi]) + x.pack_sorted(h[lo:hi] - bounds[k])))
        return _rows(out)

    return send


def _rows(out: list[tuple]) -> pa.Table:
    k, g, n, p = zip(*out, strict=True) if out else ((), (), (), ())
    return pa.table({"bucket": pa.array(k, pa.int32()), "g": pa.array(g, pa.int32()), "n": pa.array(n, pa.int64()), "payload": pa.array(p, pa.binary())})


def _answer_anchors(table: pa.Table) -> pa.Table:
    k, gs, ns = table["bucket"][0].as_py(), table["g"].to_pylist(), table["n"].to_pylist()
    hs, sev, blk = [], [], []
    for n, p in zip(ns, table["payload"], strict=True):
        m = memoryview(p.as_buffer())
        a, u = x.unpack_bits(m, n)
        b, v = x.unpack_bits(m[u:], n)
        hs.append(x.unpack_sorted(m[u + v :], n)[0])
        sev.append(a)
        blk.append(b)
    h = np.concatenate(hs)
    order, runs = _groups_of(h)
    size = np.diff(np.concatenate([runs, [len(h)]]))
    found = ((size > 1) | np.logical_or.reduceat(np.concatenate(sev)[order], runs)) & np.logical_or.reduceat(np.concatenate(blk)[order], runs)
    flag = np.empty(len(h), bool)
    flag[order] = np.repeat(found, size)
    cut = np.concatenate([[0], np.cumsum(ns)])
    return _rows([(k, g, n, x.pack_bits(flag[a:b])) for g, n, a, b in zip(gs, ns, cut[:-1], cut[1:], strict=True)])


def _extender(layout: x.Layout, window: int, block: int):
    bounds = x.bucket_bounds(layout.buckets, 64)

    def extend(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows or not answers.num_rows:
            return _rows([])
        g = docs["g"][0].as_py()
        own = _Group(docs, window, block)
        order, runs = _groups_of(own.anchor)
        parts = sorted(zip(answers["bucket"].to_pylist(), answers["n"].to_pylist(), answers["payload"], strict=True), key=lambda r: r[0])
        flag = np.concatenate([x.unpack_bits(memoryview(p.as_buffer()), n)[0] for _, n, p in parts])
        hit = np.zeros(len(own.anchor), bool)
        hit[order] = np.repeat(flag, np.diff(np.concatenate([runs, [len(order)]])))
        at = own.candidates(hit)
        if not len(at):
            return _rows([])
        h, k = own.window_hashes(at)
        order, runs = _pairs_of(h, k)
        h, k = h[order][runs], k[order][runs]
        ids = own.ids[own.tokens.doc[at]]
        least = np.minimum.reduceat(ids[order], runs)
        several = _several(ids, order, runs)
        table, code = np.unique(least, return_inverse=True)
        out = []
        for j, (lo, hi) in enumerate(_split(h, bounds)):
            if hi > lo:
                used, inv = np.unique(code[lo:hi], return_inverse=True)
                body = x.pack_bits(several[lo:hi]) + x.pack_sorted(h[lo:hi] - bounds[j]) + x.planes(k[lo:hi]) + x.planes(inv.astype(U)) + table[used].astype("<i8").tobytes()
                out.append((j, g, int(hi - lo), body))
        return _rows(out)

    return extend


def _answer_windows(table: pa.Table) -> pa.Table:
    """For each group: its windows that occur in two documents or more, and whether a smaller id than the group's own has them."""
    j, gs, ns = table["bucket"][0].as_py(), table["g"].to_pylist(), table["n"].to_pylist()
    hs, ks, least, sev = [], [], [], []
    for n, p in zip(ns, table["payload"], strict=True):
        m = memoryview(p.as_buffer())
        a, u = x.unpack_bits(m, n)
        h, v = x.unpack_sorted(m[u:], n)
        k, w = x.unplanes(m[u + v :], n)
        c, y = x.unplanes(m[u + v + w :], n)
        ids = np.frombuffer(m[u + v + w + y :], "<i8")
        hs.append(h)
        ks.append(k)
        least.append(ids[c.astype(np.int64)])
        sev.append(a)
    h, k, own, several = np.concatenate(hs), np.concatenate(ks), np.concatenate(least), np.concatenate(sev)
    order, runs = _pairs_of(h, k)
    size = np.diff(np.concatenate([runs, [len(h)]]))
    first = np.repeat(np.minimum.reduceat(own[order], runs), size)
    repeated = np.repeat((size > 1) | np.logical_or.reduceat(several[order], runs), size)
    back, smaller = np.empty(len(h), bool), np.empty(len(h), bool)
    back[order], smaller[order] = repeated, first < own[order]
    cut = np.concatenate([[0], np.cumsum(ns)])
    out = []
    for g, a, b in zip(gs, cut[:-1], cut[1:], strict=True):
        sel = back[a:b]
        if sel.any():
            out.append((j, g, int(sel.sum()), x.pack_bits(smaller[a:b][sel]) + x.planes(k[a:b][sel]) + x.pack_sorted(h[a:b][sel])))
    return _rows(out)


def _remover(layout: x.Layout, window: int, block: int):
    bounds = x.bucket_bounds(layout.buckets, 64)

    def remove(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _result([], pa.array([], pa.int64()), [], [], [])
        own = _Group(docs, window, block)
        t, n = own.tokens, docs.num_rows
        gone = np.zeros(len(own.wh), bool)
        if answers.num_rows:
            hs, ks, flags = [], [], []
            for j, m, p in sorted(zip(answers["bucket"].to_pylist(), answers["n"].to_pylist(), answers["payload"], strict=True), key=lambda r: r[0]):
                v = memoryview(p.as_buffer())
                f, u = x.unpack_bits(v, m)
                k, w = x.unplanes(v[u:], m)
                ks.append(k)
                hs.append(x.unpack_sorted(v[u + w :], m)[0] + bounds[j])
                flags.append(f)
            h, k, smaller = np.concatenate(hs), np.concatenate(ks), np.concatenate(flags)
            every = np.flatnonzero((own.left >= window) & _fit(own)[t.doc])
            slot, known = _slots(h, k, *own.window_hashes(every))
            every, slot = every[known], slot[known]
            ids = own.ids[t.doc[every]]
            order, runs = _groups_of(slot)
            least = np.empty(len(slot), np.int64)
            if len(runs):
                least[order] = np.repeat(np.minimum.reduceat(ids[order], runs), np.diff(np.concatenate([runs, [len(order)]])))
            start = every[smaller[slot] | (ids > least)]
            mark = np.zeros(len(own.wh) + 1, np.int32)
            np.add.at(mark, start, 1)
            np.add.at(mark, start + window, -1)
            gone = np.cumsum(mark[:-1]) > 0
        removed = np.bincount(t.doc[gone], minlength=n) if gone.any() else np.zeros(n, np.int64)
        return _result(docs["doc_id"], join_kept(t, ~gone), t.counts, removed, _spans(gone, t, n))

    return remove


def _fit(own: _Group) -> np.ndarray:
    fit = own.tokens.counts >= own.window
    at = np.zeros(len(fit), bool)
    at[own.doc] = True
    return fit & at


def _spans(gone: np.ndarray, t: Tokens, n: int) -> list[list[dict]]:
    """Runs of removed words of each row, as word numbers from 0, end exclusive."""
    out: list[list[dict]] = [[] for _ in range(n)]
    if gone.any():
        edge = np.concatenate([[True], t.doc[1:] != t.doc[:-1]])
        begin = np.flatnonzero(gone & (edge | ~np.concatenate([[False], gone[:-1]])))
        last = np.flatnonzero(gone & np.concatenate([edge[1:] | ~gone[1:], [True]]))
        for b, e in zip(begin.tolist(), last.tolist(), strict=True):
            d = int(t.doc[b])
            f = int(t.first[d])
            out[d].append({"start": b - f, "end": e + 1 - f})
    return out


def _result(ids, text, words, removed, spans) -> pa.Table:
    text = text if isinstance(text, pa.Array) else pa.array(text, pa.large_string())
    return pa.table({"doc_id": ids, "text": text.cast(pa.string()), "n_words": pa.array(words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))})


def remove_repeats(docs: DataFrame, id_col: str | Column = "doc_id", text_col: str | Column = "text", window: int = 50, group_bytes: int = x.GROUP_BYTES, bucket_hashes: int = x.BUCKET_HASHES) -> DataFrame:
    """One row for each row of ``docs``: doc_id, text (kept words joined by one space), n_words,
    n_removed, removed (spans of word numbers)."""
    block = window // 2
    if block < 1:
        raise ValueError("window must be 2 words at least")
    text, ident = (F.col(c) if isinstance(c, str) else c for c in (text_col, id_col))
    own = docs.select(ident.cast("long").alias("doc_id"), text.cast("string").alias("text"))
    layout = x.plan(own, "text", group_bytes, bucket_hashes)
    dealt = own.withColumn("g", x.group_of(F.coalesce(F.col("doc_id"), F.xxhash64("text")), layout))
    by_group = dealt.groupBy("g")
    hits = by_group.applyInArrow(_sender(layout, window, block), SENT).groupBy("bucket").applyInArrow(_answer_anchors, SENT)
    windows = by_group.cogroup(hits.groupBy("g")).applyInArrow(_extender(layout, window, block), SENT)
    found = windows.groupBy("bucket").applyInArrow(_answer_windows, SENT)
    return by_group.cogroup(found.groupBy("g")).applyInArrow(_remover(layout, window, block), "doc_id long, text string, n_words long, n_removed long, removed array<struct<start:int,end:int>>")

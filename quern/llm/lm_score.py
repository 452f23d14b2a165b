"""Language-model scores by logistic mixing of hashed-context bit predictors.

A text is its lower-cased words and one end. A word is coded as its bytes and a space, a byte
as eight bits, the end as the space alone; so the bits' probabilities give every text a
probability.  Five predictors see the coded text before -- the last byte, the last two, three
and five, over the word's edge into the words before, and the word so far -- and look their
context up, hashed with the bit's place in the byte, in tables of 0/1 counts over the training
tokens.  Their stretched probabilities are summed under weights chosen by a gate (how often the
two longest contexts were seen), which are learnt online, batch after batch, without the token
that is being predicted (leave-one-out).  A refinement table, by place in the byte and mixed
probability, maps the mix to what was observed.  The token probability is at last interpolated
with the token's own frequency, at the share that predicts left-out training tokens best.

No context is longer than five bytes or the word so far, so a token's bits fall in two: its
*head*, the first four bytes, whose contexts reach into the four bytes before the last space;
and its *rest*, the bytes from the fifth on, whose contexts lie within the word.  A head with
the bytes before it is one number of eight bytes.  Every distinct head, and the rest of every
distinct word, is coded once; heads and rests have a table and a set of weights each.

All training texts are counted: slices of documents send their distinct words and heads, with
counts, to buckets of their hashes; buckets merge them, count contexts for each once, and score
each once.  Slices then sum over their tokens.  Table sizes are parameters and do not grow;
everything else is dealt over slices and buckets.

Defined results: a null or empty text is the end alone; a null id is in training (its row's
held_out is false); rows that repeat an id are scored alike; an empty table gives an empty
result; without training texts all counts are 0; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as x
from .near_dedup import slices
from .state import cut
from .tokens import Tokens, U, column_bytes, hash_slices, mix, take_bytes, tokenize

#: Bits of the tables of the five contexts.
BITS = (16, 18, 19, 20, 20)
ORDERS = (1, 2, 3, 5, 0)  # bytes seen; 0: the whole word so far
HEAD = 4  # places whose contexts reach over the word's edge
BASES = np.concatenate([[0], np.cumsum([1 << b for b in BITS])])
GATES = 25
INPUTS = len(BITS) + 1
LEVELS = 33
SHARES = np.array([0.0, 0.3, 0.5, 0.7, 0.8, 0.9, 0.95, 0.98, 0.995])
SEGMENT = 1 << 16
SPACE = 32
BATCH = LEARN_BATCH = 8192
PRIOR = 0.1
CODEC = pa.Codec("zstd", compression_level=3)
SEEN = (0.5, 2.5, 20.5, 500.5)


def _squash(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -16, 16)))


class Types:
    """Distinct words, by number of bytes: their bytes in a padded grid, shorter first. Coded from the place ``first`` on."""

    def __init__(self, buf: np.ndarray, begin: np.ndarray, first: int = 0):
        self.size = np.diff(begin)
        self.buf, self.begin, self.first = buf, begin, first

    def take(self, rows: np.ndarray) -> Types:
        return Types(*take_bytes(self.buf, self.begin[rows], self.begin[rows + 1], None), self.first)

    def bits(self, rows: np.ndarray, grid: np.ndarray) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]]:
        return bits_of(grid, self.size[rows], first=self.first)

    def batches(self, batch: int = BATCH, by_size: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, grid of their bytes, each ended by a space)."""
        order = np.argsort(self.size, kind="stable") if by_size else np.argsort(self.size > 48, kind="stable")
        step = 0
        while step < len(order):
            rows = order[step : step + batch]
            width = int(self.size[rows].max()) + 1
            if width > 64 and len(rows) > 1:  # very long words: fewer at a time
                rows = rows[: max(1, batch * 64 // (width * 8))]
                width = int(self.size[rows].max()) + 1
            step += len(rows)
            grid = np.full((len(rows), width), SPACE, np.uint8)
            n = self.size[rows]
            at = np.repeat(np.arange(len(rows)), n)
            col = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            grid[at, col] = self.buf[np.repeat(self.begin[rows], n) + col]
            yield rows, grid


class Heads:
    """Distinct heads: the four bytes before the last space (0: before the text), then the first four of the word and its space, padded by spaces."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        raw = np.ascontiguousarray(keys.astype(">u8")).view(np.uint8).reshape(-1, 2 * HEAD)
        self.before, self.grid = raw[:, :HEAD], raw[:, HEAD:]
        self.size = np.where((self.grid == SPACE).any(1), (self.grid == SPACE).argmax(1), HEAD)

    def take(self, rows: np.ndarray) -> Heads:
        return Heads(self.keys[rows])

    def batches(self, batch: int = BATCH, by_size: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i in range(0, len(self.keys), batch):
            rows = np.arange(i, min(i + batch, len(self.keys)))
            yield rows, self.grid[rows]

    def bits(self, rows: np.ndarray, grid: np.ndarray) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]]:
        before = self.before[rows]
        return bits_of(grid, self.size[rows], np.concatenate([before, np.full((len(rows), 1), SPACE, np.uint8)], 1))


def contexts(grid: np.ndarray, place: int, whole: np.ndarray, before: np.ndarray | None = None) -> list[np.ndarray]:
    """Hashes of the contexts before the byte at ``place``; ``whole`` is that of the word so far. ``before``: the bytes before the word."""
    out = []
    h = np.full(len(grid), 77 + (min(place, 8) << 20), U)
    for k in range(max(ORDERS)):
        if k < place or before is not None:
            byte = grid[:, place - 1 - k] if k < place else before[:, place - 1 - k]
            h = (h + byte.astype(U) + U(1)) * U(0x9E3779B97F4A7C15)
            h ^= h >> U(29)
        if k + 1 in ORDERS:
            out.append(h)
    return [*out, whole]


def bits_of(grid: np.ndarray, size: np.ndarray, before: np.ndarray | None = None, first: int = 0) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]]:
    """(live rows, slots of the five contexts, bit, node) of every bit, from the place ``first`` on, of the words in a grid; ``before``: the bytes before
    each word. ``node``: the bits of the byte so far after a leading 1."""
    live = np.arange(len(grid))
    whole = np.full(len(grid), 99, U)
    for place in range(grid.shape[1]):
        on = size[live] >= place
        if not on.all():
            live, whole = live[on], whole[on]
        if not len(live):
            return
        sub = grid[live]
        byte = sub[:, place].astype(np.int64)
        node = np.ones(len(live), np.int64)
        ctx = contexts(sub, place, whole, None if before is None else before[live]) if place >= first else []
        for k in range(7, -1, -1) if place >= first else ():
            bit = (byte >> k) & 1
            key = node.astype(U) * U(0xD6E8FEB86659FD93)
            yield live, [((c ^ key) * U(0xC2B2AE3D27D4EB4F) >> U(64 - b)).view(np.int64) + base for c, b, base in zip(ctx, BITS, BASES, strict=False)], bit, node
            node = node * 2 + bit
        whole = (whole + byte.astype(U) + U(1)) * U(0x9E3779B97F4A7C15)
        whole ^= whole >> U(29)


def count_contexts(types: Types | Heads, count: np.ndarray) -> np.ndarray:
    """Counts of 0 and 1 in every slot, over the words with their counts."""
    table = np.zeros((2, BASES[-1]), np.float32)
    flat, width = table.reshape(-1), int(BASES[-1])
    for rows, grid in types.batches():
        c = count[rows]
        some = c > 0
        if not some.any():
            continue
        rows, grid, c = rows[some], grid[some], c[some].astype(np.float32)
        for live, slot, bit, _ in types.bits(rows, grid):
            at, w = bit * width, c[live]
            for s in slot:
                np.add.at(flat, s + at, w)
    return table


class Mixer:
    """Weights by gate, and sums of the refinement table."""

    def __init__(self):
        self.weight = np.full((GATES, INPUTS), 0.3)
        self.weight[:, -1] = 0
        self.seen = np.zeros((2, 256, LEVELS))
        self.share = 0.0

    @staticmethod
    def _level(z: np.ndarray) -> np.ndarray:
        return np.clip(np.rint(z * 2) + LEVELS // 2, 0, LEVELS - 1).astype(np.int64)

    def refined(self) -> np.ndarray:
        """Share of a 1 by node and level, drawn towards the level itself where little was seen."""
        middle = _squash((np.arange(LEVELS) - LEVELS // 2) / 2)
        return (self.seen[1] + 30 * middle) / (self.seen[0] + self.seen[1] + 30)

    @staticmethod
    def _left_out(table: np.ndarray, slot: list[np.ndarray], bit: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Stretched predictions and gates of the bits, each without its own token."""
        one = bit.astype(np.float32)
        zero, inputs, gate = 1 - one, [], np.zeros(len(bit), np.int64)
        for k, s in enumerate(slot):
            n1 = np.maximum(table[1][s] - one, 0)
            n0 = np.maximum(table[0][s] - zero, 0)
            inputs.append(np.log((n1 + np.float32(PRIOR)) / (n0 + np.float32(PRIOR))))
            if k >= len(slot) - 2:
                n0 += n1
                gate *= 5
                for e in SEEN:
                    gate += n0 >= e
        return inputs, gate

    def learn(self, table: np.ndarray, types: Types | Heads, count: np.ndarray, _total: float = 0.0, rate: float = 0.15) -> None:
        """One online pass over all training words, in random order, each predicted without one of its tokens."""
        squares = np.full(self.weight.shape, 1e-3)
        drawn = np.random.default_rng(5).permutation(np.flatnonzero(count > 0))
        some, c = types.take(drawn), count[drawn].astype(float)
        for rows, grid in some.batches(LEARN_BATCH, False):
            say = np.minimum(c[rows], 50.0)  # many tokens of one word teach less than as many of several
            for live, slot, bit, node in some.bits(rows, grid):
                inputs, gate = self._left_out(table, slot, bit)
                z = self.weight[:, -1][gate]
                for k, v in enumerate(inputs):
                    z += self.weight[:, k][gate] * v
                p, level = _squash(z), self._level(z)
                v = say[live]
                err = (bit - p) * v
                step = np.stack([np.bincount(gate, weights=err * k, minlength=GATES) for k in [*inputs, 1.0]], 1)
                step /= np.maximum(np.bincount(gate, weights=v, minlength=GATES), 1)[:, None]
                squares += step * step
                self.weight += rate * step / np.sqrt(squares)
                self.seen += np.bincount((bit * 256 + node) * LEVELS + level, weights=v, minlength=self.seen.size).reshape(self.seen.shape)

    def score(self, table: np.ndarray, types: Types | Heads, count: np.ndarray, total: float, left: np.ndarray | None = None) -> np.ndarray:
        """log10 probability of each word. ``left`` gets what it is for training words where one of their tokens is not counted."""
        stretch = np.log((table[1] + PRIOR) / (table[0] + PRIOR)).astype(np.float32)
        often = np.digitize(table[0] + table[1], SEEN).astype(np.uint8)
        refined = self.refined().reshape(-1).astype(np.float32)
        weight = np.ascontiguousarray(self.weight.T.astype(np.float32))

        def said(inputs: Iterable[np.ndarray], gate: np.ndarray, bit: np.ndarray, node: np.ndarray) -> np.ndarray:
            z = weight[-1][gate]
            for k, v in enumerate(inputs):
                z += weight[k][gate] * v
            q = np.float32(0.5) * _squash(z) + np.float32(0.5) * refined[node * LEVELS + self._level(z)]
            return np.log(np.where(bit == 1, q, 1 - q))

        out = np.zeros(len(types.size))
        for rows, grid in types.batches():
            logp, less = np.zeros(len(rows)), np.zeros(len(rows))
            known = count[rows] > 0
            for live, slot, bit, node in types.bits(rows, grid):
                logp[live] += said((stretch[s] for s in slot), often[slot[-2]].astype(np.int64) * 5 + often[slot[-1]], bit, node)
                if left is not None:
                    on = known[live]
                    if not on.all():
                        live, slot, bit, node = live[on], [s[on] for s in slot], bit[on], node[on]
                    less[live] += said(*self._left_out(table, slot, bit), bit, node)
            out[rows] = logp / np.log(10)
            if left is not None:
                left[rows] = less / np.log(10)
        return interpolated(out, count / total, self.share) if total and self.share else out


def interpolated(score: np.ndarray, own: np.ndarray, share: float) -> np.ndarray:
    """log10 of the probabilities (given as log10) mixed with the tokens' own frequencies."""
    if not share:
        return score
    p = (1 - share) * np.exp(score * np.log(10)) + share * own
    tiny = p < 1e-290  # of very long words
    out = np.log(np.where(tiny, 1, p)) / np.log(10)
    out[tiny] = score[tiny] + np.log10(1 - share)
    return out


def _zip(*parts: bytes) -> bytes:
    raw = bytes([len(parts)]) + np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(parts)
    return len(raw).to_bytes(8, "little") + CODEC.compress(raw, asbytes=True)


def _unzip(data: bytes) -> list[memoryview]:
    raw = memoryview(CODEC.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True))
    k = raw[0]
    sizes = np.frombuffer(raw[1 : 1 + 8 * k], np.int64)
    ends = np.cumsum(sizes) + 1 + 8 * k
    return [raw[e - n : e] for e, n in zip(ends, sizes, strict=True)]


# --- slices: tokens, their distinct words and heads ---
class Slice:
    """Tokens of some texts, the ends last; the distinct words and heads, in the order of the buckets that ``bounds`` divides."""

    def __init__(self, text: pa.Array | pa.ChunkedArray, bounds: tuple[np.ndarray, np.ndarray]):
        tok = tokenize(text, lower=True)
        n = len(tok.first) - 1
        self.buf = tok.buf
        self.doc = np.concatenate([tok.doc, np.arange(n)])
        self.start = np.concatenate([tok.start, np.zeros(n, np.int64)])
        self.end = np.concatenate([tok.end, np.zeros(n, np.int64)])
        self.tokens = np.diff(tok.first) + 1
        self.coded = np.bincount(self.doc, weights=self.end - self.start + 1, minlength=n).astype(np.int64)
        h = np.concatenate([hash_slices(tok.buf, tok.start, tok.end), hash_slices(tok.buf[:0], np.zeros(n, np.int64), np.zeros(n, np.int64))])
        self.words, self.word, self.sample = _distinct(h)
        self.word_cuts = np.concatenate([[0], np.searchsorted(self.words, bounds[0][1:-1]), [len(self.words)]])
        keys, code, _ = _distinct(_heads(tok))
        bucket = np.searchsorted(bounds[1][1:-1], mix(keys), "right")
        order = np.argsort(bucket, kind="stable")
        self.heads, self.head_cuts = keys[order], np.searchsorted(bucket[order], np.arange(len(bounds[1])))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.head = place[code]


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct numbers, sorted; which of them each number is; and a place of each."""
    out, code = np.unique(h, return_inverse=True)
    place = np.empty(len(out), np.int64)
    place[code] = np.arange(len(h))
    return out, code, place


def _heads(tok: Tokens) -> np.ndarray:
    """The heads of all words, then of the ends, as numbers."""
    n, size, low = len(tok.first) - 1, np.minimum(tok.end - tok.start, HEAD).astype(U), U(0xFFFFFFFF)
    padded = np.concatenate([tok.buf, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(tok.buf) + 1,), ">u8", padded, strides=(1,))
    bits = size * U(8)
    begins = (eight[tok.start].astype(U) >> U(32)) >> (U(32) - bits)  # the first four bytes, or all
    head = (begins << (U(32) - bits)) | (U(0x20202020) & (low >> bits))
    ends = np.where(size < HEAD, begins, eight[np.maximum(tok.end - HEAD, 0)].astype(U) >> U(32))  # the last four, or all
    later = np.ones(len(size), bool)
    later[tok.first[:-1][np.diff(tok.first) > 0]] = False
    short = np.flatnonzero((size < HEAD) & later)  # the space before them, and what is before that
    gap = U(SPACE) << bits[short]
    ends[short] |= gap
    ends[short] |= (ends[short - 1] << (bits[short] + U(8))) & low
    before = np.zeros(len(size) + n, U)
    before[1 : len(size)] = ends[:-1]
    before[: len(size)][~later] = 0
    some = np.flatnonzero(np.diff(tok.first) > 0)
    before[len(size) + some] = ends[tok.first[1:][some] - 1]
    return before << U(32) | np.concatenate([head, np.full(n, 0x20202020, U)])


def _slice(t: pa.Table, g: int, bounds: tuple[np.ndarray, np.ndarray]) -> list[tuple]:
    """The slice's texts, as one row, and its words and heads with their counts in training for each bucket."""
    own = Slice(t["text"], bounds)
    held = t["held_out"].to_numpy(zero_copy_only=False).astype(bool)
    learnt = ~held[own.doc]
    ids = t["doc_id"].combine_chunks()
    raw, off = column_bytes(t["text"])
    body = _zip(ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes(), np.asarray(ids.is_null()).tobytes(), held.tobytes(), off.astype("<i8").tobytes(), raw.tobytes())
    out = [(-1, g, t.num_rows, body)]
    start, end = own.start[own.sample], own.end[own.sample]
    count = np.bincount(own.word, weights=learnt, minlength=len(own.words)).astype(U)
    for k, (lo, hi) in enumerate(zip(own.word_cuts[:-1], own.word_cuts[1:], strict=True)):
        if hi > lo:
            raw, _ = take_bytes(own.buf, start[lo:hi], end[lo:hi], None)
            out.append((k, g, int(hi - lo), _zip(x.pack_sorted(own.words[lo:hi] - bounds[0][k]), x.planes(count[lo:hi]), x.planes((end - start)[lo:hi].astype(U)), raw.tobytes())))
    count = np.bincount(own.head, weights=learnt, minlength=len(own.heads)).astype(U)
    for k, (lo, hi) in enumerate(zip(own.head_cuts[:-1], own.head_cuts[1:], strict=True), len(bounds[0]) - 1):
        if hi > lo:
            out.append((k, g, int(hi - lo), _zip(x.pack_sorted(own.heads[lo:hi]), x.planes(count[lo:hi]))))
    return out


ROWS = "bucket int, g long, n long, payload binary"


def _table(rows: list[tuple]) -> pa.Table:
    b, g, n, p = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.table({"bucket": pa.array(b, pa.int32()), "g": pa.array(g, pa.int64()), "n": pa.array(n, pa.int64()), "payload": pa.array(p, pa.binary())})


def _bounds(buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the buckets of words, and of the heads' (twice as many, numbered after them)."""
    return x.bucket_bounds(buckets, 64), x.bucket_bounds(2 * buckets, 64)


def _slicer(buckets: int, slice_bytes: int):
    bounds = _bounds(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = k = 0
        part = 0

        def flush():
            nonlocal held, size, k
            t = pa.concat_tables(held).combine_chunks()
            rows = _slice(t, (part << 24) + k, bounds)
            held, size, k = [], 0, k + 1
            return _table(rows).to_batches()

        for t in slices(batches, "text", slice_bytes):
            part = t["part"][0].as_py()
            held.append(t)
            size += t["text"].nbytes
            if size >= slice_bytes:
                yield from flush()
        if held:
            yield from flush()

    return run


# --- buckets ---
def _merger(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        """One row for the bucket: its distinct words or heads with counts, and where each slice's are among them; and rows of context counts."""
        k, gs, ns = table["bucket"][0].as_py(), table["g"].to_numpy(), table["n"].to_numpy()
        hs, cs, sizes, raws = [], [], [], []
        for n, p in zip(ns.tolist(), table["payload"], strict=True):
            a, b, *of_words = _unzip(p.as_py())
            hs.append(x.unpack_sorted(a, n)[0])
            cs.append(x.unplanes(b, n)[0])
            if of_words:
                sizes.append(x.unplanes(of_words[0], n)[0].astype(np.int64))
                raws.append(np.frombuffer(of_words[1], np.uint8))
        things, code, first = _distinct(np.concatenate(hs))
        count = np.bincount(code, weights=np.concatenate(cs), minlength=len(things)).astype(np.int64)
        if k < buckets:
            raw, begin = np.concatenate(raws), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            types = Types(*take_bytes(raw, begin[first], begin[first + 1], None), HEAD)
            what = x.planes(types.size.astype(U)), types.buf.tobytes()
        else:
            types = Heads(things)
            what = x.pack_sorted(things), b""
        cuts = np.concatenate([[0], np.cumsum(ns)])
        maps = [x.pack_sorted(code[a:b].astype(U)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        body = _zip(x.planes(count.astype(U)), *what, gs.astype("<i8").tobytes(), ns.astype("<i8").tobytes(), np.array([len(m) for m in maps], np.int64).tobytes(), b"".join(maps))
        counts = count_contexts(types, count)
        return _table([(-1, k, len(things), body), *_segments(np.concatenate([counts.reshape(-1), [count.sum(), (count > 0).sum()]]), k)])

    return run


def _segments(values: np.ndarray, g: int) -> list[tuple]:
    """A long array as rows: (segment, g, length, numbers)."""
    out = []
    for i in range(0, len(values), SEGMENT):
        v = values[i : i + SEGMENT]
        if v.any():
            out.append((i // SEGMENT, g, len(v), _zip(np.asarray(v, "<f8" if i + SEGMENT >= len(values) else "<f4").tobytes())))
    return out


def _add(table: pa.Table) -> pa.Table:
    total, last = None, False
    for n, p in zip(table["n"].to_pylist(), table["payload"], strict=True):
        raw = _unzip(p.as_py())[0]
        last = len(raw) == 8 * n
        v = np.frombuffer(raw, "<f8" if last else "<f4").astype(float)
        total = v if total is None else total + v
    return _table([(table["bucket"][0].as_py(), table["g"][0].as_py() // 32, len(total), _zip(total.astype("<f8" if last else "<f4").tobytes()))])


def _summed(rows: DataFrame, senders: int, length: int) -> np.ndarray:
    """The sum of the arrays of all senders, added up 32 at a time; its length is fixed."""
    while senders > 1:
        rows = rows.groupBy("bucket", F.expr("g div 32")).applyInArrow(_add, ROWS)
        senders = -(-senders // 32)
    out = np.zeros(length)
    for r in rows.toArrow().to_pylist():
        raw = _unzip(r["payload"])[0]
        v = np.frombuffer(raw, "<f8" if len(raw) == 8 * r["n"] else "<f4")
        out[r["bucket"] * SEGMENT : r["bucket"] * SEGMENT + len(v)] += v
    return out


def _opened(payload: bytes, n: int, heads: bool) -> tuple[Types | Heads, np.ndarray, np.ndarray, np.ndarray, list[memoryview]]:
    a, b, c, d, e, f, m = _unzip(payload)
    count = x.unplanes(a, n)[0].astype(np.int64)
    types = Heads(x.unpack_sorted(b, n)[0]) if heads else Types(np.frombuffer(c, np.uint8), np.concatenate([[0], np.cumsum(x.unplanes(b, n)[0].astype(np.int64))]), HEAD)
    ends = np.cumsum(np.frombuffer(f, np.int64))
    maps = [m[end - k : end] for end, k in zip(ends.tolist(), np.frombuffer(f, np.int64).tolist(), strict=True)]
    return types, count, np.frombuffer(d, "<i8"), np.frombuffer(e, "<i8"), maps


def _learner(held, heads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                types, count, *_ = _opened(r["payload"], r["n"], heads)
                m = Mixer()
                m.learn(held.value, types, count)
                mass = float(count.sum() if heads else count[types.size >= HEAD].sum())
                yield from _table(_segments(np.concatenate([(m.weight * mass).reshape(-1), m.seen.reshape(-1), [mass]]), r["g"])).to_batches()

    return run


def _learnt(words: DataFrame, held, heads: bool, senders: int) -> Mixer:
    """The buckets' mixers in one: weights in proportion to the tokens."""
    mixer = Mixer()
    got = _summed(words.mapInArrow(_learner(held, heads), ROWS), senders, mixer.weight.size + mixer.seen.size + 1)
    if got[-1]:
        mixer.weight = got[: mixer.weight.size].reshape(mixer.weight.shape) / got[-1]
        mixer.seen = got[mixer.weight.size : -1].reshape(mixer.seen.shape)
    return mixer


LEFT = 32  # steps of the left-out scores in one of log10


def _answerer(held, mixer: Mixer, heads: bool):
    """To each slice: counts and scores of its words (or heads), and how much less they are where a token is left out (in steps; only the share is chosen by it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                types, count, gs, ns, maps = _opened(r["payload"], r["n"], heads)
                left = np.zeros(len(count))
                score = mixer.score(held.value, types, count, 0.0, left)
                less = np.where(count > 0, score - left, 0)
                less = np.clip(np.rint(less * LEFT), 0, 255).astype(U)
                score = score.astype("<f4").view("<u4").astype(U)
                for g, n, m in zip(gs.tolist(), ns.tolist(), maps, strict=True):
                    at = x.unpack_sorted(m, n)[0].astype(np.int64)
                    yield from _table([(r["g"], g, n, _zip(x.planes(score[at]), x.planes(less[at]), *([] if heads else [x.planes(count[at].astype(U))])))]).to_batches()

    return run


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, coded long, scores array<double>, gains array<double>"


def _scorer(total: int, kinds: int, buckets: int):
    """Rows with a score for each of SHARES; a slice's first row has the log-likelihoods of its left-out training tokens."""
    bounds = _bounds(buckets)

    def numbers(parts: list[list[memoryview]], sizes: list[int], k: int) -> np.ndarray:
        return np.concatenate([x.unplanes(p[k], n)[0] for p, n in zip(parts, sizes, strict=True)])

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        rows = sorted(zip(answers["bucket"].to_pylist(), answers["n"].to_pylist(), answers["payload"], strict=True), key=lambda r: r[0])
        for n, p in zip(docs["n"].to_pylist(), docs["payload"], strict=True):
            ids, null, held, off, raw = _unzip(p.as_py())
            own = Slice(pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(off), pa.py_buffer(raw)]), bounds)
            held = np.frombuffer(held, bool)
            score, less, count = np.zeros(len(own.doc)), np.zeros(len(own.doc)), None
            for heads, token in ((False, own.word), (True, own.head)):
                mine = [(m, _unzip(a.as_py())) for k, m, a in rows if (k >= buckets) == heads]
                sizes, parts = [m for m, _ in mine], [a for _, a in mine]
                score += numbers(parts, sizes, 0).astype("<u4").view("<f4").astype(float)[token]
                less += numbers(parts, sizes, 1)[token] / LEFT
                if not heads:
                    count = numbers(parts, sizes, 2).astype(np.int64)[token]
            add = lambda v: np.bincount(own.doc, weights=v, minlength=n)
            learnt = ~held[own.doc]
            left, others = 10 ** (score - less)[learnt], (count[learnt] - 1) / max(total - 1, 1)
            scores, gains = np.zeros((n, len(SHARES))), np.zeros(len(SHARES))
            for i, s in enumerate(SHARES):
                scores[:, i] = add(interpolated(score, count / max(total, 1), s))
                gains[i] = np.log(np.maximum((1 - s) * left + s * others, 1e-280)).sum()
            out.append({
                "doc_id": pa.array(np.frombuffer(ids, "<i8"), mask=np.frombuffer(null, bool)),
                "held_out": pa.array(held),
                "n_tokens": pa.array(own.tokens),
                "n_known": pa.array(add(count > 0).astype(np.int64)),
                "train_tokens": pa.array(np.full(n, total)),
                "base_score": pa.array(add(np.log10((count + 1) / (total + kinds + 1)))),
                "coded": pa.array(own.coded),
                "scores": pa.array(list(scores), pa.list_(pa.float64())),
                "gains": pa.array([gains, *[None] * (n - 1)], pa.list_(pa.float64())),
            })
        schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("coded", pa.int64()), ("scores", pa.list_(pa.float64())), ("gains", pa.list_(pa.float64()))])
        return pa.concat_tables([pa.table(t, schema) for t in out]) if out else schema.empty_table()

    return run


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2, slice_bytes: int = 8 << 20, bucket_hashes: int = x.BUCKET_HASHES // 2) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    bits_per_byte (of the coded text: its words, a byte after each, and the end)."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    own = own.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held_fold, F.lit(False))).withColumn("part", F.spark_partition_id())
    layout = x.plan(own, "text", bucket_hashes=bucket_hashes, bytes_a_hash=45.0)
    buckets = layout.buckets
    sliced = cut(own.mapInArrow(_slicer(buckets, slice_bytes), ROWS))
    merged = cut(sliced.where("bucket >= 0").groupBy("bucket").applyInArrow(_merger(buckets), ROWS))
    total = kinds = 0
    answers = []
    for heads in (False, True):
        mine, senders = merged.where(f"g >= {buckets}" if heads else f"g < {buckets}"), buckets * (1 + heads)
        counts = mine.where("bucket >= 0").withColumn("g", F.col("g") - heads * buckets)
        sums = _summed(counts, senders, 2 * int(BASES[-1]) + 2)
        if not heads:
            total, kinds = round(sums[-2]), round(sums[-1])
        held = spark.sparkContext.broadcast(sums[:-2].reshape(2, -1).astype(np.float32))
        words = mine.where("bucket < 0")
        mixer = _learnt(words.withColumn("g", F.col("g") - heads * buckets), held, heads, senders) if total else Mixer()
        answers.append(words.mapInArrow(_answerer(held, mixer, heads), ROWS))
    scored = cut(sliced.where("bucket < 0").groupBy("g").cogroup(answers[0].union(answers[1]).groupBy("g")).applyInArrow(_scorer(total, kinds, buckets), SCORED))
    gains = scored.agg(*[F.sum(F.col("gains")[i]) for i in range(len(SHARES))]).first()
    score = F.col("scores")[max(range(len(SHARES)), key=lambda i: gains[i] or 0.0)]
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", score.alias("score"), (-score / float(np.log10(2)) / F.col("coded")).alias("bits_per_byte"))

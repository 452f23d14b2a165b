"""Secret scan: fixed patterns, and a linear-chain conditional random field for the rest.

The patterns (assignments to secret-like names, access key ids, long hexadecimal runs) give
the base spans.  The field tags every word as beginning, inside or outside of a secret, from
its shape, the words and shapes around it and features of the whole file (its length, how
unlike prose it is, its share of assignments, how many long mixed words it has).  It is trained
by conditional likelihood (forward-backward, adaptive gradient steps) on the base spans of a
bounded sample, ``train_docs`` documents, and decoded by Viterbi; spans it tags that touch no
base span are added with the kind ``field``.  So that it learns more than the patterns say, each
stretch with a span is seen four times more: without the words (what is left is shape); without
the words and the alphabet of a value that has a name before it; without the shape of such a
value (what is left is context); and, as no span, without the words and with a plain word or
number for the value.

Words that look like prose -- no digit, none of the characters of assignments, not long -- and
stand ``REACH`` words or more from one that doesn't are outside by definition, in training and in
decoding; the stretches between them begin and end beside the outside tag.

Spans are in code points, end exclusive.  Defined results: a null or empty text has no spans;
rows that repeat an id are scanned alone; very long texts are scanned whole; without a base
span in the sample the field adds nothing; columns pass through, save those named as results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from .near_dedup import slices
from .tokens import LOWER, Tokens, hash_slices, tokenize

U = np.uint64
# --- fixed values: the base patterns ---
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "field")
_STARTS = (b"passw", b"secret", b"token", b"apikey", b"api_key")

REACH = 3
OUT, BEGIN, INSIDE = 0, 1, 2


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind that are long enough."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # runs of hexadecimal digits do not touch each other, so the long ones can be matched at once
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return ordered(found)


def ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def _class(chars: str | bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[c if isinstance(c, int) else ord(c) for c in chars]] = True
    return out


_DIGIT, _UPPER, _LOWERCASE = _class("0123456789"), _class(bytes(range(65, 91))), _class(bytes(range(97, 123)))
_MARK = _class("=:_+/\"'@\\")
_HEXD = _class("0123456789abcdef")
_ASCII_PUNCT = _class(bytes(i for i in range(33, 127) if not chr(i).isalnum()))
_QUOTE = _class("\"'")
_AT = _class("@")
WORDS = 1 << 10
#: Number of values of each feature.
WIDTHS = (8, 32, 8, WORDS, 32, 32, WORDS, WORDS, WORDS, 16, 4, 12)
#: Features that name words, and those that show the shape which the patterns ask for.
WORD_FEATURES, SHAPE_FEATURES = (3, 6, 7, 8), (1, 2)
#: Length class, characters and kind of plain words and numbers, bare and in quotes.
PLAIN = ((1, 1, 4), (2, 1, 4), (1, 9, 0), (2, 9, 0), (2, 4, 0), (2, 6, 0), (2, 12, 0), (2, 14, 0), (3, 4, 0), (3, 12, 0), (1, 17, 0), (2, 17, 0))


def candidates(t: Tokens) -> np.ndarray:
    """Rows that may have a base span: a superset, from byte searches over all texts at once."""
    rows = len(t.first) - 1
    hit = np.zeros(rows, bool)
    if not len(t.buf):
        return hit
    where: list[int] = []
    low, raw = LOWER[t.buf].tobytes(), t.buf.tobytes()
    for data, needles in ((low, _STARTS), (raw, (b"AKIA",))):
        for needle in needles:
            at = data.find(needle)
            while at >= 0:
                where.append(at)
                at = data.find(needle, at + 1)
    # runs end with their word, so that the end of one text and the start of the next do not join
    edge = np.zeros(len(t.buf) + 1, bool)
    edge[t.start] = edge[t.end] = True
    h = np.concatenate([[False], _HEXD[t.buf], [False]])
    begin = np.flatnonzero(h[1:-1] & (~h[:-2] | edge[:-1]))
    end = np.flatnonzero(h[1:-1] & (~h[2:] | edge[1:])) + 1
    runs = begin[end - begin >= 24]
    at = np.concatenate([np.array(where, np.int64), runs])
    if len(at):
        word = np.searchsorted(t.start, at, side="right") - 1
        hit[t.doc[np.clip(word, 0, len(t.doc) - 1)]] = True
    return hit


class Features:
    """Features of words near one that does not look like prose."""

    def __init__(self, t: Tokens):
        self.tokens = t
        n = len(t.start)
        size = t.end - t.start

        def count(cls: np.ndarray) -> np.ndarray:
            c = np.concatenate([[0], np.cumsum(cls[t.buf], dtype=np.int32)])
            return c[t.end] - c[t.start]

        digits, marks, uppers, lowers = count(_DIGIT), count(_MARK), count(_UPPER), count(_LOWERCASE)
        odd = (digits > 0) | (marks > 0) | (size >= 32)
        self.odd = odd
        near = odd.copy()
        for k in range(1, REACH):
            near[k:] |= odd[:-k] & (t.doc[k:] == t.doc[:-k])
            near[:-k] |= odd[k:] & (t.doc[k:] == t.doc[:-k])
        self.at = np.flatnonzero(near)
        other = size - digits - uppers - lowers - marks
        mask = (digits > 0) + 2 * (uppers > 0) + 4 * (lowers > 0) + 8 * (marks > 0) + 16 * (other > 0)
        at = self.at
        a, b = t.start[at], t.end[at].copy()
        begin = a.copy()
        for where, step, edge in ((begin, 1, 0), (b, -1, -1)):
            live = np.arange(len(at))
            while len(live):
                live = live[b[live] - begin[live] > 1]
                live = live[_ASCII_PUNCT[t.buf[where[live] + edge]]]
                where[live] += step
        low = LOWER[t.buf]
        word = (hash_slices(low, begin, b) % U(WORDS - 2)).astype(np.int64) + 2 if len(at) else np.zeros(0, np.int64)
        all_words = np.zeros(n, np.int64)
        all_words[at] = word
        hexed = count(_HEXD)
        long = np.digitize(size, [2, 4, 8, 12, 20, 32, 64])
        rows = len(t.first) - 1
        odd_share = np.bincount(t.doc, weights=odd, minlength=rows) / np.maximum(t.counts, 1)
        file = np.digitize(t.counts, [20, 200, 2000]) * 4 + np.digitize(odd_share, [0.01, 0.1, 0.4])
        last = t.buf[t.end - 1] if n else t.buf
        sets = np.bincount(t.doc, weights=(last == ord("=")) | (last == ord(":")), minlength=rows) / np.maximum(t.counts, 1)
        mixed = np.bincount(t.doc, weights=(size >= 20) & (digits > 0) & (lowers + uppers > 0), minlength=rows)
        file2 = np.digitize(sets, [0.001, 0.02, 0.1]) * 3 + np.digitize(mixed, [1, 2])

        def beside(x: np.ndarray, step: int, none: int) -> np.ndarray:
            k = at + step
            good = (k >= 0) & (k < n)
            k = np.clip(k, 0, max(n - 1, 0))
            return np.where(good & (t.doc[k] == t.doc[at]), x[k], none)

        kind = (size[at] >= 16) * ((hexed[at] * 10 >= size[at] * 8) + 2 * ((digits[at] > 0) & (lowers[at] + uppers[at] > 0))) + 4 * (digits[at] == size[at])
        kind = np.where(count(_AT)[at] > 0, 5, kind)
        quote = _QUOTE[t.buf[a]] + 2 * _QUOTE[t.buf[t.end[at] - 1]] if len(at) else np.zeros(0, np.int64)
        self.x = np.stack([long[at], mask[at], kind, word, beside(mask, -1, 0), beside(mask, 1, 0), beside(all_words, -1, 1), beside(all_words, 1, 1), beside(all_words, -2, 1), file[t.doc[at]], quote, file2[t.doc[at]]], 1).astype(np.int64) if len(at) else np.zeros((0, len(WIDTHS)), np.int64)
        # stretches of neighbouring words of one document
        new = np.concatenate([[True], (np.diff(at) > 1) | (t.doc[at][1:] != t.doc[at][:-1])]) if len(at) else np.zeros(0, bool)
        self.stretch = np.flatnonzero(new)


class Field:
    """Weights of a linear-chain conditional random field over OUT, BEGIN, INSIDE."""

    def __init__(self):
        self.emit = np.zeros((sum(WIDTHS), 3))
        self.move = np.zeros((3, 3))
        self.offset = np.concatenate([[0], np.cumsum(WIDTHS)[:-1]])

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), 3))
        for k in range(x.shape[1]):
            out += self.emit[x[:, k] + self.offset[k]]
        return out

    @property
    def steps(self) -> np.ndarray:
        """Scores of moves; inside never follows outside."""
        m = self.move.copy()
        m[OUT, INSIDE] = -1e9
        return m

    def _grid(self, stretch: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = np.diff(np.concatenate([stretch, [n]]))
        o = np.argsort(-size, kind="stable")
        return stretch[o], size[o], np.searchsorted(-size[o], -np.arange(int(size.max()) if len(size) else 0), side="left")

    def viterbi(self, x: np.ndarray, stretch: np.ndarray) -> np.ndarray:
        n = len(x)
        tags = np.zeros(n, np.int8)
        if not n:
            return tags
        e, m = self.scores(x), self.steps
        begin, size, active = self._grid(stretch, n)
        back = np.zeros((n, 3), np.int8)
        best = e[begin] + m[OUT]
        final = np.zeros((len(begin), 3))
        for k in range(1, len(active) + 1):
            live = int(active[k]) if k < len(active) else 0
            final[live : len(best)] = best[live:]
            if not live:
                break
            w = best[:live, :, None] + m[None]
            back[begin[:live] + k] = w.argmax(axis=1)
            best = w.max(axis=1) + e[begin[:live] + k]
        end = (final + m[:, OUT]).argmax(axis=1).astype(np.int8)
        tag = end
        for k in range(len(active) - 1, -1, -1):
            live = int(active[k])
            last = size[:live] - 1 == k
            tag[:live] = np.where(last, end[:live], tag[:live])
            tags[begin[:live] + k] = tag[:live]
            if k:
                tag[:live] = back[begin[:live] + k, tag[:live]]
        return tags

    def fit(self, x: np.ndarray, stretch: np.ndarray, y: np.ndarray, hidden: np.ndarray | None = None, rounds: int = 60, rate: float = 0.25, l2: float = 1e-3) -> None:
        """``hidden``: features (rows x kinds) that are not to be seen."""
        n = len(x)
        if not n or not (y > 0).any():
            return
        begin, size, active = self._grid(stretch, n)
        none = len(self.emit)  # a feature without weight
        cols = x + self.offset if hidden is None else np.where(hidden, none, x + self.offset)
        sq, sm = np.full(self.emit.shape, 1e-8), np.full((3, 3), 1e-8)
        hot = np.eye(3)[y]
        ends = begin + size - 1
        seen = np.zeros((3, 3))
        inner = np.ones(n, bool)
        inner[begin] = False
        np.add.at(seen, (y[np.flatnonzero(inner) - 1], y[inner]), 1)
        np.add.at(seen, (np.zeros(len(begin), int), y[begin]), 1)
        np.add.at(seen, (y[ends], np.zeros(len(ends), int)), 1)
        for _ in range(rounds):
            held = np.vstack([self.emit, np.zeros(3)])
            e, m = sum(held[cols[:, k]] for k in range(cols.shape[1])), self.steps
            em = np.exp(m)
            pe = np.exp(e - e.max(axis=1, keepdims=True))
            f, b = np.zeros((n, 3)), np.zeros((n, 3))
            f[begin] = pe[begin] * em[OUT]
            f[begin] /= f[begin].sum(axis=1, keepdims=True)
            for k in range(1, len(active)):
                at = begin[: active[k]] + k
                v = (f[at - 1] @ em) * pe[at]
                f[at] = v / v.sum(axis=1, keepdims=True)
            b[ends] = em[:, OUT]
            for k in range(len(active) - 1, 0, -1):
                at = begin[: active[k]] + k
                v = (b[at] * pe[at]) @ em.T
                b[at - 1] = v / v.sum(axis=1, keepdims=True)
            p = f * b
            p /= p.sum(axis=1, keepdims=True)
            g = np.zeros_like(self.emit)
            err = p - hot
            for k in range(cols.shape[1]):
                for t in range(3):
                    g[:, t] += np.bincount(cols[:, k], weights=err[:, t], minlength=none + 1)[:none]
            g = g / n + l2 * self.emit
            at = np.flatnonzero(inner)
            pair = f[at - 1][:, :, None] * em[None] * (pe[at] * b[at])[:, None, :]
            pair /= pair.sum(axis=(1, 2), keepdims=True)
            exp = pair.sum(axis=0)
            exp[OUT] += p[begin].sum(axis=0)
            exp[:, OUT] += p[ends].sum(axis=0)
            gm = (exp - seen) / n + l2 * self.move
            sq += g * g
            sm += gm * gm
            self.emit -= rate * g / np.sqrt(sq)
            self.move -= rate * gm / np.sqrt(sm)


def _char_offsets(raw: bytes, at: list[int]) -> list[int]:
    """Code points before these byte offsets (ascending)."""
    out, done, chars = [], 0, 0
    for k in at:
        chars += len(raw[done:k].decode("utf-8", "replace"))
        done = k
        out.append(chars)
    return out


def _truth(f: Features, texts: pa.Array, hit: np.ndarray) -> np.ndarray:
    """Tags of the words of f by the base spans."""
    t = f.tokens
    y = np.zeros(len(t.start), np.int64)
    for d in np.flatnonzero(hit):
        text = texts[int(d)].as_py()
        a, b = int(t.first[d]), int(t.first[d + 1])
        if a == b:
            continue
        spans = base_spans(text)
        base = int(t.start[a]) - len(text[: next(i for i, c in enumerate(text) if c not in " \t\n\x0b\x0c\r")].encode())
        for _, s, e in spans:
            lo, hi = base + len(text[:s].encode()), base + len(text[:e].encode())
            words = np.flatnonzero((t.end[a:b] > lo) & (t.start[a:b] < hi)) + a
            fresh = words[y[words] == 0]
            y[fresh] = INSIDE
            if len(words) and (words[0] == a or y[words[0]] != 0) and len(fresh) == len(words):
                y[words[0]] = BEGIN
    return y[f.at]


def shown_again(x: np.ndarray, stretch: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The stretches (x, starts, y), then those with spans in four disguises; with what is hidden of each."""
    first = np.zeros(len(x), np.int64)
    first[stretch[1:]] = 1
    number = np.cumsum(first)
    with_span = np.zeros(len(stretch), bool)
    with_span[number[y > 0]] = True
    again = np.flatnonzero(with_span[number])
    own, tag, number = x[again], y[again], number[again]
    n, k = len(x), len(again)
    begin = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]])) if k else again
    name = (tag == BEGIN) & np.concatenate([tag[1:] == INSIDE, [False]])[:k]  # the first word of several
    nothing, words = np.zeros(own.shape, bool), np.zeros(own.shape, bool)
    words[:, WORD_FEATURES] = True
    words[name, 0] = True
    alphabet, shape = words.copy(), nothing.copy()
    named = (tag == INSIDE) | name
    alphabet[named, 1] = True
    shape[np.ix_(named, SHAPE_FEATURES)] = True
    mixed, dull = own.copy(), own.copy()
    mixed[named & (mixed[:, 2] == 3), 2] = 2  # hexadecimal or not
    value = np.flatnonzero((tag > 0) & (own[:, 0] >= 3))
    dull[value, :3] = np.array(PLAIN)[np.random.default_rng(3).integers(0, len(PLAIN), len(value))]
    for step, feature in ((1, 4), (-1, 5)):  # the neighbours see the new shape
        at = np.clip(value + step, 0, max(k - 1, 0))
        good = (at == value + step) & (number[at] == number[value])
        dull[at[good], feature] = dull[value[good], 1]
    hidden = np.concatenate([np.zeros(x.shape, bool), words, alphabet, shape, words])
    return np.concatenate([x, own, mixed, own, dull]), np.concatenate([stretch, *(begin + n + k * i for i in range(4))]), np.concatenate([y, tag, tag, tag, np.zeros(k, y.dtype)]), hidden


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_docs: int = 3_000) -> Field:
    """A field from the base spans of the documents with the smallest hashes of their ids; half of the sample has a word that spans begin with."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    likely = F.col("text").rlike(r"(?i)password|passwd|secret|token|api_?key|AKIA") | F.col("text").rlike(r"[0-9a-f]{24}")
    order = [F.xxhash64(F.col("doc_id"), F.lit(31)), "doc_id", "tid"]
    # only ids and hashes of texts are ordered; features of the chosen few are made on executors
    keyed = own.withColumn("tid", F.xxhash64("text"))
    rare = keyed.where(likely).select("doc_id", "tid").orderBy(*order).limit(train_docs // 2)
    rest = keyed.select("doc_id", "tid").orderBy(*order).limit(train_docs - train_docs // 2)
    chosen = rare.union(rest).distinct()
    sample = keyed.join(F.broadcast(chosen), ["doc_id", "tid"], "left_semi").dropDuplicates(["doc_id", "tid"]).select("text")

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            texts = part["text"].combine_chunks()
            t = tokenize(texts)
            f = Features(t)
            if len(f.x):
                begins = np.zeros(len(f.x), bool)
                begins[f.stretch] = True
                x = pa.FixedSizeListArray.from_arrays(pa.array(f.x.astype(np.int16).reshape(-1)), f.x.shape[1])
                yield from pa.table({"x": x.cast(pa.list_(pa.int16())), "begins": pa.array(begins), "y": pa.array(_truth(f, texts, candidates(t)).astype(np.int8))}).to_batches()

    got = sample.mapInArrow(coded, "x array<short>, begins boolean, y byte").toArrow()
    field = Field()
    if got.num_rows:
        x = got["x"].combine_chunks().flatten().to_numpy().astype(np.int64).reshape(got.num_rows, -1)
        x, stretch, y, hidden = shown_again(x, np.flatnonzero(got["begins"].to_numpy()), got["y"].to_numpy().astype(np.int64))
        field.fit(x, stretch, y, hidden)
    return field


SPANS = ArrayType(StructType().add("kind", "string").add("start", "integer").add("end", "integer"))
SPANS_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find(texts: pa.Array | pa.ChunkedArray, field: Field) -> list[list[tuple[str, int, int]]]:
    t = tokenize(texts)
    rows = len(t.first) - 1
    out: list[list[tuple[str, int, int]]] = [[] for _ in range(rows)]
    hit = candidates(t)
    for d in np.flatnonzero(hit):
        out[d] = base_spans(texts[int(d)].as_py())
    if not len(t.start):
        return out
    f = Features(t)
    tags = field.viterbi(f.x, f.stretch)
    tagged = np.flatnonzero(tags > 0)
    if len(tagged):
        word = f.at[tagged]
        new = np.concatenate([[True], (np.diff(word) > 1) | (tags[tagged][1:] == BEGIN) | (t.doc[word][1:] != t.doc[word][:-1])])
        first, last = word[new], word[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(word) - 1]])]
        for d in np.unique(t.doc[first]):
            text = texts[int(d)].as_py()
            raw = text.encode()
            base = int(t.start[t.first[d]]) - (len(raw) - len(raw.lstrip(b" \t\n\x0b\x0c\r")))
            mine = np.flatnonzero(t.doc[first] == d)
            at = [int(v) - base for k in mine for v in (t.start[first[k]], t.end[last[k]])]
            chars = _char_offsets(raw, at)
            taken = list(out[d])
            for s, e in zip(chars[::2], chars[1::2], strict=True):
                if not any(a < e and s < b for _, a, b in taken):
                    out[d].append(("field", s, e))
            out[d] = ordered(out[d])
    return out


def scan(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """``docs`` with ``spans`` (kind, start, end), all of them, by start and kind."""
    kept = [c for c in docs.columns if c != "spans"]
    source = docs.select(*kept)
    schema = StructType([*source.schema.fields, StructField("spans", SPANS)])
    held = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for part in slices(batches, text_col):
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in find(part[text_col].combine_chunks(), model)]
            yield from part.append_column("spans", pa.array(spans, SPANS_TYPE)).combine_chunks().to_batches()

    return source.mapInArrow(run, schema)

"""Quality classifier from weak labels.

*Labellers.*  Heuristics vote on each document: good, bad or nothing.  They overlap and err.
Statistics of shape vote bad where they are extreme; a lexicon votes bad on word beginnings
that documents marked bad have and others do not; ``plain`` votes good where no statistic is
even raised and no lexicon entry occurs; ``marked`` repeats a given label, where there is one.
*Label model.*  The votes of all documents are counted by pattern (at most 3 to the number of
labellers, whatever the corpus); expectation-maximisation over these counts estimates how
often each labeller is right where it votes, from and towards its agreement with given labels.  Saying nothing tells nothing, because the kinds
of bad documents exclude each other and most labellers are silent on most of them.
*Scorer.*  Posterior labels of a bounded sample (``train_rows``, the smallest hashes of the
id) train a linear model over hashed features -- word beginnings and binned statistics.  It
scores every document; below ``threshold`` a document is rejected.

Bounds: ``label_rows`` labelled ids are read for the lexicon, where executors count, and
``train_rows`` rows train the scorer, whose features meet on the driver; the model has 2**bits weights and is sent to executors whole (2 MB).

Defined results: a null or empty text is scored as a text without words; a null id is scored
like any other; repeated rows get equal scores; without labels the lexicon abstains; an empty
table gives an empty result; columns pass through, save those named as the results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from .near_dedup import slices
from .tokens import LOWER, hash_slices, join_hash, tokenize

U = np.uint64
#: Word beginnings, in bytes, that are features of their own; 0 stands for the whole word.
PREFIXES = (4, 6, 0)
STATS = ("symbols", "pipes", "capitals", "exclaimed", "repeated", "top_run", "repeated_lines", "digits")
LABELLERS = (*STATS, "lexicon", "plain", "marked")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*@^~|<>{}[]\\=+_"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ALPHA = _UPPER.copy()
_ALPHA[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[i for i in range(33, 127) if not chr(i).isalnum()]] = True


@dataclass
class Features:
    """Statistics (rows x STATS), words in each row, and the distinct hashed features of each row."""

    stats: np.ndarray
    words: np.ndarray
    row: np.ndarray
    hash: np.ndarray



def features(col: pa.Array | pa.ChunkedArray) -> Features:
    t = tokenize(col)
    rows = len(t.first) - 1
    n = t.counts.astype(float)
    some = np.maximum(n, 1)
    stats = np.zeros((rows, len(STATS)))
    if not len(t.start):
        return Features(stats, n, np.zeros(0, np.int64), np.zeros(0, U))
    buf = t.buf
    last = buf[t.end - 1]
    before = buf[np.maximum(t.end - 2, t.start)]
    size = t.end - t.start
    low = LOWER[buf]
    a, b = t.start.copy(), t.end.copy()
    for at, step, edge in ((a, 1, 0), (b, -1, -1)):
        live = np.arange(len(a))
        while len(live):
            live = live[a[live] < b[live]]
            live = live[_PUNCT[buf[at[live] + edge]]]
            at[live] += step
    bare = a >= b

    def by_word(x: np.ndarray) -> np.ndarray:
        return np.bincount(t.doc, weights=x, minlength=rows) / some

    letters = np.concatenate([[0], np.cumsum(_ALPHA[buf], dtype=np.int64)])
    uppers = np.concatenate([[0], np.cumsum(_UPPER[buf], dtype=np.int64)])
    stats[:, 0] = by_word(_SYMBOL[last] & _SYMBOL[before] & (size > 2))
    stats[:, 1] = by_word((size == 1) & (last == ord("|")))
    up = np.bincount(t.doc, weights=uppers[t.end] - uppers[t.start], minlength=rows)
    al = np.bincount(t.doc, weights=letters[t.end] - letters[t.start], minlength=rows)
    stats[:, 2] = np.where(al >= 30, up / np.maximum(al, 1), 0)
    stats[:, 3] = by_word((last == ord("!")) & (before == ord("!")))
    wh = hash_slices(low, a, b)
    same = np.zeros(len(wh))
    same[1:] = (wh[1:] == wh[:-1]) & (t.doc[1:] == t.doc[:-1])
    o = np.argsort((t.doc.astype(U) << U(40)) | (wh >> U(24)))
    new = np.concatenate([[True], (wh[o][1:] != wh[o][:-1]) | (t.doc[o][1:] != t.doc[o][:-1])])
    kinds = np.bincount(t.doc[o][new], minlength=rows)
    stats[:, 4] = np.where(n >= 25, 1 - kinds / np.maximum(np.sqrt(some * 40), some * 0.55).clip(1, some), 0).clip(0, 1)
    stats[:, 5] = np.where(n >= 10, by_word(same), 0)
    # lines: hash of the words of each
    line = np.zeros(len(wh), bool)
    line[t.first[:-1][t.counts > 0]] = True
    breaks = np.concatenate([[0], np.cumsum(buf == 10, dtype=np.int64)])
    line[1:] |= breaks[t.start[1:]] > breaks[t.end[:-1]]
    begin = np.flatnonzero(line)
    place = np.arange(len(wh)) - np.repeat(begin, np.diff(np.concatenate([begin, [len(wh)]])))
    lh = np.add.reduceat(join_hash(wh, place.astype(U), 31), begin)
    ld = t.doc[begin]
    lo = np.lexsort((lh, ld))
    ln = np.concatenate([[True], (lh[lo][1:] != lh[lo][:-1]) | (ld[lo][1:] != ld[lo][:-1])])
    count = np.bincount(ld, minlength=rows)
    stats[:, 6] = np.where(count >= 5, 1 - np.bincount(ld[lo][ln], minlength=rows) / np.maximum(count, 1), 0)
    stats[:, 7] = by_word(_DIGIT[last] & _DIGIT[buf[t.start]])
    # hashed beginnings of distinct words
    kept = o[new & ~bare[o]]
    doc, s, e = t.doc[kept], a[kept], b[kept]
    fr, fh = [], []
    for k in PREFIXES:
        sel = np.flatnonzero(e - s > k) if k else np.arange(len(s))
        fr.append(doc[sel])
        fh.append(hash_slices(low, s[sel], s[sel] + k, k + 1) if k else hash_slices(low, s, e, 0))
    row, h = np.concatenate(fr), np.concatenate(fh)
    o = np.argsort((row.astype(U) << U(40)) | (h >> U(24)))
    row, h = row[o], h[o]
    once = np.concatenate([[True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])]) if len(row) else np.zeros(0, bool)
    return Features(stats, n, row[once], h[once])


#: Shares from which each statistic speaks of a bad document, and below which of a good one.
BAD_FROM = np.array([0.2, 0.12, 0.5, 0.1, 0.55, 0.25, 0.5, 0.3])
GOOD_TO = np.array([0.03, 0.02, 0.15, 0.01, 0.25, 0.08, 0.35, 0.1])


def votes(f: Features, lexicon: np.ndarray, marked: np.ndarray | None = None) -> np.ndarray:
    """(rows x LABELLERS): 1 bad, -1 good, 0 nothing. marked: given labels in this code."""
    rows, k = len(f.words), len(STATS)
    v = np.zeros((rows, len(LABELLERS)), np.int8)
    long = f.words >= 10
    v[:, :k] = (f.stats >= BAD_FROM) & long[:, None]
    hits = np.zeros(rows, np.int64)
    if len(lexicon):
        at = np.minimum(np.searchsorted(lexicon, f.hash), len(lexicon) - 1)
        hits = np.bincount(f.row[lexicon[at] == f.hash], minlength=rows)
        v[:, k] = hits > 0
    v[:, k + 1] = -((f.stats <= GOOD_TO).all(axis=1) & (hits == 0)).astype(np.int8)
    if marked is not None:
        v[:, k + 2] = marked
    return v


def learn_lexicon(sample: DataFrame, least: int = 8, odds: float = 40.0, alone: float = 0.002) -> np.ndarray:
    """Hashes of word beginnings in ``least`` bad documents or more and ``odds`` times as common there; sample(text, known)."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            f = features(part["text"])
            bad = part["known"].to_numpy(zero_copy_only=False).astype(bool)
            yield from pa.table({"hash": pa.array(f.hash.view(np.int64)), "bad": pa.array(bad[f.row])}).to_batches()

    size = sample.agg(F.count_if("known").alias("bad"), F.count_if(~F.col("known")).alias("good")).first()
    nb, ng = max(1, size.bad), max(1, size.good)
    counts = sample.mapInArrow(listed, "hash long, bad boolean").groupBy("hash").agg(F.count_if("bad").alias("b"), F.count_if(~F.col("bad")).alias("g"))
    kept = counts.where((F.col("b") >= least) & (F.col("b") / nb >= odds * (F.col("g") + 0.5) / ng) & (F.col("g") / ng <= alone))
    return np.sort(kept.select("hash").toArrow()["hash"].to_numpy(zero_copy_only=False).astype(np.int64).view(U))


@dataclass
class LabelModel:
    """How often each labeller is right where it votes; ``prior`` of bad."""

    accuracy: np.ndarray
    prior: float

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """Probability of bad."""
        weight = np.log(self.accuracy / (1 - self.accuracy))
        return 1 / (1 + np.exp(-np.clip(np.log(self.prior / (1 - self.prior)) + v @ weight, -50, 50)))


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, prior: float = 0.4, first: float | np.ndarray = 0.9, strength: float | np.ndarray = 20.0, rounds: int = 200) -> LabelModel:
    """Expectation-maximisation over vote patterns, from the accuracies ``first``, which also stand for ``strength`` votes of each labeller."""
    k = patterns.shape[1]
    model = LabelModel(np.full(k, first, float), prior)
    for _ in range(rounds):
        bad = model.posterior(patterns)
        right = np.where(patterns == 1, bad[:, None], np.where(patterns == -1, 1 - bad[:, None], 0))
        voted = counts @ (patterns != 0)
        accuracy = np.clip((counts @ right + first * strength) / (voted + strength), 0.55, 0.995)
        moved = np.abs(accuracy - model.accuracy).max() if k else 0
        model = LabelModel(accuracy, prior)
        if moved < 1e-7:
            break
    return model


def anchors(patterns: np.ndarray, counts: np.ndarray, first: float = 0.9, strength: float = 20.0) -> tuple[np.ndarray, np.ndarray]:
    """(accuracies, strengths) to begin with: each labeller's agreement with the given labels (the
    last labeller), which count as much as all its votes.  Without it, a labeller that mostly
    votes alone could only drift to a coin's toss."""
    given = patterns[:, -1:] * patterns
    right, voted = counts @ (given > 0), counts @ (given != 0)
    right[-1:] = voted[-1:] = 0
    return (right + first * strength) / (voted + strength), strength + counts @ (patterns != 0)


def slots(f: Features, v: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the linear model: hashed beginnings, statistics in bins, and the votes of the labellers other than given labels."""
    bins = np.digitize(f.stats, np.array([0.005, 0.02, 0.05, 0.1, 0.2, 0.35, 0.55, 0.8]))
    r, c = np.indices(f.stats.shape)
    size = np.digitize(f.words, [1, 5, 10, 20, 50, 200, 1000])
    vr, vc = np.nonzero(v[:, :-1])
    row = np.concatenate([f.row, r.reshape(-1), np.arange(len(f.words)), vr])
    return row, np.concatenate([(f.hash >> U(64 - bits)).astype(np.int64) + 256, (c * 16 + bins).reshape(-1), 200 + size, 220 + vc])


@dataclass
class Scorer:
    weight: np.ndarray
    bias: float
    bits: int

    def __call__(self, f: Features, v: np.ndarray) -> np.ndarray:
        """Probability of good."""
        r, c = slots(f, v, self.bits)
        z = np.bincount(r, weights=self.weight[c], minlength=len(f.words)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit_scorer(row: np.ndarray, col: np.ndarray, good: np.ndarray, bits: int, steps: int = 200, rate: float = 0.3, l2: float = 1e-3, least: int = 10, screen: float = 8.0) -> Scorer:
    """Logistic regression with adaptive steps on soft labels; features in fewer than ``least`` rows, or whose share differs between the classes by less than ``screen`` standard errors, stay 0."""
    width = (1 << bits) + 256
    seen = np.bincount(col, minlength=width)
    nb = max((1 - good).sum(), 1e-9)
    ng = max(good.sum(), 1e-9)
    in_bad = np.bincount(col, weights=(1 - good)[row], minlength=width)
    rate_all = seen / (nb + ng)
    z = (in_bad / nb - (seen - in_bad) / ng) / np.sqrt(np.maximum(rate_all * (1 - rate_all), 1e-12) * (1 / nb + 1 / ng))
    useful = (seen >= least) & (np.abs(z) >= screen)
    row, col = row[useful[col]], col[useful[col]]
    n = max(1, len(good))
    weight, bias = np.zeros(width), 0.0
    sq, sb = np.full(width, 1e-8), 1e-8
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights=weight[col], minlength=n) + bias, -50, 50)))
        err = p - good
        g = np.bincount(col, weights=err[row], minlength=width) / n + l2 * weight
        sq += g * g
        weight -= rate * g / np.sqrt(sq)
        gb = err.mean()
        sb += gb * gb
        bias -= rate * gb / np.sqrt(sb)
    return Scorer(weight, float(bias), bits)


@dataclass
class QualityModel:
    labels: LabelModel
    scorer: Scorer
    lexicon: np.ndarray


def _vote_rows(lexicon: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            v = votes(features(part["text"]), lexicon, part["marked"].to_numpy())
            code = ((v + 1) @ 3 ** np.arange(v.shape[1])).astype(np.int64)
            yield from pa.table({"pattern": pa.array(code)}).to_batches()

    return run


def train(docs: DataFrame, labels: DataFrame | None, id_col: str = "doc_id", text_col: str = "text", train_rows: int = 8_000, label_rows: int = 40_000, bits: int = 18) -> QualityModel:
    """``labels``: doc_id, bad (boolean)."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = F.xxhash64(F.col("doc_id"), F.lit(11))
    lexicon = np.zeros(0, U)
    if labels is not None:
        known = labels.groupBy("doc_id").agg(F.max("bad").alias("known"))
        drawn = known.orderBy(order, "doc_id").limit(label_rows)
        lexicon = learn_lexicon(own.join(F.broadcast(drawn), "doc_id").select("text", "known"))
        marked = own.join(F.broadcast(drawn), "doc_id", "left").select("doc_id", "text", F.when(F.col("known"), 1).when(~F.col("known"), -1).otherwise(0).alias("marked"))
    else:
        marked = own.withColumn("marked", F.lit(0))
    seen = marked.select("text", "marked").mapInArrow(_vote_rows(lexicon), "pattern long").groupBy("pattern").count().toArrow()
    code = seen["pattern"].to_numpy(zero_copy_only=False)
    patterns = (code[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1).astype(np.int8) if len(code) else np.zeros((0, len(LABELLERS)), np.int8)
    often = seen["count"].to_numpy(zero_copy_only=False).astype(float)
    first, strength = anchors(patterns, often)
    model = fit_label_model(patterns, often, first=first, strength=strength)
    # rows are drawn by id and text hash, so that ids which repeat add no more than their place
    drawn = own.select("doc_id", F.xxhash64("text").alias("tid")).orderBy(F.xxhash64(F.col("doc_id"), F.lit(23)), "doc_id", "tid").limit(train_rows).distinct()
    chosen = marked.withColumn("tid", F.xxhash64("text")).join(F.broadcast(drawn), ["doc_id", "tid"], "left_semi").dropDuplicates(["doc_id", "tid"])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            f = features(part["text"])
            v = votes(f, lexicon, part["marked"].to_numpy())
            r, c = slots(f, v, bits)
            o = np.argsort(r, kind="stable")
            off = np.concatenate([[0], np.cumsum(np.bincount(r, minlength=part.num_rows))]).astype(np.int32)
            cols = pa.ListArray.from_arrays(pa.array(off), pa.array(c[o].astype(np.int32)))
            yield from pa.table({"cols": cols, "good": pa.array(1 - model.posterior(v))}).to_batches()

    # features of the sample are made by the executors; the driver gets small integers
    rows = chosen.select("text", "marked").mapInArrow(coded, "cols array<int>, good double").toArrow()
    if not rows.num_rows:
        return QualityModel(model, Scorer(np.zeros((1 << bits) + 256), 1.0, bits), lexicon)
    cols = rows["cols"].combine_chunks()
    per = np.asarray(cols.value_lengths())
    return QualityModel(model, fit_scorer(np.repeat(np.arange(len(per), dtype=np.int32), per), cols.flatten().to_numpy(), rows["good"].to_numpy(), bits), lexicon)


def classify(docs: DataFrame, model: QualityModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with weak_bad (the label model's probability), score (the linear model's probability of good) and accepted."""
    names = ("weak_bad", "score", "accepted")
    kept = [c for c in docs.columns if c not in names]
    source = docs.select(*kept)
    held = docs.sparkSession.sparkContext.broadcast((model.labels, model.scorer, model.lexicon))
    schema = StructType([*source.schema.fields, StructField("weak_bad", DoubleType()), StructField("score", DoubleType()), StructField("accepted", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weak, scorer, lexicon = held.value
        for part in slices(batches, text_col):
            f = features(part[text_col])
            v = votes(f, lexicon)
            p = scorer(f, v)
            for name, x in zip(names, (weak.posterior(v), p, p >= threshold), strict=True):
                part = part.append_column(name, pa.array(x))
            yield from part.combine_chunks().to_batches()

    return source.mapInArrow(run, schema)

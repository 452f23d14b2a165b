"""MinHash near-duplicates by tensored banding, with exact confirmation.

Similarity search with L tables of K minhashes each needs L*K minhash functions.  Tensoring
takes two collections of ``bands`` keys (``rows`` minhashes each) and forms the bands**2
tables from pairs (A_i, B_j): two documents meet in a table when they agree on some A_i and
on some B_j.  18 bands of 3 rows give 324 tables of 6 minhashes from 108 functions instead of
1944; a pair at similarity 0.8 escapes all of them with probability 5e-6.

1. Equal shingle sets collapse to one node (equi-aggregate on a 64-bit set hash).
2. Each node sends one row for each A_i with the bytes of all its B minhashes; in a cell of
   A_i, the pairs (A_i, B_j) are the tables.  Members of a table are linked if their B bytes
   agree on ``keep_share`` of functions.  The links themselves are not listed: a search compares
   members with those it has not reached, starting from what earlier tables of the cell have
   connected, and the cell returns a spanning forest, at most one edge for each of its nodes.  A
   band value with more than ``hot_rows`` rows is dealt to several cells, and all parts of one
   of its tables are joined.
3. Components of the forests are candidate clusters.  Within each, full shingle sets decide: a
   breadth-first search compares a node with those not reached yet that share one of its rarest
   shingles (a pair at the similarity must), which finds exactly the components of the true
   links and is far from all pairs, in groups of copies as in long chains.  A cluster beyond
   ``cluster_bytes`` is searched in blocks; then everything outside its main component is
   compared with every block, which is exact too.

Defined results: a null or empty text has no shingles and is linked with nothing; with fewer
words than a shingle, the whole sequence is the one shingle; a null id keeps component null and
is kept; rows that repeat an id are rows of their own (each judged by its own text); an empty
table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .state import components, cut
from .tokens import U, Tokens, join_hash, mix, rolling, tokenize, word_hashes

SLICE_BYTES = 2 << 20


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.Table]:
    """The rows in tables of at most ``limit`` bytes of text (or one row)."""
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not t.num_rows:
            continue
        size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(t[text]), 0)).astype(np.int64)
        part = (np.cumsum(size) - size) // limit
        cut_at = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [t.num_rows]])
        for a, b in zip(cut_at[:-1], cut_at[1:], strict=True):
            yield t.slice(a, b - a)


def shingles(t: Tokens, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every shingle, in order of row; repeats included."""
    wh = word_hashes(t)
    r = rolling(wh, size, 3) if size > 1 else mix(wh + U(7))
    ok = t.doc[: len(r)] == t.doc[size - 1 : size - 1 + len(r)] if len(r) else np.zeros(0, bool)
    row, h = t.doc[: len(r)][ok], r[ok]
    n = t.counts
    few = np.flatnonzero((n > 0) & (n < size))
    if len(few):  # the whole sequence, told apart by its length
        acc = mix(n[few].astype(U) + U(0xABCDEF12345))
        for i in range(size - 1):
            has = n[few] > i
            acc[has] = join_hash(acc[has], wh[t.first[few[has]] + i], 11)
        row, h = np.concatenate([row, few]), np.concatenate([h, acc])
        o = np.argsort(row, kind="stable")
        row, h = row[o], h[o]
    return row, h


def distinct_sets(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    o = np.lexsort((h, row))
    row, h = row[o], h[o]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])]) if len(row) else np.zeros(0, bool)
    return row[new], h[new]


def set_hash(row: np.ndarray, h: np.ndarray, rows: int) -> np.ndarray:
    """A hash of each row's set (distinct, sorted); 0 for an empty one, as a signed number."""
    out = np.zeros(rows, U)
    if len(row):
        begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        total = np.add.reduceat(mix(h ^ U(0x5851F42D4C957F2D)), begin)
        size = np.diff(np.concatenate([begin, [len(row)]])).astype(U)
        out[row[begin]] = join_hash(total, size, 13) | U(1)
    return out.view(np.int64)


class Signer:
    """Minhash keys of shingle sets."""

    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(20240601)
        self.bands, self.rows = bands, rows
        self.xor = rng.integers(0, 1 << 32, 2 * bands * rows, dtype=np.uint64).astype(np.uint32)
        self.mul = (rng.integers(0, 1 << 32, 2 * bands * rows, dtype=np.uint64) | U(1)).astype(np.uint32)

    def __call__(self, row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(A keys, B bytes) of each row that has shingles."""
        begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        low = (h >> U(32)).astype(np.uint32)
        m = np.empty((2 * self.bands * self.rows, len(begin)), np.uint32)
        for k in range(len(m)):
            m[k] = np.minimum.reduceat((low ^ self.xor[k]) * self.mul[k], begin)
        a = np.zeros((len(begin), self.bands), U)
        half = self.bands * self.rows
        for i in range(self.bands):
            key = np.full(len(begin), i, U)
            for r in range(self.rows):
                key = join_hash(key, m[i * self.rows + r].astype(U), 17)
            a[:, i] = key
        b = (mix(m[half:].T.astype(U)) & U(255)).astype(np.uint8)
        return a, np.ascontiguousarray(b)


def _signatures(size: int, bands: int, rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(bands, rows)
        for t in slices(batches, "text"):
            n = t.num_rows
            row, h = distinct_sets(*shingles(tokenize(t["text"], lower=True), size))
            sid = set_hash(row, h, n)
            a = np.zeros((n, bands), np.int64)
            b = np.zeros((n, bands * rows), np.uint8)
            if len(row):
                full = np.unique(row)
                a_, b_ = signer(row, h)
                a[full], b[full] = a_.view(np.int64), b_
            keys = pa.ListArray.from_arrays(pa.array(np.arange(0, n * bands + 1, bands, dtype=np.int32)), pa.array(a.reshape(-1)))
            sig = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, n * bands * rows + 1, bands * rows, dtype=np.int32)), pa.py_buffer(b.reshape(-1))])
            size_ = np.asarray(pa.compute.fill_null(pa.compute.binary_length(t["text"]), 0)).astype(np.int64)
            yield from pa.table({"doc_id": t["doc_id"], "tid": t["tid"], "n_bytes": pa.array(size_), "sid": pa.array(sid), "n_shingles": pa.array(np.bincount(row, minlength=n), pa.int64()), "keys": keys, "sig": sig}).to_batches()

    return sign


class _Forest:
    """Which nodes of a cell are connected so far: pointers that lead to the smallest node reached."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, nodes: np.ndarray) -> np.ndarray:
        root = self.up[nodes]
        while (self.up[root] != root).any():
            root = self.up[root]
        self.up[nodes] = root
        return root

    def join(self, nodes: np.ndarray) -> None:
        roots = np.unique(self.find(nodes))
        self.up[roots] = roots[0]


def _reached(sig: np.ndarray, label: np.ndarray, need: int) -> np.ndarray:
    """Component (0, 1, ...) of each row of a table, where rows of one label are connected and so are
    rows whose bytes agree in ``need`` places.  A row is compared only with those not reached yet."""
    comp = np.full(len(sig), -1)
    number = 0
    while (comp < 0).any():
        first = int(np.argmax(comp < 0))
        front = np.flatnonzero((label == label[first]) & (comp < 0))
        comp[front] = number
        while len(front):
            free = np.flatnonzero(comp < 0)
            if not len(free):
                break
            met = np.zeros(len(free), bool)
            step = max(1, (8 << 20) // (len(free) * sig.shape[1]))
            for s in range(0, len(front), step):
                left = np.flatnonzero(~met)
                if not len(left):
                    break
                met[left] = ((sig[front[s : s + step], None] == sig[free[left]][None]).sum(axis=2, dtype=np.int16) >= need).any(axis=0)
            front = np.flatnonzero(np.isin(label, label[free[met]]) & (comp < 0)) if met.any() else free[:0]
            comp[front] = number
        number += 1
    return comp


def _tables(bands: int, rows: int, keep_share: float):
    """A spanning forest of the links within a cell (each node with the smallest one it reaches); of a hot band value, also one node of each part of a table with the hash of that table."""
    need = int(np.ceil(keep_share * bands * rows))

    def link(cell: pa.Table) -> pa.Table:
        band, sid, hot = cell["band"].to_numpy(), cell["sid"].to_numpy(), cell["hot"].to_numpy(zero_copy_only=False)
        sig = np.frombuffer(b"".join(cell["sig"].to_pylist()), np.uint8).reshape(len(sid), -1)
        o = np.lexsort((sid, band))
        band, sid, sig, hot = band[o], sid[o], sig[o], hot[o]
        group = np.cumsum(np.concatenate([[True], band[1:] != band[:-1]])) - 1
        use = np.flatnonzero((np.bincount(group)[group] > 1) | hot)
        group, sig, hot, band = group[use], sig[use], hot[use], band[use]
        names, node = np.unique(sid[use], return_inverse=True)
        forest = _Forest(len(names))
        keys, parts = [], []
        for j in range(bands if len(use) else 0):
            part = np.zeros(len(use), np.int64)
            for r in range(rows):
                part = part * 256 + sig[:, j * rows + r]
            table = group.astype(np.int64) << (8 * rows) | part
            by = np.argsort(table, kind="stable")
            begin = np.flatnonzero(np.concatenate([[True], table[by][1:] != table[by][:-1]]))
            end = np.concatenate([begin[1:], [len(by)]])
            label = forest.find(np.arange(len(names)))[node[by]]
            apart = np.minimum.reduceat(label, begin) != np.maximum.reduceat(label, begin)
            for s, e, open_ in zip(begin.tolist(), end.tolist(), (apart | hot[by[begin]]).tolist(), strict=True):
                if not open_:
                    continue
                at = by[s:e]
                comp = _reached(sig[at], forest.find(node[at]), need) if e - s > 1 else np.zeros(1, np.int64)
                _, heads, count = np.unique(comp, return_index=True, return_counts=True)
                order, ends = np.argsort(comp, kind="stable"), np.cumsum(count)
                for c in np.flatnonzero(count > 1).tolist():
                    forest.join(node[at[order[ends[c] - count[c] : ends[c]]]])
                if hot[at[0]]:
                    key = int(mix(band[at[:1]].view(U) + U((j << 24) + int(part[at[0]])))[0].view(np.int64))
                    keys += [key] * len(heads)
                    parts += names[node[at[heads]]].tolist()
        root = forest.find(np.arange(len(names)))
        far = np.flatnonzero(root != np.arange(len(names)))
        k = len(keys)
        a = np.concatenate([names[far], np.array(parts, np.int64)])
        b = np.concatenate([names[root[far]], np.zeros(k, np.int64)])
        return pa.table({"key": pa.array([None] * len(far) + keys, pa.int64()), "a": pa.array(a), "b": pa.array(b, pa.int64(), mask=np.arange(len(b)) >= len(far))})

    return link


class _Sets:
    """Shingle sets of some rows, coded by small numbers."""

    def __init__(self, row: np.ndarray, h: np.ndarray, rows: int):
        self.size = np.bincount(row, minlength=rows)
        self.begin = np.concatenate([[0], np.cumsum(self.size)])
        words, self.code = np.unique(h, return_inverse=True)
        self.mark = np.zeros(len(words), bool)

    def linked(self, i: int, others: np.ndarray, num: int, den: int) -> np.ndarray:
        """Which of the other rows share den * intersection >= num * union with row i."""
        n, m = self.size[i], self.size[others]
        fit = (den * np.minimum(n, m) >= num * np.maximum(n, m)) & (m > 0)
        out = np.zeros(len(others), bool)
        cand = others[fit]
        if len(cand) and n:
            own = self.code[self.begin[i] : self.begin[i + 1]]
            self.mark[own] = True
            k = self.size[cand]
            at = np.concatenate([[0], np.cumsum(k)])
            flat = np.arange(at[-1]) + np.repeat(self.begin[cand] - at[:-1], k)
            both = np.add.reduceat(self.mark[self.code[flat]].astype(np.int64), at[:-1])
            self.mark[own] = False
            out[fit] = den * both >= num * (n + k - both)
        return out

    def search(self, num: int, den: int) -> np.ndarray:
        """Component number (the first row) of each row, by breadth-first search over true links."""
        rows = len(self.size)
        comp, unmet = np.full(rows, -1), np.ones(rows, bool)
        often = np.bincount(self.code, minlength=len(self.mark))
        owner = np.repeat(np.arange(rows), self.size)
        rarest = np.lexsort((self.code, often[self.code], owner))
        # two sets at the similarity have at least num/den of either in common, so their rarest shingles meet
        head = self.size - -(-num * self.size // den) + 1
        rank = np.arange(len(owner)) - self.begin[owner]
        first = rarest[rank < head[owner]]
        code, holder = self.code[first], owner[first]
        at = np.concatenate([[0], np.cumsum(np.bincount(holder, minlength=rows))])
        by = np.argsort(code, kind="stable")
        post = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(self.mark)))])
        posted = holder[by]
        free = np.arange(rows)
        for root in range(rows):
            if not unmet[root]:
                continue
            comp[root], unmet[root] = root, False
            queue = [root]
            while queue:
                i = queue.pop()
                mine = code[at[i] : at[i + 1]]
                lo, n = post[mine], post[mine + 1] - post[mine]
                if n.sum() < len(free):
                    seen = posted[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                    others = np.unique(seen[unmet[seen]])
                else:
                    free = free[unmet[free]]
                    others = free
                if len(others):
                    hit = others[self.linked(i, others, num, den)]
                    comp[hit], unmet[hit] = root, False
                    queue += hit.tolist()
        return comp


def _load(cell: pa.Table, size: int) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """Rows whose text has the set they are listed with, once for each set; (rows, row of shingle, shingle)."""
    row, h = distinct_sets(*shingles(tokenize(cell["text"], lower=True), size))
    sid = set_hash(row, h, cell.num_rows)
    want = cell["sid"].to_numpy()
    cluster = cell["cluster"].to_numpy()
    tag = cell["tag"].to_numpy() if "tag" in cell.column_names else np.zeros(len(want), np.int32)
    o = np.lexsort((tag, want, cluster))
    keep = np.zeros(len(want), bool)
    good = o[sid[o] == want[o]]
    keep[good[np.concatenate([[True], (want[good][1:] != want[good][:-1]) | (cluster[good][1:] != cluster[good][:-1]) | (tag[good][1:] != tag[good][:-1])])]] = True if len(good) else False
    to = np.cumsum(keep) - 1
    sel = keep[row]
    return cell.filter(pa.array(keep)), to[row[sel]], h[sel]


def _confirm(size: int, num: int, den: int):
    """Components of the true links inside each (cluster, block) of a cell."""

    def confirm(cell: pa.Table) -> pa.Table:
        cell, row, h = _load(cell, size)
        cluster, block, sid = cell["cluster"].to_numpy(), cell["block"].to_numpy(), cell["sid"].to_numpy()
        o = np.lexsort((sid, block, cluster))
        rank = np.empty(len(o), np.int64)
        rank[o] = np.arange(len(o))
        by = np.argsort(rank[row], kind="stable") if len(row) else np.zeros(0, np.int64)
        row, h = rank[row][by], h[by]
        cluster, block, sid = cluster[o], block[o], sid[o]
        new = np.concatenate([[True], (cluster[1:] != cluster[:-1]) | (block[1:] != block[:-1])]) if len(o) else np.zeros(0, bool)
        begin = np.concatenate([np.flatnonzero(new), [len(o)]])
        cut_at = np.searchsorted(row, begin)
        comp = np.empty(len(o), np.int64)
        for k in range(len(begin) - 1):
            a, b = begin[k], begin[k + 1]
            comp[a:b] = sid[a:b][_Sets(row[cut_at[k] : cut_at[k + 1]] - a, h[cut_at[k] : cut_at[k + 1]], b - a).search(num, den)]
        return pa.table({"cluster": pa.array(cluster), "block": pa.array(block), "sid": pa.array(sid), "comp": pa.array(comp)})

    return confirm


def _across(size: int, num: int, den: int):
    """True links between the outsiders (tag 1) and the members (tag 0) of a block."""

    def across(cell: pa.Table) -> pa.Table:
        cell, row, h = _load(cell, size)
        tag, sid, cluster, block = (cell[c].to_numpy() for c in ("tag", "sid", "cluster", "block"))
        by = np.argsort(row, kind="stable")
        sets = _Sets(row[by], h[by], len(sid))
        a, b = [], []
        for i in np.flatnonzero(tag == 1):
            other = np.flatnonzero((tag == 0) & (cluster == cluster[i]) & (block == block[i]) & (sid != sid[i]))
            hit = other[sets.linked(int(i), other, num, den)]
            a.append(np.full(len(hit), sid[i]))
            b.append(sid[hit])
        return pa.table({"a": pa.array(np.concatenate(a) if a else np.zeros(0, np.int64)), "b": pa.array(np.concatenate(b) if b else np.zeros(0, np.int64))})

    return across


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: tuple[int, int] = (80, 100), bands: int = 18, rows: int = 3, keep_share: float = 0.5, hot_rows: int = 20_000, cell_rows: int = 60_000, cluster_bytes: int = 16 << 20, cell_bytes: int = 4 << 20) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id (the smallest id that
    links reach), kept (the row has that smallest id); text_hash and component, a number of its
    own for each component, null without shingles."""
    num, den = similarity
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("tid", F.xxhash64("text"))
    signed = cut(own.mapInArrow(_signatures(shingle, bands, rows), "doc_id long, tid long, n_bytes long, sid long, n_shingles long, keys array<long>, sig binary"))
    full = signed.where("n_shingles > 0")
    nodes = full.where("doc_id IS NOT NULL").groupBy("sid").agg(F.min(F.struct("doc_id", "tid")).alias("least"), F.max("n_bytes").alias("n_bytes"), F.first("keys").alias("keys"), F.first("sig").alias("sig"))
    nodes = cut(nodes.select("sid", "least.doc_id", "least.tid", "n_bytes", "keys", "sig"))
    n = nodes.count()

    # tables
    keyed = nodes.select("sid", "sig", F.explode("keys").alias("band"))
    heavy = nodes.select(F.explode("keys").alias("band")).groupBy("band").count().where(F.col("count") > hot_rows)
    known = heavy.limit(10_001).collect() if n > hot_rows else []
    cells = max(1, -(-n * bands // cell_rows))
    if known:
        few = len(known) <= 10_000
        side = docs.sparkSession.createDataFrame([tuple(r) for r in known], "band long, count long") if few else heavy
        keyed = keyed.join(F.broadcast(side) if few else side, "band", "left")
    else:
        keyed = keyed.withColumn("count", F.lit(None).cast("long"))
    keyed = keyed.select("sid", "sig", "band", F.col("count").isNotNull().alias("hot"), F.pmod(F.xxhash64("band", F.when(F.col("count").isNotNull(), F.pmod(F.xxhash64("sid"), F.ceil(F.col("count") / hot_rows))).otherwise(F.lit(0).cast("long"))), F.lit(cells)).cast("int").alias("cell"))
    links = keyed.groupBy("cell").applyInArrow(_tables(bands, rows, keep_share), "key long, a long, b long")
    if known:
        links = cut(links)
        centres = links.where("key IS NOT NULL").select("key", "a").distinct()
        joined = centres.join(centres.groupBy("key").agg(F.min("a").alias("b")), "key").select("a", "b")
        links = links.where("key IS NULL").select("a", "b").union(joined)
    clusters = components(links.where("b IS NOT NULL").select("a", "b"))

    # confirmation on full sets
    members = cut(clusters.withColumnRenamed("node", "sid").withColumnRenamed("least", "cluster").join(nodes.select("sid", "doc_id", "tid", "n_bytes"), "sid"))
    blocks = members.groupBy("cluster").agg(F.ceil(F.sum("n_bytes") / cluster_bytes).alias("blocks"))
    total = members.agg(F.sum("n_bytes")).first()[0] or 0
    spread = max(1, total // cell_bytes + 1)
    placed = members.join(blocks, "cluster").withColumn("block", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("sid"), F.col("blocks"))).otherwise(0).cast("int")).join(own, ["doc_id", "tid"])
    celled = placed.select("cluster", "block", "sid", "text", F.pmod(F.xxhash64("cluster", "block"), F.lit(spread)).cast("int").alias("cell"))
    found = cut(celled.groupBy("cell").applyInArrow(_confirm(shingle, num, den), "cluster long, block int, sid long, comp long"))
    comp = found.select("sid", "comp")
    split = found.where("block > 0").select("cluster").distinct()
    if not split.isEmpty():
        comp = _join_blocks(found.join(split, "cluster"), found, members, own, shingle, num, den)

    # back to documents
    label = signed.select("doc_id", "tid", "sid", "n_shingles").join(comp, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    least = label.where("n_shingles > 0").groupBy("comp").agg(F.min("doc_id").alias("least"))
    out = label.join(least, "comp", "left")
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.col("least"))).otherwise(F.col("doc_id"))
    own_group = F.when(F.col("n_shingles") > 0, F.col("comp")).alias("component")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("tid").alias("text_hash"), own_group).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, and of the smallest text
    hash where an id is repeated; of equal rows of one id and text, one.  Rows without shingles
    (null, empty texts) or without an id all stay."""
    found = cut(near_duplicates(docs, id_col, text_col, **limits).where("component IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id", "text_hash", "component").count())
    first = found.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("first")).select("component", F.col("first.doc_id").alias("first_id"), F.col("first.text_hash").alias("first_hash"))
    marked = found.join(first, "component").select("doc_id", "text_hash", "count", ((F.col("doc_id") != F.col("first_id")) | (F.col("text_hash") != F.col("first_hash"))).alias("lost"))
    mark = "_" * (2 + max((len(c) - len(c.lstrip("_")) for c in docs.columns), default=0))
    ident, kept = f"{mark}id", [f"`{c}`" for c in docs.columns]
    keyed = docs.select(*kept, F.col(id_col).cast("long").alias(ident), F.xxhash64(F.col(text_col).cast("string")).alias(mark))
    gone = cut(marked.where("lost OR count > 1").select(F.col("doc_id").alias(ident), F.col("text_hash").alias(mark), "lost"))
    rest = keyed.join(gone.drop("lost"), [ident, mark], "left_anti").select(*kept)
    twice = gone.where("NOT lost").drop("lost")
    if twice.isEmpty():
        return rest
    return rest.union(keyed.join(twice, [ident, mark], "left_semi").dropDuplicates([ident, mark]).select(*kept))


def _join_blocks(parts: DataFrame, found: DataFrame, members: DataFrame, own: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """Joins the components of clusters that were searched in blocks."""
    texts = members.select("sid", "doc_id", "tid").join(own, ["doc_id", "tid"]).select("sid", "text")
    size = parts.groupBy("cluster", "block", "comp").count()
    main = size.groupBy("cluster", "block").agg(F.max_by("comp", F.struct("count", -F.col("comp"))).alias("comp"))
    heads = main.select("cluster", F.lit(0).alias("block"), F.col("comp").alias("sid")).join(texts, "sid").withColumn("cell", F.pmod(F.xxhash64("cluster"), F.lit(997)).cast("int"))
    met = cut(heads.groupBy("cell").applyInArrow(_confirm(shingle, num, den), "cluster long, block int, sid long, comp long"))
    joined = met.selectExpr("sid AS a", "comp AS b")
    # the largest joined component of a cluster; all that is outside it is compared with every block
    head = met.select(F.col("sid").alias("comp"), F.col("comp").alias("top"))
    tops = size.join(head, "comp", "left").withColumn("top", F.coalesce("top", "comp"))
    first = tops.groupBy("cluster", "top").agg(F.sum("count").alias("n")).groupBy("cluster").agg(F.max_by("top", F.struct("n", -F.col("top"))).alias("first"))
    inside = tops.join(first, "cluster").where("top = first").select("cluster", "comp").distinct()
    outside = parts.join(inside, ["cluster", "comp"], "left_anti").select("cluster", "sid")
    counts = outside.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / 1000).alias("chunks"))
    outside = outside.join(counts, "cluster").withColumn("chunk", F.pmod(F.xxhash64("sid"), F.col("chunks")))
    blocks = parts.select("cluster", "block").distinct()
    probe = outside.join(blocks, "cluster").select("cluster", "block", "chunk", "sid", F.lit(1).alias("tag"))
    base = parts.join(counts, "cluster").select("cluster", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), "sid", F.lit(0).alias("tag"))
    cell = probe.union(base).join(texts, "sid").withColumn("cell", F.xxhash64("cluster", "block", "chunk"))
    links = cell.groupBy("cell").applyInArrow(_across(shingle, num, den), "a long, b long")
    comp_of = parts.select("sid", "comp")
    lifted = links.join(comp_of.selectExpr("sid AS a", "comp AS ca"), "a").join(comp_of.selectExpr("sid AS b", "comp AS cb"), "b").selectExpr("ca AS a", "cb AS b").distinct()
    top = components(lifted.union(joined))
    return found.select("sid", "comp").join(top.selectExpr("node AS comp", "least"), "comp", "left").select("sid", F.coalesce("least", "comp").alias("comp"))

"""Operator 5, SimHash near-dedup over vantage-point trees.

A document's fingerprint has the majority bit of the XXH64 of its word shingles. Distinct
fingerprints are partitioned by Hamming distance: a small tree of vantage points, whose radii are
quantiles of a bounded sample, sends every fingerprint to one home shard, and as a query to the
shards with a higher number whose region its search ball overlaps (triangle inequality). A shard
builds a vantage-point tree of its own points and finds every pair within the radius exactly. It
joins what it finds and emits a spanning forest, never all pairs of a group; components over the
forests follow from alternating star contractions on tables in the shared folder.

Defined cases: texts that are null or without words have fingerprint zero and link like any other;
fewer words than a shingle make one shingle; repeated rows and ids are each a row of the result; a
component's id is the smallest non-null id in it, null if it has none; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import hashing as H
from .components import components

SHINGLE = 3
SEED = 42
RADIUS = 2
#: Distinct fingerprints that a shard holds on average, and the sample that the radii come from: in all at
#: least, for each shard, and in all at most (8 bytes each on the driver).
SHARD_POINTS = 20_000
SAMPLE_POINTS, SHARD_SAMPLE, MOST_SAMPLE = 20_000, 128, 1 << 22
#: Points tried as a vantage point above the shards, and points that judge them.
TRIED, JUDGES = 16, 256
LEAF = 48
#: Comparisons of a query block with a leaf that are made at a time.
BLOCK = 1 << 22
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingles_of(data: np.ndarray, offsets: np.ndarray, shingle: int):
    """By slices of the joined texts: the first text, the number of shingles of each, and the hashes of all."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    for lo, hi in _slices(offsets):
        part = LOWER[data[offsets[lo] : offsets[hi]]]
        at = offsets[lo : hi + 1] - offsets[lo]
        inside = ~H.IS_SPACE[part]
        edge = np.zeros(len(part) + 1, bool)
        edge[at] = True
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last[:-1] &= ~inside[1:] | edge[1:-1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        if not len(start):
            continue
        doc = np.searchsorted(at, start, side="right") - 1
        # words joined by single spaces: a shingle is then a slice of this text
        size = end - start
        word_end = np.cumsum(size + 1) - 1
        word_start = word_end - size
        take = np.repeat(start - word_start, size + 1) + np.arange(word_end[-1] + 1)
        text = np.append(part, np.uint8(0x20))[np.minimum(take, len(part))]
        text[word_end] = 0x20
        text = text.tobytes()
        words = np.bincount(doc, minlength=hi - lo)
        begin = np.concatenate([[0], np.cumsum(words)])
        n_shingles = np.where(words > 0, np.maximum(1, words - shingle + 1), 0)
        offset = np.arange(n_shingles.sum()) - np.repeat(np.cumsum(n_shingles) - n_shingles, n_shingles)
        i = np.repeat(begin[:-1], n_shingles) + offset
        j = i + np.repeat(np.minimum(words, shingle), n_shingles) - 1
        yield lo, n_shingles, np.fromiter((digest(text[a:b], SEED) for a, b in zip(word_start[i].tolist(), word_end[j].tolist())), np.uint64, len(i))


def majorities(n_shingles: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The majority bits of each text's hashes; zero for a text without any."""
    out = np.zeros(len(n_shingles), np.uint64)
    shifts = np.arange(64, dtype=np.uint64)
    full = np.flatnonzero(n_shingles)
    where = np.cumsum(n_shingles)[full] - n_shingles[full]
    for a in range(0, len(full), 512):
        b = min(len(full), a + 512)
        to = where[b] if b < len(full) else len(hashes)
        for x, y, d in _long(where[a:b], to, full[a:b]):
            ones = np.add.reduceat(np.unpackbits(hashes[x[0] : y].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), x - x[0], axis=0, dtype=np.int32)
            bits = ones * 2 > n_shingles[d][:, None]
            out[d] = (bits.astype(np.uint64) << shifts).sum(axis=1, dtype=np.uint64)
    return out


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each of the joined texts."""
    out = np.zeros(len(offsets) - 1, np.uint64)
    for lo, n_shingles, hashes in shingles_of(data, offsets, shingle):
        out[lo : lo + len(n_shingles)] = majorities(n_shingles, hashes)
    return out


def _slices(offsets: np.ndarray, size: int = 1 << 18):
    """Runs of documents of about size bytes."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size)) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def _long(where: np.ndarray, end: int, docs: np.ndarray, most: int = 1 << 16):
    """Cut documents into runs of about `most` shingles."""
    lo = 0
    while lo < len(where):
        hi = max(lo + 1, int(np.searchsorted(where, where[lo] + most)))
        yield where[lo:hi], int(where[hi]) if hi < len(where) else end, docs[lo:hi]
        lo = hi


def hamming(a, b) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


class VantageTree:
    """An exact index of distinct 64-bit points under Hamming distance."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.leaf = points, leaf
        self.nodes: list[tuple] = []
        self._build(np.arange(len(points)))

    def _build(self, members: np.ndarray) -> int:
        at = len(self.nodes)
        if len(members) <= self.leaf:
            self.nodes.append((None, members))
            return at
        vantage = self.points[members[len(members) // 2]]
        d = hamming(self.points[members], vantage)
        radius = int(np.median(d))
        inner = d <= radius
        if inner.all():
            radius = int(d.max()) - 1
            inner = d <= radius
        if inner.all() or not inner.any():
            self.nodes.append((None, members))
            return at
        self.nodes.append(())
        near, far = self._build(members[inner]), self._build(members[~inner])
        self.nodes[at] = (vantage, radius, near, far)
        return at

    def pairs(self, queries: np.ndarray, radius: int):
        """Batches (index of query, index of point) of all pairs within radius."""
        todo = [(0, np.arange(len(queries)))] if len(self.points) else []
        while todo:
            at, q = todo.pop()
            node = self.nodes[at]
            if not len(q):
                continue
            if node[0] is None:
                members = node[1]
                step = max(1, BLOCK // len(members))
                for a in range(0, len(q), step):
                    x, y = np.nonzero(np.bitwise_count(queries[q[a : a + step], None] ^ self.points[members][None, :]) <= radius)
                    if len(x):
                        yield q[a : a + step][x], members[y]
                continue
            vantage, bound, near, far = node
            d = hamming(queries[q], vantage)
            todo.append((near, q[d <= bound + radius]))
            todo.append((far, q[d > bound - radius]))


class Forest:
    """Union-find over array positions; keeps an edge where two trees met."""

    def __init__(self, n: int):
        self.up = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def roots(self, x: np.ndarray) -> np.ndarray:
        up = self.up
        r = up[x]
        while True:
            s = up[r]
            if (s == r).all():
                up[x] = r
                return r
            r = s

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.roots(a), self.roots(b)
            open_ = x != y
            a, b = a[open_], b[open_]
            if not len(a):
                return
            low, high = np.minimum(x, y)[open_], np.maximum(x, y)[open_]
            high, first = np.unique(high, return_index=True)
            self.up[high] = low[first]
            self.edges += zip(a[first].tolist(), b[first].tolist())


def widest(pts: np.ndarray) -> np.uint64:
    """Of some of the points the one whose distances spread most: its ball cuts the fewest others."""
    tried = pts[np.linspace(0, len(pts) - 1, min(TRIED, len(pts))).astype(int)]
    judges = pts[np.linspace(0, len(pts) - 1, min(JUDGES, len(pts))).astype(int)]
    return tried[hamming(tried[:, None], judges[None, :]).astype(float).var(axis=1).argmax()]


def shard_tree(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Vantage points and radii of the levels above the shards, in heap order."""
    vantages, radii = np.zeros(2**depth, np.uint64), np.zeros(2**depth, np.int16)
    members = {1: sample}
    for at in range(1, 2**depth):
        pts = members.pop(at, np.empty(0, np.uint64))
        vantage = widest(pts) if len(pts) else np.uint64(0)
        d = hamming(pts, vantage)
        radius = int(np.median(d)) if len(d) else 32
        if len(d) and (d <= radius).all():
            radius = int(d.max()) - 1
        vantages[at], radii[at] = vantage, radius
        members[2 * at], members[2 * at + 1] = pts[d <= radius], pts[d > radius]
    return vantages, radii


def dealt(points: np.ndarray, nodes: tuple[np.ndarray, np.ndarray], depth: int, radius: int):
    """(index, shard, is home) of each point in its home shard and the later shards that its ball meets.

    All points go down the tree together, a level at a time, so the work is in proportion to the rows that are dealt.
    """
    vantages, bounds = nodes
    i, at, home = np.arange(len(points)), np.ones(len(points), np.int64), np.ones(len(points), bool)
    for _ in range(depth):
        d, bound = hamming(points[i], vantages[at]), bounds[at]
        inner, near, far = d <= bound, d <= bound + radius, d > bound - radius
        i, home = np.concatenate([i[near], i[far]]), np.concatenate([home[near] & inner[near], home[far] & ~inner[far]])
        at = np.concatenate([2 * at[near], 2 * at[far] + 1])
    own = np.empty(len(points), np.int64)
    own[i[home]] = at[home]
    kept = home | (own[i] < at)
    return i[kept], at[kept], home[kept]


def replication(points: DataFrame, radius: int = RADIUS) -> float:
    """Rows that are dealt to shards for each of the distinct points: 1 would be home shards alone."""
    nodes, depth = region_tree(points)

    def count(it):
        import pyarrow as pa

        n = sum(len(dealt(b.column(0).to_numpy().view(np.uint64), nodes, depth, radius)[0]) for b in it)
        yield pa.record_batch([pa.array([n])], names=["n"])

    return (points.mapInArrow(count, "n long").agg(F.sum("n")).first()[0] or 0) / max(1, points.count())


def _joined(col) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of an Arrow column of texts; null texts are empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    col = pc.fill_null(col, b"").cast(pa.large_binary())
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[: offsets[-1]] if raw is not None else np.empty(0, np.uint8)
    return data[offsets[0] :], offsets - offsets[0]


def fingerprints(docs: DataFrame, doc_id: str, text: str, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, fp): fp is the fingerprint's 64 bits as a signed long."""

    def batches(it):
        import pyarrow as pa

        for b in it:
            fp = fingerprints_of(*_joined(b.column(2)), shingle) if b.num_rows else np.empty(0, np.uint64)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(fp.view(np.int64))], names=["doc_id", "text_hash", "fp"])
        C.give_back()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(batches, "doc_id long, text_hash long, fp long")


def region_tree(points: DataFrame) -> tuple[tuple[np.ndarray, np.ndarray], int]:
    """The tree above the shards of these points, and its depth."""
    n = points.count()
    depth = max(0, int(np.ceil(np.log2(max(1, n / SHARD_POINTS)))))
    wanted = min(MOST_SAMPLE, max(SAMPLE_POINTS, SHARD_SAMPLE * 2**depth))
    drawn = points.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(min(1.0, wanted / max(n, 1)) * (1 << 30))).limit(2 * wanted).toPandas()["fp"]
    return shard_tree(np.sort(drawn.to_numpy(np.int64)).view(np.uint64), depth), depth


def near_links(points: DataFrame, radius: int = RADIUS) -> DataFrame:
    """points: distinct `fp`. Edges (a, b) that span every group of points linked within radius."""
    nodes, depth = region_tree(points)

    def deal(it):
        import pyarrow as pa

        for b in it:
            fp = b.column(0).to_numpy()
            i, shard, home = dealt(fp.view(np.uint64), nodes, depth, radius)
            yield pa.record_batch([pa.array(shard), pa.array(fp[i]), pa.array(home)], names=["shard", "fp", "home"])

    def link(t):
        import pyarrow as pa

        fp, home = t["fp"].to_numpy().view(np.uint64), t["home"].to_numpy()
        points = np.concatenate([np.sort(fp[home]), np.sort(fp[~home])])
        k = int(home.sum())
        tree, forest = VantageTree(points[:k]), Forest(len(points))
        for q, p in tree.pairs(points, radius):
            apart = q > p
            forest.join(q[apart], p[apart])
        e = np.array(forest.edges, np.int64).reshape(-1, 2)
        e = points.view(np.int64)[e]
        return pa.table({"a": pa.array(e[:, 0]), "b": pa.array(e[:, 1])})

    return points.mapInArrow(deal, "shard long, fp long, home boolean").groupBy("shard").applyInArrow(C.lean(link), "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, fp, group, component_id) for each row of docs; group: a fingerprint that names the component."""
    fps = C.written(fingerprints(docs, doc_id, text, shingle), "fingerprints")
    points = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    edges = C.written(near_links(fps.select("fp").distinct(), radius), "links")
    groups = components(edges)
    # only fingerprints that are linked to others need the detour over their component
    linked = groups.join(points, groups.node == points.fp)
    named = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = groups.join(named, "root").select(F.col("node").alias("fp"), F.col("root").alias("group"), "component_id")
    alone = points.join(groups, points.fp == groups.node, "left_anti").select("fp", F.col("fp").alias("group"), F.col("least").alias("component_id"))
    return fps.join(linked.unionByName(alone), "fp").select("doc_id", "text_hash", "fp", "group", "component_id")


def op5_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(C.table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

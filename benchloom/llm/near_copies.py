"""Near copies for the pipeline: texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

A similarity of 0.8 leaves about 10 of 64 fingerprint bits different and up to 22. Distances between
unrelated texts spread over 32 +- 4 bits, so at that radius the triangle bound of a vantage-point tree
excludes next to nothing and every ball meets every shard: dealing by Hamming regions grows with the
square of the texts. Regions are therefore dealt for the radius of op5, and what is further apart meets in
groups named another way, where SimHash fingerprints and the trees decide again.

1. Equal shingle sets (a 64-bit hash of the set) become one point with its fingerprint, its size and a
   sketch of SKETCH minima.
2. Distinct fingerprints are dealt to the shards of a tree of vantage points by op5's operator, and the
   trees of the shards find every pair within REGION bits: those are candidates, whatever else is known of
   them, and no such pair is lost.
3. Bands of ROWS minima name BANDS groups a point belongs to: a pair at 0.8 shares none of them once in
   38,000 times, a pair at 0.85 once in 2.6 million. In a group, a vantage-point tree over the fingerprints
   finds pairs within RADIUS bits; those whose sizes and sketches allow 0.8 are candidates (a pair at 0.8
   fails once in 100,000). A group emits a spanning forest of them. Groups over GROUP points are not
   collected: all their points are tied to the smallest one. Components of the edges of 2 and 3, the
   clusters, hold every pair that may be similar, and perhaps more.
4. A point's shingles are sent once to its cluster, where all pairs are compared exactly by products of
   incidence matrices. A cluster of over TILE points is compared in tiles, each with PIVOTS points that all
   tiles share; what is then still apart from the cluster's largest component is compared with all of it,
   tile by tile, so the price is quadratic only in the points that the pivots leave apart.

Defined cases: texts that are null or have no words have the empty set and are copies of each other;
fewer words than a shingle make one shingle; rows with equal ids and texts can't be told apart; other
columns are ignored; an empty table has no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import hashing as H
from .components import components
from .simhash import RADIUS as REGION
from .simhash import Forest, VantageTree, _joined, majorities, near_links, shingles_of

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 22
BANDS, ROWS = 20, 4
#: Minima in a sketch (one byte of each is kept), and how many of them a pair must share.
SKETCH, AGREE = 64, 36
#: Points that one task collects: of a band's group, and of a cluster.
GROUP, TILE = 2048, 1024
PIVOTS = 64
LEAF = 256
#: Cells of an incidence matrix that are multiplied at a time.
CELLS = 1 << 21


def sets_of(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE):
    """shingles_of() without repetitions inside a text, sorted."""
    for lo, n_shingles, hashes in shingles_of(data, offsets, shingle):
        doc = np.repeat(np.arange(len(n_shingles)), n_shingles)
        order = np.lexsort((hashes, doc))
        doc, hashes = doc[order], hashes[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
        yield lo, np.bincount(doc[new], minlength=len(n_shingles)), hashes[new]


def minima(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """For each run of hashes that starts at begin, its minima under BANDS * ROWS scramblings."""
    out = np.empty((len(begin), BANDS * ROWS), np.uint64)
    for k, odd in enumerate(H.noise(BANDS * ROWS, 5) | np.uint64(1)):
        out[:, k] = np.minimum.reduceat((hashes ^ odd) * odd, begin)
    return out


def sketches_of(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, ...]:
    """(key, fingerprint, size, sketch, bands) of the shingle set of each of the joined texts; equal sets have equal keys."""
    n = len(offsets) - 1
    key, fp, size = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, np.int32)
    sketch, bands = np.zeros((n, SKETCH), np.uint8), np.zeros((n, BANDS), np.uint64)
    weights = H.noise(ROWS, 9) | np.uint64(1)
    for lo, count, hashes in sets_of(data, offsets, shingle):
        full = np.flatnonzero(count)
        if not len(full):
            continue
        begin = (np.cumsum(count) - count)[full]
        size[lo : lo + len(count)] = count
        fp[lo : lo + len(count)] = majorities(count, hashes)
        key[lo + full] = H.mixed(np.add.reduceat(H.mixed(hashes), begin) + count[full].astype(np.uint64))
        least = H.mixed(minima(hashes, begin))
        sketch[lo + full] = (least[:, :SKETCH] & np.uint64(255)).astype(np.uint8)
        bands[lo + full] = H.mixed((least.reshape(-1, BANDS, ROWS) * weights).sum(axis=2) + np.arange(BANDS, dtype=np.uint64))
    return key, fp, size, sketch, bands


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).cast("binary").alias("text"))


def sketches(docs: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """(doc_id, text_hash, key, fp, size, sketch, bands) of each row's shingle set."""

    def batches(it):
        import pyarrow as pa

        for b in it:
            if b.num_rows:
                key, fp, size, sketch, bands = sketches_of(*_joined(b.column(2)), shingle)
                packed = pa.array(sketch.view(f"V{SKETCH}").ravel().tolist(), pa.binary())
                at = pa.array(np.arange(0, (len(key) + 1) * BANDS, BANDS, dtype=np.int32))
                named = pa.ListArray.from_arrays(at, pa.array(bands.view(np.int64).ravel()))
                yield pa.record_batch([b.column(0), b.column(1), pa.array(key.view(np.int64)), pa.array(fp.view(np.int64)), pa.array(size), packed, named], names=["doc_id", "text_hash", "key", "fp", "size", "sketch", "bands"])
        C.give_back()

    return _rows(docs, doc_id, text).mapInArrow(batches, "doc_id long, text_hash long, key long, fp long, size int, sketch binary, bands array<long>")


def region_links(points: DataFrame) -> DataFrame:
    """points: distinct key with fp and size. Edges (a, b) that span the points linked by REGION or fewer bits."""
    points = points.where("size > 0")
    named = C.written(points.groupBy("fp").agg(F.min("key").alias("least")), "regions")
    same = points.join(named, "fp").where(F.col("key") != F.col("least")).select(F.col("key").alias("a"), F.col("least").alias("b"))
    ends = [named.select(F.col("fp").alias(x), F.col("least").alias(f"least_{x}")) for x in "ab"]
    links = near_links(named.select("fp"), REGION).join(ends[0], "a").join(ends[1], "b")
    return links.select(F.col("least_a").alias("a"), F.col("least_b").alias("b")).unionByName(same)


def candidates(points: DataFrame, similarity: float) -> DataFrame:
    """points: distinct key with fp, size, sketch and bands. Edges (a, b) that span every group of possible copies."""
    named = points.where("size > 0").select("key", F.explode("bands").alias("band"))
    # groups of one say nothing; those of many are tied to their smallest point instead of being collected
    sizes = named.groupBy("band").agg(F.count("*").alias("n"), F.min("key").alias("least")).where("n > 1")
    placed = C.written(named.join(sizes, "band"), "bands")
    tied = placed.where((F.col("n") > GROUP) & (F.col("key") != F.col("least"))).select(F.col("key").alias("a"), F.col("least").alias("b")).distinct()

    def pair(t):
        import pyarrow as pa

        t = t.sort_by([("band", "ascending"), ("key", "ascending")]).combine_chunks()
        band, key, fp, size = (t[c].to_numpy() for c in ("band", "key", "fp", "size"))
        fp = fp.view(np.uint64)
        sketch = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(-1, SKETCH)
        forest = Forest(len(key))
        ends = np.append(np.flatnonzero(band[1:] != band[:-1]) + 1, len(band))
        for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist()):
            part = fp[lo:hi]
            for q, p in VantageTree(part, LEAF).pairs(part, RADIUS):
                q, p = q + lo, p + lo
                fits = (q > p) & (np.minimum(size[q], size[p]) >= similarity * np.maximum(size[q], size[p]))
                q, p = q[fits], p[fits]
                for a in range(0, len(q), 1 << 16):  # sketches of so many pairs at a time
                    x, y = q[a : a + (1 << 16)], p[a : a + (1 << 16)]
                    agree = (sketch[x] == sketch[y]).sum(axis=1) >= AGREE
                    forest.join(x[agree], y[agree])
        e = np.array(forest.edges, np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(key[e[:, 0]]), "b": pa.array(key[e[:, 1]])})

    some = placed.where(F.col("n") <= GROUP).select("key", "band")
    bins = max(1, some.count() // (2 * GROUP))  # many groups are few points each: a call takes several
    some = some.join(points.select("key", "fp", "size", "sketch"), "key").withColumn("bin", F.pmod("band", F.lit(bins)))
    found = some.groupBy("bin").applyInArrow(C.lean(pair), "a long, b long")
    return found.unionByName(tied).distinct()


def similar_pairs(sizes: np.ndarray, hashes: np.ndarray, similarity: float, forest: Forest) -> None:
    """Joins in forest all pairs of sets whose similarity is reached; sets are joined in one array of hashes."""
    n = len(sizes)
    _, column, count = np.unique(hashes, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), sizes)
    shared = count[column] > 1
    row, column = row[shared], column[shared]
    if not len(column):
        return
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((n, n), np.float32)  # counts below 2 ** 24 are exact
    width = max(1, CELLS // n)
    for a in range(0, int(column[-1]) + 1, width):
        lo, hi = np.searchsorted(column, [a, a + width])
        cells = np.zeros((n, min(width, int(column[-1]) + 1 - a)), np.float32)
        cells[row[lo:hi], column[lo:hi] - a] = 1
        common += cells @ cells.T
    size = sizes.astype(np.float64)
    x, y = np.nonzero(np.triu(common, 1) > 0)
    s = common[x, y].astype(np.float64)
    alike = s >= similarity * (size[x] + size[y] - s)
    forest.join(x[alike], y[alike])


def compared(members: DataFrame, bins: int, similarity: float) -> DataFrame:
    """members: tile, key and shingles (packed). Edges (a, b) that span the similar points of each tile; bins: how many groups the tiles share."""

    def link(t):
        import pyarrow as pa
        import pyarrow.compute as pc

        t = t.sort_by([("tile", "ascending"), ("key", "ascending")]).combine_chunks()
        tile, key = t["tile"].to_numpy(), t["key"].to_numpy()
        new = np.append(True, (tile[1:] != tile[:-1]) | (key[1:] != key[:-1]))  # a pivot may stand in a tile of its own, too
        t, tile, key = t.filter(pa.array(new)), tile[new], key[new]
        body = t["shingles"].cast(pa.large_binary()).combine_chunks()
        size = pc.binary_length(body).to_numpy(zero_copy_only=False).astype(np.int64) // 8
        hashes = np.frombuffer(b"".join(body.to_pylist()), np.uint64)
        at = np.concatenate([[0], np.cumsum(size)])
        edges = [np.empty((0, 2), np.int64)]
        ends = np.append(np.flatnonzero(tile[1:] != tile[:-1]) + 1, len(tile)).tolist()
        for lo, hi in zip([0, *ends[:-1]], ends):
            forest = Forest(hi - lo)
            similar_pairs(size[lo:hi], hashes[at[lo] : at[hi]], similarity, forest)
            edges.append(np.array(forest.edges, np.int64).reshape(-1, 2) + lo)
        e = np.concatenate(edges)
        return pa.table({"a": pa.array(key[e[:, 0]]), "b": pa.array(key[e[:, 1]])})

    packed = members.select(F.pmod("tile", F.lit(bins)).alias("bin"), "tile", "key", "shingles")
    return packed.groupBy("bin").applyInArrow(C.lean(link), "a long, b long")


def shingle_sets(asked: DataFrame, docs: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """(key, shingles as packed hashes) of asked: key, doc_id and text_hash of a row that has it."""

    def batches(it):
        import pyarrow as pa

        for b in it:
            if b.num_rows:
                sets = [b""] * b.num_rows
                for lo, count, hashes in sets_of(*_joined(b.column(1)), shingle):
                    at = np.concatenate([[0], np.cumsum(count)])
                    for i in range(len(count)):
                        sets[lo + i] = hashes[at[i] : at[i + 1]].tobytes()
                yield pa.record_batch([b.column(0), pa.array(sets, pa.binary())], names=["key", "shingles"])
        C.give_back()

    asked = C.small(asked.select("key", F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")))
    rows = _rows(docs, doc_id, text)
    texts = rows.join(asked, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash"))).select("key", "text")
    return texts.mapInArrow(batches, "key long, shingles binary").dropDuplicates(["key"])


def confirmed(clusters: DataFrame, points: DataFrame, docs: DataFrame, doc_id: str, text: str, shingle: int, similarity: float) -> DataFrame:
    """clusters: (node, root). Edges (a, b) that span the points of similar sets.

    A tile holds TILE points or as many shingles as TILE ordinary ones, whichever is less.
    """
    asked = points.join(clusters, points.key == clusters.node).select("key", "doc_id", "text_hash", "size", "root")
    asked = C.written(asked.withColumn("weight", 1 + F.col("size") / 1024), "asked")
    sets = C.written(shingle_sets(asked, docs, doc_id, text, shingle), "shingles")
    whole = asked.groupBy("root").agg(F.count("*").alias("n"), F.sum("weight").alias("all"))
    placed = asked.join(whole, "root").withColumn("tiles", F.ceil(F.col("all") / TILE).cast("long"))
    bins = max(1, int((asked.agg(F.sum("weight")).first()[0] or 0) // (2 * TILE)))
    big = placed.where("tiles > 1")
    own = placed.select("key", F.xxhash64("root", F.pmod(F.xxhash64("key"), F.col("tiles"))).alias("tile"))
    pivots = big.where(F.pmod(F.xxhash64("key", F.lit(1)), F.greatest(F.lit(1), F.floor(F.col("n") / PIVOTS))) == 0)
    pivots = pivots.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).select("key", F.xxhash64("root", "i").alias("tile"))
    edges = C.written(compared(own.unionByName(pivots).join(sets, "key"), bins, similarity), "links")
    if big.isEmpty():
        C.forget(asked)
        C.forget(sets)
        return edges
    # what the pivots left apart from the largest part of a big cluster is compared with all of the cluster
    parts = components(edges)
    held = big.select("key", "root", "weight", "all").join(parts.withColumnRenamed("root", "part"), F.col("key") == F.col("node"), "left").withColumn("part", F.coalesce("part", "key")).drop("node")
    held = held_table = C.written(held, "parts")
    main = held.groupBy("root", "part").agg(F.count("*").alias("n")).groupBy("root").agg(F.max_by("part", F.struct("n", "part")).alias("main"))
    held = held.join(main, "root")
    apart = held.where("part <> main")
    held = held.join(apart.groupBy("root").agg(F.sum("weight").alias("left")), "root").withColumns({"rows": F.ceil(2 * F.col("left") / TILE).cast("long"), "columns": F.ceil(2 * F.col("all") / TILE).cast("long")})
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    down = held.where("part <> main").withColumns({"i": F.pmod(F.xxhash64("key"), F.col("rows")), "j": upto("columns")})
    across = held.withColumns({"i": upto("rows"), "j": F.pmod(F.xxhash64("key", F.lit(2)), F.col("columns"))})
    pairs = down.unionByName(across.select(down.columns)).select("key", F.xxhash64("root", "i", "j").alias("tile"))
    edges = edges.unionByName(C.written(compared(pairs.join(sets, "key"), 4 * bins, similarity), "more-links"))
    for table in (asked, sets, held_table):
        C.forget(table)
    return edges


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, text_hash, group) for each row of docs; rows whose shingle sets are similar, or linked by such rows, share a group."""
    rows = C.written(sketches(docs, doc_id, text, shingle), "sketches")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    points = rows.groupBy("key").agg(*[F.min(c).alias(c) for c in ("fp", "size", "sketch", "bands")], F.min(row).alias("row"))
    points = C.written(points.select("key", "fp", "size", "sketch", "bands", "row.doc_id", "row.text_hash"), "points")
    found = region_links(points).unionByName(candidates(points, similarity))
    clusters = C.written(components(C.written(found, "candidates")), "clusters")
    groups = components(confirmed(clusters, points.select("key", "doc_id", "text_hash", "size"), docs, doc_id, text, shingle, similarity))
    out = C.written(rows.join(groups, rows.key == groups.node, "left").select("doc_id", "text_hash", F.coalesce("root", "key").alias("group")), "groups")
    for table in (rows, points, clusters):
        C.forget(table)
    return out

"""Operator 8, embedding near-dedup by PCA-ordered tiled comparison.

Unit vectors are turned into the basis of their principal components, largest first. Two vectors
whose cosine reaches the threshold differ by at most sqrt(2 - 2 * threshold) in any coordinate, so
only vectors in neighbouring cells of the first coordinates meet. A cell is dealt into tiles of
bounded size; a task compares two tiles, block by block: it sums the leading dimensions, bounds the rest by the
product of the suffix norms, and drops a pair as soon as it cannot reach the threshold. Pairs that
remain are decided by the cosine of the vectors as given, in double precision.

A task returns the number of links of each vector and a spanning forest of them, never all pairs.

Defined cases: a null label links with nothing, nor does a vector that is null, empty, zero, too
long for a finite norm, or holds null or non-finite components; vectors of different length do not
link; repeated rows are vectors of their own and link with each other; ids may be null or repeated
(component_id is the smallest non-null id); a null id is kept if no id is in its component.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import components
from .simhash import Forest

THRESHOLD = 0.98
#: Vectors of a tile, which is what travels, and of a block, which is what is multiplied at a time.
TILE, BLOCK = 4096, 1024
#: Leading coordinates that make the cells, and dimensions that are summed at a time.
CELL_DIMS = 2
STEP = 16
SLACK = 1e-9
#: Pairs that are decided at a time.
PAIRS = 1 << 15


def moments(vectors: DataFrame) -> dict[int, np.ndarray]:
    """The principal axes (columns, largest first) of the unit vectors of each length, over all rows.

    What reaches the driver is one d x d matrix for each length d.
    """

    def sums(batches):
        import pyarrow as pa

        total: dict[int, np.ndarray] = {}
        for b in batches:
            for d, x in _by_length(b.column(0)):
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                total[d] = total.get(d, 0) + x.T @ x
        for d, m in total.items():
            yield pa.record_batch([pa.array([d] * d), pa.array(range(d)), pa.array(list(m), pa.list_(pa.float64()))], names=["d", "i", "m"])

    cells = vectors.select("embedding").mapInArrow(sums, "d long, i long, m array<double>")
    cells = cells.select("d", "i", F.posexplode("m").alias("j", "v")).groupBy("d", "i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = {}
    for d, part in cells.groupby("d"):
        m = np.zeros((d, d))
        m[part["i"], part["j"]] = part["v"]
        out[int(d)] = np.linalg.eigh((m + m.T) / 2)[1][:, ::-1]
    return out


def _by_length(column):
    """(d, matrix) of the vectors of an Arrow list column, by their length."""
    sizes = np.array(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    for d in np.unique(sizes):
        yield int(d), flat[starts[sizes == d][:, None] + np.arange(d)].astype(np.float64)


def links_between(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float, same: bool):
    """Index pairs (i, j) with cosine of a[i] and b[j] at or above threshold; i < j if same."""
    x, y = a.astype(np.float64), b.astype(np.float64)
    nx, ny = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))
    p, q = x / nx[:, None] @ axes, y / ny[:, None] @ axes
    d = p.shape[1]
    lead = min(STEP, d)
    rest = lambda m, k: np.sqrt(np.maximum(0, (m[:, k:] ** 2).sum(axis=1)))
    dot = p[:, :lead] @ q[:, :lead].T
    i, j = np.nonzero(dot + np.outer(rest(p, lead), rest(q, lead)) >= threshold - SLACK)
    if same:
        i, j = i[i < j], j[i < j]
    part = dot[i, j]
    while lead < d and len(i):
        to = min(d, lead + STEP)
        for s in range(0, len(i), PAIRS):
            e = slice(s, s + PAIRS)
            part[e] += np.einsum("ij,ij->i", p[i[e], lead:to], q[j[e], lead:to])
        lead = to
        on = part + rest(p, lead)[i] * rest(q, lead)[j] >= threshold - SLACK
        i, j, part = i[on], j[on], part[on]
    exact = np.concatenate([np.einsum("ij,ij->i", x[i[s : s + PAIRS]], y[j[s : s + PAIRS]]) for s in range(0, len(i), PAIRS)]) if len(i) else part
    on = exact / (nx[i] * ny[j]) >= threshold
    return i[on], j[on]


def embedding_links(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE):
    """vectors: node, label, embedding (usable ones only). (links per node, spanning edges)."""
    axes = moments(vectors)
    width = float(np.sqrt(2 - 2 * threshold)) + 1e-6
    real = vectors.schema["embedding"].dataType.elementType.simpleString()
    dtype = np.float32 if real == "float" else np.float64
    label = vectors.schema["label"].dataType.simpleString()

    def place(batches):
        import pyarrow as pa

        for b in batches:
            cell = np.zeros((b.num_rows, CELL_DIMS), np.int64)
            sizes = np.array(b.column(2).value_lengths().to_numpy(zero_copy_only=False), np.int64)
            for d, x in _by_length(b.column(2)):
                u = x / np.linalg.norm(x, axis=1, keepdims=True) @ axes[d][:, :CELL_DIMS]
                cell[np.flatnonzero(sizes == d)[:, None], np.arange(u.shape[1])] = np.floor(u / width)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(sizes), pa.array(cell[:, 0]), pa.array(cell[:, 1]), b.column(2)], names=["node", "label", "d", "ci", "cj", "embedding"])

    key = ["label", "d", "ci", "cj"]
    placed = C.written(vectors.select("node", "label", "embedding").mapInArrow(place, f"node long, label {label}, d long, ci long, cj long, embedding array<{real}>"), "cells")
    counts = placed.groupBy(key).agg(F.ceil(F.count("*") / tile).alias("tiles"))
    tiles = counts.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).drop("tiles")

    def pack(t):
        import pyarrow as pa

        x = t["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(dtype)
        first = {k: [t[k][0].as_py()] for k in ("tile_id", "d")}
        return pa.table({**first, "nodes": pa.array([t["node"].to_numpy().tobytes()], pa.binary()), "body": pa.array([x.tobytes()], pa.binary())})

    packed = placed.join(counts, key).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")))
    packed = packed.withColumn("tile_id", F.to_json(F.struct(*key, "tile"))).groupBy("tile_id").applyInArrow(pack, "tile_id string, d long, nodes binary, body binary")

    # keys of tiles that meet: neighbouring cells of a label, each unordered pair once
    ids = tiles.withColumn("tile_id", F.to_json(F.struct(*key, F.col("tile").cast("long").alias("tile"))))
    around = F.explode(F.expr("flatten(transform(sequence(-1, 1), x -> transform(sequence(-1, 1), y -> struct(ci + x AS ci, cj + y AS cj))))"))
    near = ids.select("label", "d", around.alias("at"), F.col("tile_id").alias("one")).select("label", "d", "at.ci", "at.cj", "one")
    pairs = near.join(ids, key).where("one <= tile_id").select("one", F.col("tile_id").alias("two"))
    pairs = pairs.withColumn("pair", F.concat("one", F.lit(" "), "two"))
    sides = pairs.select("pair", F.col("one").alias("tile_id")).unionByName(pairs.where("one <> two").select("pair", F.col("two").alias("tile_id")))
    dealt = sides.join(packed, "tile_id")

    def compare(t):
        import pyarrow as pa

        tiles = sorted(t.select(["tile_id", "d", "nodes", "body"]).to_pylist(), key=lambda r: r["tile_id"])
        one, two, d = tiles[0], tiles[-1], tiles[0]["d"]
        nodes = [np.frombuffer(x["nodes"], np.int64) for x in (one, two)]
        body = [np.frombuffer(x["body"], dtype).reshape(-1, d) for x in (one, two)]
        same = len(tiles) == 1
        found = [(np.empty(0, np.int64),) * 2]
        for p in range(0, len(body[0]), BLOCK):
            for q in range(p if same else 0, len(body[1]), BLOCK):
                i, j = links_between(body[0][p : p + BLOCK], body[1][q : q + BLOCK], axes[d], threshold, same and p == q)
                found.append((i + p, j + q))
        i, j = (np.concatenate(x) for x in zip(*found))
        n, m = len(nodes[0]), len(nodes[1])
        left, right = np.bincount(i, minlength=n), np.bincount(j, minlength=m)
        count = [(nodes[0], left + right)] if same else [(nodes[0], left), (nodes[1], right)]
        forest = Forest(n if same else n + m)
        forest.join(i, j if same else j + n)
        every = nodes[0] if same else np.concatenate(nodes)
        e = every[np.array(forest.edges, np.int64).reshape(-1, 2)]
        who, links = np.concatenate([c[0] for c in count]), np.concatenate([c[1] for c in count])
        who, links = who[links > 0], links[links > 0]
        a, b = np.concatenate([who, e[:, 0]]), np.concatenate([links, e[:, 1]])
        return pa.table({"is_edge": pa.array(np.arange(len(a)) >= len(who)), "a": pa.array(a), "b": pa.array(b)})

    found = C.written(dealt.groupBy("pair").applyInArrow(compare, "is_edge boolean, a long, b long"), "vector-links")
    links = found.where("not is_edge").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("n_links"))
    return links, found.where("is_edge").select("a", "b")


def usable(embedding: str, label: str):
    x = F.col(embedding)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    total = F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    return F.col(label).isNotNull() & x.isNotNull() & fine & (total > 0) & (total != float("inf"))


def dedup_embeddings(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """(key, n_links, component_id, kept) for each row of vectors."""
    rows = vectors.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(embedding).alias("embedding"))
    rows = C.written(rows.withColumn("node", F.monotonically_increasing_id()), "vectors")  # ids hold from here on
    links, edges = embedding_links(rows.where(F.coalesce(usable("embedding", "label"), F.lit(False))), threshold, tile)
    groups = components(edges)
    mine = rows.select("node", "key").join(links, "node", "left").join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    linked = mine.where("n_links IS NOT NULL").groupBy("root").agg(F.min("key").alias("least"))
    out = mine.join(linked, "root", "left").withColumn("component_id", F.when(F.col("n_links").isNull(), F.col("key")).otherwise(F.col("least")))
    return out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))


def op8_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_embeddings(C.table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_sum(list_transform(embedding, lambda e: abs(e))) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.x, b.x) >= 0.98
), r AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON vec_id = c.a LEFT JOIN n ON vec_id = n.a
"""

"""Operator 11, a Merkle manifest of a dataset with parent-preimage paths.

Every row becomes a leaf, the SHA-256 of its fields; each tree (the rows of one language, say) orders its
leaves, runs of FAN nodes become the hash of their concatenated hashes until one is left, and the trees'
tops, ordered by name, become the root in the same way. What is stored is a row for each parent with its
preimage: the concatenated hashes of its children. A leaf joins the preimages of its ancestors, cuts its
own 64 characters out of each, which leaves the siblings, and splices a replacement in to fold any claimed
leaf up to the root.

Positions come from a range exchange and prefix sums over its partitions, so no task holds a tree. Blocks
of BLOCK consecutive nodes climb HEIGHT levels in one group, and their tops are the nodes of the next
round: one exchange of a shrinking table for each HEIGHT levels. Ancestors above a leaf's block are joined
once for the block and not for each leaf.

Defined cases: a null field is hashed as `-`, apart from every value; a null tree name is a tree of its
own and comes first; leaves ascend by the order column (nulls first), rows that agree in it by leaf hash,
and rows that agree in both are interchangeable; a lone leaf is its tree's top, a lone top the root; an
empty table has no leaves, no parents and no root; columns that are no fields are ignored.
"""

from __future__ import annotations

import functools
import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

FAN = 2
#: Levels that a block climbs in one group, and so FAN ** HEIGHT nodes in it.
HEIGHT = 9
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: The key of a tree: nulls sort first, and equal keys join.
TREE = ["named", "name"]
PARENTS = "named boolean, name string, level int, index long, preimage string"


def field(value: Column) -> Column:
    """`-` for null, else the value's UTF-8 byte count, `:` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with `index`, their place from 0 in their tree, and `size`, the rows of their tree."""
    at = F.shiftright("__at", 33).alias("part")
    # the number of a row holds its partition and its place there; written once, both stay
    placed = C.written(rows.repartitionByRange(*TREE, *order).sortWithinPartitions(*TREE, *order).withColumn("__at", F.monotonically_increasing_id()), name)
    runs = placed.groupBy(*TREE, at).agg(F.min("__at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy(TREE).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*TREE, "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(Window.partitionBy(TREE)).alias("size"))
    return placed.withColumn("part", at).join(C.small(runs), [*TREE, "part"]).withColumn("index", F.col("__at") + F.col("shift")).drop("__at", "part", "shift")


def depth_of(size: Column, fan: int, at_most: int = 64) -> Column:
    """Levels above the leaves of a tree of so many, in whole numbers."""
    # powers beyond 2 ** 62 exceed any size
    powers = [fan**i for i in range(at_most) if fan**i < 1 << 62]
    return sum(((size > p).cast("int") for p in powers[1:]), (size > 1).cast("int"))


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _climber(fan: int, height: int, base: int):
    """A block's nodes to the preimages of all parents above them, up to height levels or the tree's top."""

    def climb(table):
        import pyarrow as pa

        t = table.sort_by("index")
        named, name, depth = t["named"][0].as_py(), t["name"][0].as_py(), t["depth"][0].as_py()
        nodes, first = t["hash"].to_pylist(), t["index"][0].as_py()
        levels, places, preimages = [], [], []
        for level in range(base + 1, min(base + height, depth) + 1):
            made = ["".join(nodes[i : i + fan]) for i in range(0, len(nodes), fan)]
            first //= fan
            levels += [level] * len(made)
            places += range(first, first + len(made))
            preimages += made
            nodes = list(map(_digest, made))
        n = len(levels)
        return pa.table({"named": pa.array([named] * n, pa.bool_()), "name": pa.array([name] * n, pa.string()), "level": pa.array(levels, pa.int32()), "index": pa.array(places, pa.int64()), "preimage": pa.array(preimages, pa.string())})

    return climb


def build(leaves: DataFrame, name: str, fan: int = FAN, height: int = HEIGHT) -> tuple[DataFrame, DataFrame]:
    """leaves: named, name, index, size, hash. The parents' preimages, and (named, name, size, depth, top) of each tree."""
    nodes = leaves.select(*TREE, "index", "hash", "size", depth_of(F.col("size"), fan).alias("depth"))
    trees = nodes.where("index = 0").select(*TREE, "size", "depth", F.col("hash").alias("lone"))
    trees = C.written(trees, f"{name}-trees")
    deepest = trees.agg(F.max("depth")).first()[0] or 0
    made, base = [], 0
    block = F.floor(F.col("index") / F.lit(fan**height)).alias("block")
    while base < deepest:
        grouped = nodes.where(F.col("depth") > base).select(*TREE, "index", "hash", "depth", block).groupBy(*TREE, "block")
        made.append(C.written(grouped.applyInArrow(_climber(fan, height, base), PARENTS), f"{name}-parents"))
        base += height
        above = made[-1].where(F.col("level") == base).select(*TREE, "index", F.sha2("preimage", 256).alias("hash"))
        nodes = above.join(C.small(trees.select(*TREE, "depth")), TREE)
    none = leaves.sparkSession.range(0).select(F.lit(True).alias("named"), F.lit("").alias("name"), F.lit(0).alias("level"), F.col("id").alias("index"), F.lit("").alias("preimage"))
    parents = functools.reduce(DataFrame.unionByName, made) if made else none
    tops = parents.select(*TREE, F.col("level").alias("depth"), F.sha2("preimage", 256).alias("top"), "index").where("index = 0").drop("index")
    return parents, trees.join(tops, [*TREE, "depth"], "left").select(*TREE, "size", "depth", F.coalesce("top", "lone").alias("top"))


def _joiner(fan: int, height: int):
    """A block's leaves and its ancestors' preimages: the leaves with their siblings and what a claim folds to."""

    def join(leaves, above):
        import pyarrow as pa

        inside, shared = {}, []
        for level, index, slot, preimage in zip(*(above[c].to_pylist() for c in ("level", "index", "slot", "preimage"))):
            if slot is None:
                inside[level, index] = preimage
            else:
                shared.append((level, preimage[: 64 * slot], preimage[64 * slot + 64 :]))
        shared.sort()
        proofs, folds = [], []
        for place, claim in zip(leaves["index"].to_pylist(), leaves["claim"].to_pylist()):
            siblings = []
            for level in range(1, height + 1):
                place, slot = divmod(place, fan)
                preimage = inside.get((level, place))
                if preimage is None:
                    break
                before, after = preimage[: 64 * slot], preimage[64 * slot + 64 :]
                siblings += (before, after)
                claim = _digest(before + claim + after)
            for _, before, after in shared:
                siblings += (before, after)
                claim = _digest(before + claim + after)
            proofs.append("".join(siblings))
            folds.append(claim)
        out = leaves.drop_columns(["block"])
        return out.append_column("siblings", pa.array(proofs, pa.string())).append_column("folded", pa.array(folds, pa.string()))

    return join


def prove(leaves: DataFrame, parents: DataFrame, trees: DataFrame, top_parents: DataFrame, fan: int = FAN, height: int = HEIGHT) -> DataFrame:
    """leaves (named, name, index, size, hash, claim, ...) with siblings, from the leaf's level to the root, and folded.

    trees: named, name, depth, top and rank, their place among the tops; top_parents: the preimages above the tops.
    """
    width = fan**height
    power = lambda k: F.pow(F.lit(float(fan)), k).cast("long")
    over = lambda index, k: F.floor(F.col(index) / power(k)).cast("long")
    block = F.floor(F.col("index") / F.lit(width)).alias("block")
    inside = parents.where(F.col("level") <= height).select(*TREE, over("index", height - F.col("level")).alias("block"), "level", "index", F.lit(None).cast("int").alias("slot"), "preimage")
    blocks = trees.select(*TREE, "depth", "rank", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / F.lit(width)).cast("long"))).alias("block"))
    # an ancestor and the place in it, for each block and level above the block
    step = blocks.where(F.col("depth") > height).withColumn("level", F.explode(F.sequence(F.lit(height + 1), "depth")))
    step = step.withColumns({"index": over("block", F.col("level") - height), "slot": F.pmod(over("block", F.col("level") - height - 1), F.lit(fan)).cast("int")})
    upper = step.join(parents.where(F.col("level") > height), [*TREE, "level", "index"])
    tops = top_parents.select(F.col("level").alias("up"), F.col("index").alias("at"), "preimage")
    final = trees.select(*TREE, "depth", "rank", "size").join(C.small(tops), F.expr(f"at = floor(rank / pow({float(fan)}, up))"))
    final = final.select(*TREE, (F.col("depth") + F.col("up")).alias("level"), "at", F.pmod(over("rank", F.col("up") - 1), F.lit(fan)).cast("int").alias("slot"), "preimage", "size")
    final = final.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / F.lit(width)).cast("long"))))
    names = [*TREE, "block", "level", "index", "slot", "preimage"]
    above = inside.select(names).unionByName(upper.select(names)).unionByName(final.select(*TREE, "block", "level", F.col("at").alias("index"), "slot", "preimage"))
    left = leaves.withColumn("block", block)
    schema = left.drop("block").withColumns({"siblings": F.lit(""), "folded": F.lit("")}).schema
    return left.groupBy(*TREE, "block").cogroup(above.groupBy(*TREE, "block")).applyInArrow(_joiner(fan, height), schema)


def manifest(docs: DataFrame, claim: Column | None = None, fields: list[str] = FIELDS, tree: str = "lang", order: str = "doc_id", fan: int = FAN, height: int = HEIGHT) -> DataFrame:
    """(the order and tree columns, index, leaf, claim, subroot, root, siblings, folded) for each row of docs.

    claim: the leaf that is to be folded, the row's own hash if None. siblings: their hashes, joined.
    """
    own = leaf_hash(*map(F.col, fields))
    named = F.col(tree).isNotNull()
    rows = docs.select(F.col(order).alias("id"), named.alias("named"), F.coalesce(F.col(tree).cast("string"), F.lit("")).alias("name"), own.alias("hash"), (own if claim is None else F.coalesce(claim, own)).alias("claim"), F.monotonically_increasing_id().alias("seq"))
    leaves = C.written(ranked(C.written(rows, "leaves"), ["id", "hash", "seq"], "leaves-ordered"), "leaves-placed")
    parents, trees = build(leaves, "tree", fan, height)
    tops = ranked(C.written(trees, "tops").select(F.lit(True).alias("named"), F.lit("").alias("name"), "depth", F.col("size").alias("tree_size"), F.col("top").alias("hash"), F.struct(*TREE).alias("tree")), ["tree"], "tops-ordered")
    tops = C.written(tops, "tops-placed")
    top_parents, root = build(tops, "root", fan, height)
    trees = tops.select("tree.*", "depth", F.col("tree_size").alias("size"), F.col("index").alias("rank"), F.col("hash").alias("top"))
    proved = prove(leaves, parents, trees, top_parents, fan, height)
    known = C.small(trees.select(*TREE, F.col("top").alias("subroot")))
    root = F.broadcast(root.select(F.col("top").alias("root")))  # one row
    out = proved.join(known, TREE).join(root)
    return out.select(F.col("id").alias(order), F.when(F.col("named"), F.col("name")).alias(tree), "index", F.col("hash").alias("leaf"), "claim", "subroot", "root", "siblings", "folded")


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    other = leaf_hash(*[F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS])
    claim = F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 0, other)
    out = manifest(docs, claim)
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2("siblings", 256).alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


ORACLE = rf"""
WITH RECURSIVE d AS (
  SELECT *, row_number() OVER () AS rn, coalesce({C.CRC32.format("CAST(doc_id AS VARCHAR)")} % 7 = 0, false) AS bad,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM documents
), h AS (
  SELECT rn, doc_id, lang, lang IS NOT NULL AS named, coalesce(lang, '') AS name, bad, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') || tail) AS leaf,
         sha256(head || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || CAST(n_chars + 1 AS VARCHAR), '-') || tail) AS other
  FROM d
), l AS (SELECT *, row_number() OVER (PARTITION BY named, name ORDER BY doc_id NULLS FIRST, leaf, rn) - 1 AS i FROM h),
nodes AS (
  SELECT named, name, 0 AS level, i, leaf AS hash FROM l
  UNION ALL
  SELECT named, name, level + 1, i // 2, sha256(string_agg(hash, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY named, name) AS n FROM nodes) WHERE n > 1 GROUP BY named, name, level, i // 2
), tops AS (
  SELECT named, name, level AS depth, hash, row_number() OVER (ORDER BY named, name) - 1 AS r FROM (SELECT *, max(level) OVER (PARTITION BY named, name) AS depth FROM nodes) WHERE level = depth
), above AS (
  SELECT 0 AS level, r AS i, hash FROM tops
  UNION ALL
  SELECT level + 1, i // 2, sha256(string_agg(hash, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () AS n FROM above) WHERE n > 1 GROUP BY level, i // 2
), walk AS (
  SELECT rn, named, name, 0 AS level, i, '' AS proof, CASE WHEN bad THEN other ELSE leaf END AS fold FROM l
  UNION ALL
  SELECT rn, w.named, w.name, w.level + 1, w.i // 2, proof || coalesce(s.hash, ''), sha256(CASE WHEN w.i % 2 = 1 THEN s.hash || fold ELSE fold || coalesce(s.hash, '') END)
  FROM walk w JOIN tops t ON t.named = w.named AND t.name = w.name AND w.level < t.depth LEFT JOIN nodes s ON s.named = w.named AND s.name = w.name AND s.level = w.level AND s.i = xor(w.i, 1)
), climb AS (
  SELECT rn, t.hash AS subroot, 0 AS level, t.r AS i, proof, fold FROM walk w JOIN tops t ON t.named = w.named AND t.name = w.name AND w.level = t.depth
  UNION ALL
  SELECT rn, subroot, c.level + 1, c.i // 2, proof || coalesce(s.hash, ''), sha256(CASE WHEN c.i % 2 = 1 THEN s.hash || fold ELSE fold || coalesce(s.hash, '') END)
  FROM climb c LEFT JOIN above s ON s.level = c.level AND s.i = xor(c.i, 1) WHERE c.level < (SELECT max(level) FROM above)
), root AS (SELECT hash AS root FROM above WHERE level = (SELECT max(level) FROM above))
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified
FROM climb JOIN l USING (rn), root WHERE level = (SELECT max(level) FROM above)
"""

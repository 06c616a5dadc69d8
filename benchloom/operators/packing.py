"""Packing token sequences into rows of fixed length, in one order over everything or shard by shard.

A separator stands before an item iff it isn't the first and the tokens so far don't end a row. So all that
an item needs of those before it is their total modulo the row's length, and a run of items is a function
from that remainder to the next one and to the tokens it adds. Such functions compose: blocks of items
make theirs side by side, runs of blocks are composed level by level until one is left, and the starts are handed
down the same way. All this takes lengths only. Then every item knows its first token's place: its chunks are cut
where rows end, and only rows that lie in more than one chunk are put together from their pieces.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchloom.operators.curate import raising, shared_table

#: Items of a block, and functions that are composed into one.
BLOCK_ITEMS = 4096
FAN = 256
#: First tokens of an item that help to name its range where many have the same order.
RANGE_TOKENS = 8
#: Tokens of an item that are stored in one row.
CHUNK_TOKENS = 512


def pack_starts(lengths: np.ndarray, seq_len: int, total: int = 0, first: bool = True) -> tuple[np.ndarray, int]:
    """Where each item begins after `total` tokens, and the tokens then: a separator stands before it iff it isn't the first and the total isn't aligned."""
    starts = np.empty(len(lengths), np.int64)
    for i, n in enumerate(lengths.tolist()):
        total += not (first and i == 0) and total % seq_len != 0
        starts[i] = total
        total += n
    return starts, total


def added(lengths: np.ndarray, seq_len: int) -> np.ndarray:
    """For each remainder from 0 to seq_len - 1: the tokens that the items add, separators included."""
    total = np.arange(seq_len, dtype=np.int64)
    for n in lengths.tolist():
        total += (total % seq_len != 0) + n
    return total - np.arange(seq_len)


def composed(functions: list[np.ndarray], seq_len: int) -> np.ndarray:
    """What `added` is for all the functions' items, in their order."""
    total = np.arange(seq_len, dtype=np.int64)
    for f in functions:
        total += f[total % seq_len]
    return total - np.arange(seq_len)


def _layout(t, names: list[str], starts: np.ndarray, lengths: np.ndarray, begin: int, total: int, separators: list[int]) -> list[np.ndarray]:
    """Each column of a block's rows from `begin` to `total`, separators in between."""
    place = np.arange(lengths.sum()) + np.repeat(starts - begin - (np.cumsum(lengths) - lengths), lengths)
    out = []
    for name, separator in zip(names, separators):
        flat = np.full(total - begin, separator, np.int64)
        flat[place] = t[name].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        out.append(flat)
    return out


def _lengths(t) -> np.ndarray:
    return t["input_ids"].combine_chunks().value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _starts(blocks: DataFrame, seq_len: int) -> DataFrame:
    """blocks: part, block, adds -> part, block, begin: the tokens before each block. One key less at each level."""
    import pyarrow as pa

    def compose(t):
        t = t.sort_by("node")
        adds = composed([np.array(a, np.int64) for a in t["adds"].to_pylist()], seq_len)
        return pa.table({"node": t["parent"].slice(0, 1), "adds": pa.array([adds.tolist()], pa.list_(pa.int64()))})

    def hand_down(t, above):
        t = t.sort_by("node")
        total, begins = above["begin"][0].as_py(), []
        for a in t["adds"].to_pylist():
            begins.append(total)
            total += a[total % seq_len]
        return pa.table({"node": t["node"], "begin": pa.array(begins, pa.int64())})

    # the lowest nodes are blocks, the next ones partitions of the order, then runs of FAN
    levels = [blocks.select(F.struct("part", "block").alias("key"), F.col("block").alias("node"), F.col("part").alias("parent"), "adds")]
    # what all items together do is asked by nobody: a level with one parent is the last
    while levels[-1].agg(F.countDistinct("parent")).first()[0] > 1:
        above = shared_table(levels[-1].groupBy("parent").applyInArrow(compose, "node long, adds array<bigint>"), "pack-functions")
        levels.append(above.withColumn("parent", F.floor(F.col("node") / FAN).cast("long")))
    begins = levels[-1].select(F.col("parent").alias("node")).distinct().withColumn("begin", F.lit(0).cast("long"))
    for level in reversed(levels):
        grouped = level.select("parent", "node", "adds").groupBy("parent").cogroup(begins.groupBy("node"))
        last = level is levels[0]
        out = grouped.applyInArrow((lambda t, above: hand_down(t, above).append_column("part", above["node"].take([0] * t.num_rows))) if last else hand_down, "node long, begin long" + (", part long" if last else ""))
        begins = shared_table(out, "pack-begins")
    return begins.select("part", F.col("node").alias("block"), "begin")


def pack(items: DataFrame, seq_len: int, separator: int, order: str, shards: int = 1, tokens: str = "tokens", masks: dict[str, int] | None = None, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(shard, row, input_ids, one column for each mask): items of a shard in order, cut into rows of seq_len; the last may be short.

    masks: columns of the length of tokens that are packed along, and their separators. shards=1 is one
    order over everything, packed in blocks side by side; with more shards, each is a task's work. Null tokens count as none.
    """
    columns = {"input_ids": (tokens, separator)} | {m: (m, s) for m, s in (masks or {}).items()}
    schema = "".join(f", {c} array<bigint>" for c in columns)
    picked = [F.coalesce(F.col(c), F.array()).cast("array<bigint>").alias(k) for k, (c, _) in columns.items()]
    if shards == 1:
        return _pack_in_order(items.select(F.col(order).alias("__order"), *picked), seq_len, columns, block_items)

    def fold(t):
        import pyarrow as pa

        t = t.sort_by("__order").combine_chunks()
        lengths = _lengths(t)
        starts, total = pack_starts(lengths, seq_len)
        cuts = pa.array(np.append(np.arange(0, total, seq_len), total).astype(np.int32))
        out = {"shard": pa.array([t["shard"][0].as_py()] * (len(cuts) - 1), pa.int32()), "row": pa.array(range(len(cuts) - 1), pa.int64())}
        for name, flat in zip(columns, _layout(t, list(columns), starts, lengths, 0, total, [s for _, s in columns.values()])):
            out[name] = pa.ListArray.from_arrays(cuts, pa.array(flat))
        return pa.table(out)

    keyed = items.select(F.pmod(F.xxhash64(order), F.lit(shards)).cast("int").alias("shard"), F.col(order).alias("__order"), *picked)
    return keyed.groupBy("shard").applyInArrow(fold, f"shard int, row long{schema}")


def _pack_in_order(items: DataFrame, seq_len: int, columns: dict, block_items: int) -> DataFrame:
    import pyarrow as pa

    names, separators = list(columns), [s for _, s in columns.values()]
    long = lambda x: x.cast("long")
    for name in names[1:]:
        items = raising(items, F.size(name) != F.size("input_ids"), f"{name} is not as long as the tokens")
    # as orderBy("__order", *names), but the sample that ranges come from, which the driver collects, holds no whole items
    ranges = items.repartitionByRange("__order", F.slice("input_ids", 1, RANGE_TOKENS))
    placed = ranges.sortWithinPartitions("__order", *names).withColumn("__at", F.monotonically_increasing_id())
    # items are stored in chunks, since a reader's batch is thousands of stored rows, whatever their size
    n = F.size("input_ids")
    placed = placed.select("*", long(n).alias("n"), F.explode(F.sequence(F.lit(0), F.greatest(F.floor((n - 1) / CHUNK_TOKENS).cast("int"), F.lit(0)))).alias("c"))
    placed = shared_table(placed.select("__at", "n", "c", *[F.slice(name, F.col("c") * CHUNK_TOKENS + 1, CHUNK_TOKENS).alias(name) for name in names]), "pack-ordered")
    at = F.col("__at").bitwiseAND((1 << 33) - 1)
    placed = placed.withColumns({"part": F.shiftright("__at", 33), "block": F.floor(at / block_items).cast("long")})

    # workers get the items' lengths and never their tokens
    def measure(t):
        t = t.sort_by("__at")
        adds = added(t["n"].to_numpy(), seq_len)
        return pa.table({"part": t["part"].slice(0, 1), "block": t["block"].slice(0, 1), "adds": pa.array([adds.tolist()], pa.list_(pa.int64()))})

    def place(t, start):
        t = t.sort_by("__at")
        begin, lengths = start["begin"][0].as_py(), t["n"].to_numpy()
        starts, _ = pack_starts(lengths, seq_len, begin, first=begin == 0)
        totals = np.append(begin, (starts + lengths)[:-1])
        return pa.table({"part": t["part"].slice(0, 1), "block": t["block"].slice(0, 1), "totals": pa.array([totals], pa.list_(pa.int64()))})

    sizes = placed.where("c = 0").select("part", "block", "__at", "n").groupBy("part", "block")
    blocks = shared_table(sizes.applyInArrow(measure, "part long, block long, adds array<bigint>"), "pack-blocks")
    begins = _starts(blocks, seq_len)
    totals = shared_table(sizes.cogroup(begins.groupBy("part", "block")).applyInArrow(place, "part long, block long, totals array<bigint>"), "pack-totals")

    # an item's first chunk takes the separator before it along; chunks are cut where rows end
    total = F.get("totals", (at % block_items).cast("int"))
    parted = total % seq_len != 0
    first = (F.col("c") == 0) & parted
    begin = total + F.when(F.col("c") == 0, 0).otherwise(parted.cast("long") + long(F.col("c")) * CHUNK_TOKENS)
    end = begin + first.cast("long") + long(F.size("input_ids"))
    with_separator = [F.when(first, F.concat(F.array(F.lit(s).cast("long")), F.col(name))).otherwise(F.col(name)).alias(name) for name, s in zip(names, separators)]
    chunks = placed.join(totals, ["part", "block"]).where(end > begin).select(begin.alias("begin"), end.alias("end"), *with_separator)
    cut = chunks.select("*", F.explode(F.sequence(F.floor(F.col("begin") / seq_len), F.floor((F.col("end") - 1) / seq_len))).alias("row"))
    low, high = F.greatest(F.col("begin"), F.col("row") * seq_len), F.least(F.col("end"), (F.col("row") + 1) * seq_len)
    part_of = lambda name: F.slice(name, (low - F.col("begin") + 1).cast("int"), (high - low).cast("int")).alias(name)
    # whole rows stay where they are; the others are pieces, of which a row has at most seq_len
    whole = cut.where(high - low == seq_len).select("row", *[part_of(name) for name in names])
    pieces = cut.where(high - low < seq_len).select("row", low.alias("at"), *[part_of(name) for name in names])
    pieces = pieces.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", *names))).alias("p"))
    joined = pieces.select("row", *[F.flatten(F.col("p").getField(name)).alias(name) for name in names])
    return whole.unionByName(joined).select(F.lit(0).alias("shard"), "row", *names)

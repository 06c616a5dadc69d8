"""Operator 13, harmonic packing of documents into training sequences.

Class k holds the pieces of at most 1/k of a sequence, and k of them fill one of its bins, whatever their
lengths are. A document is whole sequences first; what is left goes to the class that it nearly fills, or
else gives a piece that is exactly one class's share and goes on with the rest, which falls at least to the
square of the class. So a document has few pieces, a bin's padding is bounded by what a piece may lack of its share, and
classes are about three times the square root of the capacity.

A worker keeps one open bin for each class and closes it at its k-th piece, so bins fill independently on
all workers, in one pass without an exchange of texts; a worker holds at most a sequence for each class.
Bins that are open at a worker's end are dealt on to a FEWER-th of as many groups, until one group is
left. There the last open bins, at most one for each class, are joined and cut at the capacity; the last sequence is
cut into lengths that are powers of two, which need no padding. What a round deals on is bounded by its groups, not by rows.

Defined cases: a null or empty text is the end id alone; repeated rows are documents of their own, also
where ids are null or repeated; a text of any length is cut; an empty table gives no pieces; the string of a special
token in a text is that token, as in the vocabulary's own library; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

CAPACITY = 2048
END_ID = 1
#: A piece may lack this part of its document's tokens (one token at least) of its class's share.
SLACK = 1 / 512
#: Groups of open bins that are dealt into one.
FEWER = 16
#: Texts that are tokenised at a time.
TEXTS = 64
#: The vocabulary, a file of the public tokenizers or a path to one like it.
VOCABULARY = "byte_bpe_50k.tiktoken"
SPECIAL = {"<|endoftext|>": 50256}
#: Fixed value: how this vocabulary splits a text into words, in possessive form.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@functools.lru_cache(2)
def tokenizer(vocabulary: str) -> Callable[[str], np.ndarray]:
    """The ids of a text. The ranks are those of the tokenizers file of the same name, and so are the ids."""
    import tiktoken

    if not os.path.isabs(vocabulary):
        import public_tokenizers

        vocabulary = public_tokenizers.path(vocabulary)
    with open(vocabulary, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    coder = tiktoken.Encoding("packing", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=SPECIAL)
    return lambda text: coder.encode_to_numpy(text, allowed_special="all", disallowed_special=())


def cuts(n: int, capacity: int = CAPACITY, slack: float = SLACK) -> list[tuple[int, int]]:
    """(length, class) of the pieces of a document of n tokens, from its start."""
    out = [(capacity, 1)] * (n // capacity)
    rest, lack = n % capacity, max(1, int(n * slack))
    while rest:
        k = capacity // rest
        if capacity // k - rest > lack:
            k += 1
            out.append((capacity // k, k))
            rest -= capacity // k
        else:
            out.append((rest, k))
            rest = 0
    return out


class Bins:
    """A worker's open bins. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, prefix: int, keep_ids: bool):
        self.open: dict[int, list] = {}
        self.prefix, self.sequences, self.keep_ids = prefix, 0, keep_ids
        self.rows: list[tuple] = []

    def add(self, k: int, piece: tuple) -> None:
        bin_ = self.open.setdefault(k, [])
        bin_.append(piece)
        if len(bin_) == k:
            self.close(self.open.pop(k))

    def close(self, pieces: list) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.prefix + self.sequences, at, ids if self.keep_ids else None, None))
            at += len(ids)
        self.sequences += 1

    def finish(self) -> None:
        """Rows of what is still open, to be dealt on."""
        for k, bin_ in self.open.items():
            self.rows += [(doc, start, len(ids), None, total, None, None, ids, k) for doc, start, ids, total in bin_]
        self.open = {}

    def settle(self, capacity: int) -> None:
        """Join what is still open and cut it at the capacity, and the rest at powers of two."""
        rest = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        left = sum(len(p[2]) for p in rest)
        while left:
            size = capacity if left >= capacity else 1 << (left.bit_length() - 1)
            left -= size
            filled = []
            while size:
                doc, start, ids, total = rest.pop(0)
                if len(ids) > size:
                    rest.insert(0, (doc, start + size, ids[size:], total))
                    ids = ids[:size]
                filled.append((doc, start, ids, total))
                size -= len(ids)
            self.close(filled)

    def table(self, doc_type):
        import pyarrow as pa

        cols = list(zip(*self.rows)) or [()] * 9
        self.rows = []
        types = [doc_type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        arrays = [pa.array(c, t) for c, t in zip(cols, types)]
        sizes = np.fromiter((0 if i is None else len(i) for i in cols[7]), np.int64, len(cols[7]))
        flat = np.concatenate([i for i in cols[7] if i is not None] or [np.empty(0, np.uint32)]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(flat, pa.int32()))
        return pa.table([*arrays, ids, pa.array(cols[8], pa.int32())], names=[*COLUMNS, "ids", "class"])


COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>, class int"
#: A sequence's id: the round, the group or partition in it, and a number of its own.
ROUND_BITS, GROUP_BITS = 58, 30


def _first_round(vocabulary: str, capacity: int, end_id: int, slack: float, keep_ids: bool):
    def fill(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        encode = tokenizer(vocabulary)
        bins, kind = Bins(TaskContext.get().partitionId() << GROUP_BITS, keep_ids), None
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for at in range(0, batch.num_rows, TEXTS):
                some = batch.slice(at, TEXTS)
                for doc, text in zip(some["doc_id"].to_pylist(), some["text"].to_pylist()):
                    ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4", copy=False)
                    start = 0
                    for length, k in cuts(len(ids), capacity, slack):
                        # an open bin must not hold a whole document for a piece of it
                        bins.add(k, (doc, start, ids[start : start + length].copy(), len(ids)))
                        start += length
                if bins.rows:
                    yield from bins.table(kind).to_batches()
        bins.finish()
        if bins.rows:
            yield from bins.table(kind).to_batches()

    return fill


def _next_round(number: int, last: bool, capacity: int, keep_ids: bool):
    def fill(table):
        group = table["group"][0].as_py()
        bins = Bins((number << ROUND_BITS) | (group << GROUP_BITS), keep_ids)
        # larger pieces first; the order is the same if the task is lost and run again
        t = table.sort_by([("class", "ascending"), ("part", "ascending"), ("doc_id", "ascending"), ("start", "ascending"), ("length", "ascending")])
        column = t["ids"].combine_chunks()
        flat, at = column.flatten().to_numpy(zero_copy_only=False).astype("<u4"), np.append(0, np.cumsum(t["length"].to_numpy()))
        for i, (k, doc, start, total) in enumerate(zip(*(t[c].to_pylist() for c in ("class", "doc_id", "start", "doc_tokens")))):
            bins.add(k, (doc, start, flat[at[i] : at[i + 1]], total))
        if last:
            bins.settle(capacity)
        else:
            bins.finish()
        out = bins.table(t["doc_id"].type)
        return out.append_column("part", [[group] * out.num_rows])

    return fill


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, slack: float = SLACK, vocabulary: str = VOCABULARY, keep_ids: bool = True, fewer: int = FEWER) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids) for each piece; ids only if they are to be kept."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    made = rows.mapInArrow(_first_round(vocabulary, capacity, end_id, slack, keep_ids), f"doc_id {kind}, {PIECES}")
    made = C.written(made.withColumn("part", F.spark_partition_id().cast("long")), "packed")
    rounds, number = [made], 1
    while True:
        open_ = rounds[-1].where("sequence_id IS NULL")
        parts = open_.agg(F.countDistinct("part")).first()[0]
        if not parts:
            break
        last = parts <= fewer
        # parts are numbered anew, so that groups get fewer even where most parts have nothing open
        group = F.lit(0).cast("long") if last else F.floor(F.col("part") / F.lit(fewer)).cast("long")
        dealt = open_.withColumn("group", group).groupBy("group")
        rounds.append(C.written(dealt.applyInArrow(_next_round(number, last, capacity, keep_ids), f"doc_id {kind}, {PIECES}, part long"), f"packed-{number}"))
        number += 1
    out = functools.reduce(DataFrame.unionByName, rounds).where("sequence_id IS NOT NULL")
    return out.select(*COLUMNS, *(["ids"] if keep_ids else []))


def op13_packing(spark, sf_dir: str) -> DataFrame:
    return pack(C.table(spark, sf_dir, "documents"), keep_ids=False)

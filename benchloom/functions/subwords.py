"""Byte-pair subwords by a vocabulary table, and the token rows of conversations.

A vocabulary is a table (token: binary, rank: int): of all neighbouring pieces whose joined bytes are a
token, the pair with the smallest rank is joined first, the leftmost of equals; the rank is also the id. It is
read by Spark, counted, and sent to every task, since a vocabulary is a bounded part of a model and not
of the data. Merging keeps pieces in a linked list and candidate pairs in a heap, so a word of n bytes
takes n log n steps also where it is a megabyte of one letter.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from benchloom.functions import arrays as A

#: Rows of a vocabulary at most, words whose ids a task remembers, and letters of one at most.
LARGEST = 2_000_000
REMEMBERED = 200_000
LONGEST_REMEMBERED = 64
#: A worker hands on its rows as soon as they have so many tokens, or are so many: a batch that came in may have far more.
TOKENS_AT_ONCE = 1 << 19
ROWS_AT_ONCE = 10_000
#: Words with the space before them, and runs of other white space.
WORDS = r" ?[^ \t\n\r\f\v]+|[ \t\n\r\f\v]+"


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a word. A byte that the vocabulary lacks is an error."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end = list(range(1, n + 1))  # of the piece that begins at i; 0 once it has been joined to the one before
    before = list(range(-1, n - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = end[i]
        if j < n and (rank := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (rank, i, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != stop:
            continue  # one of the two has changed since
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        piece = word[i : end[i]]
        if piece not in ranks:
            raise ValueError(f"the vocabulary has no token for {piece!r}")
        out.append(ranks[piece])
        i = end[i]
    return out


def read_ranks(spark: SparkSession, path: str) -> DataFrame:
    """A vocabulary file of lines `base64 of the token, space, rank`."""
    parts = F.split("value", " ")
    return spark.read.text(path).where("value <> ''").select(F.unbase64(parts[0]).alias("token"), parts[1].cast("int").alias("rank"))


def tokenizer(vocabulary: DataFrame, words: str = WORDS) -> Callable[[Column], Column]:
    """A function from a column of arrays of texts to the ids of each; null texts have none.

    words: a pattern whose matches, one after the other, are a text; what it leaves out has no tokens.
    """
    rows = vocabulary.limit(LARGEST + 1).collect()
    if len(rows) > LARGEST:
        raise ValueError(f"a vocabulary of more than {LARGEST} tokens is not sent to every task")
    sent = vocabulary.sparkSession.sparkContext.broadcast({bytes(r["token"]): r["rank"] for r in rows})

    @F.arrow_udf("array<array<int>>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ranks, known = sent.value, {}
        try:
            split = re.compile(words).findall
        except re.error:  # character classes by property need the larger library
            import regex

            split = regex.compile(words).findall

        def ids(word: str) -> array:
            found = known.get(word)
            if found is None:
                found = array("i", merged(word.encode(), ranks))
                if len(word) <= LONGEST_REMEMBERED:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[word] = found
            return found

        def lists():
            flat = pa.ListArray.from_arrays(pa.array(texts_end, pa.int32()), pa.array(found, pa.int32()))
            return pa.ListArray.from_arrays(pa.array(rows_end, pa.int32()), flat, mask=pa.array(missing, pa.bool_()))

        found, texts_end, rows_end, missing = array("i"), array("i", [0]), array("i", [0]), []
        for column in batches:
            for texts in column:
                for t in texts.values or () if texts.is_valid else ():
                    for w in split(t.as_py() or ""):
                        found.extend(ids(w))
                    texts_end.append(len(found))
                rows_end.append(len(texts_end) - 1)
                missing.append(not texts.is_valid)
                if len(found) >= TOKENS_AT_ONCE or len(missing) >= ROWS_AT_ONCE:
                    yield lists()
                    found, texts_end, rows_end, missing = array("i"), array("i", [0]), array("i", [0]), []
        if missing:
            yield lists()

    return encode


def tokens(encode: Callable[[Column], Column], text: Column) -> Column:
    return F.get(encode(F.array(text)), F.lit(0)).cast("array<bigint>")


def chat_rows(conversations: DataFrame, encode: Callable[[Column], Column], start: int, end: int, messages: str = "messages", keep: list[str] = ()) -> DataFrame:
    """(keep, input_ids, attention_mask, prompt_mask) of conversations with messages (role, content).

    All messages but the last are the prompt: each is `start`, role, line break, content, `end`, line break, and after
    them comes the beginning of an answer. The last one's content and `end` are the completion, where prompt_mask
    is 1. Texts are only ever text: a control string in one gives no control token. Without messages a row is left out.
    """
    before, last = A.chat_parts(F.col(messages))
    said = F.concat(F.transform(before, lambda m: F.concat(F.coalesce(m["role"], F.lit("")), F.lit("\n"), F.coalesce(m["content"], F.lit("")))), F.array(F.lit("\n"), F.lit("assistant\n"), F.coalesce(last, F.lit(""))))
    rows = conversations.where(F.size(messages) > 0).select(*keep, encode(said).cast("array<array<bigint>>").alias("__t"))
    one = lambda token: F.array(F.lit(token).cast("bigint"))
    n = F.size("__t")
    turns = F.slice("__t", 1, n - 3)
    prompt = F.concat(F.flatten(F.transform(turns, lambda t: F.concat(one(start), t, one(end), F.get("__t", n - 3)))), one(start), F.get("__t", n - 2))
    rows = rows.select(*keep, prompt.alias("__p"), F.concat(F.get("__t", n - 1), one(end)).alias("__c"))
    ids = F.concat("__p", "__c")
    return rows.select(*keep, ids.alias("input_ids"), F.transform(ids, lambda x: F.lit(1)).alias("attention_mask"), A.prompt_mask(F.col("__p"), F.col("__c")).alias("prompt_mask"))

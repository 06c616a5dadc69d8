"""Operator 3, substring dedup of word windows with a count-min prefilter.

Every partition of documents (a bundle) counts in a sketch; the sketches are merged cell by cell; a
window whose estimate stays below two occurs once and is dropped from the search, and a second pass
groups the others exactly. A sketch never underestimates, so no repeated window is lost.

A window enters the sketch through its anchor: the word gram in it with the smallest hash. Equal
windows have equal anchors at the same offset, and two places of a window are two places of its
anchor, so the anchor's count is an upper bound of the window's. Some 2 in 29 places are anchors,
which keeps the sketch and its exchange far below the size of the text. The sketch is as wide as the
input is large and lies on its shards in blocks; it is never broadcast.

Exact grouping compares 96 bits of two hashes of a window.

Defined cases: a null text has no words; a document shorter than the window keeps all words; an
empty result has the hash of no bytes; repeated rows (equal id and text) each count as a document
and so repeat each other's windows; ids may be null or repeated; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import hashing as H

WINDOW = 35
GRAM = 8
DEPTH = 2
#: Cells of a sketch row for each byte of text. There is about one anchor for 90 bytes.
CELLS_PER_BYTE = 0.25


def anchored(data, offsets, window: int, gram: int):
    """Words, valid window starts, each one's anchor (an index into anchors), and anchors' hashes."""
    start, end, word = H.words(data, offsets)
    doc = np.searchsorted(offsets, start, side="right") - 1
    n = len(word) - window + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return start, end, word, doc, none, none, np.empty(0, np.uint64)
    g = H.grams(word, gram)
    at = H.least_at(g, window - gram + 1)[:n]
    valid = np.flatnonzero(doc[:n] == doc[window - 1 : window - 1 + n])
    at = at[valid]
    fresh = np.ones(len(at), bool)
    fresh[1:] = at[1:] != at[:-1]
    return start, end, word, doc, valid, np.cumsum(fresh) - 1, g[at[fresh]]


def cells(anchors: np.ndarray, row: int, n_shards: int, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, cell in the shard's block) of each distinct cell of a row, and each anchor's place there."""
    cell = H.mixed(anchors ^ np.uint64(0xA5A5A5A5A5A5A5A5 * (row + 1) & (1 << 64) - 1)) % np.uint64(n_shards * block)
    cell, place = np.unique(cell, return_inverse=True)
    return (cell // np.uint64(block)).astype(np.int64), (cell % np.uint64(block)).astype(np.uint32), place


def sketch_keys(anchors, n_shards: int, block: int):
    """A bundle's sketch: the shard, cell and saturated count (bit 0) of each cell that it touches."""
    shards, keys, places = [], [], []
    base = 0
    for row in range(DEPTH):
        shard, cell, place = cells(anchors, row, n_shards, block)
        count = np.bincount(place, minlength=len(cell))
        shards.append(shard * DEPTH + row)
        keys.append(cell << np.uint32(1) | (count >= 2))
        places.append(place + base)
        base += len(cell)
    return np.concatenate(shards), np.concatenate(keys).astype(np.uint32), places


def window_keys(word, starts, window: int):
    """Distinct windows: 64 and 32 bits, whether a window stands here twice, and each start's place."""
    a, b = H.prefix(word, 0), H.prefix(word, 1)
    h = H.spans(a, starts, starts + window, 0)
    low = (H.spans(b, starts, starts + window, 1) >> np.uint64(32)).astype(np.uint32)
    order = np.lexsort((low, h))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (low[order][1:] != low[order][:-1])
    group = np.cumsum(new) - 1
    place = np.empty(len(h), np.int64)
    place[order] = group
    count = np.bincount(group, minlength=int(new.sum()))
    return h[order][new], low[order][new], (count >= 2).astype(np.uint8), place


def repeated(h: np.ndarray, low: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """Which keys occur at least twice in all; twice: keys that occur twice where they come from."""
    order = np.lexsort((low, h))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (low[order][1:] != low[order][:-1])
    group = np.cumsum(new) - 1
    total = np.bincount(group, weights=1 + twice[order].astype(np.int64), minlength=int(new.sum()))
    out = np.empty(len(h), bool)
    out[order] = (total >= 2)[group]
    return out


def kept_texts(data, offsets, start, end, doc, keep):
    """Kept words of each document joined by one space, as (bytes, offsets)."""
    n_docs = len(offsets) - 1
    s, e, d = start[keep], end[keep], doc[keep]
    mark = np.zeros(len(data) + 1, np.int8)
    np.add.at(mark, s, 1)
    np.add.at(mark, e, -1)
    take = np.cumsum(mark[:-1], dtype=np.int8).astype(bool)
    joint = np.ones(len(d), bool)
    joint[-1:] = False
    joint[:-1] = d[1:] == d[:-1]
    out = data.copy()
    gap = e[joint]
    out[gap] = 0x20
    take[gap] = True
    lengths = np.bincount(d, weights=e - s + joint, minlength=n_docs).astype(np.int64)
    return out[take], np.concatenate([[0], np.cumsum(lengths)])


def dedup_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, kept_text, n_words, n_removed) for each row of docs.

    Removes every word covered by a run of `window` words whose sequence also starts anywhere else.
    """
    rows, n_bundles, n_shards = C.bundled(docs, doc_id, text)
    block = max(1 << 16, int(CELLS_PER_BYTE * n_bundles * C.BUNDLE_BYTES) // n_shards)
    block = min(block, (1 << 31) - 1)

    def count(t):
        data, offsets, _, _ = C.texts_of(t)
        *_, anchors = anchored(data, offsets, window, gram)
        shard, key, _ = sketch_keys(anchors, n_shards, block)
        return C.asks_table(t["bundle"][0].as_py(), shard, key)

    def merge(t):
        bundles, sizes, (key,) = C.gathered(t, np.uint32)
        _, place = np.unique(key >> np.uint32(1), return_inverse=True)
        total = np.bincount(place, weights=1 + (key & np.uint32(1)).astype(np.int64))
        return C.answers_table(t["shard"][0].as_py(), bundles, sizes, total[place] >= 2)

    def survivors(t, said):
        data, offsets, ids, rows = C.texts_of(t)
        start, end, word, doc, valid, of, anchors = anchored(data, offsets, window, gram)
        shard, key, places = sketch_keys(anchors, n_shards, block)
        often = C.answered(said, shard)
        likely = np.ones(len(anchors), bool)
        for place in places:
            likely &= often[place]
        return data, offsets, ids, start, end, doc, word, valid[likely[of]]

    def ask(t, said):
        if not t.num_rows:
            return C.asks_table(0, np.empty(0, np.int64), *(np.empty(0, d) for d in (np.uint64, np.uint32, np.uint8)))
        *_, word, starts = survivors(t, said)
        h, low, twice, _ = window_keys(word, starts, window)
        return C.asks_table(t["bundle"][0].as_py(), (h % np.uint64(n_shards)).astype(np.int64), h, low, twice)

    def group(t):
        bundles, sizes, cols = C.gathered(t, np.uint64, np.uint32, np.uint8)
        return C.answers_table(t["shard"][0].as_py(), bundles, sizes, repeated(*cols))

    def finish(t, said):
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("kept_text", pa.binary()), ("n_words", pa.int64()), ("n_removed", pa.int64())])
        if not t.num_rows:
            return schema.empty_table()
        estimates = said.filter(pa.compute.equal(said["step"], 0))
        exact = said.filter(pa.compute.equal(said["step"], 1))
        data, offsets, ids, start, end, doc, word, starts = survivors(t, estimates)
        h, _, _, place = window_keys(word, starts, window)
        twice = C.answered(exact, (h % np.uint64(n_shards)).astype(np.int64))[place]
        step = np.zeros(len(start) + 1, np.int32)
        step[starts[twice]] += 1
        np.add.at(step, starts[twice] + window, -1)
        covered = np.cumsum(step[:-1]) > 0
        n = len(ids)
        words, removed = np.bincount(doc, minlength=n), np.bincount(doc[covered], minlength=n)
        kept, at = kept_texts(data, offsets, start, end, doc, ~covered)
        texts = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(kept)])
        return pa.table([pa.array(ids, pa.int64()), texts, pa.array(words, pa.int64()), pa.array(removed, pa.int64())], schema=schema)

    by = rows.groupBy("bundle")
    estimates = by.applyInArrow(C.lean(count), C.ASKS + "k0 binary").groupBy("shard").applyInArrow(C.lean(merge), C.ANSWERS)
    exact = by.cogroup(estimates.groupBy("bundle")).applyInArrow(C.lean(ask), C.ASKS + "k0 binary, k1 binary, k2 binary").groupBy("shard").applyInArrow(C.lean(group), C.ANSWERS)
    said = estimates.withColumn("step", F.lit(0)).unionByName(exact.withColumn("step", F.lit(1)))
    return by.cogroup(said.groupBy("bundle")).applyInArrow(C.lean(finish), "doc_id long, kept_text binary, n_words long, n_removed long")


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_substrings(C.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, rn, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws
  FROM (SELECT doc_id, text, row_number() OVER () AS rn FROM documents)
), g AS (
  SELECT rn, i, array_to_string(list_slice(ws, i, i + 34), ' ') AS gram
  FROM (SELECT rn, ws, unnest(generate_series(1, len(ws) - 34)) AS i FROM w WHERE len(ws) >= 35)
), r AS (
  SELECT rn, i FROM (SELECT rn, i, count(*) OVER (PARTITION BY gram) AS n FROM g) WHERE n > 1
), c AS (
  SELECT DISTINCT rn, unnest(generate_series(i, i + 34)) AS p FROM r
), x AS (SELECT rn, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
k AS (
  SELECT x.rn, string_agg(word, ' ' ORDER BY x.p) AS kept, count(*) AS n
  FROM x ANTI JOIN c ON x.rn = c.rn AND x.p = c.p GROUP BY x.rn
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (rn)
"""

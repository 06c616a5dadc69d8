"""Operator 4, suffix-array dedup of byte strings.

Removes each byte covered by a string of `length` bytes that also starts in a document with a
smaller id. Windows are routed by their anchor, the byte gram in them with the smallest hash: equal
windows have equal anchors at the same offset, so they meet in one shard. The run of windows of a
document that share an anchor, with the bytes they cover, is a context of under 2 * length bytes.

1. Anchors that stand once in the whole corpus are dropped: no window over them repeats.
2. Equal contexts (128 bits of hash) need only the smallest id among them.
3. Where contexts differ around the same anchor, one document for each context sends its bytes.
   An anchor with over HOT contexts is split: half of the bytes that a window has besides its anchor, on
   its right or left, join the key, and the pieces go to shards of their own.
   Windows whose hash stands alone are trimmed off. A shard builds the suffix array of them by grouping (suffix_groups.py); suffixes that begin with
   the same `length` bytes are neighbours in it, and the smallest id among them decides.

Texts never travel but for the one exchange that builds the bundles; keys do, packed, one for each
distinct key of a bundle, so copies and common passages are merged before they meet.

Defined cases: a null text is empty and its hash that of no bytes; texts shorter than `length` stay;
rows with equal ids do not remove each other's bytes; a null id counts as larger than all others and
equal to other nulls; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import hashing as H
from .suffix_groups import suffix_array

LENGTH = 50
GRAM = 24
#: Windows hashed at a time, and bytes that go into one suffix array.
SLICE = 1 << 14
#: Low bits of an anchor's key that hold its place; the same in all slices, so that ties are cut alike.
POS_BITS = 15
SUFFIX_BYTES = 1 << 16
#: Distinct contexts of an anchor beyond which they are split by their neighbours.
HOT = 256
#: Places of windows that a hot anchor's contexts are compared at together.
STRIP = 3
LAST = np.iinfo(np.int64).max


def least_of(sums: np.ndarray, m: int, gram: int, span: int) -> np.ndarray:
    """For each run of span grams among m, the place of the leftmost with the smallest hash.

    The hash's upper bits decide; a place takes the lower ones, so all minima run over 32-bit values.
    """
    _, down = H.POWERS[0].get(m)
    key = sums[gram : gram + m] - sums[:m]
    key *= down[:m]
    key >>= np.uint64(32)
    low = key.astype(np.uint32)
    low &= np.uint32(0xFFFFFFFF << POS_BITS & 0xFFFFFFFF)
    low |= np.arange(m, dtype=np.uint32)
    run = 1
    while run * 2 <= span:
        low = np.minimum(low[:-run], low[run:])
        run *= 2
    if run < span:
        low = np.minimum(low[: len(low) - (span - run)], low[span - run :])
    return low & np.uint32((1 << POS_BITS) - 1)


def contexts(data, offsets, length: int, gram: int):
    """Runs of windows that share an anchor: first and last start, hash of anchor and of context, and the anchor's distance from first."""
    n = len(data) - length + 1
    span = length - gram + 1
    found = [[], [], [], [], []]
    if n > 0:
        edge = np.zeros(len(data) + 1, np.int32)
        low = np.maximum(offsets[:-1], offsets[1:] - (length - 1))
        np.add.at(edge, low, 1)
        np.add.at(edge, offsets[1:], -1)
        valid = np.cumsum(edge[:-1], out=edge[:-1]) == 0
        del edge
        for a in range(0, n, SLICE):
            lo, b = max(0, a - 1), min(n, a + SLICE)
            hi = min(n, b + span + 1)
            sums = H.prefix(H.BYTE_NOISE[data[lo : hi + length - 1]])
            m = hi - lo + span - 1
            at = least_of(sums, m, gram, span)
            ok = valid[lo:hi]
            first = ok.copy()
            first[1:] &= ~ok[:-1] | (at[1:] != at[:-1])
            if lo < a:
                first[0] = False
            last = ok.copy()
            last[:-1] &= ~ok[1:] | (at[1:] != at[:-1])
            s = np.flatnonzero(first)
            e = np.flatnonzero(last)
            e = e[np.searchsorted(e, s)]
            mine = s < b - lo
            s, e = s[mine], e[mine]
            whole = H.spans(sums, s, e + length)
            anchor = at[s].astype(np.int64)
            left = (anchor - s).astype(np.uint64) << np.uint64(8) | (e - s).astype(np.uint64)
            for out, x in zip(found, (s + lo, e + lo, H.spans(sums, anchor, anchor + gram), H.mixed(whole ^ H.mixed(left + np.uint64(11))), (anchor - s).astype(np.uint8))):
                out.append(x)
    kinds = (np.int64, np.int64, np.uint64, np.uint64, np.uint8)
    return [np.concatenate(x) if x else np.empty(0, k) for x, k in zip(found, kinds)]


def pieces(data, first, last, off, g, hot, length: int, gram: int):
    """What of each context is compared under which key: (context, key, windows skipped, windows).

    An ordinary context is one piece under its anchor. A hot anchor's context becomes two: its windows
    have half of a window's free bytes or more on the right of the anchor, or else on the left, and that
    half is added to the key. Equal windows have their anchor at the same place, so they meet again.
    """
    free = length - gram
    half = free // 2
    whole, split = np.flatnonzero(~hot), np.flatnonzero(hot)
    count = last - first + 1
    out = [(whole, g[whole], np.zeros(len(whole), np.int64), count[whole])]
    if len(split):
        o = off[split].astype(np.int64)
        anchor = first[split] + o
        skipped = np.maximum(0, o - (free - half))
        weights = H.noise(half, 21) | np.uint64(1)
        for side, keep, begin, windows, start in ((1, skipped < count[split], skipped, count[split] - skipped, anchor + gram), (2, skipped > 0, np.zeros(len(o), np.int64), np.minimum(skipped, count[split]), anchor - half)):
            at = np.flatnonzero(keep)
            near = H.BYTE_NOISE[data[start[at][:, None] + np.arange(half)]] * weights
            key = H.mixed(g[split[at]] ^ H.mixed(near.sum(axis=1, dtype=np.uint64) + np.uint64(side)))
            out.append((split[at], key, begin[at], windows[at]))
    return [np.concatenate(x) for x in zip(*out)]


def counted(flags: np.ndarray, out: np.ndarray) -> np.ndarray:
    """How many flags stand before each place, and in all; in out, an int32 array one longer than flags."""
    out[0] = 0
    np.cumsum(flags, out=out[1:])
    return out


def shared_windows(text: np.ndarray, offsets: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """Which starts in the joined texts begin `length` bytes that also start in one with a smaller id."""
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    joined = np.zeros(len(text) + n, np.int64)
    shift = np.arange(len(text)) + row
    joined[shift] = text.astype(np.int64) + 1
    order = suffix_array(joined)
    back = np.full(len(joined), -1, np.int64)
    back[shift] = np.arange(len(text))
    order = back[order]
    order = order[order >= 0]
    order = order[offsets[row[order] + 1] - order >= length]
    out = np.zeros(len(text), bool)
    if len(order):
        rows = np.lib.stride_tricks.sliding_window_view(text, length)[order]
        new = np.ones(len(order), bool)
        new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
        least = np.minimum.reduceat(ids[row[order]], np.flatnonzero(new))
        out[order] = ids[row[order]] > least[np.cumsum(new) - 1]
    return out


def likely_windows(text: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last start, in each of the joined texts, of a window whose hash (48 bits) repeats.

    Windows outside can't repeat, so the suffix array is spared them; it alone decides on the others.
    """
    n = len(offsets) - 1
    first, last = np.full(n, 1, np.int64), np.zeros(n, np.int64)
    sums = H.prefix(H.BYTE_NOISE[text])
    starts = np.flatnonzero(np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(text)) >= length)
    h = H.spans(sums, starts, starts + length) >> np.uint64(16)
    _, place, count = np.unique(h, return_inverse=True, return_counts=True)
    starts = starts[count[place] >= 2]
    of = np.searchsorted(offsets, starts, side="right") - 1
    first[of[::-1]] = (starts - offsets[of])[::-1]
    last[of] = starts - offsets[of]
    return first, last


def compare_contexts(anchor, length_of, ids, body, at, length: int) -> np.ndarray:
    """A bit for each window start of each context: does a smaller id hold the window, too.

    Contexts of an anchor go into the same suffix array, those of many anchors share one. at: where the
    anchor stands in each context; an anchor of more than SUFFIX_BYTES is compared in strips.
    """
    out = np.zeros(len(anchor), np.uint64)
    order = np.argsort(anchor, kind="stable")
    for a, b in whole_anchors(anchor[order], length_of[order].astype(np.int64), SUFFIX_BYTES):
        part = order[a:b]
        last = part[anchor[part] == anchor[part[-1]]]  # a slice ends with the anchor that filled it
        if int(length_of[last].sum()) > SUFFIX_BYTES:
            out[last] = compare_strips(length_of[last].astype(np.int64), ids[last], body[last], at[last].astype(np.int64), length)
            part = part[: len(part) - len(last)]
        out[part] = compare_some(anchor[part], length_of[part].astype(np.int64), ids[part], body[part], length)
    return out


def compare_strips(length_of, ids, body, at, length: int) -> np.ndarray:
    """compare_contexts() of one anchor's contexts, STRIP places of windows at a time.

    All windows of a strip have the strip's middle in them, so only contexts of equal middles are compared;
    equal pieces of a strip go into the array once, with their smallest id.
    """
    out = np.zeros(len(at), np.uint64)
    count = length_of - length + 1
    wide = length + STRIP - 1
    padded = np.concatenate([np.zeros((len(body), wide), np.uint8), body, np.zeros((len(body), wide), np.uint8)], axis=1)
    # window j of a context lies at - j bytes before its anchor; a strip has the places [low, low + STRIP) of these
    for low in range(int((at - count + 1).min()), int(at.max()) + 1, STRIP):
        first = np.maximum(0, at - low - (STRIP - 1))
        last = np.minimum(count - 1, at - low)
        some = np.flatnonzero(first <= last)
        if len(some) < 2:
            continue
        begin = at[some] - low - (STRIP - 1) + wide
        strip = padded[some[:, None], begin[:, None] + np.arange(wide)]
        skip = first[some] + wide - begin
        inside = (np.arange(wide) >= skip[:, None]) & (np.arange(wide) < (skip + last[some] - first[some] + length)[:, None])
        strip[~inside] = 0
        middle = np.ascontiguousarray(strip[:, STRIP - 1 : length]).view(f"V{length - STRIP + 1}").ravel()
        _, kind, many = np.unique(middle, return_inverse=True, return_counts=True)
        shape = np.concatenate([strip, skip[:, None].astype(np.uint8), (last - first)[some][:, None].astype(np.uint8)], axis=1)
        _, same = np.unique(np.ascontiguousarray(shape).view(f"V{wide + 2}").ravel(), return_inverse=True)
        # of equal pieces the one with the smallest id stands for all
        order = np.lexsort((ids[some], same))
        lead = order[np.append(True, same[order][1:] != same[order][:-1])]
        bits = np.zeros(len(lead), np.uint64)
        kept = lead[many[kind[lead]] > 1]
        kept = kept[np.argsort(kind[kept], kind="stable")]
        sizes = (last - first)[some[kept]] + length
        for a, b in whole_anchors(kind[kept], sizes, SUFFIX_BYTES):
            part, size = kept[a:b], sizes[a:b]
            offsets = np.concatenate([[0], np.cumsum(size)])
            where = np.flatnonzero(shared_windows(strip[part][inside[part]], offsets, ids[some[part]], length))
            of = np.searchsorted(offsets, where, side="right") - 1
            np.bitwise_or.at(bits, same[part[of]], np.uint64(1) << (where - offsets[of]).astype(np.uint64))
        every = (np.uint64(1) << (last - first + 1)[some].astype(np.uint64)) - np.uint64(1)
        found = np.where(ids[some] > ids[some[lead]][same], every, bits[same])
        out[some] |= found << first[some].astype(np.uint64)
    return out


def whole_anchors(anchor: np.ndarray, sizes: np.ndarray, most: int):
    """Slices of sorted contexts that end between anchors, of about `most` bytes."""
    if not len(anchor):
        return
    ends = np.cumsum(sizes)
    begin, done = 0, 0
    for g in (np.flatnonzero(anchor[1:] != anchor[:-1]) + 1).tolist():
        if ends[g - 1] - done >= most:
            yield begin, g
            begin, done = g, ends[g - 1]
    yield begin, len(anchor)


def compare_some(anchor, length_of, ids, body, length: int) -> np.ndarray:
    """compare_contexts() of contexts in the order of their anchors."""
    out = np.zeros(len(anchor), np.uint64)
    place = np.arange(body.shape[1])[None, :]
    text = body[place < length_of[:, None]]
    first, last = likely_windows(text, np.concatenate([[0], np.cumsum(length_of)]), length)
    order = np.flatnonzero(first <= last)
    first, sizes = first[order], (last - first)[order] + length
    for a, b in whole_anchors(anchor[order], sizes, SUFFIX_BYTES):
        part, begin, size = order[a:b], first[a:b], sizes[a:b]
        text = body[part][(place >= begin[:, None]) & (place < (begin + size)[:, None])]
        offsets = np.concatenate([[0], np.cumsum(size)])
        where = np.flatnonzero(shared_windows(text, offsets, ids[part], length))
        of = np.searchsorted(offsets, where, side="right") - 1
        np.bitwise_or.at(out, part[of], np.uint64(1) << (where - offsets[of] + begin[of]).astype(np.uint64))
    return out


def dedup_suffixes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, keep: list[str] = ()) -> DataFrame:
    """(doc_id, kept_text as bytes, n_bytes, n_removed, n_spans) and the columns of keep for each row of docs."""
    if not 0 <= length - gram < 64:
        raise ValueError("length - gram must be from 0 to 63")
    rows, _, n_shards = C.bundled(docs, doc_id, text, keep)
    width = 2 * length - gram
    shard_of = lambda g: (g % np.uint64(n_shards)).astype(np.int64)

    def anchors_of(g):
        key, place, count = np.unique(g, return_inverse=True, return_counts=True)
        return shard_of(key), ((key >> np.uint64(33)).astype(np.uint32) << np.uint32(1)) | (count >= 2), place

    def ask_anchors(t):
        data, offsets, _, _ = C.texts_of(t)
        shard, key, _ = anchors_of(contexts(data, offsets, length, gram)[2])
        return C.asks_table(t["bundle"][0].as_py(), shard, key.astype(np.uint32))

    def count_anchors(t):
        bundles, sizes, (key,) = C.gathered(t, np.uint32)
        _, place = np.unique(key >> np.uint32(1), return_inverse=True)
        total = np.bincount(place, weights=1 + (key & np.uint32(1)).astype(np.int64))
        return C.answers_table(t["shard"][0].as_py(), bundles, sizes, total[place] >= 2)

    def repeated_runs(t, said):
        """The bundle and its runs over repeated anchors, with distinct contexts in a fixed order."""
        data, offsets, ids, rows = C.texts_of(t)
        first, last, g, c, off = contexts(data, offsets, length, gram)
        shard, _, place = anchors_of(g)
        keep = C.answered(said, shard)[place]
        first, last, g, c, off = first[keep], last[keep], g[keep], c[keep], off[keep]
        _, example, place = np.unique(c, return_index=True, return_inverse=True)
        id_of = np.array([LAST if i is None else i for i in ids], np.int64)
        run_id = id_of[np.searchsorted(offsets, first, side="right") - 1]
        return data, offsets, (ids, rows), first, last, off, g[example], c[example], example, place, run_id

    def ask_contexts(t, said):
        if not t.num_rows:
            return C.asks_table(0, np.empty(0, np.int64), *(np.empty(0, np.uint64),) * 3)
        *_, g, c, example, _, run_id = repeated_runs(t, said)
        return C.asks_table(t["bundle"][0].as_py(), shard_of(g), g, c, run_id[example])

    def compare_ids(t):
        bundles, sizes, (g, c, ids) = C.gathered(t, np.uint64, np.uint64, np.int64)
        order = np.lexsort((ids, c, g))
        g, c = g[order], c[order]
        new_g, new_c = np.ones(len(g), bool), np.ones(len(g), bool)
        new_g[1:] = g[1:] != g[:-1]
        new_c[1:] = new_g[1:] | (c[1:] != c[:-1])
        least = ids[order][new_c][np.cumsum(new_c) - 1]
        kinds = np.bincount(np.cumsum(new_g) - 1, weights=new_c)[np.cumsum(new_g) - 1]
        answer = np.empty(len(g), np.uint8)
        later = ids[order] > least
        answer[order] = later | (np.uint8(2) * (~later & (kinds >= 2))) | (np.uint8(4) * (kinds > HOT))
        return C.answers_table(t["shard"][0].as_py(), bundles, sizes, answer)

    def parts(said):
        import pyarrow.compute as pc

        return [said.filter(pc.equal(said["step"], k)) for k in range(3)]

    def ask_bytes(t, said):
        none = [np.empty(0, np.uint64), np.empty(0, np.uint8), np.empty(0, np.int64), np.empty(0, f"V{width}"), np.empty(0, np.uint8)]
        if not t.num_rows:
            return C.asks_table(0, np.empty(0, np.int64), *none)
        said = parts(said)
        data, _, _, first, last, off, g, _, example, _, run_id = repeated_runs(t, said[0])
        answer = C.answered(said[1], shard_of(g), np.uint8)
        open_ = answer & 2 > 0
        run = example[open_]
        of, g, begin, windows = pieces(data, first[run], last[run], off[run], g[open_], answer[open_] & 4 > 0, length, gram)
        run = run[of]
        size = windows + length - 1
        body = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(width, np.uint8)]), width)[first[run] + begin]
        body[np.arange(width)[None, :] >= size[:, None]] = 0
        flat = np.ascontiguousarray(body).view(f"V{width}").ravel()
        return C.asks_table(t["bundle"][0].as_py(), shard_of(g), g, size.astype(np.uint8), run_id[run], flat, (off[run] - begin).astype(np.uint8))

    def compare_bytes(t):
        bundles, sizes, (g, size, ids, flat, at) = C.gathered(t, np.uint64, np.uint8, np.int64, f"V{width}", np.uint8)
        body = flat.view(np.uint8).reshape(len(flat), width)
        return C.answers_table(t["shard"][0].as_py(), bundles, sizes, compare_contexts(g, size, ids, body, at, length))

    def finish(t, said):
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("kept_text", pa.binary()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64())])
        for i in range(len(keep)):
            schema = schema.append(t.schema.field(f"keep_{i}"))
        if not t.num_rows:
            return schema.empty_table()
        said = parts(said)
        data, offsets, (ids, rows), first, last, off, g, _, example, place, run_id = repeated_runs(t, said[0])
        answer = C.answered(said[1], shard_of(g), np.uint8)
        bits, open_ = np.zeros(len(g), np.uint64), np.flatnonzero(answer & 2)
        run = example[open_]
        of, key, begin, _ = pieces(data, first[run], last[run], off[run], g[open_], answer[open_] & 4 > 0, length, gram)
        np.bitwise_or.at(bits, open_[of], C.answered(said[2], shard_of(key), np.uint64) << begin.astype(np.uint64))
        whole = (answer[place] & 1 > 0) | (run_id > run_id[example][place])
        step = np.zeros(len(data) + 1, np.int32)
        np.add.at(step, first[whole], 1)
        np.add.at(step, last[whole] + length, -1)
        part = np.flatnonzero(~whole & (bits[place] > 0))
        for k in range(length - gram + 1):
            at = first[part[bits[place[part]] >> np.uint64(k) & np.uint64(1) > 0]] + k
            np.add.at(step, at, 1)
            np.add.at(step, at + length, -1)
        gone = np.cumsum(step[:-1], out=step[:-1]) > 0
        n = len(ids)
        before = counted(gone, step)  # step's place serves again
        removed = np.diff(before[offsets])
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        inner = offsets[:-1][offsets[:-1] < len(data)]
        begins[inner] = gone[inner]
        at = offsets - before[offsets]
        spans = np.diff(counted(begins, step)[offsets])
        kept = data[~gone]
        texts = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(kept)])
        return pa.table([pa.array(ids, pa.int64()), texts, *(pa.array(x, pa.int64()) for x in (np.diff(offsets), removed, spans)), *(rows[f"keep_{i}"] for i in range(len(keep)))], schema=schema)

    by = rows.groupBy("bundle")
    known = by.applyInArrow(C.lean(ask_anchors), C.ASKS + "k0 binary").groupBy("shard").applyInArrow(C.lean(count_anchors), C.ANSWERS)
    same = by.cogroup(known.groupBy("bundle")).applyInArrow(C.lean(ask_contexts), C.ASKS + "k0 binary, k1 binary, k2 binary").groupBy("shard").applyInArrow(C.lean(compare_ids), C.ANSWERS)
    said = known.withColumn("step", F.lit(0)).unionByName(same.withColumn("step", F.lit(1)))
    differ = by.cogroup(said.groupBy("bundle")).applyInArrow(C.lean(ask_bytes), C.ASKS + "k0 binary, k1 binary, k2 binary, k3 binary, k4 binary").groupBy("shard").applyInArrow(C.lean(compare_bytes), C.ANSWERS)
    said = said.unionByName(differ.withColumn("step", F.lit(2)))
    columns = "".join(f", keep_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    out = by.cogroup(said.groupBy("bundle")).applyInArrow(C.lean(finish), "doc_id long, kept_text binary, n_bytes long, n_removed long, n_spans long" + columns)
    return out.withColumnsRenamed({f"keep_{i}": c for i, c in enumerate(keep)})


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_suffixes(C.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rn, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (
  SELECT rn, doc_id, i, substr(h, CAST(2 * i - 1 AS BIGINT), 100) AS s
  FROM (SELECT rn, doc_id, h, unnest(generate_series(1, length(h) // 2 - 49)) AS i FROM d WHERE length(h) >= 100)
), r AS (
  SELECT rn, i FROM (SELECT rn, doc_id, i, min(doc_id) OVER (PARTITION BY md5_number(s)) AS m FROM g) WHERE doc_id > m
), e AS (
  SELECT rn, i, i + 50 AS j, coalesce(max(i + 50) OVER (PARTITION BY rn ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM r
), s AS (
  SELECT rn, min(i) AS a, max(j) AS b FROM (SELECT *, sum(CASE WHEN i > before THEN 1 ELSE 0 END) OVER (PARTITION BY rn ORDER BY i) AS k FROM e) GROUP BY rn, k
), p AS (
  SELECT rn, b AS f, lead(a) OVER (PARTITION BY rn ORDER BY a) AS t, row_number() OVER (PARTITION BY rn ORDER BY a) AS o FROM s
), q AS (
  SELECT rn, f, t FROM p UNION ALL SELECT rn, 1, a FROM (SELECT rn, min(a) AS a FROM s GROUP BY rn)
), k AS (
  SELECT q.rn, string_agg(substr(h, CAST(2 * f - 1 AS BIGINT), CAST(2 * (coalesce(t, length(h) // 2 + 1) - f) AS BIGINT)), '' ORDER BY f) AS kept
  FROM q JOIN d USING (rn) GROUP BY q.rn
), n AS (SELECT rn, sum(b - a) AS removed, count(*) AS spans FROM s GROUP BY rn)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k.kept, h))) AS kept_sha256
FROM d LEFT JOIN n USING (rn) LEFT JOIN k USING (rn)
"""

"""Operators 11 to 13 against brute force on small fixtures with every awkward case."""

import hashlib
import random
import zlib
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from benchloom.llm import merkle, overlap_join, packing

DOCS = "doc_id long, text string, lang string, source string, n_chars long, name string, level int, hash string, index long, part long, ids string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def climb(hashes, fan):
    """All levels of a tree, from its leaves to its top."""
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + fan])) for i in range(0, len(levels[-1]), fan)])
    return levels


def brute_manifest(rows, fan, claims):
    encoded = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, n: sha("".join(map(encoded, (r[0], r[3], r[2], n, r[1]))))
    trees = defaultdict(list)
    for r in rows:
        claim = leaf(r, r[4] + 1 if claims(r) and r[4] is not None else r[4])
        trees[r[2]].append((r[0] is not None, r[0] or 0, leaf(r, r[4]), claim, r[0]))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    levels = {n: climb([x[2] for x in sorted(trees[n])], fan) for n in names}
    top = climb([levels[n][-1][0] for n in names], fan)
    out = []
    for rank, n in enumerate(names):
        for i, (_, _, own, claim, doc) in enumerate(sorted(trees[n])):
            siblings = ""
            for tree, at in ((levels[n], i), (top, rank)):
                for level in tree[:-1]:
                    first = at - at % fan
                    before, after = "".join(level[first:at]), "".join(level[at + 1 : first + fan])
                    siblings, claim, at = siblings + before + after, sha(before + claim + after), at // fan
            out.append((doc, n, own, levels[n][-1][0], top[-1][0], siblings, claim))
    return out


@pytest.fixture(scope="module")
def documents():
    rng = random.Random(4)
    langs = ["en"] * 6 + ["de", "fr", None, "日本", ""]
    rows = [(i if i % 11 else None, None if i % 13 == 0 else "t " * rng.randrange(9) + "ü" * (i % 3), rng.choice(langs), None if i % 7 == 0 else "s", None if i % 5 == 0 else i, "n", 1, "h", 2, 3, "x") for i in range(90)]
    return [*rows, rows[3], rows[3], (5, "lone", "zz", "s", 1, None, None, None, None, None, None), (12, "x" * 100_000, "en", "s", 9, "n", 1, "h", 2, 3, "x")]


@pytest.mark.parametrize(("fan", "height"), [(2, 9), (2, 2), (3, 1), (5, 2)])
def test_merkle(spark, documents, fan, height):
    docs = spark.createDataFrame(documents, DOCS).repartition(5)
    other = merkle.leaf_hash(*[F.col(c) + 1 if c == "n_chars" else F.col(c) for c in merkle.FIELDS])
    got = merkle.manifest(docs, F.when(F.col("doc_id") % 3 == 0, other), fan=fan, height=height).collect()
    want = brute_manifest(documents, fan, lambda r: r[0] is not None and r[0] % 3 == 0)
    keyed = lambda rows: sorted(rows, key=repr)
    assert keyed((r.doc_id, r.lang, r.leaf, r.subroot, r.root, r.siblings, r.folded) for r in got) == keyed(want)
    assert {r.folded == r.root for r in got} == {True, False}


def test_merkle_small_tables(spark, documents):
    one = spark.createDataFrame(documents[:1], DOCS)
    (r,) = merkle.manifest(one).collect()
    assert r.leaf == r.subroot == r.root == r.folded and r.siblings == ""
    assert merkle.manifest(one.limit(0)).count() == 0


def test_depths(spark):
    sizes = [1, 2, 3, 4, 5, 8, 9, 27, 28, 2**40, 2**40 + 1]
    for fan in (2, 3, 7):
        df = spark.createDataFrame([(s,) for s in sizes], "s long").select(merkle.depth_of(F.col("s"), fan).alias("d"))
        want = [next(k for k in range(99) if fan**k >= s) for s in sizes]
        assert [r.d for r in df.collect()] == want


def brute_overlaps(clicks, sales, lines):
    us = lambda t: round((t - datetime(1970, 1, 1)) / timedelta(microseconds=1))
    times = defaultdict(set)
    for client, ts, kind in clicks:
        if client is not None and ts is not None:
            times[client].add(us(ts))
    bad = {(c, us(t)) for c, t, k in clicks if t is not None and k == "error"}
    runs = defaultdict(list)
    for client, all_ in times.items():
        run = []
        for t in sorted(all_):
            if run and t - run[-1] > 1_800_000_000:
                runs[client].append(run)
                run = []
            run.append(t)
        runs[client].append(run)
    out = []
    for sale, client, status, sold in sales:
        if client is None or sold is None:
            continue
        end = max([us(sold)] + [us(t) for s, t in lines if s == sale and s is not None and t is not None])
        found = defaultdict(lambda: [0, 0, 0])
        for run in runs[client]:
            inf = 10**18
            s, e, a, b = us(sold) // 21_600_000_000, end // 21_600_000_000, run[0] // 21_600_000_000, run[-1] // 21_600_000_000
            e, b = inf if status == "open" else e, inf if (client, run[-1]) in bad else b
            if s <= b and a <= e:
                names = [["overlaps", "finished_by", "contains"], ["starts", "equals", "started_by"], ["during", "finishes", "overlapped_by"]]
                one = found[names[(s > a) - (s < a) + 1][(e > b) - (e < b) + 1]]
                one[0] += 1
                one[1] = None if e == b == inf else one[1] + min(e, b) - max(s, a) + 1
                one[2] += zlib.crc32(str(run[0]).encode())
        out += [(sale, name, *v) for name, v in found.items()]
    return out


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_overlap_join(spark, kind):
    rng = random.Random(6)
    base = datetime(1969, 12, 20)  # slots on both sides of 1970

    def time():
        return None if rng.random() < 0.03 else base + timedelta(microseconds=rng.randrange(40 * 86_400) * 10**6 // rng.choice([1, 1, 60]) + rng.choice([0, 0, 1, 999_999]))

    client = lambda: rng.choice([None, 1, 1, 1, 1, 2, 3, 4])
    clicks = [(client(), time(), rng.choice([None, "error", "view"])) for _ in range(500)]
    first = clicks[0][1] or base
    # a gap of exactly 30 minutes goes on, one of a microsecond more does not; ties at the last time
    clicks += [(5, first, "view"), (5, first + timedelta(minutes=30), "view"), (5, first + timedelta(minutes=60, microseconds=1), "view"), (5, first + timedelta(minutes=60, microseconds=1), "error"), *clicks[:20]]
    sales = [(i if i % 17 else None, client(), rng.choice([None, "open", "done"]), time()) for i in range(200)] + [(900, 5, "done", first), (901, 6, "open", first)]
    lines = [(rng.choice([None, *range(200)]), time()) for _ in range(300)] + [(900, first + timedelta(days=90)), (900, first - timedelta(days=9))]
    spark_clicks = spark.createDataFrame(clicks, f"client_id long, ts {kind}, kind string").withColumns({"first": F.lit("x"), "run": F.lit(1), "open": F.lit("y")})
    spark_sales = spark.createDataFrame(sales, f"sale_id long, client_id long, status string, sold_at {kind}").withColumns({"end": F.lit(2), "relation": F.lit("z"), "shipped": F.lit(3)})
    spark_lines = spark.createDataFrame(lines, f"sale_id long, shipped_at {kind}")
    want = sorted(brute_overlaps(clicks, sales, lines), key=repr)
    assert {w[1] for w in want} == set(overlap_join.RELATIONS)
    for chunk in (overlap_join.CHUNK, 3, 1):
        got = overlap_join.overlap_join(overlap_join.sale_intervals(spark_sales, spark_lines), overlap_join.sessions(spark_clicks), chunk=chunk)
        assert sorted(map(tuple, got.collect()), key=repr) == want
    twice = overlap_join.overlap_join(overlap_join.sale_intervals(spark_sales.union(spark_sales), spark_lines), overlap_join.sessions(spark_clicks))
    assert sorted(map(tuple, twice.collect()), key=repr) == sorted(want * 2, key=repr)


def test_overlap_join_empty(spark):
    clicks = spark.createDataFrame([(1, datetime(2024, 1, 1), "view")], "client_id long, ts timestamp_ntz, kind string")
    sales = spark.createDataFrame([(1, 1, "done", datetime(2024, 1, 1))], "sale_id long, client_id long, status string, sold_at timestamp_ntz")
    lines = spark.createDataFrame([], "sale_id long, shipped_at timestamp_ntz")
    for c, s, n in ((clicks, sales, 1), (clicks.limit(0), sales, 0), (clicks, sales.limit(0), 0), (clicks.limit(0), sales.limit(0), 0)):
        assert overlap_join.overlap_join(overlap_join.sale_intervals(s, lines), overlap_join.sessions(c)).count() == n


def test_cuts():
    for capacity in (1, 7, 64, 2048):
        for n in range(1, 3 * capacity + 2):
            for slack in (0, 1 / 512, 1 / 8):
                pieces = packing.cuts(n, capacity, slack)
                assert sum(length for length, _ in pieces) == n and len(pieces) <= n // capacity + 5
                assert all(1 <= length <= capacity // k for length, k in pieces)
                assert all(capacity // k - length <= max(1, int(n * slack)) for length, k in pieces)
    assert len({k for n in range(1, 2048) for _, k in packing.cuts(n)}) < 3 * 2048**0.5


@pytest.fixture(scope="module")
def public():
    import public_tokenizers
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: [*coder.encode(text or "", add_special_tokens=False).ids, 1]


def test_tokens(public):
    rng = random.Random(1)
    parts = ["a", "B", " ", "  ", "\n", "'", "s", "'ll", "1", "é", "日", "\t", "<|endoftext|>", "\x1c", "\x85", "\xa0", "!", "\U0001f600", "ß", "\r\n", "\x00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(2000)] + ["", "x" * 50_000, " " * 9_999, "\n" * 99 + "a"]
    encode = packing.tokenizer(packing.VOCABULARY)
    assert all([*encode(t).tolist(), 1] == public(t) for t in texts)


@pytest.mark.parametrize(("capacity", "parts", "fewer"), [(2048, 1, 16), (2048, 9, 2), (64, 7, 2), (1, 2, 16)])
def test_packing(spark, public, capacity, parts, fewer):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(10**9, None), (10**9 + 1, ""), (None, "no id"), (10**9 + 2, "word " * 40_000), (10**9 + 3, "<|endoftext|> x"), (10**9 + 4, "x" * 999)], docs.schema)
    odd = odd.where("length(text) < 100 OR text IS NULL") if capacity == 1 else odd.unionByName(docs)
    odd = odd.repartition(parts).cache()
    got = packing.pack(odd.withColumns({"part": F.lit(1), "group": F.lit("g"), "ids": F.lit(2)}), capacity=capacity, fewer=fewer).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        assert r.length == len(r.ids) > 0 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    rows = odd.collect()
    assert len(by_doc) == len(rows)
    for d in rows:
        pieces = sorted(by_doc[d.doc_id], key=lambda r: r.start)
        ids = [i for p in pieces for i in p.ids]
        assert ids == public(d.text) and {p.doc_tokens for p in pieces} == {len(ids)}
        assert [p.start for p in pieces] == [sum(q.length for q in pieces[:i]) for i in range(len(pieces))]
    padding = total = 0
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        size = sum(p.length for p in pieces)
        assert size <= capacity and [p.offset for p in pieces] == [sum(q.length for q in pieces[:i]) for i in range(len(pieces))]
        padding += 0 if size & (size - 1) == 0 else capacity - size
        total += size
    assert padding <= 0.02 * total
    if capacity == 2048:
        assert len(got) <= 4 * len(rows) + total // capacity


def test_packing_equal_and_empty(spark, public):
    same = spark.createDataFrame([(1, "one two")] * 700 + [(None, None)] * 5, "doc_id long, text string").repartition(3)
    got = packing.pack(same, keep_ids=False)
    assert got.columns == packing.COLUMNS
    rows = got.collect()
    assert sum(r.length for r in rows) == 700 * len(public("one two")) + 5
    assert packing.pack(same.limit(0)).count() == 0

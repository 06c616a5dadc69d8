"""Each operator against brute force on a small fixture with every awkward case."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from benchloom.llm import chat_format, decontamination, embedding_dedup, language_id, license_scan, mixing, simhash, substring_dedup, suffix_dedup, suffix_groups, url_filter
from benchloom.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bundle int, words string, fp long"
RNG = random.Random(3)
VOCAB = ["then", "ing", "Er", "tion", "ü", "日本", "mit", "license", "a"]
PASSAGE = " ".join(RNG.choice(VOCAB) + str(i % 7) for i in range(60))


def make_texts():
    plain = [" ".join(RNG.choice(VOCAB) + RNG.choice(["", "x", "yz"]) for _ in range(RNG.randrange(1, 120))) for _ in range(30)]
    near = [t[:-3] + "q" + t[-3:] for t in plain[:6]]
    mixed = [t + "\n" + PASSAGE + " \t" + t[::-1] for t in plain[:5]]
    long_ = " ".join(plain) * 3
    return plain + near + mixed + plain[:4] + [None, "", "  \n ", "!!!", "123", long_, "x" * 3000, PASSAGE, PASSAGE.upper()]


TEXTS = make_texts()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 9 == 0 else ["en", "de"][i % 2], "s0" if i % 3 else None, 1, 5, "w", 7) for i, t in enumerate(TEXTS)]
    rows += [rows[3], rows[3], (None, TEXTS[5], "en", "s1", 1, 1, "w", 1), (None, TEXTS[5], "en", "s1", 1, 1, "w", 1), (7, "another " + TEXTS[7], "de", "s1", 2, 2, "w", 2)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def data(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def same(got, want):
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_suffix_array():
    for _ in range(500):
        t = [RNG.randrange(RNG.choice([1, 2, 3, 9])) for _ in range(RNG.randrange(40))]
        assert suffix_groups.suffix_array(np.array(t, np.int64)).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def test_substring_dedup(docs, empty):
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    for window in (35, 9):
        rows = data(docs)
        count = {}
        for _, t in rows:
            w = split(t)
            for i in range(len(w) - window + 1):
                k = tuple(w[i : i + window])
                count[k] = count.get(k, 0) + 1
        want = []
        for d, t in rows:
            w = split(t)
            gone = {j for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
            want.append((d, " ".join(x for i, x in enumerate(w) if i not in gone), len(w), len(gone)))
        got = substring_dedup.dedup_substrings(docs, window=window, gram=4).collect()
        same([(r.doc_id, r.kept_text.decode(), r.n_words, r.n_removed) for r in got], want)
    assert substring_dedup.dedup_substrings(empty).count() == 0


def brute_suffixes(rows, length):
    first = {}
    key = lambda d: float("inf") if d is None else d
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            k = b[i : i + length]
            first[k] = min(first.get(k, float("inf")), key(d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if key(d) > first[b[i : i + length]]:
                gone[i : i + length] = True
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(b) else 0
        out.append((d, bytes(x for x, g in zip(b, gone) if not g), len(b), int(gone[: len(b)].sum()), spans))
    return out


def test_suffix_dedup(docs, empty, monkeypatch):
    for length, gram, hot, most in ((50, 24, 256, 1 << 16), (12, 4, 256, 1 << 16), (50, 24, 0, 1 << 16), (12, 4, 0, 90), (13, 4, 2, 40), (50, 24, 256, 10), (12, 4, 256, 200)):
        monkeypatch.setattr(suffix_dedup, "HOT", hot)
        monkeypatch.setattr(suffix_dedup, "SUFFIX_BYTES", most)
        got = suffix_dedup.dedup_suffixes(docs, length=length, gram=gram).collect()
        same([(r.doc_id, bytes(r.kept_text), r.n_bytes, r.n_removed, r.n_spans) for r in got], brute_suffixes(data(docs), length))
    assert suffix_dedup.dedup_suffixes(empty).count() == 0


def test_anchors_do_not_depend_on_the_slice():
    text = np.random.default_rng(2).integers(0, 256, 16 * suffix_dedup.SLICE, dtype=np.uint8)
    found = lambda a, b: suffix_dedup.contexts(text[a:b], np.array([0, b - a]), 50, 24)
    at, _, anchor, whole, _ = found(0, len(text))
    want = dict(zip(at.tolist(), zip(anchor.tolist(), whole.tolist())))
    # short pieces are last slices; runs cut off by a piece's ends aside, they must be those of the whole text
    for a in range(0, len(text), 700):
        first, last, anchor, whole, _ = found(a, min(a + 700, len(text)))
        for s, g, c in list(zip((first + a).tolist(), anchor.tolist(), whole.tolist()))[1:-1]:
            assert want[s] == (g, c)


def brute_fingerprint(t):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash(docs, empty):
    rows = data(docs)
    fps = [brute_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= 2 and group[j] > group[i]:
                    group[j], changed = group[i], True
    least = {}
    for g, (d, _) in zip(group, rows):
        if d is not None:
            least[g] = min(d, least.get(g, d))
    got = simhash.near_duplicates(docs).collect()
    same([(r.doc_id, r.fp % 2**64, r.component_id) for r in got], [(d, f, least.get(g)) for (d, _), f, g in zip(rows, fps, group)])
    assert simhash.near_duplicates(empty).count() == 0


def test_vantage_trees_find_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    near = np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) for _ in range(6))])
    points = np.unique(near)
    tree = simhash.VantageTree(points, leaf=4)
    got = {(int(a), int(b)) for q, p in tree.pairs(points, 2) for a, b in zip(q, p)}
    assert got == {(i, j) for i in range(len(points)) for j in range(len(points)) if int(points[i] ^ points[j]).bit_count() <= 2}
    monkeypatch.setattr(simhash, "SHARD_POINTS", 40)
    df = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "fp long")
    comp = {r.node: r.root for r in components(simhash.near_links(df)).collect()}
    up = {int(x): int(x) for x in points.view(np.int64)}
    for _ in range(len(up)):
        before = dict(up)
        for i, j in got:
            a, b = int(points[i : i + 1].view(np.int64)[0]), int(points[j : j + 1].view(np.int64)[0])
            up[a] = up[b] = min(up[a], up[b])
        if up == before:
            break
    assert {k: comp.get(k, k) for k in up} == up


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (102, 101), (5, 5), (200, 210), (210, 205)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100, 102: 100, 200: 200, 205: 200, 210: 200}


def test_network_gradients():
    net = language_id.ByteNetwork(["a", "b", "c"], hidden=3)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 257, (4, 6)), np.array([0, 1, 2, 1])
    _, g = net.gradients(x, y)
    for name in net.w:
        flat = net.w[name].reshape(-1)
        for i in np.flatnonzero(np.abs(g[name].reshape(-1)) > 1e-4)[:5]:
            old = flat[i]
            losses = []
            for step in (1e-3, -1e-3):
                flat[i] = old + step
                losses.append(net.gradients(x, y)[0])
            flat[i] = old
            assert abs((losses[0] - losses[1]) / 2e-3 - g[name].reshape(-1)[i]) < 2e-3


def test_network_layouts_agree():
    net = language_id.ByteNetwork(["a", "b"], hidden=4)
    x = np.random.default_rng(0).integers(0, 257, (5, 9))
    p = net.logits(net.states(x))
    p = np.exp(p - p.max(axis=2, keepdims=True))
    p /= p.sum(axis=2, keepdims=True)
    assert np.allclose(net.position_probabilities(x), p.transpose(2, 0, 1), atol=1e-5)


def plain_probabilities(net, text):
    """One text, one window, one direction and one byte at a time, in double precision."""
    n, w = net.hidden, {k: v.astype(np.float64) for k, v in net.w.items()}
    total = np.zeros(len(net.labels))
    for at in range(0, len(text), language_id.WINDOW):
        x = list(text[at : at + language_id.WINDOW])
        real = len(x)
        x += [language_id.PAD] * (language_id.WINDOW - real)
        logits = np.zeros((len(x), len(net.labels))) + w["c"]
        for d in range(2):
            h = np.zeros(n)
            for t in range(len(x)) if d == 0 else range(len(x) - 1, -1, -1):
                e, u = w["E"][d][x[t]], w["U"][d]
                z, r = 1 / (1 + np.exp(-(h @ u[:, :n] + e[:n]))), 1 / (1 + np.exp(-(h @ u[:, n : 2 * n] + e[n : 2 * n])))
                h = h + z * (np.tanh((r * h) @ u[:, 2 * n :] + e[2 * n :]) - h)
                logits[t] += h @ w["V"][d]
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        total += (p / p.sum(axis=1, keepdims=True))[:real].sum(axis=0)
    return total / max(1, len(text))


def test_predictions_against_a_plain_network(spark, docs):
    """Every prediction and score of op1's operator, by brute force."""
    net = language_id.ByteNetwork(["a", "b", "c"], hidden=5)
    for r in language_id.identify(docs, net).collect():
        if not re.search(r"[^\W\d_]", r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        p = plain_probabilities(net, r.text.encode())
        assert abs(r.score - p.max()) < 1e-4 and p[net.labels.index(r.lang_pred)] > p.max() - 1e-4, r.text[:80]


def test_language_id(spark, docs, empty):
    held = docs.select("doc_id", language_id.held_out("doc_id").alias("h")).collect()
    assert all(r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in held)
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    net = language_id.train(table.where(~language_id.held_out("doc_id")), steps=150, batch=128)
    got = language_id.identify(table.where(language_id.held_out("doc_id")), net).collect()
    assert sum(r.lang == r.lang_pred for r in got) > 0.95 * len(got)
    odd = language_id.identify(docs, net).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert {r.lang_pred == "und" for r in odd if not re.search(r"[^\W\d_]", r.text or "")} == {True}
    assert "und" not in {r.lang_pred for r in odd if re.search(r"[^\W\d_]", r.text or "")}
    assert language_id.identify(empty, net).count() == 0 and language_id.train(empty) is None
    assert language_id.identify(docs, None).where("lang_pred <> 'und'").count() == 0


URLS = [None, "", "nothing", "http://a.org", "http://a.org/x", "HTTP://A.ORG/X?y#z", "https://m.example.org/es/1", "http://example.org/en/12", "http://example.org/en/2", "http://notexample.org/en/12", "http://x.com/fr/", "http://x.com/fra", "http://x.com/de/1", "http://b.net/x.org/y", "http://b.net?x.org/", "http://b.net/a.exe", "http://h/://i.org/", "ü://ü.org/ü", "http://ads.x.net/1", "http://b.net/wp-login.php\n"]


def test_url_filter(spark):
    got = url_filter.filter_urls(spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS * 2)], "page_id long, url string, host string, rule string")).collect()
    for r in got:
        u = URLS[r.page_id % len(URLS)]
        host = path = ""
        if u and "://" in u:
            host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", u.split("://", 1)[1]).groups()
            host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [x for x, _ in url_filter.LIST_RULES if ("." + host).endswith("." + x.split("/")[0]) and path.startswith("/" + x.split("/", 1)[1])]
        rule = max(fits, key=len, default=None)
        assert (r.host, r.path, r.rule) == (host, path, rule), u
        assert r.verdict == (dict(url_filter.LIST_RULES)[rule] if rule else "block" if r.glob else "allow")


def test_wildcards():
    globs = ["*.a?/**", "**b*c", "", "x**", "*", "**/y/*"]
    pattern = [re.compile("(?s)" + "".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(x, re.escape(x)) for x in re.findall(r"\*\*|.", g))) for g in globs]
    texts = ["".join(RNG.choice("abcxy./") for _ in range(RNG.randrange(9))) for _ in range(500)]
    got = url_filter.WildcardAutomaton(globs * 9).matches([t.encode() for t in texts])
    assert (got == [[bool(p.fullmatch(t)) for p in pattern] * 9 for t in texts]).all()


def test_mixing(spark, docs, empty):
    md5 = lambda *x: hashlib.md5(":".join(map(str, x)).encode()).hexdigest()
    for budget, block in ((None, 4096), (None, 3), (500, 5), (20000, 2)):
        rows = [(r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")), md5(42, "" if r.doc_id is None else r.doc_id, md5(r.text or ""))) for r in docs.collect()]
        got = mixing.mix(docs, budget=budget, block_rows=block).collect()
        total = sum(r[2] for r in rows)
        tokens, size = {}, {}
        for _, s, n, _ in rows:
            tokens[s] = tokens.get(s, 0) + n
            size[s] = size.get(s, 0) + 1
        tokens = {s: n for s, n in tokens.items() if n}
        want = budget or total

        def facts(e):
            w = {s: (n / total) ** e for s, n in tokens.items()}
            z = sum(w.values())
            return -sum(x / z * np.log(x / z) for x in w.values()), max(x / z * want / tokens[s] for s, x in w.items()), {s: x / z for s, x in w.items()}

        fine = lambda e: facts(e)[0] <= 0.97 * np.log(len(tokens)) and facts(e)[1] <= 4
        low, high = 0.0, 1.0
        if not fine(1.0):
            low = 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (low, mid) if fine(mid) else (mid, high)
        reads = []
        for s, share in facts(high)[2].items():
            passes, rest = divmod(int(share * want + 1e-6), tokens[s])
            blocks = -(-size[s] // block)
            held = {}
            for r in rows:
                if r[1] == s:
                    held.setdefault(int(r[3][:8], 16) % blocks, []).append(r)
            for epoch in range(passes + 1):
                at = 0
                rank = lambda b: int(md5(42, epoch, str(s is None).lower(), s or "", b)[:15], 16)
                for b in sorted(held, key=rank):
                    inside = sorted(held[b], key=lambda r: (md5(epoch, r[3]), r[2], (r[0] is not None, r[0])))
                    all_ = sum(r[2] for r in inside)
                    left = rest - at
                    at += all_
                    if epoch == passes and left <= 0 and all_:
                        continue
                    done = 0
                    for place, r in enumerate(inside, 1):
                        done += r[2]
                        if epoch < passes or at <= rest or (left > 0 and done <= left):
                            reads.append((r[0], s, epoch, b, rank(b), place, r[2]))
        same([tuple(r) for r in got], reads)
        assert sum(r.n_tokens for r in got) <= want
    assert mixing.mix(empty).count() == 0


LICENSES = ["MIT License", "x mit-LICENSE y mit license", "permit license", "the GNU General  Public\nLicense, version 3", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: BSD-3-Clause", "apache license apache license üapache license", "Copyright 2020 X. All rights reserved.", "general public license" * 2]


def judged(t):
    """Brute force over every rule, without keywords: labels, their best priority, and the base phrases' places."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    stream = "".join(f" {x} " for x in w)
    found = {(m.start(), m.end(), p, label) for label, rx, p in COMPILED for m in rx.finditer(stream)}
    kept = {f for f in found if not any(g[0] <= f[0] and g[1] >= f[1] and g[2] <= f[2] and (g[:2] != f[:2] or (g[2], g[3]) < (f[2], f[3])) for g in found)}
    at = []
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        at += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    strong = min([f[2] for f in kept] + [2] * bool(at), default=None)
    return len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at})), ",".join(sorted({f[3] for f in kept} | {x for _, x in at})), license_scan.STRENGTH.get(strong, 0.0)


COMPILED = [(label, re.compile(rx), p) for label, _, p, rx in license_scan.RULES]
NOTICES = ["Permission is hereby granted, free of charge, to any person obtaining a copy", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted", "released under the GPL v3", "https://www.mozilla.org/MPL/2.0", "DO WHAT THE FUCK YOU WANT TO", "https://creativecommons.org/publicdomain/zero/1.0/", "GPL-2.0 or later", "may be used to endorse or promote products derived from this software without specific prior written permission", "published under MIT", "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General\n * Public License", "Creative Commons Attribution-NonCommercial"]
CLEAN = ["PHP compatible", "permit license", "we ruby and gems", "emit licensed", ""]


def test_license_scan(spark, docs, empty):
    samples = [sample(re._parser.parse(rx)).split() for _, _, _, rx in license_scan.RULES]
    texts = TEXTS + LICENSES + NOTICES + CLEAN + [RNG.choice([" ", ", ", "\n // "]).join(RNG.choice([str.upper, str.title, str])(w) for w in x) for x in samples]
    texts += [(" ".join(LICENSES + NOTICES) + " word ") * 40, "mit license " * 3000, "\u212a mit licen\u017fe mit license", " ".join(" ".join(x) for x in samples)]
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in enumerate(texts)], "doc_id long, text string, score int, __words string")
    assert len(license_scan.RULES) > 200
    got = license_scan.scan_licenses(df.drop("__words")).collect()
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == judged(r.text), r.text
    labels = {r.text: r.labels.split(",") for r in got}
    assert all(labels[t] != [""] for t in NOTICES) and all(labels[t] == [""] for t in CLEAN)
    assert license_scan.scan_licenses(docs).count() == docs.count() and license_scan.scan_licenses(empty).count() == 0


def sample(nodes):
    """A random text that a parsed regex matches, its look-arounds aside."""
    out = ""
    for op, x in nodes:
        op = str(op)
        if op == "LITERAL":
            out += chr(x)
        elif op == "NOT_LITERAL":
            out += "~"
        elif op == "IN":
            what, y = RNG.choice(x) if str(x[0][0]) != "NEGATE" else ("LITERAL", ord("~"))
            out += chr(RNG.randint(*y)) if str(what) == "RANGE" else {"CATEGORY_SPACE": " ", "CATEGORY_DIGIT": "7"}[str(y)] if str(what) == "CATEGORY" else chr(y)
        elif op == "MAX_REPEAT":
            out += "".join(sample(x[2]) for _ in range(RNG.randint(x[0], min(x[1], x[0] + 2))))
        elif op == "SUBPATTERN":
            out += sample(x[3])
        elif op == "BRANCH":
            out += sample(RNG.choice(x[1]))
    return out


def test_license_keywords_are_necessary():
    """Random texts of each rule match it, have its keyword, and lose no label to the prefilter."""
    for label, key, _, rx in license_scan.RULES:
        for _ in range(40):
            t = sample(re._parser.parse(rx))
            assert re.search(rx, t) and key in t.split(), (rx, t)


def test_embedding_dedup(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 24))
    x = np.concatenate([base, base[:20] + 0.02 * rng.standard_normal((20, 24)), np.tile(base[0], (30, 1)) + 0.02 * rng.standard_normal((30, 24))])
    rows = [(i, [float(v) for v in row], i % 2, 1.5, "t") for i, row in enumerate(x)]
    rows += [(200, None, 0, 1.0, "t"), (201, [0.0] * 24, 0, 1.0, "t"), (202, [float("nan")] * 24, 0, 1.0, "t"), (203, rows[0][1], None, 1.0, "t"), (204, [1.0, None] * 12, 0, 1.0, "t"), (205, [1.0, 2.0], 0, 1.0, "t"), (206, [2.0, 4.0], 0, 1.0, "t"), (207, [], 0, 1.0, "t"), (None, rows[0][1], 0, 1.0, "t"), rows[2], rows[2], (208, [float("inf")] * 24, 0, 1.0, "t")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node double, tile_id string")
    vs = [None if r[1] is None or None in r[1] or r[2] is None or not np.isfinite(r[1]).all() or not np.any(r[1]) else np.array(r[1], np.float32).astype(float) for r in rows]
    n = len(rows)
    links = [[j for j in range(n) if j != i and vs[i] is not None and vs[j] is not None and rows[i][2] == rows[j][2] and len(vs[i]) == len(vs[j]) and vs[i] @ vs[j] / (np.linalg.norm(vs[i]) * np.linalg.norm(vs[j])) >= 0.98] for i in range(n)]
    group = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in links[i]:
                group[i] = group[j] = min(group[i], group[j])
    least = {}
    for g, r in zip(group, rows):
        if r[0] is not None:
            least[g] = min(r[0], least.get(g, r[0]))
    want = [(r[0], len(k), least.get(g), r[0] == least.get(g)) for r, k, g in zip(rows, links, group)]
    for tile, block in ((4096, 1024), (7, 1024), (50, 9)):
        monkeypatch.setattr(embedding_dedup, "BLOCK", block)
        same([tuple(r) for r in embedding_dedup.dedup_embeddings(df, tile=tile).collect()], want)
    assert embedding_dedup.dedup_embeddings(df.limit(0)).count() == 0


def test_chat_format(spark):
    odd = ["\\", "<|", "<\\|", "\\<|", "<|im_end|>\n", "a\\n", "日本<|im_start|>user\n", "", None, "long " * 3000]
    rows = [(c, t, RNG.choice(["user", "assistant", "system", None, "to\nol", "r\\n<|"]) if t else "system", RNG.choice(odd), "x") for c in range(12) for t in range(RNG.randrange(1, 40))]
    rows += [(None, 0, "user", "x", "y"), (None, 1, "assistant", "z", "y"), rows[0], (99, None, "assistant", "ok", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window string")
    windows = chat_format.format_windows(df, budget=200, history_budget=80)
    back = {r.conv_id: r for r in chat_format.read_back(windows).collect()}
    for c in {r[0] for r in rows}:
        mine = sorted(((r[1] is not None, r[1], r[2] or "", r[3] or "") for r in rows if r[0] == c), key=lambda r: (r[0], r[1] or 0, r[2], r[3]))
        assert back[c].n_turns == len(mine)
        assert back[c].turns == "".join(f"{r}\n{t}\n" for *_, r, t in mine)
        assert back[c].loss_text == "".join(t for *_, r, t in mine if r == "assistant")
    assert max(w.n_repeated for w in windows.collect()) > 1
    assert chat_format.read_back(chat_format.format_windows(df.limit(0))).count() == 0


def test_chat_windows_keep_the_budget(spark):
    """Budget, system turn, history and mask of every window, against the turns it must hold."""
    rows = []
    for c in range(60):
        system = RNG.choice([None, 40, 700, 6000])
        turns = ([("system", "s" * system)] if system else []) + [(RNG.choice(["user", "assistant"]), RNG.choice("abc<|") * RNG.choice([0, 3, 90, 400, 2000, 5000])) for _ in range(RNG.randrange(1, 30))]
        rows += [(c, i, r, t) for i, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    piece = lambda r, t: f"<|im_start|>{r}\n" + t.replace("\\", "\\\\").replace("<|", "<\\|") + "<|im_end|>\n"
    for budget, history, count in ((1024, 256, None), (1024, 256, lambda c: F.length(c).cast("long")), (300, 50, None), (1024, 0, None)):
        size = (lambda p: len(p)) if count else (lambda p: -(-len(p) // 4))
        windows = chat_format.format_windows(df, budget=budget, history_budget=history, **({"tokens": count} if count else {})).orderBy("conv_id", "window").collect()
        crowded = 0
        for c in range(60):
            turns = [(r, t) for d, _, r, t in rows if d == c]
            system = turns[0] if turns[0][0] == "system" else None
            done = 0
            for k, w in enumerate(x for x in windows if x.conv_id == c):
                pieces = [p + "<|im_end|>\n" for p in w.text.split("<|im_end|>\n")[:-1]]
                assert w.n_tokens == sum(map(size, pieces))
                own = pieces[w.n_repeated :]
                assert own == [piece(*x) for x in turns[done : done + len(own)]]
                repeated = pieces[: w.n_repeated]
                if k and system:
                    assert repeated.pop(0) == piece(*system)
                else:
                    assert k or not repeated
                assert len(repeated) <= 2 and repeated == [piece(*x) for x in turns[done - len(repeated) : done]] and sum(map(size, repeated)) <= history
                crowded += len(repeated)
                if w.n_tokens > budget:
                    assert not repeated and len(own) - (k == 0 and system is not None) <= 1
                want = [t for r, t in turns[done : done + len(own)] if r == "assistant"]
                assert [w.text[s.start : s.end].replace("<\\|", "<|").replace("\\\\", "\\") for s in w.loss] == want
                done += len(own)
            assert done == len(turns)
        assert crowded or not history


def test_decontamination(spark, docs, empty, monkeypatch):
    items = [(0, PASSAGE), (1, " ".join(PASSAGE.split()[20:31])), (2, "123"), (3, None), (4, "!"), (10, TEXTS[2]), (11, TEXTS[2].upper()), (5, "then then ing")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = {}
    for i, t in items:
        w = split(t)
        size = min(10, len(w))
        for a in range(len(w) - size + 1 if size else 0):
            wins.setdefault(tuple(w[a : a + size]), set()).add(str(i))
    want = []
    for d, t in data(docs):
        w, hit, found = split(t), set(), set()
        for size in {len(k) for k in wins}:
            for a in range(len(w) - size + 1):
                if k := wins.get(tuple(w[a : a + size])):
                    hit |= set(range(a, a + size))
                    found |= k
        want.append((d, len(w), len(hit), sorted(found), bool(hit)))
    for most in (1 << 20, -1):
        monkeypatch.setattr(decontamination, "BROADCAST_BYTES", most)
        monkeypatch.setattr(decontamination, "SUSPECT_NUMBERS", most)
        monkeypatch.setattr(decontamination, "SEARCHED", 64 if most > 0 else 1)
        got = decontamination.decontaminate(docs, bench).collect()
        same([(r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in got], want)
    assert decontamination.decontaminate(empty, bench).count() == 0
    assert decontamination.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_decontamination_of_long_items(spark):
    """Items of 400 and 4,000 words, wholly inside documents; no filter makes the grams anew."""
    rng = random.Random(9)
    long_ = [" ".join(f"{rng.choice(VOCAB)}{rng.randrange(999)}" for _ in range(n)) for n in (400, 4000)]
    bench = spark.createDataFrame(list(enumerate(long_)), "item_id long, text string")
    docs = spark.createDataFrame([(i, f"{'clean words ' * 50}{t}{' more' * 9}") for i, t in enumerate([*long_, long_[1][:3000], "nothing"])], "doc_id long, text string")
    plans = []
    seen = decontamination.C.written

    def watched(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return seen(df, name)

    decontamination.C.written = watched
    try:
        got = {r.doc_id: r for r in decontamination.decontaminate(docs, bench).collect()}
    finally:
        decontamination.C.written = seen
    words = lambda t: len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t))
    assert [got[i].n_hit for i in range(2)] == [words(t) for t in long_]
    assert words(long_[1][:3000]) - 1 <= got[2].n_hit <= words(long_[1][:3000]) and not got[3].contaminated
    assert [got[i]["items"] for i in range(4)] == [["0"], ["1"], ["1"], []]
    filters = [line for plan in plans for line in plan.split("\n") if "Filter" in line]
    assert filters and not any("xxhash64" in line for line in filters)  # no filter makes gram hashes


def test_dealing_to_shards():
    """Every point has one home; of two points within the radius, one at least is dealt to the other's home."""
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    points = np.unique(np.concatenate([centres ^ (np.uint64(1) << rng.integers(0, 63, 40).astype(np.uint64)) for _ in range(30)] + [centres, rng.integers(0, 1 << 63, 500, dtype=np.uint64)]))
    for depth in (0, 1, 4, 6):
        i, shard, home = simhash.dealt(points, simhash.shard_tree(points[::3], depth), depth, 2)
        own = np.full(len(points), -1)
        own[i[home]] = shard[home]
        assert home.sum() == len(points) and (own >= 2**depth).all() and (own < 2 ** (depth + 1)).all()
        there = set(zip(i.tolist(), shard.tolist()))
        assert len(there) == len(i)
        a, b = np.nonzero(np.triu(simhash.hamming(points[:, None], points[None, :]) <= 2, 1))
        assert len(a) > 100 and all((x, own[y]) in there or (y, own[x]) in there for x, y in zip(a.tolist(), b.tolist()))
        assert (shard[~home] > own[i[~home]]).all()


def test_empty_pages(spark, tmp_path):
    """Without pages there are no verdicts."""
    spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(0).write.parquet(f"{tmp_path}/pages.parquet")
    out = url_filter.op2_url_filter(spark, str(tmp_path))
    assert out.count() == 0 and {"page_id", "host", "path", "rule", "verdict"} <= set(out.columns)

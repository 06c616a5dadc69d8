"""Every stage of the pipeline against what it must keep, each on its predecessor's output."""

import random
import re

import duckdb
import pytest

from benchloom.llm import common, language_id, mixing, near_copies, simhash
import corpus_pipeline as P
from test_operators import brute_suffixes

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def similar_groups(texts):
    """Brute force: a number for each text, equal for texts linked by similarities of 0.8 or more."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    group = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if group[i] != group[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return group


def test_stages(spark, tmp_path):
    sf = str(tmp_path)
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(COLUMNS)
    odd = [(1000, None, "en", "s", 0), (1001, "!!! 12", "en", None, 6), (None, "a text without an id and words of its own kind", None, "s", 4), (None, "another text without an id, of other words", "en", "s", 4)]
    docs = real.unionByName(spark.createDataFrame(odd, real.schema)).unionByName(real.limit(2))
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(f"{sf}/benchmark.parquet")
    rows = [docs]
    for name, stage in P.STAGES:
        rows.append(common.written(stage(spark, rows[-1], sf), name))
    assert [r.columns for r in rows[1:-1]] == [COLUMNS] * 4
    raw, known, single, cut, clean, reads = ([r for r in x.collect()] for x in rows)
    texts = lambda x: sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in x)
    assert texts(known) == texts([r for r in raw if re.search(r"[^\W\d_]", r.text or "")])
    # near duplicates: texts that share 0.8 of their 5-word shingles; of each group the smallest id
    group = similar_groups([r.text for r in known])
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text)
    assert texts(single) == texts([min((r for r, h in zip(known, group) if h == g), key=key) for g in set(group)])
    brute = [(d, b.decode(errors="replace")) for d, b, _, n, _ in brute_suffixes([(r.doc_id, r.text) for r in single], 50) if b or not n]
    assert sorted(((r.doc_id, r.text) for r in cut), key=repr) == sorted(brute, key=repr)
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = {tuple(split(r.text)[i : i + 10]) for r in common.table(spark, sf, "benchmark").collect() for i in range(max(0, len(split(r.text)) - 9))}
    assert texts(clean) == texts([r for r in cut if not any(tuple(split(r.text)[i : i + 10]) in wins for i in range(len(split(r.text)) - 9))])
    # the reads are those of the mixing oracle over what decontamination kept
    duck = duckdb.connect()
    duck.register("documents", rows[-2].toArrow())
    found = duck.execute(mixing.ORACLE)
    names = [c[0] for c in found.description]
    assert reads and sorted(rows[-1].columns) == sorted(names)
    assert sorted((tuple(r[n] for n in names) for r in reads), key=repr) == sorted(found.fetchall(), key=repr)


def test_language_stage_reads_texts_once(spark):
    """A filter pushed below the projection would run the network twice, in two workers for each task."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(COLUMNS)
    plan = P.identify_language(spark, docs, "")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_near_copies(spark):
    """Planted copies at 0.8 to 0.95 go, copies below 0.8 stay."""
    rng = random.Random(5)
    words = lambda n: [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(10**6)) for _ in range(n)]
    shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    rows, near, far = [], set(), set()
    for n in (60, 120, 200, 350, 600):
        for edits in range(1, n // 25):
            for _ in range(4):
                one = words(n)
                two = list(one)
                for at in rng.sample(range(n), edits):
                    two[at] = words(1)[0]
                one, two = " ".join(one), "  ".join(two).upper()
                a, b = shingles(one), shingles(two.lower())
                rows += [(len(rows), one), (len(rows) + 1, two)]
                (near if len(a & b) >= 0.8 * len(a | b) else far).add(len(rows) - 1)
    assert len(near) > 60 and len(far) > 60
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in P.drop_near_duplicates(spark, docs, "").collect()}
    assert {i for i in range(0, len(rows), 2)} | far <= kept
    assert not near & kept


def test_near_copies_of_documents(spark):
    """The stage against brute force over the shingle sets of the smallest table."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(COLUMNS).where("text is not null")
    rows = docs.collect()
    group = similar_groups([r.text for r in rows])
    want = {min((r.doc_id, r.text) for r, h in zip(rows, group) if h == g) for g in set(group)}
    assert {(r.doc_id, r.text) for r in P.drop_near_duplicates(spark, docs, "").collect()} == want


def test_clusters_in_tiles(spark, monkeypatch):
    """One chain of copies, too large for a tile or a group, and single texts: as brute force has it."""
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(10**6))
    texts, chain = [], [word() for _ in range(80)]
    for _ in range(150):
        chain = list(chain)
        for at in rng.sample(range(80), rng.choice([1, 1, 2, 4])):
            chain[at] = word()
        texts.append(" ".join(chain))
    texts += [" ".join(word() for _ in range(30)) for _ in range(20)] + ["", None, " ", "a b", "A  b"]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, key string, bands string, n_chars long")
    want = similar_groups(texts)
    for group, tile, pivots in ((2048, 1024, 64), (6, 1024, 64), (6, 20, 4), (2048, 20, 1)):
        for name, value in (("GROUP", group), ("TILE", tile), ("PIVOTS", pivots)):
            monkeypatch.setattr(near_copies, name, value)
        got = {r.doc_id: r.group for r in near_copies.near_copies(docs).collect()}
        assert len({(got[i], want[i]) for i in got}) == len(set(want)) == len(set(got.values()))
    assert near_copies.near_copies(docs.limit(0)).count() == 0


def test_copies_in_regions(spark, monkeypatch):
    """Fingerprints dealt by Hamming regions: all pairs within two bits are linked, and copies among them go without any band."""
    rng = random.Random(21)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(10**6))
    texts = []
    for _ in range(40):
        one = [word() for _ in range(400)]
        texts += [" ".join(one), " ".join([word(), *one[1:]]), " ".join([*one[:-2], word(), word()])]
    texts += ["a b", "A  b", "", None] + [" ".join(word() for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = near_copies.sketches(docs, "doc_id", "text", near_copies.SHINGLE).collect()
    fps = {r.doc_id: r.fp % 2**64 for r in rows}
    near = [(i, j) for i in fps for j in range(i) if texts[i] and texts[j] and (fps[i] ^ fps[j]).bit_count() <= simhash.RADIUS]
    assert sum(j < i < 120 for i, j in near) > 20
    monkeypatch.setattr(simhash, "SHARD_POINTS", 30)
    dealt = []
    deal = simhash.region_tree
    monkeypatch.setattr(simhash, "region_tree", lambda points: dealt.append(deal(points)) or dealt[-1])
    monkeypatch.setattr(near_copies, "candidates", lambda points, _: spark.createDataFrame([], "a long, b long"))
    got = {r.doc_id: r.group for r in near_copies.near_copies(docs).collect()}
    assert dealt and dealt[0][1] >= 3
    similar = similar_groups(texts)
    assert all(got[i] == got[j] for i, j in near if similar[i] == similar[j])
    assert all(similar[i] == similar[j] for i in got for j in range(i) if got[i] == got[j])


def test_rejected_by_score(spark, monkeypatch):
    """Documents whose best language holds too small a share of their positions go, all others stay."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(COLUMNS)
    odd = spark.createDataFrame([(5000, "zq xkcd vbnw qqq zzx", None, "s", 3), (5001, "Ð ж ß ع " * 30, None, "s", 3)], docs.schema)
    docs = common.written(docs.unionByName(odd), "docs")
    scores = {r.doc_id: (r.p, r.s) for r in language_id.identify(docs, language_id.train(docs), pred="p", score="s").collect()}
    least = sorted(s for _, s in scores.values())[len(scores) // 4]
    monkeypatch.setattr(P, "LEAST_SCORE", least)
    kept = {r.doc_id for r in P.identify_language(spark, docs, "").collect()}
    assert kept == {d for d, (p, s) in scores.items() if p != "und" and s >= least} and 0 < len(kept) < len(scores)


def test_empty_tables(spark, tmp_path):
    """Without documents every stage and the whole pipeline are empty, with the columns they always have."""
    sf = str(tmp_path)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(COLUMNS).limit(0)
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(f"{sf}/benchmark.parquet")
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == COLUMNS and out.count() == 0
    assert P.run(spark, sf).count() == 0


def test_resumed(spark, tmp_path, monkeypatch):
    """A driver that died goes on after the last stored stage; nothing but the result is left behind."""
    import os

    sf = str(tmp_path / "sf")
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id % 4 = 0").write.parquet(f"{sf}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(f"{sf}/benchmark.parquet")
    shared = tmp_path / "shared"
    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{shared}")
    want = sorted(map(repr, P.run(spark, sf).collect()))
    assert want and [len(os.listdir(shared / d)) for d in os.listdir(shared)] == [1]

    def dies(*_):
        raise RuntimeError("killed")

    stages = list(P.STAGES)
    monkeypatch.setattr(P, "STAGES", [*stages[:3], (stages[3][0], dies), stages[4]])
    for _ in range(2):
        with pytest.raises(RuntimeError, match="killed"):
            P.run(spark, sf, resume="nightly")
        monkeypatch.setattr(P, "STAGES", [(stages[0][0], None), (stages[1][0], None), (stages[2][0], None), (stages[3][0], dies), stages[4]])
    monkeypatch.setattr(P, "STAGES", [(stages[0][0], None), (stages[1][0], None), (stages[2][0], None), *stages[3:]])
    assert sorted(map(repr, P.run(spark, sf, resume="nightly").collect())) == want
    assert os.listdir(shared / "pipeline-nightly") == ["4-temperature_mixing"] and len(os.listdir(shared)) == 2

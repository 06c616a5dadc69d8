import json
import random
import shutil
import subprocess

import numpy as np
import pytest
from pyspark.sql import functions as F

from benchloom.functions import code_blocks, py_syntax, settings, subwords
from benchloom.functions import text as T
from benchloom.operators import curate, generate, languages, packing, results, runner
from benchloom.sources import spec

FENCE = "`" * 3


def model_final_block(r):
    """Line by line, independent of the regular expressions."""

    def cut(lines):
        return lines[: next((i for i, x in enumerate(lines) if x == FENCE), len(lines))]

    def clean(t):
        t = t.lstrip()
        lines = t.split("\n")
        if t.startswith(FENCE) and len(lines) > 1:
            lines = lines[1:]
            while len(lines) > 1 and lines[0] == "":
                lines = lines[1:]
        kept = cut(lines)
        return "\n".join(kept) + ("\n" if len(kept) < len(lines) and kept else "")

    lines, i, last, after = r.split("\n"), 0, None, None
    open_left = False
    while i < len(lines):
        if lines[i].startswith(FENCE) and i + 1 < len(lines):
            j = i + 1
            while j < len(lines) - 1 and lines[j] == "":
                j += 1
            k = next((m for m in range(j, len(lines)) if lines[m] == FENCE), None)
            if k is None:
                open_left = True
                break
            last = "".join(x + "\n" for x in lines[j:k])
            i = k + 1
            while i < len(lines) - 1 and lines[i] == "":
                i += 1
            after = "\n".join(lines[i:]).lstrip("\n")
        else:
            i += 1
    if last is not None and not last.strip() and not open_left:
        kept = cut(after.split("\n"))
        out = "\n".join(kept) + ("\n" if len(kept) < len(after.split("\n")) and kept else "")
    elif last is not None:
        out = clean(last)
    elif open_left:
        out = None
    elif r.startswith((FENCE, "import ", "from ")) or len(r) < 100 or "\n" in r:
        out = clean(r)
    else:
        out = None
    return out or None


CASES = [
    ("", None), (f"{FENCE}lua\nx=1\n{FENCE}\n", "x=1\n"), (f"{FENCE}\na\n{FENCE}\n{FENCE}\nb\n{FENCE}", "b\n"), (f"{FENCE}\na\n{FENCE}\n{FENCE}py\nrest", "a\n"), (f"{FENCE}py\nrest", None),
    ("two\nlines", "two\nlines"), ("x" * 120, None), ("import " + "x" * 120, "import " + "x" * 120), (f"{FENCE}\n{FENCE}\n trailing", " trailing"), (f"{FENCE}\na\n{FENCE} \n{FENCE}", f"a\n{FENCE} \n"),
]


def test_final_block(spark):
    rng = random.Random(5)
    parts = [FENCE, FENCE + "py", "\n", "\n", "a", " b", "import x", ""]
    texts = [t for t, _ in CASES] + ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(300)]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(T.final_block(F.col("t"))).collect()]
    assert got[: len(CASES)] == [a for _, a in CASES]
    assert [(t, g) for t, g in zip(texts, got) if g != model_final_block(t)] == []


def test_pack():
    starts, total = packing.pack_starts(np.array([3, 5, 4, 0, 7]), 4)
    assert (starts.tolist(), total) == ([0, 4, 10, 15, 16], 23)


def test_pack_rows(spark):
    df = spark.createDataFrame([(0, [1, 2, 3]), (1, [4, 5, 6, 7, 8]), (2, [])], "k int, tokens array<bigint>")
    assert [r.input_ids for r in packing.pack(df, 4, 0, "k").orderBy("row").collect()] == [[1, 2, 3, 0], [4, 5, 6, 7], [8, 0]]


def test_ordinals(spark):
    df = spark.range(1000).withColumn("k", F.md5(F.col("id").cast("string")))
    got = curate.with_ordinal(df.repartition(7), ["k"]).orderBy("k").select("idx").collect()
    assert [r.idx for r in got] == list(range(1000))


def test_required_lookup(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    with pytest.raises(Exception, match="no row for key"):
        curate.required_lookup(a, b, "k").collect()


@pytest.mark.parametrize("text, want", [("jsonl:a.jsonl:limit=3", {"limit": 3}), ("hub:x:split=train:private=false", {"split": "train", "private": "false"}), ("csv:a.csv:x", {"x": True})])
def test_spec(text, want):
    assert spec.parse_spec(text).flags == want


@pytest.mark.parametrize("text", ["zip:a", "hub:x", "csv:"])
def test_bad_spec(text):
    with pytest.raises(ValueError):
        spec.parse_spec(text)


def test_specs_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", None), ("b", "c")], "x string, y string")
    for kind, extra in (("jsonl", ""), ("disk", ""), ("hub", ":split=train"), ("csv", "")):
        name = f"{kind}:{tmp_path}/{kind}{extra}"
        spec.write_spec(df, name)
        assert sorted(r.x for r in spec.read_spec(spark, name).collect()) == ["a", "b"]
    with pytest.raises(ValueError):
        spec.write_spec(df.limit(0), f"disk:{tmp_path}/none")


def test_line_ranges(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x":0}\n{"x":1}\nbad\n{"x":3}\n')
    got = spec.read_lines(spark, f"{tmp_path}/a.jsonl", "x int", 1, 4, allow_malformed=True).collect()
    assert [r.x for r in got] == [1, 3]


def test_runner_limits():
    run = lambda code: runner.run_item(code, [{"input": "", "output": ""}], "python", 3.0)["status"]
    assert run("x = 'a' * (4 << 30)") == "fail:error"
    assert run("import sys\nsys.stdout.write('y' * (2 << 20))") == "fail:wrong-output"
    assert runner.run_item("x", [{"input": "", "output": ""}], "nope", 1.0)["status"] == "fail:exception"


def c_compiles():
    """gcc may be there without its compiler proper."""
    return runner.available("c") and shutil.which(subprocess.run(["gcc", "-print-prog-name=cc1"], capture_output=True, text=True).stdout.strip()) is not None


@pytest.mark.skipif(not c_compiles(), reason="no C compiler")
def test_runner_c():
    longest = '#include <stdio.h>\n#include <string.h>\nint main(void) { char w[99]; size_t most = 0; while (scanf("%98s", w) == 1) if (strlen(w) > most) most = strlen(w); printf("%zu", most); return 0; }'
    assert runner.run_item(longest, [{"input": "ab c\nabcde", "output": "5\n"}], "c", 5.0)["status"] == "success"
    assert runner.run_item("int main(", [{"input": "", "output": ""}], "c", 5.0)["status"] == "fail:error"


def test_whole_output_is_compared():
    run = lambda code, want: runner.run_item(code, [{"input": "", "output": want}], "python", 5.0)["status"]
    assert run("print('y' * (2 << 20))", "y" * (2 << 20)) == "success"
    assert run("print('y' * (2 << 20) + 'z')", "y" * (2 << 20)) == "fail:wrong-output"
    assert len(runner.cut("ü" * (2 << 20)).encode()) <= runner.OUTPUT


def test_languages_from_configuration():
    assert languages.registered({"x": 'filename: a.x\nprompt: Use X.\ncompile: xc a.x -o a\nexecute: ./a "b c"\n'}) == {"x": ("a.x", ["xc", "a.x", "-o", "a"], ["./a", "b c"], {})}
    for bad in ('{"filename": "a"}', '{"filename": "a", "prompt": "p", "execute": "e", "more": 1}', '{"filename": "a", "prompt": "p", "execute": "e", "container": {"base-image": "x"}}', '{"filename": "a", "prompt": "p", "execute": "e", "install": "a\\nb"}'):
        with pytest.raises(ValueError):
            languages.parse_language(bad)


def test_settings():
    assert settings.parse_optimizer("AdamW(lr=5e-6, betas=(0.9, 0.95) fused=True)") == ("AdamW", {"lr": 5e-6, "betas": (0.9, 0.95), "fused": True})
    assert settings.parse_scheduler("cosine(warmup_ratio=0.1)", 1005) == ("cosine", 100) and settings.parse_scheduler("constant()", 9) == ("constant", 0)
    for bad in ("AdamW", "SGD(lr=1)", "Adam(lr=1 lr=2)", "Adam(momentum=1)", "Adam(lr=True)", "Adam(betas=(1))", "Adam(lr)"):
        with pytest.raises(ValueError):
            settings.parse_optimizer(bad)
    with pytest.raises(ValueError):
        settings.parse_scheduler("cosine(warmup_ratio=0.1 warmup_steps=3)", 9)
    assert [settings.worker_count(x, 40) for x in (None, 0, 5)] == [16, 39, 5] and settings.worker_count(None, 1) == 1
    assert settings.exclusive(a=1, b=None) == "a" and settings.exclusive(a=None) is None
    for options in ({"a": 1, "b": 2}, {"a": None, "need_one": True}):
        with pytest.raises(ValueError):
            settings.exclusive(**options)


def test_splits_insist(spark):
    pool = spark.range(10).withColumnRenamed("id", "k")
    assert curate.split(pool, "k", 3, forced=[0, 1], strict=True).count() == 5
    with pytest.raises(Exception, match="fewer than 11"):
        curate.split(pool, "k", 11, strict=True).collect()
    with pytest.raises(Exception, match="forced"):
        curate.split(pool, "k", 3, forced=[0, 99], strict=True).collect()
    with pytest.raises(Exception, match="forced"):
        curate.split(pool, "k", 3, forced=[98, 99], strict=True).collect()
    with pytest.raises(Exception, match="differ in length"):
        curate.joined_by_position(pool, pool.limit(3).withColumnRenamed("k", "j"), ["k"], ["j"]).collect()


def test_lookups_insist(spark):
    calls = spark.createDataFrame([("a", 1, 2), ("b", 1, 2)], "model string, tokens_in int, tokens_out int")
    prices = spark.createDataFrame([("a", "1.5", "2")], "model string, price_in string, price_out string")
    assert str(results.token_cost(calls.where("model = 'a'"), prices).first().cost) == "0.000005500000"
    with pytest.raises(Exception, match="unknown key b"):
        results.token_cost(calls, prices).collect()
    attached = results.attach_tests(spark.createDataFrame([("1",), ("2",)], "idx string"), spark.createDataFrame([("1", "x")], "idx string, examples string"))
    with pytest.raises(ValueError, match="1 of 2"):
        results.fail_on_missing(attached)
    assert results.fail_on_missing(attached.where("idx = '1'")) == 1


def test_strict_ranges(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x":0}\n{"x":1}\nbad\n{"x":3}\n')
    with pytest.raises(Exception, match="malformed line 2"):
        spec.read_lines(spark, f"{tmp_path}/a.jsonl", "x int", 1, 4).collect()
    assert [r.x for r in spec.read_lines(spark, f"{tmp_path}/a.jsonl", "x int", 0, 2).collect()] == [0, 1]
    with pytest.raises(Exception, match="required"):
        spec.require_columns(spark.createDataFrame([(None,)], "x int"), ["x"]).collect()
    (tmp_path / "doc.json").write_text('{\n"a": [1,\n2]}')
    assert spec.read_json_document(spark, f"{tmp_path}/doc.json").first().a == [1, 2]


def test_nulls_are_written(spark, tmp_path):
    spec.write_spec(spark.createDataFrame([("a", None)], "x string, y string").coalesce(1), f"jsonl:{tmp_path}/n")
    assert '"y":null' in "".join(p.read_text() for p in (tmp_path / "n").glob("part*"))


def test_steps(spark, tmp_path):
    out = f"{tmp_path}/step"
    spec.start_step(spark, out)
    spec.write_document(spark, f"{out}/config.json", {"n": 1})
    with pytest.raises(FileExistsError):
        spec.start_step(spark, out)
    assert (tmp_path / "step" / "config.json").read_text() == '{\n  "n": 1\n}'
    spec.start_step(spark, out, force=True)
    with pytest.raises(FileNotFoundError):
        spec.read_step(spark, f"{out}/result", "x int")
    with pytest.raises(ValueError):
        spec.log_table(spark, f"{out}/t", 1, "t", [["a"], ["b", "c"]])
    (tmp_path / "s" / "sub").mkdir(parents=True)
    (tmp_path / "s" / "sub" / "one.py").write_text("print(1)")
    assert [tuple(r) for r in spec.read_scripts(spark, f"{tmp_path}/s").collect()] == [("sub/one", "print(1)")]
    parts = spark.createDataFrame([(1, "train"), (2, "test")], "k int, split string")
    spec.write_split(parts, f"{tmp_path}/parts")
    assert spec.read_split(spark, f"{tmp_path}/parts", "test", ["k"]).collect() == [(2,)]


def test_code_blocks():
    found = lambda t, **o: code_blocks.code_blocks(t, **o)
    assert found("") == ([], 0) and found("x = 1") == ([], 5)
    assert found("x = 1\n\ny = (\n\nz = 2\n</think>\nend") == ([("x = 1", 0), ("z = 2", 14)], 29)
    assert found(f"{FENCE}py\nx = 1\n{FENCE}\n\nplain words") == ([("x = 1\n", 0)], len(f"{FENCE}py\nx = 1\n{FENCE}\n\nplain words"))
    long_ = "a" * 120
    assert found(f"{long_}\n\n# {long_}\n\n") == ([(f"# {long_}", 122)], 246)


def test_generation_failures(spark):
    prompts = spark.createDataFrame([(str(i), f"p{i}") for i in range(6)], "idx string, prompt string").coalesce(1)

    def broken(prompts, n, **_):
        if "p3" in prompts:
            raise ValueError("no")
        return [[p] * n for p in prompts]

    got = generate.generate(prompts, broken, 2, batch=2).collect()
    assert {(r.idx, r.sample_idx) for r in got} == {(str(i), k) for i in range(6) for k in range(2)}
    assert {r.idx for r in got if r.error} == {"2", "3"} and all((r.response is None) == (r.error is not None) for r in got)

    async def ask(prompt, **_):
        if prompt == "p1":
            raise OSError
        return prompt + "!"

    assert [(r.response, r.error) for r in generate.generate(prompts, generate.per_request(ask, 2), 1).collect()] == [(None, "request failed") if i == 1 else (f"p{i}!", None) for i in range(6)]


def test_packing_with_masks(spark):
    df = spark.createDataFrame([(0, [1, 2, 3], [0, 0, 1]), (1, [4, 5, 6, 7, 8], [0, 1, 1, 1, 1]), (2, [], [])], "k int, tokens array<bigint>, prompt_mask array<bigint>")
    got = packing.pack(df, 4, 9, "k", masks={"prompt_mask": 1}).orderBy("row").collect()
    assert [(r.input_ids, r.prompt_mask) for r in got] == [([1, 2, 3, 9], [0, 0, 1, 1]), ([4, 5, 6, 7], [0, 1, 1, 1]), ([8, 9], [1, 1])]


def test_text_rules(spark):
    row = spark.createDataFrame([("<think>\n\n a", " <think>x", "x\u3000\x1f \n", f"{FENCE}c++\nint x;\n{FENCE}")], "a string, b string, c string, d string")
    got = row.select(T.strip_open_think(F.col("a")), T.strip_open_think(F.col("b")), T.rstrip(F.col("c")), T.first_block(F.col("d"), "c++")).first()
    assert tuple(got) == ("\n a", " <think>x", "x", "int x;\n")
    assert T.looks_like_io_answer is not None
    with pytest.raises(Exception, match="MALFORMED"):
        row.select(T.parsed(F.lit("{x"), strict=True)).collect()


def test_commands_from_the_shell(spark, tmp_path, capsys):
    from benchloom import commands

    spark.createDataFrame([("1", "Say 1"), ("2", "refuse")], "idx string, prompt string").write.json(f"{tmp_path}/made/result")
    commands.main(["generate", f"{tmp_path}/made", f"{tmp_path}/said", "--n", "2"])
    commands.main(["extract-answers", f"{tmp_path}/said", f"{tmp_path}/answers"])
    spark.createDataFrame([("1", [("", "5")])], "idx string, test_cases array<struct<input:string,output:string>>").write.json(f"{tmp_path}/tests")
    commands.main(["verify-answers", f"{tmp_path}/answers", f"jsonl:{tmp_path}/tests", f"{tmp_path}/v", "python", "--keep-worker"])
    commands.main(["describe-verify-results", f"{tmp_path}/v"])
    assert "50.00%" in capsys.readouterr().out
    with pytest.raises(FileExistsError):
        commands.main(["extract-answers", f"{tmp_path}/said", f"{tmp_path}/answers"])


def test_subwords_by_a_public_vocabulary(spark):
    """The same ids as a library of its own gives, also for long words of one letter."""
    import tiktoken

    public_tokenizers = pytest.importorskip("public_tokenizers")
    vocabulary = subwords.read_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    ranks = {bytes(r.token): r["rank"] for r in vocabulary.collect()}
    other = tiktoken.Encoding("other", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()] + [None, "", "x" * 30_000, "ab" * 9_999, "日本語 ü \n\n  a", "<|endoftext|> it's"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").orderBy("i")
    got = [r.t for r in rows.select("i", subwords.tokens(subwords.tokenizer(vocabulary, public_tokenizers.PATTERN), F.col("text")).alias("t")).orderBy("i").collect()]
    assert got == [other.encode_ordinary(t or "") for t in texts]
    with pytest.raises(ValueError, match="no token"):
        subwords.merged(b"ab", {b"a": 0})


def test_subwords_leave_in_small_batches(spark, monkeypatch):
    """A worker hands rows on before it has all tokens of a batch; nulls, empty rows and their order stay."""
    import pyarrow as pa

    monkeypatch.setattr(subwords, "TOKENS_AT_ONCE", 10)
    monkeypatch.setattr(subwords, "REMEMBERED", 2)
    encode = subwords.tokenizer(spark.createDataFrame([(bytearray([i]), i) for i in range(256)], "token binary, rank int"))
    rows = [["a b", None], None, [], ["é" * 70], ["x " * 3], [], [""], ["yy"], None]
    batches = [pa.array(part, pa.list_(pa.string())) for part in (rows[:4], rows[4:4], rows[4:])]
    got = list(encode.func(iter(batches)))
    assert [len(b) for b in got] == [4, 5] and all(b.type == pa.list_(pa.list_(pa.int32())) for b in got)
    assert [r for b in got for r in b.to_pylist()] == [None if r is None else [list((t or "").encode()) for t in r] for r in rows]
    assert max(len(b) for b in encode.func(iter([pa.array([["abcdefghijkl"]] * 50, pa.list_(pa.string()))]))) == 1


def test_chat_rows(spark):
    """Control strings in texts stay text; the mask begins with the answer and holds its end token."""
    vocabulary = spark.createDataFrame([(bytearray([i]), i) for i in range(256)], "token binary, rank int")
    message = "array<struct<role:string,content:string>>"
    rows = [(1, [("user", "a"), ("assistant", "b")]), (2, [("assistant", None)]), (3, []), (4, None), (5, [("system", "s<end>"), (None, None), ("assistant", "ü")])]
    got = {r.k: r for r in subwords.chat_rows(spark.createDataFrame(rows, f"k int, messages {message}"), subwords.tokenizer(vocabulary), 300, 301, keep=["k"]).collect()}
    text = lambda *parts: [x for p in parts for x in ([p] if isinstance(p, int) else p.encode())]
    begun = (300, "assistant\n")
    assert sorted(got) == [1, 2, 5]
    assert got[1].input_ids == text(300, "user\na", 301, "\n", *begun, "b", 301) and got[2].input_ids == text(*begun, 301)
    assert got[5].input_ids == text(300, "system\ns<end>", 301, "\n", 300, "\n", 301, "\n", *begun, "ü", 301)
    assert [sum(got[k].prompt_mask) for k in (1, 2, 5)] == [2, 1, 3] and all(got[k].prompt_mask == sorted(got[k].prompt_mask) and len(got[k].prompt_mask) == len(got[k].input_ids) == sum(got[k].attention_mask) for k in got)


OLDER = [
    "print 'a'", "print", "print 'a', b,", "if x:\n    print 'a' % b, c # d\nelse: print 'e'\n", "print >>f, 'x', y", "exec 'a = 1'", "exec code in ns", "x = 1; print x; y = 2",
    "try:\n    f()\nexcept A, e:\n    print e\nexcept (B, C), e: pass\n", "raise A, 'b'", "if a <> b: pass", "x = 0777 + 10L", "def f():\n\tif a:\n\t    print 'x'\n        return 1\n",
    "if a:\n        x = 1\n\ty = 2\n", "print 'it\\'s', \"a # b\", '''c\nd'''", "for i in range(3): print i,", "print (a), b", "print -1", "class A:\n    def f(self): print self.x\n", "a = b if c <> d else 09",
]
NEVER = ["print 'a' b", "print x for x in y", "print a=1", "def f(:", "x = (1", "the text of a page", "except A, b, c: pass", "raise", "print 'a", "exec", "1 <> ", "if x print y", "a b", "print (", "x = 5x"]


def test_older_programs():
    """Forms of older grammars are programs; what no grammar has stays none; today's programs are left as they are."""
    assert [c for c in OLDER if not py_syntax.is_program(c)] == []
    assert [c for c in NEVER if py_syntax.is_program(c) and not py_syntax.parses(c)] == []
    source = open(py_syntax.__file__).read()
    assert py_syntax.todays(source) == source
    assert code_blocks.code_blocks("print 'a'\n\nprint 'b'\n\nsome words of prose\n</think>")[0] == [("print 'a'\n\nprint 'b'", 0)]


def test_splits_move_whole_rows_once(spark, tmp_path):
    """Keys decide what is in a split: a drawn one shuffles no whole rows, xl shuffles each once, in the order of idx."""
    from benchloom import commands

    sc = spark.sparkContext
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(300)), lambda i: F.md5(F.concat_ws(":", "id", i.cast("string")))), "")
    rows = spark.range(400).select(F.col("id").alias("idx"), text.alias("problem_statement"), F.array_repeat(F.struct(F.lit("1").alias("input"), F.lit("2").alias("output")), (F.col("id") % 3).cast("int")).alias("examples"))
    rows.write.json(f"{tmp_path}/s/result")
    spark.range(400).where("id % 5 <> 0").selectExpr("id AS idx", "'diff' AS type").write.json(f"{tmp_path}/c/result")
    whole = 400 * 9600

    def moved(kind, taken, **options):
        group = f"split-{tmp_path}-{kind}"
        sc.setJobGroup(group, kind)
        commands.make_split(spark, kind, f"{tmp_path}/s", f"{tmp_path}/c", f"{tmp_path}/{kind}", taken, **options)
        sc.setLocalProperty("spark.jobGroup.id", None)
        tracker, store = sc.statusTracker(), sc._jsc.sc().statusStore()
        return sum(store.lastStageAttempt(s).shuffleWriteBytes() for s in {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds})

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert moved("train", [], size=7) < whole / 10
        assert moved("xl", [f"{tmp_path}/train"]) < 1.3 * whole
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    drawn = [r.idx for r in spark.read.json(f"{tmp_path}/train/result").orderBy("idx").collect()]
    assert len(drawn) == 7 and all(i % 5 and i % 3 == 2 for i in drawn)
    lines = [json.loads(v)["idx"] for v in [r.value for r in spark.read.text(f"{tmp_path}/xl/result").withColumn("f", F.input_file_name()).orderBy("f").collect()]]
    assert lines == [i for i in range(400) if i % 5 and i not in drawn]

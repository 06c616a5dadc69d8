"""Worker pools, the hand-shake, packing in blocks, line numbers, sinks and keyed streams."""

import json
import random
import re
import sys
import threading
import time
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from benchloom.operators import evaluate, generate, harness, languages, packing, pools, runner
from benchloom.schemas import EXAMPLE
from benchloom.sources import reader, sink, spec
from benchloom.streaming import keyed

ITEMS = f"item_id string, code string, test_cases array<{EXAMPLE}>, lang string"
CONFIGS = {
    "plain": json.dumps({"prompt": "x", "filename": "a.py", "execute": f"{sys.executable} -I a.py"}),
    "checked": json.dumps({"prompt": "x", "filename": "b.py", "compile": f"{sys.executable} -m py_compile b.py", "execute": f"{sys.executable} -O b.py"}),
}


def test_slots():
    assert pools.slots_of({"a": 990, "b": 5, "c": 5, "d": 0}, 16) == {"a": 16, "b": 1, "c": 1}
    assert pools.slots_of({"a": 1}, 16) == {"a": 16} and pools.slots_of({}, 16) == {}
    assert pools.slots_of({"a": 3, "b": 1}, 4) == {"a": 3, "b": 1}


def test_pools(spark):
    """A language with nine tenths of the items has nine tenths of the tasks; a task keeps one worker of one language."""
    lang = lambda i: "checked" if i % 20 == 0 else "nobody" if i % 20 == 1 else "plain"
    right = {"plain": "True", "checked": "False", "nobody": ""}
    rows = [(str(i), f"print(__debug__, {i})", [("", f"{right[lang(i)]} {i}")], lang(i)) for i in range(120)]
    rows += [("broken", "def f(:", [("", "x")], "checked"), ("none", "x", [], "plain"), ("null", None, [("", "x")], "plain")]
    got = pools.run_pools(spark.createDataFrame(rows, ITEMS).repartition(5), CONFIGS, slots=6).collect()
    assert len(got) == len(rows)
    status = {r.item_id: r.status for r in got}
    assert all(status[str(i)] == ("fail:exception" if lang(i) == "nobody" else "success") for i in range(120))
    assert (status["broken"], status["none"], status["null"]) == ("fail:error", "fail:run-failed", "fail:no-answer")
    tasks, workers = defaultdict(set), defaultdict(set)
    for r in got:
        tasks[r.task].add(r.lang)
        if r.lang != "nobody" and r.item_id != "none":
            workers[r.task].add(json.loads(r.details)["worker"])
    assert all(len(langs) == 1 for langs in tasks.values())
    assert sum(langs == {"plain"} for langs in tasks.values()) == 6 and {r.tasks for r in got if r.lang == "plain"} == {6}
    # only the item without tests costs its task a new worker
    assert sorted(map(len, workers.values()))[:-1] == [1] * (len(workers) - 1) and max(map(len, workers.values())) <= 2
    partition = pools.dealt(spark.createDataFrame(rows, ITEMS), runner.LANGUAGES | languages.registered(CONFIGS), 6)[0]
    assert partition.withColumn("p", F.spark_partition_id()).where("p <> task").count() == 0


def test_start_is_not_the_items_time():
    slow = [sys.executable, "-c", "import time, sys; time.sleep(1.5); print('{\"ready\": true}', flush=True)\nfor line in sys.stdin: print('{\"result\": \"success\"}', flush=True)"]
    worker = harness.Worker(slow, timeout=0.5, ready=True)
    try:
        assert [worker.run({"item_id": str(i)})["status"] for i in range(3)] == ["success"] * 3
    finally:
        worker.stop()


def test_endless_line(monkeypatch):
    monkeypatch.setattr(harness, "LINE_BYTES", 1 << 18)
    worker = harness.Worker([sys.executable, "-c", "import sys\nwhile True: sys.stdout.write('y' * 4096)"], timeout=20)
    assert worker.run({"item_id": "1"})["status"] == "fail:run-failed"
    worker.stop()


def test_composition():
    rng = random.Random(2)
    for seq_len in (1, 2, 5, 16):
        for _ in range(40):
            blocks = [np.array([rng.randrange(2 * seq_len) for _ in range(rng.randrange(5))], np.int64) for _ in range(6)]
            functions = [packing.added(b, seq_len) for b in blocks]
            whole = packing.added(np.concatenate(blocks), seq_len)
            assert packing.composed(functions, seq_len).tolist() == whole.tolist()
            assert packing.composed([packing.composed(functions[:2], seq_len), packing.composed(functions[2:], seq_len)], seq_len).tolist() == whole.tolist()
            assert packing.pack_starts(np.concatenate(blocks), seq_len)[1] == whole[0]


@pytest.mark.parametrize(("seq_len", "block_items", "n"), [(8, 3, 120), (5, 1, 40), (64, 4096, 120), (1, 2, 20)])
def test_pack_in_blocks(spark, monkeypatch, seq_len, block_items, n):
    """One order over everything, in many blocks, with masks, empty and null items and ties."""
    monkeypatch.setattr(packing, "FAN", 2)
    rng = random.Random(seq_len)
    rows = [(i // 2 * 2 if i % 9 else i, [rng.randrange(1, 99) for _ in range(rng.choice([0, 1, 3, 3 * seq_len]))]) for i in range(n)]
    rows = sorted((k, t, [1] * len(t)) for k, t in rows)
    joined, mask = [], []
    for i, (_, t, m) in enumerate(rows):
        if i and len(joined) % seq_len:
            joined.append(-1)
            mask.append(7)
        joined, mask = joined + t, mask + m
    df = spark.createDataFrame(rows, "k int, tokens array<int>, m array<int>").repartition(6)
    df = df.withColumns({c: F.when(F.size(c) > 0, F.col(c)) for c in ("tokens", "m")})  # empty ones as null
    got = packing.pack(df.repartitionByRange(5, "k"), seq_len, -1, "k", masks={"m": 7}, block_items=block_items).orderBy("row").collect()
    assert [r.row for r in got] == list(range(len(got)))
    assert [r.input_ids for r in got] == [joined[i : i + seq_len] for i in range(0, len(joined), seq_len)]
    assert [r.m for r in got] == [mask[i : i + seq_len] for i in range(0, len(mask), seq_len)]
    assert packing.pack(df.limit(0), seq_len, -1, "k").count() == 0


def test_pack_sends_no_items(spark):
    """What the driver collects for the order holds no whole items; items of equal order lie in the order of their tokens."""
    sc, group = spark.sparkContext, f"pack-{time.time()}"
    df = spark.range(80).select(F.lit(1).alias("k"), F.concat(F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: F.lit(5)), F.sequence(79 - F.col("id"), 20078 - F.col("id"))).alias("tokens"))
    sc.setJobGroup(group, "pack")
    try:
        got = packing.pack(df, 20009, -1, "k")
        first = [r.n for r in got.orderBy("row").select(F.get("input_ids", F.lit(9)).alias("n")).collect()]
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert first == list(range(80))
    tracker, store = sc.statusTracker(), sc._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    assert stages and sum(store.lastStageAttempt(s).resultSize() for s in stages) < 4 << 20


def test_pack_workers_get_no_tokens(spark):
    """Python workers get lengths only, and no stored row holds a whole item, however long items are."""
    state = spark._jsparkSession.sharedState().statusStore()
    before = state.executionsCount()
    n, size = 60, 6_000
    df = spark.range(n).select(F.col("id").alias("k"), F.sequence(F.col("id"), F.col("id") + size - 1).alias("tokens"), F.array_repeat(F.lit(1), size).alias("m"))
    packed = packing.pack(df, 64, -1, "k", masks={"m": 7}, block_items=20)
    got = packed.agg(F.count("row"), F.sum(F.aggregate("input_ids", F.lit(0).cast("long"), lambda s, x: s + x)), F.sum(F.size(F.filter("m", lambda x: x == 7)))).first()
    joined, separators = 0, 0
    for _ in range(n):
        separators += joined % 64 != 0
        joined += (joined % 64 != 0) + size
    assert tuple(got) == (-(-joined // 64), sum(k * size for k in range(n)) + n * (size * (size - 1) // 2) - separators, separators)
    units, sent = {"B": 1, "KiB": 1 << 10, "MiB": 1 << 20, "GiB": 1 << 30}, 0
    time.sleep(1)  # metrics arrive with events
    found = state.executionsList(before, 1000)
    for e in [found.apply(i) for i in range(found.size())]:
        values = state.executionMetrics(e.executionId())
        for m in [e.metrics().apply(i) for i in range(e.metrics().size())]:
            if m.name() == "data sent to Python workers" and values.contains(m.accumulatorId()):
                number, unit = re.search(r"([\d.,]+) ([KMG]?i?B)", values.apply(m.accumulatorId())).groups()
                sent += float(number.replace(",", "")) * units[unit]
    assert 0 < sent < n * size
    folder = packing.shared_table(spark.range(1), "any").inputFiles()[0].rsplit("/", 2)[0]
    stored = max(Path(folder.removeprefix("file://")).glob("benchloom-pack-ordered-*"), key=lambda p: p.stat().st_mtime)
    assert spark.read.parquet(f"file://{stored}").agg(F.max(F.size("input_ids"))).first()[0] <= 512


def test_pack_refuses_other_masks(spark):
    df = spark.createDataFrame([(0, [1, 2, 3], [0, 0, 1]), (1, [4, 5], [0])], "k int, tokens array<bigint>, m array<bigint>")
    with pytest.raises(Exception, match="m is not as long as the tokens"):
        packing.pack(df, 4, -1, "k", masks={"m": 7}).collect()


def test_numbered_lines(spark, tmp_path):
    """Numbers carry over byte ranges and files, whatever the ranges are."""
    want = []
    for name, n in (("a", 500), ("b", 0), ("c", 1), ("d", 333)):
        lines = [f"{name}{i}" * (1 + i % 7) for i in range(n)]
        (tmp_path / f"{name}.txt").write_text("".join(f"{x}\n" for x in lines))
        want += lines
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (old, "1000b", "64b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = spec.numbered_lines(spark, str(tmp_path)).select("line", "value").collect()
            assert [r.value for r in sorted(got)] == want and sorted(r.line for r in got) == list(range(len(want)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_publish_once(spark, tmp_path):
    root, rows = f"file://{tmp_path}/log", spark.range(5)
    assert sink.publish(rows, root, "one") and not sink.publish(rows, root, "one")
    # a batch that was killed while it was staged, then repeated
    rows.write.parquet(f"{root}/{sink.STAGING}/two-killed")
    assert sink.publish(rows.where("id > 2"), root, "two")
    found = lambda: sorted(map(tuple, sink.read(spark, root, "id long").collect()))
    want = sorted([(i, "one") for i in range(5)] + [(i, "two") for i in (3, 4)])
    assert found() == want
    sink.clear_staging(spark, root)
    assert found() == want
    with pytest.raises(ValueError, match="not a batch key"):
        sink.publish(rows, root, "../x")


def test_publish_race(spark, tmp_path, monkeypatch):
    """Two writers of one batch: the later rename finds the key taken, and its rows are dropped."""
    root, seen = f"file://{tmp_path}/log", sink.published
    monkeypatch.setattr(sink, "published", lambda *a: False)
    assert sink.publish(spark.range(3), root, "b") and not sink.publish(spark.range(3), root, "b")
    monkeypatch.setattr(sink, "published", seen)
    assert sink.read(spark, root, "id long").count() == 3


def test_killed_stream(spark, tmp_path):
    """A batch that dies after it was published, and one that dies while it is made, leave each row once."""
    schema = "item_id string, n int"
    for i in range(3):
        spark.createDataFrame([(f"{i}/{j}", j) for j in range(4)], schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    died, made = [], []

    def dying(batch):
        made.append(1)
        if len(made) == 2:
            raise RuntimeError("killed")
        return batch

    run = lambda: sink.stream_into(stream(), f"file://{tmp_path}/out", f"{tmp_path}/state", dying).trigger(availableNow=True).start()
    whole = sink.publish

    def late(*args):
        out = whole(*args)
        if not died:
            died.append(1)
            raise RuntimeError("killed after the rename")
        return out

    sink.publish = late
    try:
        for _ in range(2):
            with pytest.raises(Exception, match="killed"):
                run().awaitTermination()
        run().awaitTermination()
    finally:
        sink.publish = whole
    got = sorted((r.item_id, r.n) for r in sink.read(spark, f"file://{tmp_path}/out", schema).collect())
    assert got == [(f"{i}/{j}", j) for i in range(3) for j in range(4)]


def test_keyed_stream(spark, tmp_path):
    """Nulls, ties and late rows, by arrival order: a later batch counts as later."""
    schema = "event_id long, user_id long, ts timestamp, value double, rank int"
    files = [
        [(1, 1, 10, None), (2, 1, 20, 5.0), (3, 2, 5, None), (4, None, 1, 1.0)],
        [(6, 1, 30, 4.0), (5, 1, 30, 7.0), (7, 2, 6, None), (8, 3, None, 2.0)],
        [(9, 1, 25, None), (10, 2, 9, 1.0)],
    ]
    for rows in files:
        df = spark.createDataFrame([(e, u, t, v) for e, u, t, v in rows], "event_id long, user_id long, t long, value double")
        df.select("event_id", "user_id", F.timestamp_seconds("t").alias("ts"), "value", F.lit(0).alias("rank")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    sink.stream_into(keyed.keyed_progress(events), f"{tmp_path}/out", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = {r.event_id: (r.key, r.running_max, r.lap_us, r["rank"]) for r in sink.read(spark, f"{tmp_path}/out", keyed.OUTPUT).collect()}
    s = 1_000_000
    assert got == {
        1: (1, None, None, 1), 2: (1, 5.0, 10 * s, 2), 5: (1, 7.0, 10 * s, 3), 6: (1, 7.0, 0, 4), 9: (1, 7.0, -5 * s, 5),
        3: (2, None, None, 1), 7: (2, None, 1 * s, 2), 10: (2, 1.0, 3 * s, 3),
    }


def test_evaluations_overlap(spark):
    """Each job waits until all have begun; one that fails leaves the others whole."""
    together, seen = threading.Barrier(3, timeout=60), {}

    def job(name, n):
        def rows():
            together.wait()
            seen[name] = spark.sparkContext.getLocalProperty("spark.scheduler.pool")
            if n is None:
                raise ValueError(f"{name} is broken")
            return spark.range(n).select(F.col("id").alias("key"), F.col("id").alias("reward"))

        return rows

    found = evaluate.evaluate(spark, {"a": job("a", 3), "bad": job("bad", None), "c": job("c", 5)})
    assert [o.dataset for o in found] == ["a", "bad", "c"] and [o.error for o in found] == [None, "ValueError: bad is broken", None]
    assert max(o.began for o in found) < min(o.ended for o in found) and len(set(seen.values())) == 3
    assert {(r.dataset, r["mean"], r.n) for r in evaluate.summary(spark, found).collect()} == {("a", 1.0, 3), ("bad", None, 0), ("c", 2.0, 5), (None, 1.5, 8)}
    assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None


def test_quota(spark, tmp_path):
    """A client that records its calls: no window of a period holds more than the quota, retries included."""
    path = str(tmp_path / "calls")

    def recording(prompts, n, **_):
        with open(path, "a") as f:
            f.write(f"{time.time()} {prompts[0]}\n")
        said = open(path).read().count(f" {prompts[0]}\n")
        return [[f"said {p}" if p[-1] not in "37" or said > 1 and p[-1] == "3" else None] for p in prompts]

    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(30)], "idx int, prompt string")
    got = generate.generate_paced(prompts, recording, quota=10, period=1.0, slots=4, attempts=3, backoff=0.1).collect()
    assert {(r.idx, r.response) for r in got} == {(str(i), None if i % 10 == 7 else f"said p{i}") for i in range(30)}
    assert {r.attempt for r in got if int(r.idx) % 10 == 7} == {3} and {r.attempt for r in got if int(r.idx) % 10 == 3} == {2}
    times = sorted(float(line.split()[0]) for line in open(path))
    assert len(times) == 30 + 6 + 3
    # clocks are read just before a request is counted
    assert all(b - a >= 0.97 for a, b in zip(times, times[10:]))


def test_byte_ranges(tmp_path):
    """Every line is in exactly one range, whatever the ranges, chunks and last line are."""
    rng = random.Random(3)
    old = reader.CHUNK
    try:
        for text in (b"", b"a", b"a\n", b"\n\n", b"".join(b"x" * rng.randrange(12) + b"\n" for _ in range(40)), b"long" * 50 + b"\nb", b"a\nb\n" + b"z" * 90):
            (tmp_path / "f").write_bytes(text)
            for reader.CHUNK in (1, 3, 16, 1 << 20):
                for step in (1, 2, 7, 50, 1000):
                    parts = [b"".join(reader.line_starts(str(tmp_path / "f"), a, min(len(text), a + step))) for a in range(0, len(text), step)]
                    assert b"".join(parts) == text
                    assert all(p.endswith(b"\n") or not any(parts[i + 1 :]) for i, p in enumerate(parts) if p)
    finally:
        reader.CHUNK = old


@pytest.mark.parametrize("kind", ["jsonl", "csv", "disk"])
def test_data_source(spark, tmp_path, kind):
    """Rows by number, limits and columns; a limit plans only the ranges it needs."""
    rows = spark.range(0, 1000, numPartitions=4).select("id", F.concat(F.lit("a, \"b\" "), F.col("id").cast("string")).alias("t"), F.when(F.col("id") % 3 == 0, F.col("id") / 2).alias("half"))
    name = f"{kind}:file://{tmp_path}/{kind}"
    spec.write_spec(rows, name)
    schema = "half double, line long, id long"
    whole = spec.load(spark, name, schema, bytes="999")
    assert [(r.id, r.half, r.line) for r in whole.orderBy("line").collect()] == [(i, i / 2 if i % 3 == 0 else None, i) for i in range(1000)]
    assert [r.t for r in spec.load(spark, name, "t string").collect()][-1] == 'a, "b" 999'
    for start, stop in ((0, 0), (0, 1), (240, 260), (249, 251), (990, 2000), (1000, 1001)):
        got = spec.load(spark, name, schema, bytes="999", start=str(start), stop=str(stop)).orderBy("id").collect()
        assert [(r.id, r.line) for r in got] == [(i, i) for i in range(start, min(stop, 1000))]
    limited = spec.load(spark, f"{name}:limit=7", "id long", bytes="999")
    assert sorted(r.id for r in limited.collect()) == list(range(7)) and limited.rdd.getNumPartitions() == 1
    assert dict(spec.load(spark, name).dtypes)["id"] == "bigint"
    empty = spec.load(spark, name, "id long", start="5000").collect()
    assert empty == []


def test_line_filters(spark, tmp_path):
    """Two filters of one table don't touch each other."""
    name = f"jsonl:file://{tmp_path}/x"
    spec.write_spec(spark.range(0, 300, numPartitions=3), name)
    df = spec.load(spark, name, "id long, line long", bytes="200")
    assert df.where("line >= 150 AND line < 155").count() == 5 and df.count() == 300 and [r.id for r in df.where("line = 299").collect()] == [299]
    assert df.rdd.getNumPartitions() > 12


@pytest.mark.skipif(not runner.can_box(), reason="this machine allows no namespaces")
class TestBox:
    def status(self, code, output="", stdin="", timeout=20.0):
        return runner.run_item(code, [{"input": stdin, "output": output}], "python", timeout)

    def test_files(self, tmp_path):
        """Neither the repository nor other folders can be seen; the program's own folder can, and is its own copy."""
        (tmp_path / "secret").write_text("x")
        for path in (__file__, str(tmp_path / "secret"), "/etc/passwd", "/root/repo/README.md"):
            assert self.status(f"open({path!r}).read()")["stderr"].count("FileNotFoundError") == 1
        assert self.status("import os\nopen('mine', 'w').write('x')\nprint(sorted(os.listdir('.')), os.listdir('/tmp') == [os.path.basename(os.getcwd())], os.getuid() != 0)", "['mine', 'snippet.py'] True True")["status"] == "success"
        assert "Read-only" in self.status("open('/usr/x', 'w')")["stderr"] or "Permission" in self.status("open('/usr/x', 'w')")["stderr"]

    def test_full_disk(self):
        code = f"f = open('big', 'wb')\ntry:\n    for _ in range({runner.BOX_BYTES >> 20}):\n        f.write(b'x' * (1 << 20))\nexcept OSError as e:\n    print(e.errno)"
        assert self.status(code, "28")["status"] == "success"

    def test_fork_bomb(self):
        """Processes are limited, and none outlives the program."""
        mark = str(random.Random().randrange(10**12))
        code = f"import os, time\nn = 0\ntry:\n    while n < 5000:\n        if os.fork() == 0:\n            time.sleep({mark[:3]} + 600)\n        n += 1\nexcept OSError:\n    print(0 < n < {runner.BOX_PROCESSES})"
        before = _processes()
        assert self.status(code, "True")["status"] == "success"
        deadline = time.time() + 20
        while _processes() > before + 50 and time.time() < deadline:
            time.sleep(0.2)
        assert _processes() <= before + 50

    def test_network(self):
        assert "unreachable" in self.status("import socket\nsocket.create_connection(('127.0.0.1', 9), 2)")["stderr"]

    def test_outcomes(self):
        """Exit codes and signals come through, a timeout ends everything, other programs' processes can't be seen."""
        assert self.status("raise SystemExit(7)")["exit_code"] == 7
        assert [self.status(f"import os, signal\nos.kill(os.getpid(), signal.{s})")["exit_code"] for s in ("SIGKILL", "SIGSEGV", "SIGTERM")] == [-9, -11, -15]
        assert self.status("import os\nos.abort()")["exit_code"] == -6
        assert self.status("import subprocess\nsubprocess.Popen(['sleep', '600'])\nwhile True: pass", timeout=1.5)["status"] == "fail:timeout"
        assert self.status("import os\nprint(sum(p.isdigit() for p in os.listdir('/proc')))", "2")["status"] == "success"
        assert self.status("print(input() * 2)", "abab", "ab\n")["status"] == "success"

    def test_without(self, monkeypatch):
        """Where boxes can't be made, programs run under limits alone."""
        monkeypatch.setattr(runner, "can_box", lambda: False)
        assert self.status("print(input())", "x", "x")["status"] == "success"


def _processes():
    import os

    return sum(p.isdigit() for p in os.listdir("/proc"))


def test_read_configs(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.yaml").write_text("prompt: x\nfilename: a.x\nexecute: run a.x\n")
    (tmp_path / "a" / "two.json").write_text('{"prompt": "x", "filename": "b", "compile": "c b", "execute": "./b"}')
    found = languages.registered(languages.read_configs(spark, str(tmp_path / "a")))
    assert found == {"one": ("a.x", None, ["run", "a.x"], {}), "two": ("b", ["c", "b"], ["./b"], {})}
    (tmp_path / "a" / "one.json").write_text('{"prompt": "x", "filename": "b", "execute": "./b"}')
    with pytest.raises(ValueError, match="two configurations"):
        languages.read_configs(spark, str(tmp_path / "a"))
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "bad.yaml").write_text("prompt: x\n")
    with pytest.raises(ValueError, match="keys must be"):
        languages.read_configs(spark, str(tmp_path / "b"))

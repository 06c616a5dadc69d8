"""Named pipelines over files; each reads the output of an earlier step and writes a folder of its own.

`python -m benchloom.commands COMMAND --help` lists a command's options. Steps write JSON lines to
OUT/result and their settings to OUT/config.json; a folder that is not empty is refused without --force.
Solutions and splits, which hold whole problems, are compressed by gzip.
"""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benchloom.functions import code_blocks, prompts
from benchloom.functions import text as T
from benchloom.operators import curate, generate, harness, languages, pools, results, runner
from benchloom.schemas import ANSWER, EXAMPLE, RAW_PROBLEM, RL_ROW, SOLUTIONS
from benchloom.sources import spec

RESPONSES = generate.RESPONSE
#: How languages are named in prompts; a language that is not here is named by its key.
LONG_NAMES = {"python": "Python 3", "cpp": "C++ 17", "r": "R 4", "julia": "Julia 1.11", "lua": "Lua 5.1", "java": "Java"}


#: Keys that are sent to every task.
SENT = 200_000


def _out(df: DataFrame, out: str, force: bool, compression: str = "none", **config) -> DataFrame:
    spark = df.sparkSession
    spec.start_step(spark, out, force=force)
    df.write.option("ignoreNullFields", False).option("compression", compression).json(f"{out}/result")
    spec.write_document(spark, f"{out}/config.json", config)
    return spark.read.schema(df.schema).json(f"{out}/result")


def _step(spark: SparkSession, path: str, schema: str, start: int = 0, size: int = -1) -> DataFrame:
    return spec.read_step(spark, f"{path}/result", schema, start, -1 if size < 0 else start + size)


def preprocess_solutions(spark: SparkSession, raw: str, out: str, force: bool = False) -> DataFrame:
    """Raw problems (a dataset spec) to numbered solutions."""
    rows = curate.solutions(spec.read_spec(spark, raw, RAW_PROBLEM), ["id"])
    return _out(rows, out, force, "gzip", raw=raw)


def preprocess_checkers(spark: SparkSession, solutions: str, checkers: str, out: str, force: bool = False) -> DataFrame:
    """(idx, id, type, rest): what each problem's checker text says after its thinking, as JSON."""
    problems = _step(spark, solutions, SOLUTIONS).select("idx", F.col("source_id").alias("id"))
    texts = spec.read_spec(spark, checkers, "id string, generation string").join(problems, "id", "left_semi")
    said = T.parsed(T.final_block(T.after_thinking_or_all(F.col("generation"))))
    rows = curate.required_lookup(problems, texts.groupBy("id").agg(F.max("generation").alias("generation")), "id")
    kind = F.try_variant_get(said, "$.type", "string")
    return _out(rows.select("idx", "id", kind.alias("type"), F.to_json(said).alias("rest")).where("type IS NOT NULL"), out, force, checkers=checkers)


SPLITS = {"test": (100, ()), "validation": (200, ("test",)), "train": (2000, ("test", "validation"))}
FORCED = [0, 1, 2, 4, 6]


def make_split(spark: SparkSession, kind: str, solutions: str, checkers: str, out: str, taken: list[str] = (), size: int | None = None, force: bool = False) -> DataFrame:
    """test, validation, train, or xl: rows that a diff checker judges and no split in `taken` has. The first three want two examples."""
    rows = _step(spark, solutions, SOLUTIONS)
    wanted = _step(spark, checkers, "idx bigint, type string").where("type = 'diff'")
    used = [_step(spark, t, "idx bigint") for t in taken]
    # keys decide which rows are picked; whole rows move at most once
    if kind == "xl":
        picked = rows.select("idx").join(wanted, "idx", "left_semi")
        for u in used:
            picked = picked.join(u, "idx", "left_anti")
        picked = curate.rows_of(rows, picked, "idx")
    else:
        k = SPLITS[kind][0] if size is None else size
        pool = rows.where(F.size("examples") >= 2)
        picked = curate.split(pool.select("idx"), "idx", k, wanted, used, FORCED if kind == "test" else None, strict=True)
        picked = pool.join(F.broadcast(picked) if k <= SENT else picked, "idx", "left_semi").orderBy("idx")
    return _out(picked, out, force, "gzip", kind=kind, taken=list(taken))


def publish_splits(spark: SparkSession, splits: dict[str, str], out: str) -> DataFrame:
    """Several splits as one dataset, partitioned by the split's name."""
    parts = [_step(spark, path, SOLUTIONS).withColumn("split", F.lit(name)) for name, path in splits.items()]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    spec.write_split(whole, out)
    return spark.read.parquet(out)


def make_prompts(spark: SparkSession, problems: str, out: str, lang: str, start: int = 0, size: int = -1, skip_invalid: bool = False, variants: bool = False, seed: int = 42, force: bool = False) -> DataFrame:
    """(idx, prompt) of a split's problems; rows are dropped before the range is cut."""
    rows = curate.valid_slice(_step(spark, problems, SOLUTIONS), "idx", start, size, skip_invalid)
    name = F.lit(LONG_NAMES.get(lang, lang))
    args = (F.col("problem_statement"), F.col("input_format"), F.col("output_format"), F.col("examples"), F.col("problem_notes"), name)
    prompt = prompts.build_variant_prompt(*args, F.col("idx"), seed) if variants else prompts.build_prompt(*args)
    return _out(rows.select(F.col("idx").cast("string").alias("idx"), prompt.alias("prompt")), out, force, lang=lang, start=start, size=size, variants=variants, seed=seed)


def write_benchmark_prompts(spark: SparkSession, benchmark: str, out: str, lang: str, force: bool = False) -> DataFrame:
    rows = spec.read_spec(spark, benchmark).select(F.col("question_id").cast("string").alias("idx"), prompts.benchmark_prompt(F.col("question_content"), LONG_NAMES.get(lang, lang)).alias("prompt"))
    return _out(rows, out, force, lang=lang)


def generate_responses(spark: SparkSession, made: str, out: str, client=generate.echo_client, n: int = 1, force: bool = False, **options) -> DataFrame:
    """n responses to each prompt; failed requests stay as rows with an error."""
    if isinstance(client, str):
        module, _, name = client.partition(":")
        client = getattr(importlib.import_module(module), name)
    rows = generate.generate(_step(spark, made, "idx string, prompt string"), client, n, **options)
    return _out(rows, out, force, client=getattr(client, "__name__", str(client)), n=n, **options)


def extract_answers(spark: SparkSession, responses: str, out: str, force: bool = False) -> DataFrame:
    """(idx, sample_idx, issues, answer): the final block of each response that came."""
    rows = _step(spark, responses, RESPONSES).where("response IS NOT NULL")
    answer = T.final_block(F.col("response"))
    return _out(rows.select("idx", "sample_idx", T.issues_of(answer).alias("issues"), answer.alias("answer")), out, force)


def verify_answers(spark: SparkSession, answers: str, problems: DataFrame, out: str, lang: str, timeout: float = 15.0, keep_worker: bool = False, configs: str | None = None, force: bool = False) -> DataFrame:
    """(item_id, status): each different answer to a problem runs once; answers that are missing or have no tests say so.

    configs: a folder of language configurations; their languages run in pools of long-lived workers.
    problems: idx and test_cases. After the output is written, answers without a problem are an error.
    """
    rows = _step(spark, answers, ANSWER).withColumn("item_id", T.item_id(F.col("idx"), F.col("sample_idx")))
    tests = problems.select(F.col("idx").cast("string").alias("idx"), "test_cases")
    attached = curate.shared_table(results.attach_tests(rows, tests, "idx", "test_cases").withColumn("lang", F.lit(lang)), "attached")
    there = attached.where("NOT missing AND coalesce(answer, '') <> ''").withColumnRenamed("answer", "code")
    none = there.where("test_cases IS NULL OR size(test_cases) = 0").select("item_id", F.lit("fail:no-tests").alias("status"))
    if configs is not None:
        known = languages.read_configs(spark, configs)
        run = lambda x: pools.run_pools(x, known, timeout)
    else:
        run = (lambda x: harness.supervise(x, timeout=timeout)) if keep_worker else (lambda x: runner.run_items(x, timeout))
    done = results.run_and_fan_out(there.where("size(test_cases) > 0"), ["idx", "code"], lambda x: run(x).select("item_id", "status")).unionByName(none)
    written = _out(results.with_rejected(done, attached), out, force, lang=lang, timeout=timeout)
    results.fail_on_missing(attached)
    return written


def verify_from_generate(spark: SparkSession, responses: str, problems: DataFrame, out: str, lang: str, **options) -> DataFrame:
    extract_answers(spark, responses, f"{out}/answers", options.get("force", False))
    return verify_answers(spark, f"{out}/answers", problems, f"{out}/verify", lang, **options)


def describe_verify_results(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, success-rate) for each step's results."""
    found = None
    for path in paths:
        one = _step(spark, path, "item_id string, status string").withColumn("file", F.lit(path))
        found = one if found is None else found.unionByName(one)
    return spec.success_report(found)


def prepare_dataset(spark: SparkSession, name: str, problems: DataFrame, out: str, seed: int = 42, force: bool = False) -> DataFrame:
    """RL rows of a dataset by its name: LANG, mix-A-B, fullmix-A-B (every problem in every language) or seq-A-B (languages one after the other), each may say xl-."""
    langs = name.split("_")[0].removeprefix("fullmix-").removeprefix("mix-").removeprefix("seq-").removeprefix("xl-").split("-")
    rows = problems.drop("lang")
    if name.startswith(("fullmix-", "seq-")):
        rows = curate.language_fan_out(rows, langs)
        order = ["part_ord", "idx"] if name.startswith("seq-") else ["draw", "idx", "part_ord"]
    else:
        rows = curate.assign_language(rows, "idx", langs, seed).withColumn("part_ord", F.lit(0))
        order = ["draw", "idx"]
    rows = rows.withColumn("draw", curate.draw(F.col("idx"), seed))
    shown = prompts.build_prompt(F.col("problem_statement"), F.lit(""), F.lit(""), F.col("test_cases"), F.lit(""), F.col("lang"))
    placed = curate.with_ordinal(rows.select("idx", "test_cases", "lang", shown.alias("prompt"), "draw", "part_ord"), order, "position")
    return _out(placed.select("position", *[f.split()[0] for f in ("idx", "test_cases", "lang", "prompt")]), out, force, name=name, seed=seed)


def test_executors(spark: SparkSession, cases: DataFrame, times: int = 3) -> DataFrame:
    """cases: case (the expected status's name), code, test_cases, lang, timeout_s. Each runs `times` times in one worker; (case, lang, status, expected, ok)."""
    many = cases.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(times)))).withColumn("item_id", F.concat_ws("/", "lang", "case", F.xxhash64("code", "test_cases").cast("string"), "i"))
    found = None
    for (limit,) in cases.select("timeout_s").distinct().collect():  # a handful of limits
        part = harness.supervise(many.where(F.col("timeout_s") == limit), timeout=float(limit), by="lang")
        found = part if found is None else found.unionByName(part)
    want = F.regexp_replace("case", "^fail-", "fail:")
    return many.join(found, "item_id").select("case", "lang", "status", want.alias("expected"), (F.col("status") == want).alias("ok"))


def llm_cost(spark: SparkSession, calls: DataFrame, prices: DataFrame) -> DataFrame:
    """(model, cost) in dollars, exact and as text."""
    total = results.token_cost(calls, prices).groupBy("model").agg(F.sum("cost").alias("dollars"))
    return total.select("model", "dollars", T.money(F.col("dollars")).alias("cost"))


def find_code(spark: SparkSession, responses: str, out: str, force: bool = False) -> DataFrame:
    """(idx, sample_idx, blocks, answer): code in the thinking and the final block."""
    blocks, answer = code_blocks.find_code(F.col("response"))
    return _out(_step(spark, responses, RESPONSES).select("idx", "sample_idx", blocks.alias("blocks"), answer.alias("answer")), out, force)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="benchloom")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name, *required, **optional):
        c = sub.add_parser(name)
        for r in required:
            c.add_argument(r)
        for k, v in optional.items():
            c.add_argument(f"--{k.replace('_', '-')}", default=v, **({"action": "store_true"} if v is False else {"type": type(v)} if v is not None else {}))
        c.add_argument("--force", action="store_true")

    command("preprocess-solutions", "raw", "out")
    command("preprocess-checkers", "solutions", "checkers", "out")
    command("make-split", "kind", "solutions", "checkers", "out", taken="", size=None)
    command("publish-splits", "splits", "out")
    command("make-prompts", "problems", "out", "lang", start=0, size=-1, skip_invalid=False, variants=False, seed=42)
    command("write-benchmark-prompts", "benchmark", "out", "lang")
    command("generate", "made", "out", client="benchloom.operators.generate:echo_client", n=1)
    command("extract-answers", "responses", "out")
    command("verify-answers", "answers", "problems", "out", "lang", timeout=15.0, keep_worker=False, configs=None)
    command("verify-from-generate", "responses", "problems", "out", "lang", timeout=15.0, keep_worker=False, configs=None)
    command("describe-verify-results", "paths")
    command("prepare-dataset", "name", "problems", "out", seed=42)
    command("find-code", "responses", "out")
    command("llm-cost", "calls", "prices")
    command("test-executors", "cases")
    a = vars(p.parse_args(argv))
    name = a.pop("command")
    spark = SparkSession.builder.appName(f"benchloom {name}").getOrCreate()
    calls = {"generate": generate_responses} | {n: globals()[n.replace("-", "_")] for n in sub.choices if n != "generate"}
    if name in ("describe-verify-results", "llm-cost", "publish-splits", "test-executors"):
        a.pop("force")
    if "size" in a and a["size"] is not None:
        a["size"] = int(a["size"])
    if "taken" in a:
        a["taken"] = [t for t in a["taken"].split(",") if t]
    if "paths" in a:
        a["paths"] = a["paths"].split(",")
    if "splits" in a:
        a["splits"] = dict(s.split("=", 1) for s in a["splits"].split(","))
    for k in ("calls", "prices", "cases"):
        if k in a:
            a[k] = spec.read_spec(spark, a[k])
    if name in ("verify-answers", "verify-from-generate", "prepare-dataset"):
        schema = RL_ROW if name != "prepare-dataset" else f"idx string, problem_statement string, test_cases array<{EXAMPLE}>"
        a["problems"] = spec.read_spec(spark, a["problems"], schema)
    done = calls[name](spark, **a)
    done.show(20, truncate=80)


if __name__ == "__main__":
    main()

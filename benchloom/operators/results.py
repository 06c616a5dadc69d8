"""From execution results to scores, rewards, advantages and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from benchloom.functions import text as T
from benchloom.operators.curate import raising, shared_table


def success_rate(results: DataFrame, by: list[str]) -> DataFrame:
    return results.groupBy(*by).agg(F.avg((F.col("status") == "success").cast("double")).alias("success_rate"), F.count("*").alias("n"))


def attach_tests(answers: DataFrame, problems: DataFrame, key: str = "idx", tests: str = "examples") -> DataFrame:
    """Left join on the problem; `missing` marks answers without one. Tests are never broadcast."""
    build = problems.select(key, F.col(tests).alias("test_cases"), F.lit(True).alias("__there"))
    return answers.join(build.hint("shuffle_hash"), key, "left").withColumn("missing", F.col("__there").isNull()).drop("__there")


def no_answer_rows(answers: DataFrame) -> DataFrame:
    none = answers.where(F.coalesce("answer", F.lit("")) == "")
    return none.select("item_id", F.lit("fail:no-answer").alias("status"))


def not_yet_done(items: DataFrame, done: DataFrame) -> DataFrame:
    return items.join(done.select("item_id").distinct(), "item_id", "left_anti")


def run_distinct(items: DataFrame, keys: list[str]) -> DataFrame:
    """The items that have to run: one for each distinct value of keys."""
    return items.dropDuplicates(keys)


def advantages(rewards: DataFrame, group: str, reward: Column, eps: float = 1e-4) -> Column:
    w = Window.partitionBy(group)
    return (reward - F.avg(reward).over(w)) / (F.stddev_samp(reward).over(w) + eps)


def vanilla_advantages(group: str, reward: Column, least: float = 1e-10) -> Column:
    w = Window.partitionBy(group)
    std = F.stddev_samp(reward).over(w)
    return F.when(std < least, 0.0).otherwise((reward - F.avg(reward).over(w)) / std)


def macro_average(scores: DataFrame, dataset: str, value: str) -> DataFrame:
    return scores.groupBy(dataset).agg(F.avg(value).alias("m")).agg(F.avg("m").alias("macro_average"))


def running_max(value: str, by: list[str], within: list[str]) -> Column:
    return F.max(value).over(Window.partitionBy(*within).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0))


def first_k(df: DataFrame, key: str, by: list[str], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*by))).where(F.col("rank") <= k)


def pass1_of_responses(responses: DataFrame, expected: str, by: list[str]) -> DataFrame:
    """Responses are judged by their final block alone: equal to the expected text or not."""
    answer = T.final_block(F.col("response"))
    status = F.when(answer.isNull(), "fail:no-answer").when(T.same_output(answer, F.col(expected)), "success").otherwise("fail:wrong-output")
    return success_rate(responses.withColumn("status", status), by)


def token_cost(calls: DataFrame, prices: DataFrame, model: str = "model") -> DataFrame:
    """Exact decimal cost of input and output tokens at dollars for a million."""
    d = lambda c: F.col(c).cast("decimal(20,6)")
    cost = d("tokens_in") * d("price_in") / 1000000 + d("tokens_out") * d("price_out") / 1000000
    return lookup(calls, prices, model).withColumn("cost", cost.cast("decimal(38,12)"))


#: Rows of a registry (prices, languages, models) that are sent to every task; a larger one is joined by a shuffle.
REGISTRY_ROWS = 100_000


def lookup(rows: DataFrame, registry: DataFrame, key: str, problem: str | None = None) -> DataFrame:
    """rows with the registry's columns; a key that the registry lacks is an error, or reported in the column `problem`."""
    small = F.broadcast if registry.count() <= REGISTRY_ROWS else (lambda x: x)
    found = rows.join(small(registry.withColumn("__there", F.lit(True))), key, "left")
    said = F.concat(F.lit("unknown key "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    if problem is not None:
        return found.withColumn(problem, F.when(F.col("__there").isNull(), said)).drop("__there")
    return raising(found, F.col("__there").isNull(), said).drop("__there")


def run_and_fan_out(items: DataFrame, keys: list[str], run) -> DataFrame:
    """run() on one item of each distinct value of keys; every item gets the result of its own.

    items: item_id and what run reads; run: a function from such a table to (item_id, status, ...).
    """
    kept = items.where(F.coalesce("item_id", F.lit("")) != "")
    firsts = shared_table(kept.groupBy(*keys).agg(F.min("item_id").alias("run_id")), "firsts")
    results = shared_table(run(kept.join(firsts.select(F.col("run_id").alias("item_id")), "item_id", "left_semi").dropDuplicates(["item_id"])), "results")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"i.{k}").eqNullSafe(F.col(f"f.{k}"))
    owner = kept.alias("i").join(firsts.alias("f"), same).select("i.item_id", "f.run_id")
    return owner.join(results.withColumnRenamed("item_id", "run_id"), "run_id").drop("run_id")


def with_rejected(results: DataFrame, answers: DataFrame) -> DataFrame:
    """Results and, after them, a row for each answer that could not run; ids that are there already stay alone."""
    none = no_answer_rows(answers).join(results.select("item_id"), "item_id", "left_anti")
    return results.unionByName(none, allowMissingColumns=True)


def fail_on_missing(attached: DataFrame, what: str = "problem") -> int:
    """Called after the output is written: an error if answers had no problem; else how many rows there were."""
    n, missing = attached.agg(F.count("*"), F.count_if("missing")).first()
    if missing:
        raise ValueError(f"{missing} of {n} answers have no {what}")
    return n


def without_tests(answers: DataFrame, tests: DataFrame, key: str = "idx") -> DataFrame:
    """Answers with their test cases; where there are none, the status says so and nothing has to run."""
    found = attach_tests(answers, tests, key, "test_cases")
    return found.withColumn("status", F.when(F.col("missing") | F.col("test_cases").isNull() | (F.size("test_cases") == 0), "fail:no-tests")).drop("missing")

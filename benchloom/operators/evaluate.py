"""Evaluations of several datasets side by side: their jobs share the cluster in fair pools, and one that fails stops none of the others."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benchloom.operators.curate import shared_table

SCORES = "dataset string, key string, reward double"


@dataclass(frozen=True)
class Outcome:
    """How one dataset's evaluation went; times in seconds, error None if it has scores."""

    dataset: str
    began: float
    ended: float
    scores: DataFrame | None
    error: str | None


def evaluate(spark: SparkSession, jobs: Mapping[str, Callable[[], DataFrame]], at_once: int = 4) -> list[Outcome]:
    """Runs each job, a function to (key, reward), on a thread with a scheduler pool of its own; outcomes in the jobs' order.

    Scores are written, so an outcome is whole or an error. Pools share fairly where spark.scheduler.mode is
    FAIR; else jobs still overlap, but the first one goes first.
    """
    group = f"evaluate-{uuid.uuid4().hex}"

    def run(name: str, job: Callable[[], DataFrame]) -> Outcome:
        began = time.time()
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"{group}-{name}")
        spark.sparkContext.setJobDescription(f"evaluation of {name}")
        try:
            rows = job().select(F.lit(name).alias("dataset"), F.col("key").cast("string").alias("key"), F.col("reward").cast("double").alias("reward"))
            return Outcome(name, began, time.time(), shared_table(rows, "scores"), None)
        except Exception as problem:  # noqa: BLE001  one dataset must not stop the others
            return Outcome(name, began, time.time(), None, f"{type(problem).__name__}: {problem}")
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)
            spark.sparkContext.setJobDescription(None)

    with ThreadPoolExecutor(max(1, min(at_once, len(jobs)))) as threads:
        # each task inherits the caller's properties and keeps its own apart
        waiting = [threads.submit(inheritable_thread_target(spark)(run), name, job) for name, job in jobs.items()]
        return [w.result() for w in waiting]


def scores_of(spark: SparkSession, outcomes: list[Outcome]) -> DataFrame:
    """All scores (dataset, key, reward)."""
    found = spark.createDataFrame([], SCORES)
    for o in outcomes:
        if o.scores is not None:
            found = found.unionByName(o.scores)
    return found


def summary(spark: SparkSession, outcomes: list[Outcome]) -> DataFrame:
    """(dataset, mean, n, error) of every dataset, and a last row without a name: the mean of the means of those that have one."""
    means = scores_of(spark, outcomes).groupBy("dataset").agg(F.avg("reward").alias("mean"), F.count("*").alias("n"))
    said = spark.createDataFrame([(o.dataset, o.error) for o in outcomes], "dataset string, error string")
    each = said.join(means, "dataset", "left").select("dataset", "mean", F.coalesce("n", F.lit(0)).alias("n"), "error")
    macro = each.agg(F.lit(None).cast("string").alias("dataset"), F.avg("mean").alias("mean"), F.sum("n").alias("n"), F.lit(None).cast("string").alias("error"))
    return each.unionByName(macro)

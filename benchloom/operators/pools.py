"""Pools of long-lived workers: every language has tasks of its own, as many as its share of the items asks for.

Items are counted by language; a language with a share of the rows gets that share of the slots, one at
least, and its items are dealt over them by their hash. So a language that holds nearly everything is run
by nearly all tasks and no task sees two languages. A task keeps one worker, started with its language's
configuration when the first item comes. Items of languages that nobody has registered share a pool
without a worker and are answered as such; the driver only sees a count for each registered language.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchloom.operators import harness, runner
from benchloom.operators.languages import registered

RESULT = "item_id string, status string, details string, lang string, task int, tasks int"
#: Seconds that reading a request's answer may take beyond the limit of its program.
MARGIN = 30.0


def slots_of(counts: Mapping[str, int], slots: int) -> dict[str, int]:
    """Tasks of each pool: its share of the slots rounded up, so one at least."""
    total = sum(counts.values())
    return {pool: -(-n * slots // total) for pool, n in sorted(counts.items()) if n}


def dealt(items: DataFrame, languages: Mapping[str, tuple], slots: int) -> tuple[DataFrame, dict[str, int]]:
    """items with `task`, dealt so that a partition holds one task, and the tasks of each pool ("" for unknown languages)."""
    pool = F.when(F.col("lang").isin(list(languages)), F.col("lang")).otherwise("")
    counts = {r["pool"]: r["count"] for r in items.groupBy(pool.alias("pool")).count().collect()}
    tasks = slots_of(counts, slots)
    first, at = {}, 0
    for name, n in tasks.items():
        first[name], at = at, at + n
    task = F.lit(0)
    for name, n in tasks.items():
        task = F.when(pool == name, F.lit(first[name]) + F.pmod(F.xxhash64("item_id", "code"), F.lit(n))).otherwise(task)
    rows = items.select("item_id", "code", "test_cases", "lang", task.cast("int").alias("task"))
    return rows.repartitionById(max(1, at), "task"), tasks


def run_pools(items: DataFrame, configs: Mapping[str, str] | None = None, timeout: float = 15.0, slots: int | None = None, item_timeout: float | None = None) -> DataFrame:
    """items (item_id, code, test_cases, lang) -> (item_id, status, details, lang, task, tasks); tasks: how many its pool has.

    configs: language configurations, YAML or JSON by name, beside or instead of the built-in languages.
    timeout is for one test; item_timeout for all tests of an item (else the tests' own limits hold).
    """
    languages = runner.LANGUAGES | registered(dict(configs or {}))
    slots = slots or items.sparkSession.sparkContext.defaultParallelism
    rows, tasks = dealt(items, languages, slots)

    def batches(it):
        import pyarrow as pa

        worker, of = None, None
        try:
            for b in it:
                out = []
                for row in b.to_pylist():
                    task, lang = row.pop("task"), row["lang"]
                    if lang not in languages:
                        found = {"status": "fail:exception", "details": {"message": f"unknown language {lang}"}}
                    else:
                        if worker is None or of != lang:
                            if worker is not None:
                                worker.stop()
                            worker, of = harness.Worker(harness.own_command({lang: languages[lang]}), ready=True), lang
                        worker.timeout = item_timeout or timeout * (1 + len(row["test_cases"] or [])) + runner.COMPILE_S + MARGIN
                        try:
                            found = worker.run(row | {"timeout_s": timeout})
                        except Exception as problem:  # noqa: BLE001  one item must not stop the others
                            worker.stop()
                            found = {"status": "fail:exception", "details": {"type": type(problem).__name__, "message": str(problem)}}
                    out.append({"item_id": row["item_id"], "status": found["status"], "details": json.dumps(found["details"] | {"worker": worker.process.pid if worker and worker.process else None}), "lang": lang, "task": task, "tasks": tasks[lang if lang in languages else ""]})
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        finally:
            if worker is not None:
                worker.stop()

    import pyarrow as pa

    schema = pa.schema([("item_id", pa.string()), ("status", pa.string()), ("details", pa.string()), ("lang", pa.string()), ("task", pa.int32()), ("tasks", pa.int32())])
    return rows.mapInArrow(batches, RESULT)

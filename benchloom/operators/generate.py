"""Batched generation through a client that the caller supplies.

A client is a function of (prompts, n, **options) that returns, for each prompt, a list of n entries: a
response, or None where a request failed. It runs inside the tasks, on batches, and may be asynchronous.
sample_idx is the request's own number, so a failed request leaves a row with an error and never renumbers
the others; a batch that raises becomes a row with the error for each of its samples.
"""

from __future__ import annotations

import asyncio
import inspect
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchloom.operators.curate import shared_table, with_ordinal

RESPONSE = "idx string, sample_idx int, prompt string, response string, error string"


def echo_client(prompts: list[str], n: int, **_) -> list[list[str | None]]:
    """A client without a model, for tests: deterministic, and it refuses prompts with the word `refuse`."""
    return [[None if "refuse" in p else f"```py\nprint({i} + {len(p)})\n```\n" for i in range(n)] for p in prompts]


async def limited(work: list, most: int) -> list:
    """Results of coroutines, at most `most` at a time, in their order; an exception takes its result's place."""
    gate = asyncio.Semaphore(most)

    async def one(w):
        async with gate:
            return await w

    return await asyncio.gather(*map(one, work), return_exceptions=True)


def per_request(ask: Callable, most: int = 20) -> Callable:
    """A client that sends n requests for each prompt through the coroutine function ask(prompt, **options)."""

    def client(prompts, n, **options):
        found = asyncio.run(limited([ask(p, **options) for p in prompts for _ in range(n)], most))
        found = [None if isinstance(x, BaseException) else x for x in found]
        return [found[i * n : (i + 1) * n] for i in range(len(prompts))]

    return client


def generate(prompts: DataFrame, client: Callable = echo_client, n: int = 1, batch: int = 32, partitions: int | None = None, **options) -> DataFrame:
    """prompts (idx, prompt) -> n rows each."""

    def batches(it):
        import pyarrow as pa

        for b in it:
            rows = b.to_pylist()
            for a in range(0, len(rows), batch):
                part = rows[a : a + batch]
                error = "request failed"
                try:
                    said = client([r["prompt"] for r in part], n, **options)
                    said = asyncio.run(said) if inspect.isawaitable(said) else said
                except Exception as problem:  # noqa: BLE001  the batch's rows tell
                    said, error = [[None] * n] * len(part), f"{type(problem).__name__}: {problem}"
                out = [{"idx": r["idx"], "sample_idx": i, "prompt": r["prompt"], "response": x, "error": error if x is None else None} for r, answers in zip(part, said, strict=True) for i, x in enumerate(answers)]
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    import pyarrow as pa

    schema = pa.schema([("idx", pa.string()), ("sample_idx", pa.int32()), ("prompt", pa.string()), ("response", pa.string()), ("error", pa.string())])
    rows = prompts.select(F.col("idx").cast("string").alias("idx"), "prompt")
    return (rows.repartition(partitions, "idx") if partitions else rows).mapInArrow(batches, RESPONSE)


PACED = "idx string, sample_idx int, prompt string, response string, error string, attempt int"


def generate_paced(prompts: DataFrame, client: Callable, n: int = 1, quota: int = 60, period: float = 60.0, slots: int = 8, attempts: int = 3, backoff: float = 1.0, **options) -> DataFrame:
    """prompts (idx, prompt) -> n rows each with `attempt`; the whole cluster sends at most `quota` requests in any `period` seconds.

    The quota is split over slots, and a slot keeps its share by leaving time between its requests, so no slot has to
    know of the others; fewer machines than slots only send less. Requests that failed are dealt to all slots
    anew in the next round, after a pause that doubles, so no slot waits for one that has many of them.
    """
    slots = max(1, min(slots, quota))
    apart = period / (quota // slots)

    def send(batches):
        import pyarrow as pa

        last = time.monotonic()  # as if the slot's last request of the round before had just been sent
        for b in batches:
            for r in b.to_pylist():
                time.sleep(max(0.0, last + apart - time.monotonic()))
                last, error, said = time.monotonic(), "request failed", None
                try:
                    said = client([r["prompt"]], 1, **options)
                    said = (asyncio.run(said) if inspect.isawaitable(said) else said)[0][0]
                except Exception as problem:  # noqa: BLE001  the row tells
                    error = f"{type(problem).__name__}: {problem}"
                yield pa.RecordBatch.from_pylist([r | {"response": said, "error": error if said is None else None}], schema=schema)

    import pyarrow as pa

    schema = pa.schema([("idx", pa.string()), ("sample_idx", pa.int32()), ("prompt", pa.string()), ("response", pa.string()), ("error", pa.string()), ("attempt", pa.int32())])
    waiting = prompts.select(F.col("idx").cast("string").alias("idx"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("sample_idx"), "prompt")
    done = None
    for attempt in range(1, attempts + 1):
        slot = F.pmod(F.col("__place"), F.lit(slots)).cast("int")
        dealt = with_ordinal(waiting, ["idx", "sample_idx"], "__place").withColumn("__slot", slot).repartitionById(slots, "__slot")
        sent = shared_table(dealt.select("idx", "sample_idx", "prompt", F.lit(None).cast("string").alias("response"), F.lit(None).cast("string").alias("error"), F.lit(attempt).alias("attempt")).mapInArrow(send, PACED), "paced")
        final = sent if attempt == attempts else sent.where("response IS NOT NULL")
        done = final if done is None else done.unionByName(final)
        waiting = sent.where("response IS NULL").select("idx", "sample_idx", "prompt")
        if attempt == attempts or waiting.isEmpty():
            break
        time.sleep(backoff * 2 ** (attempt - 1))
    return done


def rewarded(rows: DataFrame, rewards: list[Callable], completion: str = "completion") -> DataFrame:
    """rows with a column `rewards`, a map from each function's name to its value.

    A reward is a function of a list of (completion, row as dict) to a list of floats, called by batch.
    """
    names = [f.__name__ for f in rewards]
    if len(set(names)) < len(names):
        raise ValueError("two rewards have the same name")

    def batches(it):
        import pyarrow as pa

        for b in it:
            items = [(r[completion], r) for r in b.to_pylist()]
            values = [f(items) for f in rewards]
            if any(len(v) != len(items) for v in values):
                raise ValueError("a reward returned another number of values than rows")
            maps = [list(zip(names, map(float, v))) for v in zip(*values)] if items else []
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(maps, pa.map_(pa.string(), pa.float64()))], names=[*b.schema.names, "rewards"])

    from pyspark.sql.types import DoubleType, MapType, StringType, StructField, StructType

    schema = StructType([*rows.schema.fields, StructField("rewards", MapType(StringType(), DoubleType()))])
    return rows.mapInArrow(batches, schema)

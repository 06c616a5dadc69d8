"""Verify response files as they arrive: each item once, resumable after a crash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benchloom.functions import text as T
from benchloom.operators import runner
from benchloom.schemas import EXAMPLE
from benchloom.sources import sink

RESPONSES = f"idx string, sample_idx int, response string, lang string, test_cases array<{EXAMPLE}>"


def items_of(responses: DataFrame) -> DataFrame:
    return responses.select(T.item_id(F.col("idx"), F.col("sample_idx")).alias("item_id"), T.final_block(F.col("response")).alias("code"), "test_cases", "lang")


def verify_stream(spark: SparkSession, source: str, out: str, checkpoint: str, timeout: float = 15.0) -> None:
    """Runs every response file below source that no earlier call has seen; results go to the sink `out`.

    The checkpoint remembers the files and the ids of items that came, so an item of two files runs once;
    a batch that crashed is run again and published once, and nothing that is in the sink is read for it.
    """
    items = items_of(spark.readStream.schema(RESPONSES).json(source)).dropDuplicates(["item_id"])
    stream = sink.stream_into(items, out, checkpoint, lambda batch: runner.run_items(batch, timeout))
    stream.trigger(availableNow=True).start().awaitTermination()

"""Per-key figures over a stream, in arrival order: running maxima, laps and the first k rows of a key.

What a key needs of its past is a handful of numbers (its maximum, its last time, how many rows it had), kept
in Spark's state store by key, so state stays small however many rows a key has. Rows of a key that come in
one batch are put in order first, in memory, so the batch's size (maxFilesPerTrigger) bounds a hot key's
share of a task; rows of a later batch count as later, which is what arrival order means.

Defined cases: rows without key or time are left out; a null value changes no maximum, and the maximum is null
until there is one; of equal times the smaller event id comes first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "best double, last long, seen long"
OUTPUT = "event_id long, key long, running_max double, lap_us long, rank long"


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    best, last, seen = state.get if state.exists else (None, None, 0)
    rows = pd.concat(list(frames)).sort_values(["us", "event_id"], kind="stable")
    # a null value changes no maximum, and a maximum of nothing is null
    values = rows["value"].cummax().ffill()
    if best is not None:
        values = values.fillna(best).clip(lower=best)
    laps = rows["us"].astype("Int64").diff()
    if last is not None:
        laps.iloc[0] = int(rows["us"].iloc[0]) - last
    n = len(rows)
    top = values.iloc[-1]
    state.update((None if pd.isna(top) else float(top), int(rows["us"].iloc[-1]), seen + n))
    yield pd.DataFrame({"event_id": rows["event_id"], "key": key[0], "running_max": values, "lap_us": laps, "rank": range(seen + 1, seen + n + 1)})


def keyed_progress(events: DataFrame, key: str = "user_id", time: str = "ts", value: str = "value", event: str = "event_id") -> DataFrame:
    """events, a stream -> (event_id, key, running_max, lap_us, rank); rank counts a key's rows from 1, so `rank <= k` are its first k."""
    kind = dict(events.dtypes)[time]
    us = F.unix_micros(time) if kind == "timestamp" else F.unix_micros(F.col(time).cast("timestamp"))
    rows = events.select(F.col(event).cast("long").alias("event_id"), F.col(key).cast("long").alias("key"), us.alias("us"), F.col(value).cast("double").alias("value")).where("key IS NOT NULL AND us IS NOT NULL")
    return rows.groupBy("key").applyInPandasWithState(_advance, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)

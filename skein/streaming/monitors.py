"""Online monitors: transition counts, per-type windows, first events and Lamport clocks over event streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files: int = 1, glob: str = "*.parquet") -> DataFrame:
    """A stream of event files as they arrive."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).option("pathGlobFilter", glob).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, event_type, n) per tumbling window; a window is final once the watermark has passed it."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def _in_order(batches: Iterator[pd.DataFrame], columns: list[str]) -> pd.DataFrame | None:
    """All rows of a key in a trigger, in order: a key's rows may come in several batches, in any order."""
    parts = [b for b in batches if len(b)]
    return pd.concat(parts).sort_values(columns, kind="stable") if parts else None


def _pairs(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = _in_order(batches, ["ts", "event_id"])
    if rows is None:
        return
    types = rows["event_type"].tolist()
    before = [state.get[0] if state.exists else None, *types[:-1]]
    yield pd.DataFrame([(key[0], a, b) for a, b in zip(before, types, strict=True) if a is not None], columns=["user_id", "src", "dst"])
    state.update((types[-1],))


def transitions(events: DataFrame) -> DataFrame:
    """(user_id, src, dst) of each event and its user's previous one, which the state keeps. Triggers come in order; a trigger's rows may not."""
    return events.groupBy("user_id").applyInPandasWithState(_pairs, "user_id long, src string, dst string", "last string", "append", GroupStateTimeout.NoTimeout)


def _clock(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = _in_order(batches, ["seq"])
    if rows is None:
        return
    now, out = state.get[0] if state.exists else 0, []
    for seq, remote in zip(rows["seq"], rows["remote"], strict=True):
        now = max(now, int(remote) if remote is not None and remote == remote else 0) + 1
        out.append((key[0], int(seq), now))
    yield pd.DataFrame(out, columns=["process", "seq", "clock"])
    state.update((now,))


def lamport_clocks(messages: DataFrame) -> DataFrame:
    """(process, seq, clock): each process's clock after every event; a received time is caught up with."""
    return messages.groupBy("process").applyInPandasWithState(_clock, "process string, seq long, clock long", "clock long", "append", GroupStateTimeout.NoTimeout)


def first_events(events: DataFrame, keys: list[str], late: str = "30 days") -> DataFrame:
    """The first event of each key within the watermark, as it arrives: coverage progress online."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)

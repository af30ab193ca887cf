"""Streams of fetch events: latest state, windowed mixes and streaks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "ts timestamp, url string, host string, outcome string, status int"


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """An event log as a stream: files of JSON lines that are only ever added."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).json(path)


def outcome_mix(events: DataFrame, window: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Events per host, outcome and window; rows later than ``late`` are not waited for."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "host", "outcome").agg(F.count(F.lit(1)).alias("n")).select("window.start", "host", "outcome", "n")


def first_seen(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Each (url, outcome) once within the time rows may be late."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["url", "outcome"])


def streaks(events: DataFrame, most: int = 10) -> DataFrame:
    """An alarm whenever a host has had ``most`` bad outcomes in a row (F29): ``host, at, length``. The state of a host is
    one number, kept between batches; rows of a batch count in order of time."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        length = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        alarms = []
        for ts, outcome in zip(rows["ts"], rows["outcome"]):
            length = 0 if outcome == "ok" else length + 1
            if length == most:
                alarms.append((key[0], ts, length))
        state.update((length,))
        yield pd.DataFrame(alarms, columns=["host", "at", "length"]).astype({"host": object})

    return events.where("host IS NOT NULL").groupBy("host").applyInPandasWithState(step, "host string, at timestamp, length long", "length long", "append", GroupStateTimeout.NoTimeout)


def latest_state(events: DataFrame, target: str, checkpoint: str):
    """Keeps a table with the last event of each url (F20, L10): every batch is merged with what the table holds and written
    beside it as the next version; readers take the newest complete one."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = f"{target}/v{number - 1}"
        rows = batch.unionByName(spark.read.parquet(old)) if number else batch
        keep = rows.groupBy("url").agg(F.max_by(F.struct("ts", "host", "outcome", "status"), F.struct("ts", "outcome", "status")).alias("r")).select("url", "r.*")
        keep.write.mode("overwrite").parquet(f"{target}/v{number}")

    return events.where("url IS NOT NULL").writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).outputMode("update")

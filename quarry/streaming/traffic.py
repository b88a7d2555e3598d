"""Streaming operators: request metrics, change scans and per-client rate limits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LIMIT, SECONDS = 60, 60


def minutes(events: DataFrame, *, late: str = "10 minutes", size: str = "1 minute", slide: str | None = None) -> DataFrame:
    """Requests by event-time window and type; events: ts, event_type, value. Batch or stream."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", size, slide) if slide else F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, *, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of a user's events with no longer gap."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))


def _accept(times: list[float], kept: list[float], limit: int, seconds: float) -> tuple[list[bool], list[float]]:
    """Which requests pass: fewer than limit accepted ones in the last seconds; only accepted ones count."""
    out = []
    for t in times:
        kept = [k for k in kept if t - k < seconds]
        out.append(len(kept) < limit)
        if out[-1]:
            kept.append(t)
    return out, kept


def accepted(events: DataFrame, *, limit: int = LIMIT, seconds: float = SECONDS) -> DataFrame:
    """(event_id, user_id, accepted) by a sliding window of accepted requests, in order of time, for each user."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["t", "event_id"])
        rows["accepted"] = _accept(rows["t"].tolist(), [], limit, seconds)[0]
        return rows[["event_id", "user_id", "accepted"]]

    times = events.select("event_id", "user_id", F.col("ts").cast("timestamp").cast("double").alias("t"))
    return times.groupBy("user_id").applyInPandas(one, "event_id long, user_id long, accepted boolean")


def accepted_stream(events: DataFrame, *, limit: int = LIMIT, seconds: float = SECONDS, late: str = "10 minutes") -> DataFrame:
    """The same over a stream, judged as requests come; those later than `late` are dropped.

    The state of a user is the times of its accepted requests in the window. It goes when the watermark has passed
    the last of them by the window's length, so users who stay away hold none.
    """

    def one(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).sort_values(["t", "event_id"])
        rows["accepted"], kept = _accept(rows["t"].tolist(), kept, limit, seconds)
        state.update((kept,))
        ends = int(1000 * (max(kept, default=float(rows["t"].max())) + seconds))
        state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs()) + 1)
        yield rows[["event_id", "user_id", "accepted"]]

    ts = F.col("ts").cast("timestamp")
    # a watermark starts at the epoch and what lies on it is late, hence the millisecond
    times = events.select("event_id", "user_id", ts.cast("double").alias("t"), (ts + F.expr("INTERVAL 1 MILLISECOND")).alias("seen")).withWatermark("seen", late)
    return times.groupBy("user_id").applyInPandasWithState(one, "event_id long, user_id long, accepted boolean", "kept array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def changed_files(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """A stream of new files with the hash of their content; run it with an available-now trigger for a periodic scan."""
    schema = spark.read.format("binaryFile").load(folder).schema
    rows = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return rows.select("path", "length", F.sha2(F.col("content"), 256).alias("sha256"), "modificationTime")

"""Structured Streaming over ledger events and admission attempts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.operators.budgets import PER_SESSION, WINDOW_S
from lodestone.operators.ledger import replayable

#: Seconds after which a run is warned and ended.
SOFT_S, HARD_S = 45, 60


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Appended event files as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def replay_stream(events: DataFrame, runs: DataFrame, after: int = 0) -> DataFrame:
    """Events past the cursor; terminal ones wait for the run's stored status (a stream-static join)."""
    return replayable(events, runs, after)


def admission_stream(attempts: DataFrame, per_session: int = PER_SESSION, window: float = WINDOW_S) -> DataFrame:
    """session_id, attempt_id and admitted of attempts (session_id, attempt_id, at in seconds), with each session's admissions as state."""
    def admit(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["at", "attempt_id"])
        admitted = []
        for at in rows["at"]:
            kept = [t for t in kept if t >= at - window]
            admitted.append(len(kept) < per_session)
            if admitted[-1]:
                kept.append(float(at))
        state.update((kept,))
        yield pd.DataFrame({"session_id": key[0], "attempt_id": rows.attempt_id, "admitted": admitted})

    return attempts.groupBy("session_id").applyInPandasWithState(admit, "session_id string, attempt_id long, admitted boolean", "admitted array<double>", "append", GroupStateTimeout.NoTimeout)


def run_timeouts(events: DataFrame, delay: str = "1 minute", soft: int = SOFT_S, hard: int = HARD_S) -> DataFrame:
    """run_id and state of runs from events (run_id, type, at): a run without a terminal event is 'slow' after `soft`
    seconds of event time and 'expired' after `hard`."""
    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (start,) = state.get if state.exists else (None,)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"run_id": [key[0]], "state": ["expired"], "seconds": [float(hard)]})
            return
        rows = pd.concat(list(frames)).sort_values("at")
        begun = int(rows["at"].min().timestamp() * 1000)
        start = begun if start is None else min(start, begun)
        ended = rows[rows["type"].str.startswith("run.") & ~rows["type"].isin(["run.started", "run.created"])]
        if len(ended):
            seconds = ended["at"].min().timestamp() - start / 1000
            if state.exists:
                state.remove()
            yield pd.DataFrame({"run_id": [key[0]], "state": ["expired" if seconds > hard else "slow" if seconds > soft else "ended"], "seconds": [seconds]})
            return
        state.update((start,))
        state.setTimeoutTimestamp(max(start + hard * 1000, state.getCurrentWatermarkMs() + 1))

    marked = events.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", delay)
    return marked.groupBy("run_id").applyInPandasWithState(follow, "run_id string, state string, seconds double", "start long", "append", GroupStateTimeout.EventTimeTimeout)


def windowed_usage(calls: DataFrame, width: str = "1 hour", slide: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Tokens by session and sliding window, late rows within the delay included."""
    marked = calls.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", delay)
    return marked.groupBy("session_id", F.window("at", width, slide)).agg(F.sum("tokens").alias("tokens")).select("session_id", F.col("window.start").alias("start"), "tokens")


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process all that is there now and stop; a second call goes on from the checkpoint."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()

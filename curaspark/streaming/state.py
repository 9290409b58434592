"""Streams of requests and task states: a token bucket, limits by window, the latest state of tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def token_bucket(events: DataFrame, key: str, time: str, id: str, capacity: float, per_second: float) -> DataFrame:
    """(key, id, accepted) for each request of a stream (or table) of events, with a bucket of tokens held per key."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, at = state.get if state.exists else (float(capacity), None)
        rows = pd.concat(frames).sort_values(["t", "id"])
        accepted = []
        for t in rows["t"]:
            tokens = min(float(capacity), tokens + (t - at) * per_second) if at is not None else tokens
            ok, at = tokens >= 1, t
            tokens -= ok
            accepted.append(ok)
        state.update((float(tokens), float(at)))
        yield pd.DataFrame({"key": k[0], "id": rows["id"], "accepted": accepted})

    seconds = F.unix_micros(F.col(time).cast("timestamp")) / 1e6
    rows = events.select(F.col(key).cast("string").alias("key"), F.col(id).cast("long").alias("id"), seconds.alias("t"))
    return rows.groupBy("key").applyInPandasWithState(step, "key string, id long, accepted boolean", "tokens double, at double", "append", GroupStateTimeout.NoTimeout)


def window_counts(events: DataFrame, key: str, time: str, width: str = "1 minute", lateness: str = "10 minutes") -> DataFrame:
    """Requests by key and window of event time; late rows within the lateness still count."""
    held = events.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", lateness)
    return held.groupBy(key, F.window("_at", width).alias("window")).agg(F.count(F.lit(1)).alias("requests"))


def latest_states(log: DataFrame, key: str, time: str, state: str) -> DataFrame:
    """The newest state of each task, in update or complete mode."""
    return log.groupBy(key).agg(F.max_by(state, time).alias(state), F.max(time).alias(time))


def task_states(results: DataFrame, session: str, task: str, result: str, time: str, error: str | None = None) -> DataFrame:
    """(session, task, state, error, at): completed where there is a result, else failed with its error."""
    done = F.col(result).isNotNull()
    told = F.when(~done, F.col(error)) if error else F.lit(None)
    state = F.when(done, "completed").otherwise("failed")
    return results.select(F.col(session).cast("string").alias("session"), F.col(task).cast("string").alias("task"), state.alias("state"), told.cast("string").alias("error"), F.col(time).cast("timestamp").alias("at"))


def save_states(stream: DataFrame, folder: str, checkpoint: str):
    """Starts a query that appends a stream of task states to a log of Parquet folders, one for each batch.

    A batch that is replayed after a failure replaces its own folder, so its rows are there once."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number:012d}")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cancel(spark: SparkSession, folder: str, session: str, at: str, reason: str = "cancelled") -> None:
    """Appends the cancellation of a session to the log, as a state of no task; cancelled again, it replaces itself."""
    row = spark.createDataFrame([(session, None, "cancelled", reason, at)], "session string, task string, state string, error string, at string")
    name = row.select(F.sha2(F.lit(session), 256)).first()[0]
    row.withColumn("at", F.col("at").cast("timestamp")).write.mode("overwrite").parquet(f"{folder}/batch=cancel-{name}")


LOG = "session string, task string, state string, error string, at timestamp, batch string"


def saved_states(spark: SparkSession, folder: str) -> DataFrame:
    """What resolved_states makes of the log in a folder."""
    return resolved_states(spark.read.schema(LOG).parquet(folder))


def resolved_states(log: DataFrame) -> DataFrame:
    """(session, task, state, at): the newest state of each task; tasks that a cancellation found unfinished are failed.

    Of states with one time the last one by name counts. A task is unfinished unless its newest state is completed."""
    newest = log.where("task IS NOT NULL").groupBy("session", "task").agg(F.max(F.struct("at", "state")).alias("last"))
    ends = log.where("task IS NULL AND state = 'cancelled'").groupBy("session").agg(F.min("at").alias("cancelled_at"))
    held = newest.join(ends, "session", "left").select("session", "task", "last.state", "last.at", "cancelled_at")
    cut = F.col("cancelled_at").isNotNull() & (F.col("state") != "completed")
    return held.select("session", "task", F.when(cut, "failed").otherwise(F.col("state")).alias("state"), F.when(cut, F.greatest("at", "cancelled_at")).otherwise(F.col("at")).alias("at"))

"""Task and checkpoint state as append-only logs: latest state, progress, resume, retention, durations, rate limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, key: str | list[str], *order: str) -> DataFrame:
    """The last row of each key, by map-side combining: no key's history meets in one task."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in log.columns if c not in keys]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"))
    return last.select(*keys, "_last.*")


def retention(checkpoints: DataFrame, keep: int, updated: str, id: str, by: str | None = None) -> DataFrame:
    """The checkpoints beyond the newest ones, of all or of each group."""
    w = Window.partitionBy(*([by] if by else [])).orderBy(F.desc(updated), F.desc(id))
    if by:
        return checkpoints.withColumn("age_rank", F.row_number().over(w)).where(F.col("age_rank") > keep)
    newest = checkpoints.orderBy(F.desc(updated), F.desc(id)).limit(keep)  # a top-k, then everything else
    return checkpoints.join(newest.select(id), id, "left_anti")


def cascade(tasks: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """The tasks of removed checkpoints."""
    return tasks.join(removed.select(key).distinct(), key, "left_semi")


def progress(log: DataFrame, session: str, state: Column, done: str = "completed", failed: str = "failed") -> DataFrame:
    """Per session: total, completed, failed, progress, success_rate (of those ended; 0 where none has)."""
    counts = log.groupBy(session).agg(F.count(F.lit(1)).alias("total"), F.count_if(state == done).alias("completed"), F.count_if(state == failed).alias("failed"))
    ended = F.col("completed") + F.col("failed")
    return counts.withColumns({"progress": F.col("completed") / F.col("total"), "success_rate": F.coalesce(F.try_divide("completed", ended), F.lit(0.0))})


def session_status(progress_rows: DataFrame) -> DataFrame:
    status = F.when(F.col("completed") + F.col("failed") < F.col("total"), "processing").when(F.col("failed") > 0, "failed").otherwise("completed")
    return progress_rows.withColumn("status", status)


def pending(tasks: DataFrame, log: DataFrame, key: str, completed: Column) -> DataFrame:
    """Tasks without a completed row in the log: what a resumed run has to do."""
    return tasks.join(log.where(completed).select(key).distinct(), key, "left_anti")


def durations(log: DataFrame, key: str, time: str, id: str) -> DataFrame:
    """Seconds from each state of a key to the next; null for the last."""
    following = F.lead(time).over(Window.partitionBy(key).orderBy(time, id))
    return log.withColumn("seconds", (F.unix_micros(following.cast("timestamp")) - F.unix_micros(F.col(time).cast("timestamp"))) / 1e6)


def fallback(attempts: DataFrame, key: str, priority: str, ok: Column, result: str) -> DataFrame:
    """Of each key the result of the first source, by priority, that succeeded; null where none did."""
    return attempts.groupBy(key).agg(F.min_by(F.col(result), F.when(ok, F.col(priority))).alias("result"), F.min(F.when(ok, F.col(priority))).alias("source"))


def fixed_window_limit(events: DataFrame, key: str, time: str, limit: int, width: str = "1 minute") -> DataFrame:
    """Requests, allowed and rejected by key and window of time."""
    counts = events.groupBy(key, F.window(F.col(time).cast("timestamp"), width).alias("w")).agg(F.count(F.lit(1)).alias("requests"))
    return counts.select(key, F.col("w.start").alias("window_start"), "requests", F.least("requests", F.lit(limit)).alias("allowed"), F.greatest(F.col("requests") - limit, F.lit(0)).alias("rejected"))


def token_bucket(events: DataFrame, key: str, time: str, id: str, capacity: float, per_second: float) -> DataFrame:
    """Per key: requests and accepted, with a bucket that refills steadily; a fold over the key's requests in order.

    The fold needs a key's requests in order, so a key's times (numbers) meet in one task; keys are providers or users."""
    start = F.struct(F.lit(float(capacity)).alias("tokens"), F.lit(None).cast("double").alias("at"), F.lit(0).cast("long").alias("accepted"))

    def step(s: Column, t: Column) -> Column:
        filled = F.least(F.lit(float(capacity)), s["tokens"] + F.coalesce(t - s["at"], F.lit(0.0)) * per_second)
        ok = filled >= 1
        return F.struct(F.when(ok, filled - 1).otherwise(filled).alias("tokens"), t.alias("at"), (s["accepted"] + F.when(ok, 1).otherwise(0)).alias("accepted"))

    seconds = F.unix_micros(F.col(time).cast("timestamp")) / 1e6
    times = events.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(seconds.alias("t"), F.col(id).alias("i")))), lambda e: e["t"]).alias("times"))
    folded = F.aggregate("times", start, step)
    return times.select(key, F.size("times").cast("long").alias("requests"), folded["accepted"].alias("accepted"))


def estimated(log: DataFrame, key: str, state: Column, time: str) -> DataFrame:
    """By key: tasks done and remaining, seconds elapsed, and seconds to go at that pace; null before the first is done."""
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    held = log.groupBy(key).agg(
        F.count_if(state.isin("completed", "failed")).alias("done"),
        F.count_if(~state.isin("completed", "failed")).alias("remaining"),
        (seconds(F.max(time)) - seconds(F.min(time))).alias("elapsed"),
    )
    return held.withColumn("eta", F.when(F.col("done") > 0, F.col("elapsed") / F.col("done") * F.col("remaining")))


def failed(log: DataFrame, state: Column | str, name: str = "failed") -> DataFrame:
    """The rows of a log that failed; unknown states did not."""
    return log.where(F.coalesce((F.col(state) if isinstance(state, str) else state) == name, F.lit(False)))

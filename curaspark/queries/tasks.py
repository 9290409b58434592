"""Queries over events as a log of tasks, checkpoints, requests and cache accesses.

user_id is the session, event_type the state (purchase: completed, error: failed), value a size in bytes."""

from __future__ import annotations

from pyspark.sql import functions as F

from curaspark.operators import cache, summary, tasks
from curaspark.queries.dataset import table
from curaspark.sources import shared
from curaspark.streaming import state



def events(spark, sf_dir):
    held = table(spark, sf_dir, "events")
    state = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("processing")
    return held.withColumn("state", state)


def latest_checkpoint(spark, sf_dir):
    held = tasks.latest(events(spark, sf_dir).select("user_id", "ts", "event_id", "state"), "user_id", "ts", "event_id")
    return held.select("user_id", "event_id", "state")


def checkpoint_retention(spark, sf_dir):
    return tasks.retention(events(spark, sf_dir), 10, "ts", "event_id", "user_id").select("user_id", "event_id", F.col("age_rank").cast("long").alias("age_rank"))


def checkpoint_cascade(spark, sf_dir):
    """The lines of the orders beyond the newest hundred."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    gone = tasks.retention(orders, 100, "o_orderdate", "o_orderkey").withColumnRenamed("o_orderkey", "l_orderkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return tasks.cascade(lines, gone, "l_orderkey").groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("lines"))


def task_progress(spark, sf_dir):
    held = tasks.session_status(tasks.progress(events(spark, sf_dir), "user_id", F.col("state")))
    return held.select("user_id", "total", "completed", "failed", F.round("progress", 6).alias("progress"), F.round("success_rate", 6).alias("success_rate"), "status")


def resume_pending(spark, sf_dir):
    """Sessions without a completed task after their last failure."""
    held = events(spark, sf_dir)
    failures = held.where(F.col("state") == "failed").groupBy("user_id").agg(F.max("ts").alias("last"))
    later = held.join(failures, "user_id").where("ts > last")
    return tasks.pending(failures.select("user_id"), later, "user_id", F.col("state") == "completed")


def session_eta(spark, sf_dir):
    held = tasks.estimated(events(spark, sf_dir), "user_id", F.col("state"), "ts")
    return held.select("user_id", "done", "remaining", F.round("elapsed", 3).alias("elapsed"), F.round("eta", 3).alias("eta"))


def saved_task_states(spark, sf_dir):
    """The newest state of fifty tasks a session, of which every seventh session was cancelled."""
    rows = table(spark, sf_dir, "events").withColumn("result", F.when(F.col("event_type") == "purchase", F.col("value")))
    log = state.task_states(rows.withColumn("task", F.col("event_id") % 50), "user_id", "task", "result", "ts", "event_type")
    ends = rows.where("user_id % 7 = 0").select(F.col("user_id").cast("string").alias("session")).distinct()
    ends = ends.select("session", F.lit(None).cast("string").alias("task"), F.lit("cancelled").alias("state"), F.lit("stop").alias("error"), F.lit("2024-01-10 00:00:00").cast("timestamp").alias("at"))
    held = state.resolved_states(log.unionByName(ends))
    return held.groupBy("session", "state").agg(F.count(F.lit(1)).alias("tasks"), F.max(F.unix_micros("at")).alias("newest"))


def cache_upsert(spark, sf_dir):
    """Two rounds of entries put into a stored index, and what it holds then."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("cache_key"), F.col("ts").alias("created"), "event_id", F.col("value").alias("file_size"), F.col("ts").alias("last_accessed"))
    path = shared.new_folder(spark, "cache_index")
    cache.upsert(rows.where("event_id % 2 = 0"), path)
    cache.upsert(rows.where("event_id % 2 = 1"), path)
    return cache.stored(spark, path).select("cache_key", "event_id", F.round("file_size", 6).alias("file_size"))


def last_states(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", "user_id", "state").transform(summary.top, 10, F.desc("event_id"))


def failed_tasks(spark, sf_dir):
    return tasks.failed(events(spark, sf_dir), "state").select("event_id", "user_id")


def task_durations(spark, sf_dir):
    held = tasks.durations(events(spark, sf_dir).select("user_id", "ts", "event_id"), "user_id", "ts", "event_id")
    return held.select("event_id", F.round("seconds", 3).alias("seconds"))


def fallback_choice(spark, sf_dir):
    """Of each user the first source, in the order of names, that did not fail."""
    return tasks.fallback(events(spark, sf_dir), "user_id", "event_type", F.col("state") != "failed", "event_id").select("user_id", "source")


def fixed_window_limit(spark, sf_dir):
    held = tasks.fixed_window_limit(events(spark, sf_dir), "event_type", "ts", 15, "1 hour")
    return held.select("event_type", F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "requests", "allowed", "rejected")


def token_bucket(spark, sf_dir):
    return tasks.token_bucket(events(spark, sf_dir), "user_id", "ts", "event_id", 2.0, 1 / 86400)


def cache_hits(spark, sf_dir):
    """Requests for parts by order lines, an index of parts up to size 25, and files of even numbers."""
    requests = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("cache_key"), "l_quantity")
    held = cache.lookup(requests, _index(spark, sf_dir), _files(spark, sf_dir))
    return held.groupBy("hit").agg(F.count(F.lit(1)).alias("requests"))


def _index(spark, sf_dir):
    return table(spark, sf_dir, "part").where("p_size <= 25").select(F.col("p_partkey").alias("cache_key"), F.format_string("cache/%d.wav", "p_partkey").alias("file_path"), F.col("p_size").alias("file_size"))


def _files(spark, sf_dir):
    return table(spark, sf_dir, "part").where("p_retailprice > 940").select(F.format_string("cache/%d.wav", "p_partkey").alias("file_path"))


def cache_orphans(spark, sf_dir):
    return cache.orphans(_files(spark, sf_dir), _index(spark, sf_dir))


def cache_index_live(spark, sf_dir):
    return cache.live_entries(_index(spark, sf_dir), _files(spark, sf_dir)).select("cache_key", "file_size")


def cache_lru_evict(spark, sf_dir):
    """Accesses as entries; the cap is 600 times the mean size and grows with the table."""
    entries = events(spark, sf_dir).select("event_id", "ts", F.round(F.col("value") * 100).cast("long").alias("size"))
    cap = entries.agg(F.sum("size") * 0.6).first()[0] or 0
    return cache.to_evict(entries, cap, 0.8, "size", "ts", "event_id").select("event_id", "evicted_before")


def cache_stats(spark, sf_dir):
    requests = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("cache_key"), F.col("l_linenumber").alias("file_size"))
    held = cache.lookup(requests, _index(spark, sf_dir).drop("file_size"), _files(spark, sf_dir))
    return cache.totals(held).select("lookups", "hits", "misses", "bytes", F.round("hit_rate", 6).alias("hit_rate"))


EVENTS = "e AS (SELECT *, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'processing' END AS state FROM events)"
INDEX = "i AS (SELECT p_partkey AS cache_key, 'cache/' || p_partkey || '.wav' AS file_path, p_size AS file_size FROM part WHERE p_size <= 25), f AS (SELECT 'cache/' || p_partkey || '.wav' AS file_path FROM part WHERE p_retailprice > 940)"
LOOKED = f"{INDEX}, l AS (SELECT l_linenumber, i.cache_key IS NOT NULL AND f.file_path IS NOT NULL AS hit FROM lineitem LEFT JOIN i ON l_partkey = cache_key LEFT JOIN f USING (file_path))"
SQL = {
    "saved_task_states": """WITH t AS (SELECT user_id, ts, CASE WHEN event_type = 'purchase' THEN 'completed' ELSE 'failed' END AS state, row_number() OVER (PARTITION BY user_id, event_id % 50 ORDER BY ts DESC, CASE WHEN event_type = 'purchase' THEN 1 ELSE 2 END DESC) AS r FROM events)
SELECT user_id::VARCHAR AS session, state, count(*) AS tasks, max(epoch_us(CASE WHEN user_id % 7 = 0 AND state = 'failed' THEN greatest(ts, TIMESTAMP '2024-01-10 00:00:00') ELSE ts END)) AS newest FROM t WHERE r = 1 GROUP BY ALL""",
    "cache_upsert": """SELECT user_id::VARCHAR AS cache_key, event_id, round(value, 6) AS file_size
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 2 DESC, ts DESC, event_id) AS r FROM events) WHERE r = 1""",
    "latest_checkpoint": f"WITH {EVENTS} SELECT user_id, event_id, state FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM e) WHERE r = 1",
    "checkpoint_retention": "SELECT user_id, event_id, r AS age_rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r > 10",
    "checkpoint_cascade": "SELECT l_linenumber, count(*)::BIGINT AS lines FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM (SELECT *, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r > 100) GROUP BY 1",
    "task_progress": f"""WITH {EVENTS}, c AS (SELECT user_id, count(*) AS total, count(*) FILTER (state = 'completed') AS completed, count(*) FILTER (state = 'failed') AS failed FROM e GROUP BY user_id)
SELECT user_id, total, completed, failed, round(completed / total, 6) AS progress, coalesce(round(completed / nullif(completed + failed, 0), 6), 0) AS success_rate,
  CASE WHEN completed + failed < total THEN 'processing' WHEN failed > 0 THEN 'failed' ELSE 'completed' END AS status FROM c""",
    "resume_pending": "SELECT user_id FROM events GROUP BY user_id HAVING max(ts) FILTER (event_type = 'error') IS NOT NULL AND coalesce(max(ts) FILTER (event_type = 'purchase') <= max(ts) FILTER (event_type = 'error'), true)",
    "session_eta": """SELECT user_id, done::BIGINT AS done, (total - done)::BIGINT AS remaining, round(elapsed, 3) AS elapsed, round(CASE WHEN done > 0 THEN elapsed / done * (total - done) END, 3) AS eta
  FROM (SELECT user_id, count(*) AS total, count(*) FILTER (event_type IN ('purchase', 'error')) AS done, epoch_us(max(ts) - min(ts)) / 1e6 AS elapsed FROM events GROUP BY user_id)""",
    "last_states": "SELECT event_id, user_id, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'processing' END AS state FROM events ORDER BY event_id DESC LIMIT 10",
    "failed_tasks": "SELECT event_id, user_id FROM events WHERE event_type = 'error'",
    "task_durations": "SELECT event_id, round(epoch_us(lead(ts) OVER w - ts) / 1e6, 3) AS seconds FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "fallback_choice": "SELECT user_id, min(event_type) FILTER (event_type <> 'error') AS source FROM events GROUP BY user_id",
    "fixed_window_limit": "SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, count(*)::BIGINT AS requests, least(count(*), 15)::BIGINT AS allowed, greatest(count(*) - 15, 0)::BIGINT AS rejected FROM events GROUP BY 1, 2",
    "token_bucket": """WITH RECURSIVE o AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
b AS (SELECT user_id, k, t, 1.0::DOUBLE AS tokens, 1 AS accepted FROM o WHERE k = 1
  UNION ALL SELECT o.user_id, o.k, o.t, least(2.0, b.tokens + (o.t - b.t) / 86400) - CASE WHEN least(2.0, b.tokens + (o.t - b.t) / 86400) >= 1 THEN 1 ELSE 0 END,
    b.accepted + CASE WHEN least(2.0, b.tokens + (o.t - b.t) / 86400) >= 1 THEN 1 ELSE 0 END FROM b JOIN o ON o.user_id = b.user_id AND o.k = b.k + 1)
SELECT user_id, max(k)::BIGINT AS requests, max(accepted)::BIGINT AS accepted FROM b GROUP BY user_id""",
    "cache_hits": f"WITH {LOOKED} SELECT hit, count(*)::BIGINT AS requests FROM l GROUP BY hit",
    "cache_orphans": f"WITH {INDEX} SELECT file_path, '[unknown]' AS text FROM f WHERE file_path NOT IN (SELECT file_path FROM i)",
    "cache_index_live": f"WITH {INDEX} SELECT cache_key, file_size FROM i WHERE file_path IN (SELECT file_path FROM f)",
    "cache_lru_evict": """WITH x AS (SELECT event_id, ts, round(value * 100)::BIGINT AS size FROM events),
r AS (SELECT *, coalesce(sum(size) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS evicted_before, sum(size) OVER () AS total FROM x)
SELECT event_id, evicted_before::BIGINT AS evicted_before FROM r WHERE total - evicted_before > 0.8::DOUBLE * (total * 0.6::DOUBLE)""",
    "cache_stats": f"WITH {LOOKED} SELECT count(*)::BIGINT AS lookups, count(*) FILTER (hit)::BIGINT AS hits, count(*) FILTER (NOT hit)::BIGINT AS misses, sum(l_linenumber)::BIGINT AS bytes, round(count(*) FILTER (hit) / count(*), 6) AS hit_rate FROM l",
}
QUERIES = {k: globals()[k] for k in SQL}

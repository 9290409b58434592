"""A content-addressed result cache as tables: keys, hits, orphans, eviction, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def content_key(text: Column, voice: Column, provider: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", F.lower(F.trim(text)), voice, provider), 256), 1, 16)


def legacy_key(text: Column, voice: Column, params: Column) -> Column:
    """params: a map; its JSON has sorted keys."""
    body = F.array_join(F.transform(F.array_sort(F.map_entries(params)), lambda e: F.concat(F.lit('"'), e["key"], F.lit('": "'), e["value"], F.lit('"'))), ", ")
    return F.md5(F.concat_ws("|", text, voice, F.concat(F.lit("{"), body, F.lit("}"))))


def lookup(requests: DataFrame, index: DataFrame, files: DataFrame, key: str = "cache_key", path: str = "file_path") -> DataFrame:
    """Adds hit: the key is in the index and its file exists."""
    live = index.join(files.select(path), path, "left_semi").select(key, path).dropDuplicates([key])
    return requests.join(live, key, "left").withColumn("hit", F.col(path).isNotNull())


def orphans(files: DataFrame, index: DataFrame, path: str = "file_path") -> DataFrame:
    """Files that the index does not list, as rows of unknown text."""
    return files.join(index.select(path), path, "left_anti").withColumn("text", F.lit("[unknown]"))


def live_entries(index: DataFrame, files: DataFrame, path: str = "file_path") -> DataFrame:
    return index.join(files.select(path), path, "left_semi")


def to_evict(entries: DataFrame, cap: float, headroom: float = 0.8, size: str = "file_size", accessed: str = "last_accessed", id: str = "cache_key", step: str = "day") -> DataFrame:
    """The entries to remove, least recently used first, until the total is at most headroom x cap; none while it is within cap.

    The running total over all entries is taken in two steps, by period and within it, so no task holds them all."""
    held = entries.withColumn("_period", F.date_trunc(step, accessed))
    periods = held.groupBy("_period").agg(F.sum(size).alias("_bytes"))
    before = Window.orderBy("_period").rowsBetween(Window.unboundedPreceding, -1)
    periods = periods.select("_period", F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_before"), F.sum("_bytes").over(Window.partitionBy(F.lit(1))).alias("_total"))
    held = held.join(periods, "_period")
    within = Window.partitionBy("_period").orderBy(accessed, id).rowsBetween(Window.unboundedPreceding, -1)
    gone = F.col("_before") + F.coalesce(F.sum(size).over(within), F.lit(0))
    kept = held.withColumn("evicted_before", gone)
    return kept.where((F.col("_total") > cap) & (F.col("_total") - F.col("evicted_before") > headroom * cap)).drop("_period", "_before", "_total")


#: Folders of a stored index. A key's folder never changes, so this is fixed for an index's life.
BUCKETS = 64


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The live entries of a stored index."""
    return spark.read.parquet(path).where("evicted_at IS NULL").drop("bucket", "evicted_at")


def _replace(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Rewrites the folders that rows have entries for, and no others."""
    writer = rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("bucket").parquet(path)


def _there(spark: SparkSession, path: str) -> bool:
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    return held.getFileSystem(spark._jsc.hadoopConfiguration()).exists(held)


def upsert(entries: DataFrame, path: str, *, key: str = "cache_key", newest: str = "created", buckets: int = BUCKETS) -> None:
    """Puts entries into the index stored at path: new keys are added, known ones replaced, whatever they held.

    The index is Parquet in folders by a hash of the key; only folders that some entry belongs to are read and written
    again, and each is swapped in when its files are complete. Of several entries with one key the newest counts (by all
    columns where that ties), so the same entries put in again change nothing. Entries without a key are left out; an
    evicted key that comes again is live again. No entries leave the index as it is, but for a new one, which is then empty.
    """
    spark = entries.sparkSession
    rest = [c for c in entries.columns if c not in (key, newest)]
    order = [F.desc_nulls_last(newest), *[F.col(c).asc_nulls_first() for c in rest]]
    one = Window.partitionBy(key).orderBy(*order)
    rows = entries.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n")
    rows = rows.withColumns({"evicted_at": F.lit(None).cast("timestamp"), "bucket": _bucket(F.col(key), buckets)})
    if _there(spark, path):
        touched = [r[0] for r in rows.select("bucket").distinct().collect()]  # of so many folders at most
        if not touched:
            return
        kept = spark.read.schema(rows.schema).parquet(path).where(F.col("bucket").isin(touched)).join(rows.select(key), key, "left_anti")
        rows = rows.unionByName(kept.select(rows.columns))
    _replace(spark, path, rows)


def evict(spark: SparkSession, path: str, cap: float, *, headroom: float = 0.8, key: str = "cache_key", size: str = "file_size", accessed: str = "last_accessed", now: str | None = None) -> int:
    """Marks the least recently used live entries as evicted until the rest is at most headroom x cap; gives their number.

    Marked entries stay in their folder without counting, so a folder is never left without rows, which a rewrite of
    single folders could not express; run again, it finds nothing more to do."""
    held = spark.read.parquet(path)
    gone = to_evict(held.where("evicted_at IS NULL"), cap, headroom, size, accessed, key).select(key, F.lit(True).alias("_gone"))
    touched = held.join(gone.select(key), key, "left_semi").groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a folder
    if not touched:
        return 0
    at = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    marked = held.where(F.col("bucket").isin([r["bucket"] for r in touched])).join(gone, key, "left")
    marked = marked.withColumn("evicted_at", F.when(F.col("evicted_at").isNull() & F.col("_gone"), at).otherwise(F.col("evicted_at"))).select(held.columns)
    _replace(spark, path, marked)
    return sum(r["n"] for r in touched)


def totals(lookups: DataFrame, size: str = "file_size") -> DataFrame:
    """entries, bytes, hits, misses and hit_rate (0 without lookups)."""
    hits, n = F.count_if("hit"), F.count(F.lit(1))
    return lookups.agg(
        n.alias("lookups"), hits.alias("hits"), (n - hits).alias("misses"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.coalesce(F.try_divide(hits, n), F.lit(0.0)).alias("hit_rate")
    )

"""Summaries of a dataset: totals, distributions, histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x: Column) -> Column:
    """x, null where infinite or not a number, so that means stay finite."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def moments(value: Column | str, name: str) -> list[Column]:
    """Count, sum, mean, population deviation (0 for one value), least and greatest."""
    x = _column(value)
    return [
        F.count(x).alias(f"{name}_count"),
        F.sum(x).alias(f"{name}_sum"),
        F.avg(x).alias(f"{name}_mean"),
        F.stddev_pop(x).alias(f"{name}_std"),
        F.min(x).alias(f"{name}_min"),
        F.max(x).alias(f"{name}_max"),
    ]


def validity_counts(is_valid: Column | str) -> list[Column]:
    valid = _column(is_valid)
    return [F.count(F.lit(1)).alias("total"), F.count_if(valid).alias("valid"), F.count_if(~valid).alias("invalid")]


def histogram(df: DataFrame, value: Column | str, edges: Sequence[float]) -> DataFrame:
    """(bucket, label, count): [low, high), the last one closed; values outside are dropped, empty buckets count 0. No rows in, no rows out."""
    x, last = _column(value), len(edges) - 2
    inside = [(x >= lo) & ((x <= hi) if i == last else (x < hi)) for i, (lo, hi) in enumerate(zip(edges, edges[1:]))]
    counts = df.agg(F.count(x).alias("n"), *[F.count_if(c).alias(f"b{i}") for i, c in enumerate(inside)])
    rows = F.array(*[F.struct(F.lit(i).alias("bucket"), F.lit(f"{lo}-{hi}").alias("label"), F.col(f"b{i}").alias("count")) for i, (lo, hi) in enumerate(zip(edges, edges[1:]))])
    return counts.where("n > 0").select(F.inline(rows))


def equal_width_histogram(df: DataFrame, value: Column | str, bins: int, empty: bool = False) -> DataFrame:
    """(bucket, low, high, count) of at most so many equal buckets between the least and greatest value; with ``empty`` also
    those that hold nothing. Nulls and values that are no finite numbers have no part; without others there is no bucket, and
    where all are equal there is one."""
    held = df.select(_column(value).cast("double").alias("x")).where("x is not null and not isnan(x) and abs(x) < double('infinity')")
    bounds = held.agg(F.min("x").alias("least"), F.max("x").alias("greatest"))
    width = (F.col("greatest") - F.col("least")) / bins
    bucket = F.when(width > 0, F.least(F.floor((F.col("x") - F.col("least")) / width), F.lit(bins - 1))).otherwise(0)
    counted = held.join(F.broadcast(bounds)).groupBy(bucket.cast("int").alias("bucket"), "least", width.alias("width")).count()  # bounds is one row
    if empty:
        last = F.when(width > 0, bins - 1).otherwise(0)
        all_ = bounds.where("least is not null").select(F.explode(F.sequence(F.lit(0), last)).alias("bucket"), "least", width.alias("width"))
        counted = all_.join(counted.select("bucket", "count"), "bucket", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    return counted.select("bucket", (F.col("least") + F.col("bucket") * F.col("width")).alias("low"), (F.col("least") + (F.col("bucket") + 1) * F.col("width")).alias("high"), "count")


def points(df: DataFrame, id: str, x: str, y: str) -> DataFrame:
    """(id, x, y) of the rows that have both figures, as finite numbers: the dots of a chart. None where a column is missing."""
    if not {id, x, y} <= set(df.columns):
        return df.sparkSession.createDataFrame([], "id string, x double, y double")
    both = df.select(F.col(id).cast("string").alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    return both.where(finite(F.col("x")).isNotNull() & finite(F.col("y")).isNotNull())


def top(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first rows in an order, which should end in what makes it total."""
    return df.orderBy(*order).limit(n)


def distribution(df: DataFrame, *keys: str) -> DataFrame:
    """Counts by key, and the share of all in percent to one decimal. Only the counts meet in one place."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
    all_ = counts.agg(F.sum("count").alias("all"))
    return counts.join(F.broadcast(all_)).select(*keys, "count", F.round(100 * F.col("count") / F.col("all"), 1).alias("percent"))  # all_ is one row


def distribution_maps(df: DataFrame, *keys: str) -> DataFrame:
    """One row: for each key a map from its values to their counts; for keys of few values."""
    out = None
    for k in keys:
        pairs = df.groupBy(F.col(k).alias("k")).count().where("k is not null")
        one = pairs.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "count")))).alias(k))
        out = one if out is None else out.join(F.broadcast(one))  # one row each
    return out


def split_counts(df: DataFrame, *keys: str) -> DataFrame:
    """Counts by all keys, with totals over each, in one pass."""
    return df.rollup(*keys).agg(F.count(F.lit(1)).alias("count"))


def confusion(df: DataFrame, label: Column | str, predicted: Column | str, *by: str) -> DataFrame:
    """tp, fp, fn, tn, accuracy, precision, recall, f1; ratios are 0 where their base is."""
    real, said = _column(label), _column(predicted)
    counts = df.groupBy(*by).agg(
        F.count_if(real & said).alias("tp"), F.count_if(~real & said).alias("fp"), F.count_if(real & ~said).alias("fn"), F.count_if(~real & ~said).alias("tn")
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns(
        {"accuracy": ratio(tp + tn, tp + tn + fp + fn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)}
    )


def best_frame_scores(frames: DataFrame, *keys: str, score: str = "score") -> DataFrame:
    """The greatest frame score of each sample, at least 0."""
    return frames.groupBy(*keys).agg(F.greatest(F.lit(0.0), F.max(score)).alias("score"))


def compare_models(metrics: DataFrame, first: str, second: str) -> DataFrame:
    """One row from the metrics of two models: the gains of the second and the winner by F1."""
    of = lambda c, m: F.max(F.when(F.col("model") == m, F.col(c)))
    gain = lambda c: (of(c, second) - of(c, first)).alias(f"{c}_gain")
    held = metrics.agg(gain("accuracy"), gain("f1"))
    return held.withColumn("winner", F.when(F.col("f1_gain") > 0, second).when(F.col("f1_gain") < 0, first).otherwise("tie"))

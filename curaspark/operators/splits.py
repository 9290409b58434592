"""Splits, samples and allocations that come out the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_key(id: Column | str, seed: int = 42) -> Column:
    """A pseudo-random order of rows that depends on their id and a seed alone."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), (F.col(id) if isinstance(id, str) else id).cast("string")))


def ranks(df: DataFrame, id: str, by: list[str], seed: int) -> DataFrame:
    """Adds __rank (0 up) and __size within each group, in the pseudo-random order.

    Rows are dealt into cells by the leading digits of their order key, so that no group is one task: a row's rank is
    the summed size of the cells before its own plus its place within the cell."""
    held = df.withColumns({"__order": order_key(id, seed)}).withColumn("__cell", F.substring("__order", 1, 3))
    cells = held.groupBy(*by, "__cell").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*by).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumns({"__before": F.coalesce(F.sum("__n").over(before), F.lit(0)), "__size": F.sum("__n").over(Window.partitionBy(*by))})
    held = held.join(cells.drop("__n"), [*by, "__cell"])
    place = F.row_number().over(Window.partitionBy(*by, "__cell").orderBy("__order", id)) - 1
    return held.withColumn("__rank", (F.col("__before") + place).cast("long")).drop("__order", "__cell", "__before")


def shuffle_split(df: DataFrame, id: str, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1), by: list[str] | None = None, seed: int = 42) -> DataFrame:
    """Adds split: train gets the floor of its share of each group, then val of its own, test the rest."""
    keys = by or []
    held = ranks(df.withColumn("__all", F.lit(1)), id, keys or ["__all"], seed)
    train, val = F.floor(F.col("__size") * ratios[0]), F.floor(F.col("__size") * ratios[1])
    split = F.when(F.col("__rank") < train, "train").when(F.col("__rank") < train + val, "val").otherwise("test")
    return held.withColumn("split", split).drop("__rank", "__size", "__all")


def stratified_split(df: DataFrame, id: str, label: str, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: int = 42) -> DataFrame:
    """Adds split: of each label first the test share, rounded up, then val as its part of the rest, rounded up."""
    held = ranks(df, id, [label], seed)
    test = F.ceil(F.round(F.col("__size") * ratios[2], 9))
    val = F.ceil(F.round((F.col("__size") - test) * (ratios[1] / (ratios[0] + ratios[1])), 9))
    split = F.when(F.col("__rank") < test, "test").when(F.col("__rank") < test + val, "val").otherwise("train")
    return held.withColumn("split", split).drop("__rank", "__size")


def allocate(weights: DataFrame, total: int, weight: str = "weight", least: int = 0) -> DataFrame:
    """Adds allocated: the floor of the total's share, at least so many; what rounding leaves is not dealt out."""
    return weights.withColumn("allocated", F.greatest(F.floor(F.lit(total) * F.col(weight)), F.lit(least)).cast("long"))


def equal_weights(df: DataFrame) -> DataFrame:
    n = df.agg(F.count(F.lit(1)).alias("__n"))
    return df.join(F.broadcast(n)).withColumn("weight", 1.0 / F.col("__n")).drop("__n")  # n is one row


def uniform(id: Column | str, purpose: str, seed: int = 42, low: float = 0.0, high: float = 1.0) -> Column:
    """A number in [low, high) that depends on id, purpose and seed alone, so that a retried task draws it again."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(purpose), F.col(id) if isinstance(id, str) else id), 11)
    return low + bits / float(2**53) * (high - low)


def chance(id: Column | str, purpose: str, probability: float, seed: int = 42) -> Column:
    return uniform(id, purpose, seed) < probability


def grid(low: float, high: float, n: int) -> Column:
    """n evenly spaced values from low to high."""
    if n == 1:
        return F.array(F.lit(float(low)))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: low + (high - low) * i / (n - 1))


def cartesian(df: DataFrame, axes: dict[str, Column]) -> DataFrame:
    """Every combination of array axes, the last one fastest, with its ordinal. Axes are short by nature: parameter lists."""
    size, ordinal, out = F.lit(1), F.lit(0).cast("long"), df
    for name, values in axes.items():
        out = out.select("*", F.posexplode(values).alias(f"_{name}", name))
        ordinal = ordinal * F.size(values) + F.col(f"_{name}")
        size = size * F.size(values)
    return out.withColumns({"ordinal": ordinal, "combinations": size.cast("long")}).drop(*[f"_{a}" for a in axes])


def positions(df: DataFrame, order: str, name: str) -> DataFrame:
    """Adds the place of each row, 0 up, in the order of a column: ranges are sorted side by side, then counted."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = df.select(F.percentile_approx(order, [i / parts for i in range(1, parts)], 10_000)).first()[0] if parts > 1 else None
    cell = F.size(F.filter(F.array(*map(F.lit, bounds or [])).cast(f"array<{df.schema[order].dataType.simpleString()}>"), lambda b: b < F.col(order)))
    held = df.withColumn("__cell", cell)
    counts = held.groupBy("__cell").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    held = held.join(F.broadcast(counts.select("__cell", before.alias("__before"))), "__cell")
    place = F.row_number().over(Window.partitionBy("__cell").orderBy(order)) - 1
    return held.withColumn(name, F.col("__before") + place).drop("__cell", "__before")

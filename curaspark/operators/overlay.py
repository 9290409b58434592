"""Sounds from a table of events laid over clips: a range join by sample number.

Sounds are cut at bins of ``BIN`` samples and summed by (clip, bin) with the sums of all tasks' own rows first, so clips
with very many events are no task of their own; only a clip's bins, bounded by its length, come together again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Samples of a bin; as many sums in one aggregation.
BIN = 64


def overlay_events(clips: DataFrame, events: DataFrame, *, id: str, samples: str = "samples", start: str = "start", sound: str = "sound", whole: bool = False) -> DataFrame:
    """clips with every event's sound added to its clip's samples, from sample ``start`` (0 up) on; other columns stay.

    Overlapping sounds add up. What passes a clip's end is cut off, or with ``whole`` such events are left out as a whole;
    so are events that start before 0 or past the end, of no clip, without a start or a sound, and empty ones. Null
    samples of a sound count as zero. Null and empty clips, clips without an id or events stay as they are; clips that
    share an id all get its events. Extra columns of events are not read.
    """
    lengths = clips.where(F.size(samples) > 0).select(F.col(id).alias("__id"), F.size(samples).alias("__n")).distinct()
    e = events.select(F.col(id).alias("__id"), F.col(start).cast("long").alias("__at"), F.col(sound).alias("__sound"))
    e = e.where((F.col("__at") >= 0) & (F.size("__sound") > 0)).join(lengths, "__id").where(F.col("__at") < F.col("__n"))
    if whole:
        e = e.where(F.col("__at") + F.size("__sound") <= F.col("__n"))
    last = F.least(F.col("__at") + F.size("__sound"), F.col("__n")) - 1
    bins = e.select("__id", "__n", "__at", "__sound", F.explode(F.sequence(F.floor(F.col("__at") / BIN), F.floor(last / BIN))).alias("__bin"))
    offset = F.col("__bin") * BIN - F.col("__at")
    piece = F.transform(F.sequence(F.lit(0), F.lit(BIN - 1)), lambda j: F.coalesce(F.get("__sound", (offset + j).cast("int")), F.lit(0.0)))
    sums = bins.select("__id", "__n", "__bin", piece.alias("__piece")).groupBy("__id", "__n", "__bin").agg(F.array(*[F.sum(F.get("__piece", F.lit(j))) for j in range(BIN)]).alias("__sums"))
    held = sums.groupBy("__id", "__n").agg(F.sort_array(F.collect_list(F.struct("__bin", "__sums"))).alias("__bins"))
    before = lambda i: F.when(i > 0, F.get("__bins", i - 1)["__bin"]).otherwise(F.lit(-1))
    gap = lambda b, i: F.array_repeat(F.lit(0.0), ((b["__bin"] - before(i) - 1) * BIN).cast("int"))
    dense = F.flatten(F.transform("__bins", lambda b, i: F.concat(gap(b, i), b["__sums"])))
    laid = clips.join(held.select("__id", "__n", dense.alias("__laid")), (F.col(id) == F.col("__id")) & (F.size(samples) == F.col("__n")), "left")
    added = F.zip_with(samples, F.slice("__laid", 1, F.greatest(F.size(samples), F.lit(0))), lambda x, y: x + F.coalesce(y, F.lit(0.0)))
    return laid.withColumn(samples, F.when(F.col("__laid").isNotNull() & (F.size(samples) > 0), added).otherwise(F.col(samples))).drop("__id", "__n", "__laid")

"""Training layouts: a dataset of samples written as splits, manifests and metadata.

Every export takes samples (sample_id, path, label 0/1, transcript, split) and writes below one folder with Spark's
writers, so that any number of tasks write at once; only counts come back to the driver, for the metadata."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curaspark.operators.summary import split_counts


def labelled_union(positive: DataFrame, negative: DataFrame, word: str) -> DataFrame:
    """Both sources with label 1 or 0 and the word or "unknown" as transcript."""
    tagged = lambda df, label, transcript: df.withColumns({"label": F.lit(label), "transcript": F.lit(transcript)})
    return tagged(positive, 1, word).unionByName(tagged(negative, 0, "unknown"))


def class_name(label: Column | str = "label") -> Column:
    return F.when((F.col(label) if isinstance(label, str) else label) == 1, "positive").otherwise("negative")


def numbered(df: DataFrame, id: str, by: str, digits: int = 5) -> DataFrame:
    """Adds number (0 up in each group by id) and export_name. Ids are dealt by ranges first, so no group is one task."""
    held = df.repartitionByRange(F.col(by), F.col(id)).withColumn("_part", F.spark_partition_id())
    parts = held.groupBy(by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(by, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    held = held.join(parts, [by, "_part"])
    place = F.row_number().over(Window.partitionBy(by, "_part").orderBy(id)) - 1
    number = (F.col("_before") + place).cast("long")
    name = F.concat(class_name(by), F.format_string(f"_%0{digits}d.wav", number))
    return held.withColumns({"number": number, "export_name": name}).drop("_part", "_before")


def metadata(samples: DataFrame) -> DataFrame:
    """Counts by split and label with their totals."""
    return split_counts(samples, "split", "label")


def summary_row(samples: DataFrame, name: str, word: str, durations_ms: str | None = None) -> DataFrame:
    """One row about the dataset, as ``sources.files.dataset_metadata`` reads it: counts by label and split, and where a column
    of durations is given their mean and spread (of the population)."""
    n = lambda c: F.count_if(c)
    figures = [
        F.count(F.lit(1)).alias("total_samples"), n(F.col("label") == 1).alias("positive_samples"), n(F.col("label") == 0).alias("negative_samples"),
        *[n(F.col("split") == split).alias(f"{split}_samples") for split in ("train", "val", "test")],
    ]
    if durations_ms:
        figures += [F.coalesce(F.avg(durations_ms), F.lit(0.0)).alias("average_duration_ms"), F.coalesce(F.stddev_pop(durations_ms), F.lit(0.0)).alias("duration_std_ms")]
    return samples.agg(*figures).select(F.lit(name).alias("name"), F.lit(word).alias("wake_word"), "*")


def _write(df: DataFrame, folder: str, kind: str, *by: str) -> None:
    writer = df.write.mode("overwrite")
    writer = writer.partitionBy(*by) if by else writer
    writer.option("header", True).format(kind).save(folder)


def _metadata(samples: DataFrame, folder: str, **settings: str) -> None:
    rows = metadata(samples).withColumns({k: F.lit(v) for k, v in settings.items()})
    _write(rows.coalesce(1), f"{folder}/metadata", "json")  # a row a split and label


def precise(samples: DataFrame, folder: str, word: str) -> None:
    held = samples.withColumn("class_dir", F.when(F.col("label") == 1, "wake-word").otherwise("not-wake-word"))
    _write(held, f"{folder}/samples", "parquet", "class_dir", "split")
    _metadata(samples, folder, format="precise", wake_word=word)


def picovoice(samples: DataFrame, folder: str, word: str) -> None:
    """Files renumbered; negatives go to train."""
    held = numbered(samples, "sample_id", "label").withColumn("split", F.when(F.col("label") == 0, "train").otherwise(F.col("split")))
    manifest = held.select(F.col("export_name").alias("audio_filepath"), F.col("transcript").alias("text"), "label", "split")
    _write(manifest, f"{folder}/manifest", "csv")
    _metadata(held, folder, format="picovoice", wake_word=word)


def tensorflow(samples: DataFrame, folder: str, word: str) -> None:
    _write(samples.withColumn("label_name", class_name()), f"{folder}/data", "parquet", "split", "label_name")
    _metadata(samples, folder, format="tensorflow", wake_word=word)


def pytorch(samples: DataFrame, folder: str, word: str) -> None:
    labels = samples.select(F.substring_index("path", "/", -1).alias("filename"), "label", class_name().alias("label_name"), "split")
    _write(labels, f"{folder}/labels", "csv", "split")
    _metadata(samples, folder, format="pytorch", wake_word=word)


def huggingface(samples: DataFrame, folder: str, word: str) -> None:
    split = F.when(F.col("split") == "val", "validation").otherwise(F.col("split"))
    rows = samples.select(F.substring_index("path", "/", -1).alias("file_name"), "label", class_name().alias("label_name"), "transcript", split.alias("split"))
    _write(rows, f"{folder}/data", "json", "split")
    _metadata(samples, folder, format="huggingface", wake_word=word)


def openwakeword(samples: DataFrame, folder: str, word: str) -> None:
    rows = samples.select("path", "label", F.when(F.col("label") == 1, F.lit(word)).otherwise("unknown").alias("transcript"))
    _write(rows, f"{folder}/manifest", "json")


def manifests(samples: DataFrame, folder: str, word: str) -> None:
    _write(samples, f"{folder}/manifest", "json", "split")


FORMATS: dict[str, Callable[[DataFrame, str, str], None]] = {
    "precise": precise,
    "picovoice": picovoice,
    "tensorflow": tensorflow,
    "pytorch": pytorch,
    "huggingface": huggingface,
    "openwakeword": openwakeword,
    "manifest": manifests,
}


def export(samples: DataFrame, format: str, folder: str, word: str) -> None:
    if format not in FORMATS:
        raise ValueError(f"unknown format {format!r}; valid: {sorted(FORMATS)}")
    FORMATS[format](samples, folder, word)

"""Sources: audio files, text lines, manifests, job specifications, presets."""

from __future__ import annotations

import io
import os
import re
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AUDIO = "*.{wav,mp3,ogg,flac}"


def audio_files(spark: SparkSession, folder: str, pattern: str = AUDIO, recursive: bool = False) -> DataFrame:
    """(path, modificationTime, length, content); content is read only where a query uses it."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(folder)


def audio_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, relative_path, size) of audio files at any depth, whatever the case of their suffix."""
    files = audio_files(spark, folder, "*", recursive=True).select("path", "length")
    audio = files.where(F.lower("path").rlike(r"\.(wav|mp3|ogg|flac)$"))
    root = re.sub(r"^file:/*", "/", folder.rstrip("/")) + "/"
    relative = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + re.escape(root), "")
    return audio.select("path", F.substring_index("path", "/", -1).alias("name"), relative.alias("relative_path"), F.col("length").alias("size"))


def audio_scan(spark: SparkSession, *folders: str) -> DataFrame:
    """(path, length, modificationTime) of the audio files in the folders and at any depth below them, each once, by path.

    Folders may lie within each other or be named twice. Case of the suffix is no matter. A folder that is not there fails."""
    held = None
    for folder in folders:
        for deep in (False, True):
            found = audio_files(spark, folder, "*", deep).select("path", "length", "modificationTime").where(F.lower("path").rlike(r"\.(wav|mp3|ogg|flac)$"))
            held = found if held is None else held.unionByName(found)
    if held is None:
        raise ValueError("no folder to scan")
    return held.groupBy("path").agg(F.max("length").alias("length"), F.max("modificationTime").alias("modificationTime")).orderBy("path")


#: What a dataset says of itself.
METADATA = (
    "name string, wake_word string, version string, created_at string, total_samples long, positive_samples long, negative_samples long, train_samples long, "
    "val_samples long, test_samples long, sample_rate int, channels int, bit_depth int, format string, providers_used array<string>, voices_used array<string>, "
    "augmentations_applied array<string>, average_duration_ms double, duration_std_ms double, average_snr_db double, description string, license string, "
    "author string, tags array<string>"
)


def dataset_metadata(spark: SparkSession, path: str) -> DataFrame:
    """The rows of metadata files (JSON objects, one a file or one a line), with what they leave out filled in: version 1.0.0,
    16 kHz, one channel, 16 bits, wav, licence MIT, zeros for counts and durations, empty lists and texts, no noise ratio.
    A row without name or wake word, or one that is no object of such fields, has the error as its error column."""
    held = spark.read.schema(METADATA + ", _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    known = {"version": "1.0.0", "sample_rate": 16_000, "channels": 1, "bit_depth": 16, "format": "wav", "license": "MIT", "description": "", "author": "", "created_at": None, "average_snr_db": None}
    columns = []
    for field in held.schema.fields[:-1]:
        kind, name = field.dataType.simpleString(), field.name
        if kind.startswith("array"):
            filled = F.coalesce(name, F.array().cast(kind))
        elif name in ("name", "wake_word"):
            filled = F.col(name)
        else:
            filled = F.coalesce(name, F.lit(known.get(name, 0)).cast(kind))
        columns.append(filled.alias(name))
    missing = F.when(F.col("_corrupt").isNotNull(), "no metadata").when(F.col("name").isNull() | F.col("wake_word").isNull(), "no name or wake word")
    return held.select(*columns, missing.alias("error"))


def _decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = []
        for path, content in zip(f["path"], f["content"]):
            try:
                with wave.open(io.BytesIO(content)) as w:
                    width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
                    raw = w.readframes(w.getnframes())
                if width == 3:
                    wide = np.zeros((len(raw) // 3, 4), np.uint8)
                    wide[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
                    x = wide.reshape(-1).view("<i4") / 2.0**31
                elif width == 1:
                    x = (np.frombuffer(raw, np.uint8) - 128.0) / 128
                else:
                    x = np.frombuffer(raw, f"<i{width}") / 2.0 ** (8 * width - 1)
                rows.append((path, rate, channels, 8 * width, x.reshape(-1, channels).mean(axis=1).tolist(), None))
            except (wave.Error, EOFError, ValueError) as e:
                rows.append((path, None, None, None, None, f"{type(e).__name__}: {e}"))
        yield pd.DataFrame(rows, columns=["path", "sample_rate", "channels", "bit_depth", "samples", "error"])


def decode_wav(files: DataFrame) -> DataFrame:
    """(path, sample_rate, channels, bit_depth, samples, error): PCM mixed to one channel; an unreadable file has an error."""
    return files.select("path", "content").mapInPandas(_decode, "path string, sample_rate int, channels int, bit_depth int, samples array<double>, error string")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines; blank ones go, and those whose first character is #."""
    lines = spark.read.text(path)
    return lines.where(~F.startswith("value", F.lit("#"))).select(F.trim("value").alias("text")).where("text <> ''")


def json_manifest(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON array of rows."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def with_environment(value: object) -> object:
    """``${NAME}`` and ``${NAME:default}`` in all strings of a nested value; an error where neither is there."""
    if isinstance(value, dict):
        return {k: with_environment(v) for k, v in value.items()}
    if isinstance(value, list):
        return [with_environment(v) for v in value]
    if not isinstance(value, str):
        return value

    def one(m: re.Match) -> str:
        found = os.environ.get(m[1], m[2])
        if found is None:
            raise ValueError(f"environment variable {m[1]} is not set and has no default")
        return found

    return re.sub(r"\$\{(\w+)(?::([^}]*))?\}", one, value)


def job_specification(path: str) -> dict:
    """A YAML job: a mapping that is not empty, with its environment filled in."""
    import yaml

    with open(path, encoding="utf-8") as f:
        held = yaml.safe_load(f)
    if not held or not isinstance(held, dict):
        raise ValueError(f"{path}: a job is a mapping with entries")
    return with_environment(held)

"""Errors as one typed column: what kind they are, at which stage they came up, and what they say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of errors and what each is a kind of.
KINDS = {
    "Error": None,
    "ProviderError": "Error",
    "ConfigError": "Error",
    "AudioError": "Error",
    "GenerationError": "Error",
    "AugmentationError": "Error",
    "NoiseError": "AugmentationError",
    "RoomSimulationError": "AugmentationError",
    "MicrophoneSimulationError": "AugmentationError",
    "QualityAssuranceError": "Error",
}
TYPE = "struct<class:string,stage:string,message:string>"
#: Kinds of errors of augmentation steps whose message names them; others are errors of augmentation in general.
OF_STEPS = {"noise": "NoiseError", "room": "RoomSimulationError", "microphone": "MicrophoneSimulationError"}


def error(message: Column, kind: str | Column, stage: str) -> Column:
    """The error that a message tells of; null for a null or empty message."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    held = F.struct(kind.alias("class"), F.lit(stage).alias("stage"), message.alias("message"))
    return F.when(message.isNotNull() & (message != ""), held)


def of_augmentation(message: Column) -> Column:
    """The error of an augmentation: signals that could not be worked on, or the step that left nothing."""
    kind = F.when(~message.startswith("nothing usable after"), "AudioError")
    for step, name in OF_STEPS.items():
        kind = kind.when(message == f"nothing usable after {step}", name)
    return error(message, kind.otherwise("AugmentationError"), "augment")


def first(*errors: Column) -> Column:
    """The error of the earliest stage that has one."""
    return F.coalesce(*errors)


def lineage(kind: str) -> list[str]:
    """The kind and all that it is a kind of."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind of error: {kind}; valid: {', '.join(KINDS)}")
    return [kind] + (lineage(KINDS[kind]) if KINDS[kind] else [])


def counts(df: DataFrame, column: str = "error") -> DataFrame:
    """(class, stage, own, total): errors of the very kind, and with those of the kinds below it, by stage. Unknown kinds
    count as themselves; rows without an error count nowhere."""
    above = F.create_map(*[x for kind in KINDS for x in (F.lit(kind), F.array(*map(F.lit, lineage(kind))))])
    e = df.where(F.col(column).isNotNull()).select(F.col(f"{column}.class").alias("kind"), F.col(f"{column}.stage").alias("stage"))
    each = e.select("kind", "stage", F.explode(F.coalesce(F.try_element_at(above, F.col("kind")), F.array("kind"))).alias("class"))
    return each.groupBy("class", "stage").agg(F.count_if(F.col("kind").eqNullSafe(F.col("class"))).alias("own"), F.count(F.lit(1)).alias("total"))

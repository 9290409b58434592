"""Providers of signals: what they need, whether that is there, and the catalog of their voices as tables."""

from __future__ import annotations

import importlib.util
import os
from dataclasses import dataclass, field

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Provider:
    name: str
    kind: str
    modules: tuple[str, ...] = ()
    keys: tuple[str, ...] = ()
    voices: tuple[tuple[str, str, str, str], ...] = field(default=())  # id, name, gender, language


class Registry:
    def __init__(self):
        self._held: dict[str, Provider] = {}

    def register(self, provider: Provider) -> None:
        self._held[provider.name.lower()] = provider

    def get(self, name: str) -> Provider:
        if name.lower() not in self._held:
            raise ValueError(f"unknown provider {name!r}; valid: {sorted(self._held)}")
        return self._held[name.lower()]

    def names(self) -> list[str]:
        return sorted(self._held)

    def availability(self, spark: SparkSession) -> DataFrame:
        """(provider, kind, missing_modules, missing_keys, available), a row for each provider."""
        rows = []
        for p in self._held.values():
            modules = [m for m in p.modules if importlib.util.find_spec(m) is None]
            keys = [k for k in p.keys if not os.environ.get(k)]
            rows.append((p.name, p.kind, modules, keys, not modules and not keys))
        return spark.createDataFrame(rows, "provider string, kind string, missing_modules array<string>, missing_keys array<string>, available boolean")

    def voices(self, spark: SparkSession) -> DataFrame:
        rows = [(*v, p.name) for p in self._held.values() for v in p.voices]
        return spark.createDataFrame(rows, "id string, name string, gender string, language string, provider string")


def filter_voices(voices: DataFrame, language: str | list[str] | None = None, gender: str | None = None, names: list[str] | None = None) -> DataFrame:
    """Languages that hold any of the codes asked for, gender, id or name; whatever the case of the first two."""
    held = voices
    if language:
        codes = [language] if isinstance(language, str) else language
        held = held.where(reduce(or_, [F.contains(F.lower("language"), F.lit(c.lower())) for c in codes]))
    if gender:
        held = held.where(F.lower("gender") == gender.lower())
    return held.where(F.col("id").isin(names) | F.col("name").isin(names)) if names else held


def preferred(rows: DataFrame, by: str, prefers: Column, order: list[Column], pick: list[str]) -> DataFrame:
    """Of each group one row: the first in order among those that are preferred, or the first of all where none is.

    Sums alone find it, so no group is sorted; nulls in the order come first, a null preference is none."""
    rank = F.struct((~F.coalesce(prefers, F.lit(False))).alias("_later"), *[c.alias(f"_{i}") for i, c in enumerate(order)])
    held = rows.groupBy(by).agg(F.min_by(F.struct(*pick), rank).alias("_best"))
    return held.select(by, *[F.col(f"_best.{c}").alias(c) for c in pick])

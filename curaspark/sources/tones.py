"""A registered source of deterministic signals, which stands in for synthesis: ``spark.read.format("tones")``.

Options: count, rate, seconds, partitions. Each row depends on its number alone, so retried tasks give it again."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "sample_id bigint, sample_rate int, frequency double, samples array<double>"


class Tones(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tones"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TonesReader(self.options)


class TonesReader(DataSourceReader):
    def __init__(self, options):
        self.count, self.rate = int(options.get("count", 10)), int(options.get("rate", 8_000))
        self.seconds, self.parts = float(options.get("seconds", 0.1)), int(options.get("partitions", 4))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(self.parts)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        t = np.arange(int(self.rate * self.seconds)) / self.rate
        for i in range(partition.value, self.count, self.parts):
            frequency = 110.0 * 2 ** (i % 36 / 12)
            yield i, self.rate, frequency, (0.5 * np.sin(2 * np.pi * frequency * t)).tolist()


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Tones)

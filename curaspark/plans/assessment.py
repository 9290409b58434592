"""A dataset assessed from signals to a report: features, checks, scores, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curaspark.operators import summary, validation


def assess(signals: DataFrame, checks: validation.ValidationConfig, scores: validation.ScoreConfig = validation.ScoreConfig(), window: int | None = None) -> DataFrame:
    """signals(…, sample_rate, samples) with features, is_valid, error and scores."""
    return validation.score(validation.validate(signals, checks), scores, window=window)


def statistics(assessed: DataFrame, *by: str) -> DataFrame:
    """Counts, durations, and means and deviations of finite values over valid rows."""
    valid = F.col("is_valid")
    only = lambda c: F.when(valid, summary.finite(F.col(c)))
    aggs = summary.validity_counts(valid)
    for c in ("duration", "peak", "rms", "zcr", "snr_db"):
        aggs += summary.moments(only(c), c)
    return assessed.groupBy(*by).agg(*aggs)


def report_rows(assessed: DataFrame, id: str, n: int = 50) -> DataFrame:
    """The report's table of the first samples by id: rounded figures and a mark for validity."""
    figures = {"duration": 2, "snr_db": 1, "overall_score": 3}
    rounded = [F.round(c, d).alias(c) for c, d in figures.items()]
    return assessed.orderBy(id).limit(n).select(id, *rounded, F.when(F.col("is_valid"), "✓").otherwise("✗").alias("valid"))


def report_html(statistics_row: dict, distributions: dict[str, list[tuple[str, int]]], title: str = "Dataset report") -> str:
    """A page of small tables; its figures are already counted."""
    table = lambda name, rows: f"<h2>{name}</h2><table>" + "".join(f"<tr><td>{k}</td><td>{v}</td></tr>" for k, v in rows) + "</table>"
    body = table("Totals", statistics_row.items()) + "".join(table(k, v) for k, v in distributions.items())
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{title}</title></head><body><h1>{title}</h1>{body}</body></html>"

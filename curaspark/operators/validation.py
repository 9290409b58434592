"""Checks and scores of signals, one row per sample."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curaspark.functions import signal as S
from curaspark.functions import spectrum


@dataclass(frozen=True)
class ValidationConfig:
    min_duration: float = 0.5
    max_duration: float = 10.0
    sample_rate: int = 24_000
    max_peak: float = 0.99
    min_rms: float = 0.001
    min_snr_db: float = 15.0
    snr_window: int = 1024


def signal_features(df: DataFrame, rate: Column | int, window: int = 1024, signal: str = "samples") -> DataFrame:
    a = F.col(signal)
    return df.withColumns(
        {"duration": S.duration(a, rate), "peak": S.peak(a), "rms": S.rms(a), "zcr": S.zero_crossing_rate(a), "snr_db": S.snr_db(a, window)}
    )


def validate(df: DataFrame, config: ValidationConfig = ValidationConfig(), signal: str = "samples", rate: Column | None = None) -> DataFrame:
    """Adds the features, is_valid and error. Missing, empty, short, long or misrated signals stop there and have null features; peak, RMS and SNR violations are told together."""
    c, a = config, F.col(signal)
    rate = F.col("sample_rate") if rate is None else rate
    seconds = S.duration(a, rate)
    early = (
        F.when(a.isNull(), F.lit("signal is missing"))
        .when(F.size(a) == 0, F.lit("signal is empty"))
        .when(seconds < c.min_duration, F.format_string(f"duration %.2fs is below minimum {c.min_duration}s", seconds))
        .when(seconds > c.max_duration, F.format_string(f"duration %.2fs exceeds maximum {c.max_duration}s", seconds))
        .when(rate != c.sample_rate, F.format_string(f"sample rate %dHz is not the required {c.sample_rate}Hz", rate))
    )
    held = df.withColumn("early", early)
    only = lambda x: F.when(F.col("early").isNull(), x)
    held = held.withColumns(
        {
            "duration": seconds,
            "peak": only(S.peak(a)),
            "rms": only(S.rms(a)),
            "zcr": only(S.zero_crossing_rate(a)),
            "snr_db": only(S.snr_db(a, c.snr_window)),
        }
    )
    late = F.array_compact(
        F.array(
            F.when(F.col("peak") > c.max_peak, F.format_string(f"peak amplitude %.3f > {c.max_peak}", "peak")),
            F.when(F.col("rms") < c.min_rms, F.format_string(f"RMS amplitude %.6f < {c.min_rms}", "rms")),
            F.when(F.col("snr_db") < c.min_snr_db, F.format_string(f"SNR %.2fdB < {c.min_snr_db}dB", "snr_db")),
        )
    )
    error = F.coalesce(F.col("early"), F.when(F.size(late) > 0, F.array_join(late, "; ")))
    return held.withColumns({"is_valid": error.isNull(), "error": error}).drop("early")


# The weights of the score's parts.
WEIGHTS = {"clarity": 0.25, "snr": 0.2, "naturalness": 0.2, "diversity": 0.15, "technical": 0.2}


@dataclass(frozen=True)
class ScoreConfig:
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    floors: dict[str, float] = field(default_factory=dict)


def _unit(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def clarity_score(m: Column, rate: Column | int, n: Column) -> Column:
    return _unit(0.6 * (1 - F.least(S.centroid_hz(m, rate, n) / 4000, F.lit(1.0))) + 0.4 * (1 - S.flatness_score(m)))


def snr_score(snr: Column) -> Column:
    return F.coalesce(1 / (1 + F.exp(-5 * (F.least(snr / 40, F.lit(1.0)) - 0.5))), F.lit(0.0))


def naturalness_score(a: Column, window: Column | int) -> Column:
    """Steadiness of loudness and of zero crossings over windows; one half with fewer than two windows."""

    def of(w: Column) -> Column:
        calm = 0.6 / (1 + 100 * S.variance(F.transform(w, S.rms)))
        even = 0.4 / (1 + 50 * S.variance(F.transform(w, S.zero_crossing_rate)))
        return F.when(F.size(w) < 2, F.lit(0.5)).otherwise(_unit(calm + even))

    return S.let(S.windows(a, window), of)


def technical_score(error: Column, snr: Column, peak: Column, rms: Column) -> Column:
    """A half for an error; then a bonus for SNR, a penalty for a high peak, a bonus for loudness, cut to [0, 1] after each."""
    score = F.when(error.isNull() | (error == ""), F.lit(1.0)).otherwise(F.lit(0.5))
    score = F.least(F.lit(1.0), score + F.least(F.coalesce(snr, F.lit(0.0)) / 50, F.lit(0.2)))
    score = F.greatest(F.lit(0.0), score - F.greatest(F.lit(0.0), F.coalesce(peak, F.lit(0.0)) - 0.9) * 2)
    return _unit(F.least(F.lit(1.0), score + F.least(F.coalesce(rms, F.lit(0.0)) * 50, F.lit(0.1))))


def score(validated: DataFrame, config: ScoreConfig = ScoreConfig(), signal: str = "samples", rate: Column | None = None, window: Column | int | None = None) -> DataFrame:
    """Adds the five parts and overall to validated rows; all are 0 for an invalid sample."""
    rate = F.col("sample_rate") if rate is None else rate
    a, m = F.col(signal), F.col("_magnitudes")
    held = validated.withColumn("_magnitudes", spectrum.magnitudes(F.when(F.col("is_valid") & (F.size(a) > 0), a)))
    parts = {
        "clarity": clarity_score(m, rate, F.size(a)),
        "snr": snr_score(F.col("snr_db")),
        "naturalness": naturalness_score(a, F.floor(rate * 0.02).cast("int") if window is None else window),
        "diversity": _unit(S.spectral_entropy(m)),
        "technical": technical_score(F.col("error"), F.col("snr_db"), F.col("peak"), F.col("rms")),
    }
    valid = F.col("is_valid")
    floors = {k: F.greatest(x, F.lit(config.floors.get(k, 0.0))) for k, x in parts.items()}
    held = held.withColumns({f"{k}_score": F.when(valid, x).otherwise(F.lit(0.0)) for k, x in floors.items()})
    overall = sum((F.col(f"{k}_score") * w for k, w in config.weights.items()), F.lit(0.0))
    return held.withColumn("overall_score", F.when(valid, overall).otherwise(F.lit(0.0))).drop("_magnitudes")


def in_range(rules: dict[str, tuple[Column, float, float]]) -> Column:
    """The names of the parameters outside their ranges, ends included; null parameters break none."""
    return F.array_compact(F.array(*[F.when(~c.between(low, high), F.lit(name)) for name, (c, low, high) in rules.items()]))


def rate_error(rate: Column, low: int = 8_000, high: int = 48_000, multiple: int = 1) -> Column:
    """Null for a sample rate that is allowed."""
    return F.when(rate.isNull() | ~rate.between(low, high), F.format_string(f"sample rate %d is not in {low} to {high}", rate)).when(
        rate % multiple != 0, F.format_string(f"sample rate %d is no multiple of {multiple}", rate)
    )


def component_means(scored: DataFrame, parts: tuple[str, ...] = ("clarity", "snr", "naturalness", "diversity", "technical", "overall")) -> DataFrame:
    """(component, mean) of the scores of valid rows."""
    means = scored.where("is_valid").agg(*[F.avg(f"{p}_score").alias(p) for p in parts])
    return means.unpivot([], list(parts), "component", "mean")


def accepted(wer: Column, confidence: Column, most: float = 0.3, least: float = 0.7) -> Column:
    """A transcript is right: few errors and much confidence; unknown figures are not."""
    return F.coalesce((wer <= most) & (confidence >= least), F.lit(False))


def acceptance_error(wer: Column, confidence: Column, most: float = 0.3, least: float = 0.7) -> Column:
    """Why it is not; of two reasons the confidence. Null for accepted ones and where the figures are unknown."""
    low = F.when(confidence < least, F.format_string(f"low confidence: %.3f < {least:g}", confidence))
    return F.coalesce(low, F.when(wer > most, F.format_string(f"high WER: %.3f > {most:g}", wer)))


def unknown_names(rows: DataFrame, name: Column, known: DataFrame, known_name: Column) -> DataFrame:
    """(name) of names that are not among the known ones, each once, whatever the case; no name is not unknown."""
    asked = rows.select(F.upper(name).alias("name")).where("name is not null").distinct()
    return asked.join(known.select(F.upper(known_name).alias("name")), "name", "left_anti")

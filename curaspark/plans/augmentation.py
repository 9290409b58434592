"""Augmentation profiles: ordered steps over a column of signals, with an error for each row that cannot be worked on."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curaspark.functions import damage, degrade, microphone, resampling, scene, vocoder
from curaspark.functions import signal as S
from curaspark.operators.presets import MICROPHONES, PHONES

#: Steps that need the signal alone: names and what each does under its parameters.
STEPS: dict[str, Callable[..., Column]] = {
    "compress": S.compress,
    "expand": S.expand,
    "limit": S.limit,
    "codec": S.codec,
    "quantise": S.quantise,
    "distort": S.distort,
    "distance": S.distance_gain,
    "echo": S.echo,
    "reverb": S.reverb,
    "ramps": S.ramps,
    "scale": S.scaled_to_peak,
    "time_stretch": vocoder.time_stretch,
    "pitch_shift": vocoder.pitch_shift,
    "tempo": vocoder.change_tempo,
    "speed": resampling.change_speed,
    "time_effects": vocoder.time_effects,
}
#: Rate that clips are brought to before the first step.
RATE = 24_000
TRACE = "array<struct<step:string,samples:array<double>>>"


Part = Callable[[Column], Column]


def _phone(key: Column, rate: int, seed: int, name: str, **options) -> list[Part]:
    low, high = damage.preset({p[0]: p[1:3] for p in PHONES}, name, "telephone")
    return degrade.telephone(key, low, high, rate, seed=seed, **options)


def _microphone(key: Column, rate: int, seed: int, name: str) -> list[Part]:
    distortion, floor_db = damage.preset({m[0]: m[1:3] for m in MICROPHONES}, name, "microphone")
    return [lambda a: microphone.microphone(a, key, name, distortion, floor_db, rate, seed)]


def _dynamics(key: Column, rate: int, seed: int, name: str) -> list[Part]:
    kind, options = damage.preset(damage.DYNAMICS, name, "dynamics")
    return [lambda a: damage.dynamics(a, rate, kind, **options)]


def _losses(key: Column, rate: int, seed: int, name: str) -> list[Part]:
    kind, options = damage.preset(damage.LOSSES, name, "degradation")
    return [lambda a: damage.degrade(a, key, rate, kind, seed, **options)]


def _voice(key: Column, rate: int, seed: int, name: str) -> list[Part]:
    effects = damage.preset(damage.VOICES, name, "voice")
    return [lambda a: vocoder.time_effects(a, **effects)]


#: Steps that also need the rate, or a row's key and the seed for what they draw; each a list of parts, which follow each
#: other in projections of their own.
PLACED: dict[str, Callable[..., list[Part]]] = {
    "noise": lambda key, rate, seed, **o: [lambda a: scene.with_noise(a, key, rate, seed=seed, **o)],
    "room": lambda key, rate, seed, name, wet=0.6: [lambda a: scene.in_room(a, name, rate, wet)],
    "microphone": _microphone,
    "dynamics": lambda key, rate, seed, **o: [lambda a: damage.dynamics(a, rate, **o)],
    "dynamics_preset": _dynamics,
    "degradation": lambda key, rate, seed, **o: [lambda a: damage.degrade(a, key, rate, seed=seed, **o)],
    "degradation_preset": _losses,
    "far": lambda key, rate, seed, metres, **o: degrade.distance_chain(metres, rate, **o),
    "telephone": _phone,
    "voice_preset": _voice,
}


def _finite(a: Column) -> Column:
    """All samples are numbers; a signal without samples is none."""
    return F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _usable(a: Column) -> Column:
    """As _finite for what a step made, without a lambda function: Spark would not find Python functions again whose
    arguments hold one. Not a number counts as more than infinity."""
    return (F.array_max(a) < float("inf")) & (F.array_min(a) > float("-inf"))


def _prepared(df: DataFrame, signal: str, rate: str, to_rate: int) -> DataFrame:
    a, r = F.col(signal), F.col(rate)
    error = (
        F.when(a.isNull() | (F.size(a) == 0), "no samples")
        .when(~_finite(a), "samples that are no numbers")
        .when(r.isNull() | (r <= 0), "no sample rate")
    )
    held = df.withColumn("augment_error", error)
    return held.withColumn("augmented", resampling.to_rate(F.when(F.col("augment_error").isNull(), S.as_signal(a)), r, to_rate))


def _parts(steps: list[tuple[str, dict]], key: Column | None, rate: int, seed: int) -> list[tuple[str, Part]]:
    """(name of the step, what it does) in order; steps of several parts have their name at each."""
    parts: list[tuple[str, Part]] = []
    for name, options in steps:
        own = [lambda a, f=STEPS[name], o=options: f(a, **o)] if name in STEPS else PLACED[name](key, rate, seed, **options)
        parts += [(name, part) for part in own]
    return parts


def _applied(held: DataFrame, done: Column, told: Column) -> DataFrame:
    """held with done as what it is augmented to; what was usable and is so no longer gets the error.

    Exploding an array of one keeps the projections apart: joined to one expression, arguments of Python functions would
    hold lambda functions, which Spark cannot plan."""
    held = held.select("*", F.explode(F.array(done)).alias("__done"), told.alias("__told"))
    failed = F.when(F.col("augmented").isNotNull() & ~F.coalesce(_usable(F.col("__done")), F.lit(False)), F.col("__told"))
    return held.withColumns({"augment_error": F.coalesce("augment_error", failed), "augmented": F.when(failed.isNull(), F.col("__done"))}).drop("__done", "__told")


def _checked(profiles: list[list[tuple[str, dict]]], key: str | None) -> None:
    names = [name for steps in profiles for name, _ in steps]
    if unknown := [n for n in names if n not in STEPS and n not in PLACED]:
        raise ValueError(f"unknown steps: {', '.join(unknown)}")
    if key is None and (keyed := [n for n in names if n in PLACED]):
        raise ValueError(f"these steps draw by a key column: {', '.join(keyed)}")


def augment(df: DataFrame, steps: list[tuple[str, dict]], *, signal="samples", rate="sample_rate", to_rate: int = RATE, key: str | None = None, seed: int = 42, trace: bool = False) -> DataFrame:
    """Adds augmented and augment_error. Clips are resampled to ``to_rate``, then the steps apply in their order.

    Defined results: null or empty signals, samples that are null, infinite or no numbers, and rates that are null or not
    positive give a null result and an error; so does a step that leaves nothing or samples that are not finite (a silent
    clip under noise), which the error names. Other rows are not touched by them; no steps give the resampled clip.
    Unknown steps and presets are errors of the profile and raise ValueError before anything runs. What steps draw
    depends on the seed and the ``key`` column, which they need; a null key gives an error. With ``trace`` a column
    augment_steps has what each step made, array<struct<step, samples>>, up to the one that failed.
    """
    _checked([steps], key)
    held = _prepared(df, signal, rate, to_rate)
    held = held.withColumn("augment_steps", F.array().cast(TRACE)) if trace else held
    for name, part in _parts(steps, None if key is None else F.col(key), to_rate, seed):  # a projection each, so that none is computed twice
        held = _applied(held, F.when(F.col("augmented").isNotNull(), part(F.col("augmented"))), F.lit(f"nothing usable after {name}"))
        if trace:
            made = F.when(F.col("augmented").isNotNull(), F.array(F.struct(F.lit(name).alias("step"), F.col("augmented").alias("samples")))).otherwise(F.array().cast(TRACE))
            held = held.withColumn("augment_steps", F.concat("augment_steps", made))
    return held


def augment_profiles(df: DataFrame, profiles: dict[str, list[tuple[str, dict]]], *, signal="samples", rate="sample_rate", to_rate: int = RATE, key: str | None = None, seed: int = 42) -> DataFrame:
    """Every row under every profile, with the profile's name. The table is read and resampled once: a row for each
    profile is made of the resampled one, and each step works on its profile's rows."""
    _checked(list(profiles.values()), key)
    held = _prepared(df, signal, rate, to_rate).withColumn("profile", F.explode(F.array(*map(F.lit, profiles)) if profiles else F.array().cast("array<string>")))
    parts = {name: _parts(steps, None if key is None else F.col(key), to_rate, seed) for name, steps in profiles.items()}
    for k in range(max(map(len, parts.values()), default=0)):  # the kth parts of all profiles side by side
        done, told = F.col("augmented"), F.lit(None).cast("string")
        for name, own in parts.items():
            if len(own) > k:
                ours = F.col("profile") == name
                done = F.when(ours, own[k][1](F.when(ours & F.col("augmented").isNotNull(), F.col("augmented")))).otherwise(done)
                told = F.when(ours, f"nothing usable after {own[k][0]}").otherwise(told)
        held = _applied(held, done, told)
    return held


def configuration(spark: SparkSession, profiles: dict[str, list[tuple[str, dict]]]) -> DataFrame:
    """(profile, place, step, options): what the profiles do, a row a step."""
    rows = [(name, i, step, json.dumps(options, sort_keys=True)) for name, steps in profiles.items() for i, (step, options) in enumerate(steps)]
    return spark.createDataFrame(rows, "profile string, place int, step string, options string")


def paired(left: DataFrame, left_order: str, right: DataFrame, right_order: str) -> DataFrame:
    """Rows side by side by their positions in two orders; ValueError where the lengths differ. Column names must differ."""
    n, m = left.count(), right.count()
    if n != m:
        raise ValueError(f"{n} rows on the left, {m} on the right")
    from curaspark.operators.splits import positions

    return positions(left, left_order, "__left").join(positions(right, right_order, "__right"), F.col("__left") == F.col("__right")).drop("__left", "__right")

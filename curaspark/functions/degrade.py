"""Losses of a transmission and of distance. What is random is a function of seed, row key and place."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from curaspark.functions import signal as S
from curaspark.functions import spectrum
from curaspark.operators.splits import uniform

# Milliseconds of the reverb's taps; rooms with their reverberation time.
TAPS = [23, 37, 53, 71, 97, 131, 173, 227]
DISTANCE_ROOMS = {"small": 0.3, "medium": 0.5, "large": 0.8, "outdoor": 0.1}
# An event's seconds, band and strength, each from and to.
EVENTS = {
    "dish_clink": ((0.1, 0.3), (2000, 8000), (0.3, 0.7)),
    "door_close": ((0.5, 1.2), (100, 2000), (0.5, 0.9)),
    "footstep": ((0.15, 0.35), (50, 1000), (0.2, 0.6)),
    "chair_scrape": ((0.8, 1.5), (150, 3000), (0.4, 0.8)),
    "water_running": ((1.0, 2.5), (500, 5000), (0.3, 0.7)),
}


def _draw(key: Column, purpose: str, place: Column, seed: int) -> Column:
    return uniform(F.concat_ws(":", key.cast("string"), place.cast("string")), purpose, seed)


def packet_loss(a: Column, key: Column, rate: int, loss: float = 0.02, packet_ms: float = 20.0, seed: int = 42) -> Column:
    """Lost packets are silent, faded out and in over at most 50 samples each."""
    size = max(int(packet_ms * rate / 1000), 1)
    n = F.size(a)

    def one(x: Column, i: Column) -> Column:
        packet = F.floor(i / size)
        length = F.least(F.lit(size), n - packet * size)
        fade, at = F.least(F.lit(50), F.floor(length / 2)), i - packet * size
        down = F.when(fade > 1, 1 - at / (fade - 1)).otherwise(1.0)
        up = F.when(fade > 1, (at - (length - fade)) / (fade - 1)).otherwise(0.0)
        faded = F.when(at < fade, x * down).when(at >= length - fade, x * up).otherwise(0.0)
        return F.when(_draw(key, "packet", packet, seed) < loss, faded).otherwise(x)

    return F.transform(a, one)


def jitter(a: Column, key: Column, rate: int, jitter_ms: float = 20.0, seed: int = 42) -> Column:
    """Segments of a fiftieth of a second come from a little later, where the signal reaches so far."""
    most, segment = int(jitter_ms * rate / 1000) // 4, max(rate // 50, 1)
    n = F.size(a)

    def one(x: Column, i: Column) -> Column:
        low = F.floor(i / segment).cast("int") * segment
        shift = F.floor(_draw(key, "jitter", low, seed) * (2 * most)).cast("int") - most
        moved = (shift > 0) & (low + segment + shift < n) & (low < n - segment)
        return F.when(moved, F.get(a, i + shift)).otherwise(x)

    return F.transform(a, one)


def reverberate(a: Column, rate: int, rt60: float, wet: float) -> Column:
    """The dry signal mixed with its taps, which decay with the reverberation time; scaled down where it exceeds 1."""
    delays = [int(ms * rate / 1000) for ms in TAPS]
    gains = [0.3 * math.exp(-3 * ms / (rt60 * 1000)) for ms in TAPS]
    mixed = F.zip_with(a, S.reverb(a, delays, gains), lambda x, y: x * (1 - wet) + y * wet)
    return S.let(mixed, lambda m: S.let(S.peak(m), lambda p: F.when(p > 1, F.transform(m, lambda x: x / p)).otherwise(m)))


def distance_chain(metres: float, rate: int, room: str = "medium", wet: float = 0.3) -> list[Callable[[Column], Column]]:
    """Gain, air and proximity, then the room's reverb: parts that follow each other in projections of their own."""
    d = F.lit(float(metres))
    return [
        lambda a: S.distance_gain(a, d),
        lambda a: spectrum.proximity(spectrum.air_absorption(a, d, rate), d, rate),
        lambda a: reverberate(a, rate, DISTANCE_ROOMS[room], wet),
    ]


def telephone(key: Column, low: float, high: float, rate: int, bits: int = 13, loss: float = 0.02, seed: int = 42) -> list[Callable[[Column], Column]]:
    """Band, then codec, lost packets and jitter, each a part of its own."""
    return [
        lambda a: spectrum.phone_band(a, low, high, rate),
        lambda a: S.codec(a, bits),
        lambda a: packet_loss(a, key, rate, loss, seed=seed),
        lambda a: jitter(a, key, rate, seed=seed),
    ]


EVENT_KIND = "array<struct<start:double,duration:double,type:string,strength:double>>"


def random_events(key: Column, seconds: Column | float, per_minute: float, seed: int = 42) -> Column:
    """array<struct<start, duration, type, strength>> of a clip: as many as the density says, at least half a second apart, none past the end."""
    seconds = seconds if isinstance(seconds, Column) else F.lit(float(seconds))
    names = F.array(*[F.lit(n) for n in EVENTS])
    bounds = F.array(*[F.struct(F.lit(float(d[0])).alias("d0"), F.lit(float(d[1])).alias("d1"), F.lit(float(s[0])).alias("s0"), F.lit(float(s[1])).alias("s1")) for d, _, s in EVENTS.values()])
    n = F.floor(per_minute * seconds / 60).cast("int")
    begin = F.struct(F.lit(0.0).alias("now"), F.array().cast(EVENT_KIND).alias("events"))
    between = lambda low, high, what, k: low + _draw(key, what, k, seed) * (high - low)

    def step(s: Column, k: Column) -> Column:
        which = F.floor(_draw(key, "type", k, seed) * len(EVENTS)).cast("int")

        def placed(b: Column) -> Column:
            duration = between(b["d0"], b["d1"], "duration", k)
            start = F.greatest(s["now"] + 0.5, between(s["now"], seconds - duration, "start", k))
            event = F.struct(start.alias("start"), duration.alias("duration"), F.get(names, which).alias("type"), between(b["s0"], b["s1"], "strength", k).alias("strength"))
            return F.struct((start + duration).alias("now"), F.concat(s["events"], F.array(event)).alias("events"))

        return S.let(F.get(bounds, which), placed)

    each = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    held = F.aggregate(each, begin, step)["events"]
    return F.filter(held, lambda e: e["start"] + e["duration"] <= seconds)

"""Features and transforms of signals, arrays of doubles, as Catalyst expressions.

A null signal gives null. An empty one gives null means and spectra, and an empty array where an array is made.
Expressions suit short arrays; for long ones see ``curaspark.functions.spectrum``, whose results are the same.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from curaspark.functions.stacked import stacked

EPSILON = 1e-10


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def as_signal(a: Column) -> Column:
    return a.cast("array<double>")


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return F.try_divide(total(a), F.size(a))


def variance(a: Column) -> Column:
    """Of the population."""
    return let(mean(a), lambda m: mean(F.transform(a, lambda x: (x - m) * (x - m))))


def duration(a: Column, rate: Column | int) -> Column:
    return F.size(a) / rate


def peak(a: Column) -> Column:
    return F.array_max(F.transform(a, F.abs))


def energy(a: Column) -> Column:
    return mean(F.transform(a, lambda x: x * x))


def rms(a: Column) -> Column:
    return F.sqrt(energy(a))


def zero_crossing_rate(a: Column) -> Column:
    """Half the summed steps of the sign, per sample; a touch of zero counts half."""
    n = F.size(a)
    step = F.zip_with(F.slice(a, 1, F.greatest(n - 1, F.lit(0))), F.slice(a, 2, F.greatest(n - 1, F.lit(0))), lambda x, y: F.abs(F.signum(y) - F.signum(x)))
    return F.try_divide(total(step), 2 * n)


def windows(a: Column, size: Column | int) -> Column:
    """The full windows of a size, side by side; what is left at the end is no window."""
    n = F.floor(F.size(a) / size).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.slice(a, i * size + 1, size))


def snr_db(a: Column, window: int = 1024) -> Column:
    """Mean power over the least power of a window, in dB; infinite where a window is silent, minus infinite without a window."""
    floor = F.array_min(F.transform(windows(a, window), energy))

    def ratio(noise: Column) -> Column:
        decibels = 10 * F.log10(energy(a) / noise)
        return F.when(noise.isNull(), F.lit(float("-inf"))).when(noise == 0, F.lit(float("inf"))).otherwise(decibels)

    return F.when(a.isNotNull(), let(floor, ratio))


def magnitudes(a: Column) -> Column:
    """Absolute values of the real Fourier transform, bins 0 to n/2."""
    n = F.size(a)

    def bin_of(k: Column) -> Column:
        angle = lambda i: F.pmod(k * i, n) * (2 * 3.141592653589793) / n
        part = lambda f: total(F.transform(a, lambda x, i: x * f(angle(i))))
        return F.hypot(part(F.cos), part(F.sin))

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor(n / 2).cast("int")), bin_of))


def centroid(m: Column) -> Column:
    """In bins."""
    return F.try_divide(total(F.transform(m, lambda x, k: x * k)), total(m))


def centroid_hz(m: Column, rate: Column | int, n: Column) -> Column:
    return centroid(m) * rate / n


def flatness(m: Column) -> Column:
    """Geometric over arithmetic mean, a small number added to every magnitude."""
    raised = F.transform(m, lambda x: x + EPSILON)
    return F.exp(mean(F.transform(raised, F.ln))) / mean(raised)


def flatness_score(m: Column) -> Column:
    """As flatness, but the mean below takes the magnitudes as they are, plus the small number."""
    return F.exp(mean(F.transform(m, lambda x: F.ln(x + EPSILON)))) / (mean(m) + EPSILON)


def rolloff(m: Column, share: float = 0.85) -> Column:
    """Number of bins before the summed magnitudes reach the share."""

    def count(limit: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"))
        add = lambda s, x: F.struct((s["sum"] + x).alias("sum"), (s["n"] + F.when(s["sum"] + x < limit, 1).otherwise(0)).alias("n"))
        return F.aggregate(m, start, add)["n"]

    return let(total(m) * share, count)


def spectral_entropy(m: Column) -> Column:
    """Of the magnitudes as shares, over its greatest value."""
    raised = F.transform(m, lambda x: x + EPSILON)
    bits = lambda all_: -total(F.transform(raised, lambda x: (x / all_) * F.log2(x / all_)))
    return let(total(raised), bits) / F.log2(F.size(m))


def moment(a: Column, k: int) -> Column:
    """Standardised; 0 where the signal does not vary."""

    def of(m: Column) -> Column:
        spread = F.sqrt(mean(F.transform(a, lambda x: (x - m) * (x - m))))
        return let(spread, lambda s: F.when(s == 0, F.lit(0.0)).otherwise(mean(F.transform(a, lambda x: F.pow((x - m) / s, k)))))

    return let(mean(a), of)


def skewness(a: Column) -> Column:
    return moment(a, 3)


def excess_kurtosis(a: Column) -> Column:
    return F.when(variance(a) == 0, F.lit(0.0)).otherwise(moment(a, 4) - 3)


def cosine(a: Column, b: Column) -> Column:
    norms = F.sqrt(total(F.transform(a, lambda x: x * x))) * F.sqrt(total(F.transform(b, lambda x: x * x)))
    return F.try_divide(total(F.zip_with(a, b, lambda x, y: x * y)), norms)


def min_max(a: Column) -> Column:
    bounds = F.struct(F.array_min(a).alias("low"), F.array_max(a).alias("high"))
    return let(bounds, lambda b: F.transform(a, lambda x: (x - b["low"]) / (b["high"] - b["low"] + EPSILON)))


def embedding(a: Column, size: int = 64) -> Column:
    """Ten features, zeros up to the size, scaled to between 0 and 1."""
    features = let(
        magnitudes(a),
        lambda m: F.array(centroid(m), rolloff(m).cast("double"), flatness(m), rms(a), zero_crossing_rate(a), peak(a), mean(a), F.sqrt(variance(a)), skewness(a), excess_kurtosis(a)),
    )
    return let(F.concat(features, F.array_repeat(F.lit(0.0), size - 10)), min_max)


def hash_similarity(a: Column, b: Column) -> Column:
    """Share of equal bits of two hexadecimal strings of 256 bits."""
    word = lambda h, i: F.conv(F.substring(h, i * 8 + 1, 8), 16, 10).cast("long")
    unequal = F.bit_count(word(a, 0).bitwiseXOR(word(b, 0)))
    for i in range(1, 8):
        unequal = unequal + F.bit_count(word(a, i).bitwiseXOR(word(b, i)))
    return (256 - unequal) / 256


# Transforms.


def scaled_to_peak(a: Column, to: float = 0.95) -> Column:
    return let(peak(a), lambda p: F.when(p > 0, F.transform(a, lambda x: x * to / p)).otherwise(a))


def mix_at_snr(a: Column, noise: Column, snr: Column | float) -> Column:
    """Signal and noise, cut to the shorter, the noise at so many dB below; scaled to a peak of 0.95. Null where either is silent."""
    n = F.least(F.size(a), F.size(noise))

    def mixed(s: Column, z: Column) -> Column:
        gain = F.sqrt(energy(s) / (energy(z) * F.pow(F.lit(10.0), F.lit(snr) / 10 if not isinstance(snr, Column) else snr / 10)))
        sums = let(gain, lambda g: F.zip_with(s, z, lambda x, y: x + g * y))
        return F.when((energy(s) > 0) & (energy(z) > 0), let(sums, lambda y: scaled_to_peak(y)))

    return let(F.slice(a, 1, n), lambda s: let(F.slice(noise, 1, n), lambda z: mixed(s, z)))


def quantise(a: Column, bits: int) -> Column:
    """Rounded, half to even, to so many bits."""
    top = float(2 ** (bits - 1) - 1)
    return F.transform(a, lambda x: F.least(F.greatest(F.rint(x * top), F.lit(-top)), F.lit(top)) / top)


def codec(a: Column, bits: int) -> Column:
    """Rounded to steps of 2^(bits-1) and cut to between -1 and 1."""
    steps = float(2 ** (bits - 1))
    return F.transform(a, lambda x: F.least(F.greatest(F.rint(x * steps) / steps, F.lit(-1.0)), F.lit(1.0)))


def distort(a: Column, amount: float) -> Column:
    """Soft clipping mixed in by the root of the amount."""
    wet = amount**0.5
    return F.transform(a, lambda x: x * (1 - wet) + F.tanh(x * (1 + 2 * amount)) * (0.8 - 0.6 * amount) * wet)


def distance_gain(a: Column, metres: Column | float) -> Column:
    d = metres if isinstance(metres, Column) else F.lit(float(metres))
    gain = F.least(F.greatest(F.pow(0.3 / F.greatest(d, F.lit(0.3)), 1.5), F.lit(0.01)), F.lit(1.0))
    return F.transform(a, lambda x: x * gain)


def delayed(a: Column, by: int) -> Column:
    return F.slice(F.concat(F.array_repeat(F.lit(0.0), by), a), 1, F.size(a))


def echo(a: Column, delay: int, level: float) -> Column:
    """The signal plus itself some samples later; scaled down where it exceeds 1."""
    sums = F.zip_with(a, delayed(a, delay), lambda x, y: x + y * level)
    return let(sums, lambda s: let(peak(s), lambda p: F.when(p > 1, F.transform(s, lambda x: x / p)).otherwise(s)))


def reverb(a: Column, delays: list[int], gains: list[float]) -> Column:
    out = a
    for d, g in zip(delays, gains, strict=True):
        out = F.zip_with(out, delayed(a, d), _plus(g))
    return out


def _plus(gain: float) -> Callable[[Column, Column], Column]:
    return lambda x, y: x + y * gain


def decibels(x: Column) -> Column:
    return 20 * F.log10(F.abs(x) + EPSILON)


def compress(a: Column, threshold: float = -20.0, ratio: float = 4.0, knee: float = 5.0, makeup: float = 0.0) -> Column:
    """Sample by sample: what lies above the threshold, soft around it, is reduced; the peak never grows."""
    low, high, up = threshold - knee / 2, threshold + knee / 2, 10 ** (makeup / 20)

    def one(x: Column) -> Column:
        level = decibels(x)
        over = F.when((level > low) & (level < high) & F.lit(knee > 0), F.lit(0.0)).otherwise(F.greatest(level - threshold, F.lit(0.0)))
        return x * F.pow(F.lit(10.0), -over * (1 - 1 / ratio) / 20) * up

    capped = lambda c, p, q: F.when((q > p) & (p > 0), F.transform(c, lambda x: x * p / q)).otherwise(c)
    return let(F.transform(a, one), lambda c: let(peak(a), lambda p: let(peak(c), lambda q: capped(c, p, q))))


def expand(a: Column, threshold: float = -40.0, ratio: float = 2.0) -> Column:
    """What lies below the threshold is made quieter."""
    return F.transform(a, lambda x: x * F.pow(F.lit(10.0), -F.greatest(threshold - decibels(x), F.lit(0.0)) * (ratio - 1) / 20))


def limit(a: Column, threshold: float = -1.0, release: int = 10) -> Column:
    """An envelope that rises at once and falls by a share of the gap per sample holds the signal under the threshold."""
    top = 10 ** (threshold / 20)
    return stacked(lambda x: limited(x, top, release), a)


def limited(x: np.ndarray, top: float, release: int) -> np.ndarray:
    """Rows of x side by side, sample after sample."""
    levels = np.abs(x)
    envelopes, envelope = np.empty_like(levels), np.zeros(len(x))
    for i in range(x.shape[1]):
        envelope = np.where(levels[:, i] > envelope, levels[:, i], envelope + (levels[:, i] - envelope) / release)
        envelopes[:, i] = envelope
    return x * np.where(envelopes > top, top / np.maximum(envelopes, top), 1.0)


def resample(a: Column, size: Column) -> Column:
    """Linear interpolation at so many points from the first sample to the last."""

    def at(i: Column) -> Column:
        place = F.when(size > 1, i * (F.size(a) - 1) / (size - 1)).otherwise(F.lit(0.0))
        low = F.floor(place).cast("int")
        high = F.least(low + 1, F.size(a) - 1)
        return F.get(a, low) + (F.get(a, high) - F.get(a, low)) * (place - low)

    return F.when(size > 0, F.transform(F.sequence(F.lit(0), size - 1), at)).otherwise(F.array().cast("array<double>"))


def fit_length(a: Column, size: int) -> Column:
    return F.slice(F.concat(a, F.array_repeat(F.lit(0.0), size)), 1, size)


def ramps(a: Column, attack: int, release: int) -> Column:
    """An event's envelope: rises over the first samples, falls over the last ones."""
    n = F.size(a)
    rise = lambda i: F.least(i / F.lit(float(max(attack, 1))), F.lit(1.0))
    fall = lambda i: F.least((n - 1 - i) / F.lit(float(max(release, 1))), F.lit(1.0))
    return F.transform(a, lambda x, i: x * rise(i) * fall(i))


def overlay(a: Column, event: Column, at: int, gain: float = 1.0) -> Column:
    """a with the event added from a sample on; what passes the end is cut off."""
    return F.transform(a, lambda x, i: x + gain * F.coalesce(F.try_element_at(event, (F.when(i >= at, i - at + 1).otherwise(F.size(event) + 1)).cast("int")), F.lit(0.0)))

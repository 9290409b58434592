"""Band-limited resampling: a polyphase filter of windowed sines, for rational rates. Rows of equal length go together.

Null signals and rates give null, empty signals stay empty; rates that are not positive give null."""

from __future__ import annotations

from fractions import Fraction
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from curaspark.functions.stacked import stacked

#: Zero crossings of the filter on each side, its share of the lower Nyquist frequency, and the window's shape (80 dB).
ZEROS, SHARE, BETA = 48, 0.92, 8.0
#: Largest denominator of a ratio of rates.
DENOMINATOR = 10_000


@lru_cache(maxsize=8)
def _bank(up: int, down: int) -> np.ndarray:
    """The filter at each of the phases between two input samples; a row a phase, each with a sum of 1."""
    cutoff = SHARE * min(1.0, up / down)
    half = int(np.ceil(ZEROS / cutoff))
    t = np.arange(-half + 1, half + 1)[None, :] - np.arange(up)[:, None] / up
    window = np.i0(BETA * np.sqrt(np.maximum(1 - (t / half) ** 2, 0))) / np.i0(BETA)
    bank = cutoff * np.sinc(cutoff * t) * window
    return bank / bank.sum(axis=1, keepdims=True)


def resampled(x: np.ndarray, ratio: Fraction) -> np.ndarray:
    """Rows of x at ratio times their rate: ceil(n * ratio) samples, the first at the place of the first."""
    up, down = ratio.numerator, ratio.denominator
    if up == down:
        return x
    bank = _bank(up, down)
    taps = bank.shape[1]
    padded = np.pad(x, ((0, 0), (taps // 2 - 1, taps // 2 + 1)))
    at = np.arange(-(-x.shape[1] * up // down)) * down
    out = np.empty((len(x), len(at)))
    step = max(1, (1 << 21) // (taps * max(len(x), 1)))
    for i in range(0, len(at), step):
        place, phase = np.divmod(at[i : i + step], up)
        windows = padded[:, place[:, None] + np.arange(taps)]
        out[:, i : i + step] = np.einsum("kmt,mt->km", windows, bank[phase])
    return out


def ratio_of(target: float, rate: float) -> Fraction:
    return Fraction(target / rate).limit_denominator(DENOMINATOR) or Fraction(1, DENOMINATOR)


def to_rate(a: Column, rate: Column, target: int) -> Column:
    """a, sampled at a row's rate, as it sounds at the target rate; nothing above the lower Nyquist frequency is left."""
    known = F.when(rate > 0, rate.cast("double"))
    moved = stacked(lambda x, r: resampled(x, ratio_of(target, r)), F.when(rate != target, a), same=[known])
    return F.when(rate == target, a).otherwise(moved)


def channels_to_rate(channels: Column, rate: Column, target: int, number: int) -> Column:
    """As to_rate, for each of so many channels of an array of channels; missing ones are null."""
    return F.when(channels.isNotNull(), F.slice(F.array(*[to_rate(F.get(channels, F.lit(i)), rate, target) for i in range(number)]), 1, F.least(F.size(channels), F.lit(number))))


def change_speed(a: Column, factor: Column | float) -> Column:
    """Plays so many times as fast, which moves the pitch too. Factors outside 0.25 to 4 give null."""
    f = factor if isinstance(factor, Column) else F.lit(float(factor))
    held = F.when(f.between(0.25, 4.0), f.cast("double"))
    return stacked(lambda x, s: resampled(x, 1 / ratio_of(s, 1.0)), a, same=[held])

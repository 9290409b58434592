"""Tempo and pitch by a phase vocoder whose spectral peaks keep the phases around them (identity phase locking).

Null signals give null, empty ones stay empty; factors outside their range give null. Rows of equal length go together."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from curaspark.functions.resampling import ratio_of, resampled, change_speed
from curaspark.functions.stacked import stacked

WINDOW = 2048


def _window(n: int) -> int:
    """A power of two, at most WINDOW, at most about half the signal."""
    return min(WINDOW, 1 << max(4, (max(n, 1) // 2).bit_length() - 1))


def _nearest_peak(size: np.ndarray) -> np.ndarray:
    """For each bin of each row the nearest bin that is no smaller than its two neighbours on either side."""
    wide = np.pad(size, ((0, 0), (2, 2)), constant_values=-1.0)
    bins = size.shape[1]
    peak = np.all([size >= wide[:, 2 + d : 2 + d + bins] for d in (-2, -1, 1, 2)], axis=0)
    at = np.arange(bins)
    left = np.maximum.accumulate(np.where(peak, at, -bins), axis=1)
    right = np.minimum.accumulate(np.where(peak, at, 2 * bins)[:, ::-1], axis=1)[:, ::-1]
    return np.clip(np.where(at - left <= right - at, left, right), 0, bins - 1)


def stretched(x: np.ndarray, rate: float) -> np.ndarray:
    """Rows of x at rate times the tempo and the same pitch: round(n / rate) samples."""
    rows, n = x.shape
    width = _window(n)
    hop, bins = width // 4, width // 2 + 1
    shape = np.hanning(width + 1)[:-1]
    padded = np.pad(x, ((0, 0), (width // 2, width // 2 + width)))
    places = np.arange(0, n + width // 2 + 1, hop)
    frames = np.fft.rfft(shape * padded[:, places[:, None] + np.arange(width)], axis=2)
    size, angle = np.abs(frames), np.angle(frames)
    steps = np.arange(0, len(places) - 1, rate)
    length = round(n / rate)
    out, weight = np.zeros((rows, max(len(steps) * hop + width, length + width))), np.zeros(max(len(steps) * hop + width, length + width))
    turn, row = 2 * np.pi * hop * np.arange(bins) / width, np.arange(rows)[:, None]
    phase = angle[:, 0]
    for k, s in enumerate(steps):
        low, part = int(s), s - int(s)
        now = (1 - part) * size[:, low] + part * size[:, low + 1]
        peak = _nearest_peak(now)
        phase = phase[row, peak] + angle[:, low] - angle[row, low, peak]
        out[:, k * hop : k * hop + width] += shape * np.fft.irfft(now * np.exp(1j * phase), width)
        weight[k * hop : k * hop + width] += shape**2
        moved = angle[:, low + 1] - angle[:, low] - turn
        phase = phase + turn + moved - 2 * np.pi * np.round(moved / (2 * np.pi))
    return (out / np.maximum(weight, 1e-2))[:, width // 2 : width // 2 + length]


def _fitted(x: np.ndarray, n: int) -> np.ndarray:
    return x[:, :n] if x.shape[1] >= n else np.pad(x, ((0, 0), (0, n - x.shape[1])))


def shifted(x: np.ndarray, steps: float, octave: float) -> np.ndarray:
    """Rows of x moved by so many steps of an octave, at their length."""
    factor = 2 ** (steps / octave)
    return _fitted(resampled(stretched(x, 1 / factor), ratio_of(1 / factor, 1.0)), x.shape[1])


def _within(value: Column | float, low: float, high: float) -> Column:
    v = value if isinstance(value, Column) else F.lit(float(value))
    return F.when(v.between(low, high), v.cast("double"))


def time_stretch(a: Column, rate: Column | float) -> Column:
    """Faster (above 1) or slower at the same pitch; from 0.25 to 4, 1 leaves the signal as it is."""
    return stacked(lambda x, r: x if r == 1 else stretched(x, r), a, same=[_within(rate, 0.25, 4.0)])


def pitch_shift(a: Column, steps: Column | float, octave: int = 12) -> Column:
    """Higher or lower at the same length; from -12 to 12 steps, of which ``octave`` make an octave."""
    return stacked(lambda x, s: x if s == 0 else shifted(x, s, octave), a, same=[_within(steps, -12.0, 12.0)])


def change_tempo(a: Column, tempo: float, keep_pitch: bool = True) -> Column:
    """Signals at 1/tempo times the stretch where the pitch is kept, else at the tempo's speed; 0.5 to 2."""
    if not 0.5 <= tempo <= 2.0:
        raise ValueError(f"tempo {tempo} is not between 0.5 and 2")
    return time_stretch(a, 1 / tempo) if keep_pitch else change_speed(a, tempo)


def time_effects(a: Column, pitch: float = 0.0, stretch: float = 1.0, speed: float = 1.0) -> Column:
    """Pitch, then tempo, then speed; neutral ones are left out."""
    a = pitch_shift(a, pitch) if pitch else a
    a = time_stretch(a, stretch) if stretch != 1 else a
    return change_speed(a, speed) if speed != 1 else a

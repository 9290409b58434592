"""What a microphone makes of a signal: its frequency response, distortion, its own noise, a peak of 0.95."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column

from curaspark.functions import noise
from curaspark.functions.stacked import stacked

# Hertz and gains in dB of each microphone.
RESPONSES = {
    "smartphone": [(50, -12.0), (100, -6.0), (200, -3.0), (500, 0.0), (1000, 1.0), (2000, 2.0), (5000, 1.0), (10000, -3.0), (15000, -8.0)],
    "lapel": [(50, -8.0), (100, -2.0), (200, 1.0), (500, 2.0), (1000, 3.0), (2000, 2.0), (5000, 0.0), (10000, -4.0), (15000, -10.0)],
    "studio": [(20, -2.0), (50, 0.0), (100, 0.5), (200, 1.0), (500, 1.5), (1000, 2.0), (2000, 1.5), (5000, 1.0), (10000, 0.5), (15000, 0.0)],
    "conference": [(50, -6.0), (100, -1.0), (200, 1.0), (500, 2.0), (1000, 3.0), (2000, 2.0), (5000, 0.0), (10000, -3.0), (15000, -8.0)],
    "headset": [(50, -10.0), (100, -3.0), (200, 1.0), (500, 3.0), (1000, 4.0), (2000, 3.0), (5000, 1.0), (10000, -4.0), (15000, -12.0)],
    "far_field": [(50, -15.0), (100, -8.0), (200, -2.0), (500, 2.0), (1000, 4.0), (2000, 3.0), (5000, 0.0), (10000, -6.0), (15000, -15.0)],
}


def spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The cubic spline through the points whose first two and last two pieces are one cubic each, held beyond the ends.

    With three points a parabola, with two a line; second derivatives come from one tridiagonal system whose ends are
    folded in."""
    n, h = len(x), np.diff(x)
    slope = np.diff(y) / h
    m = np.zeros(n)
    if n == 3:
        m[:] = 2 * (slope[1] - slope[0]) / (h[0] + h[1])
    elif n > 3:
        lower, upper, right = h[:-1].copy(), h[1:].copy(), 6 * np.diff(slope)
        middle = 2 * (h[:-1] + h[1:])
        # m[0] = m[1] + (m[1] - m[2]) * h[0] / h[1], and alike at the end.
        middle[0] += h[0] * (1 + h[0] / h[1])
        upper[0] -= h[0] * h[0] / h[1]
        middle[-1] += h[-1] * (1 + h[-1] / h[-2])
        lower[-1] -= h[-1] * h[-1] / h[-2]
        for i in range(1, n - 2):
            share = lower[i] / middle[i - 1]
            middle[i] -= share * upper[i - 1]
            right[i] -= share * right[i - 1]
        for i in range(n - 3, -1, -1):
            m[i + 1] = (right[i] - (upper[i] * m[i + 2] if i < n - 3 else 0.0)) / middle[i]
        m[0] = m[1] + (m[1] - m[2]) * h[0] / h[1]
        m[-1] = m[-2] + (m[-2] - m[-3]) * h[-1] / h[-2]
    at = np.clip(at, x[0], x[-1])
    i = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 2)
    t, w = at - x[i], h[i]
    return y[i] + (slope[i] - w * (2 * m[i] + m[i + 1]) / 6) * t + m[i] / 2 * t**2 + (m[i + 1] - m[i]) / (6 * w) * t**3


def gains(points: list[tuple[float, float]], hertz: np.ndarray) -> np.ndarray:
    """Linear gains at the given frequencies, between those of the points."""
    x, y = (np.array(v, float) for v in zip(*points))
    return spline(x, 10 ** (y / 20), hertz)


def equalise(a: Column, points: list[tuple[float, float]], rate: float) -> Column:
    """The gains of the points (hertz, dB), at least two with rising hertz, on the signal's spectrum."""

    def filtered(x: np.ndarray) -> np.ndarray:
        n = x.shape[1]
        return np.fft.irfft(np.fft.rfft(x, axis=1) * gains(points, np.fft.rfftfreq(n, 1 / rate)), n)

    return stacked(filtered, a)


def microphone(a: Column, key: Column, name: str, distortion: float, floor_db: float, rate: float, seed: int = 42) -> Column:
    """Response, distortion, own noise, peak of 0.95; a silent signal is the microphone's own noise alone."""
    if name not in RESPONSES:
        raise ValueError(f"unknown microphone: {name}; valid: {', '.join(sorted(RESPONSES))}")

    def heard(x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        n, wet = x.shape[1], max(distortion, 0.0) ** 0.5
        y = np.fft.irfft(np.fft.rfft(x, axis=1) * gains(RESPONSES[name], np.fft.rfftfreq(n, 1 / rate)), n)
        y = y * (1 - wet) + np.tanh(y * (1 + 2 * distortion)) * (0.8 - 0.6 * distortion) * wet
        y = noise.with_self_noise(y, floor_db, keys)
        top = np.abs(y).max(axis=1, keepdims=True)
        return np.where(top > 0, y * 0.95 / np.where(top > 0, top, 1), y)

    return stacked(heard, a, own=[noise.keyed(key, "self_noise", seed)])

"""Fourier transforms and what needs them, for long signals: Arrow functions over numpy, a batch of rows at a time.

Null signals give null; empty ones give empty."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from curaspark.functions.stacked import stacked


def _each(kind: str, f: Callable[..., object]) -> Callable[..., Column]:
    """A function of one row's arrays as a column function."""

    @F.pandas_udf(kind)
    def apply(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None for v in row) else f(*row) for row in zip(*columns)], dtype=object)

    return apply


def _array(x: object) -> np.ndarray:
    return np.asarray(x, float)


def magnitudes(a: Column) -> Column:
    return stacked(lambda x: np.abs(np.fft.rfft(x, axis=1)), a)


def _filtered(x: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """Rows of x with their spectra times a gain, one for all or one each."""
    return np.fft.irfft(np.fft.rfft(x, axis=1) * gain, x.shape[1])


def _hertz(x: np.ndarray, rate: float) -> np.ndarray:
    return np.fft.rfftfreq(x.shape[1], 1 / rate)


def band_pass(a: Column, low: float, high: float, rate: float) -> Column:
    """Keeps the frequencies from low to high, nothing else."""

    def kept(x: np.ndarray) -> np.ndarray:
        f = _hertz(x, rate)
        return _filtered(x, (f >= low) & (f <= high))

    return stacked(kept, a)


def phone_band(a: Column, low: float, high: float, rate: float) -> Column:
    """Soft edges of the second and fourth order."""

    def kept(x: np.ndarray) -> np.ndarray:
        f = _hertz(x, rate)
        return _filtered(x, 1 / (1 + (low / np.maximum(f, 1e-9)) ** 2) / (1 + (f / high) ** 4))

    return stacked(kept, a)


def air_absorption(a: Column, metres: Column, rate: float) -> Column:
    """A low pass that closes with distance; none under a metre."""

    def heard(x: np.ndarray, d: np.ndarray) -> np.ndarray:
        cutoff = np.where(d >= 1, 16_000 / (1 + 0.5 * (d - 1)), np.inf)
        return _filtered(x, 1 / (1 + (_hertz(x, rate) / cutoff[:, None]) ** 2))

    return stacked(heard, a, own=[metres])


def proximity(a: Column, metres: Column, rate: float) -> Column:
    """Fuller below 0.3 m, thinner beyond a metre."""

    def heard(x: np.ndarray, d: np.ndarray) -> np.ndarray:
        f = _hertz(x, rate)
        fuller, thinner = np.where(d < 0.3, 0.3, 0.0)[:, None], np.clip((d - 1) * 0.2, 0.0, 1.0)[:, None]
        return _filtered(x, 1 + fuller / (1 + (f / 200) ** 2) - thinner / (1 + (f / 150) ** 2))

    return stacked(heard, a, own=[metres])


def convolve(a: Column, kernel: Column) -> Column:
    """Cut to the signal's length."""

    def one(x: object, k: object) -> np.ndarray:
        x, k = _array(x), _array(k)
        if not len(x) or not len(k):
            return x
        n = 1 << (len(x) + len(k) - 2).bit_length()
        return np.fft.irfft(np.fft.rfft(x, n) * np.fft.rfft(k, n), n)[: len(x)]

    return _each("array<double>", one)(a, kernel)


def room_response(rate: int, size: tuple[float, float, float], source: tuple[float, float, float], mic: tuple[float, float, float], absorption: float, order: int, sound: float = 343.0) -> list[float]:
    """Impulse response of a box-shaped room by image sources, up to so many reflections."""
    beta, taps = np.sqrt(1 - absorption), {}
    steps = np.arange(-order, order + 1)
    for nx in steps:
        for ny in steps:
            for nz in steps:
                if abs(nx) + abs(ny) + abs(nz) > order:
                    continue
                image = [n * s + (p if n % 2 == 0 else s - p) for n, s, p in zip((nx, ny, nz), size, source)]
                distance = float(np.linalg.norm(np.subtract(image, mic)))
                at = round(distance / sound * rate)
                taps[at] = taps.get(at, 0.0) + beta ** (abs(nx) + abs(ny) + abs(nz)) / (4 * np.pi * max(distance, 0.1))
    out = np.zeros(max(taps) + 1)
    for at, v in taps.items():
        out[at] = v
    return out.tolist()


def coloured_noise(size: Column, key: Column, exponent: float, seed: int = 42) -> Column:
    """Noise whose power falls with frequency to the exponent (0 white, 1 pink, 2 brown), a peak of 0.1; a function of key and seed."""

    def one(n: int, k: object) -> np.ndarray:
        digest = hashlib.sha256(f"{seed}:{k}".encode()).digest()
        white = np.random.default_rng(int.from_bytes(digest[:8], "big")).standard_normal(int(n))
        f = np.fft.rfftfreq(len(white))
        f[:1] = 1
        out = np.fft.irfft(np.fft.rfft(white) * f ** (-exponent / 2), len(white)) if len(white) else white
        return out * 0.1 / max(np.abs(out).max(initial=0), 1e-12)

    return _each("array<double>", one)(size, key)


def _prints(x: np.ndarray, window: int, hop: int, bins: int, digits: int) -> np.ndarray:
    """The spectra of all full windows, each scaled to between 0 and 1 and rounded, so that hashes of them do not hang on the
    last bits; a row a window."""
    if len(x) < window:
        return np.zeros((0, bins), "<i8")
    m = np.abs(np.fft.rfft(np.lib.stride_tricks.sliding_window_view(x, window)[::hop], axis=1))[:, :bins]
    low, high = m.min(axis=1, keepdims=True), m.max(axis=1, keepdims=True)
    return np.round((m - low) / (high - low + 1e-10) * 10**digits).astype("<i8")


def fingerprints(a: Column, window: int = 1024, hop: int = 512, bins: int = 128, digits: int = 6) -> Column:
    """A hash of each full window's spectrum."""
    return _each("array<string>", lambda x: [hashlib.sha256(row.tobytes()).hexdigest() for row in _prints(_array(x), window, hop, bins, digits)])(a)


def spectrum_hash(a: Column, window: int = 1024, hop: int = 512, bins: int = 128, first: int = 10, digits: int = 6) -> Column:
    """One hash of the spectra of the first full windows; null without one."""

    def one(x: object) -> str | None:
        rows = _prints(_array(x)[: window + hop * (first - 1)], window, hop, bins, digits)
        return hashlib.sha256(rows.tobytes()).hexdigest() if len(rows) else None

    return _each("string", one)(a)

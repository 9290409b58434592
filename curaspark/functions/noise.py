"""Noise and sounds that are functions of a key alone: tasks that run again draw the same numbers.

Spectra are drawn first, as those of white noise (Rayleigh sizes, even phases), and then cut to a band or coloured, so no
filter leaves anything outside. Rows of equal length are drawn together. Null keys, sizes and kinds give null."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from curaspark.functions.degrade import EVENTS
from curaspark.functions.stacked import apply_stacked, runs

U = np.uint64
# How fast an event's sound rises (lengths of the event a unit), and where and how fast it falls.
ENVELOPES = {
    "dish_clink": (10.0, 0.7, 5.0),
    "door_close": (3.0, 0.8, 2.0),
    "footstep": (15.0, 0.5, 4.0),
    "water_running": (2.0, 0.9, 3.0),
}
OTHER_ENVELOPE = (5.0, 0.6, 3.0)
PEAK = 0.8


def uniforms(keys: np.ndarray, n: int, purpose: int) -> np.ndarray:
    """A row of n numbers between 0 and 1 for each 64-bit key."""
    z = (keys.astype(np.int64).view(U) ^ U(purpose * 0xD6E8FEB86659FD93 % 2**64))[:, None] + np.arange(1, n + 1).astype(U) * U(0x9E3779B97F4A7C15)
    z = (z ^ (z >> U(30))) * U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> U(27))) * U(0x94D049BB133111EB)
    return ((z ^ (z >> U(31))) >> U(11)).astype(float) * 2.0**-53 + 2.0**-54


def normals(keys: np.ndarray, n: int, purpose: int = 0) -> np.ndarray:
    return np.sqrt(-2 * np.log(uniforms(keys, n, 2 * purpose + 1))) * np.cos(2 * np.pi * uniforms(keys, n, 2 * purpose + 2))


def white_spectrum(keys: np.ndarray, n: int) -> np.ndarray:
    """The spectrum of n samples of white noise of unit spread."""
    bins = n // 2 + 1
    spectrum = np.sqrt(-np.log(uniforms(keys, bins, 3)) * n) * np.exp(2j * np.pi * uniforms(keys, bins, 4))
    spectrum[:, 0] = np.sqrt(2) * spectrum[:, 0].real
    if n % 2 == 0:
        spectrum[:, -1] = np.sqrt(2) * spectrum[:, -1].real
    return spectrum


def band_noise(keys: np.ndarray, n: int, low: float, high: float, rate: float) -> np.ndarray:
    """White noise from low to high hertz, and nothing else."""
    f = np.fft.rfftfreq(n, 1 / rate)
    return np.fft.irfft(white_spectrum(keys, n) * ((f >= low) & (f <= high)), n)


def envelope(kind: str, n: int) -> np.ndarray:
    """Of an event's sound, from its first sample (place 0) to its last (place 1)."""
    t = np.linspace(0, 1, n)
    if kind == "chair_scrape":
        return np.maximum(np.sin(2 * np.pi * t) * 0.3 + 0.7, 0.1)
    rise, fall_at, fall = ENVELOPES.get(kind, OTHER_ENVELOPE)
    return np.minimum(t * rise, 1) * np.where(t > fall_at, np.maximum(1 - (t - fall_at) * fall, 0), 1)


def event_sound(keys: np.ndarray, kind: str, n: int, rate: float) -> np.ndarray:
    """One sound for each key: noise in the kind's band under its envelope, with a peak of 0.8; silent where the band
    has no frequency of so short a sound or of so low a rate."""
    low, high = EVENTS[kind][1]
    sound = band_noise(keys, n, low, high, rate) * envelope(kind, n)
    top = np.abs(sound).max(axis=1, keepdims=True, initial=0)
    return np.where(top > 1e-12, sound * PEAK / np.maximum(top, 1e-12), 0.0)


def keyed(key: Column, purpose: str, seed: int) -> Column:
    """A 64-bit key of a row for one purpose; null for a null key."""
    return F.when(key.isNotNull(), F.xxhash64(F.lit(seed), F.lit(purpose), key))


def event_sounds(kind: Column, seconds: Column, key: Column, rate: int, seed: int = 42) -> Column:
    """The samples of each event; null for unknown kinds, empty for none or negative seconds."""
    size = F.when(seconds.isNotNull(), F.greatest(F.floor(seconds * rate), F.lit(0))).cast("int")
    known = F.when(kind.isin(*EVENTS), kind)

    def drawn(sizes: pa.Array, kinds: pa.Array, keys: pa.Array) -> pa.Array:
        # The lists hold nothing: they carry each event's length, by which rows are stacked.
        counts = np.concatenate([[0], np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int32)
        blank = pa.ListArray.from_arrays(pa.array(counts), pa.array(np.zeros(counts[-1]), pa.float64()), mask=sizes.is_null())
        return apply_stacked(lambda x, k, of: event_sound(of, k, x.shape[1], rate), blank, [kinds], [keys])

    @F.arrow_udf("array<double>")
    def draw(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        # A batch of few bytes makes sounds of very many; they are handed back in runs.
        for batch in batches:
            for run in runs(batch[0].fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)):
                yield drawn(*(x.slice(run.start, run.stop - run.start) for x in batch))

    return draw(size, known, keyed(key, "sound", seed))


def with_self_noise(x: np.ndarray, floor_db: float, keys: np.ndarray) -> np.ndarray:
    """Rows of x with a microphone's own noise: normal, its spread a tenth of the signal's root mean square at so many dB;
    a silent signal counts as one of 1."""
    level = np.sqrt(np.mean(x**2, axis=1, keepdims=True))
    return x + normals(keys, x.shape[1]) * np.where(level > 0, level, 1.0) * 10 ** (floor_db / 20) * 0.1

"""Losses of quality: dropouts, an imitation of a lossy codec, random mixtures, and the presets that choose among them.

What is random depends on seed, row key and place alone. Null signals and keys give null; empty signals stay empty."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column

from curaspark.functions import noise
from curaspark.functions import signal as S
from curaspark.functions.stacked import stacked

# Bit rates of the codec; presets of losses, of dynamics and of time effects.
BITRATES = [32, 48, 64, 96, 128, 192, 256, 320]
LOSSES = {
    "telephone": ("bandwidth", {"low": 300.0, "high": 3400.0}),
    "old_recording": ("random", {"severity": 0.7}),
    "voip_call": ("mp3", {"bitrate": 48}),
    "low_quality_mic": ("bit_depth", {"bits": 12}),
    "broken_transmission": ("transmission", {"probability": 0.05, "duration_ms": 20.0}),
}
DYNAMICS = {
    "voice_compression": ("compression", {"threshold": -24.0, "ratio": 3.0, "knee": 3.0, "makeup": 6.0}),
    "aggressive_limiting": ("limiting", {"threshold": -1.0, "release_ms": 20.0}),
    "noise_reduction": ("expansion", {"threshold": -40.0, "ratio": 3.0}),
    "dynamic_boost": ("compression", {"threshold": -30.0, "ratio": 2.0, "knee": 2.0, "makeup": 3.0}),
}
VOICES = {
    "male_to_female": {"pitch": 4.0, "stretch": 0.95, "speed": 1.0},
    "female_to_male": {"pitch": -5.0, "stretch": 1.05, "speed": 1.0},
    "child_voice": {"pitch": 8.0, "stretch": 0.85, "speed": 1.1},
    "slow_speech": {"pitch": 0.0, "stretch": 1.3, "speed": 0.9},
    "fast_speech": {"pitch": 0.0, "stretch": 0.7, "speed": 1.1},
    "robot_voice": {"pitch": -2.0, "stretch": 1.0, "speed": 1.0},
}


def preset(known: dict, name: str, what: str):
    if name not in known:
        raise ValueError(f"unknown {what}: {name}; valid: {', '.join(known)}")
    return known[name]


def silenced(x: np.ndarray, hits: np.ndarray, run: int) -> np.ndarray:
    """Rows of x with a run of silence from each hit on that lies in no earlier run."""
    edges = np.zeros((len(x), x.shape[1] + 1), np.int32)
    for row in range(len(x)):
        places, i = np.flatnonzero(hits[row]), 0
        while i < len(places):
            start = places[i]
            edges[row, start] += 1
            edges[row, min(start + run, x.shape[1])] -= 1
            i = np.searchsorted(places, start + run)
    return np.where(np.cumsum(edges, axis=1)[:, :-1] > 0, 0.0, x)


def dropouts(a: Column, key: Column, rate: float, probability: float = 0.01, duration_ms: float = 5.0, seed: int = 42) -> Column:
    """At each sample outside a run of silence such a run begins by chance; probabilities up to 0.1."""
    run = int(duration_ms * rate / 1000)
    if not 0 <= probability <= 0.1 or duration_ms <= 0:
        raise ValueError("dropouts need a probability from 0 to 0.1 and a positive duration")
    hit = lambda x, keys: silenced(x, noise.uniforms(keys, x.shape[1], 11) < probability, max(run, 1))
    return stacked(hit, a, own=[noise.keyed(key, "dropouts", seed)])


def _band(x: np.ndarray, low: float, high: float, rate: float) -> np.ndarray:
    f = np.fft.rfftfreq(x.shape[1], 1 / rate)
    return np.fft.irfft(np.fft.rfft(x, axis=1) * ((f >= low) & (f <= high)), x.shape[1])


def band_limit(a: Column, low: float, high: float, rate: float) -> Column:
    return stacked(lambda x: _band(x, low, high, rate), a)


def _coded(x: np.ndarray, keys: np.ndarray, bitrate: int, rate: float) -> np.ndarray:
    high = 12_000.0 if bitrate <= 64 else 16_000.0 if bitrate <= 128 else 18_000.0
    return _band(x + 0.01 * 10.0 ** (bitrate / 8 - 40) * noise.normals(keys, x.shape[1], 6), 50.0, high, rate)


def lossy_codec(a: Column, key: Column, rate: float, bitrate: int = 64, seed: int = 42) -> Column:
    """Noise that grows with the bit rate, and the band that its class keeps."""
    if bitrate not in BITRATES:
        raise ValueError(f"unknown bit rate: {bitrate}; valid: {', '.join(map(str, BITRATES))}")
    return stacked(lambda x, keys: _coded(x, keys, bitrate, rate), a, own=[noise.keyed(key, "codec", seed)])


def random_losses(a: Column, key: Column, rate: float, severity: float = 0.5, seed: int = 42) -> Column:
    """Each of four losses by chance: fewer bits, a band, dropouts, a codec at the highest known rate not above its own."""
    if not 0.1 <= severity <= 1:
        raise ValueError(f"severity {severity} is not between 0.1 and 1")
    top = float(2 ** (max(8, 16 - int(severity * 8)) - 1) - 1)
    bitrate = max(b for b in BITRATES if b <= max(32, 320 - int(severity * 288)))
    losses = [
        (0.8, lambda x, keys: np.clip(np.rint(x * top), -top, top) / top),
        (0.7, lambda x, keys: _band(x, 100 + severity * 400, 8000 - severity * 3000, rate)),
        (0.5, lambda x, keys: silenced(x, noise.uniforms(keys, x.shape[1], 11) < severity * 0.01, max(int(5 * rate / 1000), 1))),
        (0.6, lambda x, keys: _coded(x, keys, bitrate, rate)),
    ]

    def lost(x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        x, gates = x.copy(), noise.uniforms(keys, len(losses), 12)
        for i, (share, loss) in enumerate(losses):
            if (own := gates[:, i] < severity * share).any():
                x[own] = loss(x[own], keys[own])
        return x

    return stacked(lost, a, own=[noise.keyed(key, "losses", seed)])


def degrade(a: Column, key: Column, rate: float, kind: str, seed: int = 42, **options) -> Column:
    """One kind of loss under its options."""
    kinds = {
        "bit_depth": lambda bits=8: S.quantise(a, bits),
        "bandwidth": lambda low=300.0, high=3400.0: band_limit(a, low, high, rate),
        "transmission": lambda **o: dropouts(a, key, rate, seed=seed, **o),
        "mp3": lambda **o: lossy_codec(a, key, rate, seed=seed, **o),
        "random": lambda **o: random_losses(a, key, rate, seed=seed, **o),
    }
    return preset(kinds, kind, "degradation")(**options)


def dynamics(a: Column, rate: float, kind: str, **options) -> Column:
    """Compression, limiting or expansion under its options; a limiter's release is given in milliseconds."""
    limit = lambda threshold=-3.0, release_ms=50.0: S.limit(a, threshold, max(int(release_ms * rate / 1000), 1))
    kinds = {"compression": lambda **o: S.compress(a, **o), "limiting": limit, "expansion": lambda **o: S.expand(a, **o)}
    return preset(kinds, kind, "dynamics")(**options)

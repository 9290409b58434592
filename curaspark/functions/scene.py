"""Background noise with events in it, and rooms, for clips of any length; functions of seed and key alone."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from curaspark.functions import degrade, noise, spectrum
from curaspark.functions.damage import preset
from curaspark.functions.stacked import AT_ONCE, _lists, stacked
from curaspark.operators.presets import ROOMS
from curaspark.operators.splits import uniform

# Powers by which a kind's noise falls with frequency; where microphone and source stand in each room.
COLOURS = {"white": None, "pink": 1.0, "brown": 2.0, "blue": 0.5}
PLACES = {
    "small_room": ((1.5, 1.25, 1.2), (0.5, 0.5, 1.0)),
    "medium_room": ((2.5, 2.0, 1.4), (1.0, 1.0, 1.0)),
    "large_room": ((4.0, 3.0, 1.5), (2.0, 2.0, 1.0)),
    "bathroom": ((1.25, 1.0, 1.2), (0.5, 0.5, 1.0)),
    "living_room": ((3.0, 2.25, 1.3), (1.0, 1.0, 1.0)),
    "office": ((5.0, 4.0, 1.4), (2.0, 2.0, 1.0)),
}


def coloured(keys: np.ndarray, n: int, kind: str) -> np.ndarray:
    """A row of noise for each key: a peak of 0.1, white noise a spread of 0.1 instead."""
    power = COLOURS[kind]
    if power is None:
        return 0.1 * np.fft.irfft(noise.white_spectrum(keys, n), n) if n > 1 else 0.1 * noise.normals(keys, n)
    f = np.fft.rfftfreq(n)
    f[0] = 1
    out = np.fft.irfft(noise.white_spectrum(keys, n) * f ** (-power / 2), n)
    return out * 0.1 / np.maximum(np.abs(out).max(axis=1, keepdims=True, initial=0), 1e-12)


def drawn_events(own: int, seconds: float, per_minute: float) -> list[tuple[str, float, float]]:
    """(kind, start, duration) of a clip's events: as many as the density says, at least half a second apart."""
    n, now, out, kinds = int(per_minute * seconds / 60), 0.0, [], list(degrade.EVENTS)
    for kind, length, place in noise.uniforms(np.array([own]), 3 * n, 21).reshape(n, 3):
        name = kinds[int(kind * len(kinds))]
        low, high = degrade.EVENTS[name][0]
        duration = low + length * (high - low)
        start = max(now + 0.5, now + place * (seconds - duration - now))
        out.append((name, start, duration))
        now = start + duration
    return out


def _laid(n: int, own: int, kind: str, rate: int, per_minute: float) -> np.ndarray:
    """n samples of noise with events laid over it, those that would pass the end left out."""
    row = coloured(np.array([own]), n, kind)[0] if n else np.zeros(0)
    for k, (name, start, duration) in enumerate(drawn_events(own, n / rate, per_minute)):
        at, length = int(start * rate), int(duration * rate)
        if length and at + length <= n:
            row[at : at + length] += noise.event_sound(np.array([own ^ (k + 1)]), name, length, rate)[0]
    return row


def mixed(x: np.ndarray, z: np.ndarray, snr: float) -> np.ndarray | None:
    """Signal and noise of its length, the noise at so many dB below, with a peak of 0.95; none where either is silent."""
    power, other = np.mean(x**2) if len(x) else 0.0, np.mean(z**2) if len(z) else 0.0
    if not power > 0 or not other > 0:
        return None
    y = x + z * np.sqrt(power / (other * 10 ** (snr / 10)))
    top = np.abs(y).max()
    return y * 0.95 / top if top > 0 else y


def with_noise(a: Column, key: Column, rate: int, kind: str = "pink", snr: tuple[float, float] = (15.0, 15.0), per_minute: float = 0.0, seed: int = 42) -> Column:
    """a with background noise, and so many events a minute in it, at a ratio drawn between two, in dB; a peak of 0.95.

    Overlapping events add up. Null where the signal is silent or empty, and for null signals and keys."""
    preset(COLOURS, kind, "noise")
    if not -10 <= snr[0] <= snr[1] <= 50:
        raise ValueError(f"ratios {snr} are not between -10 and 50 dB")
    drawn = uniform(key, "snr", seed, float(snr[0]), float(snr[1]))

    @F.arrow_udf("array<double>")
    def mix(signals: pa.Array, keys: pa.Array, ratios: pa.Array) -> pa.Array:
        out = []
        for x, own, ratio in zip(signals, keys.to_pylist(), ratios.to_pylist()):
            known = x.is_valid and own is not None
            samples = x.values.to_numpy(zero_copy_only=False).astype(float) if known else None
            out.append(mixed(samples, _laid(len(samples), own, kind, rate, per_minute), ratio) if known else None)
        return _lists(out)

    return mix(a, noise.keyed(key, "background", seed), drawn)


def response(name: str, rate: int) -> np.ndarray:
    """The impulse response of one of the rooms."""
    mic, source = preset(PLACES, name, "room")
    room = next(r for r in ROOMS if r[0] == name)
    return np.array(spectrum.room_response(rate, room[1:4], source, mic, room[5], room[6]))


def echoed(x: np.ndarray, kernel: np.ndarray, wet: float) -> np.ndarray:
    """Rows of x with their echoes by an impulse response, by share of the power; a peak of 0.95."""
    n = 1 << (x.shape[1] + len(kernel)).bit_length()
    tail, room = np.fft.rfft(kernel, n), np.empty(x.shape)
    step = max(1, AT_ONCE // n)  # a short clip is as long as the response while it is transformed
    for a in range(0, len(x), step):
        room[a : a + step] = np.fft.irfft(np.fft.rfft(x[a : a + step], n, axis=1) * tail, n)[:, : x.shape[1]]
    out = np.sqrt(1 - wet) * x + np.sqrt(wet) * room
    top = np.abs(out).max(axis=1, keepdims=True)
    return np.where(top > 0, out * 0.95 / np.where(top > 0, top, 1), out)


def in_room(a: Column, name: str, rate: int, wet: float = 0.6) -> Column:
    """The signal and its echo from the room at equal power, by share; a peak of 0.95."""
    kernel = response(name, rate)
    return stacked(lambda x: echoed(x, kernel, wet), a)

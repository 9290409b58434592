"""Resampling, tempo and pitch, noise, events, microphones, losses and overlays, against plain computation."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from curaspark.functions import damage, degrade, microphone, noise, resampling, scene, spectrum, stacked, vocoder
from curaspark.functions import signal as S
from curaspark.operators import overlay
from curaspark.plans import augmentation
from curaspark.queries import signals

EDGES = [None, [], [0.5], [0.0] * 40, [0.25, None, 0.5], np.sin(np.arange(300)).tolist(), np.cos(np.arange(300)).tolist()]


def tone(hertz: float, rate: int, seconds: float = 1.0) -> np.ndarray:
    return np.sin(2 * np.pi * hertz * np.arange(int(rate * seconds)) / rate)


def pitch(x: np.ndarray, rate: int) -> float:
    return np.argmax(np.abs(np.fft.rfft(x * np.hanning(len(x)), 1 << 20))) * rate / (1 << 20)


def loudness(x: np.ndarray) -> float:
    return 20 * np.log10(np.sqrt(np.mean(x[600:-600] ** 2)) * np.sqrt(2) + 1e-15)


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(list(enumerate(EDGES)), "id long, a array<double>").repartition(2)


def results(df, column):
    return [r[0] for r in df.orderBy("id").select(column).collect()]


# Resampling.


@pytest.mark.parametrize(("rate", "target"), [(24_000, 16_000), (16_000, 24_000), (44_100, 16_000), (48_000, 8_000)])
def test_resampling_keeps_what_is_below_and_nothing_above(rate, target):
    ratio, low = resampling.ratio_of(target, rate), min(rate, target) / 2
    for share in (0.02, 0.3, 0.7):
        y = resampling.resampled(tone(share * low, rate)[None], ratio)[0]
        assert len(y) == -(-rate * target // rate) and np.abs(y - tone(share * low, target))[600:-600].max() < 1e-3
    if target < rate:
        for above in (1.03, 1.3, min(1.9, rate / target * 0.98)):
            assert loudness(resampling.resampled(tone(above * low, rate)[None], ratio)[0]) < -60
    else:
        y = resampling.resampled(tone(0.5 * low, rate)[None], ratio)[0]
        outside = np.abs(np.fft.rfft(y * np.hanning(len(y))))[int(1.05 * low) :]
        assert outside.max() < 1e-3 * len(y) / 4


def test_resampling_equals_a_plain_sum():
    rng, x, up, down = np.random.default_rng(3), None, 3, 4
    x = rng.normal(size=90)
    cutoff = 0.92 * up / down
    half = int(np.ceil(48 / cutoff))
    want = []
    for j in range(-(-90 * up // down)):
        place, t = divmod(j * down, up)[0], np.arange(-half + 1, half + 1) - (j * down % up) / up
        h = cutoff * np.sinc(cutoff * t) * np.i0(8.0 * np.sqrt(np.maximum(1 - (t / half) ** 2, 0)))
        taps = [x[place + k] if 0 <= place + k < 90 else 0.0 for k in range(-half + 1, half + 1)]
        want.append(np.dot(taps, h / h.sum()))
    assert np.allclose(resampling.resampled(np.stack([x, 2 * x]), Fraction(up, down)), [want, 2 * np.array(want)], atol=1e-12)


def test_resampling_of_edges_and_channels(spark, edges):
    got = results(edges, resampling.to_rate(F.col("a"), F.lit(8_000), 4_000))
    assert [g if g is None else len(g) for g in got] == [None, 0, 1, 20, 2, 150, 150]
    assert results(edges, resampling.to_rate(F.col("a"), F.lit(4_000), 4_000)) == EDGES
    for rate in (F.lit(None).cast("int"), F.lit(0), F.lit(-5)):
        assert not any(results(edges, resampling.to_rate(F.col("a"), rate, 4_000)))
    x, y = tone(100, 2000, 0.2), tone(300, 2000, 0.2)
    df = spark.createDataFrame([(0, [x.tolist(), y.tolist()]), (1, None), (2, [x.tolist()])], "id long, c array<array<double>>")
    both, none, one = results(df, resampling.channels_to_rate(F.col("c"), F.lit(2000), 1000, 2))
    assert none is None and len(both) == 2 and len(one) == 1 and both[0] == one[0]
    assert np.allclose(both, resampling.resampled(np.stack([x, y]), Fraction(1, 2)))


def test_speed_moves_length_and_pitch(spark):
    df = spark.createDataFrame([(0, tone(440, 8000).tolist(), 1.25), (1, tone(440, 8000).tolist(), 9.0)], "id long, a array<double>, f double")
    fast, wrong = results(df, resampling.change_speed(F.col("a"), F.col("f")))
    assert wrong is None and len(fast) == 6400 and pitch(np.array(fast), 8000) == pytest.approx(550, rel=1e-3)


# Tempo and pitch.


@pytest.mark.parametrize("steps", [-12, -7, -1, 4, 12])
def test_pitch_moves_and_length_stays(steps):
    x = np.stack([tone(330, 16_000), tone(500, 16_000)])
    y = vocoder.shifted(x, steps, 12)
    assert y.shape == x.shape
    for row, hertz in zip(y, (330, 500)):
        assert pitch(row, 16_000) == pytest.approx(hertz * 2 ** (steps / 12), rel=3e-3) and abs(loudness(row)) < 1


@pytest.mark.parametrize("rate", [0.5, 0.85, 1.3, 2.5])
def test_length_moves_and_pitch_stays(rate):
    x = tone(330, 16_000) + 0.5 * tone(1234, 16_000)
    y = vocoder.stretched(x[None], rate)[0]
    assert len(y) == round(16_000 / rate) and pitch(y, 16_000) == pytest.approx(330, rel=3e-3)
    m = np.abs(np.fft.rfft(y[500:-500] * np.hanning(len(y) - 1000)))
    at = np.fft.rfftfreq(len(y) - 1000, 1 / 16_000)
    near = lambda f: (m[np.abs(at - f) < 40] ** 2).sum()
    assert (near(330) + near(1234)) / (m**2).sum() > 0.99 and near(1234) / near(330) == pytest.approx(0.25, rel=0.1)


def test_tempo_of_edges_and_guards(edges):
    for f in (vocoder.time_stretch(F.col("a"), 0.5), vocoder.pitch_shift(F.col("a"), 3.0), vocoder.time_effects(F.col("a"), 2.0, 1.5, 0.8)):
        got = results(edges, f)
        assert got[0] is None and got[1] == [] and all(len(g) > 0 for g in got[2:]) and np.isfinite([*got[3], *got[5]]).all()
    assert results(edges, vocoder.time_stretch(F.col("a"), 1.0))[5] == EDGES[5]
    assert not any(results(edges, vocoder.time_stretch(F.col("a"), 5.0))) and not any(results(edges, vocoder.pitch_shift(F.col("a"), 13.0)))
    assert len(results(edges, vocoder.change_tempo(F.col("a"), 1.25, keep_pitch=False))[5]) == 240
    assert len(results(edges, vocoder.change_tempo(F.col("a"), 1.25))[5]) == 375
    with pytest.raises(ValueError, match="tempo 3"):
        vocoder.change_tempo(F.col("a"), 3.0)


# Noise and events.


def test_noise_is_white_normal_and_of_its_key():
    keys = np.arange(40)
    x = np.fft.irfft(noise.white_spectrum(keys, 4096), 4096)
    power = np.mean(np.abs(np.fft.rfft(x, axis=1)) ** 2, axis=0)
    assert x.std() == pytest.approx(1, abs=0.01) and abs(x.mean()) < 0.01 and power[1:700].mean() / power[-700:].mean() == pytest.approx(1, abs=0.05)
    assert np.array_equal(noise.normals(keys, 99)[7], noise.normals(keys[7:8], 99)[0]) and abs(np.corrcoef(x)[np.triu_indices(40, 1)]).max() < 0.1
    z = noise.normals(keys, 4000)
    assert z.std() == pytest.approx(1, abs=0.01) and np.mean(z**4) == pytest.approx(3, abs=0.1)


@pytest.mark.parametrize("kind", degrade.EVENTS)
def test_band_noise_leaves_nothing_outside(kind):
    low, high = degrade.EVENTS[kind][1]
    x = noise.band_noise(np.arange(5), 8001, low, high, 24_000)
    f, m = np.fft.rfftfreq(8001, 1 / 24_000), np.abs(np.fft.rfft(x, axis=1)) ** 2
    assert (m[:, (f < low) | (f > high)].sum(axis=1) / m.sum(axis=1)).max() < 1e-9
    sound = noise.event_sound(np.arange(5), kind, 8001, 24_000)
    assert np.allclose(np.abs(sound).max(axis=1), 0.8)
    assert np.allclose(sound, 0.8 * x * noise.envelope(kind, 8001) / np.abs(x * noise.envelope(kind, 8001)).max(axis=1, keepdims=True))


def test_envelopes_follow_their_rules():
    for kind, (rise, at, fall) in {**noise.ENVELOPES, "other": noise.OTHER_ENVELOPE}.items():
        want = [min(t * rise, 1.0) * (max(1 - (t - at) * fall, 0.0) if t > at else 1.0) for t in np.linspace(0, 1, 97)]
        assert np.allclose(noise.envelope(kind, 97), want)
    assert np.allclose(noise.envelope("chair_scrape", 5), [0.7, 1.0, 0.7, 0.4, 0.7])


def test_event_sounds_repeat_and_bear_odd_rows(spark):
    rows = [(0, "footstep", 0.2, "a"), (1, "footstep", 0.2, "a"), (2, "footstep", 0.2, "b"), (3, "no such", 0.2, "a"), (4, None, 0.2, "a"), (5, "door_close", None, "a"), (6, "door_close", -1.0, "a"), (7, "door_close", 0.5, None), (8, "dish_clink", 0.00026, "a")]
    df = spark.createDataFrame(rows, "id long, kind string, seconds double, key string")
    make = lambda d: results(d, noise.event_sounds(F.col("kind"), F.col("seconds"), F.col("key"), 8000))
    got = make(df.repartition(3))
    assert got == make(df.coalesce(1)) and got[0] == got[1] != got[2] and len(got[0]) == 1600
    assert got[3] is got[4] is got[5] is got[7] is None and got[6] == [] and len(got[8]) == 2


def test_event_query_against_one_event_at_a_time(spark):
    got = {(r.vec_id, r.start): r for r in signals.event_sounds(spark, "/root/testdata/sf0.001").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", F.inline(degrade.random_events(F.col("vec_id"), 120.0, 1.0)))
    rows = rows.withColumn("key", F.xxhash64(F.lit(42), F.lit("sound"), F.concat_ws(":", "vec_id", "start"))).collect()
    assert len(rows) == len(got) > 300
    for r in rows[::7]:
        y = noise.event_sound(np.array([r.key]), r.type, int(r.duration * 8000), 8000)[0]
        held = got[r.vec_id, round(r.start, 5)]
        assert (held.n, held.type) == (len(y), r.type) and held.peak == pytest.approx(np.abs(y).max(), abs=1e-6) and held.rms == pytest.approx(np.sqrt(np.mean(y**2)), abs=2e-5)


def test_sounds_are_handed_back_in_runs(spark):
    sizes = np.array([0, 90, 20, 5, 200, 0, 1, 60, 40])
    cut = [(r.start, r.stop) for r in stacked.runs(sizes, 100)]
    assert cut == [(0, 2), (2, 4), (4, 5), (5, 8), (8, 9)] and list(stacked.runs(sizes[:0], 100)) == []
    assert [(r.start, r.stop) for r in stacked.runs(np.array([0, 0]), 100)] == [(0, 2)]
    rows = spark.range(3000).select("id", F.lit("footstep").alias("kind"), (F.col("id") % 7 / 10).alias("seconds"), F.col("id").alias("key")).coalesce(1)
    made = rows.withColumn("y", noise.event_sounds(F.col("kind"), F.col("seconds"), F.col("key"), 8000)).select("id", F.size("y").alias("n"))
    got = made.collect()
    assert len(got) == 3000 and all(r.n == int(r.id % 7 / 10 * 8000) for r in got)


def test_rooms_transform_few_short_clips_at_a_time(monkeypatch):
    kernel, sizes, plain = scene.response("medium_room", 8000), [], np.fft.rfft
    monkeypatch.setattr(np.fft, "rfft", lambda x, *a, **k: (sizes.append(np.size(x, 0) if np.ndim(x) > 1 else 1), plain(x, *a, **k))[1])
    x = np.random.default_rng(1).normal(size=(3000, 64))
    got = scene.echoed(x, kernel, 0.6)
    n = 1 << (64 + len(kernel)).bit_length()
    assert max(sizes) * n <= 1 << 17
    room = np.array([np.convolve(row, kernel)[:64] for row in x[::500]])
    want = np.sqrt(0.4) * x[::500] + np.sqrt(0.6) * room
    assert np.allclose(got[::500], want * 0.95 / np.abs(want).max(axis=1, keepdims=True))


# Overlay.


def plain_overlay(clips, events, whole: bool) -> dict:
    out = {}
    for k, (id, samples, *_) in enumerate(clips):
        y = None if samples is None else list(samples)
        for of, at, sound, *_ in events:
            if y and of is not None and of == id and at is not None and 0 <= at < len(y) and sound and not (whole and at + len(sound) > len(y)):
                for i, v in enumerate(sound):
                    if at + i < len(y):
                        y[at + i] += v or 0.0
        out[k] = y
    return out


@pytest.mark.parametrize("whole", [False, True])
def test_overlay_against_a_plain_loop(spark, whole):
    rng = np.random.default_rng(5)
    clips = [(i % 12, rng.normal(size=int(rng.integers(1, 700))).tolist(), k, 1.0) for k, i in enumerate(range(14))]
    clips += [(20, None, 14, 1.0), (21, [], 15, 1.0), (None, [1.0, 2.0], 16, 1.0), (22, [0.5] * 10, 17, 1.0)]
    events = [(int(rng.integers(0, 23)), int(rng.integers(-20, 720)), rng.normal(size=int(rng.integers(0, 300))).tolist(), "s") for _ in range(150)]
    events += [(3, int(rng.integers(0, 60)), [0.25] * 90, "s") for _ in range(400)]  # a third and more of all events on one clip
    events += [(None, 0, [1.0], "s"), (22, None, [1.0], "s"), (22, 0, None, "s"), (22, 9, [1.0, None], "s"), (22, 8, [None, 2.0, 3.0], "s"), (99, 0, [1.0], "s")]
    c = spark.createDataFrame(clips, "clip long, samples array<double>, row long, sound double").repartition(3)
    e = spark.createDataFrame(events, "clip long, start long, sound array<double>, samples string").repartition(4)
    got = overlay.overlay_events(c, e, id="clip", whole=whole)
    want = plain_overlay([(c[0], c[1]) for c in clips], events, whole)
    assert got.columns == c.columns
    for r in got.collect():
        assert r.samples == want[r.row] or np.allclose(r.samples, want[r.row], atol=1e-9)
    assert got.count() == len(clips)
    assert overlay.overlay_events(c, e.limit(0), id="clip").count() == len(clips) and overlay.overlay_events(c.limit(0), e, id="clip").count() == 0


# Microphones and losses.


@pytest.mark.parametrize("n", [2, 3, 4, 5, 9])
def test_spline_equals_a_dense_solve(n):
    rng = np.random.default_rng(n)
    x, y = np.cumsum(rng.uniform(0.2, 3, n)), rng.normal(size=n)
    at = np.linspace(x[0] - 1, x[-1] + 1, 101)
    if n < 4:
        want = np.polyval(np.polyfit(x, y, n - 1), np.clip(at, x[0], x[-1]))
    else:  # a cubic for each piece: values at both ends, smooth twice, and the third derivative goes on at the ends
        a, b, p = np.zeros((4 * (n - 1), 4 * (n - 1))), np.zeros(4 * (n - 1)), lambda t, d: [[1, t, t**2, t**3], [0, 1, 2 * t, 3 * t**2], [0, 0, 2, 6 * t], [0, 0, 0, 6]][d]
        row = 0
        for i in range(n - 1):
            for j in (i, i + 1):
                a[row, 4 * i : 4 * i + 4], b[row], row = p(x[j], 0), y[j], row + 1
        for i in range(1, n - 1):
            for d in (1, 2) + ((3,) if i in (1, n - 2) else ()):
                if row < len(a):
                    a[row, 4 * i - 4 : 4 * i], a[row, 4 * i : 4 * i + 4], row = p(x[i], d), [-v for v in p(x[i], d)], row + 1
        c = np.linalg.lstsq(a, b, rcond=None)[0].reshape(n - 1, 4)
        t = np.clip(at, x[0], x[-1])
        i = np.clip(np.searchsorted(x, t, "right") - 1, 0, n - 2)
        want = (c[i] * np.stack([t**0, t, t**2, t**3], axis=1)).sum(axis=1)
    assert np.allclose(microphone.spline(x, y, at), want, atol=1e-6)


def test_microphones_against_their_steps(spark, edges):
    x = np.random.default_rng(1).normal(size=2000) * 0.2
    key = spark.range(1).select(noise.keyed(F.lit("k"), "self_noise", 42)).first()[0]
    df = spark.createDataFrame([(0, x.tolist(), "k")], "id long, a array<double>, k string")
    for name, points in microphone.RESPONSES.items():
        f = np.fft.rfftfreq(2000, 1 / 24_000)
        y = np.fft.irfft(np.fft.rfft(x) * microphone.gains(points, f))
        y = y * (1 - np.sqrt(0.1)) + np.tanh(y * 1.2) * 0.74 * np.sqrt(0.1)
        y = y + noise.normals(np.array([key]), 2000)[0] * np.sqrt(np.mean(y**2)) * 10 ** (-40 / 20) * 0.1
        got = results(df, microphone.microphone(F.col("a"), F.col("k"), name, 0.1, -40.0, 24_000))[0]
        assert np.allclose(got, y * 0.95 / np.abs(y).max(), atol=1e-9)
        assert microphone.gains(points, np.array([p[0] for p in points], float)) == pytest.approx([10 ** (p[1] / 20) for p in points])
    got = results(edges, microphone.microphone(F.col("a"), F.col("id"), "studio", 0.03, -80.0, 24_000))
    assert got[0] is None and got[1] == [] and [len(g) for g in got[2:]] == [1, 40, 3, 300, 300] and max(map(abs, got[3])) == pytest.approx(0.95)
    with pytest.raises(ValueError, match="unknown microphone: tin; valid: conference"):
        microphone.microphone(F.col("a"), F.col("id"), "tin", 0.1, -40.0, 24_000)


def test_runs_of_silence_equal_a_plain_walk(spark):
    rng = np.random.default_rng(8)
    for n, p, run in ((1, 1.0, 3), (50, 0.2, 4), (500, 0.02, 60), (500, 0.9, 1)):
        x, hits = rng.normal(size=(4, n)), rng.random((4, n)) < p
        want = x.copy()
        for row in range(4):
            i = 0
            while i < n:
                if hits[row, i]:
                    want[row, i : i + run] = 0
                    i += run
                else:
                    i += 1
        assert np.array_equal(damage.silenced(x, hits, run), want)
    df = spark.range(1).select("id", F.transform(F.sequence(F.lit(1), F.lit(240_000)), lambda i: i.cast("double")).alias("a"))
    got = np.array(results(df, damage.dropouts(F.col("a"), F.col("id"), 24_000, 0.001, 5.0))[0])
    silent = np.flatnonzero(np.diff(np.concatenate([[0], got == 0, [0]])))
    assert len(got) == 240_000 and all(n >= 120 for n in (silent[1::2] - silent[::2])[:-1]) and 0.05 < (got == 0).mean() < 0.2


def test_losses_and_guards(edges):
    a, key = F.col("a"), F.col("id")
    kinds = [("bit_depth", {"bits": 8}), ("bandwidth", {"low": 100.0, "high": 900.0}), ("transmission", {"probability": 0.1}), ("mp3", {"bitrate": 320}), ("random", {"severity": 1.0})]
    for kind, options in kinds:
        got = results(edges, damage.degrade(a, key, 2_000, kind, **options))
        assert [g if g is None else len(g) for g in got] == [None, 0, 1, 40, 3, 300, 300]
    for bad in (lambda: damage.degrade(a, key, 1, "rust"), lambda: damage.lossy_codec(a, key, 1, 65), lambda: damage.random_losses(a, key, 1, 0.0), lambda: damage.dropouts(a, key, 1, 0.5), lambda: damage.dynamics(a, 1, "rust")):
        with pytest.raises(ValueError):
            bad()
    assert results(edges, damage.dynamics(a, 1000, "limiting", threshold=-12.0, release_ms=8.0))[5] == pytest.approx(results(edges, S.limit(a, -12.0, 8))[5])


def test_random_losses_come_by_their_shares(spark):
    clips = spark.range(600).select("id", F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.sin(i * 0.1)).alias("a"))
    got = results(clips, damage.random_losses(F.col("a"), F.col("id"), 24_000, 0.5))
    x = np.sin(0.1 * np.arange(1, 65))
    keys = np.array([r[0] for r in clips.orderBy("id").select(noise.keyed(F.col("id"), "losses", 42)).collect()])
    gates = noise.uniforms(keys, 4, 12) < 0.5 * np.array([0.8, 0.7, 0.5, 0.6])
    untouched = [np.allclose(g, x, atol=1e-12) for g in got]
    assert all(u for u, g in zip(untouched, gates) if not g.any()) and not any(u for u, g in zip(untouched, gates) if g[1])
    assert np.abs(gates.mean(axis=0) - 0.5 * np.array([0.8, 0.7, 0.5, 0.6])).max() < 0.06
    only_bits = next(i for i, g in enumerate(gates) if list(g) == [True, False, False, False])
    assert np.allclose(got[only_bits], np.rint(x * 2047) / 2047)


def test_limiter_against_a_plain_loop(edges):
    for x, y in zip(EDGES, results(edges, S.limit(F.col("a"), -6.0, 5))):
        if x and None not in x:
            envelope, want, top = 0.0, [], 10 ** (-6 / 20)
            for v in x:
                envelope = abs(v) if abs(v) > envelope else envelope + (abs(v) - envelope) / 5
                want.append(v * top / envelope if envelope > top else v)
            assert y == pytest.approx(want)


def test_packet_loss_against_a_plain_loop(spark):
    from curaspark.operators.splits import uniform

    n, size = 230, 40
    df = spark.range(30).select("id", F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.sin(i * 0.3) + 2).alias("a"))
    lost = {r.id: r.d for r in df.select("id", F.array(*[uniform(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(p))), "packet", 42) < 0.4 for p in range(6)]).alias("d")).collect()}
    for r in df.withColumn("y", degrade.packet_loss(F.col("a"), F.col("id"), 1000, 0.4, 40.0)).collect():
        want = list(r.a)
        for p in range(6):
            length = min(size, n - p * size)
            fade = min(50, length // 2)
            for k in range(length if lost[r.id][p] else 0):
                gain = 1 - k / (fade - 1) if k < fade else (k - (length - fade)) / (fade - 1) if k >= length - fade else 0.0
                want[p * size + k] *= gain
        assert r.y == pytest.approx(want)


# Scenes and profiles.


def test_noise_lies_at_the_ratio_drawn(spark):
    from curaspark.operators.splits import uniform

    clips = spark.range(20).select("id", F.transform(F.sequence(F.lit(1), F.lit(4000)), lambda i: F.sin(i * 0.2) * 0.3).alias("a"))
    held = clips.select("id", "a", scene.with_noise(F.col("a"), F.col("id"), 8000, "pink", (5.0, 20.0), 600.0).alias("y"), uniform("id", "snr", 42, 5.0, 20.0).alias("snr"), noise.keyed(F.col("id"), "background", 42).alias("key")).collect()
    for r in held:
        z = scene.coloured(np.array([r.key]), 4000, "pink")[0]
        assert np.abs(z).max() == pytest.approx(0.1)
        for k, (kind, start, duration) in enumerate(scene.drawn_events(r.key, 0.5, 600.0)):
            at, length = int(start * 8000), int(duration * 8000)
            if at + length <= 4000:
                z[at : at + length] += noise.event_sound(np.array([r.key ^ (k + 1)]), kind, length, 8000)[0]
        x = np.array(r.a)
        y = x + z * np.sqrt(np.mean(x**2) / np.mean(z**2)) * 10 ** (-r.snr / 20)
        assert np.allclose(r.y, y * 0.95 / np.abs(y).max(), atol=1e-9)
    events = scene.drawn_events(5, 120.0, 3.0)
    assert 0 < len(events) == 6 and all(b[1] >= a[1] + a[2] + 0.5 - 1e-9 for a, b in zip(events, events[1:]))


def test_colours_fall_with_frequency():
    for kind, power in (("white", 0.0), ("pink", 1.0), ("brown", 2.0), ("blue", 0.5)):
        m = np.mean(np.abs(np.fft.rfft(scene.coloured(np.arange(300), 1024, kind), axis=1)) ** 2, axis=0)
        assert np.log2(m[40:60].mean() / m[320:480].mean()) / 3 == pytest.approx(power, abs=0.12)


def test_room_against_plain_convolution(spark):
    x = np.random.default_rng(2).normal(size=900)
    df = spark.createDataFrame([(0, x.tolist())], "id long, a array<double>")
    kernel = scene.response("bathroom", 8000)
    y = np.sqrt(0.4) * x + np.sqrt(0.6) * np.convolve(x, kernel)[:900]
    assert np.allclose(results(df, scene.in_room(F.col("a"), "bathroom", 8000))[0], y * 0.95 / np.abs(y).max(), atol=1e-8)


PROFILES = {
    "kitchen": [("noise", {"snr": (12.0, 20.0), "per_minute": 30.0}), ("room", {"name": "small_room"}), ("microphone", {"name": "smartphone"})],
    "phone": [("telephone", {"name": "mobile_gsm"}), ("degradation", {"kind": "transmission", "probability": 0.01}), ("scale", {"to": 0.5})],
    "far": [("far", {"metres": 3.0}), ("dynamics_preset", {"name": "aggressive_limiting"}), ("compress", {}), ("codec", {"bits": 8})],
    "voice": [("voice_preset", {"name": "child_voice"}), ("degradation_preset", {"name": "old_recording"}), ("speed", {"factor": 0.9})],
    "plain": [],
}


def test_profiles_side_by_side_equal_each_alone(spark):
    rows = [(i, (np.sin(np.arange(600) * (0.05 + i / 50)) * 0.4).tolist(), 8000 if i % 2 else 6000, "p") for i in range(4)]
    df = spark.createDataFrame(rows, "id long, samples array<double>, sample_rate int, __x string")
    both = {(r.profile, r.id): r for r in augmentation.augment_profiles(df, PROFILES, to_rate=8000, key="id").collect()}
    assert len(both) == 4 * len(PROFILES)
    for name, steps in PROFILES.items():
        for r in augmentation.augment(df, steps, to_rate=8000, key="id").collect():
            held = both[name, r.id]
            assert r.augment_error is None and held.augment_error is None and len(r.augmented) and np.allclose(r.augmented, held.augmented, atol=1e-12)


def test_profiles_report_what_is_not_usable(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [0.1, inf, 0.2], 8000), (2, [0.1, nan], 8000), (3, [0.1, None], 8000), (4, [0.0] * 50, 8000), (5, [], 8000), (6, None, 8000), (7, [0.1], 0), (None, [0.1, 0.2], 8000), (9, [1e200, -1e200], 8000), (10, [0.5], 8000)]
    df = spark.createDataFrame(rows, "id long, samples array<double>, sample_rate int")
    held = augmentation.augment_profiles(df, PROFILES | {"loud": [("scale", {"to": 1e150}), ("reverb", {"delays": [1], "gains": [1e200]})]}, to_rate=8000, key="id").collect()
    assert all((r.augmented is None) == (r.augment_error is not None) for r in held)
    assert all(r.augmented is None or np.isfinite(r.augmented).all() for r in held)
    told = {(r.profile, r.id): r.augment_error for r in held}
    assert {told[p, i] for p in PROFILES for i in (1, 2, 3)} == {"samples that are no numbers"} and told["plain", 4] is None
    assert told["kitchen", 4] == told["kitchen", None] == "nothing usable after noise" and told["plain", None] is told["kitchen", 10] is None
    assert {told[p, 5] for p in PROFILES} == {told[p, 6] for p in PROFILES} == {"no samples"} and told["far", 7] == "no sample rate"
    assert told["loud", 9] == "nothing usable after scale" and told["loud", 10] is None
    assert augmentation.augment_profiles(df.where("false"), PROFILES, key="id").count() == 0 and augmentation.augment_profiles(df, {}).count() == 0
    with pytest.raises(ValueError, match="draw by a key column: noise"):
        augmentation.augment(df, [("noise", {})])
    with pytest.raises(ValueError, match="unknown room: attic"):
        augmentation.augment(df, [("room", {"name": "attic"})], key="id")
    shown = augmentation.configuration(spark, PROFILES).orderBy("profile", "place").collect()
    assert len(shown) == sum(map(len, PROFILES.values())) and shown[0].options == '{"metres": 3.0}'


def test_spectrum_functions_of_edges(edges):
    for f in (spectrum.air_absorption(F.col("a"), F.lit(3.0), 8000), spectrum.proximity(F.col("a"), F.lit(0.1), 8000), spectrum.phone_band(F.col("a"), 300, 3400, 8000), noise.event_sounds(F.lit("footstep"), F.size("a") / 10, F.col("id"), 100)):
        got = results(edges, f)
        assert got[1] == [] and len(got[5]) >= 300
    x = np.array(EDGES[5])
    f = np.fft.rfftfreq(300, 1 / 8000)
    want = np.fft.irfft(np.fft.rfft(x) / (1 + (f / 8000) ** 2), 300)
    assert np.allclose(results(edges, spectrum.air_absorption(F.col("a"), F.lit(3.0), 8000))[5], want)
    want = np.fft.irfft(np.fft.rfft(x) * (1 - 0.4 / (1 + (f / 150) ** 2)), 300)
    assert np.allclose(results(edges, spectrum.proximity(F.col("a"), F.lit(3.0), 8000))[5], want)

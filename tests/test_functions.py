from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from curaspark.functions import signal as S
from curaspark.functions import microphone, spectrum, vocoder
from curaspark.functions import text as T
from curaspark.operators import validation

#: Signals that every array function must bear.
EDGES = [None, [], [0.5], [0.0] * 32, [0.25] * 32, [0.0] * 16 + [1.0] * 16, [1.0, -1.0] * 7 + [0.5], np.sin(np.arange(64)).tolist()]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(list(enumerate(EDGES)), "id long, a array<double>").coalesce(1)


def values(df, column):
    return [r[0] for r in df.orderBy("id").select(column).collect()]


def test_features_of_edges(edges):
    peak, rms = values(edges, S.peak(F.col("a"))), values(edges, S.rms(F.col("a")))
    for a, p, r in zip(EDGES, peak, rms):
        if not a:
            assert p is None and r is None
        else:
            assert p == pytest.approx(np.abs(a).max()) and r == pytest.approx(np.sqrt(np.mean(np.square(a))))
    assert values(edges, S.snr_db(F.col("a"), 16))[:4] == [None, float("-inf"), float("-inf"), float("inf")]
    crossing = values(edges, S.zero_crossing_rate(F.col("a")))
    assert crossing[6] == pytest.approx(np.abs(np.diff(np.sign(EDGES[6]))).sum() / 30)


def test_spectrum_both_ways(edges):
    for a, m, n in zip(EDGES, values(edges, S.magnitudes(F.col("a"))), values(edges, spectrum.magnitudes(F.col("a")))):
        if a:
            assert np.allclose(m, np.abs(np.fft.rfft(a)), atol=1e-9) and np.allclose(n, m, atol=1e-9)


def test_transforms_keep_length_and_bear_edges(edges):
    a = F.col("a")
    for f in (S.quantise(a, 8), S.codec(a, 8), S.distort(a, 0.2), S.echo(a, 3, 0.5), S.compress(a), S.expand(a), S.limit(a, -6.0, 4), S.distance_gain(a, 2.0), S.reverb(a, [2, 5], [0.3, 0.1])):
        for x, y in zip(EDGES, values(edges, f)):
            assert (y is None) == (x is None) and (x is None or len(y) == len(x))


def test_limiter_stays_below(edges):
    for y in values(edges, S.limit(F.col("a"), -6.0, 4)):
        assert y is None or all(abs(v) <= 10 ** (-6 / 20) + 1e-9 for v in y)


def test_convolution_and_stretch(spark):
    rng = np.random.default_rng(1)
    x, k = rng.normal(size=2000), rng.normal(size=50)
    df = spark.createDataFrame([(0, x.tolist(), k.tolist())], "id long, a array<double>, k array<double>")
    assert np.allclose(values(df, spectrum.convolve(F.col("a"), F.col("k")))[0], np.convolve(x, k)[:2000], atol=1e-8)
    assert len(values(df, vocoder.time_stretch(F.col("a"), 2.0))[0]) == pytest.approx(1000, abs=260)
    noise = values(df, spectrum.coloured_noise(F.lit(512), F.col("id"), 1.0))[0]
    assert max(map(abs, noise)) == pytest.approx(0.1) and noise == values(df, spectrum.coloured_noise(F.lit(512), F.col("id"), 1.0))[0]
    response = spectrum.room_response(8000, (3.0, 2.5, 2.4), (0.5, 0.5, 1.0), (1.5, 1.25, 1.2), 0.2, 2)
    assert np.count_nonzero(response) > 7 and max(response) > 0


def test_equaliser_is_flat_for_equal_gains(spark):
    x = np.random.default_rng(2).normal(size=256)
    df = spark.createDataFrame([(0, x.tolist())], "id long, a array<double>")
    assert np.allclose(values(df, microphone.equalise(F.col("a"), [(50, 0), (500, 0), (2000, 0)], 8000))[0], x, atol=1e-9)


def edits(r, h):
    row = list(range(len(h) + 1))
    for i, a in enumerate(r, 1):
        new = [i]
        for j, b in enumerate(h, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (a != b)))
        row = new
    return row[-1]


def test_word_error_rate(spark):
    rows = [("a b c", "a b c"), ("", "x"), ("a", ""), ("  the cat  sat ", "the dog sat down"), ("x y", "a b c d e"), ("A b", "a B")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, r string, h string")
    got = values(df, T.word_error_rate(T.tokens(F.col("r")), T.tokens(F.col("h"))))
    for (r, h), g in zip(rows, got):
        r, h = r.lower().split(), h.lower().split()
        assert g == pytest.approx(edits(r, h) / len(r) if r else 1.0)


def test_text_rules(spark):
    df = spark.createDataFrame([(0, "${HOME_X}/a/${B:def}.WAV", "warm:alice")], "id long, p string, v string")
    assert values(df, T.with_environment(F.col("p"), {"HOME_X": "/root"})) == ["/root/a/def.WAV"]
    assert values(df, T.with_environment(F.col("p"), {})) == [None]
    assert values(df, T.style_voice(F.col("v"))["voice"]) == ["alice"]
    assert values(df, T.path_parts(F.lit("/x/y/clip.WAV")))[0].asDict() == {"name": "clip.WAV", "stem": "clip", "suffix": ".wav", "parent": "/x/y"}
    assert values(df, T.class_name(F.lit("my_new-plugin"))) == ["MyNewPlugin"]


def test_edit_distance_against_a_plain_table():
    import random

    rng = random.Random(4)
    for _ in range(300):
        r, h = ([rng.choice("abcd") for _ in range(rng.randint(0, 80))] for _ in range(2))
        costs = list(range(len(h) + 1))
        for i, x in enumerate(r):
            above, costs[0] = costs[0], i + 1
            for j, y in enumerate(h):
                above, costs[j + 1] = costs[j + 1], min(costs[j] + 1, costs[j + 1] + 1, above + (x != y))
        assert T.distance(r, h) == costs[-1]


def test_small_functions(spark):
    df = spark.createDataFrame([(0.256, 2_048, 3_145_728, {"a": "1"}, "aGk=", 44_100)], "share double, small long, large long, given map<string,string>, coded string, rate int")
    held = df.select(
        T.percent(F.col("share")), T.file_size(F.col("small")), T.file_size(F.col("large")), T.with_defaults(F.create_map(F.lit("a"), F.lit("0"), F.lit("b"), F.lit("2")), F.col("given")),
        T.from_base64(F.col("coded")), validation.rate_error(F.col("rate"), multiple=1000), validation.in_range({"share": (F.col("share"), 0.5, 1.0), "rate": (F.col("rate"), 0, 1e6)}),
    ).first()
    assert list(held[:3]) == ["25.6%", "2.0 KB", "3.0 MB"] and held[3] == {"a": "1", "b": "2"} and bytes(held[4]) == b"hi"
    assert held[5] == "sample rate 44100 is no multiple of 1000" and held[6] == ["share"]

"""Small parts that no other test calls."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from curaspark.functions import degrade, spectrum
from curaspark.functions import signal as S
from curaspark.functions import text as T
from curaspark.operators import presets, summary, tasks, validation
from curaspark.plans import assessment, augmentation
from curaspark.sources import files, registry
from curaspark.streaming import state


def test_histograms_with_empty_bars(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([(x,) for x in (0.0, 0.1, 4.0, 10.0, None, inf, -inf, nan)], "x double")
    got = [(r.bucket, r.low, r["count"]) for r in summary.equal_width_histogram(df, "x", 5, empty=True).orderBy("bucket").collect()]
    assert got == [(0, 0.0, 2), (1, 2.0, 0), (2, 4.0, 1), (3, 6.0, 0), (4, 8.0, 1)]
    assert [r["count"] for r in summary.equal_width_histogram(df, "x", 5).orderBy("bucket").collect()] == [2, 1, 1]
    same = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert [(r.low, r.high, r["count"]) for r in summary.equal_width_histogram(same, "x", 5, empty=True).collect()] == [(3.0, 3.0, 2)]
    assert summary.equal_width_histogram(df.where("x > 99 and x < 100"), "x", 5, empty=True).count() == 0


def test_points_and_tops(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0), (2, None, 1.0), (3, float("nan"), 1.0), (4, float("inf"), 1.0), (5, 1.0, 1.0)], "id long, x double, y double")
    assert {tuple(r) for r in summary.points(df, "id", "x", "y").collect()} == {("1", 2.0, 3.0), ("5", 1.0, 1.0)}
    assert summary.points(df, "id", "x", "absent").count() == 0
    assert [r.id for r in summary.top(df, 2, F.desc("y"), "id").collect()] == [1, 2] and summary.top(df.limit(0), 2, "id").count() == 0
    maps = summary.distribution_maps(spark.createDataFrame([("a", 1), ("a", None), ("b", 1)], "k string, n int"), "k", "n").first()
    assert maps.k == {"a": 2, "b": 1} and maps.n == {1: 2}


def test_failed_rows_and_unknown_names(spark):
    log = spark.createDataFrame([(1, "failed"), (2, None), (3, "completed"), (4, "failed")], "id long, state string")
    assert {r.id for r in tasks.failed(log, "state").collect()} == {1, 4} and tasks.failed(log.limit(0), "state").count() == 0
    names = spark.createDataFrame([("one",), ("One",), ("two",), (None,), ("",)], "name string")
    known = spark.createDataFrame([("ONE",), (None,)], "k string")
    assert {r.name for r in validation.unknown_names(names, F.col("name"), known, F.col("k")).collect()} == {"TWO", ""}


def test_texts_and_presets(spark):
    row = spark.range(1).select(
        T.output_name(F.lit("hey you"), F.lit("anna"), F.lit("2024-01-01 00:00:00").cast("timestamp")), T.display(F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))),
        presets.prioritised(F.create_map(F.lit("x"), F.lit(1), F.lit("y"), F.lit(2)), F.array(F.lit("y"), F.lit("z"))), presets.prioritised(F.create_map(F.lit("x"), F.lit(1)), F.array(F.lit("y")), include_all=True),
    ).first()
    assert list(row) == ["hey_you_anna_1704067200000.wav", "a: 1, b: 2", {"y": 2}, {"x": 1}]
    held = presets.phones(spark).collect()
    assert {r.phone for r in held} == {p[0] for p in presets.PHONES} and all(r.low_hz < r.high_hz for r in held)


def test_manifests_reports_and_voices(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{"path": "a.wav", "label": 1}, {"path": "b.wav"}]))
    assert {tuple(r) for r in files.json_manifest(spark, f"{tmp_path}/m.json", "path string, label int").collect()} == {("a.wav", 1), ("b.wav", None)}
    page = assessment.report_html({"total": 3}, {"label": [("1", 2), ("0", 1)]}, "Set")
    assert page.startswith("<!doctype html>") and "<td>total</td><td>3</td>" in page and "<td>0</td><td>1</td>" in page and "<title>Set</title>" in page
    voices = spark.createDataFrame([("a", "Anna", "Female", "en-GB", "p"), ("b", "Bo", "male", "de-DE", "p"), ("c", None, None, None, "p")], "id string, name string, gender string, language string, provider string")
    pick = lambda **o: [r.id for r in registry.filter_voices(voices, **o).orderBy("id").collect()]
    assert pick(names=["Anna", "b"]) == ["a", "b"] and pick(language=["EN", "de"], gender="FEMALE") == ["a"] and pick() == ["a", "b", "c"]


def test_latest_states_of_a_log(spark):
    log = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, "w")], "task string, at int, state string")
    assert {(r.task, r.state, r["at"]) for r in state.latest_states(log, "task", "at", "state").collect()} == {("a", "z", 3), ("b", "w", 1)}


def test_telephone_is_its_parts_in_turn(spark):
    x = np.random.default_rng(2).normal(size=700) * 0.2
    df = spark.createDataFrame([(5, x.tolist(), 8000)], "id long, samples array<double>, sample_rate int")
    got = augmentation.augment(df, [("telephone", {"name": "pstn_landline", "loss": 0.3})], to_rate=8000, key="id").first().augmented
    held = df.select("id", spectrum.phone_band(F.col("samples"), 300, 3400, 8000).alias("a"))
    f = np.fft.rfftfreq(700, 1 / 8000)
    assert np.allclose(held.first().a, np.fft.irfft(np.fft.rfft(x) / (1 + (300 / np.maximum(f, 1e-9)) ** 2) / (1 + (f / 3400) ** 4), 700))
    held = spark.createDataFrame(held.collect(), "id long, a array<double>").select("id", S.codec(F.col("a"), 13).alias("a"))
    assert np.allclose(np.array(held.first().a) * 4096, np.round(np.array(held.first().a) * 4096))
    held = held.select("id", degrade.packet_loss(F.col("a"), F.col("id"), 8000, 0.3, seed=42).alias("a"))
    want = held.select(degrade.jitter(F.col("a"), F.col("id"), 8000, seed=42).alias("a")).first().a
    assert got == pytest.approx(want)


def test_jitter_moves_whole_segments(spark):
    n, rate = 1000, 8000
    df = spark.range(5).select("id", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i.cast("double")).alias("a"))
    moved = 0
    for r in df.withColumn("y", degrade.jitter(F.col("a"), F.col("id"), rate)).collect():
        y = np.array(r.y)
        for low in range(0, n, rate // 50):
            shift = set((y[low : low + rate // 50] - np.arange(low, min(n, low + rate // 50))).tolist())
            assert len(shift) == 1 and 0 <= min(shift) < 40  # a whole segment from a little later, or as it was
            moved += shift != {0.0}
    assert moved > 3


def test_distance_chain_is_quieter_and_duller_with_distance(spark):
    x = np.random.default_rng(3).normal(size=2400) * 0.2
    df = spark.createDataFrame([(1, x.tolist(), 24_000)], "id long, samples array<double>, sample_rate int")
    near, far = (np.array(augmentation.augment(df, [("far", {"metres": m, "room": "small", "wet": 0.0})], key="id").first().augmented) for m in (0.5, 6.0))
    high = lambda y: (np.abs(np.fft.rfft(y))[600:] ** 2).sum() / (np.abs(np.fft.rfft(y)) ** 2).sum()
    assert np.abs(far).max() < 0.1 * np.abs(near).max() and high(far) < 0.8 * high(near)
    gain, cutoff = (0.3 / 6.0) ** 1.5, 16_000 / (1 + 0.5 * 5)
    f = np.fft.rfftfreq(2400, 1 / 24_000)
    want = np.fft.irfft(np.fft.rfft(x * gain) / (1 + (f / cutoff) ** 2) * (1 - 1.0 / (1 + (f / 150) ** 2)), 2400)
    assert np.allclose(far, want, atol=1e-9)

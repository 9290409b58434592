"""Scans, metadata, presets and their variations, preferences, acceptance, and what each step of a profile made."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from curaspark.operators import presets, validation
from curaspark.operators.splits import uniform
from curaspark.plans import augmentation, exports
from curaspark.queries import catalog
from curaspark.sources import files, registry


def test_scans_find_each_file_once_in_order(spark, tmp_path):
    for name in ("b.wav", "a.MP3", "deep/c.flac", "deep/er/d.ogg", "deep/no.txt", "a b é.wav"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * len(name))
    root = str(tmp_path)
    got = files.audio_scan(spark, root, f"{root}/deep", root).collect()
    paths = [r.path for r in got]
    assert [os.path.basename(p) for p in paths] == ["a b é.wav", "a.MP3", "b.wav", "c.flac", "d.ogg"] and paths == sorted(paths)
    assert [r.length for r in got][1] == 5
    (tmp_path / "empty").mkdir()
    assert files.audio_scan(spark, f"{root}/empty").count() == 0
    with pytest.raises(ValueError, match="no folder"):
        files.audio_scan(spark)


def test_metadata_goes_round_and_is_filled_in(spark, tmp_path):
    rows = [(1, "train", 400.0), (1, "test", 600.0), (0, "val", None), (0, "train", 500.0)]
    samples = spark.createDataFrame(rows, "label int, split string, ms double")
    exports.summary_row(samples, "set", "hey", "ms").coalesce(1).write.json(f"{tmp_path}/m")
    (r,) = files.dataset_metadata(spark, f"{tmp_path}/m").collect()
    assert (r.name, r.wake_word, r.total_samples, r.positive_samples, r.negative_samples, r.train_samples, r.val_samples, r.test_samples) == ("set", "hey", 4, 2, 2, 2, 1, 1)
    assert r.average_duration_ms == 500.0 and r.duration_std_ms == pytest.approx(81.6496580928) and r.error is None
    assert (r.version, r.sample_rate, r.channels, r.bit_depth, r.format, r.license, r.tags, r.average_snr_db, r.author) == ("1.0.0", 16000, 1, 16, "wav", "MIT", [], None, "")
    (tmp_path / "odd").mkdir()
    for name, text in (("a.json", json.dumps({"name": "x"})), ("b.json", "not json"), ("c.json", json.dumps({"name": "y", "wake_word": "w", "channels": 2, "tags": ["t"], "more": 1}))):
        (tmp_path / "odd" / name).write_text(text)
    odd = sorted(files.dataset_metadata(spark, f"{tmp_path}/odd").collect(), key=lambda r: r.name or "")
    assert [r.error for r in odd] == ["no metadata", "no name or wake word", None] and (odd[2].channels, odd[2].tags) == (2, ["t"])
    assert exports.summary_row(samples.limit(0), "none", "w", "ms").first().total_samples == 0


def test_categories_hold_every_device_once(spark):
    held = presets.devices(spark)
    assert sorted(d for members in presets.CATEGORIES.values() for d in members) == sorted(d[0] for d in presets.DEVICES)
    for category, members in presets.CATEGORIES.items():
        assert {r.device for r in presets.in_category(held, category).collect()} == set(members)
    assert presets.in_category(held, "toaster").count() == 0
    other = spark.createDataFrame([("x",), (None,)], "device string").select(presets.category_of(F.col("device")).alias("c"))
    assert [r.c for r in other.collect()] == [None, None]


def test_variations_move_what_was_drawn(spark):
    base = spark.range(2000).select("id", F.lit(None).cast("double").alias("pitch_steps"), F.lit(0.11).alias("rt60"), F.when(F.col("id") % 5 > 0, 0.2).alias("distortion"))
    draws = [uniform("id", f"{w} moves", 42).alias(f"{w}_m") for w in presets.VARIATIONS] + [uniform("id", w, 42, low, high).alias(f"{w}_d") for w, (_, low, high) in presets.VARIATIONS.items()]
    moved = dict.fromkeys(presets.VARIATIONS, 0)
    for r in presets.varied(base.select("*", *draws), "id", 0.6).collect():
        for what, (share, _, _) in presets.VARIATIONS.items():
            moves = r[f"{what}_m"] < 0.6 * share
            moved[what] += moves
            if what == "pitch_steps":
                assert r[what] == (pytest.approx(r.pitch_steps_d * 0.6) if moves else 0.0)
            elif what == "rt60":
                assert r[what] == pytest.approx(max(0.1, 0.11 * r.rt60_d) if moves else 0.11)
            else:
                assert (r[what] is None) == (r.id % 5 == 0) and (r[what] is None or r[what] == pytest.approx(max(0.01, 0.2 * r.distortion_d) if moves else 0.2))
    assert all(abs(n / 2000 - 0.6 * presets.VARIATIONS[w][0]) < 0.04 for w, n in moved.items())
    still = presets.varied(base, "id", 0.0)
    assert still.where("pitch_steps <> 0 OR rt60 <> 0.11").count() == 0 and presets.varied(base.limit(0), "id").count() == 0
    with pytest.raises(ValueError, match="strength 1.5"):
        presets.varied(base, "id", 1.5)


def test_variation_query_stays_in_bounds(spark):
    rows = catalog.profile_variations(spark, "/root/testdata/sf0.001").collect()
    base = {r.c_custkey: r for r in catalog.preset_star(spark, "/root/testdata/sf0.001").collect()}
    assert len(rows) == len(base) and any(r.pitch_steps for r in rows) and any(r.rt60 != base[r.c_custkey].rt60 for r in rows)
    assert all(abs(r.pitch_steps) <= 0.8 and 0.8 * base[r.c_custkey].rt60 - 1e-6 <= r.rt60 <= 1.2 * base[r.c_custkey].rt60 + 1e-6 for r in rows)


def test_own_profiles_are_added_or_refused(spark):
    known, rooms, mics = presets.environments(spark), presets.rooms(spark), presets.microphones(spark)
    own = lambda *rows: spark.createDataFrame(rows, known.schema)
    held = presets.with_profiles(known, own(("My Attic", "blue", 5.0, 9.0, 0.5, "office", "lapel")), rooms, mics)
    assert held.count() == known.count() + 1 and held.where("profile = 'custom_my_attic' AND room = 'office'").count() == 1
    with pytest.raises(ValueError, match="custom_a: snr, room; custom_b: events, noise, mic"):
        presets.with_profiles(known, own(("a", "pink", 9.0, 5.0, 0.5, "attic", "lapel"), ("b", "red", 5.0, 9.0, -1.0, "office", None)), rooms, mics)
    with pytest.raises(ValueError, match="custom_a: name is taken"):
        presets.with_profiles(known, own(*[(n, "pink", 5.0, 9.0, 0.5, "office", "lapel") for n in ("A", "a")]), rooms, mics)


def test_preferred_rows_of_groups(spark):
    rows = [("de", 3, "web"), ("de", 1, "book"), ("de", 2, "web"), ("en", 5, None), ("en", 4, "book"), (None, 9, "web"), ("fr", None, "book"), ("fr", 1, "book")]
    df = spark.createDataFrame(rows, "lang string, id long, source string").repartition(3)
    got = {r.lang: r.id for r in registry.preferred(df, "lang", F.col("source") == "web", [F.col("id")], ["id"]).collect()}
    assert got == {"de": 2, "en": 4, None: 9, "fr": None}
    assert registry.preferred(df.limit(0), "lang", F.lit(True), [F.col("id")], ["id"]).count() == 0


def test_acceptance_of_transcripts(spark):
    rows = [(0.3, 0.7), (0.31, 0.9), (0.1, 0.69), (0.9, 0.1), (None, 0.9), (0.1, None)]
    df = spark.createDataFrame(rows, "w double, c double").coalesce(1)
    got = df.select(validation.accepted(F.col("w"), F.col("c")), validation.acceptance_error(F.col("w"), F.col("c"))).collect()
    assert [tuple(r) for r in got] == [(True, None), (False, "high WER: 0.310 > 0.3"), (False, "low confidence: 0.690 < 0.7"), (False, "low confidence: 0.100 < 0.7"), (False, None), (False, None)]


def test_trace_has_what_each_step_made(spark):
    rows = [(1, [0.5, -0.5] * 40, 8000), (2, [0.0] * 80, 8000), (3, None, 8000)]
    df = spark.createDataFrame(rows, "id long, samples array<double>, sample_rate int")
    steps = [("distort", {"amount": 0.2}), ("noise", {}), ("scale", {"to": 0.5})]
    held = {r.id: r for r in augmentation.augment(df, steps, to_rate=8000, key="id", trace=True).collect()}
    alone = [{r.id: r.augmented for r in augmentation.augment(df, steps[:k], to_rate=8000, key="id").collect()} for k in (1, 2, 3)]
    assert [s.step for s in held[1].augment_steps] == ["distort", "noise", "scale"] and [s.samples for s in held[1].augment_steps] == [a[1] for a in alone]
    assert [s.step for s in held[2].augment_steps] == ["distort"] and held[2].augment_error == "nothing usable after noise" and held[3].augment_steps == []

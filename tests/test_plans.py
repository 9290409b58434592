from __future__ import annotations

import json
import wave
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from curaspark.operators import cache, duplicates, presets, splits, summary, tasks, validation
from curaspark.plans import assessment, exports
from curaspark.sources import files, registry, tones
from curaspark.streaming import state


@pytest.fixture(scope="module")
def samples(spark):
    rows = spark.range(200).select(F.col("id").alias("sample_id"), F.format_string("clips/%d.wav", "id").alias("path"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    return splits.stratified_split(rows, "sample_id", "label").withColumn("transcript", F.lit("hey"))


@pytest.mark.parametrize("format", sorted(exports.FORMATS))
def test_exports_write_all_rows(spark, samples, tmp_path, format):
    exports.export(samples, format, str(tmp_path), "hey")
    data = next(p for p in tmp_path.iterdir() if p.name != "metadata")
    kind = next(x.suffix[1:] for x in data.rglob("part-*"))
    assert spark.read.option("header", True).format(kind).load(str(data)).count() == 200
    with pytest.raises(ValueError, match="valid"):
        exports.export(samples, "nonsense", str(tmp_path), "hey")


def test_numbering_is_by_id_without_gaps(samples):
    for r in exports.numbered(samples, "sample_id", "label").groupBy("label").agg(F.count("*").alias("n"), F.max("number").alias("m"), F.count_distinct("number").alias("d")).collect():
        assert r.n == r.d == r.m + 1


def test_splits_cover_and_repeat(samples):
    again = splits.stratified_split(samples.drop("split").repartition(7), "sample_id", "label")
    assert {(r.sample_id, r.split) for r in again.collect()} == {(r.sample_id, r.split) for r in samples.collect()}
    one = splits.shuffle_split(samples.limit(1).drop("split"), "sample_id")
    assert [r.split for r in one.collect()] == ["test"]


def test_validation_stops_early(spark):
    rows = [(0, 24000, None), (1, 24000, []), (2, 24000, [0.1] * 10), (3, 8000, [0.1] * 8000), (4, 24000, [1.0, -1.0] * 12000), (5, 24000, [0.0] * 24000)]
    df = spark.createDataFrame(rows, "id long, sample_rate int, samples array<double>")
    got = {r.id: r for r in validation.validate(df).collect()}
    assert [bool(got[i].is_valid) for i in range(6)] == [False] * 6
    assert got[0].error == "signal is missing" and got[1].error == "signal is empty" and "below minimum" in got[2].error and "sample rate" in got[3].error
    assert got[3].peak is None and "peak amplitude" in got[4].error and "; " in got[4].error and "RMS" in got[5].error
    held = assessment.assess(df, validation.ValidationConfig())
    assert all(r.overall_score == 0 for r in held.collect())


def test_histogram_edges(spark):
    df = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 1.0, 2.0, 2.5)], "x double")
    assert [(r.label, r["count"]) for r in summary.histogram(df, "x", [0.0, 1.0, 2.0]).orderBy("bucket").collect()] == [("0.0-1.0", 1), ("1.0-2.0", 2)]
    assert summary.histogram(df.where("false"), "x", [0.0, 1.0]).count() == 0


def test_jaccard_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    sets = [sorted({f"w{x}" for x in rng.integers(0, 12, 8)}) for _ in range(60)] + [[], ["a"], ["a"]]
    df = spark.createDataFrame(list(enumerate(sets)), "id long, s array<string>")
    got = {(r.a, r.b): r.similarity for r in duplicates.jaccard_pairs(df, "id", "s", 0.6).collect()}
    want = {(i, j): len(set(a) & set(b)) / len(set(a) | set(b)) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and a and b}
    assert got == pytest.approx({k: v for k, v in want.items() if v >= 0.6})


def test_cosine_blocks_equal_all_pairs(spark):
    v = np.random.default_rng(4).normal(size=(70, 5))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    got = {(r.a, r.b) for r in duplicates.cosine_pairs(df, "id", "v", 0.8, block=16).collect()}
    n = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert got == {(i, j) for i in range(70) for j in range(i + 1, 70) if n[i] @ n[j] >= 0.8}


def test_presets_and_cache(spark):
    with pytest.raises(ValueError, match="unknown room"):
        presets.lookup_or_fail(spark.createDataFrame([("attic",)], "room string"), presets.rooms(spark), "room")
    assert presets.rule_violations(presets.rooms(spark), "room", presets.room_rules()).count() == 0
    key = spark.range(1).select(cache.content_key(F.lit(" Hey "), F.lit("v"), F.lit("p")), cache.legacy_key(F.lit("a"), F.lit("v"), F.create_map(F.lit("z"), F.lit("1"), F.lit("b"), F.lit("2")))).first()
    import hashlib

    assert key[0] == hashlib.sha256(b"hey|v|p").hexdigest()[:16]
    assert key[1] == hashlib.md5(("a|v|" + json.dumps({"b": "2", "z": "1"})).encode()).hexdigest()


def test_sources(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.wav", "sub/B.WAV"):
        with wave.open(str(tmp_path / name), "wb") as w:
            w.setnchannels(2), w.setsampwidth(2), w.setframerate(8000)
            w.writeframes(np.array([16384, 0] * 100, "<i2").tobytes())
    (tmp_path / "bad.wav").write_bytes(b"RIFFnothing")
    decoded = {Path(r.path).name: r for r in files.decode_wav(files.audio_files(spark, str(tmp_path))).collect()}
    assert decoded["a.wav"].samples[:2] == [0.25, 0.25] and decoded["bad.wav"].error and decoded["a.wav"].channels == 2
    assert {r.relative_path for r in files.audio_manifest(spark, str(tmp_path)).collect()} == {"a.wav", "bad.wav", "sub/B.WAV"}
    (tmp_path / "lines.txt").write_text("# no\n hey you \n\n #yes\n")
    assert [r.text for r in files.text_lines(spark, str(tmp_path / "lines.txt")).collect()] == ["hey you", "#yes"]
    (tmp_path / "job.yaml").write_text("word: ${NO_SUCH_NAME:hey}\n")
    assert files.job_specification(str(tmp_path / "job.yaml")) == {"word": "hey"}
    tones.register(spark)
    held = spark.read.format("tones").option("count", 5).load()
    assert held.count() == 5 and len(held.first().samples) == 800


def test_registry(spark):
    r = registry.Registry()
    r.register(registry.Provider("one", "free", ("json",), (), (("a", "Anna", "female", "en-GB"), ("b", "Bo", "male", "de-DE"))))
    r.register(registry.Provider("two", "commercial", ("no_such_module_x",), ("NO_SUCH_KEY_X",)))
    assert {x.provider: x.available for x in r.availability(spark).collect()} == {"one": True, "two": False}
    assert [x.id for x in registry.filter_voices(r.voices(spark), language="EN").collect()] == ["a"]


def test_token_bucket_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = state.token_bucket(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "user_id", "ts", "event_id", 2.0, 1 / 86400)
    query = stream.writeStream.format("memory").queryName("bucket").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {int(r.key): r.n for r in spark.sql("SELECT key, count_if(accepted) AS n FROM bucket GROUP BY key").collect()}
    batch = {r.user_id: r.accepted for r in tasks.token_bucket(events, "user_id", "ts", "event_id", 2.0, 1 / 86400).collect()}
    assert got == batch


def test_window_counts_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = state.window_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "event_type", "ts", "1 day")
    query = stream.writeStream.format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "c")).outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.sql("SELECT sum(requests) AS n FROM windows").first().n == events.count()


def test_augmentation_reports_bad_rows(spark):
    from curaspark.plans import augmentation

    rows = [(1, [0.5, -0.5, 0.25, 0.1] * 6, 24_000), (2, None, 24_000), (3, [], 24_000), (4, [0.1, float("nan")], 24_000), (5, [0.1, None], 24_000), (6, [0.1], None), (7, [0.0, 1.0], 12_000)]
    df = spark.createDataFrame(rows, "id long, samples array<double>, sample_rate int")
    got = {r.id: r for r in augmentation.augment(df, [("distort", {"amount": 0.1}), ("limit", {"threshold": -6.0}), ("ramps", {"attack": 2, "release": 2})]).collect()}
    assert [got[i].augment_error for i in range(1, 8)] == [None, "no samples", "no samples", "samples that are no numbers", "samples that are no numbers", "no sample rate", None]
    assert all((got[i].augmented is None) == (got[i].augment_error is not None) for i in got)
    assert len(got[1].augmented) == 24 and got[1].augmented[0] == 0 == got[1].augmented[-1] and max(map(abs, got[1].augmented)) <= 10 ** (-6 / 20) + 1e-9
    assert len(got[7].augmented) == 4
    with pytest.raises(ValueError, match="unknown steps: warp"):
        augmentation.augment(df, [("warp", {})])
    assert augmentation.augment(df.where("false"), []).count() == 0


def test_rows_pair_by_position(spark):
    from curaspark.plans import augmentation

    left = spark.range(500).selectExpr("id * 7 % 1000 AS path")
    right = spark.range(500).selectExpr("id AS line", "concat('text ', id) AS text").repartition(5)
    got = augmentation.paired(left, "path", right, "line").orderBy("line").collect()
    assert [r.path for r in got] == sorted(i * 7 % 1000 for i in range(500)) and [r.line for r in got] == list(range(500))
    with pytest.raises(ValueError, match="500 rows on the left, 499"):
        augmentation.paired(left, "path", right.where("line > 0"), "line")

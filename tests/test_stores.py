"""Record files, the stored cache index, the log of task states and typed errors."""

from __future__ import annotations

import random
import struct
from pathlib import Path

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from curaspark.operators import cache, errors
from curaspark.sources import records
from curaspark.streaming import state

SCHEMA = "id bigint, audio binary, name string, gain float, ok boolean, ids array<bigint>, parts array<string>, split string"


def plain_crc(data: bytes) -> int:
    register = 0xFFFFFFFF
    for b in data:
        register ^= b
        for _ in range(8):
            register = register >> 1 ^ (0x82F63B78 if register & 1 else 0)
    return register ^ 0xFFFFFFFF


def test_sums_of_many_records_at_once():
    rng = random.Random(1)
    held = [rng.randbytes(n) for n in (0, 1, 3, 4, 5, 255, 256, 257, 1000, 4096, 3)] + [b"123456789", b"\0" * 700]
    assert records.crc32c(held) == [plain_crc(r) for r in held] and records.crc32c([]) == []
    assert records.crc32c([b"123456789"]) == [0xE3069283]  # the check value of CRC-32C


def rows_of(rng: random.Random, n: int) -> list[tuple]:
    return [(rng.choice([0, -1, 2**62, i]), rng.randbytes(rng.randint(0, 900)), f"clip é {i}", i / 4, bool(i % 2), [i, -i, 2**40][: i % 4], ["a", ""][: i % 3], ("train", "val", "test-1")[i % 3]) for i in range(n)]


def test_records_round_trip_byte_for_byte(spark, tmp_path):
    rows = rows_of(random.Random(2), 200)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    folder = f"file://{tmp_path}/out"
    records.write_records(df, folder, "split")
    got = records.read_records(spark, folder, SCHEMA, "split").collect()
    want = [(*r[:5], r[5] or None, r[6] or None, r[7]) for r in rows]  # empty lists have no values to store
    key = lambda r: (r[2],)
    assert sorted([(r.id, bytes(r.audio), r.name, r.gain, r.ok, r.ids or None, r.parts or None, r.split) for r in got], key=key) == sorted(want, key=key)
    files = sorted(Path(tmp_path, "out").rglob("*.tfrecord"))
    assert {f.parent.name for f in files} == {"train", "val", "test-1"} and len(files) == 9
    data = files[0].read_bytes()  # framing by hand
    (size,) = struct.unpack("<Q", data[:8])
    mask = lambda c: ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF
    assert struct.unpack("<I", data[8:12])[0] == mask(plain_crc(data[:8])) and struct.unpack("<I", data[12 + size : 16 + size])[0] == mask(plain_crc(data[12 : 12 + size]))


def test_a_record_as_bytes(spark, tmp_path):
    folder = f"file://{tmp_path}/one"
    records.write_records(spark.createDataFrame([(1, b"ab")], "label bigint, audio binary").coalesce(1), folder)
    data = next(Path(tmp_path, "one").glob("*.tfrecord")).read_bytes()
    label = b"\x0a\x05label\x12\x05\x1a\x03\x0a\x01\x01"
    audio = b"\x0a\x05audio\x12\x06\x0a\x04\x0a\x02ab"
    features = b"".join(b"\x0a" + bytes([len(f)]) + f for f in (label, audio))
    assert data[12:-4] == b"\x0a" + bytes([len(features)]) + features


def test_records_of_odd_rows_and_failed_writes(spark, tmp_path):
    folder = f"file://{tmp_path}/odd"
    odd = [(None, None, None, None, None, None, None, "a"), (1, b"", "", float("inf"), False, [], [None, "x"], "a")]
    records.write_records(spark.createDataFrame(odd, SCHEMA), folder, "split")
    got = sorted(records.read_records(spark, folder, SCHEMA + ", absent string", "split").collect(), key=lambda r: r.id or 0)
    assert [tuple(r) for r in got] == [(None,) * 7 + ("a", None), (1, bytearray(b""), "", float("inf"), False, [], ["x"], "a", None)]
    before = sorted(p.name for p in Path(tmp_path, "odd").rglob("*.tfrecord"))
    for bad in ("../x", None):
        with pytest.raises(PySparkException, match="cannot name a folder"):
            records.write_records(spark.createDataFrame([(*odd[1][:7], "b"), (*odd[1][:7], bad)], SCHEMA).coalesce(1), folder, "split")
        assert sorted(p.name for p in Path(tmp_path, "odd").rglob("*.tfrecord")) == before  # a failed task leaves nothing
    records.write_records(spark.createDataFrame([], SCHEMA), folder, "split")
    assert records.read_records(spark, folder, SCHEMA, "split").count() == 0 and not [*Path(tmp_path, "odd").rglob("*.tfrecord")]
    records.write_records(spark.createDataFrame(odd, SCHEMA), folder, "split")
    held = next(p for p in Path(tmp_path, "odd").rglob("*.tfrecord") if p.stat().st_size > 60)
    data = bytearray(held.read_bytes())
    data[30] ^= 1
    held.write_bytes(bytes(data))
    with pytest.raises(PySparkException, match="damaged"):
        records.read_records(spark, folder, SCHEMA, "split").collect()


ENTRY = "cache_key string, created int, file_size long, last_accessed timestamp, text string"


def entries(spark, rows):
    held = [(k, c, s, f"2024-01-{a:02d} 00:00:00", t) for k, c, s, a, t in rows]
    return spark.createDataFrame(held, ENTRY.replace("timestamp", "string")).withColumn("last_accessed", F.col("last_accessed").cast("timestamp"))


def files_of(folder: Path) -> dict:
    return {p.parent.name: p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_upsert_rewrites_touched_folders_alone(spark, tmp_path):
    path, rng, model = f"file://{tmp_path}/index", random.Random(3), {}
    for round_ in range(5):
        rows = [(f"k{rng.randint(0, 400)}", rng.randint(0, 3), rng.randint(1, 9), rng.randint(1, 28), f"t{round_}") for _ in range(200 if round_ < 3 else 3)]
        before = files_of(tmp_path / "index") if round_ else {}
        cache.upsert(entries(spark, rows).repartition(3), path, buckets=16)
        best = {}
        for r in rows:
            if r[0] not in best or (-r[1], r[2], r[3], r[4]) < (-best[r[0]][1], best[r[0]][2], best[r[0]][3], best[r[0]][4]):
                best[r[0]] = r
        model |= best
        got = {r.cache_key: (r.cache_key, r.created, r.file_size, r.last_accessed.day, r.text) for r in cache.stored(spark, path).collect()}
        assert got == model
        touched = {f"bucket={r[0]}" for r in entries(spark, rows).select(cache._bucket(F.col("cache_key"), 16)).collect()}
        after = files_of(tmp_path / "index")
        assert {f for f in after if before.get(f) != after[f]} == touched
    again = files_of(tmp_path / "index")
    cache.upsert(entries(spark, rows), path, buckets=16)
    assert {r.cache_key for r in cache.stored(spark, path).collect()} == set(model) and again.keys() == files_of(tmp_path / "index").keys()


def test_upsert_and_evict_of_odd_entries(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    cache.upsert(entries(spark, []), path)
    assert cache.stored(spark, path).count() == 0 if any((tmp_path / "index").rglob("*.parquet")) else True
    rows = [(None, 1, 5, 1, "no key"), ("a", 1, 10, 1, "x"), ("a", None, 99, 1, "older"), ("b", 2, 10, 2, None), ("c", 3, 10, 3, "z"), ("c", 3, 10, 3, "z"), ("d", 1, 10, 4, "w")]
    cache.upsert(entries(spark, rows), path)
    assert {r.cache_key: r.file_size for r in cache.stored(spark, path).collect()} == {"a": 10, "b": 10, "c": 10, "d": 10}
    cache.upsert(entries(spark, []), path)
    assert cache.evict(spark, path, 40.0) == 0 and cache.evict(spark, path, 30.0, headroom=0.8, now="2024-02-01") == 2
    assert {r.cache_key for r in cache.stored(spark, path).collect()} == {"c", "d"} and cache.evict(spark, path, 30.0) == 0
    cache.upsert(entries(spark, [("a", 9, 1, 9, "back")]), path)
    assert {r.cache_key for r in cache.stored(spark, path).collect()} == {"a", "c", "d"}


def test_states_of_a_stream_are_saved_once(spark, tmp_path):
    schema = "session long, task string, result string, at string, note string"
    log, checkpoint, source = f"{tmp_path}/log", f"{tmp_path}/check", tmp_path / "in"
    feed = lambda rows, name: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source / name))

    def run():
        stream = spark.readStream.schema(schema).parquet(str(source / "*"))
        state.save_states(state.task_states(stream, "session", "task", "result", "at", "note"), log, checkpoint).awaitTermination(120)

    feed([(1, "a", None, "2024-01-01", "bad"), (1, "b", "ok", "2024-01-01", "unused"), (2, "a", None, "2024-01-01", None), (None, None, None, None, None)], "one")
    run()
    feed([(1, "a", "ok", "2024-01-02", None), (2, "c", "ok", "2024-01-02", None)], "two")
    run()
    latest = lambda: {(r.session, r.task): (r.state, r.at.day) for r in state.saved_states(spark, log).collect()}
    want = {("1", "a"): ("completed", 2), ("1", "b"): ("completed", 1), ("2", "a"): ("failed", 1), ("2", "c"): ("completed", 2)}
    assert latest() == want
    assert {(r.task, r.error) for r in spark.read.schema(state.LOG).parquet(log).where("session = '1'").collect()} == {("a", "bad"), ("b", None), ("a", None)}
    n = spark.read.schema(state.LOG).parquet(log).count()
    last = sorted((tmp_path / "check" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))[-1]
    for p in (last, last.with_name(f".{last.name}.crc")):  # as if the query had died between its write and its commit
        p.unlink(missing_ok=True)
    run()
    assert spark.read.schema(state.LOG).parquet(log).count() == n and latest() == want
    state.cancel(spark, log, "2", "2024-01-05")
    state.cancel(spark, log, "2", "2024-01-05")
    state.cancel(spark, log, "1", "2024-01-05")
    assert latest() == want | {("2", "a"): ("failed", 5)}
    assert spark.read.schema(state.LOG).parquet(log).count() == n + 2


def test_errors_are_typed_and_counted_with_their_kinds(spark):
    rows = [("nothing usable after noise",), ("nothing usable after room",), ("nothing usable after codec",), ("no samples",), ("",), (None,)]
    df = spark.createDataFrame(rows, "m string").coalesce(1)
    held = df.select(errors.of_augmentation(F.col("m")).alias("error"))
    assert held.schema["error"].dataType.simpleString() == errors.TYPE
    assert [r.error and r.error["class"] for r in held.collect()] == ["NoiseError", "RoomSimulationError", "AugmentationError", "AudioError", None, None]
    more = held.unionByName(spark.createDataFrame([("Odd", "x", "?"), (None, "x", "?")], "class string, stage string, message string").select(F.struct("class", "stage", "message").alias("error")))
    got = {(r["class"], r.stage): (r.own, r.total) for r in errors.counts(more).collect()}
    assert got == {
        ("NoiseError", "augment"): (1, 1), ("RoomSimulationError", "augment"): (1, 1), ("AugmentationError", "augment"): (1, 3), ("AudioError", "augment"): (1, 1),
        ("Error", "augment"): (0, 4), ("Odd", "x"): (1, 1), (None, "x"): (1, 1),
    }
    both = df.select(errors.first(errors.error(F.lit(None), "AudioError", "decode"), errors.of_augmentation(F.col("m"))).alias("e")).first().e
    assert (both.stage, both.message) == ("augment", "nothing usable after noise") and errors.counts(held.limit(0)).count() == 0
    assert errors.lineage("NoiseError") == ["NoiseError", "AugmentationError", "Error"]
    with pytest.raises(ValueError, match="unknown kind of error: Nope"):
        errors.lineage("Nope")


def test_sums_over_whole_clips_are_fast_enough():
    clip = np.random.default_rng(1).integers(0, 256, 480_000, dtype=np.uint8).tobytes()
    assert records.crc32c([clip, clip[:-1]])[0] == records.crc32c([clip])[0]

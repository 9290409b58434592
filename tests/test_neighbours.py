"""The hyperplane index, spectrum hashes and the order of methods, against all pairs and plain computation."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from curaspark.functions import spectrum
from curaspark.operators import duplicates, neighbours, shared
from curaspark.queries import signals


def frame(spark, vectors, more=()):
    return spark.createDataFrame([(i, None if v is None else list(map(float, v))) for i, v in [*enumerate(vectors), *more]], "id long, v array<double>").repartition(3)


def all_pairs(vectors, threshold) -> dict:
    m = np.array(vectors, float)
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(m @ m.T >= threshold, 1))
    return {(int(a), int(b)): (m[a] @ m[b]) for a, b in zip(i, j)}


@pytest.mark.parametrize(("threshold", "bits"), [(0.9, 12), (0.8, 10), (0.5, 6)])
def test_index_finds_what_all_pairs_find(spark, threshold, bits):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(150, 24))
    spread = np.sqrt(1 / threshold**2 - 1) / np.sqrt(24)
    vectors = np.concatenate([base] + [base + rng.normal(size=base.shape) * spread * np.linalg.norm(base, axis=1, keepdims=True) * f for f in (0.6, 0.9, 1.0)])
    _, kinds = neighbours.classes(frame(spark, vectors), "id", "v")
    got = {(r.a, r.b): r.similarity for r in neighbours.hyperplane_pairs(kinds, threshold, bits=bits).collect()}
    want = all_pairs(vectors, threshold)
    assert len(want) > 150 and set(got) <= set(want) and len(got) >= 0.95 * len(want)
    assert all(s == pytest.approx(want[p]) for p, s in got.items())


def test_large_buckets_are_dealt_into_blocks(spark):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=16)
    vectors = [centre + rng.normal(size=16) * 0.05 for _ in range(120)] + list(rng.normal(size=(60, 16)))
    _, kinds = neighbours.classes(frame(spark, vectors), "id", "v")
    rows = neighbours.hyperplane_pairs(kinds, 0.9, block=16).collect()
    got, want = {(r.a, r.b) for r in rows}, all_pairs(vectors, 0.9)
    assert len(got) == len(rows) and got <= set(want) and len(got) >= 0.99 * len(want) > 7000


def test_copies_and_odd_vectors(spark):
    vectors = [[1, 2, 3], [1, 2, 3], [2, 4, 6], [0, 0, 0], [], None, [1, 2, 3], [1, 2], [-1, -2, -3], [0, 0, 0]]
    members, kinds = neighbours.classes(frame(spark, vectors, [(None, [1, 2, 3])]), "id", "v")
    assert {(r.id, r.rep) for r in members.collect()} == {(0, 0), (1, 0), (2, 2), (3, 3), (6, 0), (7, 7), (8, 8), (9, 3)}
    assert {r.rep: r.copies for r in kinds.collect()} == {0: 3, 2: 1, 3: 2, 7: 1, 8: 1}
    assert [(r.a, r.b) for r in neighbours.hyperplane_pairs(kinds, 0.99).collect()] == [(0, 2)]
    assert neighbours.hyperplane_pairs(kinds.where("false"), 0.9).count() == 0


def test_bands_hold_the_recall_asked_for():
    for threshold in (0.5, 0.8, 0.95):
        same = 1 - np.arccos(threshold) / np.pi
        n = neighbours.bands_for(threshold)
        assert 1 - (1 - same**12) ** n >= 0.97 > 1 - (1 - same**12) ** (n - 1)
    assert neighbours.bands_for(1.0) == 1


def test_hashes_of_spectra_against_plain_windows(spark):
    rng = np.random.default_rng(3)
    rows = [rng.normal(size=n) for n in (0, 63, 64, 96, 1000)]
    df = frame(spark, [*rows, None])
    got = {r.id: r for r in df.select("id", spectrum.fingerprints(F.col("v"), 64, 32, 20).alias("p"), spectrum.spectrum_hash(F.col("v"), 64, 32, 20).alias("h")).collect()}
    for i, x in enumerate(rows):
        plain = []
        for k in range(0, len(x) - 63, 32):
            m = np.abs(np.fft.rfft(x[k : k + 64]))[:20]
            plain.append(np.round((m - m.min()) / (m.max() - m.min() + 1e-10) * 10**6).astype("<i8").tobytes())
        assert got[i].p == [hashlib.sha256(b).hexdigest() for b in plain]
        assert got[i].h == (hashlib.sha256(b"".join(plain[:10])).hexdigest() if plain else None)
    assert got[5].p is None and got[5].h is None


def test_methods_count_in_their_order(spark):
    rng = np.random.default_rng(4)
    a, b, c = rng.normal(size=400), rng.normal(size=400), rng.normal(size=400)
    rows = [a, a * 3, b, np.concatenate([b[:240], rng.normal(size=160)]), c, c + rng.normal(size=400) * 0.01, rng.normal(size=400), a, rng.normal(size=8), None]
    members, pairs = neighbours.find_duplicates(frame(spark, rows), "id", "v", F.col("v"), threshold=0.9, window=64, hop=16, bins=33)
    got = {(r.a, r.b): r for r in pairs.collect()}
    assert {p: r.method_used for p, r in got.items()} == {(0, 1): "fingerprint", (2, 3): "spectrum", (4, 5): "embedding"}
    assert got[0, 1].similarity == got[2, 3].similarity == 1.0 and got[4, 5].similarity == pytest.approx(c @ rows[5] / np.linalg.norm(c) / np.linalg.norm(rows[5]))
    assert (7, 0) in {(r.id, r.rep) for r in members.collect()}


def test_queries_against_all_pairs(spark):
    folder = "/root/testdata/sf0.001"
    rows = sorted((r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect())
    want = all_pairs([r[1] for r in rows], 0.4)
    got = {(r.a, r.b): r.similarity for r in signals.near_signals(spark, folder).collect()}
    assert set(got) <= set(want) and len(got) >= 0.9 * len(want) > 0
    exact = {(r.a, r.b) for r in duplicates.cosine_pairs(spark.read.parquet(f"{folder}/embeddings.parquet"), "vec_id", "embedding", 0.4).collect()}
    assert set(got) <= exact
    found = {(r.a, r.b): r.method_used for r in signals.near_duplicate_clips(spark, folder).collect()}
    clips = sorted((r.vec_id, r.samples) for r in signals.clips_and_copies(spark, folder).collect())
    want = {(clips[a][0], clips[b][0]) for a, b in all_pairs([c[1] for c in clips], 0.9)}
    assert len(want) > 100 and len(want & found.keys()) >= 0.95 * len(want)
    assert {p for p, m in found.items() if m == "embedding"} <= want and {"fingerprint", "embedding"} <= set(found.values())


def test_all_pairs_of_sets_with_frequent_elements(spark):
    rng = np.random.default_rng(5)
    sets = [sorted({f"w{x}" for x in rng.zipf(1.3, 40) % 200}) for _ in range(700)] + [[], ["a"], ["a"], None, ["a", "a", "b", None]]
    df = spark.createDataFrame([*enumerate(sets), (None, ["a"])], "id long, s array<string>")
    got = {(r.a, r.b): r.similarity for r in duplicates.all_jaccard_pairs(df, "id", "s", 0.15).collect()}
    plain = {i: set(s) - {None} for i, s in enumerate(sets) if s}
    want = {(a, b): len(plain[a] & plain[b]) / len(plain[a] | plain[b]) for a in plain for b in plain if a < b}
    assert got == pytest.approx({k: v for k, v in want.items() if v >= 0.15}) and len(got) > 10_000 and got[701, 704] == 0.5
    assert duplicates.all_jaccard_pairs(df.where("false"), "id", "s", 0.15).count() == 0


def packed(sets) -> shared.Sets:
    codes = [sorted(s) for s in sets]
    return shared.Sets(np.arange(len(sets)), np.array([len(s) for s in sets]), np.array(sum(codes, [])), 1 + max(max(s) for s in codes))


@pytest.mark.parametrize("block, rows", [(shared.BLOCK, shared.ROWS), (50, 3)])
def test_shared_elements_are_counted_whole(monkeypatch, block, rows):
    monkeypatch.setattr(shared, "BLOCK", block)
    monkeypatch.setattr(shared, "ROWS", rows)
    monkeypatch.setattr(shared, "PAIRS", 100)
    rng = np.random.default_rng(7)
    sets = [set((rng.zipf(1.3, rng.integers(1, 500 if i % 3 else 30)) % (900 if i % 2 else 60)).tolist()) for i in range(240)]
    sets += [set(range(40_000)), set(range(100, 39_000)), set(range(300)), set(range(260)), {1}, {1}, {5000}]
    plain = {(i, j): len(x & y) / len(x | y) for i, x in enumerate(sets) for j, y in enumerate(sets) if x & y}
    left, right = np.arange(0, len(sets), 2), np.arange(len(sets))
    for threshold in (0.0, 0.15, 0.5, 1.0):
        got = [pair for i, j, s in shared.similar(packed(sets), left, right, threshold) for pair in zip(i.tolist(), j.tolist(), s.tolist())]
        want = {(i, j, s) for (i, j), s in plain.items() if i % 2 == 0 and s >= threshold}
        assert len(got) == len(set(got)) and set(got) == want, threshold


def test_long_lists_are_passed_over_only_where_they_cannot_decide(monkeypatch):
    rng = np.random.default_rng(8)
    frequent, middle = range(64), range(64, 264)
    sets = [{*rng.choice(frequent, 8).tolist(), *rng.choice(middle, 30).tolist(), *(rng.integers(264, 2000, 60)).tolist()} for _ in range(400)]
    sets = [{*middle}, *sets, {*middle, 1}]  # these two are alike by nothing but long lists
    read, flat = [], shared.flat
    monkeypatch.setattr(shared, "flat", lambda first, sizes: read.append(int(sizes.sum())) or flat(first, sizes))
    monkeypatch.setattr(shared, "WORTH", 1e9)  # one word of bits
    left, right = np.arange(200), np.arange(200, 402)
    got = [(i.tolist(), j.tolist(), s.tolist()) for i, j, s in shared.similar(packed(sets), left, right, 0.5)]
    assert got == [([0], [401], [200 / 201])]
    assert sum(read) < sum(len(sets[i] & sets[j]) for i in left for j in right)


def test_equal_sets_are_one_row_until_they_are_very_many(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "COPIES", 20)
    looked, placed = [], duplicates._placed
    monkeypatch.setattr(duplicates, "_placed", lambda rows, *rest: looked.append(rows) or placed(rows, *rest))
    sets = [["a", "b", "c"]] * 5 + [["c", "b", "a", "a"]] * 5 + [["a", "b"]] * 100 + [["x"], [], None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "id int, s array<string>")
    got = duplicates.all_jaccard_pairs(df, "id", "s", 0.6)
    found = {(r.a, r.b): r.similarity for r in got.collect()}
    assert got.schema["a"].dataType.simpleString() == "int"
    assert found == {(a, b): 1.0 if (a < 10) == (b < 10) else 2 / 3 for a in range(110) for b in range(a + 1, 110)} and got.count() == len(found)
    sizes = sorted(len(r.ids) for r in looked[0].where("size(s) > 0").collect())
    assert len(sizes) <= 7 and sizes[0] == 1 and 10 in sizes and sizes[-1] < 50
    many = spark.range(1000).select("id", F.array((F.col("id") % 7).cast("string")).alias("s"))
    assert duplicates.all_jaccard_pairs(many, "id", "s", 0.5).rdd.getNumPartitions() == 4 * 5 / 2  # one for each pair of groups


def test_all_pairs_keep_the_type_of_ids(spark):
    rows = [("x", ["a", "b"], [1.0, 0.0]), ("y", ["b", "a"], [1.0, 0.0]), ("z", ["c"], [0.0, 1.0])]
    df = spark.createDataFrame(rows, "id string, s array<string>, v array<double>").withColumn("at", F.timestamp_seconds(F.ascii("id")))
    for id, (a, b) in (("id", "xy"), ("at", [r["at"] for r in df.orderBy("id").limit(2).collect()])):
        for pairs in (duplicates.all_jaccard_pairs(df, id, "s", 0.9), duplicates.cosine_pairs(df, id, "v", 0.9)):
            assert [tuple(r) for r in pairs.collect()] == [(a, b, 1.0)] and pairs.schema["a"].dataType == df.schema[id].dataType
        alone = df.where("id > 'x'")  # no pair
        assert duplicates.all_jaccard_pairs(alone, id, "s", 0.9).collect() == duplicates.cosine_pairs(alone, id, "v", 0.9).collect() == []


def test_all_pairs_shuffle_in_proportion_to_the_rows(spark):
    rows = spark.range(500).withColumn("v", F.array(F.lit(1.0)))
    for n in (20_000, 200_000, 1_000_000):
        assert duplicates.dealt(rows, "id", n).count() == 16 * 500
    assert duplicates.dealt(rows, "id", 4_000_000).count() == 62 * 500  # then no group outgrows a task
    odd = spark.createDataFrame([(0, [1.0, 0.0]), (1, None), (None, [1.0, 0.0]), (3, [0.0, 0.0]), (4, [2.0, 0.0]), (5, [None, 1.0])], "id long, v array<float>")
    assert [tuple(r) for r in duplicates.cosine_pairs(odd, "id", "v", 0.9).collect()] == [(0, 4, 1.0)]


def test_vectors_go_as_bytes_once_a_key(spark):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=16)
    vectors = [centre + rng.normal(size=16) * 0.05 for _ in range(700)]
    found = {}
    for name, rows in (("double", vectors), ("single", [v.astype(np.float32) for v in vectors])):
        _, kinds = neighbours.classes(frame(spark, rows), "id", "v")
        pairs = neighbours.hyperplane_pairs(kinds, 0.9)
        plan = pairs._jdf.queryExecution().optimizedPlan().toString()
        assert " codes#" in plan and "Join" not in plan.split("MapInArrow")[0]  # 700 in one bucket are one block
        found[name] = {(r.a, r.b): r.similarity for r in pairs.collect()}
        want = all_pairs(rows, 0.9)
        assert found[name].keys() <= want.keys() and len(found[name]) >= 0.99 * len(want) > 200_000
    assert all(s == pytest.approx(want[p]) for p, s in found["single"].items())

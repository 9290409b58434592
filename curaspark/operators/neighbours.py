"""Near-duplicate signals without looking at all pairs: an index of random hyperplanes over vectors, equal spectrum hashes,
shared fingerprints, and the order in which their verdicts count."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curaspark.functions import spectrum
from curaspark.operators.duplicates import close_rows, jaccard_pairs

#: Bits of a key, share of the pairs at the threshold that are to be found, members of a bucket that stay together.
BITS, RECALL, BLOCK = 12, 0.97, 1 << 14
#: Groups of buckets for each shuffle partition at least, and rows of a group in the mean at most.
SHARDS, SHARD_ROWS = 4, 1 << 15
#: Blocks of crowded buckets that may be broadcast.
BROADCAST_ROWS = 500_000


def bands_for(threshold: float, bits: int = BITS, recall: float = RECALL) -> int:
    """How many keys a vector needs, so that pairs at the threshold share one with the probability asked for."""
    same = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    return 1 if same == 1 else math.ceil(math.log(1 - recall) / math.log(1 - same**bits))


def classes(df: DataFrame, id: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """(id, rep) of every row with a vector, and (rep, v, copies): rows of equal vectors count once, the least id for all."""
    v = F.col(vector).cast("array<double>")
    rows = df.where(F.col(id).isNotNull() & (F.size(vector) > 0)).select(F.col(id).alias("id"), v.alias("v"), F.xxhash64(v).alias("x"), F.xxhash64(F.lit(1), v).alias("y"))
    kinds = rows.groupBy("x", "y").agg(F.min_by("v", "id").alias("v"), F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    return rows.select("id", "x", "y").join(kinds.select("x", "y", "rep"), ["x", "y"]).select("id", "rep"), kinds.select("rep", "v", "copies")


def _packed(rows: np.ndarray) -> pa.Array:
    """Rows of numbers as their bytes."""
    width = rows.shape[1] * rows.itemsize
    offsets = pa.array(np.arange(len(rows) + 1) * width, pa.int32())
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, offsets.buffers()[1], pa.py_buffer(np.ascontiguousarray(rows))])


def _unpacked(packed: pa.Array, size: int) -> np.ndarray:
    """Vectors of so many numbers, of four or eight bytes each."""
    out, narrow = np.empty((len(packed), size)), pc.equal(pc.binary_length(packed), 4 * size).to_numpy(zero_copy_only=False)
    for kind, own in ((np.float32, np.flatnonzero(narrow)), (np.float64, np.flatnonzero(~narrow))):
        if len(own):
            out[own] = np.frombuffer(b"".join(packed.take(pa.array(own)).to_pylist()), kind).reshape(-1, size)
    return out


def _code(bits: int) -> type:
    return np.uint8 if bits <= 8 else np.uint16 if bits <= 16 else np.uint32


def _keys(bands: int, bits: int, seed: int):
    """v as bytes, of single precision where that holds it exactly; codes, the bits of all bands as bytes; and keys."""

    def keys(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
            data = batch.column("v").flatten().to_numpy(zero_copy_only=False)
            first = np.cumsum(sizes) - sizes
            for size in np.unique(sizes):
                if size not in planes:
                    planes[size] = np.random.default_rng([seed, size]).normal(size=(size, bands * bits))
                own = np.flatnonzero(sizes == size)
                rows = data[first[own][:, None] + np.arange(size)]
                code = (rows @ planes[size] > 0).reshape(len(own), bands, bits) @ (1 << np.arange(bits))
                with np.errstate(over="ignore", invalid="ignore"):
                    single = rows.astype(np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * bands, pa.int32()), pa.array((code + (int(size) << bits)).ravel()))
                v = _packed(single if (single == rows).all() else rows)
                yield pa.RecordBatch.from_arrays([batch.column("rep").take(pa.array(own)), v, _packed(code.astype(_code(bits))), lists], ["rep", "v", "codes", "keys"])

    return keys


def hyperplane_pairs(vectors: DataFrame, threshold: float, *, bits: int = BITS, recall: float = RECALL, block: int = BLOCK, seed: int = 42) -> DataFrame:
    """(a, b, similarity), a < b, of vectors (rep, v) whose cosine reaches the threshold, exact for every pair it reports.

    Each vector has ``bands_for(...)`` keys of ``bits`` sides of random hyperplanes; only vectors that share a key are
    compared, so a pair at the threshold is missed with a probability of 1 - recall at most, a closer one less often.
    A vector is shuffled once a key, as bytes. A bucket with more than ``block`` members is dealt into blocks, and each pair
    of its blocks is worked on by itself, so no task holds a bucket; many small buckets are handed to Python together. A pair
    is reported from the first key it shares alone. Vectors of other sizes never meet;
    vectors of zeros have no direction and pair with nothing; reps are distinct.
    """
    bands = bands_for(threshold, bits, recall)
    live = vectors.select("rep", "v").where(F.exists("v", lambda x: x != 0))
    kind = live.schema["rep"].dataType.simpleString()
    keyed = live.mapInArrow(_keys(bands, bits, seed), f"rep {kind}, v binary, codes binary, keys array<long>")
    counts = keyed.select(F.posexplode("keys").alias("band", "key")).groupBy("band", "key").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n"))
    n_rows, n_crowded = counts.agg(F.sum(F.col("n") * F.col("blocks")), F.count_if(F.col("blocks") > 1)).first()
    each = keyed.select("rep", "v", "codes", F.posexplode("keys").alias("band", "key"))
    if n_crowded:
        crowded = counts.where("blocks > 1").drop("n")
        each = each.join(F.broadcast(crowded) if n_crowded <= BROADCAST_ROWS else crowded, ["band", "key"], "left")
        met = each.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    else:
        met = each.withColumns({"blocks": F.lit(1), "own": F.lit(0)})
    dealt = met.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.withColumns({"p": F.least("own", "other"), "q": F.greatest("own", "other")}).drop("other", "blocks")

    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(SHARDS * parts, -(-(n_rows or 0) // SHARD_ROWS))
    shard = F.pmod(F.xxhash64("band", "key", "p", "q"), F.lit(shards)).alias("shard")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).combine_chunks()
        of = [rows[c].to_numpy() for c in ("band", "key", "p", "q")]
        order = np.lexsort(of)
        new = np.any([x[order][1:] != x[order][:-1] for x in of], axis=0)
        reps, own = rows["rep"].to_numpy(), rows["own"].to_numpy()
        v, codes = (rows[c].combine_chunks() for c in ("v", "codes"))
        v, codes = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (v, codes))
        for bucket in np.split(order, np.flatnonzero(new) + 1):
            if len(bucket) < 2:
                continue
            band, key, p, q = (int(x[bucket[0]]) for x in of)
            left, right = bucket[own[bucket] == p], bucket[own[bucket] == q]
            x, y = (_unpacked(v.take(pa.array(side)), key >> bits) for side in (left, right))
            mine, theirs = (np.frombuffer(b"".join(codes.take(pa.array(side)).to_pylist()), _code(bits)).reshape(-1, bands) for side in (left, right))
            for i, j, similarity in close_rows(x, y, threshold):
                a, b = reps[left[i]], reps[right[j]]
                first = (a < b if p == q else a != b) & (np.argmax(mine[i] == theirs[j], axis=1) == band)
                a, b = a[first], b[first]
                low, high = (pa.array(ends, rows["rep"].type) for ends in (np.where(a < b, a, b), np.where(a < b, b, a)))
                yield pa.RecordBatch.from_arrays([low, high, pa.array(similarity[first])], ["a", "b", "similarity"])

    # So many partitions even of few bytes: they are much work.
    return dealt.select("*", shard).repartition(parts, "shard").groupBy("shard").applyInArrow(compare, f"a {kind}, b {kind}, similarity double")


def spectrum_pairs(hashes: DataFrame) -> DataFrame:
    """(a, b, similarity 1) of rows (rep, hash) with equal hashes: each with the least of its group."""
    known = hashes.where("hash IS NOT NULL")
    least = known.groupBy("hash").agg(F.min("rep").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return known.join(least, "hash").where("rep > a").select("a", F.col("rep").alias("b"), F.lit(1.0).alias("similarity"))


def find_duplicates(df: DataFrame, id: str, signal: str, vector: Column, *, threshold: float = 0.9, window: int = 1024, hop: int = 512, bins: int = 128) -> tuple[DataFrame, DataFrame]:
    """(id, rep) of every row, and (a, b, similarity, method_used) of distinct signals that are duplicates.

    Three methods look at every pair they could find: shared fingerprints of windows (Jaccard), equal hashes of the first
    windows' spectra (each with the least rep that has its hash), and the cosine of ``vector``. Of a pair that several
    methods find, the first of them in this order counts. Signals without a full window have neither fingerprints nor a
    hash. Rows without an id or samples have no part; rows with equal samples are one signal, their least id for all.
    """
    members, kinds = classes(df, id, signal)
    held = kinds.select("rep", F.col("v").alias(signal))
    prints = held.select("rep", spectrum.fingerprints(F.col(signal), window, hop, bins).alias("prints"))
    hashes = held.select("rep", spectrum.spectrum_hash(F.col(signal), window, hop, bins).alias("hash"))
    found = [
        ("fingerprint", jaccard_pairs(prints, "rep", "prints", threshold)),
        ("spectrum", spectrum_pairs(hashes)),
        ("embedding", hyperplane_pairs(held.select("rep", vector.alias("v")), threshold)),
    ]
    all_ = None
    for rank, (method, pairs) in enumerate(found):
        told = pairs.select("a", "b", F.struct(F.lit(rank).alias("rank"), "similarity", F.lit(method).alias("method")).alias("told"))
        all_ = told if all_ is None else all_.unionByName(told)
    best = all_.groupBy("a", "b").agg(F.min("told").alias("told"))
    return members, best.select("a", "b", F.col("told.similarity").alias("similarity"), F.col("told.method").alias("method_used"))

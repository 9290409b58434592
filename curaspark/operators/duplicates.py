"""Exact and near duplicates of samples: content hashes, shared fingerprints, vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curaspark.operators import shared

#: Groups that rows are dealt into where all pairs are looked at, rows of a group below which there are fewer groups, and
#: beyond which there are more.
GROUPS, FEW_ROWS, GROUP_ROWS = 16, 256, 1 << 16
#: Rows of a group that are looked at together, on either side; pairs that are worked on and handed back together.
LEFT, RIGHT, PAIRS = 1024, 8192, 1 << 16
#: About so many rows of equal sets are one row with their ids; more are several, so that no task holds them all.
COPIES = 1024
#: Bytes of rows that are packed together for the groups.
PACK_BYTES = 1 << 26


def exact_groups(df: DataFrame, content: Column, id: str) -> DataFrame:
    """(hash, first_id, copies) of contents that occur more than once; only counts and least ids are shuffled."""
    counts = df.groupBy(F.sha2(content, 256).alias("hash")).agg(F.min(id).alias("first_id"), F.count(F.lit(1)).alias("copies"))
    return counts.where("copies > 1")


def jaccard_pairs(df: DataFrame, id: str, elements: str, threshold: float) -> DataFrame:
    """(a, b, similarity) of rows whose element sets are similar enough, by prefixes.

    Elements are put in order of rarity; two sets of a Jaccard similarity t share one of the first n - ceil(t n) + 1.
    So a frequent element hardly ever is an index key, and pairs come from rare ones alone. Empty sets pair with nothing."""
    sets = df.select(F.col(id).alias("id"), F.array_distinct(elements).alias("s")).where(F.size("s") > 0)
    each = sets.select("id", F.size("s").alias("n"), F.explode("s").alias("e"))
    common = each.groupBy("e").agg(F.count(F.lit(1)).alias("df"))
    ordered = each.join(common, "e").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "e"))).alias("o"))
    prefix = F.slice("o", 1, (F.col("n") - F.ceil(F.col("n") * threshold) + 1).cast("int"))
    keys = ordered.select("id", "n", F.explode(F.transform(prefix, lambda x: x["e"])).alias("key"))
    x, y = keys.alias("x"), keys.alias("y")
    meet = (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")) & (F.least("x.n", "y.n") >= F.greatest("x.n", "y.n") * threshold)
    pairs = x.join(y, meet).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    similarity = F.size(F.array_intersect("sa", "sb")) / F.size(F.array_union("sa", "sb"))
    return both.select("a", "b", similarity.alias("similarity")).where(F.col("similarity") >= threshold)


def n_groups(n_rows: int, group_rows: int = GROUP_ROWS) -> int:
    return max(1, min(GROUPS, -(-n_rows // FEW_ROWS)), -(-n_rows // group_rows))


Found = Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]


def _placed(rows: DataFrame, n: int, *by: str) -> DataFrame:
    return rows.withColumn("own", F.pmod(F.xxhash64(*by), F.lit(n)).cast("int"))


def _spread(placed: DataFrame, n: int) -> DataFrame:
    each = placed.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("other"))
    return each.withColumns({"p": F.least("own", "other"), "q": F.greatest("own", "other")}).drop("other")


def dealt(rows: DataFrame, id: str, n_rows: int, group_rows: int = GROUP_ROWS) -> DataFrame:
    """rows with own, their group, and p and q, one row for each pair of groups that their group takes part in.

    There are ``GROUPS`` groups at most while those hold ``group_rows`` rows, so what is shuffled grows with the table."""
    n = n_groups(n_rows, group_rows)
    return _spread(_placed(rows, n, id), n)


def _all_pairs(placed: DataFrame, kind: str, n: int, find: Callable[[pa.Table, int, int], tuple[pa.DataType, Found]]) -> DataFrame:
    """(a, b, similarity), a < b, of all ids against all: each pair of n groups in one task, by find(rows of both groups, group, other group): the ids' type and pairs of ids."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        both = pa.Table.from_batches(held) if held else pa.table({"p": [], "q": []})
        for p, q in sorted(set(zip(both["p"].to_pylist(), both["q"].to_pylist()))):  # one
            id_type, found = find(both.filter((pc.field("p") == p) & (pc.field("q") == q)), p, q)
            for a, b, similarity in found:
                new = a < b if p == q else a != b
                a, b = a[new], b[new]
                low, high = (pa.array(x, id_type) for x in (np.where(a < b, a, b), np.where(a < b, b, a)))
                yield pa.RecordBatch.from_arrays([low, high, pa.array(similarity[new])], ["a", "b", "similarity"])

    pair = (F.col("q") * (F.col("q") + 1) / 2 + F.col("p")).cast("int")
    return _spread(placed, n).repartitionById(n * (n + 1) // 2, pair).mapInArrow(compare, f"a {kind}, b {kind}, similarity double")


def _lists(lists: pa.ChunkedArray) -> tuple[np.ndarray, pa.ChunkedArray]:
    """The lists' lengths, 0 for null, and their values."""
    sizes = [c.value_lengths().fill_null(0).to_numpy() for c in lists.chunks]
    return np.concatenate(sizes).astype(np.int64), pa.chunked_array([c.flatten() for c in lists.chunks], lists.type.value_type)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(own, rows) for rows (own, ids, s): rows of one group as bytes, where each element of their sets is written once."""

    def pack(table: pa.Table) -> pa.RecordBatch:
        own, packs = table["own"].to_numpy(), []
        for group in np.unique(own):
            sizes, elements = _lists(table["s"].take(pa.array(np.flatnonzero(own == group))))
            elements = elements.dictionary_encode()
            codes = pa.DictionaryArray.from_arrays(pa.concat_arrays([c.indices for c in elements.chunks]), elements.chunk(0).dictionary)
            s = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), codes)
            ids = table["ids"].take(pa.array(np.flatnonzero(own == group)))
            new, sink = pa.table({"ids": ids, "s": s}).combine_chunks(), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, new.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(new)
            packs.append((int(group), sink.getvalue().to_pybytes()))
        return pa.RecordBatch.from_arrays([pa.array([g for g, _ in packs], pa.int32()), pa.array([x for _, x in packs], pa.binary())], ["own", "rows"])

    held, n_bytes = [], 0
    for batch in batches:
        held.append(batch)
        n_bytes += batch.nbytes
        if n_bytes >= PACK_BYTES:
            yield pack(pa.Table.from_batches(held))
            held, n_bytes = [], 0
    if sum(batch.num_rows for batch in held):
        yield pack(pa.Table.from_batches(held))


def _unpacked(packs: pa.Table) -> tuple[shared.Sets, np.ndarray, np.ndarray, pa.ChunkedArray]:
    """The sets of packs, the group of each, how many ids it has, and the ids."""
    tables = [pa.ipc.open_stream(x.as_buffer()).read_all() for x in packs["rows"]]
    own = np.repeat(packs["own"].to_numpy(), [t.num_rows for t in tables])
    lists = [_lists(t["s"]) for t in tables]
    words = pa.chunked_array([e.chunk(0).dictionary for _, e in lists]).dictionary_encode()
    codes = np.concatenate([w.indices.to_numpy()[e.chunk(0).indices.to_numpy()] for w, (_, e) in zip(words.chunks, lists)]).astype(np.int64)
    sizes, (n_ids, ids) = np.concatenate([n for n, _ in lists]), _lists(pa.concat_tables([t.select(["ids"]) for t in tables])["ids"])
    return shared.Sets(np.arange(len(sizes)), sizes, codes, len(words.chunk(0).dictionary)), own, n_ids, ids


def _of_copies(i: np.ndarray, j: np.ndarray, similarity: np.ndarray, n_ids: np.ndarray) -> Found:
    """Pairs of rows as pairs of their ids' places; about PAIRS of these at once, or those of one pair of rows."""
    first, n = np.cumsum(n_ids) - n_ids, n_ids[i] * n_ids[j]
    for at in np.split(np.arange(len(i)), np.flatnonzero(np.diff(np.cumsum(n) // PAIRS)) + 1):
        pair = np.repeat(at, n[at])
        k = np.arange(len(pair)) - np.repeat(np.cumsum(n[at]) - n[at], n[at])
        yield first[i[pair]] + k // n_ids[j[pair]], first[j[pair]] + k % n_ids[j[pair]], similarity[pair]


def all_jaccard_pairs(df: DataFrame, id: str, elements: str, threshold: float) -> DataFrame:
    """As jaccard_pairs, by counting what each two sets share: for low thresholds, whose prefixes hold frequent elements.

    Equal sets are compared once. Pairs are never rows before they are similar enough. The work is quadratic; a task holds
    two groups of rows."""
    distinct = F.sort_array(F.array_distinct(F.filter(elements, lambda x: x.isNotNull())))
    known = df.where(F.col(id).isNotNull())
    sets = known.select(F.col(id).alias("id"), distinct.alias("s")).withColumn("h", F.xxhash64("s"))  # empty ones too: a filter would make s twice
    many = sets.groupBy("h").agg(F.ceil(F.count(F.lit(1)) / COPIES).alias("n")).where("n > 1")
    dealt_copies = sets.join(F.broadcast(many), "h", "left").withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce("n", F.lit(1))))
    rows = dealt_copies.groupBy("h", "s", "part").agg(F.collect_list("id").alias("ids"))

    def find(both: pa.Table, p: int, q: int) -> tuple[pa.DataType, Found]:
        held, own, n_ids, ids = _unpacked(both)
        left, right = (np.flatnonzero((own == group) & (held.sizes > 0)) for group in (p, q))
        pairs = (x for found in shared.similar(held, left, right, threshold) for x in _of_copies(*found, n_ids))
        values = ids.to_numpy()
        return ids.type, ((values[x], values[y], near) for x, y, near in pairs)

    n, kind = n_groups(known.count()), df.schema[id].dataType.simpleString()
    packs = _placed(rows, n, "h", "part").select("own", "ids", "s")  # not by ids, which a repeated task may list in another order
    packs = packs.mapInArrow(_packed, "own int, rows binary")
    return _all_pairs(packs, kind, n, find)


def close_rows(x: np.ndarray, y: np.ndarray, threshold: float) -> Found:
    """(i, j, cosine) of rows of x and y that reach the threshold; rounded products find them, exact ones count."""
    with np.errstate(invalid="ignore", over="ignore"):
        x, y = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30) for m in (x, y))
    low = threshold - 1e-6 * max(x.shape[1], 8)
    coarse, others = x.astype(np.float32), y.astype(np.float32)
    for a in range(0, len(x), LEFT):
        for b in range(0, len(y), RIGHT):
            near = (coarse[a : a + LEFT] @ others[b : b + RIGHT].T).ravel()
            hits = np.flatnonzero(near >= low)
            width = min(RIGHT, len(y) - b)
            for k in range(0, len(hits), PAIRS):
                i, j = a + hits[k : k + PAIRS] // width, b + hits[k : k + PAIRS] % width
                similarity = np.einsum("ij,ij->i", x[i], y[j])
                enough = similarity >= threshold
                yield i[enough], j[enough], similarity[enough]


def cosine_pairs(df: DataFrame, id: str, vector: str, threshold: float, block: int = GROUP_ROWS) -> DataFrame:
    """(a, b, similarity) with a < b of all vectors against all, by matrix products of groups of rows.

    Groups of up to ``block`` rows are made by a hash of the id; each pair of them is one task's work. The work is quadratic, as every pair is looked at. Null ids and vectors pair with nothing; other lengths are an error."""
    rows = df.select(F.col(id).alias("id"), F.col(vector).cast("array<float>").alias("v")).where("id is not null and v is not null")

    def find(both: pa.Table, p: int, q: int) -> tuple[pa.DataType, Found]:
        v = both["v"].combine_chunks()
        v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
        sizes = np.unique(v.value_lengths().to_numpy())
        if len(sizes) > 1:
            raise ValueError(f"vectors of {sizes[0]} and of {sizes[-1]} numbers")
        m, ids, own = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1), both["id"].to_numpy(), both["own"].to_numpy()
        a, b = ids[own == p], ids[own == q]
        return both["id"].type, ((a[i], b[j], similarity) for i, j, similarity in close_rows(m[own == p], m[own == q], threshold))

    n = n_groups(rows.count(), block)
    return _all_pairs(_placed(rows, n, "id"), rows.schema["id"].dataType.simpleString(), n, find)


def cascade(pairs: DataFrame, fingerprint: str, spectrum: str, embedding: str, threshold: float) -> DataFrame:
    """Adds similarity, method_used and is_duplicate: the first of three similarities that is not null."""
    similarity = F.coalesce(fingerprint, spectrum, embedding)
    method = F.when(F.col(fingerprint).isNotNull(), "fingerprint").when(F.col(spectrum).isNotNull(), "spectrum").when(F.col(embedding).isNotNull(), "embedding").otherwise("all_failed")
    return pairs.withColumns({"similarity": similarity, "method_used": method, "is_duplicate": F.coalesce(similarity >= threshold, F.lit(False))})

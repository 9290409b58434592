"""N-gram Jaccard join: universe partition with pigeonhole, exact verification, components.

A document is its set of 64-bit hashes of five-word shingles. Sets of equal content collapse to one. Two sets
that link differ in at most D = (r + s) / 9 elements for a similarity of 0.8. At each *level* (a band of sizes,
or the border between two bands) the hash universe is cut into m segments; a set indexes its first
``D + 1 + slack`` segments, so linking sets agree on at least ``slack + 1`` indexed segments. Agreement on empty
segments says nothing, so a set that has more than ``slack`` of them is also indexed under further partitions
until one suits it (drawn from ``round`` number; partners are indexed there as far as their own last round, and
the better-suited of the two decides).

Which segments a set is looked up by is allocated by their cost, the sizes of their buckets: linking sets have so
many segments in common that the first common one, in the order of bucket sizes, lies outside the costliest
``slack`` of either, so these are left out for each set. Agreement on ``slack + 1`` of the segments stands for the
index of segment subsets. One-deletion neighbourhoods are not indexed: they would make one row for each element, 4.5
times as many as segments.

In the buckets left, each set is verified against the set it meets most often as the least of a bucket, then
against members drawn by hash; components form, and only pairs across components remain, of which exact bounds by
sketches leave few to verify.

Defined results: null or blank text has an empty set and links with nothing, component_id is its own id; a null
id gives a row with a null component; rows that repeat an id give a row each and share its links; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curaspark.llm.common import Scratch, join_counted
from curaspark.llm.components import components
from curaspark.llm.shingles import U, Words, mix

WIDTH, PERCENT = 5, 80
#: Rounds in which each set of a bucket is held against one member drawn by a hash.
HUBS = 2
#: Buckets of each set that tell where a pair has met before.
FIRSTS = 32
#: Texts worked on at once: so many at most, of so many bytes together unless a single one is longer.
TEXTS_AT_ONCE, BYTES_AT_ONCE = 2_000, 4 << 20
SET_SCHEMA = "doc_id long, n_shingles long, key1 long, key2 long"
SIGNATURE_SCHEMA = "signature long, doc_id long, entry int, room int, side int"
#: A sketch has four bits of the content of each of 256 segments, sixteen segments a column.
SKETCH = [f"s{i}" for i in range(16)]
SKETCH_SCHEMA = "doc_id long, n long, " + ", ".join(f"{s} long" for s in SKETCH)
HASHES_SCHEMA = "doc_id long, n long, hashes array<long>"


def _pieces(batches: Iterator[pa.RecordBatch], most: int = BYTES_AT_ONCE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, at, held = pc.binary_length(batch.column(1)).to_pylist(), 0, 0
        for i, size in enumerate(sizes):
            if i > at and (held + (size or 0) > most or i - at == TEXTS_AT_ONCE):
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += size or 0
        if sizes:
            yield batch.slice(at)


def _sums(text: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, U)
    np.add.at(out, text, values)
    return out


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in _pieces(batches):
        t, h, n = Words(piece.column(1)).shingle_sets(WIDTH)
        one, two = _sums(t, mix(h), len(n)), _sums(t, mix(h ^ U(0x5851F42D4C957F2D)), len(n))
        yield pa.RecordBatch.from_arrays(
            [piece.column(0), pa.array(n), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))],
            ["doc_id", "n_shingles", "key1", "key2"],
        )


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in _pieces(batches):
        t, h, n = Words(piece.column(1)).shingle_sets(WIDTH)
        offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [piece.column(0), pa.array(n), pa.ListArray.from_arrays(offsets, pa.array(h.view(np.int64)))],
            ["doc_id", "n", "hashes"],
        )


def differences(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The most elements in which linking sets of these sizes differ: 100 * shared >= 80 * union."""
    return (low + high) // 9


def levels(n: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """(set number, level, segments in all, segments to index, slack, side) for bands [2^b, 2^(b+1)) and their borders.

    Bands have even levels, borders odd ones; side is 1 for sets below a border.
    """
    found = []
    sets = np.flatnonzero(n > 0)
    size = n[sets]
    band = np.frexp(size.astype(float))[1] - 1
    for shift in (None, 0, 1):
        if shift is None:  # the set's own band
            which = np.ones(len(size), bool)
            top = (2 << band) - 1
            most, partner, level = differences(top, top), np.minimum(top, 5 * size // 4), 2 * band
        else:  # the border at B = 2^(band + shift), below (1) or above (0) which the set lies
            border = 1 << (band + shift)
            which = (5 * size >= 4 * border) if shift else (4 * size <= 5 * (border - 1)) & (band > 0)
            top = 5 * (border - 1) // 4
            most, level = differences(border - 1, top), 2 * (band + shift) - 1
            partner = np.minimum(top, 5 * size // 4) if shift else border - 1
        slack = (most + 1) // 8
        index = differences(size, partner) + 1 + slack
        m = np.maximum(most + 1 + slack, 1)
        side = np.full(len(size), shift or 0)
        found.append(tuple(x[which] for x in (sets, level, m, np.minimum(index, m), slack, side)))
    return found


def signatures(n: np.ndarray, h: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(set number, signature, entry, room, side) of all non-empty indexed segments; h: the sets' elements in order."""
    first = np.cumsum(n) - n
    for sets, level, m, index, slack, side in levels(n):
        round_ = 0
        while len(sets):
            size = n[sets]
            base = np.cumsum(index) - index
            owner = np.repeat(np.arange(len(sets)), size)
            within = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
            element = h[np.repeat(first[sets], size) + within]
            salt = mix((level * 64 + round_).astype(U) + U(0x2545F4914F6CDD1D))
            value = mix(element ^ salt[owner])
            segment = ((value >> U(20)) % m[owner].astype(U)).astype(np.int64)
            keep = segment < index[owner]
            slot = base[owner[keep]] + segment[keep]
            total = int(index.sum())
            content, filled = _sums(slot, mix(value[keep]), total), np.bincount(slot, minlength=total) > 0
            set_of, segment_of = np.repeat(np.arange(len(sets)), index), np.arange(total) - np.repeat(base, index)
            empty = np.bincount(set_of[~filled], minlength=len(sets))
            out = set_of[filled]
            mark = mix(salt[out] + segment_of[filled].astype(U))
            yield sets[out], mix(content[filled] ^ mark), (level * 64 + round_)[out], (slack - empty)[out], side[out]
            again = empty > slack
            sets, level, m, index, slack, side = (x[again] for x in (sets, level, m, index, slack, side))
            round_ += 1


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in _pieces(batches):
        _, h, n = Words(piece.column(1)).shingle_sets(WIDTH)
        ids = piece.column(0).to_numpy(zero_copy_only=False)
        for sets, signature, entry, room, side in signatures(n, h):
            columns = [pa.array(signature.view(np.int64)), pa.array(ids[sets]), *(pa.array(x.astype(np.int32)) for x in (entry, room, side))]
            yield pa.RecordBatch.from_arrays(columns, ["signature", "doc_id", "entry", "room", "side"])


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in _pieces(batches):
        t, h, n = Words(piece.column(1)).shingle_sets(WIDTH)
        value = mix(h ^ U(0x7F4A7C159E3779B9))
        slots = t.astype(np.int64) * 256 + (value >> U(56)).astype(np.int64)
        bits = mix(_sums(slots, mix(value), len(n) * 256)) >> U(60)
        words = (bits.reshape(-1, 16, 16) << (U(4) * np.arange(16, dtype=U))).sum(axis=2, dtype=U)
        columns = [pa.array(np.ascontiguousarray(words[:, i]).view(np.int64)) for i in range(16)]
        yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(n), *columns], ["doc_id", "n", *SKETCH])


def may_link(x: str, y: str) -> F.Column:
    """Linking sets differ in at most (r + s) / 9 elements, so in no more segments of their sketches."""
    r, s = F.col(f"{x}.n"), F.col(f"{y}.n")

    def unequal(c: str) -> F.Column:
        v = F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))
        v = v.bitwiseOR(F.shiftrightunsigned(v, 1))
        return F.bit_count(v.bitwiseOR(F.shiftrightunsigned(v, 2)).bitwiseAND(F.lit(0x1111_1111_1111_1111)))

    total = unequal(SKETCH[0])
    for c in SKETCH[1:]:
        total = total + unequal(c)
    return (100 * r >= PERCENT * s) & (100 * s >= PERCENT * r) & (9 * total <= r + s)


def verify(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those pairs (a, b) whose sets are similar enough, by exact counts."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("hashes").alias("ha"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("hashes").alias("hb"))
    both = pairs.join(left, "a").join(right, "b")
    fits = (100 * F.col("na") >= percent * F.col("nb")) & (100 * F.col("nb") >= percent * F.col("na"))
    shared = F.size(F.array_intersect("ha", "hb"))
    return both.where(fits).where(100 * shared >= percent * (F.col("na") + F.col("nb") - shared)).select("a", "b")


def near_duplicates(docs: DataFrame, *, id="doc_id", text="text") -> DataFrame:
    """Per row: doc_id, n_shingles and component_id, the smallest id reachable by links."""
    scratch = Scratch(docs.sparkSession, "near")
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sized = scratch.put(rows.mapInArrow(_sets, SET_SCHEMA), "sized")
    full = sized.where("doc_id is not null and n_shingles > 0")
    equal = scratch.put(full.groupBy("n_shingles", "key1", "key2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "equal")
    copies = full.join(equal.where("copies > 1"), ["n_shingles", "key1", "key2"]).where("doc_id <> rep").select("doc_id", "rep").distinct()
    # Ids that several rows with different sets share: all their sets count, and tie their representatives together.
    several = full.groupBy("doc_id").agg(F.min("key1").alias("low"), F.max("key1").alias("high")).where("low < high").select("doc_id")
    several = scratch.put(several, "several")
    copies = scratch.put(copies.join(several, "doc_id", "left_anti"), "copies")
    n_copies = copies.count()
    reps = join_counted(rows.where("doc_id is not null"), copies.select("doc_id"), "doc_id", "left_anti", n_copies)

    # Segments that at least two sets share; at a border, one from either side of it. Counts combine before they are shuffled.
    signed = scratch.put(reps.mapInArrow(_signatures, SIGNATURE_SCHEMA), "signed")
    both_sides = (F.col("entry") % 128 < 64) | (F.col("low") < F.col("high"))
    met = signed.groupBy("signature").agg(
        F.count(F.lit(1)).alias("sets"), F.min("doc_id").alias("least"), F.min("side").alias("low"), F.max("side").alias("high"), F.min("entry").alias("entry")
    )
    met = scratch.put(met.where((F.col("sets") > 1) & both_sides).select("signature", "sets", "least"), "met")
    members = scratch.put(signed.join(met, "signature"), "members")
    scratch.drop("signed")
    # Allocation by cost: linking sets have more than ``room`` of these segments in common, so the first common one, in
    # the order of bucket sizes, is among all but the last ``room`` of either. The costliest buckets are left out.
    own = Window.partitionBy("doc_id", "entry")
    ranked = members.select("*", F.row_number().over(own.orderBy("sets", "signature")).alias("place"), F.count(F.lit(1)).over(own).alias("met"))
    useful = ranked.where(F.col("place") <= F.col("met") - F.greatest("room", F.lit(0))).select("signature", "doc_id", "entry", "side", "sets", "least")
    useful = scratch.put(useful, "useful")
    scratch.drop("members")

    # First each set against the set it meets most often as the least of a bucket.
    star = useful.where("least < doc_id").groupBy("doc_id", "least").agg(F.count(F.lit(1)).alias("times"))
    star = star.where("times > 1").groupBy("doc_id").agg(F.max_by("least", F.struct("times", -F.col("least"))).alias("a")).select("a", F.col("doc_id").alias("b"))
    star = scratch.put(star, "star")
    one = scratch.put(verify(star, _sets_of(rows, star, scratch, "star_sets")), "links1")

    # Then, in each bucket with several components, against one more member drawn by a hash, which then leaves the bucket.
    links, tried, left = one, star, useful
    for r in range(HUBS + 1):
        part = components(links, scratch, f"cc{r}")
        home = left.join(part.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
        home = scratch.put(home.select("signature", "entry", "side", "doc_id", "component"), f"home{r}")
        drawn = F.struct(F.xxhash64("doc_id", "signature", F.lit(r)).alias("h"), "doc_id", "component", "side")
        hub = home.groupBy("signature").agg(F.min(drawn).alias("hub"), F.min("component").alias("low"), F.max("component").alias("high"))
        hub = scratch.put(hub.where("low < high").select("signature", F.col("hub.doc_id").alias("hub"), F.col("hub.component").alias("to"), F.col("hub.side").alias("hub_side")), f"hubs{r}")
        left = home.join(hub, "signature")
        if r == HUBS:
            break
        # At a border, two sets on one side are left to the level of their own band.
        pairs = left.where((F.col("component") != F.col("to")) & ((F.col("entry") % 128 < 64) | (F.col("side") != F.col("hub_side"))))
        pairs = pairs.select(F.least("doc_id", "hub").alias("a"), F.greatest("doc_id", "hub").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
        pairs = scratch.put(pairs, f"pairs{r}")
        more = scratch.put(verify(pairs, _sets_of(rows, pairs, scratch, f"sets{r}")), f"more{r}")
        links, tried = links.unionByName(more), tried.unionByName(pairs)
        left = left.where("doc_id <> hub").select("signature", "entry", "side", "doc_id")

    # Last, what lies in one bucket but still in different components.
    home = scratch.put(left.drop("hub", "to", "hub_side"), "apart")
    # Pairs whose sketches differ in more segments than linking sets can never become rows.
    ids = scratch.put(home.select("doc_id").distinct(), "apart_ids")
    picked = join_counted(rows, ids, "doc_id", "left_semi", ids.count())
    sketches = scratch.put(picked.mapInArrow(_sketches, SKETCH_SCHEMA).distinct(), "sketches")
    # A pair meets in the least of its buckets, as far as the first ones of both tell.
    firsts = home.groupBy("doc_id", "entry").agg(F.slice(F.array_sort(F.collect_set("signature")), 1, FIRSTS).alias("firsts"))
    home = scratch.put(home.join(firsts, ["doc_id", "entry"]).join(sketches, "doc_id"), "sketched")
    x, y = home.alias("x"), home.alias("y")
    level = (F.col("x.entry") % 128 < 64) | (F.col("x.side") != F.col("y.side"))
    meet = may_link("x", "y") & (F.col("x.signature") == F.col("y.signature")) & (F.col("x.doc_id") < F.col("y.doc_id")) & (F.col("x.component") != F.col("y.component")) & level
    meet = meet & F.coalesce(F.array_min(F.array_intersect("x.firsts", "y.firsts")) >= F.col("x.signature"), F.lit(True))
    pairs = x.join(y, meet).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"))
    cross = scratch.put(pairs.distinct().join(tried, ["a", "b"], "left_anti"), "cross")
    two = verify(cross, _sets_of(rows, cross, scratch, "cross_sets"))
    tied = full.join(several, "doc_id").join(equal, ["n_shingles", "key1", "key2"]).select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    linked = components(scratch.put(links.unionByName(two).unionByName(tied), "links"), scratch, "cc_all")

    # Back to documents: the copies of a set share its component.
    home_of = equal.join(linked, F.col("rep") == F.col("node"), "left").select("n_shingles", "key1", "key2", F.coalesce("component", "rep").alias("of_set"))
    home_of = scratch.put(home_of, "home_of")
    scratch.keep("sized", "home_of")  # the result reads no other
    keyed = sized.join(home_of, ["n_shingles", "key1", "key2"], "left")
    return keyed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("of_set", "doc_id")).alias("component_id"))


def _sets_of(rows: DataFrame, pairs: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    ids = scratch.put(ids, f"{name}_ids")
    picked = join_counted(rows, ids, "doc_id", "left_semi", ids.count())
    return scratch.put(picked.mapInArrow(_hashes, HASHES_SCHEMA).distinct(), name)

"""Suffix-array dedup: bytes covered by a 50-byte string that also starts in a document with a smaller id.

Distributed prefix doubling. A full suffix array of every byte position would sort all positions many times;
only *sampled* suffixes take part: of every 50-byte string the position of its smallest 20-byte hash (the
minimizer), about one position in fifteen. Equal strings sample equal positions, so no repeat is missed.

1. The rank of a sampled suffix is the hash of its first 20 bytes. Spark sorts suffixes by rank; a rank found
   in one document only is unique and drops out.
2. The remaining suffixes take the pair (rank, rank of everything within 50 bytes either side). Where a smaller
   document has the equal pair, all strings of that suffix repeat: one span, past the threshold.
3. Suffixes that come first under their pair but not under their rank are reranked by the pair of their first
   rank with the 15 bytes before it, and with the 15 bytes after: every 50-byte string spans one of both. Those
   unique under both drop out.
4. The rest is at the threshold: their 50-byte strings themselves are grouped, the smallest document keeps each.

Defined results: null text is empty, texts under 50 bytes lose nothing; rows that repeat an id are one
document's parts, so matches between them remove nothing; a null id takes no part and keeps its bytes; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curaspark.llm.common import Scratch
from curaspark.llm.near import _pieces
from curaspark.llm.shingles import _BYTE, U, mix, powers

LENGTH, PREFIX = 50, 20
SIDE = LENGTH - PREFIX
HALF = SIDE // 2
SUFFIX_SCHEMA = "rank long, around long, doc_id long, at int"
RESULT_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
KEY_SCHEMA = "doc_id long, at int, key long"


class Bytes:
    """The bytes of some texts, with hashes of ranges."""

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        self.first = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(raw), np.uint8)
        n = len(self.data)
        up, self.down = powers(n + 1)
        self.prefix = np.zeros(n + 1, U)
        np.cumsum(_BYTE[self.data] * up[:n], out=self.prefix[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.down[start])

    def samples(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions (in all bytes) of the minimizers of all 50-byte strings within a text, and their texts."""
        n = len(self.data)
        if n < LENGTH:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        start = np.arange(n - PREFIX + 1)
        h = self.hash(start, start + PREFIX)
        width, least, size = SIDE + 1, h, 1
        while size < width:  # the minimum of each window, by windows of doubled sizes
            step = min(size, width - size)
            least = np.minimum(least[:-step], least[step:])
            size += step
        text = np.repeat(np.arange(len(self.sizes)), self.sizes)
        inside = text[: len(least)] == text[LENGTH - 1 :]
        taken = np.zeros(len(h), bool)
        for o in range(width):
            taken[o : o + len(least)] |= (h[o : o + len(least)] == least) & inside
        at = np.flatnonzero(taken)
        return at, text[at]


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in _pieces(batches):
        b = Bytes(piece.column(1).to_pylist())
        at, text = b.samples()
        start, end = b.first[text], b.first[text] + b.sizes[text]
        low, high = np.maximum(at - SIDE, start), np.minimum(at + LENGTH, end)
        around = mix(b.hash(low, high) + (at - low).astype(U) * U(0xD6E8FEB86659FD93) + (high - at).astype(U))
        ids = piece.column(0).to_numpy(zero_copy_only=False)[text]
        rank = b.hash(at, at + PREFIX)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rank.view(np.int64)), pa.array(around.view(np.int64)), pa.array(ids), pa.array((at - start).astype(np.int32))],
            ["rank", "around", "doc_id", "at"],
        )


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, at, key) for the reranking of step 3: the rank joined with either side; sides cut by a text's end give none."""
    for piece in _pieces(batches):
        b = Bytes(piece.column(1).to_pylist())
        lists = piece.column(2)
        owner = np.repeat(np.arange(piece.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
        at = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + b.first[owner]
        start, end = b.first[owner], b.first[owner] + b.sizes[owner]
        ids = piece.column(0).to_numpy(zero_copy_only=False)[owner]
        out = []
        for low, high, mark in ((at - HALF, at + PREFIX, 1), (at, at + PREFIX + HALF, 2)):
            ok = (low >= start) & (high <= end)
            out.append((ids[ok], (at - start)[ok], mix(b.hash(low[ok], high[ok]) + U(mark))))
        ids, at, key = (np.concatenate(x) for x in zip(*out))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(at.astype(np.int32)), pa.array(key.view(np.int64))], ["doc_id", "at", "key"])


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, at, key) of all 50-byte strings that hold the prefix of a listed suffix."""
    for piece in _pieces(batches):
        b = Bytes(piece.column(1).to_pylist())
        lists = piece.column(2)
        owner = np.repeat(np.arange(piece.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
        at = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + b.first[owner]
        low = np.maximum(at - SIDE, b.first[owner])
        high = np.minimum(at, b.first[owner] + b.sizes[owner] - LENGTH)
        n = np.maximum(high - low + 1, 0)
        which = np.repeat(np.arange(len(at)), n)
        start = low[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        start, first = np.unique(start, return_index=True)
        owner = owner[which][first]
        ids = piece.column(0).to_numpy(zero_copy_only=False)[owner]
        key = b.hash(start, start + LENGTH)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array((start - b.first[owner]).astype(np.int32)), pa.array(key.view(np.int64))], ["doc_id", "at", "key"]
        )


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans with those that touch or overlap made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut(text: str, starts: list[int] | None, ends: list[int] | None) -> tuple[int, int, int, str, bytes]:
    raw = text.encode("utf-8", "surrogatepass")
    spans = merge([(max(a, 0), min(b, len(raw))) for a, b in zip(starts or [], ends or [])])
    kept, done = [], 0
    for a, b in spans:
        kept.append(raw[done:a])
        done = b
    left = b"".join([*kept, raw[done:]])
    return len(raw), len(raw) - len(left), len(spans), hashlib.sha256(left).hexdigest(), left


def _cut_with_kept(batches: Iterator[pa.RecordBatch], kept: bool = True) -> Iterator[pa.RecordBatch]:
    fields = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())]
    fields = fields if kept else fields[:-1]
    for batch in _pieces(batches):
        rows = [cut(*x)[: len(fields)] for x in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)))]
        columns = list(zip(*rows)) or [()] * len(fields)
        arrays = [pa.array(c, k) for c, (_, k) in zip(columns, fields)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", *(n for n, _ in fields)])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _cut_with_kept(batches, kept=False)


def repeated_spans(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows(doc_id, text) to (doc_id, start, end): spans to remove, in bytes, overlaps included; ends may pass the text."""
    by_rank, by_pair = Window.partitionBy("rank"), Window.partitionBy("rank", "around")
    # Step 1. One sort by (rank, around) serves both windows.
    ranked = rows.mapInArrow(_suffixes, SUFFIX_SCHEMA).repartition("rank").sortWithinPartitions("rank", "around")
    least, most = F.min("doc_id").over(by_rank), F.max("doc_id").over(by_rank)
    differ = F.min("around").over(by_rank) != F.max("around").over(by_rank)
    ranked = ranked.select("*", least.alias("least"), most.alias("most"), differ.alias("differ")).where("least <> most")
    ranked = scratch.put(ranked.select("doc_id", "at", F.min("doc_id").over(by_pair).alias("owner"), "differ"), "ranked")
    # Step 2.
    equal = ranked.where("owner < doc_id").select("doc_id", (F.col("at") - SIDE).alias("start"), (F.col("at") + LENGTH).alias("end"))
    # Step 3, on what comes first under its pair.
    positions = F.sort_array(F.collect_set("at")).alias("ats")
    listed = ranked.where("owner = doc_id and differ").groupBy("doc_id").agg(positions)
    keys = rows.join(listed, "doc_id").select("doc_id", "text", "ats").mapInArrow(_halves, KEY_SCHEMA)
    by_key = Window.partitionBy("key")
    keys = keys.select("doc_id", "at", (F.min("doc_id").over(by_key) != F.max("doc_id").over(by_key)).alias("met"))
    met = scratch.put(keys.where("met").groupBy("doc_id").agg(positions), "met")
    # Step 4.
    strings = rows.join(met, "doc_id").select("doc_id", "text", "ats").mapInArrow(_strings, KEY_SCHEMA)
    strings = strings.select("doc_id", "at", F.min("doc_id").over(by_key).alias("owner")).where("owner < doc_id")
    strings = scratch.put(strings.select("doc_id", F.col("at").alias("start"), (F.col("at") + LENGTH).alias("end")), "strings")
    return equal.unionByName(strings)


def remove_repeats(docs: DataFrame, *, id="doc_id", text="text", with_kept=False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept: the remaining bytes."""
    scratch = Scratch(docs.sparkSession, "repeats")
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    named, unnamed = rows.where("doc_id is not null"), rows.where("doc_id is null")
    spans = repeated_spans(named, scratch)
    spans = spans.groupBy("doc_id").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    held = named.join(spans, "doc_id", "left").select("doc_id", "text", "starts", "ends")
    none = F.lit(None).cast("array<int>")
    held = held.unionByName(unnamed.select("doc_id", "text", none.alias("starts"), none.alias("ends")))
    return held.mapInArrow(_cut_with_kept, RESULT_SCHEMA + ", kept binary") if with_kept else held.mapInArrow(_cut, RESULT_SCHEMA)

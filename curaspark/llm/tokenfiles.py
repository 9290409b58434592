"""Token ids in files of Simple-8b blocks, as a Spark data source: ``write_ids`` and ``read_ids``.

A folder holds files and ``_manifest.json``, which lists the files in the order of their documents, with how many
documents and ids each has and how many ids stand before it. A file holds blocks of three columns (token ids, tokens of
each document, steps from one doc_id to the next), an index with each block's column, byte offset, values, words and
escapes, and a trailer. So any stretch of ids is read by its blocks alone, and a file's documents are decoded in bulk.

Tasks write files under names of their own attempt and hand their sizes to the driver; only files of successful
attempts come into the manifest, and what another attempt left is deleted. Files end at ``FILE_IDS`` ids or ``FILE_DOCS``
documents, and a task holds one file's blocks in the making, never its whole partition.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as files
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from curaspark.llm.common import text_of
from curaspark.llm.near import _pieces
from curaspark.llm.simple8b import BLOCK, Packed, pack, unpack

U = np.uint64
MAGIC = b"S8BIDS01"
IDS, SIZES, STEPS = 0, 1, 2
INDEX = np.dtype([("column", "<i8"), ("offset", "<i8"), ("values", "<i8"), ("words", "<i8"), ("escapes", "<i8")])
TRAILER = np.dtype([("blocks", "<i8"), ("index", "<i8"), ("docs", "<i8"), ("nulls", "<i8"), ("ids", "<i8"), ("magic", "S8")])
#: Most ids and documents of a file, and ids that are packed or read at a time.
FILE_IDS, FILE_DOCS, AT_ONCE = 1 << 24, 1 << 20, BLOCK << 7
SCHEMA = "doc_id bigint, start bigint, n_tokens bigint, ids array<bigint>"
ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int64()))])


def opened(folder: str) -> tuple[files.FileSystem, str]:
    return files.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/(?!/)", "file:///", folder)))


class Maker:
    """One file in the making: ids, documents' sizes and doc_ids go in; full blocks go out at once."""

    def __init__(self, place: files.FileSystem, path: str):
        self.out, self.index = place.open_output_stream(path), []
        self.out.write(MAGIC)
        self.at, self.ids, self.waiting, self.sizes, self.docs, self.nulls = len(MAGIC), 0, [], [], [], 0

    def _blocks(self, column: int, values: np.ndarray) -> None:
        p = pack(values)
        w, e = np.cumsum(p.n_words), np.cumsum(p.n_escapes)
        for i in range(len(p.n_values)):
            held = p.words[w[i] - p.n_words[i] : w[i]].astype("<u8").tobytes() + p.escapes[e[i] - p.n_escapes[i] : e[i]].astype("<u8").tobytes()
            self.index.append((column, self.at, p.n_values[i], p.n_words[i], p.n_escapes[i]))
            self.out.write(held)
            self.at += len(held)

    def add(self, doc_ids: pa.Array, sizes: np.ndarray, ids: np.ndarray) -> None:
        if doc_ids.null_count and (any(map(len, self.docs)) or doc_ids[: doc_ids.null_count].null_count < doc_ids.null_count):
            raise ValueError("documents without an id come first")
        self.nulls += doc_ids.null_count
        self.docs.append(doc_ids.drop_null().to_numpy(zero_copy_only=False).astype(np.int64))  # a copy: the batch goes
        self.sizes.append(sizes.copy())
        self.waiting.append(ids)
        self.ids += len(ids)
        if sum(map(len, self.waiting)) >= AT_ONCE:
            self._flush(False)

    def _flush(self, all_: bool) -> None:
        held = np.concatenate([*self.waiting, np.zeros(0, np.int64)]).astype(U)
        full = len(held) if all_ else len(held) // BLOCK * BLOCK
        for i in range(0, full, AT_ONCE):
            self._blocks(IDS, held[i : min(full, i + AT_ONCE)])
        self.waiting = [held[full:]]

    def close(self) -> tuple[int, int]:
        self._flush(True)
        known, sizes = np.concatenate(self.docs), np.concatenate(self.sizes)
        self._blocks(SIZES, sizes.astype(U))
        self._blocks(STEPS, np.diff(known.view(U), prepend=U(0)))  # modulo 2^64, so negative ids are no matter
        end = np.array([(len(self.index), self.at, len(sizes), self.nulls, self.ids, MAGIC)], TRAILER)
        self.out.write(np.array(self.index, INDEX).tobytes() + end.tobytes())
        self.out.close()
        return len(sizes), self.ids


class Held:
    """A file to read: ``values`` gives any stretch of a column by the blocks that cover it."""

    def __init__(self, place: files.FileSystem, path: str):
        self.file = place.open_input_file(path)
        size = self.file.size()
        self.end = np.frombuffer(self.file.read_at(TRAILER.itemsize, size - TRAILER.itemsize), TRAILER)[0]
        if self.end["magic"] != MAGIC:
            raise ValueError(f"{path} is no file of token ids")
        self.index = np.frombuffer(self.file.read_at(int(self.end["blocks"]) * INDEX.itemsize, int(self.end["index"])), INDEX)

    def values(self, column: int, start: int, stop: int) -> np.ndarray:
        own = self.index[self.index["column"] == column][start // BLOCK : -(-stop // BLOCK)]
        if stop <= start or not len(own):
            return np.zeros(0, U)
        offset, last = int(own["offset"][0]), own[-1]
        data = np.frombuffer(self.file.read_at(int(last["offset"] + 8 * (last["words"] + last["escapes"])) - offset, offset), "<u8").astype(U)
        both = np.stack([own["words"], own["escapes"]], axis=1)
        of = np.repeat(np.tile([False, True], len(own)), both.ravel())  # words and escapes take turns, block by block
        got = unpack(Packed(data[~of], data[of], own["values"], own["words"], own["escapes"]))
        return got[start - start // BLOCK * BLOCK :][: stop - start]

    def doc_ids(self) -> pa.Array:
        known = np.cumsum(self.values(STEPS, 0, int(self.end["docs"] - self.end["nulls"]))).view(np.int64)
        return pa.concat_arrays([pa.nulls(int(self.end["nulls"]), pa.int64()), pa.array(known, pa.int64())])

    def batches(self, start: int) -> Iterator[pa.RecordBatch]:
        """All documents, some ids at a time; start: ids before this file."""
        doc_ids, sizes = self.doc_ids(), self.values(SIZES, 0, int(self.end["docs"])).astype(np.int64)
        ends = np.cumsum(sizes)
        i = 0
        while i < len(sizes):
            first = int(ends[i] - sizes[i])
            j = max(i + 1, int(np.searchsorted(ends, first + AT_ONCE, "right")))
            ids = self.values(IDS, first, int(ends[j - 1])).astype(np.int64)
            offsets = np.concatenate([[0], ends[i:j] - first])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int64()))
            yield pa.RecordBatch.from_arrays([doc_ids[i:j], pa.array(start + ends[i:j] - sizes[i:j]), pa.array(sizes[i:j]), lists], schema=ARROW)
            i = j


@dataclass
class Written(WriterCommitMessage):
    partition: int
    files: list  # of name, documents, ids


class IdWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, tokenizer: str | None, end: int | None):
        self.folder, self.tokenizer, self.end = folder, tokenizer, end

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        place, root = opened(self.folder)
        place.create_dir(root, recursive=True)
        partition, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        names, done, now, docs = [], [], None, 0
        held = _encode(iterator, self.tokenizer, self.end) if self.tokenizer else iterator
        try:
            for batch in held:
                sizes = batch.column("ids").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                ids = batch.column("ids").flatten().to_numpy(zero_copy_only=False)
                ends, i = np.cumsum(sizes), 0
                while i < len(sizes):  # as many documents as the file still takes, one at least
                    if now is None:
                        names.append(f"part-{partition:06d}-{len(names):04d}-{attempt}.s8b")
                        now, docs = Maker(place, f"{root}/{names[-1]}"), 0
                    first = int(ends[i] - sizes[i])
                    j = min(max(i + 1, int(np.searchsorted(ends, first + FILE_IDS - now.ids, "right"))), i + FILE_DOCS - docs)
                    now.add(batch.column("doc_id")[i:j], sizes[i:j], ids[first : ends[j - 1]])
                    docs, i = docs + j - i, j
                    if now.ids >= FILE_IDS or docs >= FILE_DOCS:
                        done.append((names[-1], *now.close()))
                        now = None
            if now:
                done.append((names[-1], *now.close()))
        except BaseException:
            for name in names:
                place.delete_file(f"{root}/{name}")
            raise
        return Written(partition, done)

    def commit(self, messages: list) -> None:
        place, root = opened(self.folder)
        place.create_dir(root, recursive=True)
        held = [(m.partition, *f) for m in messages if m for f in m.files]
        known, start = [], 0
        for _, name, docs, ids in sorted(held):
            known.append({"file": name, "docs": docs, "ids": ids, "start": start})
            start += ids
        self._clear(place, root, {f["file"] for f in known})
        with place.open_output_stream(f"{root}/_manifest.json") as out:
            out.write(json.dumps(known).encode())

    def abort(self, messages: list) -> None:
        place, root = opened(self.folder)
        for m in messages:
            for name, *_ in m.files if m else []:
                place.delete_file(f"{root}/{name}")

    @staticmethod
    def _clear(place: files.FileSystem, root: str, keep: set[str]) -> None:
        for f in place.get_file_info(files.FileSelector(root)):
            if f.base_name.endswith(".s8b") and f.base_name not in keep:
                place.delete_file(f.path)


class IdReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        place, root = opened(self.folder)
        with place.open_input_stream(f"{root}/_manifest.json") as held:
            known = json.loads(held.read())
        return [InputPartition((f["file"], f["start"])) for f in known] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value:
            place, root = opened(self.folder)
            name, start = partition.value
            yield from Held(place, f"{root}/{name}").batches(start)


class TokenIds(DataSource):
    """``spark.read.format("token_ids")`` and ``df.write.format("token_ids").mode("overwrite")``; the path is a folder.

    Rows to write are doc_id and ids, or doc_id and text with the option ``tokenizer`` (a file) and perhaps ``end`` (an id)."""

    @classmethod
    def name(cls) -> str:
        return "token_ids"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> IdReader:
        return IdReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> IdWriter:
        if not overwrite:
            raise ValueError("a folder of token ids is written as a whole: use mode('overwrite')")
        end = self.options.get("end")
        return IdWriter(self.options["path"], self.options.get("tokenizer"), None if end is None else int(end))


#: Spark's setting of the bytes that are handed to Python at a time.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Pieces whose ids a worker remembers at most, in each of two generations; bytes of a text that is joined for encoding.
HELD, JOINED = 150_000, 100_000
#: What may be a blank to the tokenizer, and more, so that a single blank between two other characters is sure to begin a
#: piece of text of its own, whatever stands before it.
_DOUBT = r"\s\x00-\x20\x7f-\xa0 ᠎ -⁯　﻿"
_DOUBTS = frozenset(c for c in map(chr, range(0x10000)) if re.match(f"[{_DOUBT}]", c))
_SURE = re.compile(f"(?<=[^{_DOUBT}]) (?=[^{_DOUBT}])")


class Encoder:
    """The ids of texts. Pieces between single blanks are split off and told apart by Arrow, encoded once and remembered;
    those that are new are joined for the library, as each begins with the only blank it holds."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks run side by side already
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.older = Tokenizer.from_file(path), {}, {}
        self.begins = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        self.begins[[i for token, i in self.tokenizer.get_vocab().items() if token.startswith("Ġ")]] = True  # a blank

    def each(self, texts: list[str], at_once: int = 256) -> list[bytes]:
        """Of every text by itself; the library's own results, which are large, are held for some texts at a time."""
        out: list[bytes] = []
        for i in range(0, len(texts), at_once):
            out += [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts[i : i + at_once], add_special_tokens=False)]
        return out

    def _joined(self, pieces: list[str]) -> list[bytes]:
        """Of pieces without a blank, each after one; joined to long texts and cut again where a token begins with a blank."""
        sizes = np.cumsum([len(p) + 1 for p in pieces])
        cuts = [0, *(np.flatnonzero(np.diff(sizes // JOINED)) + 1).tolist(), len(pieces)]
        out: list[bytes] = []
        texts = ["".join([" " + p for p in pieces[a:b]]) for a, b in zip(cuts, cuts[1:])]
        for a, b, held in zip(cuts, cuts[1:], self.each(texts, 1)):
            starts = np.flatnonzero(self.begins[np.frombuffer(held, "<u4")])
            if len(starts) == b - a:
                ends = [*(4 * starts[1:]).tolist(), len(held)]
                out += [held[4 * i : j] for i, j in zip(starts.tolist(), ends)]
            else:
                out += self.each([" " + p for p in pieces[a:b]])
        return out

    def _remembered(self, pieces: list[str], encode: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """What each piece is encoded to; b"" for pieces that encode leaves out, which are none that anything is."""
        if len(self.known) > HELD:
            self.known, self.older = {}, self.known
        held = list(map(self.known.get, pieces))
        new = [i for i, v in enumerate(held) if v is None]
        for i in new:
            held[i] = self.older.get(pieces[i])
        self.known.update((pieces[i], held[i]) for i in new if held[i] is not None)
        new = [i for i in new if held[i] is None]
        for i, v in zip(new, encode([pieces[i] for i in new]) if new else []):
            held[i] = self.known[pieces[i]] = v
        return held

    def _sound(self, pieces: list[str]) -> list[bytes]:
        """As _joined, with b"" for pieces that are empty or have an end that may be a blank."""
        sound = [bool(p) and p[0] not in _DOUBTS and p[-1] not in _DOUBTS for p in pieces]
        done = iter(self._joined([p for p, ok in zip(pieces, sound) if ok]))
        return [next(done) if ok else b"" for ok in sound]

    def _rough(self, text: str) -> bytes:
        """Of a text with other blanks than single ones between other characters."""
        first, *rest = _SURE.split(text)
        return b"".join([*self.each([first]), *self._remembered([" " + p for p in rest], self.each)])

    def encode(self, texts: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """All ids, text by text, and how many each text has; null texts are empty; ``end`` follows each."""
        texts = texts.fill_null("").cast(pa.large_string())
        split = pc.split_pattern(texts, " ")
        counts = split.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        held = split.flatten().dictionary_encode()
        codes, pieces = held.indices.to_numpy(zero_copy_only=False), held.dictionary.to_numpy(zero_copy_only=False).tolist()
        first, of = np.cumsum(counts) - counts, np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        inner = np.ones(len(codes), bool)
        inner[first] = False
        wanted = np.zeros(len(pieces), bool)
        wanted[codes[inner]] = True
        wanted = np.flatnonzero(wanted)
        pool = self._remembered([pieces[c] for c in wanted], self._sound)
        # Texts that hold a piece which is empty or has a doubtful end are rough; the first one's front is no matter.
        bad = np.zeros(len(pieces), bool)
        bad[wanted[[not v for v in pool]]] = True
        whole = [pieces[c] for c in codes[first]]
        rough = np.bincount(of[bad[codes] & inner], minlength=len(counts)) > 0
        rough |= np.array([n > 1 and (not w or w[-1] in _DOUBTS) for n, w in zip(counts.tolist(), whole)], bool)
        inner &= ~rough[of]
        pool += self.each(["" if r else w for r, w in zip(rough, whole)])
        for i in np.flatnonzero(rough):
            pool[len(wanted) + i] = self._rough(texts[int(i)].as_py())
        pool.append(b"" if end is None else np.array([end], "<u4").tobytes())
        # Which parts of the pool follow each other: a text's first piece, its others, its end.
        place = np.full(len(pieces), -1)
        place[wanted] = np.arange(len(wanted))
        parts, at = np.full(len(codes) + len(counts), len(pool) - 1), np.arange(len(codes)) + of
        parts[at] = np.where(inner, place[codes], len(pool) - 1)
        parts[at[first]] = len(wanted) + np.arange(len(counts))
        ends = at[first] + counts
        used = np.zeros(len(parts), bool)
        used[at[inner]] = used[at[first]] = used[ends] = True
        sizes = np.array([len(b) // 4 for b in pool])
        starts = np.cumsum(sizes) - sizes
        size = np.where(used, sizes[parts], 0)
        done = np.cumsum(size)
        data = np.frombuffer(b"".join(pool), "<u4")
        ids = data[np.repeat(starts[parts] - (done - size), size) + np.arange(done[-1] if len(done) else 0)]
        return ids, np.diff(done[ends], prepend=0)


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def _encode(batches: Iterator[pa.RecordBatch], path: str, end: int | None) -> Iterator[pa.RecordBatch]:
    for piece in _pieces(batches, 6_000_000):
        ids, sizes = _encoder(path).encode(piece.column(1), end)
        pa.default_memory_pool().release_unused()
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        yield pa.RecordBatch.from_arrays([piece.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int64()))], ["doc_id", "ids"])


def ordered(docs: DataFrame) -> DataFrame:
    """doc_id and text in ascending doc_id order, by ranges: null ids first, rows that share an id by a hash of their text."""
    rows = docs.select("doc_id", text_of().alias("text"), F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("k"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("h"), F.col("k")]  # the row number only lets ranges divide copies of a row
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")


def tokenize(docs: DataFrame, path: str, end: int | None = 0) -> DataFrame:
    """doc_id and ids of each document under a byte-level vocabulary of the tokenizers library, in the order of docs.

    Null and empty texts have the end id alone, or none; other columns are left out; an empty table gives none."""
    return docs.select("doc_id", "text").mapInArrow(lambda batches: _encode(batches, path, end), "doc_id bigint, ids array<bigint>")


def _folder(spark: SparkSession, path: str) -> str:
    """The path with its scheme, also where it leaves the default one out."""
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    return held.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(held).toString()


def write_ids(rows: DataFrame, folder: str) -> None:
    """rows (doc_id bigint, ids array<bigint>) as they are ordered, partition after partition, into a folder of files."""
    spark = rows.sparkSession
    spark.dataSource.register(TokenIds)
    rows.select("doc_id", "ids").write.format("token_ids").mode("overwrite").save(_folder(spark, folder))


def write_texts(docs: DataFrame, folder: str, path: str, end: int = 0) -> None:
    """The documents' ids, each followed by the end id, in ascending doc_id order, into a folder of files.

    Texts are dealt out by ranges of doc_id and encoded by the tasks that write them, so texts are shuffled once and ids
    never. Null and empty texts have the end id alone. Null ids come first; rows that repeat an id stay apart, ordered by
    a hash of their text; rows that repeat both are alike. Other columns are left out. An empty table gives no file.
    """
    spark = docs.sparkSession
    spark.dataSource.register(TokenIds)
    writer = ordered(docs).write.format("token_ids").mode("overwrite").option("tokenizer", path).option("end", str(end))
    before = spark.conf.get(BATCH_BYTES)
    spark.conf.set(BATCH_BYTES, "4m")  # a worker holds a batch of texts and all that is made of it
    try:
        writer.save(_folder(spark, folder))
    finally:
        spark.conf.set(BATCH_BYTES, before)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids, from the files."""
    spark.dataSource.register(TokenIds)
    return spark.read.format("token_ids").load(_folder(spark, folder))


def ids_between(folder: str, start: int, stop: int) -> np.ndarray:
    """The ids from one place of the whole sequence to another, by the blocks that hold them."""
    place, root = opened(folder)
    with place.open_input_stream(f"{root}/_manifest.json") as held:
        known = [f for f in json.loads(held.read()) if f["start"] < stop and f["start"] + f["ids"] > start]
    parts = [Held(place, f"{root}/{f['file']}").values(IDS, max(start - f["start"], 0), min(stop - f["start"], f["ids"])) for f in known]
    return np.concatenate([*parts, np.zeros(0, U)])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        data = memoryview(ids.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes())
        ends = 4 * np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        crc = [zlib.crc32(data[a:b]) for a, b in zip([0, *ends[:-1]], ends)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def digests(held: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian unsigned 32-bit integers) of what read_ids gives."""
    return held.mapInArrow(_digests, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")

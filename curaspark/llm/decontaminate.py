"""Benchmark decontamination by latent semantic retrieval.

1. Inverse document frequencies of hashed words (lower case, without ASCII marks) over all documents and items.
2. The benchmark's items, in passages of at most ``PASSAGE`` words, are the rows of TF-IDF matrices, one for each
   block of about ``rank`` passages. The singular vectors of each come from a randomised SVD (a random projection
   and a power iteration) in one task a block. A block has as many vectors as passages, so nothing of them is lost.
3. Every document's windows of ``3 * STRIDE`` words, one every ``STRIDE`` words, are projected on the vectors of
   each block and compared with its passages, ``BLOCKS`` blocks in one reading: candidates have a cosine of
   ``cosine`` or more. Windows whose squared weights lie by less than the squared cosine on
   words of the passages cannot reach it, and are not projected. The cosine divides by the length of the whole window and equals
   the one of the full TF-IDF vectors, however many passages there are.
4. A candidate is a leak if the longest common subsequence of the passage's words and the words around the window
   covers ``lcs`` of the passage, or ``weak_lcs`` of it while ``answers`` of the passage's rarest words, which stand
   for its answer, are there too: a paraphrase that keeps the facts. So one passage of a long item is enough; the
   words of ``SECTION`` passages of an item that follow each other are held to the same shares as one.

The broadcast tables are bounded: ``FEATURES`` frequencies, the passages of ``BLOCKS`` blocks and their singular
vectors, one row for each word of a block. Documents are read once for the frequencies and once for every
``BLOCKS`` blocks, and never shuffled.

Defined results: null or blank texts and items match nothing; a null id, of a document or an item, is
reported as null; rows that repeat a document's or an item's id are all searched, with each of their different
texts, and give one row per document and item id, with the best of each figure; a benchmark without words gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curaspark.llm.common import Scratch
from curaspark.llm.near import _pieces
from curaspark.llm.shingles import MARKS, U, Words, mix

BITS = 18
FEATURES = 1 << BITS
RANK, OVERSAMPLE, STRIDE, PASSAGE, SECTION, BLOCKS = 256, 8, 8, 48, 4, 8
COSINE, LCS, WEAK_LCS, ANSWERS = 0.35, 0.6, 0.45, 0.8
#: Windows projected at once.
AT_ONCE = 2_048
COUNT_SCHEMA = "feature int, uses long"
PASSAGE_SCHEMA = "item_id long, text_hash long, part int, features array<int>, words array<long>"
VECTOR_SCHEMA = "block long, feature int, v array<float>"
LEAK_SCHEMA = "doc_id long, item_id long, cosine double, lcs double, answers double"


def features_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U(64 - BITS)).astype(np.int32)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts of the task each hashed word occurs."""
    total = np.zeros(FEATURES, np.int64)
    for piece in _pieces(batches):
        w = Words(piece.column(1), blank=MARKS)
        both = np.unique(w.text.astype(np.int64) * FEATURES + features_of(w.hash))
        total += np.bincount(both % FEATURES, minlength=FEATURES)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["feature", "uses"])


def frequencies(texts: DataFrame) -> np.ndarray:
    """Of (id, text): inverse document frequency by hashed word; one number for each of a fixed number of features."""
    n = texts.count()
    rows = texts.mapInArrow(_counts, COUNT_SCHEMA).groupBy("feature").agg(F.sum("uses").alias("uses")).toPandas()
    uses = np.zeros(FEATURES)
    uses[rows["feature"]] = rows["uses"]
    return np.log((n + 1) / (uses + 0.5)).clip(0).astype(np.float32)


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in _pieces(batches):
        w = Words(piece.column(1), blank=MARKS)
        ids, rows = list(zip(piece.column(0).to_pylist(), piece.column(2).to_pylist())), []
        for i, hashes in enumerate(np.split(w.hash, np.cumsum(w.count)[:-1])):
            parts = max(1, -(-len(hashes) // PASSAGE))
            rows += [(*ids[i], k, part) for k, part in enumerate(np.array_split(hashes, parts)) if len(part)]
        columns = list(zip(*rows)) or [(), (), (), ()]
        arrays = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32())]
        arrays += [pa.array([features_of(p) for p in columns[3]], pa.list_(pa.int32())), pa.array([p.view(np.int64) for p in columns[3]], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, ["item_id", "text_hash", "part", "features", "words"])


def _gauss(features: np.ndarray, width: int) -> np.ndarray:
    """The rows of the random matrix: a pure function of feature and column."""
    x = mix(features.astype(U)[:, None] * U(1 << 20) + np.arange(width, dtype=U)[None, :])
    u, v = ((x >> U(32)).astype(float) + 1) / 2.0**32, (x & U(0xFFFFFFFF)).astype(float) / 2.0**32
    return np.sqrt(-2 * np.log(np.minimum(u, 1.0))) * np.cos(2 * np.pi * v)


def singular_vectors(lists: list[np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors, one a passage, of the passages' TF-IDF matrix: (features that occur, a row of numbers for each)."""
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    at, place = np.unique(np.concatenate(lists), return_inverse=True)
    a = np.zeros((len(lists), len(at)))
    np.add.at(a, (row, place), idf[at][place])

    def whitening(g: np.ndarray) -> np.ndarray:
        """The matrix that makes columns of this Gram matrix orthonormal; what is numerically zero stays zero."""
        s, u = np.linalg.eigh(g)
        return u * np.where(s > 1e-10 * max(s.max(), 1e-300), 1 / np.sqrt(np.maximum(s, 1e-300)), 0)

    basis = _gauss(at, len(lists) + OVERSAMPLE)
    for _ in range(2):  # a power iteration between two orthonormalisations
        y = a @ basis
        z = a.T @ (y @ whitening(y.T @ y))
        # Orthonormal columns that span the same space.
        basis = z @ whitening(z.T @ z)
    y = a @ basis
    s, u = np.linalg.eigh(y.T @ y)
    return at, (basis @ u[:, np.argsort(-s)[: len(lists)]]).astype(np.float32)


def lcs_length(item: list[int], words: list[int]) -> int:
    """Longest common subsequence, by bits of one integer."""
    places: dict[int, int] = {}
    for i, w in enumerate(item):
        places[w] = places.get(w, 0) | 1 << i
    full = state = (1 << len(item)) - 1
    for w in words:
        if m := places.get(w):
            both = state & m
            state = (state + both | state - both) & full
    return len(item) - state.bit_count()


class Search:
    """A block of passages, and what is needed to compare a batch of texts with them."""

    def __init__(self, idf: np.ndarray, at: np.ndarray, vectors: np.ndarray, block: list, cosine: float, lcs: float, weak_lcs: float, answers: float):
        self.idf = idf
        self.words = [[x % 2**64 for x in r["words"]] for r in block]
        self.vectors = np.vstack([vectors, np.zeros((1, vectors.shape[1]), np.float32)])
        self.index = np.full(FEATURES, -1, np.int32)
        self.index[at] = np.arange(len(at))
        self.item_of = [r["item_id"] for r in block]
        # What is looked for in the texts: each passage, and each section of more than one.
        sections: dict[tuple, list[int]] = {}
        for i, r in enumerate(block):
            sections.setdefault((r["item_id"], r["text_hash"], r["part"] // SECTION), []).append(i)
        self.targets = [[i] for i in range(len(block))]
        for members in (m for m in sections.values() if len(m) > 1):
            for i in members:
                self.targets[i].append(len(self.words))
            self.item_of.append(self.item_of[members[0]])
            self.words.append([x for i in members for x in self.words[i]])
        latent = np.zeros((len(block), vectors.shape[1]), np.float32)
        for i, r in enumerate(block):
            f = np.array(r["features"])
            weights = np.bincount(np.unique(f, return_inverse=True)[1]) * idf[np.unique(f)]
            latent[i] = weights @ vectors[self.index[np.unique(f)]] / max(np.linalg.norm(weights), 1e-9)
        self.latent = np.ascontiguousarray(latent.T)
        self.limits = cosine, lcs, weak_lcs, answers
        self.rare = []
        for words in self.words:
            by_rarity = sorted(set(words), key=lambda w: (-idf[np.uint64(w) >> U(64 - BITS)], w))
            self.rare.append(set(by_rarity[: max(3, len(words) // 6)]))

    def candidates(self, w: Words) -> Iterator[tuple[int, int, int, float]]:
        """(text, first word of the window, number of the passage, cosine)."""
        n_words = len(w.text)
        if not n_words:
            return
        place = np.arange(n_words) - (np.cumsum(w.count) - w.count)[w.text]
        feature = features_of(w.hash)
        begins = np.flatnonzero(place % STRIDE == 0)
        text = w.text[begins]
        known = self.index[feature]
        square = self.idf[feature] ** 2
        all_, mine = np.add.reduceat(square, begins), np.add.reduceat(np.where(known >= 0, square, 0), begins)
        # A window is its own block of words and the next two of the same text.
        ends = np.append(begins, n_words)
        end, norm, held = ends[1:].copy(), all_.copy(), mine.copy()
        for k in (1, 2):
            same = np.flatnonzero(text[k:] == text[:-k])
            end[same] = ends[same + k + 1]
            norm[same] += all_[same + k]
            held[same] += mine[same + k]
        chosen = np.flatnonzero((held > 0) & (held >= max(self.limits[0], 0) ** 2 * norm))
        norm = np.sqrt(np.maximum(norm, 1e-9))
        for low in range(0, len(chosen), AT_ONCE):
            at = chosen[low : low + AT_ONCE]
            # The words of each window, those past its end as the vector of zeros that closes the table.
            word = begins[at][:, None] + np.arange(3 * STRIDE)
            inside = word < end[at][:, None]
            word = np.minimum(word, n_words - 1)
            row = np.where(inside, known[word], -1)
            weight = np.where(inside, self.idf[feature[word]], 0).astype(np.float32)
            total = np.matmul(weight[:, None, :], self.vectors[row])[:, 0]
            near = np.flatnonzero(np.linalg.norm(total, axis=1) >= self.limits[0] * norm[at])
            scores = total[near] @ self.latent / norm[at[near]][:, None]
            for a, b in zip(*np.nonzero(scores >= self.limits[0])):
                yield int(text[at[near[a]]]), int(begins[at[near[a]]]), int(b), float(scores[a, b])

    def leaks(self, w: Words) -> Iterator[tuple[int, int, float, float, float]]:
        """(text, item, cosine, share of the longest common subsequence, share of the rarest words)."""
        _, lcs, weak, answers = self.limits
        first = np.cumsum(w.count) - w.count
        near: dict[tuple[int, int], list[tuple[int, float]]] = {}
        for text, at, passage, score in self.candidates(w):
            for target in self.targets[passage]:
                near.setdefault((text, target), []).append((at, score))
        for (text, target), places in near.items():
            words, rare, best, regions = self.words[target], self.rare[target], None, []
            for at, _ in sorted(places):  # regions around windows, those that overlap made one
                low, high = max(at - len(words), first[text]), min(at + 3 * STRIDE + len(words), first[text] + w.count[text])
                if regions and low <= regions[-1][1] and high - regions[-1][0] <= 4 * len(words) + 6 * STRIDE:
                    regions[-1][1] = high
                else:
                    regions.append([low, high])
            for low, high in regions:
                around = w.hash[low:high].tolist()
                share = lcs_length(words, around) / len(words)
                held = len(rare.intersection(around)) / len(rare)
                best = max(best or (0.0, 0.0), (share, held))
            if best[0] >= lcs or (best[0] >= weak and best[1] >= answers):
                yield text, self.item_of[target], max(s for _, s in places), best[0], best[1]


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, id="doc_id", text="text", item="item_id", item_text="text", rank=RANK, cosine=COSINE, lcs=LCS, weak_lcs=WEAK_LCS, answers=ANSWERS) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answers) of the leaks, one row for each document and item."""
    scratch = Scratch(docs.sparkSession, "leaks")
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    items = benchmark.select(F.col(item).cast("long").alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    idf = frequencies(rows.union(items))
    passages = scratch.put(items.distinct().withColumn("text_hash", F.xxhash64("text")).mapInArrow(_passages, PASSAGE_SCHEMA), "passages")
    n = passages.count()
    # Smaller ones than rank where there are many, so that few exceed it; those have more vectors.
    blocks = 1 if n <= rank else -(-n // max(1, rank * 3 // 4))
    numbered = passages.withColumn("block", F.pmod(F.xxhash64("item_id", "text_hash", F.floor(F.col("part") / SECTION)), F.lit(blocks)))

    def factored(table: pa.Table) -> pa.Table:
        at, vectors = singular_vectors([np.array(x) for x in table.column("features").to_pylist()], idf)
        v = pa.ListArray.from_arrays(np.arange(len(at) + 1, dtype=np.int32) * vectors.shape[1], vectors.ravel())
        return pa.table({"block": np.full(len(at), table.column("block")[0].as_py()), "feature": at.astype(np.int32), "v": v})

    found = docs.sparkSession.createDataFrame([], LEAK_SCHEMA)
    for low in range(0, blocks if n else 0, BLOCKS):
        some = numbered.where(F.col("block").between(low, low + BLOCKS - 1))
        rows_of: dict[int, list] = {}
        for r in some.orderBy("block", "item_id", "text_hash", "part").collect():
            rows_of.setdefault(r["block"], []).append(r)
        vectors = some.groupBy("block").applyInArrow(factored, VECTOR_SCHEMA).toArrow()
        of = vectors.column("block").to_numpy()
        parts = []
        for block, held in rows_of.items():
            mine = vectors.filter(pa.array(of == block))
            v = np.array(mine.column("v").combine_chunks().flatten()).reshape(mine.num_rows, -1)
            parts.append((mine.column("feature").to_numpy(), v, [r.asDict() for r in held]))

        def search(batches: Iterator[pa.RecordBatch], parts=parts) -> Iterator[pa.RecordBatch]:
            searches = [Search(idf, *part, cosine, lcs, weak_lcs, answers) for part in parts]
            for piece in _pieces(batches):
                ids, w = piece.column(0).to_pylist(), Words(piece.column(1), blank=MARKS)
                leaks = [(ids[t], *x) for s in searches for t, *x in s.leaks(w)]
                columns = list(zip(*leaks)) or [()] * 5
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "item_id", "cosine", "lcs", "answers"])

        found = found.unionByName(rows.mapInArrow(search, LEAK_SCHEMA))
    best = [F.max(c).alias(c) for c in ("cosine", "lcs", "answers")]
    return found.groupBy("doc_id", "item_id").agg(*best)

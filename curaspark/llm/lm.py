"""LM scoring: stupid-backoff scores of all documents against the word pairs of all other documents.

A document's score is the mean natural logarithm of S(w | v) over its words w with the word v before each (a
start sign before the first): count(v w) / count(v) if the pair occurs in another document, else ``backoff``
times count(w) / all words. Pair counts leave the document's own out, so text that stands alone is not scored by
itself; counts of single words are those of the whole table.

Relationally: words and pairs are 64-bit hashes. The table of word counts is summed with map-side combining. The
documents' exploded pairs meet by the pair's hash, where sums over documents are the table of pair counts, then
look up one word count each: the context's where the pair is known, the word's where not. Terms are summed per
document. The joins hash their small side and need no sort. Pairs go in ``slices`` of the hash range, one after the other, so that the shuffle of all pairs never
lies on disk at once; each slice reads the texts again. What is gathered grows with the input. A word or pair
that a third of all documents have makes one row per document and is summed by splittable joins.

Defined results: null or blank text has no words and a null score; a null id takes no part and has a null score;
rows that repeat an id count as different texts and get one score over all their words; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curaspark.llm.common import Scratch
from curaspark.llm.near import _pieces
from curaspark.llm.shingles import U, Words, mix

BACKOFF, SLICES = 0.4, 4
#: Bytes of texts worked on at once, for words and for pairs.
BYTES_AT_ONCE, PAIR_BYTES = 2 << 20, 1 << 20
START = U(0x5354415254)
WORD_SCHEMA = "word long, uses long"
PAIR_SCHEMA = "doc_id long, context long, word long, uses int"


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts of a batch; the start sign is used once by each text that has words."""
    for piece in _pieces(batches, BYTES_AT_ONCE):
        w = Words(piece.column(1))
        word, uses = np.unique(np.append(w.hash, np.full(np.count_nonzero(w.count), START)), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(uses)], ["word", "uses"])


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each different key, in their order, and how often it occurs; which place does not matter, so no stable sort."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.flatnonzero(np.concatenate([keys[:1] == keys[:1], keys[1:] != keys[:-1]]))
    return order[new], np.diff(new, append=len(keys))


def _pairs(batches: Iterator[pa.RecordBatch], part: int, slices: int) -> Iterator[pa.RecordBatch]:
    """The different pairs of each text in one slice of the hash range."""
    for piece in _pieces(batches, PAIR_BYTES):
        w = Words(piece.column(1))
        before = np.full(len(w.hash), START)
        inner = np.flatnonzero(w.text[1:] == w.text[:-1]) + 1
        before[inner] = w.hash[inner - 1]
        pair = mix(before ^ mix(w.hash))
        mine = np.flatnonzero(pair % U(slices) == U(part))
        at, uses = _distinct(mix(pair[mine] ^ mix(w.text[mine].astype(U))))
        at = mine[at]
        ids = piece.column(0).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[w.text[at]]), pa.array(before[at].view(np.int64)), pa.array(w.hash[at].view(np.int64)), pa.array(uses.astype(np.int32))],
            ["doc_id", "context", "word", "uses"],
        )


def score(docs: DataFrame, *, id="doc_id", text="text", backoff=BACKOFF, slices=SLICES) -> DataFrame:
    """Per row: doc_id, n_words, n_known (words whose pair another document has) and score."""
    scratch = Scratch(docs.sparkSession, "lm")
    ids = docs.select(F.col(id).cast("long").alias("doc_id"))
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("doc_id is not null")
    counts = rows.mapInArrow(_words, WORD_SCHEMA).groupBy("word").agg(F.sum("uses").alias("total"))
    counts = scratch.put(counts, "words")
    n_words = counts.where(F.col("word") != int(START)).agg(F.sum("total")).first()[0] or 0

    terms = None
    for part in range(slices):
        pairs = rows.mapInArrow(lambda batches, part=part: _pairs(batches, part, slices), PAIR_SCHEMA)
        totals = pairs.groupBy("context", "word").agg(F.sum("uses").alias("pair_total"), F.count(F.lit(1)).alias("texts")).where("texts > 1")
        # A pair without a total is in one text only.
        held = pairs.join(totals.drop("texts").hint("shuffle_hash"), ["context", "word"], "left")
        others = F.coalesce(F.col("pair_total") - F.col("uses"), F.lit(0))
        held = held.select("doc_id", "uses", others.alias("others"), F.when(others > 0, F.col("context")).otherwise(F.col("word")).alias("lookup"))
        held = held.join(counts.withColumnRenamed("word", "lookup").hint("shuffle_hash"), "lookup")
        known = F.col("others") > 0
        value = F.when(known, F.log(F.col("others") / F.col("total"))).otherwise(F.log(F.col("total") * backoff))
        each = held.groupBy("doc_id").agg(
            F.sum(F.col("uses") * value).alias("logs"), F.sum("uses").alias("n"), F.sum(F.when(known, F.col("uses")).otherwise(0)).alias("n_known")
        )
        each = scratch.put(each, f"part{part}")
        terms = each if terms is None else terms.unionByName(each)
    summed = terms.groupBy("doc_id").agg(F.sum("logs").alias("logs"), F.sum("n").alias("n_words"), F.sum("n_known").alias("n_known"))
    missed = F.col("n_words") - F.col("n_known")
    return ids.join(summed, "doc_id", "left").select(
        "doc_id",
        F.coalesce("n_words", F.lit(0)).cast("long").alias("n_words"),
        F.coalesce("n_known", F.lit(0)).cast("long").alias("n_known"),
        ((F.col("logs") - missed * F.log(F.lit(n_words))) / F.col("n_words")).alias("score"),
    )

"""SentencePiece encoding with seeded merge dropout, and lossless decoding, of a merge-type (BPE) model.

Agenda processing takes the best-scored merge of two neighbours first, the leftmost of equals. With dropout each
candidate is skipped if a hash keyed with the seed, the document, the word's place in it and the candidate's place
in the word says so; the hash is a pure function, so a candidate is skipped for good and a retried task gives the
same tokens, and every occurrence of a word draws its own skips. Without dropout the tokens are those of the model's
own encoder.

Merges never cross from a letter to a blank, so words are encoded by themselves: all new words of a
batch, and all occurrences that skip a candidate, at once, step by step, with numpy; results without skips are held
in a table of bounded size. Characters outside the
vocabulary become bytes, and so does the blank sign itself (U+2581), so decoding gives every text back exactly.

Defined results: null text is empty and has no tokens; a null id hashes as 0; rows that repeat an id and a text
have equal tokens; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, count
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curaspark.llm.near import _pieces
from curaspark.llm.shingles import U, mix

BLANK = "▁"
#: A word is a run of blanks and the characters up to the next blank.
WORDS = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
HELD = 200_000
#: Occurrences of words worked on at once.
AT_ONCE = 65_536
#: Bytes encoded, and rows decoded, at once.
BYTES_AT_ONCE, ROWS_AT_ONCE = 2 << 20, 256
#: Stands for a blank sign of the text itself until it becomes bytes; no valid string holds a lone surrogate.
OWN_SIGN = "\udc81"
#: Longer words go through a heap, one at a time: all words at once take as many steps as the longest has merges.
LONG = 64
ENCODED_SCHEMA = "doc_id long, ids array<int>"


def read_model(path: str) -> bytes:
    return Path(path).read_bytes()


def place_of(begin: np.ndarray, middle: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for the candidate that joins [begin, middle) and [middle, end) of a word."""
    return (((begin * 0x1F_FFF7 + middle) * 0x1F_FFF7) + end).astype(U) * U(0x9E3779B97F4A7C15)


class Model:
    """The pieces of a model, and its merges: a table from two neighbours to the piece they make."""

    def __init__(self, proto: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        odd = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i) for i in range(n)]
        normal = {p: i for i, p in enumerate(self.pieces) if not odd[i]}
        assert not any(re.search(f"[^{BLANK}]{BLANK}", p) for p in normal), "the model joins words"
        self.byte_ids = [self.pieces.index(f"<0x{b:02X}>") for b in range(256)]
        # Neighbours are pieces, or characters that only longer pieces hold; those get numbers from n on.
        chars = sorted({c for p in normal for c in p} - normal.keys())
        symbols = normal | {c: n + i for i, c in enumerate(chars)}
        self.first = {c: i for c, i in symbols.items() if len(c) == 1}
        self.other, self.n = n + len(chars), n
        self.chars = chars
        # Rank 0 is the best score; equal scores share a rank.
        scores = {i: sp.get_score(i) for i in normal.values()}
        ranks = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = np.full(self.other + 1, 2**31 - 1, np.int64)
        for i, s in scores.items():
            self.rank[i] = ranks[s]
        pairs = {(symbols[p[:k]] << 20) | symbols[p[k:]]: i for p, i in normal.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols}
        # A hash table with free slots; a pair lies in the first that was free from its own on.
        self.bits = max(16, (4 * len(pairs)).bit_length())
        self.keys, self.made = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        key, piece = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int64)
        at = self.slot(key)
        while len(key):
            free = self.keys[at] < 0
            self.keys[at[free]], self.made[at[free]] = key[free], piece[free]  # of several for one slot the last stays
            left = self.keys[at] != key
            key, piece, at = key[left], piece[left], (at[left] + 1) & (len(self.keys) - 1)
        self.point = np.full(0x110000, self.other, np.int32)
        self.point[[ord(c) for c in self.first]] = list(self.first.values())
        # What each id stands for, for decoding.
        raw = [bytes([self.byte_ids.index(i)]) if sp.is_byte(i) else b"" if odd[i] else p.replace(BLANK, " ").encode() for i, p in enumerate(self.pieces)]
        self.raw = np.array(raw, object)

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(U) * U(0x9E3779B97F4A7C15)) >> U(64 - self.bits)).astype(np.int64)

    def merge_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece two neighbours make, -1 where none."""
        key = (left << 20) | right
        at = self.slot(key)
        held, made = self.keys[at], self.made[at]
        wrong = np.flatnonzero((held != key) & (held >= 0))
        made[held != key] = -1
        at = at[wrong]
        while len(wrong):  # other pairs' slots
            at = (at + 1) & (len(self.keys) - 1)
            held = self.keys[at]
            hit = held == key[wrong]
            made[wrong[hit]] = self.made[at[hit]]
            still = ~hit & (held >= 0)
            wrong, at = wrong[still], at[still]
        return made

    def agenda(self, symbol: list[int], variant: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """One word's symbols, merged best first: (place of each symbol that is left, symbol)."""
        n = len(symbol)
        before, after, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        salt = mix(np.array([variant], U))
        waiting: list[tuple[int, int, int, int]] = []

        def offer(places: list[int]) -> None:
            """Puts the candidates that begin at these places on the agenda, but for those that are skipped."""
            left = np.array([i for i in places if i >= 0 and after[i] < n], np.int64)
            if not len(left):
                return
            right = np.array([after[i] for i in left.tolist()], np.int64)
            end = np.array([after[i] for i in right.tolist()], np.int64)
            made = self.merge_of(np.array([symbol[i] for i in left.tolist()]), np.array([symbol[i] for i in right.tolist()]))
            ok = (made >= 0) & (mix(salt ^ place_of(left, right, end)) >= U(limit))
            for x in zip(self.rank[made[ok]].tolist(), left[ok].tolist(), right[ok].tolist(), made[ok].tolist(), end[ok].tolist()):
                heapq.heappush(waiting, x)

        offer(list(range(n - 1)))
        while waiting:
            _, i, j, piece, end = heapq.heappop(waiting)
            if not (alive[i] and alive[j] and after[i] == j and after[j] == end):
                continue
            symbol[i], alive[j], after[i] = piece, False, end
            if end < n:
                before[end] = i
            offer([before[i], i])
        left = [i for i in range(n) if alive[i]]
        return np.array(left, np.int64), np.array([symbol[i] for i in left], np.int64)

    def segment(self, words: list[str], variants: np.ndarray, dropout: float, seen: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, each in its variant, one word after the other, and how many each has. seen takes (word, place) of the candidates of words up to LONG."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbol = self.point[points].astype(np.int64)
        word = np.repeat(np.arange(len(words)), sizes)
        first = np.cumsum(sizes) - sizes
        begin = np.arange(len(symbol)) - np.repeat(first, sizes)  # a symbol's place in its word
        character = np.arange(len(symbol))  # and in all words
        limit = U(min(int(dropout * 2.0**64), 2**64 - 1))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for w in np.flatnonzero(sizes > LONG).tolist():
            own = symbol[first[w] : first[w] + sizes[w]]
            places, own = self.agenda(own.tolist(), int(variants[w]), int(limit) if dropout > 0 else 0)
            done.append((np.full(len(own), w), first[w] + places, own))
        short = sizes[word] <= LONG
        word, begin, character, symbol = word[short], begin[short], character[short], symbol[short]

        def candidates(i: np.ndarray) -> np.ndarray:
            """The piece that symbol i and its right neighbour make, -1 where none or skipped."""
            right = np.minimum(i + 1, len(symbol) - 1)
            made = np.where((word[i] == word[right]) & (right > i), self.merge_of(symbol[i], symbol[right]), -1)
            if dropout > 0 or seen is not None:
                some = np.flatnonzero(made >= 0)
                own, right = i[some], right[some]
                nxt = np.minimum(right + 1, len(symbol) - 1)
                end = np.where((nxt > right) & (word[nxt] == word[own]), begin[nxt], sizes[word[own]])
                place = place_of(begin[own], begin[right], end)
                if seen is not None:
                    seen.append((word[own], place))
                if dropout > 0:
                    made[some[mix(mix(variants[word[own]].astype(U)) ^ place) < limit]] = -1
            return made

        made = candidates(np.arange(len(symbol)))
        while len(symbol):
            can = np.flatnonzero(made >= 0)
            # The best candidate of each word: words are runs, so the minimum of each run of candidates.
            value = self.rank[made[can]] * 2**32 + can
            starts = np.flatnonzero(np.concatenate([[True], word[can][1:] != word[can][:-1]])) if len(can) else can
            best = np.minimum.reduceat(value, starts) % 2**32 if len(can) else can
            active = np.zeros(len(words), bool)
            active[word[best]] = True
            symbol[best] = made[best]
            still = active[word]
            done.append((word[~still], character[~still], symbol[~still]))
            keep = still.copy()
            keep[best + 1] = False
            word, begin, character, symbol, made = word[keep], begin[keep], character[keep], symbol[keep], made[keep]
            if len(symbol):
                merged = (np.cumsum(keep) - 1)[best]
                left = merged[merged > 0] - 1
                changed = np.zeros(len(symbol), bool)
                changed[merged] = changed[left] = True
                changed = np.flatnonzero(changed)
                made[changed] = candidates(changed)
        word, character, symbol = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(character)
        word, character, symbol = word[order], character[order], symbol[order]
        symbol, word = self._bytes_for(symbol, word, character, words)
        return symbol.astype(np.int32), np.bincount(word, minlength=len(words))

    def _bytes_for(self, symbol: np.ndarray, word: np.ndarray, character: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Characters that are no piece, as the pieces of their bytes."""
        odd = np.flatnonzero(symbol >= self.n)
        if not len(odd):
            return symbol, word
        joined = "".join(words)
        raw = [(BLANK if joined[i] == OWN_SIGN else joined[i]).encode("utf-8", "surrogatepass") for i in character[odd].tolist()]
        times = np.ones(len(symbol), np.int64)
        times[odd] = [len(r) for r in raw]
        first = np.cumsum(times) - times
        symbol, word = np.repeat(symbol, times), np.repeat(word, times)
        at = np.repeat(first[odd], times[odd]) + np.concatenate([np.arange(len(r)) for r in raw])
        symbol[at] = np.array(self.byte_ids)[np.frombuffer(b"".join(raw), np.uint8)]
        return symbol, word

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(self.raw[ids].tolist()).decode("utf-8", "surrogatepass")[1:]


@lru_cache(maxsize=2)
def model_of(proto: bytes) -> Model:
    return Model(proto)


class Encoder:
    """Encodes texts; holds the ids of the words it has met as they are without skips, up to a number of words.

    Every occurrence draws its own skips, by seed, document and place. One that skips none of the candidates met without
    skips has the ids held; the agenda runs again for all others.
    """

    def __init__(self, model: Model, dropout: float, seed: int):
        self.model, self.dropout, self.seed = model, dropout, seed
        self.limit = U(min(int(dropout * 2.0**64), 2**64 - 1))
        self.clear()

    def clear(self) -> None:
        self.held: defaultdict[str, int] = defaultdict(count().__next__)  # a new word has the next number
        self.flat, self.places = np.zeros(0, np.int32), np.zeros(0, U)
        self.start = self.size = self.place_start = self.place_size = np.zeros(0, np.int64)  # by word
        self.long = np.zeros(0, bool)

    def meet(self, words: list[str]) -> None:
        """Holds new words: their ids without skips, and the places of the candidates on the way there."""
        seen: list[tuple[np.ndarray, np.ndarray]] = []
        flat, sizes = self.model.segment(words, np.zeros(len(words), U), 0.0, seen if self.dropout > 0 else None)
        word, place = (np.concatenate(x) for x in zip((np.zeros(0, np.int64), np.zeros(0, U)), *seen))
        counts = np.bincount(word, minlength=len(words))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(sizes) - sizes])
        self.place_start = np.concatenate([self.place_start, len(self.places) + np.cumsum(counts) - counts])
        self.size, self.place_size = np.concatenate([self.size, sizes]), np.concatenate([self.place_size, counts])
        self.flat, self.places = np.concatenate([self.flat, flat]), np.concatenate([self.places, place[np.argsort(word, kind="stable")]])
        self.long = np.concatenate([self.long, np.fromiter((len(w) > LONG for w in words), bool, len(words))])

    def skipping(self, number: np.ndarray, keyed: np.ndarray) -> np.ndarray:
        """The occurrences in which a candidate is skipped, and all of long words."""
        counts = self.place_size[number]
        ends = np.cumsum(counts)
        place = self.places[np.repeat(self.place_start[number] - (ends - counts), counts) + np.arange(int(counts.sum()))]
        some = self.long[number]
        some[np.repeat(np.arange(len(number)), counts)[mix(np.repeat(mix(keyed), counts) ^ place) < self.limit]] = True
        return np.flatnonzero(some)

    def encode(self, texts: list[str], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text after the other, and how many each has."""
        if len(self.held) > HELD:
            self.clear()
        known = len(self.held)
        parts = [WORDS.findall(BLANK + t.replace(BLANK, OWN_SIGN).replace(" ", BLANK)) if t else [] for t in texts]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        n, held = int(sizes.sum()), self.held
        number = np.fromiter(map(held.__getitem__, chain.from_iterable(parts)), np.int64, n)
        words = list(held)
        if len(words) > known:
            self.meet(words[known:])

        first = np.cumsum(sizes) - sizes
        flat, start, lengths = self.flat, self.start[number], self.size[number]
        if self.dropout > 0:
            place = np.arange(n) - np.repeat(first, sizes)
            keyed = mix(mix(np.repeat(ids.astype(np.int64).view(U), sizes) ^ mix(np.array([self.seed], np.int64).view(U))) + place.astype(U))
            for low in range(0, n, AT_ONCE):
                again = low + self.skipping(number[low : low + AT_ONCE], keyed[low : low + AT_ONCE])
                if len(again):
                    own, counts = self.model.segment([words[i] for i in number[again].tolist()], keyed[again], self.dropout)
                    start[again], lengths[again] = len(flat) + np.cumsum(counts) - counts, counts
                    flat = np.concatenate([flat, own])
        ends = np.cumsum(lengths)
        out = flat[np.repeat(start - (ends - lengths), lengths) + np.arange(int(lengths.sum()))]
        return out, np.diff(np.concatenate([[0], ends])[np.concatenate([first, [n]])])


def _encode(batches: Iterator[pa.RecordBatch], proto: bytes, dropout: float, seed: int) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(model_of(proto), dropout, seed)
    for piece in _pieces(batches, BYTES_AT_ONCE):
        ids, sizes = encoder.encode(piece.column(1).to_pylist(), piece.column(0).fill_null(0).to_numpy(zero_copy_only=False))
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([piece.column(0), pa.ListArray.from_arrays(offsets, ids)], ["doc_id", "ids"])


def _decode(batches: Iterator[pa.RecordBatch], proto: bytes) -> Iterator[pa.RecordBatch]:
    model = model_of(proto)
    for batch in (b.slice(i, ROWS_AT_ONCE) for b in batches for i in range(0, b.num_rows, ROWS_AT_ONCE)):
        ids = batch.column(1).flatten().to_numpy(zero_copy_only=False)
        sizes = batch.column(1).value_lengths().fill_null(0).to_pylist()
        texts, at = [], 0
        for n in sizes:
            texts.append(model.decode(ids[at : at + n]))
            at += n
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])


def encode(docs: DataFrame, model_path: str, *, id="doc_id", text="text", dropout=0.1, seed=1) -> DataFrame:
    """Per row: doc_id and ids array<int>. The driver reads the model file, whose size is fixed, and sends it along."""
    proto = read_model(model_path)
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(lambda batches: _encode(batches, proto, dropout, seed), ENCODED_SCHEMA)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids) with text added: exactly what was encoded."""
    proto = read_model(model_path)
    return encoded.select("doc_id", "ids").mapInArrow(lambda batches: _decode(batches, proto), ENCODED_SCHEMA + ", text string")

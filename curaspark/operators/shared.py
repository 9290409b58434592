"""Pairs of sets that are similar enough, inside a task: bits of frequent elements, lists of rows for the others."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Rows on the right that are counted together, and on the left; pairs that are handed back together.
BLOCK, ROWS, PAIRS = 1 << 14, 32, 1 << 16
#: Frequent elements that may have bits, and the pairs' mean number of shared ones from which 64 elements are worth them.
FREQUENT, WORTH = 192, 0.2
#: Shared elements that lists not passed over would have to show before the others are looked at.
SPARE = 3
#: Rows are kept together by the most frequent element that they hold, while that keeps so large a share of them together.
TOGETHER = 1 / 16

Found = Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]


def flat(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... sizes[0] of them, then those of the next."""
    ends = np.cumsum(sizes)
    kind = np.int32 if len(ends) and max(ends[-1], np.max(first + sizes)) < 1 << 31 else np.int64
    at = np.repeat((first - ends + sizes).astype(kind), sizes)
    at += np.arange(len(at), dtype=kind)
    return at


class Sets:
    """Sets of numbers below n_elements, one after the other, with their rows."""

    def __init__(self, rows: np.ndarray, sizes: np.ndarray, codes: np.ndarray, n_elements: int) -> None:
        self.rows, self.sizes, self.codes, self.n_elements = rows, sizes, codes, n_elements
        self.ends = np.cumsum(sizes)
        self.first = self.ends - sizes

    def take(self, at: np.ndarray) -> Sets:
        return Sets(self.rows[at], self.sizes[at], self.codes[flat(self.first[at], self.sizes[at])], self.n_elements)

    def places(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    def having(self, wanted: np.ndarray) -> np.ndarray:
        """How many elements of each set are wanted."""
        up_to = np.concatenate([[0], np.cumsum(wanted[self.codes])])
        return up_to[self.ends] - up_to[self.first]

    def bits(self, rank: np.ndarray, n: int) -> np.ndarray:
        """For each 64 ranks of elements one number a set."""
        held = rank[self.codes]
        bits = np.zeros((len(self.sizes), n), bool)
        bits[self.places()[held < n], held[held < n]] = True
        return np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little").view(np.uint64).T)


def alike(sets: Sets) -> Iterator[Sets]:
    """Blocks of the sets, each by rising size: those that hold the most frequent element, of the rest those that hold its most frequent, ..."""
    places, label, open_ = sets.places(), np.zeros(len(sets.sizes), np.int64), np.ones(len(sets.sizes), bool)
    codes = sets.codes
    for k in range(1, int(1 / TOGETHER) + 1):
        best = int(np.argmax(np.bincount(codes))) if len(codes) else 0
        holders = places[codes == best]
        if len(holders) < TOGETHER * len(sets.sizes):
            break
        label[holders], open_[holders] = k, False
        still = open_[places]
        places, codes = places[still], codes[still]
    order = np.lexsort((sets.sizes, label))
    for same in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
        for at in range(0, len(same), BLOCK):
            yield sets.take(same[at : at + BLOCK])


def similar_to_block(left: Sets, block: Sets, threshold: float) -> Found:
    """(row, row of the block, similarity) of the left sets against those of a block by rising size.

    A pair's shared elements are its common bits and the times that the block's set is listed under an element of the left
    one. Where bits alone leave all sets of the block short of d elements, only d - ``SPARE`` of a left set's longest lists are
    passed over, and looked at after all where the rest comes so near that they could decide."""
    n, n_elements = len(block.sizes), block.n_elements
    share = max(threshold, 0.0) / (1 + max(threshold, 0.0))  # of both sizes, to be shared
    held = np.bincount(block.codes, minlength=n_elements)

    most = left.having(held > 0)
    kept = np.flatnonzero((most > 0) & (most >= share * (left.sizes + block.sizes[0]) - 1e-6))
    if not len(kept):
        return
    kept = kept[np.lexsort((most[kept], left.sizes[kept]))]
    left, most = left.take(kept), most[kept]

    top = np.argpartition(-held, FREQUENT)[:FREQUENT] if n_elements > FREQUENT else np.arange(n_elements)
    top = top[np.argsort(-held[top], kind="stable")]
    gain = np.add.reduceat((held[top] / n) ** 2, np.arange(0, len(top), 64))
    n_bits = 64 * max(1, int((gain > WORTH).sum()))
    rank = np.full(n_elements, n_bits, np.int16)
    rank[top[:n_bits]] = np.arange(len(top[:n_bits]))
    ours, theirs = left.bits(rank, n_bits), block.bits(rank, n_bits)

    listed = (rank == n_bits) & (held > 0)
    others = listed[block.codes]
    lists = block.places().astype(np.int32)[others][np.argsort(block.codes[others], kind="stable")]
    begin = np.cumsum(np.where(listed, held, 0)) - held
    n_lists = left.having(listed)
    wanted = left.codes[listed[left.codes]]
    starts, lengths = begin[wanted], held[wanted]
    first = np.cumsum(n_lists) - n_lists

    # The block's sets that are neither too small nor too large: shared ones are at most their elements, and at most ``most``.
    low = np.searchsorted(block.sizes, threshold * left.sizes - 1e-6)
    high = np.searchsorted(block.sizes, most / share - left.sizes + 1e-6, "right") if share > 0 else np.full(len(left.sizes), n)
    kind = np.int16 if max(block.sizes[-1], left.sizes[-1]) < 1 << 14 else np.int32
    width, one = -(-n // 8) * 8, kind(1)
    scores = np.empty((ROWS, width), kind)  # shared elements, less those that are needed
    both, bits, more = np.empty((ROWS, width), np.uint64), np.empty((ROWS, width), np.uint8), np.empty((ROWS, width), np.uint8)
    enough, found, n_found = np.zeros((ROWS, width), bool), [], 0

    def count(rows: np.ndarray, first: np.ndarray, n: np.ndarray) -> None:
        """Adds the n lists from the first to the scores of rows."""
        each = flat(first, n)
        place = lists[flat(starts[each], lengths[each])]
        place += np.repeat(np.repeat(rows.astype(np.int32) * width, n), lengths[each])
        np.add.at(scores.reshape(-1), place.astype(np.intp), one)

    for same in np.split(np.arange(len(left.sizes)), np.flatnonzero(np.diff(left.sizes)) + 1):
        needed = np.maximum(np.ceil(share * (block.sizes + left.sizes[same[0]]) - 1e-6), 1).astype(kind)
        for at in range(same[0], same[-1] + 1, ROWS):
            end = min(at + ROWS, same[-1] + 1)
            m, lo, hi = end - at, int(low[at]), int(high[end - 1])  # the last one has the most
            if lo >= hi:
                continue
            part = np.s_[:m, lo:hi]
            np.bitwise_and(theirs[0, None, lo:hi], ours[0, at:end, None], out=both[part])
            np.bitwise_count(both[part], out=bits[part])
            for k in range(1, len(ours)):
                np.bitwise_and(theirs[k, None, lo:hi], ours[k, at:end, None], out=both[part])
                np.bitwise_count(both[part], out=more[part])
                np.add(bits[part], more[part], out=bits[part])
            np.subtract(bits[part], needed[lo:hi], out=scores[part])
            over = np.clip(-scores[part].max(axis=1).astype(np.int64) - SPARE, 0, n_lists[at:end])
            count(np.arange(m), first[at:end] + over, n_lists[at:end] - over)
            enough[:m, :lo], enough[:m, hi:] = False, False
            np.greater_equal(scores[part], -over[:, None].astype(kind), out=enough[part])
            near = np.flatnonzero(enough[:m].view(np.uint64) != 0)
            if not len(near):
                continue
            near = (near[:, None] * 8 + np.arange(8)).ravel()
            near = near[enough[:m].ravel()[near]]
            r, j = near // width, near % width
            again = np.unique(r[over[r] > 0])
            count(again, first[at + again], over[again])
            fits = scores[r, j] >= 0
            if fits.any():
                found.append((at + r[fits], j[fits], scores[r[fits], j[fits]].astype(np.int64)))
                n_found += len(found[-1][0])
            if n_found >= PAIRS:
                yield _pairs(left, block, found, share, threshold)
                found, n_found = [], 0
    if found:
        yield _pairs(left, block, found, share, threshold)


def _pairs(left: Sets, block: Sets, found: list, share: float, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    i, j, shared = (np.concatenate(x) for x in zip(*found))
    both = left.sizes[i] + block.sizes[j]
    shared += np.maximum(np.ceil(share * both - 1e-6), 1).astype(np.int64)
    similarity = shared / (both - shared)
    fits = similarity >= threshold
    return left.rows[i[fits]], block.rows[j[fits]], similarity[fits]


def similar(sets: Sets, left: np.ndarray, right: np.ndarray, threshold: float) -> Found:
    """(i, j, similarity) of the left sets against the right ones that share something and are similar enough, each pair once."""
    if not len(left) or not len(right):
        return
    frequent_first = np.argsort(np.argsort(-np.bincount(sets.codes, minlength=sets.n_elements), kind="stable"))
    key = np.sort(sets.places() * sets.n_elements + frequent_first[sets.codes])
    sets = Sets(sets.rows, sets.sizes, key % sets.n_elements, sets.n_elements)
    ours = sets.take(left[np.argsort(sets.sizes[left], kind="stable")])
    for block in alike(sets.take(right)):
        yield from similar_to_block(ours, block, threshold)

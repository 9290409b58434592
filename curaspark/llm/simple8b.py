"""Simple-8b: whole 64-bit words, each a selector of 4 bits and as many equally wide values as fit into the other 60.

Values are cut into blocks of ``BLOCK``, which code alone, so many blocks are packed or read side by side: the walk from
word to word goes through all blocks at once, one word a step, and every selector's words are filled or taken apart by
one matrix operation. A value of 60 bits and more (2^60-1 included) is an escape: its slot is all ones, and the value
itself stands in the block's list of escapes, in order. A block knows how many values, words and escapes it has.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

U = np.uint64
BLOCK = 8192
# How many values a word holds under each selector, and their width in bits.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = U(2**60 - 1)
_LONGEST = int(COUNTS[0])


class Packed(NamedTuple):
    """Blocks one after the other: words and escapes of all, and of each how many values, words and escapes it has."""

    words: np.ndarray
    escapes: np.ndarray
    n_values: np.ndarray
    n_words: np.ndarray
    n_escapes: np.ndarray


def _wide_room(values: np.ndarray) -> np.ndarray:
    room = np.ones(values.shape, np.uint8)
    for count, width in zip(COUNTS[-2:0:-1], WIDTHS[-2:0:-1]):
        room[values < U(1) << U(width)] = count
    room[values == 0] = _LONGEST
    return room


_NARROW = _wide_room(np.arange(1 << 16, dtype=U))


def _room(values: np.ndarray) -> np.ndarray:
    """How many values as wide as this one a word holds: looked up for small values."""
    if values.size and values.max() < len(_NARROW):
        return _NARROW[values.astype(np.uint16)]
    return _wide_room(values)


def _selectors(room: np.ndarray, width: int) -> np.ndarray:
    """The selector of the fullest word that may begin at each place; room has so many columns more as a word may hold.

    Values that fill a word together also fill every less full one, so the fitting ones are counted."""
    best = np.full((len(room), width), len(COUNTS) - 1, np.uint8)
    least, size = room, 1
    for s in range(len(COUNTS) - 2, -1, -1):
        step = int(COUNTS[s]) - size
        least, size = np.minimum(least[:, : least.shape[1] - step], least[:, step:]), int(COUNTS[s])
        best -= (least[:, :width] >= size).view(np.uint8)
    return best


def _walk(best: np.ndarray, n_values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, place, selector) of every word, block by block: all blocks take a step at a time, ended ones stand still."""
    blocks, width = best.shape
    flat, base = best.ravel(), np.arange(blocks, dtype=np.int32) * width
    counts, ends = COUNTS.astype(np.int32), n_values.astype(np.int32)
    at, places, selectors = np.zeros(blocks, np.int32), [], []
    while (at < ends).any():
        for _ in range(32):
            s = flat[base + np.minimum(at, width - 1)]
            places.append(at)
            selectors.append(s)
            at = np.minimum(at + counts[s], ends)
    if not places:
        return (np.zeros(0, np.int64),) * 3
    place, selector = np.stack(places, axis=1), np.stack(selectors, axis=1)
    live = place < ends[:, None]
    return np.repeat(np.arange(blocks), live.sum(axis=1)), place[live].astype(np.int64), selector[live].astype(np.int64)


def pack(values: np.ndarray) -> Packed:
    values = np.ascontiguousarray(values, U)
    blocks = -(-len(values) // BLOCK)
    n_values = np.full(blocks, BLOCK)
    if blocks:
        n_values[-1] = len(values) - BLOCK * (blocks - 1)
    grid = np.zeros((blocks, BLOCK + _LONGEST), U)
    for i in range(blocks):
        grid[i, : n_values[i]] = values[i * BLOCK : i * BLOCK + n_values[i]]
    block, place, selector = _walk(_selectors(_room(grid), BLOCK), n_values)
    words = selector.astype(U) << U(60)
    wide = grid >= ESCAPE
    escapes, n_escapes = grid[wide], wide.sum(axis=1)
    if len(escapes):
        grid[wide] = ESCAPE
    slots, first = grid.ravel(), block * grid.shape[1] + place
    for s in range(2, len(COUNTS)):
        own = np.flatnonzero(selector == s)
        held, at = words[own], first[own]
        for k in range(COUNTS[s] if len(own) else 0):
            held |= slots[at + k] << U(k * WIDTHS[s])
        words[own] = held
    return Packed(words, escapes, n_values, np.bincount(block, minlength=blocks), n_escapes)


def unpack(packed: Packed) -> np.ndarray:
    words, n_values, n_words = packed.words, packed.n_values, packed.n_words
    selector = (words >> U(60)).astype(np.int64)
    block, count = np.repeat(np.arange(len(n_words)), n_words), COUNTS[selector]
    first = np.cumsum(count) - count  # of each word's values, then within its block
    head = np.cumsum(n_words) - n_words
    place = first - first[np.minimum(head, max(len(first) - 1, 0))][block] if len(first) else first
    out = np.zeros(int(n_values.sum()) + _LONGEST, U)
    base = np.cumsum(n_values) - n_values
    at, room = base[block] + place, n_values[block] - place
    last = len(out) - 1  # where what a block's last word holds beyond its values goes
    for s in range(2, len(COUNTS)):
        own = np.flatnonzero(selector == s)
        held, to, left = words[own], at[own], room[own]
        for k in range(COUNTS[s] if len(own) else 0):
            out[np.where(k < left, to + k, last)] = (held >> U(k * WIDTHS[s])) & ((U(1) << U(WIDTHS[s])) - U(1))
    out = out[: len(out) - _LONGEST]
    out[out == ESCAPE] = packed.escapes
    return out

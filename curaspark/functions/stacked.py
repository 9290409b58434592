"""Functions of whole matrices as column functions: rows of one Arrow batch with equal length (and equal settings) are
stacked and worked on together, so Python runs once for many signals."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Samples that are stacked at most, unless one row has more.
AT_ONCE = 1 << 17


def runs(sizes: np.ndarray, at_once: int | None = None) -> Iterator[slice]:
    """The rows one after the other in runs of so many samples at most, unless one row has more."""
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + (at_once or AT_ONCE), "right")))
        yield slice(a, b)
        a = b


def _lists(rows: list[np.ndarray | None]) -> pa.Array:
    sizes = np.array([0 if r is None else len(r) for r in rows], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    data = np.concatenate([np.zeros(0), *(r for r in rows if r is not None)])
    missing = pa.array([r is None for r in rows], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(data, pa.float64()), mask=missing)


def apply_stacked(f: Callable[..., np.ndarray], signals: pa.Array, same: Sequence[pa.Array], own: Sequence[pa.Array]) -> pa.Array:
    data = signals.flatten().to_numpy(zero_copy_only=False).astype(float)  # a null sample counts as nan
    sizes = signals.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.cumsum(sizes) - sizes
    settings, values = [x.to_pylist() for x in same], [x.to_pylist() for x in own]
    out: list[np.ndarray | None] = [None] * len(signals)
    groups = defaultdict(list)
    for i, known in enumerate(signals.is_valid().to_pylist()):
        if known and all(x[i] is not None for x in (*settings, *values)):
            groups[sizes[i], *(x[i] for x in settings)].append(i)
    for (size, *given), members in groups.items():
        step = max(1, AT_ONCE // max(size, 1))
        for a in range(0, len(members), step):
            rows = members[a : a + step]
            matrix = data[first[rows][:, None] + np.arange(size)]
            done = f(matrix, *given, *(np.array([x[i] for i in rows]) for x in values)) if size else matrix
            for i, row in zip(rows, done):
                out[i] = row
    return _lists(out)


def stacked(f: Callable[..., np.ndarray], signal: Column, same: Sequence[Column] = (), own: Sequence[Column] = ()) -> Column:
    """f(matrix of signals, settings they share, arrays with each one's own values) gives a matrix with as many rows.

    A null signal, setting or value gives null; an empty signal stays empty and is not handed to f."""

    shared = len(same)

    @F.arrow_udf("array<double>")
    def apply(signals: pa.Array, *rest: pa.Array) -> pa.Array:
        return apply_stacked(f, signals, rest[:shared], rest[shared:])

    return apply(signal, *same, *own)

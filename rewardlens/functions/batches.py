"""Arrow arrays a slice of rows at a time.

A batch that comes to a Python function has a bounded number of rows, but array
arithmetic holds many copies of its items at once. Over slices these copies stay small,
however long the batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Items of a slice; a longer row is a slice of its own.
SLICE_ITEMS = 1 << 18


def cuts(ends: np.ndarray, most: int) -> list[int]:
    """Where to cut rows whose items end at ``ends``, so that a slice has at most ``most`` items or is one row."""
    at, before, n = [0], 0, len(ends)
    while at[-1] < n:
        at.append(max(at[-1] + 1, int(np.searchsorted(ends, before + most, "right"))))
        before = int(ends[at[-1] - 1])
    return at


def slices(lists: pa.Array, most: int = SLICE_ITEMS) -> Iterator[pa.Array]:
    """A list array as runs of rows."""
    offsets = lists.offsets.to_numpy()
    at = cuts(offsets[1:] - offsets[0], most)
    for a, b in zip(at, at[1:]):
        yield lists.slice(a, b - a)


def in_slices(lists: pa.Array, fn: Callable[[pa.Array], pa.Array], most: int = SLICE_ITEMS) -> pa.Array:
    """``fn`` of a list array, which gives one value for each row, slice by slice."""
    return pa.concat_arrays([fn(s) for s in slices(lists, most)]) if len(lists) else fn(lists)

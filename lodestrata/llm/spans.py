"""Helpers for sorted keys arriving in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def runs(batches: Iterable[pa.RecordBatch], keys: list[str], target: int = 4000, size: int = 16 << 20) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by keys: about ``target`` rows or ``size`` bytes each, a group never cut."""
    held: list[pa.RecordBatch] = []
    rows = total = 0
    for whole in batches:
        # a batch of large values is taken in parts
        step = max(1, whole.num_rows * size // max(1, 2 * whole.nbytes))
        for b in (whole.slice(k, step) for k in range(0, whole.num_rows, step)):
            held.append(b)
            rows += b.num_rows
            total += b.nbytes
            if rows < target and total < size:
                continue
            first, last = held[0], held[-1]
            if all(first.column(k)[0] == last.column(k)[last.num_rows - 1] for k in keys):
                continue  # one group so far
            t = pa.Table.from_batches(held)
            other = np.zeros(t.num_rows, dtype=bool)
            for k in keys:
                c = t.column(k).to_numpy()
                other |= c != c[-1]
            cut = int(np.flatnonzero(other)[-1]) + 1
            yield t.slice(0, cut).combine_chunks()
            held = t.slice(cut).combine_chunks().to_batches()
            rows, total = t.num_rows - cut, sum(x.nbytes for x in held)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()

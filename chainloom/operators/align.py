"""Order-preserving alignment of two arrays by identity, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame


def matched_places(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of places of a longest common subsequence.

    >>> matched_places([1, 2, 2, 3], [2, 3])
    [(1, 0), (3, 1)]
    """
    n, m = len(a), len(b)
    best = np.zeros((n + 1, m + 1), np.int32)
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i, j] = best[i + 1, j + 1] + 1 if a[i] == b[j] else max(best[i + 1, j], best[i, j + 1])
    i = j = 0
    out = []
    while i < n and j < m:
        if a[i] == b[j] and best[i, j] == best[i + 1, j + 1] + 1:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1, j] >= best[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


def align(rows: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(key, i, j): matched places of two array columns."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for row, (x, y) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                for i, j in matched_places(x or [], y or []):
                    for column, v in zip(out, (row, i, j), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], names=[key, "i", "j"])

    return rows.select(key, a, b).mapInArrow(run, f"{key} {kind}, i bigint, j bigint")

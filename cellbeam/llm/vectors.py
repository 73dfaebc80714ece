"""Helpers shared by the operators on embeddings: list columns as matrices, sums of arrays by key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a list column as doubles, by length: (row numbers, matrix).

    Null rows and rows with a null, infinite or undefined entry are left out.
    """
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.fill_null(column.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    ends = np.cumsum(np.maximum(lengths, 0))
    bad = np.append(0, np.cumsum(~np.isfinite(values)))
    whole = (lengths >= 0) & (bad[ends] == bad[ends - np.maximum(lengths, 0)])
    for size in np.unique(lengths[whole]).tolist():
        rows = np.flatnonzero(whole & (lengths == size))
        yield rows, values[(ends[rows] - size)[:, None] + np.arange(size)]


def sum_arrays(parts: DataFrame) -> DataFrame:
    """``key, total`` from ``key (long), task (long), value (array<double>)``: sums by entry, in the order of ``task``.

    Only one array a key is held at a time, however many tasks contribute.
    """
    out = T.StructType([T.StructField("key", T.LongType()), T.StructField("total", T.ArrayType(T.DoubleType()))])

    def add(batches):
        now, total = None, None
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                row = value.values.to_numpy(zero_copy_only=False)
                if key != now:
                    if total is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([total], pa.list_(pa.float64()))], names=out.names)
                    now, total = key, row.copy()
                else:
                    total += row
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([total], pa.list_(pa.float64()))], names=out.names)

    return parts.repartition("key").sortWithinPartitions("key", "task").select("key", "value").mapInArrow(add, out)


def rotation(dims: int, seed: int) -> np.ndarray:
    """An orthogonal matrix that depends on its size and seed only."""
    return np.linalg.qr(np.random.default_rng([seed, dims]).normal(size=(dims, dims)))[0] if dims else np.zeros((0, 0))

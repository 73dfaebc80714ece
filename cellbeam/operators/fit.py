"""Fitting: gradient steps on grids, and small networks in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sgd_step(grid: DataFrame, gradient: DataFrame, keys: list[str], rate: float) -> DataFrame:
    return grid.join(gradient, keys, "left").withColumn("value", F.col("value") - rate * F.coalesce("gradient", F.lit(0.0))).drop("gradient")


def adam_step(grid: DataFrame, gradient: DataFrame, keys: list[str], step: int, rate: float = 1e-2, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8) -> DataFrame:
    """``grid``: keys, value, m, v."""
    g = F.coalesce("gradient", F.lit(0.0))
    j = grid.join(gradient, keys, "left").withColumn("m", b1 * F.col("m") + (1 - b1) * g).withColumn("v", b2 * F.col("v") + (1 - b2) * g * g)
    return j.withColumn("value", F.col("value") - rate * (F.col("m") / (1 - b1**step)) / (F.sqrt(F.col("v") / (1 - b2**step)) + eps)).drop("gradient")


def rmsprop_step(grid: DataFrame, gradient: DataFrame, keys: list[str], rate: float = 1e-2, alpha: float = 0.99, eps: float = 1e-8) -> DataFrame:
    """``grid``: keys, value, v."""
    g = F.coalesce("gradient", F.lit(0.0))
    j = grid.join(gradient, keys, "left").withColumn("v", alpha * F.col("v") + (1 - alpha) * g * g)
    return j.withColumn("value", F.col("value") - rate * g / (F.sqrt("v") + eps)).drop("gradient")


def decayed(rate: float, epoch: int, factor: float) -> float:
    return rate * factor**epoch


def init_network(sizes: list[int], seed: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Weights drawn uniformly with the bound sqrt(6 / inputs), zero biases."""
    rng = np.random.default_rng(seed)
    return [(rng.uniform(-np.sqrt(6 / a), np.sqrt(6 / a), (a, b)), np.zeros(b)) for a, b in zip(sizes, sizes[1:], strict=False)]


#: The activations of ``functions.columns.activation`` for arrays.
ACTIVATIONS = {
    "relu": lambda x: np.maximum(x, 0),
    "abs": np.abs,
    "softplus": lambda x: np.logaddexp(x, 0),
    "id": lambda x: x,
    "none": lambda x: x,
    "sigmoid": lambda x: 1 / (1 + np.exp(-x)),
    "leaky_relu": lambda x: np.where(x < 0, x * 0.01, x),
    "sin": np.sin,
}


def apply_network(x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], kind: str = "relu", last: str = "id") -> np.ndarray:
    """All outputs of a network: linear layers with ``kind`` between them and ``last`` at the end."""
    for i, (w, b) in enumerate(layers):
        x = ACTIVATIONS[last if i + 1 == len(layers) else kind](x @ w + b)
    return x


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A batch of arrays of one length as a matrix; a null entry is undefined."""
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    if len(flat) != len(column) * width:
        raise ValueError(f"the network takes {width} inputs in each row")
    return flat.reshape(-1, width)


def decode(features: Column, layers: list[tuple[np.ndarray, np.ndarray]], kind: str = "relu", last: str = "id") -> Column:
    """First output of a network over an array column, batch by batch."""

    @F.arrow_udf("double")
    def run(x: pa.Array) -> pa.Array:
        return pa.array(apply_network(_matrix(x, len(layers[0][0])), layers, kind, last)[:, 0])

    return run(features)


def decode_channels(features: Column, layers: list[tuple[np.ndarray, np.ndarray]], kind: str = "relu", last: str = "id") -> Column:
    """All outputs of a network over an array column, as an array."""

    @F.arrow_udf("array<double>")
    def run(x: pa.Array) -> pa.Array:
        y = apply_network(_matrix(x, len(layers[0][0])), layers, kind, last)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]), pa.array(y.ravel()))

    return run(features)


#: Derivatives of ACTIVATIONS; relu and abs have 0 at 0.
SLOPES = {
    "relu": lambda x: (x > 0).astype(float),
    "abs": np.sign,
    "softplus": lambda x: 1 / (1 + np.exp(-x)),
    "id": np.ones_like,
    "none": np.ones_like,
    "sigmoid": lambda x: 1 / (1 + np.exp(-x)) * (1 - 1 / (1 + np.exp(-x))),
    "leaky_relu": lambda x: np.where(x < 0, 0.01, 1.0),
    "sin": np.cos,
}


def back_propagate(x: np.ndarray, target: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], kind: str = "relu", last: str = "id") -> tuple[float, np.ndarray]:
    """Sum of squared errors of a batch and its gradient, all weights and biases end to end."""
    kinds = [kind] * (len(layers) - 1) + [last]
    held, h = [], x
    for (w, b), k in zip(layers, kinds, strict=True):
        raw = h @ w + b
        held.append((h, raw))
        h = ACTIVATIONS[k](raw)
    gap = h - target.reshape(h.shape)
    push, parts = 2 * gap, []
    for (w, _), k, (into, raw) in zip(reversed(layers), reversed(kinds), reversed(held), strict=True):
        push = push * SLOPES[k](raw)
        parts += [push.sum(0), (into.T @ push).ravel()]
        push = push @ w.T
    return float((gap * gap).sum()), np.concatenate(parts[::-1])


def network_gradient(rows: DataFrame, layers: list[tuple[np.ndarray, np.ndarray]], features: str = "features", target: str = "target", kind: str = "relu", last: str = "id") -> DataFrame:
    """``part, value``: mean squared error (part -1) and its gradient by every weight and bias, numbered end to end.

    Each task adds up its Arrow batches and sends one number per weight; the rest is a sum by number. Rows with
    a null feature list or target take no part; without rows there is no result.
    """
    schema = "part long, value double, n long"

    def run(batches):
        total, n = 0.0, 0
        for batch in batches:
            if batch.num_rows:
                x = np.stack(batch.column(0).to_numpy(zero_copy_only=False)).astype(float)
                y = np.array(batch.column(1).to_pylist(), float)
                loss, g = back_propagate(x, y, layers, kind, last)
                total, n = total + np.append(loss, g), n + len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(total) - 1)), pa.array(total), pa.array(np.full(len(total), n))], names=["part", "value", "n"])

    used = rows.where(F.col(features).isNotNull() & F.col(target).isNotNull()).select(features, target)
    sums = used.mapInArrow(run, schema).groupBy("part").agg(F.sum("value").alias("value"), F.sum("n").alias("n"))
    return sums.select("part", (F.col("value") / F.col("n")).alias("value"))


def unflatten(flat: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Weights and biases of a network's shape from their numbers end to end."""
    out, at = [], 0
    for w, b in layers:
        out.append((flat[at : at + w.size].reshape(w.shape), flat[at + w.size : at + w.size + b.size]))
        at += w.size + b.size
    return out


def fit_network(rows: DataFrame, layers: list[tuple[np.ndarray, np.ndarray]], steps: int, rate: float = 1e-2, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8, **kw) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[float]]:
    """A network after some Adam steps over all rows, and the loss before each step.

    A step is one pass over the rows; the driver holds weights and moments, whose size is the network's.
    """
    flat = np.concatenate([x for w, b in layers for x in (w.ravel(), b)])
    m, v, losses = np.zeros_like(flat), np.zeros_like(flat), []
    for step in range(1, steps + 1):
        got = network_gradient(rows, unflatten(flat, layers), **kw).orderBy("part").collect()
        if not got:
            break
        losses.append(got[0]["value"])
        g = np.array([r["value"] for r in got[1:]])
        m, v = b1 * m + (1 - b1) * g, b2 * v + (1 - b2) * g * g
        flat = flat - rate * (m / (1 - b1**step)) / (np.sqrt(v / (1 - b2**step)) + eps)
    return unflatten(flat, layers), losses


def remove_along(g: tuple[Column, ...], d: tuple[Column, ...]) -> tuple[Column, ...]:
    """A gradient without its component along a unit direction."""
    dot = g[0] * d[0] + g[1] * d[1] + g[2] * d[2]
    return tuple(a - dot * b for a, b in zip(g, d, strict=True))

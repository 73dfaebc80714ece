"""Dense sampling: lattices over the volume or a slice of it, densities from node grids, rendering and voxel tables."""

from __future__ import annotations

from math import prod

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import AXES, activation, activation_slope, delinearize
from ..sources.tables import settled
from .active import local_in
from .fit import decode
from .interp import gather_cells, grid_gradient, interpolate, place
from .points import leaf_key, locate
from .rays import integrate
from .tree import boxes, level_start


#: Cells of node grids, all channels together, up to which the grids are sent to the samples: 32 MB of doubles.
BROADCAST_CELLS = 1 << 22


def node_arrays(grid: DataFrame, cells: dict[str, int], channels: list[str] | None = None) -> DataFrame:
    """``gather_cells`` of all nodes, written once; broadcast up to ``BROADCAST_CELLS``, so that samples are not shuffled."""
    nodes = settled(gather_cells(grid, cells, "node_id", channels))
    return F.broadcast(nodes) if nodes.count() * prod(cells.values()) * len(channels or [1]) <= BROADCAST_CELLS else nodes


def lattice_cells(spark: SparkSession, size: tuple[int, int, int], last_fastest: bool = False) -> DataFrame:
    """``i, cx, cy, cz``: all cells of a lattice; the first axis runs fastest unless told otherwise."""
    c = delinearize(F.col("id"), size, last_fastest)
    return spark.range(size[0] * size[1] * size[2]).select(F.col("id").alias("i"), *[x.cast("int").alias(f"c{a}") for a, x in zip(AXES, c, strict=True)])


def uniform_volume(spark: SparkSession, size: tuple[int, int, int], depth: int, last_fastest: bool = False, active: DataFrame | None = None) -> DataFrame:
    """``i, cx, cy, cz, x, y, z, node_id``: a lattice over [-1, 1] per axis, ends included, and the leaf of each point.

    With ``active`` (node_id) it is the active node that holds the point, of any level down to ``depth``, or NULL.
    """
    g = lattice_cells(spark, size, last_fastest)
    at = [(F.col(f"c{a}") / (n - 1) * 2 - 1).alias(a) for a, n in zip(AXES, size, strict=True)]
    return in_node(g.select("*", *at), depth, active)


def in_node(points: DataFrame, depth: int, active: DataFrame | None = None) -> DataFrame:
    """Adds ``node_id``: the leaf of x, y, z, or the active node there."""
    return points.withColumn("node_id", leaf_key(depth)) if active is None else locate(points, active, depth).withColumnRenamed("active_node", "node_id")


def uniform_slice(spark: SparkSession, size: tuple[int, int, int], lo: tuple[float, ...], step: tuple[float, ...], depth: int | None = None, last_fastest: bool = False, active: DataFrame | None = None) -> DataFrame:
    """``i, cx, cy, cz, x, y, z`` at lo + step * cell; with ``depth`` also the leaf (or active node) of each point, NULL outside."""
    g = lattice_cells(spark, size, last_fastest)
    g = g.select("*", *[(F.lit(float(a0)) + F.lit(float(s)) * F.col(f"c{a}")).alias(a) for a, a0, s in zip(AXES, lo, step, strict=True)])
    return g if depth is None else in_node(g, depth, active)


def local_of(depth: int, node: str = "node_id") -> dict[str, Column]:
    """Coordinates in [-1, 1] inside the node of a level; boxes follow from the id, so no node table is joined."""
    box = boxes(F.col(node) - level_start(depth), depth)
    return {a: (F.col(a) - box[2 * k]) / (box[2 * k + 1] - box[2 * k]) * 2 - 1 for k, a in enumerate(AXES)}


def node_places(depth: int, size: int, mixed: bool = False) -> tuple[dict[str, Column], dict[str, int]]:
    """Positions in cell units inside ``node_id``, ends of the node on the outer cells, and the cells per axis.

    ``mixed``: nodes stand on any level down to ``depth``, else all on that level.
    """
    local = local_in("node_id", depth) if mixed else local_of(depth)
    return {a: (c + 1.0) * ((size - 1) / 2.0) for a, c in reversed(local.items())}, {a: size for a in reversed(AXES)}


def sample_volume(samples: DataFrame, grid: DataFrame, depth: int, size: int, layers: list[tuple[np.ndarray, np.ndarray]] | None = None, kind: str = "softplus", out: str = "density", mixed: bool = False) -> DataFrame:
    """Adds the density at each sample (x, y, z in node_id): node grid, decoder, activation, mask.

    Nodes stand on the level ``depth``, or with ``mixed`` on any level down to it.

    ``grid``: node_id, iz, iy, ix and value, or one column per channel (``value0``, ``value1``...) for a decoder
    with as many inputs. Samples outside all nodes, or in a node without a grid, get 0. The grids travel once per
    node as arrays; samples are neither exploded nor summed again, and shuffled only where the grids are too large
    to be broadcast.
    """
    channels = sorted(c for c in grid.columns if c.startswith("value"))
    where, cells = node_places(depth, size, mixed)
    nodes = node_arrays(grid, cells, channels)
    j = place(samples, where, cells).join(nodes, "node_id", "left")
    features = [interpolate(f"__{c}", where, cells) for c in channels]
    raw = decode(F.array(*[F.coalesce(f, F.lit(0.0)) for f in features]), layers) if layers else features[0]
    known = F.col("node_id").isNotNull() & F.col(f"__{channels[0]}").isNotNull()
    j = j.withColumn("__raw", raw)
    return j.select(*samples.columns, F.when(known, activation(F.col("__raw"), kind)).otherwise(0.0).alias(out))


def render(rays: DataFrame, samples: DataFrame, grid: DataFrame, depth: int, size: int, **kw) -> DataFrame:
    """``ray_id, integral``: densities of a ray's samples from the node grids, times their weights, summed."""
    return integrate(rays, sample_volume(samples, grid, depth, size, out="value", **kw))


def residuals(rendered: DataFrame, targets: DataFrame, target: str = "target") -> DataFrame:
    """``ray_id, residual``: derivative of the rays' mean squared error by each ray's integral."""
    n = targets.count()
    return rendered.join(targets.select("ray_id", target).hint("merge"), "ray_id").select("ray_id", ((F.col("integral") - F.col(target)) * (2.0 / max(n, 1))).alias("residual"))


def render_gradient(rays: DataFrame, samples: DataFrame, grid: DataFrame, depth: int, size: int, kind: str = "softplus", mixed: bool = False) -> DataFrame:
    """``node_id, iz, iy, ix, gradient``: the reverse pass of ``render``, from ``rays`` (ray_id, residual) to the grids' cells.

    A sample hands its ray's residual on to the cells around it, times its weight, the activation's slope there and
    the cell's share. Shares of a cell are summed before the only shuffle that grows with the samples. Samples in
    nodes without a grid have none; a cell that its grid lacks counts as 0 and gets a gradient all the same.
    Samples that carry their ray's ``residual`` already (see ``ray_samples``) are not joined with ``rays``.
    """
    where, cells = node_places(depth, size, mixed)
    known = samples if "residual" in samples.columns else samples.join(rays.select("ray_id", "residual"), "ray_id")
    j = place(known, where, cells).join(node_arrays(grid, cells), "node_id")
    pushed = j.withColumn("__push", F.col("residual") * F.col("weight") * activation_slope(interpolate("__value", where, cells), kind))
    return grid_gradient(pushed, "__push", {a: F.col(f"__q_{a}") for a in where}, cells)


def voxels(sampled: DataFrame, value: str = "density") -> DataFrame:
    """Voxel table ``ix, iy, iz, value, node_id, valid`` of a sampled lattice: 0 and not valid outside all nodes."""
    inside = F.col("node_id").isNotNull()
    return sampled.select(*[F.col(f"c{a}").alias(f"i{a}") for a in AXES], F.when(inside, F.col(value)).otherwise(0.0).alias("value"), "node_id", inside.alias("valid"))

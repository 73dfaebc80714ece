"""Adaptive octrees and quadtrees as node tables with Morton ids.

Ids are breadth first: a level starts after all nodes above it, and inside a level
nodes stand in Morton order, so parents, children and boxes follow by arithmetic
and no join is needed to walk the tree.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import AXES, in_roi
from .batches import numbered


def level_start(depth: int, fan: int = 8) -> int:
    return (fan**depth - 1) // (fan - 1)


def cell_of(m: Column, depth: int, quad: bool = False) -> dict[str, Column]:
    """Cell numbers per axis from a Morton number; a quadtree splits x and z only."""
    axes = ("x", "z") if quad else AXES
    k = len(axes)
    return {a: reduce(lambda p, q: p + q, [F.shiftright(m, k * b + i).bitwiseAND(F.lit(1)) * (1 << b) for b in range(depth)], F.lit(0).cast("long")) for i, a in enumerate(axes)}


def morton_of(cells: dict[str, Column], depth: int, quad: bool = False) -> Column:
    axes = ("x", "z") if quad else AXES
    k = len(axes)
    return reduce(lambda p, q: p + q, [F.shiftright(cells[a], b).bitwiseAND(F.lit(1)) * (1 << (k * b + i)) for b in range(depth) for i, a in enumerate(axes)], F.lit(0).cast("long"))


def boxes(m: Column, depth: int, quad: bool = False, y: tuple[float, float] = (-1.0, 1.0)) -> list[Column]:
    """x0..z1 of a node of one level."""
    cells, width = cell_of(m, depth, quad), 2.0 / (1 << depth)
    out = []
    for a in AXES:
        if quad and a == "y":
            out += [F.lit(y[0]).alias("y0"), F.lit(y[1]).alias("y1")]
        else:
            out += [(cells[a] * width - 1.0).alias(f"{a}0"), ((cells[a] + 1) * width - 1.0).alias(f"{a}1")]
    return out


def full_tree(spark: SparkSession, max_depth: int, quad: bool = False, y: tuple[float, float] = (-1.0, 1.0)) -> DataFrame:
    """``node_id, parent_id, depth, morton, x0..z1, scale`` of all nodes down to ``max_depth``."""
    fan = 4 if quad else 8
    levels = []
    for d in range(max_depth + 1):
        m = F.col("id")
        parent = (F.lit(level_start(d - 1, fan)) + F.shiftright(m, 2 if quad else 3)) if d else F.lit(None)
        scale = d / max_depth * 2 - 1 if max_depth else 0.0
        levels.append(spark.range(fan**d).select((m + level_start(d, fan)).alias("node_id"), parent.cast("long").alias("parent_id"), F.lit(d).alias("depth"), m.alias("morton"), *boxes(m, d, quad, y), F.lit(float(scale)).alias("scale")))
    return reduce(DataFrame.unionByName, levels)


def set_active(nodes: DataFrame, depth: int) -> DataFrame:
    return nodes.withColumn("active", F.col("depth") == depth)


def active_rank(nodes: DataFrame) -> DataFrame:
    """``active_rank``: place among the active nodes by id, NULL elsewhere; counted in ranges of the ids."""
    ranks = numbered(nodes.where("active").select("node_id"), "node_id").select(F.col("node_id").alias("__n"), F.col("n").alias("active_rank"))
    return nodes.join(ranks, nodes["node_id"] == F.col("__n"), "left").drop("__n")


def cull_fixpoint(nodes: DataFrame, max_depth: int) -> DataFrame:
    """A node is culled if all its children are, from the lowest level up; a leaf only explicitly. Errors of culled nodes become 0."""
    flags = nodes.select("node_id", "parent_id", "depth", "culled")
    for d in range(max_depth - 1, -1, -1):
        up = flags.where(F.col("depth") == d + 1).groupBy(F.col("parent_id").alias("p")).agg(F.min(F.col("culled").cast("int")).alias("every"))
        flags = flags.join(up, flags["node_id"] == up["p"], "left").select("node_id", "parent_id", "depth", (F.col("culled") | F.coalesce(F.col("every") == 1, F.lit(False))).alias("culled"))
    return nodes.drop("culled").join(flags.select("node_id", "culled"), "node_id").withColumn("error", F.col("error") * F.when(F.col("culled"), 0.0).otherwise(1.0))


def update_active(nodes: DataFrame) -> DataFrame:
    """Fails if a node is active and culled; else the ranked table."""
    return active_rank(nodes.withColumn("active", F.when(F.col("active") & F.col("culled"), F.raise_error(F.lit("an active node is culled"))).otherwise(F.col("active"))))


def set_errors(nodes: DataFrame, errors: DataFrame, mode: str = "override") -> DataFrame:
    """New errors of active nodes: 'override' replaces, 'min' keeps the smaller (no error counts as none)."""
    j = nodes.join(errors.select("node_id", F.col("error").alias("__new")), "node_id", "left")
    new = F.col("__new") if mode == "override" else F.least(F.coalesce("error", F.lit(1e6)), F.coalesce("__new", F.lit(1e6)))
    return j.withColumn("error", F.when(F.col("active"), F.coalesce(new, F.col("error"))).otherwise(F.col("error"))).drop("__new")


def roi_errors(nodes: DataFrame, lo, hi, push: bool = False, tv: tuple | None = None, **kw) -> DataFrame:
    """Outside the region errors are 0; with ``push``, 1e6 inside it and 1e9 inside the region ``tv``."""
    inside = in_roi(lo, hi, **kw)
    value = F.when(inside, F.lit(1e6)).otherwise(F.lit(0.0)) if push else F.when(inside, F.col("error")).otherwise(F.lit(0.0))
    if tv:
        value = F.when(in_roi(*tv, **kw), F.lit(1e9)).otherwise(value)
    return nodes.withColumn("error", value)


def cull_by_density(nodes: DataFrame, threshold: float, lo, hi) -> DataFrame:
    """Active nodes below the density and outside the region are culled and deactivated."""
    gone = F.col("active") & (F.col("max_density") < threshold) & ~in_roi(lo, hi)
    return nodes.withColumn("culled", F.col("culled") | gone).withColumn("active", F.col("active") & ~gone)


def apply_plan(nodes: DataFrame, plan: DataFrame, fan: int = 8) -> DataFrame:
    """New active flags from ``plan`` (node_id, action none/split/merge): children that are not culled, or the parent."""
    acts = nodes.where("active").join(plan, "node_id", "left").select("node_id", "parent_id", F.coalesce("action", F.lit("none")).alias("action"))
    kids = acts.where("action = 'split'").select(F.col("node_id").alias("p"))
    on = acts.where("action = 'none'").select("node_id").union(acts.where("action = 'merge'").select("parent_id")).union(nodes.where(~F.col("culled")).join(kids, nodes["parent_id"] == kids["p"], "left_semi").select("node_id")).distinct()
    flagged = nodes.join(on.withColumn("__on", F.lit(True)), "node_id", "left")
    return flagged.withColumn("active", F.coalesce("__on", F.lit(False))).drop("__on")

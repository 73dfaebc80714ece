"""Rays against boxes: hits by plane crossings, sample generation, weights and integration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import slab
from .tree import level_start, morton_of

RAY = ("ray_id", "ox", "oy", "oz", "dx", "dy", "dz")


def ray_node_hits(rays: DataFrame, depth: int, quad: bool = False, y=(-1.0, 1.0), min_length: float = 1e-5, carry: tuple[str, ...] = ()) -> DataFrame:
    """``ray_id.., node_id, tmin, tmax`` of every ray and every node of a level that it crosses.

    A ray's crossings with all planes of the level are sorted; between two of them it is in one node, whose
    Morton id follows from the middle. A ray costs what it crosses: there is no test against nodes, no join, no
    shuffle and nothing to broadcast, whatever the number of nodes. A zero direction component stays in the
    half-open cell of its origin; parts shorter than ``min_length`` or wholly behind the origin are left out.
    ``carry``: columns of the rays that their hits keep, so that hits and samples need not be joined with rays again.
    """
    n = 1 << depth
    split = {a: (y[0], y[1], 1) if quad and a == "y" else (-1.0, 1.0, n) for a in "xyz"}
    planes = []
    for a, (lo, hi, k) in split.items():
        o, d = F.col(f"o{a}"), F.col(f"d{a}")
        at = [F.lit(lo + i * ((hi - lo) / k)) for i in range(k + 1)]
        planes.append(F.when(d != 0, F.array(*[(p - o) / d for p in at])).otherwise(F.array().cast("array<double>")))
    own = (*RAY, *carry)
    t = rays.select(*own, F.sort_array(F.concat(*planes)).alias("t"))
    pairs = F.arrays_zip(F.slice("t", 1, F.greatest(F.size("t") - 1, F.lit(0))).alias("tmin"), F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0))).alias("tmax"))
    part = t.select(*own, F.explode(pairs).alias("p")).select(*own, "p.tmin", "p.tmax").where((F.col("tmax") - F.col("tmin") >= min_length) & (F.col("tmax") >= 0))
    middle = (F.col("tmin") + F.col("tmax")) / 2
    cell = {a: F.floor((F.col(f"o{a}") + F.col(f"d{a}") * middle - lo) / ((hi - lo) / k)) for a, (lo, hi, k) in split.items()}
    part = part.select(*own, "tmin", "tmax", *[c.alias(f"c{a}") for a, c in cell.items()])
    for a, (_, _, k) in split.items():
        part = part.where(F.col(f"c{a}").between(0, k - 1))
    node = morton_of({a: F.col(f"c{a}") for a in "xyz"}, depth, quad) + level_start(depth, 4 if quad else 8)
    return part.select(*own, node.alias("node_id"), "tmin", "tmax")


def ray_box_hits(rays: DataFrame, lo, hi, min_length: float = 1e-5) -> DataFrame:
    """The one-box case (a region of interest): node_id 0."""
    boxed = rays.select(*RAY, *[F.lit(float(v)).alias(f"{a}{k}") for k, vs in ((0, lo), (1, hi)) for a, v in zip("xyz", vs, strict=True)])
    tmin, tmax, hit = slab()
    return boxed.select(*RAY, F.lit(0).cast("long").alias("node_id"), tmin.alias("tmin"), tmax.alias("tmax"), hit.alias("hit")).where("hit").where(F.col("tmax") - F.col("tmin") >= min_length).drop("hit")


def ray_samples(hits: DataFrame, diagonal: float | Column, per_diagonal: int = 32, jitter: Callable[[Column], Column] | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """``ray_id, node_id, j, t, weight, x, y, z``: one sample in each of ceil(length / diagonal * n) parts of each interval.

    Samples stand in the middle of their parts, or where ``jitter`` puts the j-th, from 0 to 1. Weights are half
    intervals to the neighbours clamped to the ends, so they sum to the length. All of a part's neighbours are
    known by arithmetic: no window, no shuffle. ``carry``: columns of the hits that their samples keep.
    """
    n = F.ceil((F.col("tmax") - F.col("tmin")) / diagonal * per_diagonal).cast("long")
    part = hits.withColumn("n", F.greatest(n, F.lit(1).cast("long"))).withColumn("step", (F.col("tmax") - F.col("tmin")) / F.col("n"))
    s = part.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    j, step = F.col("j"), F.col("step")
    if jitter is None:
        s = s.withColumn("t", F.col("tmin") + (j + 0.5) * step)
        before, behind = F.col("t") - step / 2, F.col("t") + step / 2
    else:
        s = s.withColumns({name: F.col("tmin") + (k + jitter(k)) * step for name, k in (("t", j), ("__before", j - 1), ("__behind", j + 1))})
        before, behind = (F.col("__before") + F.col("t")) / 2, (F.col("__behind") + F.col("t")) / 2
    left = F.when(j == 0, F.col("tmin")).otherwise(before)
    right = F.when(j == F.col("n") - 1, F.col("tmax")).otherwise(behind)
    return s.select("ray_id", "node_id", "j", "t", (right - left).alias("weight"), *[(F.col(f"o{a}") + F.col(f"d{a}") * F.col("t")).alias(a) for a in "xyz"], *carry)


def sample_offsets(hits: DataFrame, diagonal: float, per_diagonal: int = 32) -> DataFrame:
    """``first``: number of a ray's samples before each interval, by entry and node."""
    n = F.greatest(F.ceil((F.col("tmax") - F.col("tmin")) / diagonal * per_diagonal).cast("long"), F.lit(1).cast("long"))
    w = W.partitionBy("ray_id").orderBy("tmin", "node_id").rowsBetween(W.unboundedPreceding, -1)
    return hits.select("ray_id", "node_id", "tmin", n.alias("n")).withColumn("first", F.coalesce(F.sum("n").over(w), F.lit(0)))


def half_interval_weights(samples: DataFrame) -> DataFrame:
    """The general form for given t: halves to the neighbours, clamped to tmin and tmax at the ends."""
    w = W.partitionBy("ray_id", "node_id").orderBy("j")
    t = F.col("t")
    right, left = F.coalesce((F.lead("t").over(w) + t) / 2, F.col("tmax")), F.coalesce((F.lag("t").over(w) + t) / 2, F.col("tmin"))
    return samples.withColumn("weight", right - left)


def integrate(rays: DataFrame, samples: DataFrame, value: str = "value") -> DataFrame:
    """``ray_id, integral`` = sum of value * weight; rays without a sample get 0."""
    s = samples.groupBy("ray_id").agg(F.sum(F.col(value) * F.col("weight")).alias("integral"))
    # both sides are one row a ray: a merge keeps them off the driver, where a broadcast would be built
    return rays.select("ray_id").join(s.hint("merge"), "ray_id", "left").select("ray_id", F.coalesce("integral", F.lit(0.0)).alias("integral"))


def integrate_bound(samples: DataFrame, inside: str, value: str = "value") -> DataFrame:
    """Sums over the samples inside and over all, with their ratios; a missing divisor gives 1 and 0."""
    s = samples.groupBy("ray_id").agg(F.sum(F.when(F.col(inside), F.col(value) * F.col("weight")).otherwise(0.0)).alias("integral"), F.sum(F.when(F.col(inside), F.col("weight")).otherwise(0.0)).alias("w_in"), F.sum("weight").alias("w_all"))
    return s.withColumn("in_by_all", F.when(F.col("w_all") > 0, F.col("w_in") / F.col("w_all")).otherwise(1.0)).withColumn("all_by_in", F.when(F.col("w_in") > 0, F.col("w_all") / F.col("w_in")).otherwise(0.0))


def alpha_blend(samples: DataFrame, density: str = "density", colour: str = "value", gain: float = 10.0) -> DataFrame:
    """``ray_id, blended``: sum of alpha * transmittance * colour along each ray by t.

    A ray's samples are bounded by the grid, so they are folded as one sorted array.
    """
    step = F.struct("t", F.col(density).alias("d"), F.col("weight").alias("w"), F.col(colour).alias("c"))
    rows = samples.groupBy("ray_id").agg(F.array_sort(F.collect_list(step)).alias("s"))
    start = F.struct(F.lit(1.0).alias("left"), F.lit(0.0).alias("sum"))

    def fold(acc, x):
        alpha = 1 - F.exp(-gain * x["d"] * x["w"])
        return F.struct((acc["left"] * (1 - alpha + 1e-10)).alias("left"), (acc["sum"] + alpha * acc["left"] * x["c"]).alias("sum"))

    return rows.select("ray_id", F.aggregate("s", start, fold, lambda a: a["sum"]).alias("blended"))

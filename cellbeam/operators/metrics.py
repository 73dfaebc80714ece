"""Losses and statistics over samples, nodes and images."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import loss_weight
from .windows import box_sum, over_tiles


def node_loss(samples: DataFrame, ray_loss: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node_id, loss, weight``: sum of ray loss * weight and of weight; every node is there, 0 without samples."""
    s = samples.join(ray_loss, "ray_id").groupBy("node_id").agg(F.sum(F.col("loss") * F.col("weight")).alias("loss"), F.sum("weight").alias("weight"))
    return nodes.select("node_id").join(s, "node_id", "left").fillna(0.0, ["loss", "weight"])


def node_stats(samples: DataFrame, value: str = "value", node: str = "node_id") -> DataFrame:
    return samples.groupBy(node).agg(F.max(value).alias("max"), F.stddev_samp(value).alias("std"), F.sum(value).alias("sum"), F.product(value).alias("product"))


def image_errors(pixels: DataFrame, a: str, b: str, image: str = "image_id") -> DataFrame:
    """Mean over images of the mean squared and absolute error, and PSNR of a peak of 1."""
    d = F.col(a) - F.col(b)
    per = pixels.groupBy(image).agg(F.avg(d * d).alias("mse"), F.avg(F.abs(d)).alias("l1"))
    return per.agg(F.avg("mse").alias("mse"), F.avg("l1").alias("l1")).withColumn("psnr", F.log10(1 / F.col("mse")) * 10)


def volume_psnr(cells: DataFrame, prediction: str, target: str, volume: str = "node_id") -> DataFrame:
    """``volume, peak, mse, psnr`` of each volume, with the target's largest value as its peak."""
    d = F.col(prediction) - F.col(target)
    per = cells.groupBy(volume).agg(F.max(target).alias("peak"), F.avg(d * d).alias("mse"))
    return per.withColumn("psnr", F.log10(F.col("peak") * F.col("peak") / F.col("mse")) * 10)


def loss_of(prediction: str, target: str, kind: str = "none", mse: float = 1.0, l1: float = 0.0, scale: float = 1.0) -> Column:
    """The weighted squared and absolute error as one aggregate, so that several losses share a pass."""
    d = F.col(prediction) - F.col(target)
    w = loss_weight(F.col(target), kind)
    return (F.avg(w * d * d) * mse + F.avg(w * F.abs(d)) * l1) * scale


def training_loss(rays: DataFrame, prediction: str, target: str, **kw) -> DataFrame:
    return rays.agg(loss_of(prediction, target, **kw).alias("loss"), F.count(F.lit(1)).alias("n"))


def weighted_sum(terms: list[tuple[DataFrame, str, float]]) -> DataFrame:
    """``loss``: the mean of each table's column times its weight, summed."""
    means = [df.agg((F.avg(column) * weight).alias("loss")) for df, column, weight in terms]
    return reduce(DataFrame.unionByName, means).agg(F.sum("loss").alias("loss"))


def running_loss(batches: DataFrame) -> DataFrame:
    return batches.agg((F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("loss"))


def background(images: DataFrame, crop: int, all_ids: DataFrame, image: str = "image_id") -> DataFrame:
    """Lower median of each image's corner crop; images without one get the mean of the others."""
    m = images.where((F.col("row") < crop) & (F.col("col") < crop)).groupBy(image).agg(F.expr("percentile_disc(0.5) within group (order by value)").alias("median"))
    mean = m.agg(F.avg("median").alias("__mean"))
    return all_ids.select(image).join(m, image, "left").crossJoin(F.broadcast(mean)).select(image, F.coalesce("median", "__mean").alias("background"))


def weight_maps(density: DataFrame, lam: float, lo: float, hi: float) -> DataFrame:
    """Weights from a cell density: min / x * lam, x / max * lam, and a linear map of both ends to [lo, hi]."""
    ends = density.agg(F.min("density").alias("mn"), F.max("density").alias("mx"))
    x = F.col("density")
    return density.crossJoin(F.broadcast(ends)).select("node_id", (F.col("mn") / x * lam).alias("tv"), (x / F.col("mx") * lam).alias("nlm"), ((x - F.col("mn")) / (F.col("mx") - F.col("mn")) * (hi - lo) + lo).alias("scaled"))


def _steps(images: DataFrame, image: str) -> tuple[Column, Column]:
    by_row, by_col = W.partitionBy(image, "row").orderBy("col"), W.partitionBy(image, "col").orderBy("row")
    return F.lead("value").over(by_row) - F.col("value"), F.lead("value").over(by_col) - F.col("value")


def total_variation(images: DataFrame, image: str = "image_id") -> DataFrame:
    dx, dy = _steps(images, image)
    return images.select(image, dx.alias("dx"), dy.alias("dy")).groupBy(image).agg((F.avg(F.abs("dx")) + F.avg(F.abs("dy"))).alias("tv"))


def huber_variation(images: DataFrame, delta: float, image: str = "image_id") -> DataFrame:
    dx, dy = _steps(images, image)
    h = lambda c: F.when(F.abs(c) < delta, F.col(c) * F.col(c) / 2).otherwise(delta * (F.abs(F.col(c)) - delta / 2))
    return images.select(image, dx.alias("dx"), dy.alias("dy")).groupBy(image).agg((F.avg(h("dx")) + F.avg(h("dy"))).alias("huber"))


def edge_map(images: DataFrame, image: str = "image_id") -> DataFrame:
    """|right - left| + |below - above| of each pixel, clamped to 1; a missing neighbour counts as 0."""
    by_row, by_col = W.partitionBy(image, "row").orderBy("col"), W.partitionBy(image, "col").orderBy("row")
    z = F.lit(0.0)
    gx = F.coalesce(F.lead("value").over(by_row), z) - F.coalesce(F.lag("value").over(by_row), z)
    gy = F.coalesce(F.lead("value").over(by_col), z) - F.coalesce(F.lag("value").over(by_col), z)
    return images.select(image, "row", "col", F.least(F.abs(gx) + F.abs(gy), F.lit(1.0)).alias("edge"))


def ssim(images: DataFrame, a: str, b: str, reach: int = 1, c1: float = 1e-4, c2: float = 9e-4, image: str = "image_id", axes: tuple[str, ...] = ("row", "col")) -> DataFrame:
    """Mean structural similarity over square (or, with three ``axes``, cubic) windows around all cells.

    A window takes the cells that there are: fewer at the border and beside missing ones. Images are cut into tiles
    with a margin, so about one row a cell is shuffled, and windows are running sums. A null ends no job: its
    cell counts as missing.
    """

    def score(known, arrays, inner, origin):
        x, y = arrays
        n, *sums = [box_sum(v, reach, 1)[inner] for v in (known.astype(float), x, y, x * x, y * y, x * y)]
        own = known[inner]
        ma, mb, aa, bb, ab = [(v / np.maximum(n, 1))[own] for v in sums]
        s = ((2 * ma * mb + c1) * (2 * (ab - ma * mb) + c2)) / ((ma * ma + mb * mb + c1) * (aa - ma * ma + bb - mb * mb + c2))
        tile = np.nonzero(own)[0]
        return np.arange(len(own)), np.bincount(tile, s, len(own)).astype(float), np.bincount(tile, minlength=len(own))

    tiles = over_tiles(images, image, axes, (a, b), reach, score, "s double, n long")
    return tiles.groupBy(image).agg((F.sum("s") / F.sum("n")).alias("ssim")).where("ssim is not null")


def smoothness(curve: DataFrame, top: float, key: str = "curve_id") -> DataFrame:
    """Mean squared distance of each knot to the mean of its neighbours; the ends are pinned to 0 and ``top``."""
    w = W.partitionBy(key).orderBy("knot")
    near = (F.lead("value").over(w) + F.lag("value").over(w)) / 2
    want = F.when(F.lag("value").over(w).isNull(), F.lit(0.0)).when(F.lead("value").over(w).isNull(), F.lit(float(top))).otherwise(near)
    d = F.col("value") - F.col("want")
    return curve.withColumn("want", want).groupBy(key).agg(F.avg(d * d).alias("smoothness"))


def edge_loss(pairs: DataFrame, key: str = "point_id") -> DataFrame:
    """Root of the mean squared feature gap over the two sides of each pair."""
    gap = pairs.groupBy(key, "axis").agg((F.max(F.when(F.col("side") == 0, F.col("feature"))) - F.max(F.when(F.col("side") == 1, F.col("feature")))).alias("gap"))
    return gap.agg(F.sqrt(F.avg(F.col("gap") * F.col("gap"))).alias("edge_loss"), F.count(F.lit(1)).alias("pairs"))

"""Splits, samples and unions of row sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import keyed_uniform


def bisect(cuts: list[float], x: Column) -> Column:
    """How many of the sorted ``cuts`` are at most x, by halving: some fourteen look-ups among 10,000 cuts."""
    if not cuts:
        return F.lit(0)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])
    known = F.array(*[F.lit(c) for c in cuts])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(known, at + s - 1) <= x, at + s).otherwise(at))


def range_of(rows: DataFrame, key: str) -> Column:
    """Number of the range of a numeric key that a row is in; as many ranges as shuffle partitions, about equal ones.

    The cuts come from one pass that keeps a sketch a task. They are constants of the plan, so all its branches and
    retries number alike, which a plain range exchange would not promise.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = rows.stat.approxQuantile(key, [i / parts for i in range(1, parts)], 0.01) if parts > 1 else []
    return bisect(sorted(set(cuts)), F.col(key))


def numbered(ids: DataFrame, key: str) -> DataFrame:
    """``n``: place by key from 0, and ``total``. Places are counted in ranges of the key, then shifted.

    The ranges are cut by quantiles, so no task holds all ids.
    """
    r = ids.withColumn("__range", range_of(ids, key))
    counts = r.groupBy("__range").agg(F.count(F.lit(1)).alias("c"))
    before = counts.select("__range", (F.sum("c").over(W.orderBy("__range")) - F.col("c")).alias("base"), F.sum("c").over(W.partitionBy()).alias("total"))
    place = r.withColumn("__r", F.row_number().over(W.partitionBy("__range").orderBy(key)) - 1)
    return place.join(F.broadcast(before), "__range").withColumn("n", F.col("__r") + F.col("base")).drop("__r", "base", "__range")


def split_uniform(ids: DataFrame, key: str, test: int) -> DataFrame:
    """``test`` ids at even steps are held out: split is 'test' or 'train'."""
    x = numbered(ids, key)
    step = F.col("total") / test
    k = F.round(F.col("n") / step)
    return x.select(key, F.when((F.round(k * step) == F.col("n")) & (k < test), "test").otherwise("train").alias("split"))


def split_last(ids: DataFrame, key: str, test: int) -> DataFrame:
    return numbered(ids, key).select(key, F.when(F.col("n") >= F.col("total") - test, "test").otherwise("train").alias("split"))


def split_prefix(ids: DataFrame, key: str, share: float) -> DataFrame:
    return numbered(ids, key).select(key, F.when(F.col("n") < F.round(F.col("total") * share), "train").otherwise("test").alias("split"))


def reduce_uniform(ids: DataFrame, key: str, n: int) -> DataFrame:
    """Every (total / n)-th id, at rounded steps."""
    return split_uniform(ids, key, n).where("split = 'test'").select(key)


def drop_near(ids: DataFrame, others: DataFrame, key: str, reach: int) -> DataFrame:
    """Ids with no other id within ``reach``: the others are spread over their reach, an equi anti join follows."""
    near = others.select(F.explode(F.sequence(F.col(key) - reach, F.col(key) + reach)).alias(key)).distinct()
    return ids.join(near, key, "left_anti")


def concatenate(parts: list[DataFrame]) -> DataFrame:
    """UNION ALL by name; columns that some parts lack are NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def random_batch(pixels: DataFrame, images: int, share: float, seed: int, key: str = "pixel_id") -> DataFrame:
    """Pixels of about ``share`` of the rows, each moved to a random place in a random image.

    What is drawn depends on the seed and the row's key only, not on how rows are dealt out.
    """
    k = F.col(key)
    drawn = pixels.where(keyed_uniform(seed, "draw", k) < share)
    return drawn.withColumn("image_id", F.floor(keyed_uniform(seed, "image", k) * images) + 1).withColumns({c: keyed_uniform(seed, c, k) for c in ("u", "v")})


def random_scene_batch(pixels: DataFrame, images: DataFrame, share: float, seed: int, key: str = "pixel_id") -> DataFrame:
    """As ``random_batch`` for several scenes: one scene is drawn for the whole batch, then images of that scene.

    ``images``: scene_id, image_id. The scene is the one with the least number by the seed; its images are numbered
    by id, and every sampled pixel gets one of them.
    """
    scene = images.select("scene_id").distinct().orderBy(keyed_uniform(seed, "scene", F.col("scene_id")), "scene_id").limit(1)
    here = numbered(images.join(F.broadcast(scene), "scene_id").select("scene_id", "image_id").distinct(), "image_id").select("scene_id", "image_id", "n", "total")
    k = F.col(key)
    drawn = pixels.where(keyed_uniform(seed, "draw", k) < share).drop("image_id", "scene_id").withColumns({c: keyed_uniform(seed, c, k) for c in ("u", "v")})
    size = here.agg(F.max("total").alias("__total"))
    drawn = drawn.crossJoin(F.broadcast(size)).withColumn("n", F.floor(keyed_uniform(seed, "image", k) * F.col("__total")))
    return drawn.join(here.drop("total"), "n").drop("n", "__total")


def row_batches(images: DataFrame, rows: int, height: int, width: int, image: str = "image_id") -> DataFrame:
    """Sequential batches of whole rows: ``batch`` (image, then row block), the block's first and last row, and u, v.

    An image has ceil(height / rows) blocks; the last may be shorter. Images are numbered by id from 0.
    """
    blocks = -(-height // rows)
    order = numbered(images.select(image).distinct(), image).select(image, "n")
    block = F.floor(F.col("row") / rows).cast("int")
    start = block * rows
    at = images.join(order, image)
    return at.select((F.col("n") * blocks + block).alias("batch"), image, start.alias("row_start"), F.least(start + rows, F.lit(height)).alias("row_end"), "row", "col", (F.col("col") / (width - 1)).alias("u"), (F.col("row") / (height - 1)).alias("v"), "value")


def random_in_nodes(nodes: DataFrame, per_node: int, seed: int) -> DataFrame:
    """``per_node`` random points inside every node, by the seed and the node's id."""
    x = nodes.select("*", F.explode(F.sequence(F.lit(1), F.lit(per_node))).alias("k"))
    return x.select("node_id", "k", *[(F.col(f"{a}0") + keyed_uniform(seed, a, F.col("node_id"), F.col("k")) * (F.col(f"{a}1") - F.col(f"{a}0"))).alias(a) for a in "xyz"])


def lattice(nodes: DataFrame, n: int) -> DataFrame:
    """An n^3 evaluation lattice in every node, ends included."""
    g = nodes.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n**3 - 1))))
    at = {"x": F.col("c") % n, "y": F.floor(F.col("c") / n) % n, "z": F.floor(F.col("c") / (n * n))}
    return g.select("node_id", "c", *[(F.col(f"{a}0") + i / (n - 1) * (F.col(f"{a}1") - F.col(f"{a}0"))).alias(a) for a, i in at.items()])

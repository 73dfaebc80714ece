"""Cameras and poses: projection, unprojection, rays of pixels, visibility."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import keyed_normal, keyed_uniform, normalise, rotate
from ..sources.tables import settled
from .tree import morton_of

QUAT, SHIFT = ("qx", "qy", "qz", "qw"), ("tx", "ty", "tz")
#: What a cell must lie inside or outside an image's side, in pixels times depth, to be decided as a whole.
MARGIN = 1e-6
#: Points of the smallest boxes, boxes in one above them, and pairs of a pose and a box a step.
GROUP, FAN, PAIRS = 32, 8, 1 << 16
#: Points that one row packs, poses that one row packs, and bytes of an Arrow batch of such rows.
BLOCK_POINTS, PACK_POSES, ROW_BYTES = 8192, 8192, 8 << 20
#: Poses that are sent to all tasks; beyond it packs of poses and blocks of points meet by a shuffle-free product.
BROADCAST_POSES = 500_000


def with_pose(points: DataFrame, poses: DataFrame, image: str = "image_id") -> DataFrame:
    """Look-up join of the pose by image; Spark broadcasts the pose table where its size allows."""
    return points.join(poses.select(F.col(image), *QUAT, *SHIFT), image)


def rotate_points(points: DataFrame, poses: DataFrame, inverse: bool = False, translate: bool = False) -> DataFrame:
    """Points x, y, z turned by their image's rotation (or its inverse), with its translation if asked."""
    q = tuple(F.col(c) * (-1.0 if inverse and c != "qw" else 1.0) for c in QUAT)
    turned = rotate(q, tuple(F.col(c) for c in "xyz"))
    moved = [t + F.col(s) if translate else t for t, s in zip(turned, SHIFT, strict=True)]
    return with_pose(points, poses).select(*[c for c in points.columns if c not in "xyz"], *[m.alias(c) for m, c in zip(moved, "xyz", strict=True)])


def apply_tangent(poses: DataFrame, tangents: DataFrame, image: str = "image_id") -> DataFrame:
    """Poses turned by exp of a rotation vector: q = exp(t) * q. ``tangents``: image, rx, ry, rz; images without one stay.

    exp(t) has the axis t / |t| and the angle |t|; for very small vectors its first terms stand in.
    """
    t = [F.coalesce(F.col(c), F.lit(0.0)) for c in ("rx", "ry", "rz")]
    n = F.sqrt(t[0] * t[0] + t[1] * t[1] + t[2] * t[2])
    by = F.when(n < 1e-8, 0.5 - n * n / 48).otherwise(F.sin(n / 2) / n)
    a = (*[c * by for c in t], F.cos(n / 2))
    b = tuple(F.col(c) for c in QUAT)
    product = (
        a[3] * b[0] + a[0] * b[3] + a[1] * b[2] - a[2] * b[1],
        a[3] * b[1] - a[0] * b[2] + a[1] * b[3] + a[2] * b[0],
        a[3] * b[2] + a[0] * b[1] - a[1] * b[0] + a[2] * b[3],
        a[3] * b[3] - a[0] * b[0] - a[1] * b[1] - a[2] * b[2],
    )
    j = poses.join(tangents.select(image, "rx", "ry", "rz"), image, "left")
    return j.select(*[dict(zip(QUAT, product, strict=True)).get(c, F.col(c)).alias(c) for c in poses.columns])


def rotation_gradient(points: DataFrame, poses: DataFrame, gradient: tuple[str, str, str] = ("gx", "gy", "gz"), image: str = "image_id") -> DataFrame:
    """``image, rx, ry, rz``: gradient of each pose's rotation, as a rotation vector on the left, as ``apply_tangent`` takes it.

    ``points``: image, x, y, z before the turn and the gradient of each turned point. A small turn r moves the turned
    point p by r x p, so the gradient is the sum of p x g. That is linear in the products of p's and g's entries:
    their nine sums are made first, by image and before the shuffle, and only those sums are turned. No point meets
    a pose, however many share an image.
    """
    m = {(a, b): F.sum(F.col(a) * F.col(g)).alias(f"{a}{b}") for a in "xyz" for b, g in zip("xyz", gradient, strict=True)}
    j = with_pose(points.groupBy(image).agg(*m.values()), poses, image)
    turned = {b: dict(zip("xyz", rotate(tuple(F.col(c) for c in QUAT), tuple(F.col(f"{a}{b}") for a in "xyz")), strict=True)) for b in "xyz"}
    return j.select(image, *[(turned[c][b] - turned[b][c]).alias(f"r{a}") for a, b, c in (("x", "y", "z"), ("y", "z", "x"), ("z", "x", "y"))])


def unproject(pixels: DataFrame, cameras: DataFrame, depth: float = 1.0) -> DataFrame:
    """Camera-space x, y, z of pixels at a depth; shear is not used."""
    j = pixels.join(cameras.select("camera_id", "fx", "fy", "cx", "cy"), "camera_id")
    return j.select(*pixels.columns, ((F.col("px") - F.col("cx")) / F.col("fx") * depth).alias("x"), ((F.col("py") - F.col("cy")) / F.col("fy") * depth).alias("y"), F.lit(float(depth)).alias("z"))


def pinhole_rays(pixels: DataFrame, cameras: DataFrame, poses: DataFrame, key: str = "pixel_id") -> DataFrame:
    """Origin at the pose's translation, direction through the pixel."""
    p = with_pose(unproject(pixels, cameras), poses)
    turned = rotate(tuple(F.col(c) for c in QUAT), normalise(tuple(F.col(c) for c in "xyz")))
    return p.select(F.col(key).alias("ray_id"), *[F.col(s).alias(f"o{a}") for s, a in zip(SHIFT, "xyz", strict=True)], *[t.alias(f"d{a}") for t, a in zip(turned, "xyz", strict=True)])


def orthographic_rays(pixels: DataFrame, poses: DataFrame, key: str = "pixel_id") -> DataFrame:
    """Parallel rays along the pose's z axis from u, v in [-1, 1], started a diagonal before the volume."""
    p = with_pose(pixels, poses)
    q = tuple(F.col(c) for c in QUAT)
    zero, one = F.lit(0.0), F.lit(1.0)
    origin, direction = rotate(q, (F.col("u"), F.col("v"), zero)), rotate(q, (zero, zero, one))
    return p.select(F.col(key).alias("ray_id"), *[(o + F.col(s) - 2.0**0.5 * dd).alias(f"o{a}") for o, s, dd, a in zip(origin, SHIFT, direction, "xyz", strict=True)], *[t.alias(f"d{a}") for t, a in zip(direction, "xyz", strict=True)])


def _rotate(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """``functions.columns.rotate`` for rows of quaternions and vectors."""
    u, w = q[:, :3], q[:, 3:]
    t = 2 * np.cross(u, v)
    return v + w * t + np.cross(u, t)


def _planes(poses: np.ndarray, camera: dict[str, float]) -> np.ndarray:
    """(poses, 5, 4): the depth and the image's four sides as linear functions n . p + d of the place.

    The sides are times the depth, and half a pixel out, so that in front of the camera a point is seen where all
    four are positive, and behind it where all are negative.
    """
    back = poses[:, :4] * [-1, -1, -1, 1]
    turn = np.stack([_rotate(back, np.broadcast_to(e, (len(poses), 3))) for e in np.eye(3)], 2)
    x, y, z = np.concatenate([turn, -(turn @ poses[:, 4:, None])], 2).transpose(1, 0, 2)
    return np.stack([z, camera["fx"] * x + (camera["cx"] + 0.5) * z, -camera["fx"] * x + (camera["w"] - 0.5 - camera["cx"]) * z, camera["fy"] * y + (camera["cy"] + 0.5) * z, -camera["fy"] * y + (camera["h"] - 0.5 - camera["cy"]) * z], 1)


def _states(planes: np.ndarray, middle: np.ndarray, half: np.ndarray) -> np.ndarray:
    """By pair of planes and box: 1 for boxes wholly inside the image, -1 for those wholly outside, 0 undecided: a
    linear function's bounds over a box are those at its middle, more or less the sum of its slopes times the half sides."""
    value = np.einsum("pij,pj->pi", planes[:, :, :3], middle) + planes[:, :, 3]
    reach = np.einsum("pij,pj->pi", np.abs(planes[:, :, :3]), half * (1 + 1e-9)) + MARGIN
    side = np.where(value[:, 0] > reach[:, 0], 1, np.where(value[:, 0] < -reach[:, 0], -1, 0))[:, None]
    inside, outside = (side * value[:, 1:] > reach[:, 1:]).all(1), (side * value[:, 1:] < -reach[:, 1:]).any(1)
    return np.where(side[:, 0] == 0, 0, np.where(outside, -1, np.where(inside, 1, 0)))


def _in_image(pose: np.ndarray, p: np.ndarray, camera: dict[str, float]) -> np.ndarray:
    """Whether each pose sees its point, by projection: pixels are rounded half away from zero, depth 0 is not seen."""
    a, b, c = _rotate(pose[:, :4] * [-1, -1, -1, 1], p - pose[:, 4:]).T
    c = np.where(c == 0, np.nan, c)
    u, v = a / c * camera["fx"] + camera["cx"], b / c * camera["fy"] + camera["cy"]
    return (u > -0.5) & (u < camera["w"] - 0.5) & (v > -0.5) & (v < camera["h"] - 0.5)


def seen_by(p: np.ndarray, poses: np.ndarray, camera: dict[str, float]) -> np.ndarray:
    """How many ``poses`` (n, 7) see each of the points ``p``, which stand in an order that keeps near ones together.

    Boxes around GROUP points, and around FAN boxes each above them, make a tree that all poses go down at once: a
    box wholly inside a pose's image counts for all its points, one wholly outside goes, others are opened. Points
    of undecided groups are held against the poses' planes as one product, and those within MARGIN of a plane are
    projected.
    """
    n = len(p)
    counts, steps = np.zeros(n, np.int64), np.zeros(n + 1, np.int64)
    if not n or not len(poses):
        return counts
    with np.errstate(invalid="ignore", over="ignore"):
        planes = _planes(poses, camera)
        widths, ends = [GROUP], []
        while widths[-1] < n:
            widths.append(widths[-1] * FAN)
        for w in widths:
            at = np.arange(0, n, w)
            ends.append((np.minimum.reduceat(p, at), np.maximum.reduceat(p, at)))
        pose, box = np.arange(len(poses)), np.zeros(len(poses), np.int64)
        for k in range(len(widths) - 1, -1, -1):
            lo, hi = ends[k]
            state = np.concatenate([np.zeros(0, int), *[_states(planes[pose[s : s + PAIRS]], (lo[b] + hi[b]) / 2, (hi[b] - lo[b]) / 2) for s in range(0, len(pose), PAIRS) for b in (box[s : s + PAIRS],)]])
            whole = np.bincount(box[state == 1], minlength=len(lo))
            steps[: len(lo) * widths[k] : widths[k]] += whole
            np.subtract.at(steps, np.minimum(np.arange(1, len(lo) + 1) * widths[k], n), whole)
            pose, box = pose[state == 0], box[state == 0]
            if k:
                pose, box = np.repeat(pose, FAN), (box[:, None] * FAN + np.arange(FAN)).ravel()
                real = box < len(ends[k - 1][0])
                pose, box = pose[real], box[real]
        order = np.argsort(box, kind="stable")
        pose, box = pose[order], box[order]
        cuts = np.append(np.flatnonzero(np.append(True, box[1:] != box[:-1])), len(box)) if len(box) else [0]
        flat = np.concatenate([p, np.ones((n, 1))], 1).T
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            at = int(box[s]) * GROUP
            own = pose[s:e]
            value = (planes[own].reshape(-1, 4) @ flat[:, at : at + GROUP]).reshape(len(own), 5, -1)
            depth = value[:, 0]
            worst = np.where(depth > 0, value[:, 1:].min(1), -value[:, 1:].max(1))
            sure = worst > MARGIN
            i, j = np.nonzero((np.abs(worst) <= MARGIN) | (np.abs(depth) <= MARGIN))
            if len(i):
                sure[i, j] = _in_image(poses[own[i]], p[at + j], camera)
            counts[at : at + GROUP] += sure.sum(0)
    return counts + np.cumsum(steps[:n])


def visible(points: DataFrame, poses: DataFrame, camera: dict[str, float], key: str = "point_id", depth: int = 10) -> DataFrame:
    """``key, images``: points that project into the image of any pose, with the number of poses that see them.

    There is no shear and no test of what lies behind the camera; a point at depth 0 is not seen. Points are put in
    Morton order of ``2 ** depth`` cells an axis of the box around them, by ranges, and cut into blocks of BLOCK_POINTS;
    each block meets the poses in packs, and the poses go down the block's own tree (``seen_by``). Neither cells nor
    pairs are written, and a task holds one block and one pack. Packs are broadcast up to BROADCAST_POSES.
    Points with a null coordinate are never seen, nor is anything by a pose with a null entry.
    """
    spark = points.sparkSession
    ends = points.agg(F.count(F.lit(1)).alias("n"), *[f(a).alias(f"{n}{a}") for a in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]).first()
    if ends["lox"] is None or ends["loy"] is None or ends["loz"] is None:
        return points.where("false").select(key, F.lit(0).cast("long").alias("images"))
    # a row of a block and a pack is below 1 MB: batches of such rows are bounded in bytes
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(limit, str(ROW_BYTES + 1))) > ROW_BYTES:
        spark.conf.set(limit, str(ROW_BYTES))
    n = 1 << depth
    cell = {a: F.greatest(F.least(F.floor((F.col(a) - float(ends[f"lo{a}"])) / float(max(ends[f"hi{a}"] - ends[f"lo{a}"], 1e-12)) * n), F.lit(n - 1)), F.lit(0)).cast("long") for a in "xyz"}
    placed = points.where("x is not null and y is not null and z is not null").select(F.col(key).alias("key"), *[F.col(a).cast("double").alias(a) for a in "xyz"], *[c.alias(f"__c{a}") for a, c in cell.items()])
    placed = placed.select("key", "x", "y", "z", morton_of({a: F.col(f"__c{a}") for a in "xyz"}, depth).alias("place"))
    parts = max(spark.sparkContext.defaultParallelism, -(-ends["n"] // (8 * BLOCK_POINTS)))
    placed = placed.repartitionByRange(parts, "place", "key").sortWithinPartitions("place")
    kind = points.schema[key].dataType
    block = T.StructType([T.StructField("keys", T.ArrayType(kind)), T.StructField("places", T.BinaryType())])

    def blocks(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            while rows >= BLOCK_POINTS:
                table = pa.Table.from_batches(held)
                yield pack(table.slice(0, BLOCK_POINTS))
                held = table.slice(BLOCK_POINTS).to_batches()
                rows -= BLOCK_POINTS
        if rows:
            yield pack(pa.Table.from_batches(held))

    def pack(table):
        keys = table.combine_chunks().to_batches()[0].column(0)
        places = np.stack([table.column(a).to_numpy() for a in "xyz"], 1).astype(float).tobytes()
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), pa.array([places])], names=block.names)

    def packs(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, PACK_POSES):
                part = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.slice(lo, PACK_POSES).columns], 1)
                yield pa.RecordBatch.from_arrays([pa.array([part.astype(float).tobytes()])], names=["poses"])

    found = T.StructType([T.StructField(key, kind), T.StructField("images", T.LongType())])

    def count(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                p = np.frombuffer(batch.column(1)[i].as_py()).reshape(-1, 3)
                images = seen_by(p, np.frombuffer(batch.column(2)[i].as_py()).reshape(-1, 7), camera)
                some = np.flatnonzero(images)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values.take(pa.array(some)), pa.array(images[some])], names=found.names)

    packed = settled(poses.select(*[F.col(c).cast("double") for c in QUAT + SHIFT]).na.drop().coalesce(8).mapInArrow(packs, "poses binary"))
    packed = F.broadcast(packed) if poses.count() <= BROADCAST_POSES else packed
    return placed.select("key", "x", "y", "z").mapInArrow(blocks, block).crossJoin(packed).mapInArrow(count, found).groupBy(key).agg(F.sum("images").alias("images")).where("images > 0")


def defocus_radius(columns: DataFrame, angle: float, max_angle: float, max_blur: float, width: int) -> DataFrame:
    """Blur radius of each image column for a tilt: whole pixels of |tan| times distance from the axis."""
    place = F.abs(F.col("col") / (width - 1) * 2.0 - 1.0)
    return columns.withColumn("radius", F.floor(F.abs(F.tan(F.lit(angle))) * place / (F.abs(F.tan(F.lit(max_angle))) / max_blur)).cast("long"))


def pose_stats(poses: DataFrame) -> DataFrame:
    r = F.sqrt(F.col("tx") * F.col("tx") + F.col("ty") * F.col("ty") + F.col("tz") * F.col("tz"))
    return poses.agg(F.avg(r).alias("mean_distance"), F.max(r).alias("max_radius"))


def jitter(points: DataFrame, amount: float, seed: int, columns: tuple[str, ...] = ("tx", "ty", "tz"), key: str = "image_id") -> DataFrame:
    """Uniform noise of (rand - 0.5) * amount by the seed and the row's key; nothing for amounts of 0 or less."""
    if amount <= 0:
        return points
    return points.withColumns({c: F.col(c) + (keyed_uniform(seed, c, F.col(key)) - 0.5) * amount for c in columns})


def defocused(rays: DataFrame, width: int, spread: float, seed: int, key: str = "ray_id") -> DataFrame:
    """Origins moved along a random unit direction by at most the ray's defocus (in pixels of the width).

    Directions and distances follow from the seed and the ray's key.
    """
    k = F.col(key)
    r = rays.select("*", *[keyed_normal(seed, f"g{a}", k).alias(f"g{a}") for a in "xyz"], keyed_normal(seed, "gs", k).alias("gs"))
    n = F.sqrt(sum((F.col(f"g{a}") * F.col(f"g{a}") for a in "xyz"), F.lit(1e-20)))
    far = F.least(F.col("defocus") * 2.0 / width, F.col("gs") * (2.0 * spread / width))
    return r.select(*[(F.col(c) + F.col(f"g{c[1]}") / n * far).alias(c) if c in ("ox", "oy", "oz") else F.col(c) for c in rays.columns])

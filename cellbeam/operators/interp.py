"""Interpolation in images, planes, lines and grids: corners by arithmetic, values by equi join."""

from __future__ import annotations

from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import hash_corner
from ..sources.tables import settled
from .windows import over_tiles


def corners(coords: dict[str, Column], size: dict[str, int]) -> Column:
    """Array of (cell numbers, weight) of the 2^n corners around a position in cell units, clamped to the border."""
    parts = {}
    for a, c in coords.items():
        c = F.least(F.greatest(c, F.lit(0.0)), F.lit(float(size[a] - 1)))
        lo = F.floor(c).cast("int")
        parts[a] = (lo, F.least(lo + 1, F.lit(size[a] - 1)), c - lo)
    rows = []
    for bits in product((0, 1), repeat=len(coords)):
        cells = [parts[a][b].alias(f"i{a}") for a, b in zip(coords, bits, strict=True)]
        weight = reduce(lambda p, q: p * q, [parts[a][2] if b else 1.0 - parts[a][2] for a, b in zip(coords, bits, strict=True)])
        rows.append(F.struct(*cells, weight.alias("w")))
    return F.array(*rows)


def gather_cells(grid: DataFrame, size: dict[str, int], grid_key: str = "node_id", values: list[str] | None = None) -> DataFrame:
    """``grid_key`` and one array ``__<value>`` per value column: all cells of a grid in order, the last axis fastest.

    ``grid`` has one row per cell; cells that are missing stay NULL. A grid is bounded by its size.
    """
    index = reduce(lambda p, a: p * size[a] + F.col(f"i{a}"), size, F.lit(0))
    total = reduce(lambda p, n: p * n, size.values(), 1)
    values = values or ["value"]
    rows = grid.groupBy(grid_key).agg(F.array_sort(F.collect_list(F.struct(index.cast("int").alias("i"), *[F.col(v).alias(f"v{k}") for k, v in enumerate(values)]))).alias("__c"))
    # each known cell stands behind the empty ones since the one before it, so an incomplete grid is filled in one pass
    before = F.concat(F.array(F.lit(-1)), F.transform("__c", lambda c: c["i"]))
    gaps = F.zip_with(F.slice(before, 1, F.size("__c")), "__c", lambda p, c: F.when(c["i"] - p > 1, c["i"] - p - 1).otherwise(0))
    end = F.lit(total - 1) - F.element_at("__c", -1)["i"]

    def dense(k: int) -> Column:
        value = grid.schema[values[k]].dataType
        none = F.lit(None).cast(value)
        filled = F.flatten(F.zip_with(gaps, "__c", lambda g, c: F.concat(F.array_repeat(none, g), F.array(c[f"v{k}"]))))
        return F.when(F.size("__c") == total, F.transform("__c", lambda c: c[f"v{k}"])).otherwise(F.concat(filled, F.array_repeat(none, end)))

    return rows.select(grid_key, *[dense(k).alias(f"__{v}") for k, v in enumerate(values)])


def place(df: DataFrame, coords: dict[str, Column], size: dict[str, int], tag: str = "") -> DataFrame:
    """Adds the clamped position and its cell along each axis, so that the corners below share them."""
    at = {f"__q{tag}_{a}": F.least(F.greatest(c, F.lit(0.0)), F.lit(float(size[a] - 1))) for a, c in coords.items()}
    return df.withColumns(at).withColumns({f"__l{tag}_{a}": F.floor(f"__q{tag}_{a}").cast("int") for a in coords})


def interpolate(cells: str, coords: dict[str, Column], size: dict[str, int], tag: str = "") -> Column:
    """Linear interpolation in an array column from ``gather_cells`` at the positions that ``place`` has added."""
    parts = []
    for a in coords:
        q, lo = F.col(f"__q{tag}_{a}"), F.col(f"__l{tag}_{a}")
        parts.append((size[a], lo, F.least(lo + 1, F.lit(size[a] - 1)), q - lo))
    out = None
    for bits in product((0, 1), repeat=len(parts)):
        index = reduce(lambda p, x: p * x[0][0] + x[0][1 + x[1]], zip(parts, bits, strict=True), F.lit(0))
        weight = reduce(lambda p, q: p * q, [x[3] if b else 1.0 - x[3] for x, b in zip(parts, bits, strict=True)])
        term = weight * F.coalesce(F.get(cells, index), F.lit(0.0))
        out = term if out is None else out + term
    return out


def slope(cells: str, coords: dict[str, Column], size: dict[str, int], axis: str, tag: str = "") -> Column:
    """Derivative of ``interpolate`` along an axis, per cell: the gap of the two cells there, mixed along the others.

    On a cell the side behind it counts, on the last one the side before it; beyond the ends it is 0.
    """
    if size[axis] < 2:
        return F.lit(0.0)
    parts = []
    for a in coords:
        q, lo = F.col(f"__q{tag}_{a}"), F.col(f"__l{tag}_{a}")
        if a == axis:
            lo = F.least(lo, F.lit(size[a] - 2))
        parts.append((a, lo, F.least(lo + 1, F.lit(size[a] - 1)), q - lo))
    out = None
    for bits in product((0, 1), repeat=len(parts)):
        index = reduce(lambda p, x: p * size[x[0][0]] + x[0][1 + x[1]], zip(parts, bits, strict=True), F.lit(0))
        weight = reduce(lambda p, x: p * ((1.0 if x[1] else -1.0) if x[0][0] == axis else x[0][3] if x[1] else 1.0 - x[0][3]), zip(parts, bits, strict=True), F.lit(1.0))
        term = weight * F.coalesce(F.get(cells, index), F.lit(0.0))
        out = term if out is None else out + term
    return F.when(coords[axis].between(0.0, float(size[axis] - 1)), out).otherwise(0.0)


def grid_slopes(points: DataFrame, grid: DataFrame, coords: dict[str, Column], size: dict[str, int], key: str = "point_id", grid_key: str = "node_id") -> DataFrame:
    """``key`` and ``d<axis>``: derivatives of ``sample_grid`` by its coordinates, in cell units."""
    j = place(points, coords, size).join(gather_cells(grid, size, grid_key), grid_key)
    return j.select(key, *[slope("__value", coords, size, a).alias(f"d{a}") for a in coords])


def sample_grid(points: DataFrame, grid: DataFrame, coords: dict[str, Column], size: dict[str, int], key: str = "point_id", grid_key: str = "node_id", out: str = "value") -> DataFrame:
    """Linear interpolation in 1, 2 or 3 dimensions: ``key`` and the interpolated value.

    ``points``: key, grid_key and coordinates; ``grid``: grid_key, a cell column ``i<axis>`` per axis, value; a
    missing cell counts as 0. One join of points with whole grids: no row per corner, and no sum after it.
    """
    j = place(points, coords, size).join(gather_cells(grid, size, grid_key), grid_key)
    return j.select(key, interpolate("__value", coords, size).alias(out))


def grid_gradient(points: DataFrame, residual: str, coords: dict[str, Column], size: dict[str, int], grid_key: str = "node_id") -> DataFrame:
    """Scatter-add of weight * residual to the cells: the gradient of an interpolated grid.

    A batch of points is summed by cell inside its task, so there is no row per corner; what is shuffled is one row a
    batch and touched cell at most, summed again by Spark before the shuffle.
    """
    shape = [size[a] for a in coords]
    names = [f"i{a}" for a in coords]
    schema = T.StructType([T.StructField(grid_key, points.schema[grid_key].dataType), *[T.StructField(c, T.IntegerType()) for c in names], T.StructField("g", T.DoubleType()), T.StructField("n", T.LongType())])

    def scatter(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = batch.column(0).dictionary_encode()
            code = kinds.indices.fill_null(len(kinds.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
            push = batch.column(1).to_numpy(zero_copy_only=False)
            sure = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            push = np.where(sure, push, 0.0)
            parts = []
            for k, n in enumerate(shape):
                at = batch.column(2 + k).fill_null(0.0).to_numpy(zero_copy_only=False)
                at = np.clip(np.where(np.isnan(at), n - 1.0, at), 0.0, n - 1.0)
                lo = np.floor(at).astype(np.int64)
                parts.append((lo, np.minimum(lo + 1, n - 1), at - lo))
            cells = int(np.prod(shape))
            total = (len(kinds.dictionary) + 1) * cells
            found = [], [], []
            for bits in product((0, 1), repeat=len(shape)):
                where, weight = code, push
                for (lo, up, share), b, n in zip(parts, bits, shape, strict=True):
                    where = where * n + (up if b else lo)
                    weight = weight * (share if b else 1.0 - share)
                for held, x in zip(found, (where, weight, sure), strict=True):
                    held.append(x)
            where, weight, known = (np.concatenate(x) for x in found)
            if total <= 4 * len(where):
                seen = np.flatnonzero(np.bincount(where, minlength=total))
                g, c = np.bincount(where, weight, total)[seen], np.bincount(where, known, total)[seen]
            else:  # many grids in one batch
                seen, at = np.unique(where, return_inverse=True)
                g, c = np.bincount(at, weight, len(seen)), np.bincount(at, known, len(seen))
            own = pa.array(seen // cells)
            keys = pa.concat_arrays([kinds.dictionary, pa.nulls(1, kinds.dictionary.type)]).take(own)
            axes = np.unravel_index(seen % cells, shape)
            yield pa.RecordBatch.from_arrays([keys, *[pa.array(x.astype(np.int32)) for x in axes], pa.array(g), pa.array(c.astype(np.int64))], names=schema.names)

    rows = points.select(grid_key, F.col(residual).cast("double").alias("__r"), *[c.cast("double").alias(f"__c{k}") for k, c in enumerate(coords.values())])
    sums = rows.mapInArrow(scatter, schema).groupBy(grid_key, *names).agg(F.sum("g").alias("g"), F.sum("n").alias("n"))
    return sums.select(grid_key, *names, F.when(F.col("n") > 0, F.col("g")).alias("gradient"))


def line_gradient(points: DataFrame, grid: DataFrame, coord: Column, size: int, key: str = "point_id", grid_key: str = "node_id") -> DataFrame:
    """Derivative of a 1-D interpolation by its coordinate, in cell units: the difference of the two cells."""
    c = F.least(F.greatest(coord, F.lit(0.0)), F.lit(float(size - 1)))
    lo = F.least(F.floor(c).cast("int"), F.lit(size - 2))
    j = points.withColumn("__l", lo).join(gather_cells(grid, {"x": size}, grid_key), grid_key)
    return j.select(key, (F.coalesce(F.get("__value", F.col("__l") + 1), F.lit(0.0)) - F.coalesce(F.get("__value", F.col("__l")), F.lit(0.0))).alias("slope"))


#: Tables of up to this many slots travel as one array to every task.
SMALL_TABLE = 1 << 16


def hash_corners(levels: int, base: int, growth: float, size: int, coords: tuple[str, ...], along: str | None = None) -> list[list[tuple[Column, Column]]]:
    """By level: slot and weight of each corner around a position in [0, 1]; outside all weights are 0.

    A level whose lattice fits the table is indexed densely, others by XOR of coordinate and prime. With ``along``
    weights are their derivatives by that coordinate.
    """
    #: The primes of the hash.
    primes = (1, 2654435761, 805459861)
    out = []
    inside = reduce(lambda a, b: a & b, [F.col(c).between(0.0, 1.0) for c in coords])
    for level in range(levels):
        scale = 2.0 ** (level * growth) * base - 1.0
        res = int(-(-scale // 1)) + 1
        dense = res ** len(coords) <= size
        cells = {c: F.floor(F.col(c) * scale).cast("long") for c in coords}
        fracs = {c: F.col(c) * scale - F.floor(F.col(c) * scale) for c in coords}
        corners_here = []
        for bits in product((0, 1), repeat=len(coords)):
            at = tuple(cells[c] + b for c, b in zip(coords, bits, strict=True))
            index = F.pmod(reduce(lambda p, q: p + q, [a * res**k for k, a in enumerate(at)]), F.lit(size)) if dense else hash_corner(at, primes[: len(coords)], size)
            weight = reduce(lambda p, q: p * q, [F.lit(scale if b else -scale) if c == along else fracs[c] if b else 1.0 - fracs[c] for c, b in zip(coords, bits, strict=True)])
            corners_here.append((index.cast("long"), F.when(inside, weight).otherwise(0.0)))
        out.append(corners_here)
    return out


def hash_encode(points: DataFrame, table: DataFrame, levels: int, base: int, growth: float, size: int, key: str = "point_id", coords: tuple[str, ...] = ("u", "v", "w"), along: str | None = None) -> DataFrame:
    """Multi-resolution hash encoding: ``key, level, feature``; outside [0, 1] the feature is 0.

    With ``along`` the feature's derivative by that coordinate instead.

    ``table``: slot, value; a missing slot counts as 0. Small tables are looked up in place, large ones by a join.
    """
    at = hash_corners(levels, base, growth, size, coords, along)
    if size <= SMALL_TABLE:
        every = points.sparkSession.range(size).select(F.col("id").alias("slot"), F.lit(0.0).alias("value")).unionByName(table.select("slot", "value"))
        full = every.groupBy(F.lit(0).alias("__t"), F.col("slot").alias("islot")).agg(F.sum("value").alias("value"))
        whole = gather_cells(full, {"slot": size}, "__t").select("__value")
        sums = [reduce(lambda p, q: p + q, [w * F.coalesce(F.get("__value", slot.cast("int")), F.lit(0.0)) for slot, w in level]) for level in at]
        found = points.crossJoin(F.broadcast(whole)).select(key, F.posexplode(F.array(*sums)).alias("level", "feature"))
        return found
    rows = [F.struct(F.lit(level).alias("level"), slot.alias("slot"), w.alias("w")) for level, here in enumerate(at) for slot, w in here]
    spread = points.select(key, F.explode(F.array(*rows)).alias("c")).select(key, "c.*")
    return spread.join(table.select("slot", F.col("value").alias("__v")), "slot", "left").groupBy(key, "level").agg(F.sum(F.col("w") * F.coalesce("__v", F.lit(0.0))).alias("feature"))


def hash_gradient(points: DataFrame, residual: str, levels: int, base: int, growth: float, size: int, coords: tuple[str, ...] = ("u", "v", "w"), level: str | None = None) -> DataFrame:
    """``slot, gradient``: scatter-add of weight * residual, the gradient of the table of ``hash_encode``.

    The same residual reaches all levels, or with the column ``level`` only the level that it names.
    """
    at = hash_corners(levels, base, growth, size, coords)
    rows = [F.struct(F.lit(k).alias("level"), slot.alias("slot"), w.alias("w")) for k, here in enumerate(at) for slot, w in here]
    spread = points.select(residual, *([level] if level else []), F.explode(F.array(*rows)).alias("c"))
    spread = spread.where(F.col("c.level") == F.col(level)) if level else spread
    return spread.groupBy(F.col("c.slot").alias("slot")).agg(F.sum(F.col("c.w") * F.col(residual)).alias("gradient"))


def convolve(images: DataFrame, kernel: list[list[float]], image: str = "image_id") -> DataFrame:
    """Depthwise 2-D convolution, ``image, row, col, value`` of all pixels; beyond the border and where pixels are missing is 0.

    Images are cut into tiles with a margin of half the kernel: about one row a pixel is shuffled.
    """
    k = np.array(kernel, float)
    h, w = k.shape
    reach = max(h, w) // 2

    def work(known, arrays, inner, origin):
        x = np.pad(arrays[0], ((0, 0), (reach, reach), (reach, reach)))
        out = np.zeros(known.shape)
        for i, j in zip(*np.nonzero(k), strict=True):
            di, dj = int(i) - h // 2 + reach, int(j) - w // 2 + reach
            out += k[i, j] * x[:, di : di + known.shape[1], dj : dj + known.shape[2]]
        t, r, c = np.nonzero(known[inner])
        return t, (r + inner[1].start + origin[t, 0]).astype(np.int32), (c + inner[2].start + origin[t, 1]).astype(np.int32), out[inner][t, r, c]

    return over_tiles(images, image, ("row", "col"), ("value",), reach, work, "row int, col int, value double")


def halve(images: DataFrame, image: str = "image_id") -> DataFrame:
    """One pyramid level down: mean of 2 x 2 blocks."""
    half = lambda c: F.floor(F.col(c) / 2).cast("int").alias(c)
    return images.groupBy(image, half("row"), half("col")).agg(F.avg("value").alias("value"))


def laplacian_band(images: DataFrame, image: str = "image_id") -> DataFrame:
    """What a pyramid level loses by ``halve``: each pixel less the mean of its 2 x 2 block, as ``band``."""
    block = W.partitionBy(image, F.floor(F.col("row") / 2), F.floor(F.col("col") / 2))
    return images.withColumn("band", F.col("value") - F.avg("value").over(block))


def laplacian_pyramid(images: DataFrame, levels: int, image: str = "image_id") -> DataFrame:
    """``image, level, row, col, value``: bands of ``levels`` levels from the finest on, then the last level's means.

    Each level has a quarter of the pixels of the one before; it is written once and read by its band and by the next
    level. A pixel is the sum of the bands of all levels and of the mean, at its row and column halved as often.
    """
    now = images.select(image, "row", "col", "value")
    out = []
    for k in range(levels):
        out.append(laplacian_band(now, image).select(image, F.lit(k).alias("level"), "row", "col", F.col("band").alias("value")))
        now = settled(halve(now, image))
    out.append(now.select(image, F.lit(levels).alias("level"), "row", "col", "value"))
    return reduce(DataFrame.unionByName, out)


#: Per axis: the two coordinates of its plane and the coordinate of its line.
PLANES = (("v", "w", "u"), ("u", "w", "v"), ("u", "v", "w"))


def plane_features(samples: DataFrame, planes: DataFrame, size: int, key: str = "point_id", coords: tuple[str, str, str] = ("u", "v", "w")) -> DataFrame:
    """``key, p0, p1, p2``: the planes of the three axes at each sample, without the lines.

    ``samples``: key, node_id and coordinates in [-1, 1]; ``planes``: node_id, axis, iy, ix, value.
    """
    cell = dict(zip("uvw", [(F.col(c) + 1.0) * ((size - 1) / 2.0) for c in coords], strict=True))
    cells = {"axis": 3, "y": size, "x": size}
    j = samples.join(gather_cells(planes.withColumn("iaxis", F.col("axis")), cells), "node_id")
    at = [{"axis": F.lit(float(k)), "y": cell[PLANES[k][1]], "x": cell[PLANES[k][0]]} for k in range(3)]
    for k in range(3):
        j = place(j, at[k], cells, str(k))
    return j.select(key, *[interpolate("__value", at[k], cells, str(k)).alias(f"p{k}") for k in range(3)])


def tensor_feature(samples: DataFrame, planes: DataFrame, lines: DataFrame, size: int, key: str = "point_id", how: str = "add", line_coords: tuple[str, str, str] = ("u", "v", "w"), line_key: str = "node_id") -> DataFrame:
    """Plane times line of the three axes: their sum ``value``, or with ``how='cat'`` an array of the three.

    ``samples``: key, node_id, u, v, w in [-1, 1] inside the node; tables by axis. ``line_coords`` may name other
    columns, such as ``roi_coordinate`` of the global place, and ``line_key`` another key, where all nodes share lines.
    """
    if how not in ("add", "cat"):
        raise ValueError(f"unknown way {how!r}")
    cells = {"axis": 3, "x": size}
    plane = plane_features(samples, planes, size, key)
    line = gather_cells(lines.withColumn("iaxis", F.col("axis")), cells, line_key)
    cell = {c: (F.col(n) + 1.0) * ((size - 1) / 2.0) for c, n in zip("uvw", line_coords, strict=True)}
    at = [{"axis": F.lit(float(k)), "x": cell[PLANES[k][2]]} for k in range(3)]
    j = samples.join(line, line_key)
    for k in range(3):
        j = place(j, at[k], cells, str(k))
    j = j.select(key, *[interpolate("__value", at[k], cells, str(k)).alias(f"l{k}") for k in range(3)])
    parts = [F.col(f"p{k}") * F.col(f"l{k}") for k in range(3)]
    return plane.join(j, key).select(key, (parts[0] + parts[1] + parts[2] if how == "add" else F.array(*parts)).alias("value"))


def roi_coordinate(x: Column, lo: float, hi: float) -> Column:
    """A global coordinate in [-1, 1] over the region of interest."""
    return 2.0 * (x - lo) / (hi - lo) - 1.0

"""Queries over images, cameras, poses and interpolation."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.columns import activation, finite, pixel_to_uv, r6, uv_to_pixel, xray_inverse, xray_log
from ..operators import batches, camera, interp, metrics
from .queries_tree import rnd
from .scenes import SQL, d, images, view

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = " ".join(sql.split())
        return f

    return add


IM = SQL["images"]
_V = '"value"'
_POS = f"({_V} + {d(0.6)})"


def lerp_sql(axes: dict[str, int], grid: str, points: str, key: str) -> str:
    """Multilinear look-up for DuckDB: floor cells, all corners by union, weighted sum."""
    pre = ", ".join(f"least(greatest(c_{a}, 0), {n - 1}) AS q_{a}, least(CAST(floor(least(greatest(c_{a}, 0), {n - 1})) AS BIGINT), {n - 1}) AS l_{a}" for a, n in axes.items())
    corner = []
    for bits in range(1 << len(axes)):
        cells, w = [], []
        for k, (a, n) in enumerate(axes.items()):
            hi = bits >> k & 1
            cells.append(f"least(l_{a} + {hi}, {n - 1}) AS i{a}")
            w.append(f"(q_{a} - l_{a})" if hi else f"(1 - (q_{a} - l_{a}))")
        corner.append(f"SELECT {key}, node_id, {', '.join(cells)}, {' * '.join(w)} AS w FROM pre")
    on = " AND ".join(["c.node_id = g.node_id", *[f"c.i{a} = g.i{a}" for a in axes]])
    return f"pre AS (SELECT *, {pre} FROM {points}), corners AS ({' UNION ALL '.join(corner)}), sampled AS (SELECT {key}, sum(w * g.v) AS s FROM corners c JOIN {grid} g ON {on} GROUP BY {key})"


def positive(spark, sf):
    return images(spark, sf).withColumn("value", F.col("value") + 0.6)


@query("xray_log", f'WITH {IM} SELECT image_id, "row", col, round(-ln(greatest({_POS}, 1e-5) / {d(1.2)}) / -ln({d(0.01)} / {d(1.2)}), 6) + {d(0)} AS natural, round(-log10(greatest({_POS}, 1e-5) / {d(1.2)}) * 2 / -log10({d(0.01)} / {d(1.2)}), 6) + {d(0)} AS decimal FROM images')
def xray(spark, sf):
    i = positive(spark, sf)
    v = F.col("value")
    return i.select("image_id", "row", "col", r6(finite(xray_log(v, 0.01, 1.2))).alias("natural"), r6(xray_log(v, 0.01, 1.2, 2.0, base10=True)).alias("decimal"))


@query("xray_inverse", f'WITH {IM} SELECT image_id, "row", col, round(exp(-ln({d(1.2)} / {d(0.01)}) * {_V}), 6) + {d(0)} AS raw FROM images')
def inverse(spark, sf):
    return images(spark, sf).select("image_id", "row", "col", r6(xray_inverse(F.col("value"), 0.01, 1.2)).alias("raw"))


@query("masked_image", f'WITH {IM} SELECT image_id, "row", col, round({_V} * CASE WHEN ("row" + col) % 3 = 0 THEN 0 ELSE 1 END, 6) + {d(0)} AS masked FROM images')
def masked(spark, sf):
    mask = F.when((F.col("row") + F.col("col")) % 3 == 0, 0.0).otherwise(1.0)
    return images(spark, sf).select("image_id", "row", "col", r6(F.col("value") * mask).alias("masked"))


@query("uv_pixel", f"WITH {SQL['pixels']} SELECT pixel_id, {rnd('px / 639', 'u')}, {rnd(f'(py + {d(0.5)}) / 480', 'v')}, {rnd('(px / 639) * 639', 'back')} FROM pixels")
def uv_pixel(spark, sf):
    p = view(spark, sf, "pixels")
    u = pixel_to_uv(F.col("px"), 640, check=True)
    return p.select("pixel_id", r6(u).alias("u"), r6(pixel_to_uv(F.col("py"), 480, False)).alias("v"), r6(uv_to_pixel(u, 640)).alias("back"))


_UNPROJ = f"{SQL['pixels']}, {SQL['cameras']}, un AS (SELECT pixels.*, (px - cx) / fx AS x, (py - cy) / fy AS y, {d(1)} AS z FROM pixels JOIN cameras ON pixels.camera_id = cameras.camera_id)"


@query("unproject", f"WITH {_UNPROJ} SELECT pixel_id, {rnd('x * 2', 'x')}, {rnd('y * 2', 'y')}, {rnd('z * 2', 'z')} FROM un")
def unproject(spark, sf):
    return camera.unproject(view(spark, sf, "pixels"), view(spark, sf, "cameras"), 2.0).select("pixel_id", *[r6(F.col(a)).alias(a) for a in "xyz"])


def rot_sql(x: str, y: str, z: str, inverse: bool = False) -> tuple[str, str, str]:
    """The rotation as a matrix of the quaternion: another form of the same turn."""
    s = "-" if inverse else ""
    qx, qy, qz, qw = f"({s}qx)", f"({s}qy)", f"({s}qz)", "qw"
    return (
        f"((1 - 2 * ({qy} * {qy} + {qz} * {qz})) * {x} + 2 * ({qx} * {qy} - {qz} * {qw}) * {y} + 2 * ({qx} * {qz} + {qy} * {qw}) * {z})",
        f"(2 * ({qx} * {qy} + {qz} * {qw}) * {x} + (1 - 2 * ({qx} * {qx} + {qz} * {qz})) * {y} + 2 * ({qy} * {qz} - {qx} * {qw}) * {z})",
        f"(2 * ({qx} * {qz} - {qy} * {qw}) * {x} + 2 * ({qy} * {qz} + {qx} * {qw}) * {y} + (1 - 2 * ({qx} * {qx} + {qy} * {qy})) * {z})",
    )


_R = rot_sql("x", "y", "z")


@query("rotate_points", f"WITH {SQL['points']}, {SQL['poses']}, p AS (SELECT points.*, point_id % 10 + 1 AS image_id FROM points) SELECT point_id, {rnd(_R[0] + ' + tx', 'x')}, {rnd(_R[1] + ' + ty', 'y')}, {rnd(_R[2] + ' + tz', 'z')} FROM p JOIN poses ON p.image_id = poses.image_id")
def rotate_points(spark, sf):
    p = view(spark, sf, "points").select("point_id", "x", "y", "z", (F.col("point_id") % 10 + 1).alias("image_id"))
    return camera.rotate_points(p, view(spark, sf, "poses"), translate=True).select("point_id", *[r6(F.col(a)).alias(a) for a in "xyz"])


_UN = "sqrt(x * x + y * y + z * z)"
_RN = rot_sql(f"(x / {_UN})", f"(y / {_UN})", f"(z / {_UN})")


@query("rays_pinhole", f"WITH {_UNPROJ}, {SQL['poses']} SELECT pixel_id AS ray_id, {rnd('tx', 'ox')}, {rnd('ty', 'oy')}, {rnd('tz', 'oz')}, {rnd(_RN[0], 'dx')}, {rnd(_RN[1], 'dy')}, {rnd(_RN[2], 'dz')} FROM un JOIN poses ON un.image_id = poses.image_id")
def rays_pinhole(spark, sf):
    r = camera.pinhole_rays(view(spark, sf, "pixels"), view(spark, sf, "cameras"), view(spark, sf, "poses"))
    return r.select("ray_id", *[r6(F.col(c)).alias(c) for c in r.columns[1:]])


_O, _D = rot_sql("u", "v", d(0)), rot_sql(d(0), d(0), d(1))


@query("rays_ortho", f"WITH {SQL['pixels']}, {SQL['poses']}, p AS (SELECT *, px / 320 - 1 AS u, py / 240 - 1 AS v FROM pixels) SELECT pixel_id AS ray_id, {', '.join(rnd(f'{o} + t{a} - sqrt({d(2)}) * {dd}', f'o{a}') for o, dd, a in zip(_O, _D, 'xyz', strict=True))}, {', '.join(rnd(dd, f'd{a}') for dd, a in zip(_D, 'xyz', strict=True))} FROM p JOIN poses ON p.image_id = poses.image_id")
def rays_ortho(spark, sf):
    p = view(spark, sf, "pixels").withColumn("u", F.col("px") / 320 - 1).withColumn("v", F.col("py") / 240 - 1)
    r = camera.orthographic_rays(p, view(spark, sf, "poses"))
    return r.select("ray_id", *[r6(F.col(c)).alias(c) for c in r.columns[1:]])


_S = rot_sql("(x - tx)", "(y - ty)", "(z - tz)", True)


@query("visible_points", f"WITH {SQL['points']}, {SQL['poses']}, s AS (SELECT point_id, {_S[0]} AS a, {_S[1]} AS b, {_S[2]} AS c FROM points CROSS JOIN poses), q AS (SELECT point_id, c, round(a / c * 300 + 320) AS u, round(b / c * 300 + 240) AS v FROM s WHERE c <> 0) SELECT point_id, count(*) AS images FROM q WHERE u >= 0 AND u < 640 AND v >= 0 AND v < 480 GROUP BY 1")
def visible_points(spark, sf):
    """Every point against every pose."""
    return camera.visible(view(spark, sf, "points"), view(spark, sf, "poses"), {"fx": 300, "fy": 300, "cx": 320, "cy": 240, "w": 640, "h": 480}).select("point_id", "images")


@query("pose_stats", f"WITH {SQL['poses']} SELECT round(avg(sqrt(tx * tx + ty * ty + tz * tz)), 6) AS mean_distance, round(max(sqrt(tx * tx + ty * ty + tz * tz)), 6) AS max_radius FROM poses")
def pose_stats(spark, sf):
    return camera.pose_stats(view(spark, sf, "poses")).select(r6(F.col("mean_distance")).alias("mean_distance"), r6(F.col("max_radius")).alias("max_radius"))


@query("defocus_radius", f'WITH {IM} SELECT image_id, "row", col, CAST(floor(abs(tan({d(0.5)})) * abs(col / {d(7)} * 2 - 1) / (abs(tan({d(1.0)})) / 9)) AS BIGINT) AS radius FROM images')
def defocus(spark, sf):
    return camera.defocus_radius(images(spark, sf), 0.5, 1.0, 9.0, 8).select("image_id", "row", "col", "radius")


@query("activations", f"WITH {SQL['points']} SELECT point_id, {rnd('greatest(x, 0)', 'relu')}, {rnd('abs(x)', 'abs')}, {rnd('ln(1 + exp(x * 3)) / 3', 'softplus')}, {rnd('1 / (1 + exp(-x))', 'sigmoid')}, {rnd('CASE WHEN x < 0 THEN x * 0.01 ELSE x END', 'leaky_relu')}, {rnd('sin(x * 3)', 'sin')} FROM points")
def activations(spark, sf):
    x = F.col("x")
    return view(spark, sf, "points").select("point_id", *[r6(activation(x, k, 3.0)).alias(k) for k in ("relu", "abs", "softplus", "sigmoid", "leaky_relu", "sin")])


@query("exposure", f'WITH {IM}, p AS (SELECT p_partkey AS k, greatest(p_retailprice / 10000 - 0.1, 0) AS b FROM part) SELECT image_id, "row", col, round({_V} + coalesce(b, 0), 6) + {d(0)} AS exposed FROM images LEFT JOIN p ON image_id = k')
def exposure(spark, sf):
    bias = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("image_id"), F.greatest(F.col("p_retailprice") / 10000 - 0.1, F.lit(0.0)).alias("b"))
    return images(spark, sf).join(bias, "image_id", "left").select("image_id", "row", "col", r6(F.col("value") + F.coalesce("b", F.lit(0.0))).alias("exposed"))


_SB = 'bias AS (SELECT (p_partkey // 8) % 8 AS iy, p_partkey % 8 AS ix, 0 AS node_id, avg(p_retailprice) / 10000 AS v FROM part GROUP BY 1, 2)'


@query("sensor_bias", f'WITH {IM}, {_SB}, p AS (SELECT image_id * 64 + "row" * 8 + col AS point_id, image_id, 0 AS node_id, {_V}, (("row" + {d(0.3)}) / 7 * 8 - 0.5) AS c_y, ((col + {d(0.3)}) / 7 * 8 - 0.5) AS c_x FROM images), {lerp_sql({'y': 8, 'x': 8}, 'bias', 'p', 'point_id')} SELECT p.point_id, round({_V} + s, 6) + {d(0)} AS corrected FROM p JOIN sampled ON p.point_id = sampled.point_id')
def sensor_bias(spark, sf):
    """A bias image looked up between pixel centres, clamped at the border, is added to all images."""
    part = spark.read.parquet(f"{sf}/part.parquet")
    bias = part.groupBy(F.lit(0).alias("node_id"), (F.floor(F.col("p_partkey") / 8) % 8).cast("int").alias("iy"), (F.col("p_partkey") % 8).cast("int").alias("ix")).agg((F.avg("p_retailprice") / 10000).alias("value"))
    i = images(spark, sf).withColumn("point_id", F.col("image_id") * 64 + F.col("row") * 8 + F.col("col")).withColumn("node_id", F.lit(0))
    at = {a: uv_to_pixel((F.col(c) + 0.3) / 7, 8, False) for a, c in (("y", "row"), ("x", "col"))}
    s = interp.sample_grid(i.drop("value"), bias, at, {"y": 8, "x": 8}, out="s")
    return i.join(s, "point_id").select("point_id", r6(F.col("value") + F.col("s")).alias("corrected"))


@query("response_lut", f'WITH {IM}, k AS (SELECT *, least(greatest({_POS}, 0), 1.2) / 1.2 * 24 AS p FROM images), i AS (SELECT *, CAST(floor(p) AS BIGINT) AS lo FROM k) SELECT image_id, "row", col, round(sqrt(lo / {d(24)}) * (1 - (p - lo)) + sqrt(least(lo + 1, 24) / {d(24)}) * (p - lo) + CASE WHEN {_POS} > 1.2 THEN ({_POS} - 1.2) * 0.01 ELSE 0 END, 6) + {d(0)} AS response FROM i')
def response_lut(spark, sf):
    """A 25-knot curve, one per label, looked up linearly, with a small leak above its range."""
    i = positive(spark, sf).withColumn("point_id", F.col("image_id") * 64 + F.col("row") * 8 + F.col("col")).withColumn("node_id", F.col("label"))
    knots = i.select("node_id").distinct().withColumn("ix", F.explode(F.sequence(F.lit(0), F.lit(24)))).withColumn("value", F.sqrt(F.col("ix") / 24))
    v = interp.sample_grid(i.withColumn("p", F.col("value") / 1.2 * 24).drop("value"), knots, {"x": F.col("p")}, {"x": 25}, out="r")
    leak = F.when(F.col("value") > 1.2, (F.col("value") - 1.2) * 0.01).otherwise(0.0)
    return i.join(v, "point_id").select("image_id", "row", "col", r6(F.col("r") + leak).alias("response"))


_PLANE = f'plane AS (SELECT image_id AS node_id, "row" AS iy, col AS ix, {_V} AS v FROM images)'
_LINE = f'line AS (SELECT image_id AS node_id, "row" * 8 + col AS ix, {_V} AS v FROM images)'
_CUBE = f'cube AS (SELECT image_id AS node_id, ("row" * 8 + col) // 16 AS iz, (("row" * 8 + col) // 4) % 4 AS iy, ("row" * 8 + col) % 4 AS ix, {_V} AS v FROM images)'


def grids(spark, sf, kind):
    i = images(spark, sf)
    n = F.col("row") * 8 + F.col("col")
    cells = {"plane": {"iy": F.col("row"), "ix": F.col("col")}, "line": {"ix": n}, "cube": {"iz": F.floor(n / 16), "iy": F.floor(n / 4) % 4, "ix": n % 4}}[kind]
    return i.select(F.col("image_id").alias("node_id"), *[c.cast("int").alias(k) for k, c in cells.items()], "value")


def cells(n, *axes):
    return {a: (F.col(a) + 1.0) * ((n - 1) / 2.0) for a in axes}


@query("bilinear_image", f"WITH {SQL['points']}, {IM}, {_PLANE}, p AS (SELECT *, x * {d(3.5)} + {d(3.5)} AS c_x, y * {d(3.5)} + {d(3.5)} AS c_y FROM points), {lerp_sql({'y': 8, 'x': 8}, 'plane', 'p', 'point_id')} SELECT point_id, round(s, 6) + {d(0)} AS sampled FROM sampled")
def bilinear_image(spark, sf):
    out = interp.sample_grid(view(spark, sf, "points").drop("value"), grids(spark, sf, "plane"), cells(8, "y", "x"), {"y": 8, "x": 8})
    return out.select("point_id", r6(F.col("value")).alias("sampled"))


@query("grid1d", f"WITH {SQL['points']}, {IM}, {_LINE}, p AS (SELECT *, x * {d(31.5)} + {d(31.5)} AS c_x FROM points), {lerp_sql({'x': 64}, 'line', 'p', 'point_id')} SELECT point_id, round(s, 6) + {d(0)} AS sampled FROM sampled")
def grid1d(spark, sf):
    out = interp.sample_grid(view(spark, sf, "points").drop("value"), grids(spark, sf, "line"), cells(64, "x"), {"x": 64})
    return out.select("point_id", r6(F.col("value")).alias("sampled"))


@query("grid3d", f"WITH {SQL['points']}, {IM}, {_CUBE}, p AS (SELECT *, x * {d(1.5)} + {d(1.5)} AS c_x, y * {d(1.5)} + {d(1.5)} AS c_y, z * {d(1.5)} + {d(1.5)} AS c_z FROM points), {lerp_sql({'z': 4, 'y': 4, 'x': 4}, 'cube', 'p', 'point_id')} SELECT point_id, round(s, 6) + {d(0)} AS sampled FROM sampled")
def grid3d(spark, sf):
    out = interp.sample_grid(view(spark, sf, "points").drop("value"), grids(spark, sf, "cube"), cells(4, "z", "y", "x"), {"z": 4, "y": 4, "x": 4})
    return out.select("point_id", r6(F.col("value")).alias("sampled"))


@query("grid1d_slope", f"WITH {SQL['points']}, {IM}, {_LINE}, p AS (SELECT point_id, node_id, least(CAST(floor(least(greatest(x * {d(31.5)} + {d(31.5)}, 0), 63)) AS BIGINT), 62) AS lo FROM points) SELECT point_id, round(b.v - a.v, 6) + {d(0)} AS slope FROM p JOIN line a ON p.node_id = a.node_id AND lo = a.ix JOIN line b ON p.node_id = b.node_id AND lo + 1 = b.ix")
def grid1d_slope(spark, sf):
    out = interp.line_gradient(view(spark, sf, "points").drop("value"), grids(spark, sf, "line"), cells(64, "x")["x"], 64)
    return out.select("point_id", r6(F.col("slope")).alias("slope"))


@query("grid_gradient", f"WITH {SQL['points']}, p AS (SELECT point_id, node_id, y AS residual, x * {d(3.5)} + {d(3.5)} AS c_x, z * {d(3.5)} + {d(3.5)} AS c_z FROM points), {lerp_sql({'z': 8, 'x': 8}, '(SELECT 1 AS node_id, 1 AS iz, 1 AS ix, 1 AS v)', 'p', 'point_id').rsplit(', sampled', 1)[0]} SELECT corners.node_id, CAST(iz AS INT) AS iz, CAST(ix AS INT) AS ix, round(sum(w * residual), 5) + {d(0)} AS gradient FROM corners JOIN p ON corners.point_id = p.point_id GROUP BY 1, 2, 3")
def grid_gradient(spark, sf):
    g = interp.grid_gradient(view(spark, sf, "points").withColumn("residual", F.col("y")), "residual", cells(8, "z", "x"), {"z": 8, "x": 8})
    return g.select("node_id", "iz", "ix", (F.round("gradient", 5) + F.lit(0.0)).alias("gradient"))


def _hash_sql(levels=2, base=4, growth=1.0, size=64, along=None):
    parts = []
    u = {"u": "((x + 1) / 2)", "v": "((y + 1) / 2)", "w": "((z + 1) / 2)"}
    for level in range(levels):
        scale = 2.0 ** (level * growth) * base - 1.0
        res = math.ceil(scale) + 1
        for bits in range(8):
            at = {c: f"(CAST(floor({e} * {scale}) AS BIGINT) + {bits >> k & 1})" for k, (c, e) in enumerate(u.items())}
            w = " * ".join(f"({scale if bits >> k & 1 else -scale})" if c == along else f"({e} * {scale} - floor({e} * {scale}))" if bits >> k & 1 else f"(1 - ({e} * {scale} - floor({e} * {scale})))" for k, (c, e) in enumerate(u.items()))
            if res**3 <= size:
                slot = f"({at['u']} + {at['v']} * {res} + {at['w']} * {res * res}) % {size}"
            else:
                slot = f"xor(xor(({at['u']} * 1) & 4294967295, ({at['v']} * 2654435761) & 4294967295), ({at['w']} * 805459861) & 4294967295) % {size}"
            parts.append(f"SELECT point_id, {level} AS level, {slot} AS slot, {w} AS w FROM points")
    return " UNION ALL ".join(parts)


@query("hash_encode", f'WITH {SQL["points"]}, {IM}, tab AS (SELECT "row" * 8 + col AS slot, avg({_V}) AS v FROM images GROUP BY 1), c AS ({_hash_sql()}), r AS (SELECT c.point_id, level, sum(c.w * v) AS f FROM c JOIN tab ON c.slot = tab.slot GROUP BY 1, 2) SELECT r.point_id, level, round(CASE WHEN x BETWEEN -1 AND 1 AND y BETWEEN -1 AND 1 AND z BETWEEN -1 AND 1 THEN f ELSE 0 END, 6) + {d(0)} AS feature FROM r JOIN points ON r.point_id = points.point_id')
def hash_encode(spark, sf):
    p = view(spark, sf, "points").select("point_id", *[((F.col(a) + 1) / 2).alias(c) for a, c in zip("xyz", "uvw", strict=True)])
    tab = images(spark, sf).groupBy((F.col("row") * 8 + F.col("col")).cast("long").alias("slot")).agg(F.avg("value").alias("value"))
    return interp.hash_encode(p, tab, 2, 4, 1.0, 64).select("point_id", "level", r6(F.col("feature")).alias("feature"))


_K = [[0.0, 1.0, 0.0], [1.0, -4.0, 1.0], [0.0, 1.0, 0.0]]


@query("conv2d", f'WITH {IM} SELECT a.image_id, a."row", a.col, round(sum(b.{_V} * CASE WHEN a."row" = b."row" AND a.col = b.col THEN -4 WHEN abs(a."row" - b."row") + abs(a.col - b.col) = 1 THEN 1 ELSE 0 END), 6) + {d(0)} AS filtered FROM images a JOIN images b ON a.image_id = b.image_id AND abs(a."row" - b."row") <= 1 AND abs(a.col - b.col) <= 1 GROUP BY 1, 2, 3')
def conv2d(spark, sf):
    return interp.convolve(images(spark, sf), _K).select("image_id", "row", "col", r6(F.col("value")).alias("filtered"))


@query("pyramid", f'WITH {IM} SELECT image_id, CAST(floor("row" / 2) AS INT) AS "row", CAST(floor(col / 2) AS INT) AS col, round(avg({_V}), 6) + {d(0)} AS mean FROM images GROUP BY 1, 2, 3')
def pyramid(spark, sf):
    return interp.halve(images(spark, sf)).select("image_id", "row", "col", r6(F.col("value")).alias("mean"))


@query("total_variation", f'WITH {IM} SELECT image_id, round(avg(abs(dx)) + avg(abs(dy)), 6) AS tv FROM (SELECT image_id, lead({_V}) OVER (PARTITION BY image_id, "row" ORDER BY col) - {_V} AS dx, lead({_V}) OVER (PARTITION BY image_id, col ORDER BY "row") - {_V} AS dy FROM images) GROUP BY 1')
def total_variation(spark, sf):
    return metrics.total_variation(images(spark, sf)).select("image_id", r6(F.col("tv")).alias("tv"))


@query("huber_variation", f'WITH {IM} SELECT image_id, round(avg(CASE WHEN abs(dx) < 0.1 THEN dx * dx / 2 ELSE 0.1 * (abs(dx) - 0.05) END) + avg(CASE WHEN abs(dy) < 0.1 THEN dy * dy / 2 ELSE 0.1 * (abs(dy) - 0.05) END), 6) AS huber FROM (SELECT image_id, lead({_V}) OVER (PARTITION BY image_id, "row" ORDER BY col) - {_V} AS dx, lead({_V}) OVER (PARTITION BY image_id, col ORDER BY "row") - {_V} AS dy FROM images) GROUP BY 1')
def huber_variation(spark, sf):
    # the last pixel of a row has no step: averages leave it out, so its NULL must stay one
    return metrics.huber_variation(images(spark, sf), 0.1).select("image_id", r6(F.col("huber")).alias("huber"))


@query("edge_map", f'WITH {IM} SELECT image_id, "row", col, round(least(abs(coalesce(lead({_V}) OVER r, 0) - coalesce(lag({_V}) OVER r, 0)) + abs(coalesce(lead({_V}) OVER c, 0) - coalesce(lag({_V}) OVER c, 0)), 1), 6) + {d(0)} AS edge FROM images WINDOW r AS (PARTITION BY image_id, "row" ORDER BY col), c AS (PARTITION BY image_id, col ORDER BY "row")')
def edge_map(spark, sf):
    return metrics.edge_map(images(spark, sf)).select("image_id", "row", "col", r6(F.col("edge")).alias("edge"))


@query("image_psnr", f"WITH {IM}, p AS (SELECT image_id, avg(power({_V} - 0.1, 2)) AS mse, avg(abs({_V} - 0.1)) AS l1 FROM images GROUP BY 1) SELECT round(avg(mse), 6) AS mse, round(avg(l1), 6) AS l1, round(10 * log10(1 / avg(mse)), 6) AS psnr FROM p")
def image_psnr(spark, sf):
    out = metrics.image_errors(images(spark, sf).withColumn("b", F.lit(0.1)), "value", "b")
    return out.select(*[r6(F.col(c)).alias(c) for c in ("mse", "l1", "psnr")])


_SSIM = "((2 * ma * mb + 1e-4) * (2 * (ab - ma * mb) + 9e-4)) / ((ma * ma + mb * mb + 1e-4) * (aa - ma * ma + bb - mb * mb + 9e-4))"


@query("ssim", f'WITH {IM}, i AS (SELECT *, {_V} * 0.9 + 0.01 * "row" AS b FROM images), m AS (SELECT x.image_id, x."row", x.col, avg(y.{_V}) AS ma, avg(y.b) AS mb, avg(y.{_V} * y.{_V}) AS aa, avg(y.b * y.b) AS bb, avg(y.{_V} * y.b) AS ab FROM i x JOIN i y ON x.image_id = y.image_id AND abs(x."row" - y."row") <= 1 AND abs(x.col - y.col) <= 1 GROUP BY 1, 2, 3) SELECT image_id, round(avg({_SSIM}), 6) AS ssim FROM m GROUP BY 1')
def ssim(spark, sf):
    i = images(spark, sf).withColumn("b", F.col("value") * 0.9 + F.col("row") * 0.01)
    return metrics.ssim(i, "value", "b").select("image_id", r6(F.col("ssim")).alias("ssim"))


@query("background", f'WITH {IM}, m AS (SELECT image_id, quantile_disc({_V}, 0.5) AS md FROM images WHERE "row" < 4 AND col < 4 GROUP BY 1), a AS (SELECT image_id FROM images UNION SELECT s_suppkey + 100000 FROM supplier) SELECT a.image_id, round(coalesce(md, (SELECT avg(md) FROM m)), 6) + {d(0)} AS background FROM a LEFT JOIN m ON a.image_id = m.image_id')
def background(spark, sf):
    """The median of every image's crop; the suppliers stand for images without pixels, which get the mean."""
    i = images(spark, sf)
    none = spark.read.parquet(f"{sf}/supplier.parquet").select((F.col("s_suppkey") + 100000).alias("image_id"))
    return metrics.background(i, 4, i.select("image_id").union(none).distinct()).select("image_id", r6(F.col("background")).alias("background"))


@query("curve_smoothness", f'WITH {IM}, k AS (SELECT image_id, "row" * 8 + col AS knot, {_V} AS v FROM images), w AS (SELECT image_id, v, lag(v) OVER o AS p, lead(v) OVER o AS n FROM k WINDOW o AS (PARTITION BY image_id ORDER BY knot)) SELECT image_id AS curve_id, round(avg(power(v - CASE WHEN p IS NULL THEN 0 WHEN n IS NULL THEN 1 ELSE (p + n) / 2 END, 2)), 6) AS smoothness FROM w GROUP BY 1')
def curve_smoothness(spark, sf):
    c = images(spark, sf).select(F.col("image_id").alias("curve_id"), (F.col("row") * 8 + F.col("col")).alias("knot"), "value")
    return metrics.smoothness(c, 1.0).select("curve_id", r6(F.col("smoothness")).alias("smoothness"))


@query("l2_loss", f"WITH {IM} SELECT label, round(avg({_V} * {_V}), 6) AS l2 FROM images GROUP BY 1")
def l2_loss(spark, sf):
    return images(spark, sf).groupBy("label").agg(F.avg(F.col("value") * F.col("value")).alias("l2")).select("label", r6(F.col("l2")).alias("l2"))


@query("row_batches", f'WITH {IM} SELECT image_id, CAST(floor("row" / 2) AS BIGINT) AS block, count(*) AS pixels, round(sum({_V}), 5) + {d(0)} AS total FROM images GROUP BY 1, 2')
def row_batches(spark, sf):
    blocks = batches.row_batches(images(spark, sf), 2, 8, 8)
    b = blocks.groupBy("image_id", (F.col("row_start") / 2).cast("long").alias("block")).agg(F.count(F.lit(1)).alias("pixels"), (F.round(F.sum("value"), 5) + F.lit(0.0)).alias("total"))
    return b.select("image_id", "block", "pixels", "total")

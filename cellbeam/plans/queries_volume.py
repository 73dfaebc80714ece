"""Queries over volumes: lattices and slices, densities from node grids, rendering, fillings and factorised features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import AXES, r6
from ..operators import batches, camera, fit, interp, metrics, points, rays, tree, volumes
from ..sources.tables import settled
from .queries_images import _CUBE, IM, _hash_sql, cells, grids, lerp_sql
from .queries_tree import _ACTIVE, _SAMPLES, DEPTH, DIAGONAL, active_nodes, hits_of, rnd
from .scenes import SQL, d, images, leaf_sql, tree_sql, uniform_sql, view

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_V = '"value"'
#: Cells of a node's grid per axis.
N = 4


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = " ".join(sql.split())
        return f

    return add


def point_grid(spark, sf):
    """A grid of N cells per axis in each leaf: the mean value of the points in a cell; cells without points are missing."""
    p = view(spark, sf, "points").withColumn("node_id", points.leaf_key(DEPTH)).where("node_id is not null")
    at = volumes.local_of(DEPTH)
    cell = {a: F.least(F.floor((at[a] + 1) / 2 * N).cast("int"), F.lit(N - 1)) for a in AXES}
    return p.groupBy("node_id", *[cell[a].alias(f"i{a}") for a in reversed(AXES)]).agg((F.avg("value") / 100).alias("value"))


_LOCAL = {a: f"(({a} - {a}0) / ({a}1 - {a}0) * 2 - 1)" for a in "xyz"}
_LEAF = tree_sql("leaf", DEPTH)
_GRID = f"pg AS (SELECT q.leaf AS node_id, {', '.join(f'least(CAST(floor(({_LOCAL[a]} + 1) / 2 * {N}) AS INT), {N - 1}) AS i{a}' for a in 'zyx')}, avg(value) / 100 AS v FROM (SELECT *, {leaf_sql(DEPTH)} AS leaf FROM points) q JOIN leaf ON q.leaf = leaf.node_id GROUP BY 1, 2, 3, 4)"


def density_sql(samples: str, key: str, grid: str | None = None) -> str:
    """CTEs p.. sampled and known for the samples (key, node_id, x, y, z) of a CTE; ``dens`` has key and density."""
    at = ", ".join(f"{_LOCAL[a]} * {d((N - 1) / 2)} + {d((N - 1) / 2)} AS c_{a}" for a in "xyz")
    p = f"p AS (SELECT s.{key}, s.node_id, {at} FROM {samples} s JOIN leaf ON s.node_id = leaf.node_id)"
    dens = f"dens AS (SELECT p.{key}, ln(1 + exp(coalesce(s, 0))) AS density FROM p LEFT JOIN sampled ON p.{key} = sampled.{key} WHERE p.node_id IN (SELECT node_id FROM pg))"
    return f"{grid or _GRID}, {p}, {lerp_sql({'z': N, 'y': N, 'x': N}, 'pg', 'p', key)}, {dens}"


_VOX = f"CAST(cx AS INT) AS ix, CAST(cy AS INT) AS iy, CAST(cz AS INT) AS iz, round(coalesce(density, 0), 5) + {d(0)} AS density, s.node_id, s.node_id IS NOT NULL AS valid FROM s LEFT JOIN dens ON s.i = dens.i"


def voxel_rows(sampled):
    return volumes.voxels(sampled).select("ix", "iy", "iz", (F.round("value", 5) + F.lit(0.0)).alias("density"), "node_id", "valid")


@query("uniform_volume", f"WITH {SQL['points']}, {_LEAF}, c AS (SELECT i, i % 17 AS cx, (i // 17) % 17 AS cy, i // 289 AS cz FROM (SELECT unnest(range(4913)) AS i)), placed AS (SELECT *, {', '.join(f'{d(f'c{a}')} / 16 * 2 - 1 AS {a}' for a in 'xyz')} FROM c), s AS (SELECT *, {leaf_sql(DEPTH)} AS node_id FROM placed), {density_sql('s', 'i')} SELECT {_VOX}")
def uniform_volume(spark, sf):
    """The density field of all points' grids, sampled on a lattice over the whole volume."""
    s = volumes.uniform_volume(spark, (17, 17, 17), DEPTH)
    return voxel_rows(volumes.sample_volume(s, point_grid(spark, sf), DEPTH, N))


_SLICE = {"x": (-1.05, 0.07), "y": (0.1, 0.0), "z": (-0.9, 0.06)}


@query("slice_grid", f"WITH {SQL['points']}, {_LEAF}, c AS (SELECT i, i // 31 AS cx, 0 AS cy, i % 31 AS cz FROM (SELECT unnest(range(961)) AS i)), placed AS (SELECT *, {', '.join(f'{d(lo)} + {d(step)} * c{a} AS {a}' for a, (lo, step) in _SLICE.items())} FROM c), s AS (SELECT *, {leaf_sql(DEPTH)} AS node_id FROM placed), {density_sql('s', 'i')} SELECT {_VOX}")
def slice_grid(spark, sf):
    """One slice in y, last axis fastest, which reaches beyond the volume on both sides of x."""
    lo, step = zip(*_SLICE.values(), strict=True)
    s = volumes.uniform_slice(spark, (31, 1, 31), lo, step, DEPTH, last_fastest=True)
    return voxel_rows(volumes.sample_volume(s, point_grid(spark, sf), DEPTH, N))


@query("render_grid", f"WITH {SQL['points']}, {_SAMPLES}, s AS (SELECT ray_id * 1000000 + node_id * 1000 + j AS i, ray_id, node_id, weight, x, y, z FROM samples), {density_sql('s', 'i')} SELECT rays.ray_id, round(coalesce(sum(weight * density), 0), 4) + {d(0)} AS integral FROM rays LEFT JOIN s ON rays.ray_id = s.ray_id LEFT JOIN dens ON s.i = dens.i GROUP BY 1")
def render_grid(spark, sf):
    """Rays through the density field: look-up, activation and integral."""
    r = view(spark, sf, "rays")
    out = volumes.render(r, rays.ray_samples(hits_of(spark, sf), DIAGONAL, 8), point_grid(spark, sf), DEPTH, N)
    return out.select("ray_id", (F.round("integral", 4) + F.lit(0.0)).alias("integral"))


_BACK = f"d1 AS (SELECT rays.ray_id, rays.target, coalesce(sum(weight * density), 0) AS integral FROM rays LEFT JOIN s ON rays.ray_id = s.ray_id LEFT JOIN dens ON s.i = dens.i GROUP BY 1, 2), res AS (SELECT ray_id, 2 * (integral - target) / (SELECT count(*) FROM rays) AS residual FROM d1), g AS (SELECT c.node_id, c.iz, c.iy, c.ix, sum(residual * weight / (1 + exp(-coalesce(m.s, 0))) * c.w) AS gradient FROM corners c JOIN s ON c.i = s.i JOIN res ON s.ray_id = res.ray_id LEFT JOIN sampled m ON c.i = m.i WHERE c.node_id IN (SELECT node_id FROM pg) GROUP BY 1, 2, 3, 4)"


@query("render_gradient", f"WITH {SQL['points']}, {_SAMPLES}, s AS (SELECT ray_id * 1000000 + node_id * 1000 + j AS i, ray_id, node_id, weight, x, y, z FROM samples), {density_sql('s', 'i')}, {_BACK} SELECT node_id, CAST(iz AS INT) AS iz, CAST(iy AS INT) AS iy, CAST(ix AS INT) AS ix, round(gradient, 6) + {d(0)} AS gradient FROM g")
def render_gradient(spark, sf):
    """From the rays' errors back to the cells of all nodes' grids."""
    r, s, grid = view(spark, sf, "rays"), rays.ray_samples(hits_of(spark, sf), DIAGONAL, 8), settled(point_grid(spark, sf))
    back = volumes.residuals(volumes.render(r, s, grid, DEPTH, N), r)
    # residuals go down the rays a second time, one row a ray, so that no sample is joined with its ray
    hits = rays.ray_node_hits(r.join(back.hint("merge"), "ray_id"), DEPTH, carry=("residual",))
    s = rays.ray_samples(hits, DIAGONAL, 8, carry=("residual",))
    return volumes.render_gradient(back, s, grid, DEPTH, N).select("node_id", "iz", "iy", "ix", r6(F.col("gradient")).alias("gradient"))


def slope_sql(axis: str) -> str:
    """Slope of a cube's look-up along an axis: the gap of two look-ups, on the cells before and behind."""
    at = {a: f"{a} * {d(1.5)} + {d(1.5)}" for a in "zyx"}
    ends = [", ".join(f"least(floor(least(greatest({e}, 0), 3)), 2) + {k} AS c_{a}" if a == axis else f"{e} AS c_{a}" for a, e in at.items()) for k in (0, 1)]
    side = [f"(WITH q AS (SELECT point_id, node_id, {x} FROM points), {lerp_sql({'z': 4, 'y': 4, 'x': 4}, 'cube', 'q', 'point_id')} SELECT * FROM sampled)" for x in ends]
    return f"SELECT a.point_id, '{axis}' AS axis, b.s - a.s AS slope FROM {side[0]} a JOIN {side[1]} b ON a.point_id = b.point_id"


@query("grid_slopes", f"WITH {SQL['points']}, {IM}, {_CUBE}, u AS ({' UNION ALL '.join(slope_sql(a) for a in 'zyx')}) SELECT u.point_id, {', '.join(f'round(max(CASE WHEN axis = {chr(39)}{a}{chr(39)} THEN CASE WHEN {a} * {d(1.5)} + {d(1.5)} BETWEEN 0 AND 3 THEN slope ELSE 0 END END), 6) + {d(0)} AS d{a}' for a in 'zyx')} FROM u JOIN points ON u.point_id = points.point_id GROUP BY 1")
def grid_slopes(spark, sf):
    """Derivatives of a three-dimensional look-up by the place."""
    out = interp.grid_slopes(view(spark, sf, "points").drop("value"), grids(spark, sf, "cube"), cells(4, "z", "y", "x"), {"z": 4, "y": 4, "x": 4})
    return out.select("point_id", *[r6(F.col(f"d{a}")).alias(f"d{a}") for a in "zyx"])


@query("hash_slopes", f"WITH {SQL['points']}, {IM}, tab AS (SELECT {chr(34)}row{chr(34)} * 8 + col AS slot, avg({_V}) AS v FROM images GROUP BY 1), c AS ({_hash_sql(along='v')}), r AS (SELECT c.point_id, level, sum(c.w * v) AS f FROM c JOIN tab ON c.slot = tab.slot GROUP BY 1, 2) SELECT r.point_id, level, round(CASE WHEN x BETWEEN -1 AND 1 AND y BETWEEN -1 AND 1 AND z BETWEEN -1 AND 1 THEN f ELSE 0 END, 6) + {d(0)} AS slope FROM r JOIN points ON r.point_id = points.point_id")
def hash_slopes(spark, sf):
    """Derivatives of the hash encoding by the second coordinate."""
    p = view(spark, sf, "points").select("point_id", *[((F.col(a) + 1) / 2).alias(c) for a, c in zip("xyz", "uvw", strict=True)])
    tab = images(spark, sf).groupBy((F.col("row") * 8 + F.col("col")).cast("long").alias("slot")).agg(F.avg("value").alias("value"))
    return interp.hash_encode(p, tab, 2, 4, 1.0, 64, along="v").select("point_id", "level", r6(F.col("feature")).alias("slope"))


_NET = fit.init_network([2, 8, 1], 5)


def network_sql(inputs: list[str], layers) -> str:
    """First output of a small network with relu between its layers, written out."""
    for k, (w, bias) in enumerate(layers):
        out = [" + ".join([*[f"{x} * {d(repr(float(w[i, j])))}" for i, x in enumerate(inputs)], d(float(bias[j]))]) for j in range(w.shape[1])]
        inputs = [f"greatest({x}, 0)" for x in out] if k + 1 < len(layers) else out
    return inputs[0]


def channel_sql(grid: str) -> str:
    return f"(WITH {lerp_sql({'z': N, 'y': N, 'x': N}, grid, 'p', 'i')} SELECT * FROM sampled)"


_DECODED = f"{_GRID}, sq AS (SELECT node_id, iz, iy, ix, v * v AS v FROM pg), p AS (SELECT s.i, s.node_id, {', '.join(f'{_LOCAL[a]} * {d((N - 1) / 2)} + {d((N - 1) / 2)} AS c_{a}' for a in 'xyz')} FROM s JOIN leaf ON s.node_id = leaf.node_id), dens AS (SELECT p.i, ln(1 + exp({network_sql(['coalesce(f0.s, 0)', 'coalesce(f1.s, 0)'], _NET)})) AS density FROM p LEFT JOIN {channel_sql('pg')} f0 ON p.i = f0.i LEFT JOIN {channel_sql('sq')} f1 ON p.i = f1.i WHERE p.node_id IN (SELECT node_id FROM pg))"


@query("render_decoded", f"WITH {SQL['points']}, {_SAMPLES}, s AS (SELECT ray_id * 1000000 + node_id * 1000 + j AS i, ray_id, node_id, weight, x, y, z FROM samples), {_DECODED} SELECT rays.ray_id, round(coalesce(sum(weight * density), 0), 4) + {d(0)} AS integral FROM rays LEFT JOIN s ON rays.ray_id = s.ray_id LEFT JOIN dens ON s.i = dens.i GROUP BY 1")
def render_decoded(spark, sf):
    """As ``render_grid`` with a second channel and a small network between look-up and activation."""
    r = view(spark, sf, "rays")
    two = point_grid(spark, sf).select("node_id", "iz", "iy", "ix", F.col("value").alias("value0"), (F.col("value") * F.col("value")).alias("value1"))
    out = volumes.render(r, rays.ray_samples(hits_of(spark, sf), DIAGONAL, 8), two, DEPTH, N, layers=_NET)
    return out.select("ray_id", (F.round("integral", 4) + F.lit(0.0)).alias("integral"))


_PAIR = f"cube2 AS (SELECT node_id, iz, iy, ix, v AS a, v * {d(0.9)} + {d(0.01)} * ix AS b FROM cube)"


def pairs_of_volumes(spark, sf):
    return grids(spark, sf, "cube").select("node_id", "iz", "iy", "ix", F.col("value").alias("a"), (F.col("value") * 0.9 + F.col("ix") * 0.01).alias("b"))


@query("volume_psnr", f"WITH {IM}, {_CUBE}, {_PAIR}, m AS (SELECT node_id, max(b) AS peak, avg((a - b) * (a - b)) AS mse FROM cube2 GROUP BY 1) SELECT node_id, round(peak, 6) AS peak, round(10 * log10(peak * peak / mse), 5) AS psnr FROM m")
def volume_psnr(spark, sf):
    return metrics.volume_psnr(pairs_of_volumes(spark, sf), "a", "b").select("node_id", F.round("peak", 6).alias("peak"), F.round("psnr", 5).alias("psnr"))


@query("volume_ssim", f"WITH {IM}, {_CUBE}, {_PAIR}, m AS (SELECT x.node_id, x.iz, x.iy, x.ix, avg(y.a) AS ma, avg(y.b) AS mb, avg(y.a * y.a) AS aa, avg(y.b * y.b) AS bb, avg(y.a * y.b) AS ab FROM cube2 x JOIN cube2 y ON x.node_id = y.node_id AND abs(x.iz - y.iz) <= 2 AND abs(x.iy - y.iy) <= 2 AND abs(x.ix - y.ix) <= 2 GROUP BY 1, 2, 3, 4) SELECT node_id, round(avg(((2 * ma * mb + 1e-4) * (2 * (ab - ma * mb) + 9e-4)) / ((ma * ma + mb * mb + 1e-4) * (aa - ma * ma + bb - mb * mb + 9e-4))), 5) AS ssim FROM m GROUP BY 1")
def volume_ssim(spark, sf):
    """Windows of five cells per axis."""
    return metrics.ssim(pairs_of_volumes(spark, sf), "a", "b", 2, image="node_id", axes=("iz", "iy", "ix")).select("node_id", F.round("ssim", 5).alias("ssim"))


_FULL = "boxed AS (" + " UNION ALL ".join(f"SELECT node_id, x0, x1, y0, y1, z0, z1 FROM t{k}" for k in range(DEPTH + 1)) + ")"
_PLACE = f"CASE WHEN leaf IN (SELECT node_id FROM active) THEN leaf WHEN leaf IS NOT NULL THEN 1 + ((leaf - {tree.level_start(DEPTH)}) >> 3) END"
_NEAR = {a: f"CAST(round(({a} - {a}0) / ({a}1 - {a}0) * {N - 1}) AS INT)" for a in "xyz"}


@query("fill_inactive", f"WITH {_ACTIVE}, {_FULL}, k AS (SELECT b.node_id, {', '.join(f'{_NEAR[a]} AS i{a}' for a in 'zyx')}, avg(value) / 7 AS v FROM (SELECT *, {_PLACE} AS a FROM (SELECT *, {leaf_sql(DEPTH)} AS leaf FROM points)) p JOIN boxed b ON p.a = b.node_id GROUP BY 1, 2, 3, 4), cells AS (SELECT node_id, cell % {N} AS ix, (cell // {N}) % {N} AS iy, cell // {N * N} AS iz, {', '.join(f'{a}0 + {n} / {d(N - 1)} * ({a}1 - {a}0) AS {a}' for a, n in (('x', f'(cell % {N})'), ('y', f'((cell // {N}) % {N})'), ('z', f'(cell // {N * N})')))} FROM (SELECT *, unnest(range({N**3})) AS cell FROM boxed WHERE node_id NOT IN (SELECT node_id FROM active))), f AS (SELECT c.node_id, c.iz, c.iy, c.ix, b.node_id AS source, {', '.join(f'{_NEAR[a]} AS s{a}' for a in 'xyz')} FROM (SELECT *, {_PLACE} AS a FROM (SELECT *, {leaf_sql(DEPTH)} AS leaf FROM cells)) c JOIN boxed b ON c.a = b.node_id) SELECT f.node_id, CAST(f.iz AS INT) AS iz, CAST(f.iy AS INT) AS iy, CAST(f.ix AS INT) AS ix, round(v, 5) + {d(0)} AS v FROM f LEFT JOIN k ON f.source = k.node_id AND f.sx = k.ix AND f.sy = k.iy AND f.sz = k.iz")
def fill_inactive(spark, sf):
    """Grids of all inactive nodes from the active nodes' grids of the points' mean values."""
    every, active = tree.full_tree(spark, DEPTH), active_nodes(spark)
    p = points.locate(view(spark, sf, "points").drop("node_id"), active, DEPTH).where("active_node is not null")
    p = points.local_coordinates(p.withColumnRenamed("active_node", "node_id"), active)
    at = {a: F.round((F.col(f"l{a}") + 1) / 2 * (N - 1)).cast("int") for a in AXES}
    known = p.groupBy("node_id", *[at[a].alias(f"i{a}") for a in "zyx"]).agg((F.avg("value") / 7).alias("value"))
    out = points.fill_inactive(every.join(active.select("node_id"), "node_id", "left_anti"), active, known, DEPTH, N)
    return out.select("node_id", "iz", "iy", "ix", (F.round("value", 5) + F.lit(0.0)).alias("v"))


def quad_leaf(x: str, z: str, y: str = "y") -> str:
    c = [f"greatest(CAST(ceil(({a} + {d(1)}) * {d(2**DEPTH / 2)}) AS BIGINT) - 1, 0)" for a in (x, z)]
    bits = " + ".join(f"((({k} >> {b}) & 1) * {1 << (2 * b + i)})" for b in range(DEPTH) for i, k in enumerate(c))
    return f"CASE WHEN {' AND '.join(f'{a} BETWEEN -1 AND 1' for a in (x, y, z))} THEN {tree.level_start(DEPTH, 4)} + {bits} END"


_QUAD = " UNION ALL ".join(f"SELECT point_id, '{a}' AS axis, {quad_leaf(*[f'({b} - {d(0.05)})' if a == b else b for b in 'xz'])} AS n0, {quad_leaf(*[f'({b} + {d(0.05)})' if a == b else b for b in 'xz'])} AS n1 FROM points" for a in "xz")


@query("neighbor_pairs_quad", f"WITH {SQL['points']}, p AS ({_QUAD}), q AS (SELECT * FROM p WHERE n0 <> n1) SELECT point_id, axis, 0 AS side, n0 AS node_id FROM q UNION ALL SELECT point_id, axis, 1, n1 FROM q")
def neighbor_pairs_quad(spark, sf):
    """Faces of a quadtree, which has none in y."""
    return points.face_neighbours(view(spark, sf, "points"), DEPTH, 0.05, ("x", "z"), quad=True).select("point_id", "axis", "side", "node_id")


@query("neighbor_pairs_plane", f"WITH {SQL['points']}, p AS ({_QUAD}), q AS (SELECT * FROM p WHERE n0 <> n1 AND axis = 'x') SELECT point_id, 0 AS side, n0 AS node_id FROM q UNION ALL SELECT point_id, 1, n1 FROM q")
def neighbor_pairs_plane(spark, sf):
    """Faces across one axis only."""
    return points.face_neighbours(view(spark, sf, "points"), DEPTH, 0.05, ("x",), quad=True).select("point_id", "side", "node_id")


_MEANS = f'lines AS (SELECT image_id AS node_id, col AS ix, avg({_V}) AS v FROM images GROUP BY 1, 2)'
_PLANES = f'plane AS (SELECT image_id AS node_id, "row" AS iy, col AS ix, {_V} AS v FROM images)'
#: The x line runs over the region of interest, y over the node, z over the volume.
_LINES = {"x": f"(2 * (x - {d(-0.8)}) / ({d(0.9)} - {d(-0.8)}) - 1)", "y": "y", "z": "z"}


def tensor_sql(axis: int) -> str:
    p, q, r = (("y", "z", "x"), ("x", "z", "y"), ("x", "y", "z"))[axis]
    plane = f"(WITH pp AS (SELECT point_id, node_id, {q} * {d(3.5)} + {d(3.5)} AS c_y, {p} * {d(3.5)} + {d(3.5)} AS c_x FROM points), {lerp_sql({'y': 8, 'x': 8}, 'plane', 'pp', 'point_id')} SELECT * FROM sampled)"
    line = f"(WITH pl AS (SELECT point_id, node_id, {_LINES[r]} * {d(3.5)} + {d(3.5)} AS c_x FROM points), {lerp_sql({'x': 8}, 'lines', 'pl', 'point_id')} SELECT * FROM sampled)"
    return f"SELECT a.point_id, {axis} AS axis, a.s AS plane, a.s * b.s AS feature FROM {plane} a JOIN {line} b ON a.point_id = b.point_id"


_TENSOR = f"WITH {SQL['points']}, {IM}, {_PLANES}, {_MEANS}, f AS ({' UNION ALL '.join(tensor_sql(k) for k in range(3))})"


def tensor_inputs(spark, sf):
    three = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("axis")
    plane = grids(spark, sf, "plane").select("*", three)
    line = images(spark, sf).groupBy(F.col("image_id").alias("node_id"), F.col("col").alias("ix")).agg(F.avg("value").alias("value")).select("*", three)
    s = view(spark, sf, "points").select("point_id", "node_id", F.col("x").alias("u"), F.col("y").alias("v"), F.col("z").alias("w"), interp.roi_coordinate(F.col("x"), -0.8, 0.9).alias("xr"))
    return s, plane, line


@query("tensor_feature", f"{_TENSOR} SELECT point_id, round(sum(feature), 6) + {d(0)} AS feature FROM f GROUP BY 1")
def tensor_feature(spark, sf):
    s, plane, line = tensor_inputs(spark, sf)
    return interp.tensor_feature(s, plane, line, 8, line_coords=("xr", "v", "w")).select("point_id", r6(F.col("value")).alias("feature"))


@query("tensor_cat", f"{_TENSOR} SELECT point_id, axis, round(feature, 6) + {d(0)} AS feature FROM f")
def tensor_cat(spark, sf):
    s, plane, line = tensor_inputs(spark, sf)
    out = interp.tensor_feature(s, plane, line, 8, how="cat", line_coords=("xr", "v", "w"))
    return out.select("point_id", F.posexplode("value").alias("axis", "f")).select("point_id", "axis", r6(F.col("f")).alias("feature"))


@query("tensor_planes", f"{_TENSOR} SELECT point_id, {', '.join(f'round(max(CASE WHEN axis = {k} THEN plane END), 6) + {d(0)} AS p{k}' for k in range(3))} FROM f GROUP BY 1")
def tensor_planes(spark, sf):
    s, plane, _ = tensor_inputs(spark, sf)
    return interp.plane_features(s, plane, 8).select("point_id", *[r6(F.col(f"p{k}")).alias(f"p{k}") for k in range(3)])


@query("hash_gradient", f"WITH {SQL['points']}, c AS ({_hash_sql()}) SELECT c.slot, round(sum(CASE WHEN x BETWEEN -1 AND 1 AND y BETWEEN -1 AND 1 AND z BETWEEN -1 AND 1 THEN c.w ELSE 0 END * y), 5) + {d(0)} AS gradient FROM c JOIN points ON c.point_id = points.point_id GROUP BY 1")
def hash_gradient(spark, sf):
    p = view(spark, sf, "points").select(F.col("y").alias("residual"), *[((F.col(a) + 1) / 2).alias(c) for a, c in zip("xyz", "uvw", strict=True)])
    return interp.hash_gradient(p, "residual", 2, 4, 1.0, 64).select("slot", (F.round("gradient", 5) + F.lit(0.0)).alias("gradient"))


_T = [f"({d(f's_suppkey % {m}')} - {d(m // 2)}) / {d(10)}" for m in (7, 5, 9)]
_TN = "sqrt(" + " + ".join(f"{t} * {t}" for t in _T) + ")"
_A = [f"({t} * CASE WHEN {_TN} < 1e-8 THEN 0.5 ELSE sin({_TN} / 2) / {_TN} END)" for t in _T] + [f"cos({_TN} / 2)"]
_B = ["qx", "qy", "qz", "qw"]
_MUL = [f"{_A[3]} * qx + {_A[0]} * qw + {_A[1]} * qz - {_A[2]} * qy", f"{_A[3]} * qy - {_A[0]} * qz + {_A[1]} * qw + {_A[2]} * qx", f"{_A[3]} * qz + {_A[0]} * qy - {_A[1]} * qx + {_A[2]} * qw", f"{_A[3]} * qw - {_A[0]} * qx - {_A[1]} * qy - {_A[2]} * qz"]


@query("pose_tangent", f"WITH {SQL['poses']} SELECT image_id, {', '.join(rnd(m, b) for m, b in zip(_MUL, _B, strict=True))} FROM poses JOIN supplier ON image_id = s_suppkey")
def pose_tangent(spark, sf):
    """Poses turned by the exponential of a rotation vector each."""
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    t = s.select(F.col("s_suppkey").alias("image_id"), *[(((F.col("s_suppkey") % m).cast("double") - float(m // 2)) / 10).alias(c) for m, c in ((7, "rx"), (5, "ry"), (9, "rz"))])
    return camera.apply_tangent(view(spark, sf, "poses"), t).select("image_id", *[r6(F.col(c)).alias(c) for c in camera.QUAT])


@query("row_blocks", f'WITH {IM}, n AS (SELECT image_id, dense_rank() OVER (ORDER BY image_id) - 1 AS n FROM (SELECT DISTINCT image_id FROM images)) SELECT n * 3 + CAST(floor("row" / 3) AS BIGINT) AS batch, images.image_id, CAST(floor("row" / 3) AS INT) * 3 AS row_start, least(CAST(floor("row" / 3) AS INT) * 3 + 3, 8) AS row_end, "row", col, {rnd(f"col / {d(7)}", "u")}, {rnd(f"""{chr(34)}row{chr(34)} / {d(7)}""", "v")} FROM images JOIN n ON images.image_id = n.image_id')
def row_blocks(spark, sf):
    """Sequential batches of three rows; the last of an image has two."""
    out = batches.row_batches(images(spark, sf), 3, 8, 8)
    return out.select("batch", "image_id", "row_start", "row_end", "row", "col", r6(F.col("u")).alias("u"), r6(F.col("v")).alias("v"))


_SCENE = f"here AS (SELECT s_nationkey AS scene_id, s_suppkey AS image_id, row_number() OVER (ORDER BY s_suppkey) - 1 AS n, count(*) OVER () AS total FROM supplier WHERE s_nationkey = (SELECT s_nationkey FROM supplier GROUP BY 1 ORDER BY {uniform_sql(3, repr('scene'), 's_nationkey')}, 1 LIMIT 1))"
_DRAW = {c: uniform_sql(3, repr(c), "pixel_id") for c in ("draw", "image", "u", "v")}


@query("random_scene_batch", f"WITH {SQL['pixels']}, {_SCENE} SELECT pixel_id, scene_id, here.image_id, {_DRAW['u']} AS u, {_DRAW['v']} AS v FROM pixels JOIN here ON CAST(floor({_DRAW['image']} * total) AS BIGINT) = n WHERE {_DRAW['draw']} < 0.1")
def random_scene_batch(spark, sf):
    """A sampling operator: a tenth of the pixels, in images of one drawn scene (a nation's poses)."""
    i = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_nationkey").alias("scene_id"), F.col("s_suppkey").alias("image_id"))
    return batches.random_scene_batch(view(spark, sf, "pixels"), i, 0.1, 3).select("pixel_id", "scene_id", "image_id", "u", "v")


@query("laplacian_band", f'WITH {IM} SELECT image_id, "row", col, round({_V} - avg({_V}) OVER (PARTITION BY image_id, floor("row" / 2), floor(col / 2)), 6) + {d(0)} AS band FROM images')
def laplacian_band(spark, sf):
    return interp.laplacian_band(images(spark, sf)).select("image_id", "row", "col", r6(F.col("band")).alias("band"))


_LEVEL = {k: f"p{k} AS (SELECT image_id, CAST({chr(34)}row{chr(34)} // 2 AS INT) AS {chr(34)}row{chr(34)}, CAST(col // 2 AS INT) AS col, avg({_V}) AS {_V} FROM {'images' if k == 1 else f'p{k - 1}'} GROUP BY 1, 2, 3)" for k in (1, 2, 3)}
_BAND = " UNION ALL ".join(f"SELECT a.image_id, {k - 1} AS level, a.{chr(34)}row{chr(34)}, a.col, round(a.{_V} - b.{_V}, 6) + {d(0)} AS v FROM {'images' if k == 1 else f'p{k - 1}'} a JOIN p{k} b ON a.image_id = b.image_id AND a.{chr(34)}row{chr(34)} // 2 = b.{chr(34)}row{chr(34)} AND a.col // 2 = b.col" for k in (1, 2, 3))


@query("laplacian_pyramid", f"WITH {IM}, {', '.join(_LEVEL.values())} {_BAND} UNION ALL SELECT image_id, 3, {chr(34)}row{chr(34)}, col, round({_V}, 6) + {d(0)} FROM p3")
def laplacian_pyramid(spark, sf):
    """A chain of three levels and the means that are left."""
    return interp.laplacian_pyramid(images(spark, sf), 3).select("image_id", "level", "row", "col", r6(F.col("value")).alias("v"))


@query("regulariser", f'WITH {IM}, s AS (SELECT image_id, {_V} AS v, lead({_V}) OVER (PARTITION BY image_id, "row" ORDER BY col) - {_V} AS dx, lead({_V}) OVER (PARTITION BY image_id, col ORDER BY "row") - {_V} AS dy FROM images), m AS (SELECT image_id, avg(abs(dx)) + avg(abs(dy)) AS tv, avg(v * v) AS l2 FROM s GROUP BY 1) SELECT round({d(0.1)} * avg(tv) + {d(0.5)} * avg(l2), 6) AS loss FROM m')
def regulariser(spark, sf):
    """Weighted sum of the defined terms: total variation and squared values."""
    i = images(spark, sf)
    square = i.groupBy("image_id").agg(F.avg(F.col("value") * F.col("value")).alias("l2"))
    return metrics.weighted_sum([(metrics.total_variation(i), "tv", 0.1), (square, "l2", 0.5)]).select(F.round("loss", 6).alias("loss"))

"""Queries over losses, statistics, splits, gradients and spectra."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import loss_weight, r6
from ..operators import batches, camera, evolve, fit, metrics, points, rays, spectral, tree
from ..sources.tables import settled
from .queries_images import IM, grids, rot_sql
from .queries_tree import _SAMPLES, DEPTH, hits_of, rnd, samples_of
from .scenes import SQL, d, images, leaf_sql, tree_sql, uniform_sql, view

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_V = '"value"'


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = " ".join(sql.split())
        return f

    return add


@query("node_loss", f"WITH {_SAMPLES}, s AS (SELECT node_id, sum(power(path - target, 2) * weight) AS loss, sum(weight) AS w FROM samples JOIN (SELECT ray_id, sum(weight) AS path FROM samples GROUP BY 1) USING (ray_id) JOIN (SELECT ray_id, target FROM rays) USING (ray_id) GROUP BY 1) SELECT leaf.node_id, round(coalesce(loss, 0), 4) + {d(0)} AS loss, round(coalesce(w, 0), 4) + {d(0)} AS weight FROM leaf LEFT JOIN s ON leaf.node_id = s.node_id")
def node_loss(spark, sf):
    """A ray's sample weights in a node sum to its length there, so one row per ray and node stands for the samples."""
    r, s = view(spark, sf, "rays"), hits_of(spark, sf).select("ray_id", "node_id", (F.col("tmax") - F.col("tmin")).alias("weight"))
    path = s.groupBy("ray_id").agg(F.sum("weight").alias("path"))
    loss = r.join(path, "ray_id").select("ray_id", F.pow(F.col("path") - F.col("target"), 2).alias("loss"))
    nodes = tree.full_tree(spark, DEPTH).where(F.col("depth") == DEPTH)
    out = metrics.node_loss(s, loss, nodes)
    return out.select("node_id", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("loss", "weight")])


@query("node_stats", f"WITH {SQL['points']} SELECT {leaf_sql(DEPTH)} AS node_id, round(max(value), 6) AS largest, round(stddev_samp(value), 6) AS spread, round(sum(value), 4) AS total FROM points GROUP BY 1")
def node_stats(spark, sf):
    s = metrics.node_stats(view(spark, sf, "points").withColumn("node_id", points.leaf_key(DEPTH)))
    return s.select("node_id", F.round("max", 6).alias("largest"), F.round("std", 6).alias("spread"), F.round("sum", 4).alias("total"))


@query("node_product", f"WITH {IM}, p AS (SELECT label, image_id, avg({_V}) + 1 AS e FROM images GROUP BY 1, 2) SELECT label AS node_id, round(product(e), 5) AS product, round(sum(e), 5) AS total FROM p GROUP BY 1")
def node_product(spark, sf):
    e = images(spark, sf).groupBy("label", "image_id").agg((F.avg("value") + 1).alias("value"))
    s = metrics.node_stats(e, node="label")
    return s.select(F.col("label").alias("node_id"), F.round("product", 5).alias("product"), F.round("sum", 5).alias("total"))


@query("training_loss", f"WITH {_SAMPLES}, p AS (SELECT rays.ray_id, target, coalesce(sum(weight), 0) / 10 AS pred FROM rays LEFT JOIN samples ON rays.ray_id = samples.ray_id GROUP BY 1, 2) SELECT round(avg(power(pred - target, 2)), 6) AS plain, round(avg(power(target + 1e-3, 2) * power(pred - target, 2)) + 0.5 * avg(power(target + 1e-3, 2) * abs(pred - target)), 6) AS square FROM p")
def training_loss(spark, sf):
    r, s = view(spark, sf, "rays"), samples_of(spark, sf)
    p = r.join(rays.integrate(r, s.withColumn("one", F.lit(0.1)), "one"), "ray_id")
    return p.agg(F.round(metrics.loss_of("integral", "target"), 6).alias("plain"), F.round(metrics.loss_of("integral", "target", "square", 1.0, 0.5), 6).alias("square"))


@query("running_loss", f"WITH {SQL['rays']}, b AS (SELECT ray_id % 20 AS batch, avg(target) AS loss, count(*) AS n FROM rays GROUP BY 1) SELECT round(sum(loss * n) / sum(n), 6) AS loss FROM b")
def running_loss(spark, sf):
    b = view(spark, sf, "rays").groupBy(F.col("ray_id") % 20).agg(F.avg("target").alias("loss"), F.count(F.lit(1)).alias("n"))
    return metrics.running_loss(b).select(F.round("loss", 6).alias("loss"))


@query("loss_weights", f"WITH {SQL['rays']} SELECT ray_id, {rnd('1 / ((target + 1e-3) * (target + 1e-3))', 'inverse', 4)}, {rnd('(target + 1e-3) * (target + 1e-3)', 'square')} FROM rays")
def loss_weights(spark, sf):
    t = F.col("target")
    return view(spark, sf, "rays").select("ray_id", F.round(loss_weight(t, "inverse"), 4).alias("inverse"), r6(loss_weight(t, "square")).alias("square"))


@query("cell_density", f"WITH {_SAMPLES}, c AS (SELECT node_id, 1e-4 + sum(weight * target * target) AS density FROM samples JOIN (SELECT ray_id, target FROM rays) USING (ray_id) GROUP BY 1), e AS (SELECT min(density) AS mn, max(density) AS mx FROM c) SELECT node_id, round(density, 5) AS density, round(mn / density * 0.5, 5) AS tv, round(density / mx * 0.5, 5) AS nlm, round((density - mn) / (mx - mn) * 0.9 + 0.1, 5) AS scaled FROM c, e")
def cell_density(spark, sf):
    """Hits carry their ray's target, and a ray's sample weights in a node sum to its length there: no ray is joined or shuffled."""
    s = rays.ray_node_hits(view(spark, sf, "rays"), DEPTH, carry=("target",)).withColumn("weight", F.col("tmax") - F.col("tmin"))
    c = settled(s.groupBy("node_id").agg((F.sum(F.col("weight") * F.col("target") * F.col("target")) + 1e-4).alias("density")))
    m = metrics.weight_maps(c, 0.5, 0.1, 1.0)
    return c.join(m, "node_id").select("node_id", *[F.round(x, 5).alias(x) for x in ("density", "tv", "nlm", "scaled")])


_IDS = "n AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) - 1 AS n, count(*) OVER () AS total FROM orders)"


def ids(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("id"))


@query("split_uniform", f"WITH {_IDS} SELECT id, CASE WHEN round(round(n / (total / {d(128)})) * (total / {d(128)})) = n AND round(n / (total / {d(128)})) < 128 THEN 'test' ELSE 'train' END AS split FROM n")
def split_uniform(spark, sf):
    return batches.split_uniform(ids(spark, sf), "id", 128)


@query("split_last", f"WITH {_IDS} SELECT id, CASE WHEN n >= total - 100 THEN 'test' ELSE 'train' END AS split FROM n")
def split_last(spark, sf):
    return batches.split_last(ids(spark, sf), "id", 100)


@query("split_prefix", f"WITH {_IDS} SELECT id, CASE WHEN n < round(total * 0.8) THEN 'train' ELSE 'test' END AS split FROM n")
def split_prefix(spark, sf):
    return batches.split_prefix(ids(spark, sf), "id", 0.8)


@query("reduce_uniform", f"WITH {_IDS} SELECT id FROM n WHERE round(round(n / (total / {d(64)})) * (total / {d(64)})) = n AND round(n / (total / {d(64)})) < 64")
def reduce_uniform(spark, sf):
    return batches.reduce_uniform(ids(spark, sf), "id", 64)


@query("neighbor_anti", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT c_custkey * 10 + k FROM customer CROSS JOIN (SELECT unnest(range(-2, 3)) AS k))")
def neighbor_anti(spark, sf):
    """Orders that are near no customer at all."""
    others = spark.read.parquet(f"{sf}/customer.parquet").select((F.col("c_custkey") * 10).alias("id"))
    return batches.drop_near(ids(spark, sf), others, "id", 2)


@query("union_pixels", f"WITH {SQL['pixels']} SELECT pixel_id, px, NULL AS defocus FROM pixels UNION ALL SELECT pixel_id, py, px / 10 FROM pixels")
def union_pixels(spark, sf):
    p = view(spark, sf, "pixels")
    return batches.concatenate([p.select("pixel_id", "px"), p.select("pixel_id", F.col("py").alias("px"), (F.col("px") / 10).alias("defocus"))])


@query("image_ray_counts", f"WITH {SQL['pixels']} SELECT image_id, count(*) AS rays, count(DISTINCT camera_id) AS cameras FROM pixels GROUP BY 1")
def image_ray_counts(spark, sf):
    return view(spark, sf, "pixels").groupBy("image_id").agg(F.count(F.lit(1)).alias("rays"), F.countDistinct("camera_id").alias("cameras"))


_GRAD = f"g AS (SELECT node_id, CAST(floor(least(greatest((x + 1) * {d(31.5)}, 0), 63)) AS INT) AS ix, sum(y) AS gradient FROM points GROUP BY 1, 2)"
_LINE = f'line AS (SELECT image_id AS node_id, "row" * 8 + col AS ix, {_V} AS v FROM images)'


def gradient(spark, sf):
    cell = F.floor(F.least(F.greatest((F.col("x") + 1) * 31.5, F.lit(0.0)), F.lit(63.0))).cast("int")
    return view(spark, sf, "points").groupBy("node_id", cell.alias("ix")).agg(F.sum("y").alias("gradient"))


@query("sgd_step", f"WITH {SQL['points']}, {IM}, {_GRAD}, {_LINE} SELECT line.node_id, line.ix, round(v - 0.1 * coalesce(gradient, 0), 5) + {d(0)} AS v FROM line LEFT JOIN g ON line.node_id = g.node_id AND line.ix = g.ix")
def sgd_step(spark, sf):
    return fit.sgd_step(grids(spark, sf, "line"), gradient(spark, sf), ["node_id", "ix"], 0.1).select("node_id", "ix", (F.round("value", 5) + F.lit(0.0)).alias("v"))


@query("adam_step", f"WITH {SQL['points']}, {IM}, {_GRAD}, {_LINE}, a AS (SELECT line.node_id, line.ix, v, coalesce(gradient, 0) AS gr FROM line LEFT JOIN g ON line.node_id = g.node_id AND line.ix = g.ix) SELECT node_id, ix, round(v - 0.01 * ((0.1 * gr) / (1 - {d(0.9)})) / (sqrt(0.001 * gr * gr / (1 - {d(0.999)})) + 1e-8), 5) + {d(0)} AS v FROM a")
def adam_step(spark, sf):
    start = grids(spark, sf, "line").withColumn("m", F.lit(0.0)).withColumn("v", F.lit(0.0))
    return fit.adam_step(start, gradient(spark, sf), ["node_id", "ix"], 1).select("node_id", "ix", (F.round("value", 5) + F.lit(0.0)).alias("v"))


@query("rmsprop_step", f"WITH {SQL['points']}, {IM}, {_GRAD}, {_LINE}, a AS (SELECT line.node_id, line.ix, v, coalesce(gradient, 0) AS gr FROM line LEFT JOIN g ON line.node_id = g.node_id AND line.ix = g.ix) SELECT node_id, ix, round(v - 0.01 * gr / (sqrt(0.01 * gr * gr) + 1e-8), 5) + {d(0)} AS v FROM a")
def rmsprop_step(spark, sf):
    start = grids(spark, sf, "line").withColumn("v", F.lit(0.0))
    return fit.rmsprop_step(start, gradient(spark, sf), ["node_id", "ix"]).select("node_id", "ix", (F.round("value", 5) + F.lit(0.0)).alias("v"))


@query("gradient_correction", f"WITH {SQL['rays']} SELECT ray_id, {', '.join(rnd(f'o{a} - (ox * dx + oy * dy + oz * dz) * d{a}', f'g{a}') for a in 'xyz')} FROM rays")
def gradient_correction(spark, sf):
    g = fit.remove_along(tuple(F.col(f"o{a}") for a in "xyz"), tuple(F.col(f"d{a}") for a in "xyz"))
    return view(spark, sf, "rays").select("ray_id", *[r6(x).alias(f"g{a}") for x, a in zip(g, "xyz", strict=True)])


_TURNED = rot_sql("x", "y", "z")
_TORQUE = f"t AS (SELECT p.image_id, {', '.join(f'{r} AS t{a}' for a, r in zip('xyz', _TURNED, strict=True))}, gx, gy, gz FROM (SELECT point_id % 10 + 1 AS image_id, x, y, z, value / {d(100)} AS gx, x * {d(0.3)} AS gy, y - z AS gz FROM points) p JOIN poses ON p.image_id = poses.image_id), r AS (SELECT image_id, sum(ty * gz - tz * gy) AS rx, sum(tz * gx - tx * gz) AS ry, sum(tx * gy - ty * gx) AS rz FROM t GROUP BY 1)"


def pose_pull(spark, sf):
    """Gradients of the points' places after the turn of their image's pose, summed on the rotation group."""
    p = view(spark, sf, "points").select((F.col("point_id") % 10 + 1).alias("image_id"), "x", "y", "z", (F.col("value") / 100).alias("gx"), (F.col("x") * 0.3).alias("gy"), (F.col("y") - F.col("z")).alias("gz"))
    return camera.rotation_gradient(p, view(spark, sf, "poses"))


@query("rotation_gradient", f"WITH {SQL['points']}, {SQL['poses']}, {_TORQUE} SELECT image_id, {', '.join(rnd(f'r{a}', f'g{a}', 4) for a in 'xyz')} FROM r")
def rotation_gradient(spark, sf):
    """The gradient of each pose's rotation: the turned points' moments of their gradients."""
    return pose_pull(spark, sf).select("image_id", *[(F.round(f"r{a}", 4) + F.lit(0.0)).alias(f"g{a}") for a in "xyz"])


_STEP = [f"(r.r{a} * {d(-0.0001)})" for a in "xyz"]
_STEPN = "sqrt(" + " + ".join(f"{t} * {t}" for t in _STEP) + ")"
_HALF = [f"({t} * CASE WHEN {_STEPN} < 1e-8 THEN 0.5 ELSE sin({_STEPN} / 2) / {_STEPN} END)" for t in _STEP] + [f"cos({_STEPN} / 2)"]
_MUL = [f"{_HALF[3]} * qx + {_HALF[0]} * qw + {_HALF[1]} * qz - {_HALF[2]} * qy", f"{_HALF[3]} * qy - {_HALF[0]} * qz + {_HALF[1]} * qw + {_HALF[2]} * qx", f"{_HALF[3]} * qz + {_HALF[0]} * qy - {_HALF[1]} * qx + {_HALF[2]} * qw", f"{_HALF[3]} * qw - {_HALF[0]} * qx - {_HALF[1]} * qy - {_HALF[2]} * qz"]


@query("pose_step", f"WITH {SQL['points']}, {SQL['poses']}, {_TORQUE} SELECT poses.image_id, {', '.join(rnd(m, b) for m, b in zip(_MUL, camera.QUAT, strict=True))} FROM poses JOIN r ON poses.image_id = r.image_id")
def pose_step(spark, sf):
    """The poses that have points, one gradient step further on the rotation group."""
    g = pose_pull(spark, sf).select("image_id", *[(F.col(f"r{a}") * -0.0001).alias(f"r{a}") for a in "xyz"])
    moved = camera.apply_tangent(view(spark, sf, "poses"), g).join(g, "image_id", "left_semi")
    return moved.select("image_id", *[r6(F.col(c)).alias(c) for c in camera.QUAT])


@query("moment_update", f'WITH {IM} SELECT image_id, "row", col, round({_V} * {d(0.75)} + {d(0.25)} * ("row" + col) / 14, 6) + {d(0)} AS blended FROM images')
def moment_update(spark, sf):
    i = images(spark, sf)
    new = i.select("image_id", "row", "col", ((F.col("row") + F.col("col")) / 14).alias("value"))
    return evolve.blend_moments(i, new, ["image_id", "row", "col"], 4).select("image_id", "row", "col", r6(F.col("value")).alias("blended"))


@query("lattice", f"WITH {SQL['points']}, {tree_sql('leaf', DEPTH)}, used AS (SELECT {leaf_sql(DEPTH)} AS node_id, avg(value) AS v FROM points GROUP BY 1), g AS (SELECT leaf.*, v, unnest(range(64)) AS c FROM leaf JOIN used ON leaf.node_id = used.node_id) SELECT node_id, CAST(c AS INT) AS c, round(x0 + (c % 4) / {d(3)} * (x1 - x0), 6) + {d(0)} AS x, round(y0 + ((c // 4) % 4) / {d(3)} * (y1 - y0), 6) + {d(0)} AS y, round(z0 + (c // 16) / {d(3)} * (z1 - z0), 6) + {d(0)} AS z FROM g")
def lattice(spark, sf):
    used = view(spark, sf, "points").select(points.leaf_key(DEPTH).alias("node_id")).distinct()
    g = batches.lattice(tree.full_tree(spark, DEPTH).join(used.where("node_id is not null"), "node_id"), 4)
    return g.select("node_id", "c", *[r6(F.col(a)).alias(a) for a in "xyz"])


_MORTON = {a: " + ".join(f"(((node_id - 9) >> {3 * b + i}) & 1) * {1 << b}" for b in range(DEPTH)) for i, a in enumerate("xyz")}


@query("sampled_volume", f"WITH {SQL['points']}, v AS (SELECT {leaf_sql(DEPTH)} AS node_id, avg(value) AS v FROM points GROUP BY 1) SELECT {', '.join(f'CAST({m} AS INT) AS i{a}' for a, m in _MORTON.items())}, round(v, 5) AS v, node_id FROM v WHERE node_id IS NOT NULL")
def sampled_volume(spark, sf):
    """Mean values of the leaves as a voxel table; a leaf's cell follows from its Morton number."""
    from ..sources.arrays import volume

    v = view(spark, sf, "points").groupBy(points.leaf_key(DEPTH).alias("node_id")).agg(F.avg("value").alias("value")).where("node_id is not null")
    n = 1 << DEPTH
    cell = tree.cell_of(F.col("node_id") - tree.level_start(DEPTH), DEPTH)
    out = volume(v.withColumn("i", cell["x"] + n * cell["y"] + n * n * cell["z"]).withColumn("valid", F.lit(True)), (n, n, n))
    return out.select("ix", "iy", "iz", F.round("value", 5).alias("v"), "node_id")


def layer_sql(k: int, layer, source: str) -> str:
    """Outputs of linear layer ``k`` over (vec_id, i, x): CTE l<k> with vec_id, i and x, its weights as a table."""
    w, bias = layer
    rows = ", ".join(f"({i}, {j}, {d(repr(float(w[i, j])))})" for i in range(w.shape[0]) for j in range(w.shape[1]))
    return f"w{k}(i, j, w) AS (VALUES {rows}), l{k} AS (SELECT vec_id, j AS i, sum(x * w) + {d(float(bias[0]))} AS x FROM {source} s JOIN w{k} ON s.i = w{k}.i GROUP BY 1, 2)"


_NET, _NET3 = fit.init_network([64, 16, 1], 7), fit.init_network([64, 16, 3], 11)
_INPUT = "e AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)"


@query("network_decode", f"WITH {_INPUT}, {layer_sql(0, _NET[0], 'e')}, h AS (SELECT vec_id, i, greatest(x, 0) AS x FROM l0), {layer_sql(1, _NET[1], 'h')} SELECT vec_id, round(x, 6) + {d(0)} AS density FROM l1")
def network_decode(spark, sf):
    """A small network over whole images, in Arrow batches."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    return e.select("vec_id", r6(fit.decode(F.col("embedding"), _NET)).alias("density"))


@query("network_channels", f"WITH {_INPUT}, {layer_sql(0, _NET3[0], 'e')}, h AS (SELECT vec_id, i, sin(x) AS x FROM l0), {layer_sql(1, _NET3[1], 'h')} SELECT vec_id, {', '.join(f'round(max(CASE WHEN i = {k} THEN 1 / (1 + exp(-x)) END), 6) + {d(0)} AS c{k}' for k in range(3))} FROM l1 GROUP BY 1")
def network_channels(spark, sf):
    """Three outputs of a network with a sine between layers and a sigmoid at the end."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    out = e.select("vec_id", fit.decode_channels(F.col("embedding"), _NET3, "sin", "sigmoid").alias("c"))
    return out.select("vec_id", *[r6(F.col("c")[k]).alias(f"c{k}") for k in range(3)])


_W, _B = _NET[0]
_V1, _C1 = _NET[1]
_WEIGHTS = ", ".join(f"({j}, {d(repr(float(_V1[j, 0])))})" for j in range(16))


@query("network_gradient", f"WITH {_INPUT}, {layer_sql(0, _NET[0], 'e')}, h AS (SELECT vec_id, i, greatest(x, 0) AS x, CASE WHEN x > 0 THEN 1 ELSE 0 END AS on_ FROM l0), {layer_sql(1, _NET[1], 'h')}, g AS (SELECT l1.vec_id, 2 * (x - label / {d(10)}) / (SELECT count(*) FROM embeddings) AS g, power(x - label / {d(10)}, 2) / (SELECT count(*) FROM embeddings) AS loss FROM l1 JOIN embeddings ON l1.vec_id = embeddings.vec_id), v(j, w) AS (VALUES {_WEIGHTS}), into_ AS (SELECT h.vec_id, h.i AS j, g * w * on_ AS g FROM h JOIN g ON h.vec_id = g.vec_id JOIN v ON h.i = v.j), out_ AS (SELECT -1 AS part, sum(loss) AS v FROM g UNION ALL SELECT e.i * 16 + j, sum(x * g) FROM e JOIN into_ ON e.vec_id = into_.vec_id GROUP BY 1 UNION ALL SELECT 1024 + j, sum(g) FROM into_ GROUP BY 1 UNION ALL SELECT 1040 + h.i, sum(h.x * g) FROM h JOIN g ON h.vec_id = g.vec_id GROUP BY 1 UNION ALL SELECT 1056, sum(g) FROM g) SELECT CAST(part AS BIGINT) AS part, round(v, 6) + {d(0)} AS v FROM out_")
def network_gradient(spark, sf):
    """Loss and gradient of a network of 64, 16 and 1 over all images, whose target is their label."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("embedding", (F.col("label") / 10.0).alias("target"))
    return fit.network_gradient(e, _NET, "embedding").select("part", r6(F.col("value")).alias("v"))


_TURN = '2 * pi() * (a.u * "row" + b.u * col) / 8'


@query("radial_spectrum", f'WITH {IM}, k AS (SELECT unnest(range(8)) AS u), f AS (SELECT image_id, a.u AS u, b.u AS v, sum("value" * cos({_TURN})) AS re, sum("value" * sin({_TURN})) AS im FROM images CROSS JOIN k a CROSS JOIN k b GROUP BY 1, 2, 3), m AS (SELECT image_id, CAST(round(sqrt(power((u + 4) % 8 - 4, 2) + power((v + 4) % 8 - 4, 2))) AS INT) AS radius, sqrt(re * re + im * im) / 64 AS magnitude FROM f) SELECT image_id, radius, round(avg(magnitude), 6) + {d(0)} AS magnitude FROM m GROUP BY 1, 2')
def radial_spectrum(spark, sf):
    return spectral.radial_spectrum(images(spark, sf)).select("image_id", "radius", r6(F.col("magnitude")).alias("magnitude"))


@query("random_batch", f"WITH {SQL['pixels']} SELECT pixel_id, CAST(floor({uniform_sql(3, "'image'", 'pixel_id')} * 10) AS BIGINT) + 1 AS image_id, {uniform_sql(3, "'u'", 'pixel_id')} AS u, {uniform_sql(3, "'v'", 'pixel_id')} AS v FROM pixels WHERE {uniform_sql(3, "'draw'", 'pixel_id')} < 0.1")
def random_batch(spark, sf):
    """A sampling operator: about a tenth of the pixels by a seed and their ids."""
    return batches.random_batch(view(spark, sf, "pixels"), 10, 0.1, 3).select("pixel_id", "image_id", "u", "v")


@query("random_in_nodes", f"WITH {SQL['points']}, {tree_sql('leaf', DEPTH)}, used AS (SELECT DISTINCT {leaf_sql(DEPTH)} AS node_id FROM points), g AS (SELECT leaf.*, unnest(range(1, 17)) AS k FROM leaf JOIN used ON leaf.node_id = used.node_id) SELECT node_id, CAST(k AS INT) AS k, {', '.join(rnd(f'{a}0 + {uniform_sql(5, repr(a), 'node_id', 'k')} * ({a}1 - {a}0)', a) for a in 'xyz')} FROM g")
def random_in_nodes(spark, sf):
    used = view(spark, sf, "points").select(points.leaf_key(DEPTH).alias("node_id")).distinct()
    out = batches.random_in_nodes(tree.full_tree(spark, DEPTH).join(used, "node_id"), 16, 5)
    return out.select("node_id", "k", *[r6(F.col(a)).alias(a) for a in "xyz"])


@query("explicit_grid", f"WITH {SQL['points']}, {IM}, {_LINE} SELECT point_id, ix, round(v * {d(2)} + {d(0.5)}, 6) AS feature FROM points JOIN line ON points.node_id = line.node_id")
def explicit_grid(spark, sf):
    """All features of a point's node, with the affine bias of that node."""
    g = grids(spark, sf, "line").select("node_id", "ix", F.col("value").alias("v"))
    return view(spark, sf, "points").join(g, "node_id").select("point_id", "ix", r6(F.col("v") * 2 + 0.5).alias("feature"))

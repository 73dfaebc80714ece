"""Active nodes of mixed levels, reverse passes against finite differences, random numbers by key, and visibility."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellbeam.functions.columns import activation, activation_slope, keyed_normal, keyed_uniform
from cellbeam.operators import active, batches, camera, fit, interp, points, rays, tree, volumes
from cellbeam.sources.tables import settled

AXES = "xyz"
RAYS = "ray_id long, ox double, oy double, oz double, dx double, dy double, dz double"


def random_tree(rng, depth, fan=8, share=0.5, gaps=0.1):
    """Active ids of a random tree, some of whose leaves are missing."""
    out, todo = [], [(0, 0)]
    while todo:
        k, m = todo.pop()
        if k < depth and (k == 0 or rng.random() < share):
            todo += [(k + 1, m * fan + i) for i in range(fan)]
        elif rng.random() >= gaps:
            out.append(tree.level_start(k, fan) + m)
    return out


def box(node, depth, quad=False, y=(-1.0, 1.0)):
    fan, axes = (4, "xz") if quad else (8, "xyz")
    k = max(j for j in range(depth + 1) if node >= tree.level_start(j, fan))
    m, w = node - tree.level_start(k, fan), 2.0 / (1 << k)
    cell = {a: sum((m >> (len(axes) * b + i) & 1) << b for b in range(k)) for i, a in enumerate(axes)}
    return [y if a not in cell else (cell[a] * w - 1, (cell[a] + 1) * w - 1) for a in AXES]


def slab_hit(o, d, b):
    t0, t1 = -1e30, 1e30
    for p, v, (lo, hi) in zip(o, d, b, strict=True):
        if v == 0:
            if not lo <= p < hi:
                return None
        else:
            x, y = sorted(((lo - p) / v, (hi - p) / v))
            t0, t1 = max(t0, x), min(t1, y)
    return (t0, t1) if t1 - t0 >= 1e-5 and t1 >= 0 else None


@pytest.mark.parametrize("quad", [False, True])
def test_rays_meet_active_nodes_of_all_levels(spark, quad):
    rng = np.random.default_rng(2)
    y = (-0.4, 0.7) if quad else (-1.0, 1.0)
    ids = random_tree(rng, 3, 4 if quad else 8)
    o = rng.uniform(-1.4, 1.4, (60, 3))
    d = rng.normal(size=(60, 3))
    d[:12] = np.eye(3)[rng.integers(0, 3, 12)] * rng.choice([-1, 1], (12, 1))
    o[:6] = np.round(o[:6] * 4) / 4  # along planes, and through corners
    o[6:9], d[6:9] = -1.5, 1.0
    d /= np.linalg.norm(d, axis=1)[:, None]
    nodes = spark.createDataFrame([(i,) for i in ids], "node_id long")
    frame = spark.createDataFrame([(k, *map(float, (*o[k], *d[k]))) for k in range(60)], RAYS)
    want = {(k, i): h for k in range(60) for i in ids if (h := slab_hit(o[k], d[k], box(i, 3, quad, y)))}
    results = []
    for limit in (10**6, 0):
        active.BROADCAST_NODES, held = limit, active.BROADCAST_NODES
        hits = active.ray_active_hits(frame, nodes, 3, quad, y).collect()
        active.BROADCAST_NODES = held
        got = {(r["ray_id"], r["node_id"]): (r["tmin"], r["tmax"]) for r in hits}
        assert len(got) == len(hits) and got.keys() == want.keys() and len(got) > 40
        assert all(np.allclose(got[k], want[k], atol=1e-12) for k in want)
        results.append(sorted(map(tuple, hits)))
    assert results[0] == results[1]


def test_boxes_and_samples_follow_from_ids(spark):
    rng = np.random.default_rng(3)
    ids = random_tree(rng, 3)
    at = active.node_box(F.col("node_id"), 3)
    rows = spark.createDataFrame([(i,) for i in ids], "node_id long").select("node_id", *[c.alias(a) for a, c in at.items()], active.node_diagonal(F.col("node_id"), 3).alias("g")).collect()
    for r in rows:
        b = box(r["node_id"], 3)
        assert [r[f"{a}{k}"] for a in AXES for k in (0, 1)] == [x for side in b for x in side] and np.isclose(r["g"], 3**0.5 * (b[0][1] - b[0][0]))
    hits = spark.createDataFrame([(1, -2.0, 0.1, 0.1, 1.0, 0.0, 0.0, 3, 1.0, 2.0), (1, -2.0, 0.1, 0.1, 1.0, 0.0, 0.0, 100, 2.0, 2.25)], RAYS + ", node_id long, tmin double, tmax double")
    jitter = lambda j: keyed_uniform(5, F.col("ray_id"), F.col("node_id"), j)
    for way in (None, jitter):
        s = active.ray_active_samples(hits, 3, 16, way).collect()
        for node, length, n in ((3, 1.0, int(np.ceil(1 / (3**0.5) * 16))), (100, 0.25, int(np.ceil(0.25 / (3**0.5 / 4) * 16)))):
            mine = sorted((r["j"], r["t"], r["weight"]) for r in s if r["node_id"] == node)
            assert len(mine) == n and np.isclose(sum(m[2] for m in mine), length) and all(m[2] > 0 for m in mine)
            lo = {3: 1.0, 100: 2.0}[node]
            assert all(lo + j * length / n <= t <= lo + (j + 1) * length / n for j, t, _ in mine)


def test_locate_beyond_the_broadcast_limit(spark, monkeypatch):
    rng = np.random.default_rng(4)
    nodes = spark.createDataFrame([(i,) for i in random_tree(rng, 3)], "node_id long")
    p = spark.createDataFrame([(k, *map(float, rng.uniform(-1.2, 1.2, 3))) for k in range(300)] + [(300, None, 0.0, 0.0)], "point_id long, x double, y double, z double")
    few = sorted(map(tuple, points.locate(p, nodes, 3).select("point_id", "active_node").collect()))
    monkeypatch.setattr(points, "BROADCAST_NODES", 0)
    assert few == sorted(map(tuple, points.locate(p, nodes, 3).select("point_id", "active_node").collect())) and len({n for _, n in few}) > 10


# ---- random numbers


def test_keyed_numbers(spark):
    rows = spark.range(4000).select("id", keyed_uniform(1, F.col("id")).alias("u"), keyed_uniform(2, F.col("id")).alias("w"), keyed_normal(1, F.col("id")).alias("g"))
    a, b = sorted(map(tuple, rows.collect())), sorted(map(tuple, rows.repartition(7).collect()))
    u, w, g = (np.array([r[k] for r in a]) for k in (1, 2, 3))
    assert a == b and 0 <= u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.02 and abs(u.std() - 12**-0.5) < 0.01
    assert abs(np.corrcoef(u, w)[0, 1]) < 0.05 and abs(np.corrcoef(u[1:], u[:-1])[0, 1]) < 0.05 and abs(g.mean()) < 0.06 and abs(g.std() - 1) < 0.05


def test_draws_do_not_follow_the_partitioning(spark):
    pixels = spark.range(3000).select(F.col("id").alias("pixel_id"))
    scenes = spark.createDataFrame([(s, 10 * s + k) for s in range(4) for k in range(5)], "scene_id long, image_id long")
    leaf = tree.full_tree(spark, 2).where("depth = 2")
    ray = spark.range(300).select(F.col("id").alias("ray_id"), *[F.lit(0.5).alias(f"o{a}") for a in AXES], F.lit(4.0).alias("defocus"))
    pose = spark.range(300).select(F.col("id").alias("image_id"), *[F.lit(1.0).alias(f"t{a}") for a in AXES])
    for rows, draw in (
        (pixels, lambda x: batches.random_batch(x, 6, 0.3, 7)),
        (pixels, lambda x: batches.random_scene_batch(x, scenes, 0.3, 7)),
        (leaf, lambda x: batches.random_in_nodes(x, 5, 2)),
        (ray, lambda x: camera.defocused(x, 100, 3.0, 5)),
        (pose, lambda x: camera.jitter(x, 0.3, 5)),
    ):
        one, other = (sorted(map(tuple, draw(x).collect())) for x in (rows.coalesce(1), rows.repartition(9)))
        assert one == other and len(one) > 100


# ---- ranges and grids


def test_bisect(spark):
    cuts = [-3.0, 0.0, 0.5, 2.0, 2.5, 7.0, 9.0]
    for n in range(len(cuts) + 1):
        x = spark.createDataFrame([(v,) for v in [-9.0, -3.0, -1.0, 0.0, 0.4, 0.5, 2.2, 7.0, 8.0, 9.0, 99.0]], "x double")
        assert all(r["at"] == sum(c <= r["x"] for c in cuts[:n]) for r in x.select("x", batches.bisect(cuts[:n], F.col("x")).alias("at")).collect())


def test_sparse_grids_are_filled(spark):
    rng = np.random.default_rng(5)
    size = {"z": 3, "y": 4, "x": 5}
    full = rng.normal(size=(4, 60))
    known = np.array([rng.random(60) < share for share in (1.0, 0.5, 0.05, 0.9)])
    known[2, 7] = True
    cells = [(g, k // 20, k // 5 % 4, k % 5, float(full[g, k])) for g in range(4) for k in range(60) if known[g, k]]
    rows = interp.gather_cells(spark.createDataFrame(cells, "node_id long, iz int, iy int, ix int, value double"), size).collect()
    assert len(rows) == 4 and all(r["__value"] == [float(v) if ok else None for v, ok in zip(full[r["node_id"]], known[r["node_id"]], strict=True)] for r in rows)


def test_a_large_sparse_grid_takes_no_square_time(spark):
    import time

    n = 24**3
    cells = spark.range(n).where("id <> 777").select(F.lit(1).cast("long").alias("node_id"), F.floor(F.col("id") / 576).cast("int").alias("iz"), (F.floor(F.col("id") / 24) % 24).cast("int").alias("iy"), (F.col("id") % 24).cast("int").alias("ix"), F.col("id").cast("double").alias("value"))
    start = time.perf_counter()
    row = interp.gather_cells(cells, {"z": 24, "y": 24, "x": 24}).first()["__value"]
    assert len(row) == n and row[777] is None and row[778] == 778.0 and time.perf_counter() - start < 10


# ---- reverse passes


def test_slopes_of_activations(spark):
    x = [-2.1, -0.3, 0.4, 1.7, 25.0]
    frame = spark.createDataFrame([(v,) for v in x], "x double")
    for kind in fit.ACTIVATIONS:
        h = 1e-6
        r = frame.select(activation_slope(F.col("x"), kind).alias("s"), ((activation(F.col("x") + h, kind) - activation(F.col("x") - h, kind)) / (2 * h)).alias("d")).collect()
        assert all(abs(a["s"] - a["d"]) < 1e-5 for a in r)
        assert np.allclose(fit.SLOPES[kind](np.array(x)), [a["s"] for a in r])


def test_slopes_of_look_ups(spark):
    rng = np.random.default_rng(6)
    grid = spark.createDataFrame([(1, z, y, x, float(rng.normal())) for z in range(3) for y in range(3) for x in range(4)], "node_id long, iz int, iy int, ix int, value double")
    size = {"z": 3, "y": 3, "x": 4}
    at = rng.uniform(0.1, 1.9, (40, 3))
    at = np.floor(at) + np.clip(at - np.floor(at), 0.01, 0.99)
    h = 1e-5
    moved = [(k, s, a, *map(float, at[k] + s * h * np.eye(3)[a])) for k in range(40) for a in range(3) for s in (-1, 1)]
    coords = {a: F.col(a) for a in "zyx"}
    p = spark.createDataFrame([(10 * (10 * k + a) + s, 1, z, y, x) for k, s, a, z, y, x in moved], "point_id long, node_id long, z double, y double, x double")
    value = {r["point_id"]: r["value"] for r in interp.sample_grid(p, grid, coords, size).collect()}
    still = spark.createDataFrame([(k, 1, *map(float, at[k])) for k in range(40)], "point_id long, node_id long, z double, y double, x double")
    for r in interp.grid_slopes(still, grid, coords, size).collect():
        for a, name in enumerate("zyx"):
            base = 10 * (10 * r["point_id"] + a)
            assert abs(r[f"d{name}"] - (value[base + 1] - value[base - 1]) / (2 * h)) < 1e-6
    table = spark.createDataFrame([(i, float(rng.normal())) for i in range(64)], "slot long, value double")
    spot = rng.uniform(0.05, 0.9, (30, 3))
    enc = lambda rows, **kw: {(r["point_id"], r["level"]): r["feature"] for r in interp.hash_encode(spark.createDataFrame(rows, "point_id long, u double, v double, w double"), table, 2, 4, 1.0, 64, **kw).collect()}
    step = 1e-7
    up, down = ([(k, float(s[0]), float(s[1] + d), float(s[2])) for k, s in enumerate(spot)] for d in (step, -step))
    a, b, slope = enc(up), enc(down), enc([(k, *map(float, s)) for k, s in enumerate(spot)], along="v")
    assert all(abs(slope[k] - (a[k] - b[k]) / (2 * step)) < 1e-4 for k in slope)


def scene(spark, rng):
    """Rays, an adaptive tree and grids of size 3 in its nodes."""
    nodes = spark.createDataFrame([(i,) for i in range(1, 9) if i != 3] + [(tree.level_start(2) + 16 + i,) for i in range(8)], "node_id long")
    o = np.stack([np.full(30, -1.5), rng.uniform(-0.8, 0.8, 30), rng.uniform(-0.8, 0.8, 30)], 1)
    d = np.stack([np.ones(30), rng.uniform(-0.2, 0.2, 30), rng.uniform(-0.2, 0.2, 30)], 1)
    d /= np.linalg.norm(d, axis=1)[:, None]
    frame = spark.createDataFrame([(k, *map(float, (*o[k], *d[k])), float(rng.uniform(0.5, 2))) for k in range(30)], RAYS + ", target double")
    ids = [r[0] for r in nodes.collect()]
    grid = spark.createDataFrame([(i, z, y, x, float(rng.normal())) for i in ids for z in range(3) for y in range(3) for x in range(3)], "node_id long, iz int, iy int, ix int, value double")
    samples = settled(active.ray_active_samples(active.ray_active_hits(frame, nodes, 2), 2, 6))
    return frame, samples, settled(grid)


def loss_of(frame, samples, grid):
    out = volumes.render(frame, samples, grid, 2, 3, mixed=True)
    return out.join(frame.select("ray_id", "target"), "ray_id").agg(F.avg(F.pow(F.col("integral") - F.col("target"), 2))).first()[0]


def test_gradient_of_rendering(spark):
    frame, samples, grid = scene(spark, np.random.default_rng(8))
    back = volumes.residuals(volumes.render(frame, samples, grid, 2, 3, mixed=True), frame)
    got = volumes.render_gradient(back, samples, grid, 2, 3, mixed=True).collect()
    largest = sorted(got, key=lambda r: -abs(r["gradient"]))[:4]
    for r in largest:
        at = " and ".join(f"{c} = {r[c]}" for c in ("node_id", "iz", "iy", "ix"))
        up, down = (loss_of(frame, samples, grid.withColumn("value", F.when(F.expr(at), F.col("value") + h).otherwise(F.col("value")))) for h in (1e-4, -1e-4))
        assert abs(r["gradient"] - (up - down) / 2e-4) < 1e-6 * max(1, abs(r["gradient"]))


def test_a_loop_of_rendering_and_steps_lowers_the_loss(spark):
    frame, samples, grid = scene(spark, np.random.default_rng(9))
    keys = ["node_id", "iz", "iy", "ix"]
    grid = grid.withColumns({"m": F.lit(0.0), "v": F.lit(0.0)})
    losses = []
    for step in (1, 2, 3):
        here = grid.select(*keys, "value")
        losses.append(loss_of(frame, samples, here))
        back = volumes.residuals(volumes.render(frame, samples, here, 2, 3, mixed=True), frame)
        grid = settled(fit.adam_step(grid, volumes.render_gradient(back, samples, here, 2, 3, mixed=True), keys, step, 0.05))
    losses.append(loss_of(frame, samples, grid.select(*keys, "value")))
    assert losses == sorted(losses, reverse=True) and losses[3] < 0.9 * losses[0]


def test_gradient_on_the_rotation_group(spark):
    rng = np.random.default_rng(10)
    q = rng.normal(size=(3, 4))
    q /= np.linalg.norm(q, axis=1)[:, None]
    poses = spark.createDataFrame([(i, *map(float, q[i]), 0.1, 0.2, 0.3) for i in range(3)], "image_id long, qx double, qy double, qz double, qw double, tx double, ty double, tz double")
    aim = {k: rng.normal(size=3) for k in range(60)}
    p = spark.createDataFrame([(k, k % 3, *map(float, rng.normal(size=3)), *map(float, aim[k])) for k in range(60)], "point_id long, image_id long, x double, y double, z double, ax double, ay double, az double")

    def loss(at):
        turned = camera.rotate_points(p, at)
        return {r["image_id"]: r["s"] for r in turned.groupBy("image_id").agg(F.sum(sum((F.pow(F.col(a) - F.col(f"a{a}"), 2) for a in AXES), F.lit(0.0))).alias("s")).collect()}

    turned = camera.rotate_points(p, poses).select("point_id", *[(2 * (F.col(a) - F.col(f"a{a}"))).alias(f"g{a}") for a in AXES])
    got = {r["image_id"]: [r["rx"], r["ry"], r["rz"]] for r in camera.rotation_gradient(p.join(turned, "point_id"), poses).collect()}
    h = 1e-5
    for k in range(3):
        ends = []
        for s in (h, -h):
            t = spark.createDataFrame([(i, *[s if j == k else 0.0 for j in range(3)]) for i in range(3)], "image_id long, rx double, ry double, rz double")
            ends.append(loss(camera.apply_tangent(poses, t)))
        assert all(abs(got[i][k] - (ends[0][i] - ends[1][i]) / (2 * h)) < 1e-5 for i in range(3))
    step = spark.createDataFrame([(i, *[-0.002 * g for g in got[i]]) for i in range(3)], "image_id long, rx double, ry double, rz double")
    before, behind = loss(poses), loss(camera.apply_tangent(poses, step))
    assert all(behind[i] < before[i] for i in range(3))


def test_networks_are_fitted(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(400, 3))
    y = np.sin(x[:, 0]) + x[:, 1] * 0.5
    rows = spark.createDataFrame([(x[k].tolist(), float(y[k])) for k in range(400)] + [(None, 1.0), ([1.0, 1.0, 1.0], None)], "features array<double>, target double").repartition(5)
    for kind, last in (("relu", "id"), ("softplus", "sigmoid"), ("sin", "leaky_relu")):
        net = fit.init_network([3, 6, 1], 3)
        loss, g = fit.back_propagate(x, y, net, kind, last)
        got = {r["part"]: r["value"] for r in fit.network_gradient(rows, net, kind=kind, last=last).collect()}
        assert np.isclose(got[-1], loss / 400) and np.allclose([got[k] for k in range(len(g))], g / 400)
        flat = np.concatenate([v for w, b in net for v in (w.ravel(), b)])
        for k in rng.integers(0, len(flat), 6):
            ends = [fit.back_propagate(x, y, fit.unflatten(flat + s * 1e-6 * np.eye(len(flat))[k], net), kind, last)[0] for s in (1, -1)]
            assert abs(g[k] - (ends[0] - ends[1]) / 2e-6) < 1e-2
    _, losses = fit.fit_network(rows, fit.init_network([3, 6, 1], 3), 6, 0.05, kind="softplus")
    assert losses[-1] < 0.7 * losses[0] and len(losses) == 6
    assert fit.network_gradient(rows.where("false"), fit.init_network([3, 6, 1], 3)).count() == 0


# ---- visibility


@pytest.mark.parametrize("depth", [0, 2, 4])
def test_visible_is_every_point_against_every_pose(spark, depth):
    rng = np.random.default_rng(12)
    q = rng.normal(size=(25, 4))
    q /= np.linalg.norm(q, axis=1)[:, None]
    t = rng.uniform(-2, 2, (25, 3))
    p = rng.uniform(-1, 1, (300, 3)) * [1, 0.2, 3]
    cam = {"fx": 200, "fy": 180, "cx": 150, "cy": 120, "w": 300, "h": 240}
    want = {}
    for k in range(300):
        for (a, b, c, w), s in zip(q, t, strict=True):
            v = np.array([-a, -b, -c])
            x = p[k] - s
            u = 2 * np.cross(v, x)
            x = x + w * u + np.cross(v, u)
            i, j = np.floor(x[0] / x[2] * 200 + 150 + 0.5), np.floor(x[1] / x[2] * 180 + 120 + 0.5)
            if 0 <= i < 300 and 0 <= j < 240:
                want[k] = want.get(k, 0) + 1
    frame = spark.createDataFrame([(k, *map(float, p[k])) for k in range(300)] + [(900, None, 0.0, 0.0)], "point_id long, x double, y double, z double")
    poses = spark.createDataFrame([(k, *map(float, (*q[k], *t[k]))) for k in range(25)], "image_id long, qx double, qy double, qz double, qw double, tx double, ty double, tz double")
    assert {r["point_id"]: r["images"] for r in camera.visible(frame, poses, cam, depth=depth).collect()} == want and len(want) > 100
    assert camera.visible(frame.where("false"), poses, cam).count() == 0 and camera.visible(frame, poses.where("false"), cam).count() == 0


# ---- faces, windows, plans


def test_faces_meet_nodes_of_other_levels(spark):
    rng = np.random.default_rng(13)
    ids = random_tree(rng, 3, share=0.6)
    nodes = spark.createDataFrame([(i,) for i in ids], "node_id long")
    boxes = {i: box(i, 3) for i in ids}
    n, eps = 3, 1e-3
    want = set()
    for i, b in boxes.items():
        for a in range(3):
            for front in (0, 1):
                for k in range(n * n):
                    p = [0.0] * 3
                    p[a] = b[a][front]
                    for axis, share in (((a + 1) % 3, k % n / 2), ((a + 2) % 3, k // n / 2)):
                        p[axis] = b[axis][0] + share * (b[axis][1] - b[axis][0])
                    p[a] += eps if front else -eps
                    # on shared sides the lower box holds the place, at -1 the first one
                    inside = [j for j, c in boxes.items() if all((lo < x <= hi) or (x == lo == -1.0) for x, (lo, hi) in zip(p, c, strict=True))]
                    if inside and inside[0] != i:
                        want.add((i, AXES[a], front, k, inside[0]))
    out = active.active_faces(nodes, 3, n, eps).collect()
    sides = {}
    for r in out:
        sides.setdefault((r["owner"], r["axis"], r["front"], r["k"]), {})[r["side"]] = r["node_id"]
    assert {(*k, v[1]) for k, v in sides.items()} == want and all(v[0] == k[0] for k, v in sides.items()) and len(out) == 2 * len(want) > 1000
    level = lambda i: sum(i >= tree.level_start(k) for k in (1, 2, 3))
    assert len({(level(i), level(j)) for i, _, _, _, j in want}) > 3


@pytest.mark.parametrize("tile", [4, 128])
def test_windows_over_tiles(spark, monkeypatch, tile):
    """Sparse images of several sizes; tiles smaller than the images and larger."""
    from cellbeam.operators import metrics, windows

    monkeypatch.setitem(windows.TILE, 2, tile)
    rng = np.random.default_rng(14)
    rows, seen = [], {}
    for i, (h, w) in enumerate([(1, 1), (7, 11), (13, 3)]):
        for r in range(h):
            for c in range(w):
                if rng.random() < 0.9 or (h, w) == (1, 1):
                    seen[i, r, c] = (float(rng.random()), float(rng.random()))
                    rows.append((f"im{i}", r, c, *seen[i, r, c]))
    frame = spark.createDataFrame([*rows, ("im1", None, 2, 1.0, 1.0), ("im9", 0, 0, None, 1.0)], "image_id string, row int, col int, value double, b double")
    kernel = [[0.5, 0.0, -1.0, 2.0, 0.0], [1.0, -4.0, 1.0, 0.0, 3.0], [0.0, 0.0, 0.25, 0.0, 1.0]]
    want = {(f"im{i}", r, c): sum(kernel[u][v] * seen.get((i, r + u - 1, c + v - 2), (0, 0))[0] for u in range(3) for v in range(5)) for i, r, c in seen}
    got = {(x["image_id"], x["row"], x["col"]): x["value"] for x in interp.convolve(frame.drop("b").where("value is not null"), kernel).collect()}
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in want)
    for reach in (1, 3):
        scores = {}
        for i, r, c in seen:
            near = np.array([v for (j, y, x), v in seen.items() if j == i and abs(y - r) <= reach and abs(x - c) <= reach])
            (ma, mb), (aa, bb), ab = near.mean(0), (near**2).mean(0), (near[:, 0] * near[:, 1]).mean()
            scores.setdefault(f"im{i}", []).append(((2 * ma * mb + 1e-4) * (2 * (ab - ma * mb) + 9e-4)) / ((ma * ma + mb * mb + 1e-4) * (aa - ma * ma + bb - mb * mb + 9e-4)))
        out = {x["image_id"]: x["ssim"] for x in metrics.ssim(frame, "value", "b", reach).collect()}
        assert out.keys() == scores.keys() and all(np.isclose(out[k], np.mean(v)) for k, v in scores.items())


def test_saved_errors_and_region_in_plans(spark):
    from cellbeam.operators import evolve

    nodes = tree.full_tree(spark, 2).withColumn("active", F.col("depth") == 1).withColumn("culled", F.col("node_id") == 9).withColumn("leaf", F.col("depth") == 2)
    nodes = nodes.withColumn("error", F.when(F.col("depth") == 1, 2.0).when(F.col("parent_id") == 1, 0.1 * F.col("node_id")).otherwise(0.0)).withColumn("max_density", F.when(F.col("depth") == 2, 0.5).otherwise(3.0))
    rows = {r["node_id"]: r for r in evolve.family_options(nodes, saved=True).collect()}
    assert np.isclose(rows[1]["split_value"], sum(0.05 * i for i in range(9, 17))) and rows[1]["split_cost"] == 7
    assert all(np.isclose(rows[i]["split_value"], 0.75 * 6) and rows[i]["split_cost"] == 8 for i in range(2, 9))
    assert all(np.isclose(r["split_value"], 0.75 * 6) for r in evolve.family_options(nodes).collect())
    some = {r["node_id"]: r["split_value"] for r in evolve.family_options(nodes, roi=((-1.2, -1.2, -1.2), (-0.1, -0.1, -0.1))).collect()}
    # lower + upper counts as a node's middle, so the first node touches the region and the last does not
    assert some[8] is None and some[1] is not None


def test_a_pyramid_adds_up(spark):
    rng = np.random.default_rng(15)
    rows = [(i, r, c, float(rng.normal())) for i, (h, w) in enumerate([(8, 8), (5, 7), (1, 3)]) for r in range(h) for c in range(w)]
    frame = spark.createDataFrame(rows, "image_id long, row int, col int, value double")
    got = {(r["image_id"], r["level"], r["row"], r["col"]): r["value"] for r in interp.laplacian_pyramid(frame, 3).collect()}
    assert all(np.isclose(v, sum(got[i, k, r >> k, c >> k] for k in range(4))) for i, r, c, v in rows)
    assert {k[1] for k in got} == {0, 1, 2, 3} and sum(k[1] == 3 for k in got) == 3

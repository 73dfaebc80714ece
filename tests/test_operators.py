"""Invariants, edge cases and differential tests of the grid operators."""

import itertools

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cellbeam.functions.columns import activation, finite
from cellbeam.operators import camera, evolve, fit, interp, metrics, points, rays, spectral, tree
from cellbeam.sources import arrays, scene, tables

RAYS = "ray_id long, ox double, oy double, oz double, dx double, dy double, dz double"


def test_leaves_tile_the_root(spark):
    leaf = tree.full_tree(spark, 3).where("depth = 3").selectExpr("sum((x1-x0)*(y1-y0)*(z1-z0)) v", "count(*) n").first()
    assert leaf["n"] == 512 and abs(leaf["v"] - 8) < 1e-9
    assert tree.full_tree(spark, 0).first()["scale"] == 0.0


def test_quad_never_splits_y(spark):
    r = tree.full_tree(spark, 2, True, (-0.2, 0.3)).selectExpr("min(y0)", "max(y0)", "min(y1)", "max(y1)").first()
    assert tuple(r) == (-0.2, -0.2, 0.3, 0.3)


def test_ray_edges(spark):
    rows = [
        (1, -2.0, -1.0, 0.5, 1.0, 0.0, 0.0),  # on the lower side: inside (half open)
        (2, -2.0, 1.0, 0.5, 1.0, 0.0, 0.0),  # on the upper side: outside
        (3, 0.5, 0.5, 0.5, 1.0, 0.0, 0.0),  # starts inside: negative entry
        (4, 2.0, 0.5, 0.5, 1.0, 0.0, 0.0),  # wholly behind
    ]
    h = {r["ray_id"]: r for r in rays.ray_node_hits(spark.createDataFrame(rows, RAYS), 0).collect()}
    assert set(h) == {1, 3} and h[3]["tmin"] < 0 and h[1]["tmax"] - h[1]["tmin"] == 2


def test_descent_equals_theta_join(spark, sf_dir):
    from cellbeam.functions.columns import slab
    from cellbeam.plans.scenes import view

    r = view(spark, sf_dir, "rays").select(*rays.RAY)
    a = rays.ray_node_hits(r, 2).select("ray_id", "node_id")
    tmin, tmax, hit = slab()
    b = r.crossJoin(tree.full_tree(spark, 2).where("depth = 2")).where(hit & (tmax - tmin >= 1e-5)).select("ray_id", "node_id")
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_weights_sum_to_length(spark, sf_dir):
    from cellbeam.plans.scenes import view

    h = rays.ray_node_hits(view(spark, sf_dir, "rays"), 1)
    for n in (4, 8):
        s = rays.ray_samples(h, 1.0, n).groupBy("ray_id", "node_id").agg(F.sum("weight").alias("w"))
        assert h.join(s, ["ray_id", "node_id"]).where("abs(w - (tmax - tmin)) > 1e-9").isEmpty()


def test_point_ties(spark):
    rows = [(1, 0.0, 0.0, 0.0), (2, -1.0, -1.0, -1.0), (3, 1.0, 1.0, 1.0), (4, 1.1, 0.0, 0.0), (5, 0.1, 0.0, 0.0), (6, None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "point_id long, x double, y double, z double")
    got = {r[0]: r[1] for r in df.select("point_id", points.leaf_key(1)).collect()}
    assert got == {1: 1, 2: 1, 3: 8, 4: None, 5: 2, 6: None}


def test_cull_and_active(spark):
    nodes = tree.full_tree(spark, 1).withColumn("culled", F.col("depth") == 1).withColumn("active", F.lit(False)).withColumn("error", F.lit(2.0))
    out = tree.cull_fixpoint(nodes, 1)
    assert out.where("not culled").isEmpty() and out.agg(F.sum("error")).first()[0] == 0
    with pytest.raises(PySparkException):
        tree.update_active(out.withColumn("active", F.lit(True))).collect()


def brute(families, budget):
    best = None
    for combo in itertools.product(*[list(itertools.product(("none", "split"), repeat=len(f))) + [("merge",) * len(f)] for f in families]):
        cost = value = 0
        ok = True
        for f, acts in zip(families, combo):
            if acts[0] == "merge":
                cost, value, ok = cost + 1, value + (f[0]["merge_value"] or 0), ok and f[0]["merge_value"] is not None
                continue
            for r, a in zip(f, acts):
                v = r["none_value"] if a == "none" else r["split_value"]
                ok = ok and v is not None
                cost, value = cost + (1 if a == "none" else r["split_cost"]), value + (v or 0)
        if ok and cost <= budget and (best is None or value < best):
            best = value
    return best


def test_plan_is_exact(spark):
    rng = np.random.default_rng(1)
    for budget in (4, 7, 12, 20):
        rows = [(k, k // 2, float(rng.random()), float(rng.random()) if k % 3 else None, 8, float(rng.random() * 2)) for k in range(4)]
        df = spark.createDataFrame(rows, "node_id long, parent_id long, none_value double, split_value double, split_cost long, merge_value double")
        data = [r.asDict() for r in df.collect()]
        for r in data:
            r["merge_value"] = data[r["node_id"] // 2 * 2]["merge_value"]
        df = spark.createDataFrame(data, df.schema)
        acts = dict(map(tuple, evolve.plan(df, budget).collect()))
        value = sum(data[n]["none_value"] if a == "none" else data[n]["split_value"] for n, a in acts.items() if a != "merge")
        value += sum(data[p * 2]["merge_value"] for p in (0, 1) if acts[p * 2] == "merge")
        assert abs(value - brute([data[:2], data[2:]], budget)) < 1e-9


def least_value(families, budget):
    """Plain knapsack: least value for at most ``budget`` nodes."""
    best = {0: 0.0}
    for f in families:
        inner = {0: 0.0}
        for r in f:
            ways = [(c, v) for c, v in ((1, r["none_value"]), (r["split_cost"], r["split_value"])) if v is not None]
            step = {}
            for cost, value in inner.items():
                for c, v in ways:
                    step[cost + c] = min(step.get(cost + c, np.inf), value + v)
            inner = step
        if f[0]["merge_value"] is not None:
            inner[1] = min(inner.get(1, np.inf), f[0]["merge_value"])
        step = {}
        for cost, value in best.items():
            for c, v in inner.items():
                if cost + c <= budget:
                    step[cost + c] = min(step.get(cost + c, np.inf), value + v)
        best = step
    return min(best.values(), default=None)


def plan_cost(families, acts):
    cost = value = 0
    for f in families:
        if "merge" in {acts[r["node_id"]] for r in f}:
            assert {acts[r["node_id"]] for r in f} == {"merge"}
            cost, value = cost + 1, value + f[0]["merge_value"]
            continue
        for r in f:
            way = acts[r["node_id"]]
            cost, value = cost + (1 if way == "none" else r["split_cost"]), value + r[f"{way}_value"]
    return cost, value


PLAN_COLUMNS = "node_id long, parent_id long, none_value double, split_value double, split_cost long, merge_value double"


@pytest.mark.parametrize("budget,block,fan_in", [(70, 64, 16), (150, 4, 3), (290, 3, 2), (5000, 7, 16)])
def test_plans_of_many_blocks_are_exact(spark, budget, block, fan_in):
    rng = np.random.default_rng(budget)
    families = []
    for k in range(60):
        merge = float(rng.random() * 3) if k % 5 else None
        size = 1 if merge is None else int(rng.integers(1, 9))
        f = [{"node_id": 8 * k + i, "parent_id": k if k % 10 else None, "none_value": float(rng.random()) if i % 7 != 6 else None, "split_value": float(rng.random() * 0.7) if i % 3 or i == 6 else None, "split_cost": int(rng.integers(1, 9)), "merge_value": merge} for i in range(size)]
        families.append(f)
    df = spark.createDataFrame([tuple(r.values()) for f in families for r in f], PLAN_COLUMNS).repartition(5)
    acts = dict(map(tuple, evolve.plan(df, budget, block, fan_in).collect()))
    assert set(acts) == {r["node_id"] for f in families for r in f}
    cost, value = plan_cost(families, acts)
    assert cost <= budget and np.isclose(value, least_value(families, budget), rtol=1e-12)


def test_plans_at_the_edges(spark):
    empty = spark.createDataFrame([], PLAN_COLUMNS)
    assert evolve.plan(empty, 5).collect() == []
    three = spark.createDataFrame([(k, None, 1.0, None, 8, None) for k in range(3)], PLAN_COLUMNS)
    assert {r["action"] for r in evolve.plan(three, 3).collect()} == {"none"}
    nothing = spark.createDataFrame([(1, None, None, None, 8, None)], PLAN_COLUMNS)
    for df, budget in ((three, 2), (nothing, 100)):
        with pytest.raises(ValueError, match="no plan"):
            evolve.plan(df, budget)
    # what may not stay or split is merged, ties stay apart, and NaN counts as null
    nan = float("nan")
    odd = spark.createDataFrame([(1, 7, None, None, 8, 2.0), (2, 7, 1.0, nan, 8, 2.0), (3, 9, 1.0, 1.0, 1, 1.0)], PLAN_COLUMNS)
    assert dict(map(tuple, evolve.plan(odd, 9).collect())) == {1: "merge", 2: "merge", 3: "none"}


def test_interpolation_and_gradients(spark):
    rng = np.random.default_rng(2)
    g = rng.random((3, 4))
    grid = spark.createDataFrame([(0, i, j, float(g[i, j])) for i in range(3) for j in range(4)], "node_id long, iy int, ix int, value double")
    pts = [(k, 0, float(a), float(b)) for k, (a, b) in enumerate(rng.random((50, 2)) * [3.0, 4.0] - 0.5)]
    df = spark.createDataFrame(pts, "point_id long, node_id long, y double, x double")
    at = {"y": F.col("y"), "x": F.col("x")}
    got = {r[0]: r[1] for r in interp.sample_grid(df, grid, at, {"y": 3, "x": 4}).collect()}
    for k, _, y, x in pts:
        y, x = np.clip(y, 0, 2), np.clip(x, 0, 3)
        i, j = int(min(y, 1)), int(min(x, 2))
        fy, fx = y - i, x - j
        want = (1 - fy) * ((1 - fx) * g[i, j] + fx * g[i, j + 1]) + fy * ((1 - fx) * g[i + 1, j] + fx * g[i + 1, j + 1])
        assert abs(got[k] - want) < 1e-9
    total = interp.grid_gradient(df.withColumn("r", F.lit(1.0)), "r", at, {"y": 3, "x": 4}).agg(F.sum("gradient")).first()[0]
    assert abs(total - 50) < 1e-9


def seen_by(points, poses):
    """Poses that see each point, by rotation matrices."""
    n = np.zeros(len(points), int)
    for x, y, z, w, *t in poses:
        r = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])
        a, b, c = ((points - np.array(t)) @ r).T
        u, v = np.round(a / c * 300 + 320), np.round(b / c * 300 + 240)
        n += (u >= 0) & (u < 640) & (v >= 0) & (v < 480)
    return n


@pytest.mark.parametrize("count", [0, 300, 10_001])
def test_visible_from_all_poses(spark, count, monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(camera, "POSES", 70, raising=False)
    q = rng.normal(size=(count, 4))
    poses = np.hstack([q / np.linalg.norm(q, axis=1, keepdims=True), rng.uniform(-1, 1, (count, 3))])
    pts = rng.uniform(-1, 1, (12, 3))
    a = spark.createDataFrame([(i, *p) for i, p in enumerate(pts.tolist())], "point_id long, x double, y double, z double")
    b = spark.createDataFrame([(i, *p) for i, p in enumerate(poses.tolist())], "image_id long, " + ", ".join(f"{c} double" for c in camera.QUAT + camera.SHIFT))
    out = {r["point_id"]: r["images"] for r in camera.visible(a, b, {"fx": 300, "fy": 300, "cx": 320, "cy": 240, "w": 640, "h": 480}).collect()}
    assert out == {i: n for i, n in enumerate(seen_by(pts, poses).tolist()) if n}


def test_visible_at_depth_zero(spark):
    a = spark.createDataFrame([(1, 0.5, 0.0, 0.0), (2, 0.0, 0.0, 1.0)], "point_id long, x double, y double, z double")
    b = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0), (2, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0)], "image_id long, " + ", ".join(f"{c} double" for c in camera.QUAT + camera.SHIFT))
    out = {r["point_id"]: r["images"] for r in camera.visible(a, b, {"fx": 300, "fy": 300, "cx": 320, "cy": 240, "w": 640, "h": 480}).collect()}
    assert out == {1: 1, 2: 1}


def test_background_of_missing_crops(spark):
    i = spark.createDataFrame([(1, 0, 0, 1.0), (1, 0, 1, 2.0), (1, 9, 9, 8.0), (5, 1, 1, 4.0), (10, 9, 0, 7.0)], "image_id long, row int, col int, value double")
    out = {r[0]: r[1] for r in metrics.background(i, 4, i.select("image_id").distinct()).collect()}
    assert out == {1: 1.0, 5: 4.0, 10: 2.5}


def test_queries_read_whole_inputs(spark, sf_dir):
    from cellbeam.plans.registry import QUERIES
    from cellbeam.plans.scenes import view

    orders, customers = [[r[0] for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").select(k).collect()] for t, k in (("orders", "o_orderkey"), ("customer", "c_custkey"))]
    near = {c * 10 + k for c in customers for k in range(-2, 3)}
    assert sorted(r[0] for r in QUERIES["neighbor_anti"](spark, sf_dir).collect()) == sorted(o for o in orders if o not in near)
    p, q = view(spark, sf_dir, "points").toPandas(), view(spark, sf_dir, "poses").toPandas()
    n = seen_by(p[list("xyz")].to_numpy(), q[list(camera.QUAT + camera.SHIFT)].to_numpy())
    out = {r[0]: r[1] for r in QUERIES["visible_points"](spark, sf_dir).collect()}
    differ = sum(out.get(k, 0) != m for k, m in zip(p["point_id"].tolist(), n.tolist(), strict=True))
    assert differ <= len(p) // 1000  # places on a half pixel round either way


def test_network_matches_numpy(spark):
    layers = fit.init_network([3, 5, 1], 3)
    x = [[0.1, -0.2, 0.3], [1.0, 2.0, 3.0]]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "f array<double>").coalesce(1).select(fit.decode(F.col("f"), layers)).collect()]
    want = (np.maximum(np.array(x) @ layers[0][0] + layers[0][1], 0) @ layers[1][0] + layers[1][1])[:, 0]
    assert np.allclose(got, want)


def test_spectrum_matches_numpy(spark):
    a = np.arange(16.0).reshape(4, 4)
    df = spark.createDataFrame([(1, i, j, float(a[i, j])) for i in range(4) for j in range(4)], "image_id long, row int, col int, value double")
    got = {r["radius"]: r["magnitude"] for r in spectral.radial_spectrum(df).collect()}
    assert abs(got[0] - a.mean()) < 1e-9


def test_empty_inputs(spark):
    none = spark.createDataFrame([], RAYS)
    h = rays.ray_node_hits(none, 2)
    assert rays.ray_samples(h, 1.0).count() == 0
    img = spark.createDataFrame([], "image_id long, row int, col int, value double")
    assert metrics.total_variation(img).count() == 0 and interp.halve(img).count() == 0


def test_checks(spark):
    with pytest.raises(ValueError):
        activation(F.lit(1.0), "other")
    with pytest.raises(PySparkException):
        spark.range(1).select(finite(F.lit(float("nan")))).collect()


def test_scene_files(spark, tmp_path):
    (tmp_path / "poses.txt").write_text("0 0 0 1 1 2 3\n0 1 0 0 4 5 6\n")
    (tmp_path / "images.txt").write_text("a.npy\nb.npy\n")
    (tmp_path / "train.txt").write_text("0\n\n1\n")
    (tmp_path / "camera.ini").write_text("[CameraBase]\nw = 4\nh = 3\nK = 1 2 3 4 0\n")
    p = scene.read_poses(spark, str(tmp_path / "poses.txt"))
    f = scene.frames(p, scene.read_lines(spark, str(tmp_path / "images.txt"))).orderBy("image_id").collect()
    assert [(r["image"], r["tx"], r["camera_id"], r["mask"]) for r in f] == [("a.npy", 1.0, 0, None), ("b.npy", 4.0, 0, None)]
    assert [r["id"] for r in scene.read_index(spark, str(tmp_path / "train.txt")).collect()] == [0, 1]
    assert scene.read_camera(spark, str(tmp_path / "camera.ini")).first()["fy"] == 2.0
    assert scene.read_ini(spark, str(tmp_path / "camera.ini"), {"CameraBase": {"d": "1"}}, {"CameraBase": {"w": "9"}})["CameraBase"] == {"d": "1", "w": "9", "h": "3", "K": "1 2 3 4 0"}


def test_array_files(spark, tmp_path):
    a = np.arange(6, dtype=np.float32).reshape(2, 3)
    np.save(tmp_path / "a.npy", a)
    np.savez_compressed(tmp_path / "b.npz", proj=a, other=a * 2)
    (tmp_path / "c.raw").write_bytes(np.arange(6, dtype="<u2").tobytes())
    rows = arrays.read_npy(spark, str(tmp_path / "a.npy"))
    assert sorted((tuple(r["index"]), r["value"]) for r in rows.collect()) == [((i, j), float(a[i, j])) for i in range(2) for j in range(3)]
    assert arrays.read_npz(spark, str(tmp_path / "b.npz"), "proj").agg(F.sum("value")).first()[0] == 15
    assert arrays.read_npz(spark, str(tmp_path / "b.npz")).count() == 12
    assert arrays.read_raw_images(spark, str(tmp_path / "c.raw"), 3, 2).where("row = 1 and col = 0").first()["value"] == 3
    back = arrays.npy_files(rows.withColumn("name", F.lit("x"))).first()["content"]
    import io

    assert np.array_equal(np.load(io.BytesIO(back)), a)


def test_checkpoints_are_whole_or_not_there(spark, tmp_path):
    at = str(tmp_path / "cp")
    assert tables.read_checkpoint(spark, at) == {}
    rows = spark.createDataFrame([(1, 0.5), (2, None)], "image_id long, tx double")
    tables.write_checkpoint({"poses": rows, "none": rows.where("false")}, at)
    held = tables.read_checkpoint(spark, at, ["poses", "none", "gone"])
    assert set(held) == {"poses", "none"} and sorted(held["poses"].collect()) == sorted(rows.collect()) and held["none"].count() == 0
    # the next version is made from this one, and one that fails on the way changes nothing
    tables.write_checkpoint({"poses": held["poses"].withColumn("tx", F.lit(9.0))}, at)
    broken = rows.withColumn("tx", F.raise_error(F.lit("no")).cast("double"))
    with pytest.raises(Exception, match="no"):
        tables.write_checkpoint({"poses": rows, "tone": broken}, at)
    assert {r["tx"] for r in tables.read_checkpoint(spark, at)["poses"].collect()} == {9.0}
    for k in range(3):
        tables.write_checkpoint({"poses": rows.withColumn("tx", F.lit(float(k)))}, at)
    assert len(tables.versions(spark, at)) == 2 and len(list((tmp_path / "cp").iterdir())) == 2
    assert {r["tx"] for r in tables.read_checkpoint(spark, at)["poses"].collect()} == {2.0}
    again = tables.settled(rows)
    assert sorted(again.collect()) == sorted(rows.collect()) and again.schema == rows.schema

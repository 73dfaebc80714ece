"""Lattices, node grids, batches, poses and files against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellbeam.functions.columns import AXES, activation
from cellbeam.operators import batches, camera, evolve, fit, interp, metrics, points, rays, spectral, tree, volumes
from cellbeam.sources import arrays, scene


def lerp3(g, q):
    """Trilinear look-up in g[z, y, x] at q = (x, y, z) in cells."""
    q = np.clip(q, 0, np.array(g.shape[::-1]) - 1)
    lo = np.minimum(q.astype(int), np.array(g.shape[::-1]) - 2)
    f, out = q - lo, 0.0
    for k in range(8):
        b = np.array([k & 1, k >> 1 & 1, k >> 2 & 1])
        out += np.prod(np.where(b, f, 1 - f)) * g[tuple((lo + b)[::-1])]
    return out


@pytest.fixture(scope="module")
def grids(spark):
    rng = np.random.default_rng(3)
    g = {n: rng.random((4, 4, 4)) for n in range(1, 9) if n != 5}
    rows = [(n, z, y, x, float(a[z, y, x])) for n, a in g.items() for z in range(4) for y in range(4) for x in range(4)]
    return g, spark.createDataFrame(rows, "node_id long, iz int, iy int, ix int, value double")


def test_volume_of_node_grids(spark, grids):
    g, table = grids
    s = volumes.uniform_volume(spark, (5, 4, 3), 1)
    out = {(r["ix"], r["iy"], r["iz"]): r for r in volumes.voxels(volumes.sample_volume(s, table, 1, 4, kind="id")).collect()}
    assert len(out) == 60
    for (i, j, k), r in out.items():
        p = np.array([i / 4, j / 3, k / 2]) * 2 - 1
        cell = np.maximum(np.ceil(p + 1).astype(int) - 1, 0)
        node = 1 + cell[0] + 2 * cell[1] + 4 * cell[2]
        assert r["node_id"] == node and r["valid"]
        want = lerp3(g[node], (p - (cell - 1.0)) / 1.0 * 3) if node in g else 0.0
        assert abs(r["value"] - want) < 1e-9


def test_slice_reaches_outside(spark, grids):
    s = volumes.uniform_slice(spark, (7, 1, 2), (-1.5, 0.5, -0.5), (0.5, 0.0, 1.0), 1, last_fastest=True)
    rows = s.orderBy("i").collect()
    assert [(r["cx"], r["cz"]) for r in rows[:4]] == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert [r["x"] for r in rows[::2]] == [-1.5, -1.0, -0.5, 0.0, 0.5, 1.0, 1.5]
    assert [r["node_id"] is None for r in rows[::2]] == [True, False, False, False, False, False, True]
    assert set(volumes.uniform_slice(spark, (2, 1, 2), (0, 0, 0), (1, 1, 1)).columns) == {"i", "cx", "cy", "cz", *AXES}


def test_render_with_decoder(spark, grids):
    g, table = grids
    net = fit.init_network([2, 6, 1], 9)
    two = table.select("node_id", "iz", "iy", "ix", F.col("value").alias("value0"), (F.col("value") * 2 - 1).alias("value1"))
    r = spark.createDataFrame([(1, -2.0, 0.3, 0.4, 1.0, 0.0, 0.0), (2, -2.0, -0.7, 0.1, 0.8, 0.6, 0.0), (3, 5.0, 5.0, 5.0, 1.0, 0.0, 0.0)], "ray_id long, ox double, oy double, oz double, dx double, dy double, dz double")
    s = rays.ray_samples(rays.ray_node_hits(r, 1), 1.0, 4)
    got = {x["ray_id"]: x["integral"] for x in volumes.render(r, s, two, 1, 4, layers=net, kind="softplus").collect()}
    want = dict.fromkeys(got, 0.0)
    for x in s.collect():
        if x["node_id"] in g:
            m = x["node_id"] - 1
            lo = np.array([m & 1, m >> 1 & 1, m >> 2 & 1]) - 1.0
            v = lerp3(g[x["node_id"]], (np.array([x["x"], x["y"], x["z"]]) - lo) * 3)
            h = np.maximum(np.array([v, 2 * v - 1]) @ net[0][0] + net[0][1], 0) @ net[1][0] + net[1][1]
            want[x["ray_id"]] += np.logaddexp(h[0], 0) * x["weight"]
    assert set(got) == {1, 2, 3} and got[3] == 0 and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_missing_cells_count_as_nothing(spark):
    grid = spark.createDataFrame([(0, 0, 4.0), (0, 2, 8.0)], "node_id long, ix int, value double")
    p = spark.createDataFrame([(1, 0, 0.5), (2, 0, 1.0), (3, 0, 2.5), (4, 7, 0.0)], "point_id long, node_id long, x double")
    out = {r[0]: r[1] for r in interp.sample_grid(p, grid, {"x": F.col("x")}, {"x": 3}).collect()}
    assert out == {1: 2.0, 2: 0.0, 3: 8.0}


def test_hash_tables_of_both_kinds(spark, monkeypatch):
    rng = np.random.default_rng(1)
    p = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(rng.uniform(-0.1, 1.1, (40, 3)))], "point_id long, u double, v double, w double")
    table = spark.createDataFrame([(k, float(v)) for k, v in enumerate(rng.random(50))], "slot long, value double")
    rows = lambda: {(r[0], r[1]): r[2] for r in interp.hash_encode(p, table, 3, 4, 1.0, 64).select("point_id", "level", "feature").collect()}
    small = rows()
    monkeypatch.setattr(interp, "SMALL_TABLE", 0)
    large = rows()
    assert set(small) == set(large) and len(small) == 120 and all(abs(small[k] - large[k]) < 1e-12 for k in small)
    # the gradient is the transpose of the look-up
    g = {r[0]: r[1] for r in interp.hash_gradient(p.withColumn("r", F.lit(1.0)), "r", 3, 4, 1.0, 64).collect()}
    held = {r[0]: r[1] for r in table.collect()}
    assert abs(sum(g[s] * held.get(s, 0.0) for s in g) - sum(small.values())) < 1e-9


def test_locate_in_mixed_levels(spark):
    nodes = tree.full_tree(spark, 2)
    active = nodes.where("(depth = 1 and node_id not in (3, 6)) or parent_id = 3")
    rng = np.random.default_rng(2)
    p = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(rng.uniform(-1.1, 1.1, (300, 3)))], "point_id long, x double, y double, z double")
    got = {r["point_id"]: r["active_node"] for r in points.locate(p, active, 2).collect()}
    boxes = active.collect()
    for r in p.collect():
        holds = [b["node_id"] for b in boxes if all(b[f"{a}0"] <= r[a] <= b[f"{a}1"] for a in AXES)]
        assert got[r["point_id"]] == (holds[0] if holds else None)


def test_places_and_ranks_in_ranges(spark):
    rng = np.random.default_rng(5)
    rows = [(int(n) if n else None, int(k), i) for i, (n, k) in enumerate(zip(rng.integers(0, 3, 500), rng.integers(0, 60, 500)))]
    df = spark.createDataFrame(rows, "node_id long, k long, i long").repartition(4)
    got = {r["i"]: r["place"] for r in points.row_in_node(df, ["k", "i"]).collect()}
    for node in (None, 1, 2):
        mine = sorted((k, i) for n, k, i in rows if n == node)
        assert [got[i] for _, i in mine] == list(range(len(mine)))
    nodes = tree.full_tree(spark, 2).withColumn("active", F.col("node_id") % 3 == 0)
    ranks = {r["node_id"]: r["active_rank"] for r in tree.active_rank(nodes).collect()}
    assert all(ranks[n] == (n // 3 if n % 3 == 0 else None) for n in range(73))


def test_poses_turn(spark):
    def matrix(q):
        x, y, z, w = q
        return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])

    rng = np.random.default_rng(0)
    q = rng.normal(size=(4, 4))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    t = rng.normal(size=(3, 3)) * np.array([[1.0], [1e-10], [3.0]])
    poses = spark.createDataFrame([(i, *map(float, v), 1.0, 2.0, 3.0) for i, v in enumerate(q)], "image_id long, qx double, qy double, qz double, qw double, tx double, ty double, tz double")
    turns = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(t)], "image_id long, rx double, ry double, rz double")
    out = {r["image_id"]: r for r in camera.apply_tangent(poses, turns).collect()}
    for i in range(4):
        v = t[i] if i < 3 else np.zeros(3)
        k = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])
        power, total = np.eye(3), np.eye(3)
        for j in range(1, 40):
            power = power @ k / j
            total = total + power
        assert np.allclose(matrix([out[i][c] for c in camera.QUAT]), total @ matrix(q[i]), atol=1e-9) and out[i]["tz"] == 3.0


def test_noise_stays_in_bounds(spark):
    p = spark.range(200).select(F.col("id").alias("image_id"), F.lit(1.0).alias("tx"), F.lit(2.0).alias("ty"), F.lit(3.0).alias("tz"))
    r = camera.jitter(p, 0.2, 3).agg(*[F.max(F.abs(F.col(c) - v)).alias(c) for c, v in (("tx", 1.0), ("ty", 2.0), ("tz", 3.0))], F.stddev("tx").alias("s")).first()
    assert all(0 < r[c] <= 0.1 for c in ("tx", "ty", "tz")) and r["s"] > 0.01 and camera.jitter(p, 0.0, 3) is p
    ray = spark.range(200).select(F.col("id").alias("ray_id"), *[F.lit(0.5).alias(f"o{a}") for a in AXES], F.lit(4.0).alias("defocus"))
    far = camera.defocused(ray, 100, 3.0, 5).agg(F.max(F.sqrt(sum(((F.col(f"o{a}") - 0.5) ** 2 for a in AXES), F.lit(0.0)))).alias("d")).first()["d"]
    assert far > 0


def test_batches_and_random_points(spark):
    images = spark.createDataFrame([(i, r, c, float(r)) for i in (3, 8) for r in range(5) for c in range(4)], "image_id long, row int, col int, value double")
    rows = batches.row_batches(images, 2, 5, 4).collect()
    assert {(r["image_id"], r["batch"], r["row_start"], r["row_end"]) for r in rows} == {(3, 0, 0, 2), (3, 1, 2, 4), (3, 2, 4, 5), (8, 3, 0, 2), (8, 4, 2, 4), (8, 5, 4, 5)}
    assert all(r["row_start"] <= r["row"] < r["row_end"] and r["u"] == r["col"] / 3 and r["v"] == r["row"] / 4 for r in rows)
    pixels = spark.range(4000).select(F.col("id").alias("pixel_id"))
    scenes = spark.createDataFrame([(s, 10 * s + k) for s in range(4) for k in range(5)], "scene_id long, image_id long")
    drawn = batches.random_scene_batch(pixels, scenes, 0.5, 7).collect()
    assert 1600 < len(drawn) < 2400 and len({r["scene_id"] for r in drawn}) == 1 and {r["image_id"] // 10 for r in drawn} == {drawn[0]["scene_id"]}
    assert len({r["image_id"] for r in drawn}) == 5 and all(0 <= r["u"] < 1 and 0 <= r["v"] < 1 for r in drawn)
    one = batches.random_batch(pixels.withColumn("image_id", F.lit(0)), 6, 0.5, 7).collect()
    assert {r["image_id"] for r in one} == set(range(1, 7)) and sorted(map(tuple, one)) == sorted(map(tuple, batches.random_batch(pixels.withColumn("image_id", F.lit(0)), 6, 0.5, 7).collect()))
    leaf = tree.full_tree(spark, 1).where("depth = 1")
    inside = batches.random_in_nodes(leaf, 9, 2).join(leaf, "node_id")
    assert inside.count() == 72 and inside.where(" or ".join(f"{a} < {a}0 or {a} > {a}1" for a in AXES)).isEmpty() and inside.select("x").distinct().count() > 60


def test_networks(spark):
    net = fit.init_network([3, 5, 2], 4)
    x = [[0.1, -0.2, 0.3], [1.0, 2.0, -3.0]]
    for kind in fit.ACTIVATIONS:
        h = np.array(x) @ net[0][0] + net[0][1]
        df = spark.createDataFrame([(float(v),) for v in h.ravel()], "v double").coalesce(1)
        assert np.allclose([r[0] for r in df.select(activation(F.col("v"), kind)).collect()], fit.ACTIVATIONS[kind](h.ravel()))
        got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "f array<double>").coalesce(1).select(fit.decode_channels(F.col("f"), net, kind, "sigmoid")).collect()]
        assert np.allclose(got, 1 / (1 + np.exp(-(fit.ACTIVATIONS[kind](h) @ net[1][0] + net[1][1]))))
    assert fit.decayed(0.1, 3, 0.5) == 0.0125 and evolve.converged(0.99, 1.0, 10) != evolve.converged(0.5, 1.0, 10)


def test_spectra(spark):
    rng = np.random.default_rng(8)
    a, b = rng.random((2, 6, 6))
    table = lambda v: spark.createDataFrame([(1, i, j, float(v[i, j])) for i in range(6) for j in range(6)], "image_id long, row int, col int, value double")

    def rings(v):
        f = np.abs(np.fft.fftshift(np.fft.fft2(v))) / v.size
        out: dict = {}
        for i in range(6):
            for j in range(6):
                out.setdefault(int(np.rint(np.hypot(i - 3, j - 3))), []).append(f[i, j])
        return {k: np.mean(x) for k, x in out.items()}

    s, t = spectral.radial_spectrum(table(a)), spectral.radial_spectrum(table(b))
    got = {r["radius"]: r["magnitude"] for r in s.collect()}
    assert got.keys() == rings(a).keys() and all(abs(got[k] - v) < 1e-9 for k, v in rings(a).items())
    want = np.mean([(rings(a)[k] - rings(b)[k]) ** 2 / (1 + np.exp(-(k - 2.0) * 1.5)) for k in rings(a)])
    assert abs(spectral.spectrum_loss(s, t, 2.0, 1.5).first()["loss"] - want) < 1e-12


def test_pixels_outside_fail(spark):
    from pyspark.errors import PySparkException

    from cellbeam.functions.columns import pixel_to_uv

    p = spark.createDataFrame([(0.0,), (7.0,), (None,)], "p double")
    assert [r[0] for r in p.select(pixel_to_uv(F.col("p"), 8, check=True)).collect()] == [0.0, 1.0, None]
    for bad in (-1.0, 8.0):
        with pytest.raises(PySparkException):
            spark.createDataFrame([(bad,)], "p double").select(pixel_to_uv(F.col("p"), 8, check=True)).collect()


def test_losses(spark):
    df = spark.createDataFrame([(1.0, 0.5), (2.0, 2.5)], "p double, t double")
    assert abs(metrics.training_loss(df, "p", "t", mse=2.0, l1=1.0).first()["loss"] - (2 * 0.25 + 0.5)) < 1e-12
    one = spark.createDataFrame([(2.0,), (4.0,)], "a double")
    assert metrics.weighted_sum([(one, "a", 0.5), (one, "a", 2.0)]).first()["loss"] == 7.5


def test_files(spark, tmp_path):
    v = np.arange(24, dtype=float).reshape(2, 3, 4)
    rows = [("vol", x, y, z, float(v[z, y, x])) for z in range(2) for y in range(3) for x in range(4)]
    out = arrays.analyze_files(spark.createDataFrame(rows, "name string, ix int, iy int, iz int, value double")).first()
    folder = tmp_path / "scans"
    folder.mkdir()
    (folder / "vol.hdr").write_bytes(bytes(out["header"]))
    (folder / "vol.img").write_bytes(bytes(out["image"]))
    (folder / "lone.hdr").write_bytes(bytes(out["header"]))
    back = arrays.read_analyze(spark, str(folder)).collect()
    assert {(r["ix"], r["iy"], r["iz"]): r["value"] for r in back} == {(x, y, z): w for _, x, y, z, w in rows}
    big = bytearray(348)
    big[0:4], big[40:56], big[70:74] = (348).to_bytes(4, "big"), np.array([3, 4, 3, 2, 1, 0, 0, 0], ">i2").tobytes(), np.array([4, 16], ">i2").tobytes()
    assert np.array_equal(arrays._analyze(bytes(big), v.astype(">i2").tobytes()), v)
    with pytest.raises(ValueError):
        arrays._analyze(bytes(348), b"")
    cells = spark.createDataFrame([("a", n, [2], [i], float(i + k)) for k, n in enumerate(("p", "q")) for i in range(2)], "archive string, name string, dims array<int>, index array<int>, value double")
    import io

    with np.load(io.BytesIO(bytes(arrays.npz_files(cells).first()["content"]))) as z:
        assert z["p"].tolist() == [0.0, 1.0] and z["q"].tolist() == [1.0, 2.0]
    for kind, data in (("uint8", np.arange(6, dtype="u1")), ("float32", np.arange(6, dtype="<f4"))):
        (tmp_path / f"{kind}.raw").write_bytes(data.tobytes())
        assert [r["value"] for r in arrays.read_raw_images(spark, str(tmp_path / f"{kind}.raw"), 3, 2, kind).orderBy("row", "col").collect()] == list(range(6))
    m = spark.createDataFrame([(1, 0.5)], "epoch int, loss double")
    for _ in range(2):
        arrays.append_metrics(m, str(tmp_path / "metrics"))
    assert spark.read.parquet(str(tmp_path / "metrics")).count() == 2
    (tmp_path / "angles.txt").write_text("0.5\n\n1.5\n")
    assert [r[-1] for r in scene.read_angles(spark, str(tmp_path / "angles.txt")).collect()] == [0.5, 1.5]
    ring = scene.circular_poses(spark, 5, 2.0).orderBy("image_id").collect()
    assert np.allclose([r["angle"] for r in ring], np.linspace(0, 2 * np.pi, 5)) and np.allclose([np.hypot(r["tx"], r["ty"]) for r in ring], 2)

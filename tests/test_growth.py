"""What keeps a job's size in step with its input: no join of samples, no row per pair, no step per small image."""

import numpy as np
from pyspark.sql import functions as F

from cellbeam.operators import camera, rays, volumes, windows


def test_poses_go_down_a_tree_of_points():
    """Counts by trees of boxes against projection of every pair; the order of points and identical ones do not matter."""
    rng = np.random.default_rng(21)
    cam = {"fx": 300, "fy": 300, "cx": 320, "cy": 240, "w": 640, "h": 480}
    poses = rng.normal(size=(150, 7))
    poses[:, :4] /= np.linalg.norm(poses[:, :4], axis=1, keepdims=True)
    for p in (rng.uniform(-1, 1, (1000, 3)), np.repeat(rng.uniform(-1, 1, (3, 3)), 90, 0), poses[:33, 4:], np.zeros((0, 3))):
        p = p[np.argsort(p[:, 0], kind="stable")]
        want = sum((camera._in_image(np.broadcast_to(q, (len(p), 7)), p, cam).astype(int) for q in poses), np.zeros(len(p), int))
        assert (camera.seen_by(p, poses, cam) == want).all()


def test_windows_work_on_many_images_at_once(spark, monkeypatch):
    """Small images share a step, and a step is bounded by STACK cells."""
    frame = spark.range(300).select(F.col("id").alias("image_id"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("i")).select("image_id", (F.col("i") % 4).alias("col"), F.floor(F.col("i") / 4).cast("int").alias("row"), F.lit(1.0).alias("value"))

    def work(known, arrays, inner, origin):
        assert known.ndim == 3 and len(origin) == len(known)
        return np.arange(len(known)), np.full(len(known), len(known))

    for stack, most in ((1 << 20, 300), (72 * 7, 7)):
        monkeypatch.setattr(windows, "STACK", stack)
        got = windows.over_tiles(frame.coalesce(1), "image_id", ("row", "col"), ("value",), 2, work, "together long").collect()
        assert len(got) == 300 and 1 < max(r["together"] for r in got) <= most


def test_samples_are_not_shuffled_to_small_grids(spark):
    """Grids are broadcast by their own size, whatever Spark guesses from the files behind them."""
    grid = spark.range(128).selectExpr("1 + id div 64 as node_id", "cast(id % 64 div 16 as int) as iz", "cast(id div 4 % 4 as int) as iy", "cast(id % 4 as int) as ix", "1.0D as value")
    samples = spark.range(5).selectExpr("id as ray_id", "1 + id % 2 as node_id", "0D as x", "0D as y", "0D as z", "1D as weight")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = volumes.sample_volume(samples, grid, 1, 4)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and out.count() == 5
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_hits_and_samples_carry_columns(spark):
    r = spark.createDataFrame([(1, -1.5, 0.1, 0.1, 1.0, 0.0, 0.0, 7.5)], "ray_id long, ox double, oy double, oz double, dx double, dy double, dz double, residual double")
    s = rays.ray_samples(rays.ray_node_hits(r, 1, carry=("residual",)), 1.0, 4, carry=("residual",))
    assert s.count() > 4 and {x["residual"] for x in s.collect()} == {7.5}

"""Queries over an adaptive tree whose active nodes stand on three levels, split where the given points are dense."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import AXES, keyed_uniform, r6
from ..operators import active, metrics, points, tree, volumes
from ..sources.tables import settled
from .queries_tree import _AX, _TMAX, _TMIN, rnd
from .queries_volume import N, density_sql, voxel_rows
from .scenes import SQL, d, leaf_sql, tree_sql, uniform_sql, view

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Deepest level of the tree, and samples on a node's diagonal.
DEEP, PER = 3, 8


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = " ".join(sql.split())
        return f

    return add


def mixed_nodes(spark, sf):
    """All nodes with their points ``n`` and active flags: two plans split what holds more than its share of points.

    Nodes of the deepest level without points are culled, so the active nodes leave gaps.
    """
    leaf = view(spark, sf, "points").select(points.leaf_key(DEEP).alias("leaf")).where("leaf is not null")
    counts = leaf.groupBy("leaf").agg(F.count(F.lit(1)).alias("c"))
    up = counts.select("c", F.explode(points.ancestors(F.col("leaf"), DEEP)).alias("node_id")).groupBy("node_id").agg(F.sum("c").alias("n"))
    nodes = tree.full_tree(spark, DEEP).join(up, "node_id", "left").fillna(0, ["n"])
    total = up.where("node_id = 0").select(F.col("n").alias("total"))
    nodes = settled(nodes.crossJoin(F.broadcast(total)).withColumn("culled", (F.col("depth") == DEEP) & (F.col("n") == 0)).withColumn("active", F.col("depth") == 1).coalesce(1))
    for level, share in ((1, 8), (2, 64)):
        plan = nodes.where("active").select("node_id", F.when((F.col("n") * share > F.col("total")) & (F.col("depth") == level), "split").otherwise("none").alias("action"))
        nodes = settled(tree.apply_plan(nodes, plan).coalesce(1))
    return nodes


def mixed_active(spark, sf):
    return mixed_nodes(spark, sf).where("active").select("node_id", "depth")


_TREE = f"""{SQL['points']}, {', '.join(tree_sql(f'm{k}', k) for k in (1, 2, 3))}, pl AS (SELECT {leaf_sql(DEEP)} AS leaf FROM points), c3 AS (SELECT leaf AS id, count(*) AS n FROM pl WHERE leaf IS NOT NULL GROUP BY 1),
c2 AS (SELECT 9 + ((id - 73) >> 3) AS id, sum(n) AS n FROM c3 GROUP BY 1), c1 AS (SELECT 1 + ((id - 9) >> 3) AS id, sum(n) AS n FROM c2 GROUP BY 1), tot AS (SELECT sum(n) AS total FROM c1),
s1 AS (SELECT id FROM c1, tot WHERE n * 8 > total), s2 AS (SELECT id FROM c2, tot WHERE n * 64 > total AND 1 + ((id - 9) >> 3) IN (SELECT id FROM s1)),
leaf AS (SELECT * FROM m1 WHERE node_id NOT IN (SELECT id FROM s1) UNION ALL SELECT * FROM m2 WHERE parent_id IN (SELECT id FROM s1) AND node_id NOT IN (SELECT id FROM s2) UNION ALL SELECT * FROM m3 WHERE parent_id IN (SELECT id FROM s2) AND node_id IN (SELECT id FROM c3))"""
_HITS = f"{SQL['rays']}, tested AS (SELECT rays.*, node_id, x1 - x0 AS width, {_TMIN} AS tmin, {_TMAX} AS tmax FROM rays CROSS JOIN leaf WHERE {' AND '.join(x[2] for x in _AX)}), hits AS (SELECT * FROM tested WHERE tmin <= tmax AND tmax >= 0 AND tmax - tmin >= 1e-5)"
_COUNT = f"greatest(CAST(ceil((tmax - tmin) / (width * {d(3.0**0.5)}) * {PER}) AS BIGINT), 1)"


def samples_sql(place: str) -> str:
    """CTE samples from hits; ``place`` is where in its part sample ``j`` stands."""
    return f"parts AS (SELECT *, unnest(range(n)) AS j FROM (SELECT *, {_COUNT} AS n FROM hits)), stood AS (SELECT *, tmin + (j + {place}) * ((tmax - tmin) / n) AS t FROM parts), samples AS (SELECT ray_id, node_id, j, t, coalesce((lead(t) OVER w + t) / 2, tmax) - coalesce((lag(t) OVER w + t) / 2, tmin) AS weight, ox + dx * t AS x, oy + dy * t AS y, oz + dz * t AS z FROM stood WINDOW w AS (PARTITION BY ray_id, node_id ORDER BY j))"


def located(x: str) -> str:
    """The active node of rows with a deepest leaf ``lf``, as a join of the tables ``x``."""
    return f"(SELECT q.*, coalesce(a3.node_id, a2.node_id, a1.node_id) AS node_id FROM (SELECT *, {leaf_sql(DEEP)} AS lf FROM {x}) q LEFT JOIN leaf a3 ON lf = a3.node_id LEFT JOIN leaf a2 ON 9 + ((lf - 73) >> 3) = a2.node_id LEFT JOIN leaf a1 ON 1 + ((lf - 73) >> 6) = a1.node_id)"


_CELL = {a: f"least(CAST(floor((({a} - {a}0) / ({a}1 - {a}0) * 2 - 1 + 1) / 2 * {N}) AS INT), {N - 1})" for a in "xyz"}
_GRID = f"pg AS (SELECT q.node_id, {', '.join(f'{_CELL[a]} AS i{a}' for a in 'zyx')}, avg(value) / 100 AS v FROM {located('(SELECT point_id, x, y, z, value FROM points)')} q JOIN leaf ON q.node_id = leaf.node_id GROUP BY 1, 2, 3, 4)"


def hits_of(spark, sf, nodes=None):
    return active.ray_active_hits(view(spark, sf, "rays"), nodes or mixed_active(spark, sf), DEEP)


def active_grid(spark, sf, nodes):
    """A grid of N cells per axis in each active node: the mean value of the points in a cell; others are missing."""
    p = points.locate(view(spark, sf, "points").drop("node_id"), nodes, DEEP).withColumnRenamed("active_node", "node_id").where("node_id is not null")
    at = active.local_in("node_id", DEEP)
    cell = {a: F.least(F.floor((at[a] + 1) / 2 * N).cast("int"), F.lit(N - 1)) for a in AXES}
    return p.groupBy("node_id", *[cell[a].alias(f"i{a}") for a in reversed(AXES)]).agg((F.avg("value") / 100).alias("value"))


@query("mixed_tree", f"WITH {_TREE} SELECT node_id, depth, {', '.join(f'{a}{k}' for a in 'xyz' for k in (0, 1))}, {rnd(f'(x1 - x0) * {d(3.0**0.5)}', 'diagonal')} FROM leaf")
def mixed_tree(spark, sf):
    """The active nodes, with level, box and diagonal taken from the ids alone."""
    box = active.node_box(F.col("node_id"), DEEP)
    return mixed_active(spark, sf).select("node_id", active.level_of(F.col("node_id"), DEEP).alias("depth"), *[c.alias(a) for a, c in box.items()], r6(active.node_diagonal(F.col("node_id"), DEEP)).alias("diagonal"))


@query("ray_active_hits", f"WITH {_TREE}, {_HITS} SELECT ray_id, node_id, {rnd('tmin', 'tmin')}, {rnd('tmax', 'tmax')} FROM hits")
def ray_active_hits(spark, sf):
    return hits_of(spark, sf).select("ray_id", "node_id", r6(F.col("tmin")).alias("tmin"), r6(F.col("tmax")).alias("tmax"))


def sample_rows(s):
    return s.select("ray_id", "node_id", "j", *[r6(F.col(c)).alias(c) for c in ("t", "weight", "x", "y", "z")])


_ROWS = f"SELECT ray_id, node_id, j, {', '.join(rnd(c, c) for c in ('t', 'weight', 'x', 'y', 'z'))} FROM samples"


@query("ray_active_samples", f"WITH {_TREE}, {_HITS}, {samples_sql('0.5')} {_ROWS}")
def ray_active_samples(spark, sf):
    return sample_rows(active.ray_active_samples(hits_of(spark, sf), DEEP, PER))


@query("ray_jittered_samples", f"WITH {_TREE}, {_HITS}, {samples_sql(uniform_sql(17, 'ray_id', 'node_id', 'j'))} {_ROWS}")
def ray_jittered_samples(spark, sf):
    """Each sample at a random place of its part, by its ray, node and number."""
    return sample_rows(active.ray_active_samples(hits_of(spark, sf), DEEP, PER, lambda j: keyed_uniform(17, F.col("ray_id"), F.col("node_id"), j)))


_KEYED = "s AS (SELECT ray_id * 10000000 + node_id * 1000 + j AS i, ray_id, node_id, weight, x, y, z FROM samples)"


@query("render_active", f"WITH {_TREE}, {_HITS}, {samples_sql('0.5')}, {_KEYED}, {density_sql('s', 'i', _GRID)} SELECT rays.ray_id, round(coalesce(sum(weight * density), 0), 4) + {d(0)} AS integral FROM rays LEFT JOIN s ON rays.ray_id = s.ray_id LEFT JOIN dens ON s.i = dens.i GROUP BY 1")
def render_active(spark, sf):
    """Rays through the density field of the active nodes' grids."""
    nodes = mixed_active(spark, sf)
    s = active.ray_active_samples(hits_of(spark, sf, nodes), DEEP, PER)
    out = volumes.render(view(spark, sf, "rays"), s, active_grid(spark, sf, nodes), DEEP, N, mixed=True)
    return out.select("ray_id", (F.round("integral", 4) + F.lit(0.0)).alias("integral"))


@query("volume_active", f"WITH {_TREE}, c AS (SELECT i, i % 17 AS cx, (i // 17) % 17 AS cy, i // 289 AS cz FROM (SELECT unnest(range(4913)) AS i)), placed AS (SELECT *, {', '.join(f'{d(f'c{a}')} / 16 * 2 - 1 AS {a}' for a in 'xyz')} FROM c), s AS (SELECT * FROM {located('placed')}), {density_sql('s', 'i', _GRID)} SELECT CAST(cx AS INT) AS ix, CAST(cy AS INT) AS iy, CAST(cz AS INT) AS iz, round(coalesce(density, 0), 5) + {d(0)} AS density, s.node_id, s.node_id IS NOT NULL AS valid FROM s LEFT JOIN dens ON s.i = dens.i")
def volume_active(spark, sf):
    """The density field of the active nodes' grids on a lattice over the whole volume; gaps are 0 and not valid."""
    nodes = mixed_active(spark, sf)
    s = volumes.uniform_volume(spark, (17, 17, 17), DEEP, active=nodes)
    return voxel_rows(volumes.sample_volume(s, active_grid(spark, sf, nodes), DEEP, N, mixed=True))


@query("node_loss_active", f"WITH {_TREE}, {_HITS}, p AS (SELECT ray_id, sum(tmax - tmin) AS path FROM hits GROUP BY 1), s AS (SELECT node_id, sum(power(path - target, 2) * (tmax - tmin)) AS loss, sum(tmax - tmin) AS w FROM hits JOIN p USING (ray_id) GROUP BY 1) SELECT leaf.node_id, round(coalesce(loss, 0), 4) + {d(0)} AS loss, round(coalesce(w, 0), 4) + {d(0)} AS weight FROM leaf LEFT JOIN s ON leaf.node_id = s.node_id")
def node_loss_active(spark, sf):
    """Losses of rays shared out to the active nodes that they cross, the input of split and merge."""
    nodes = mixed_active(spark, sf)
    r, s = view(spark, sf, "rays"), hits_of(spark, sf, nodes).select("ray_id", "node_id", (F.col("tmax") - F.col("tmin")).alias("weight"))
    path = s.groupBy("ray_id").agg(F.sum("weight").alias("path"))
    loss = r.join(path, "ray_id").select("ray_id", F.pow(F.col("path") - F.col("target"), 2).alias("loss"))
    out = metrics.node_loss(s, loss, nodes)
    return out.select("node_id", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("loss", "weight")])


#: Places on a face per axis, and how far behind it the other node is looked for.
FACE, EPS = 3, 0.001


def face_sql(a: str, front: int) -> str:
    b, c = AXES[(AXES.index(a) + 1) % 3], AXES[(AXES.index(a) + 2) % 3]
    part = {b: f"(k % {FACE}) / {d(FACE - 1)}", c: f"(k // {FACE}) / {d(FACE - 1)}"}
    spot = {n: f"{n}{front}" if n == a else f"{n}0 + {part[n]} * ({n}1 - {n}0)" for n in AXES}
    moved = ", ".join(f"{s} {'+' if front else '-'} {d(EPS)} AS {n}" if n == a else f"{s} AS {n}" for n, s in spot.items())
    return f"SELECT owner, '{a}' AS axis, {front} AS front, k, {', '.join(f'{s} AS f{n}' for n, s in spot.items())}, {moved} FROM (SELECT node_id AS owner, {', '.join(f'{n}{e}' for n in AXES for e in (0, 1))}, unnest(range({FACE * FACE})) AS k FROM leaf)"


_FACES = f"f AS ({' UNION ALL '.join(face_sql(a, front) for a in AXES for front in (0, 1))}), met AS (SELECT * FROM {located('f')} WHERE node_id IS NOT NULL AND node_id <> owner)"
_SPOT = ", ".join(f"round(f{a}, 6) + {d(0)} AS {a}" for a in AXES)


@query("face_pairs", f"WITH {_TREE}, {_FACES} SELECT owner, axis, front, CAST(k AS INT) AS k, {_SPOT}, 0 AS side, owner AS node_id FROM met UNION ALL SELECT owner, axis, front, CAST(k AS INT) AS k, {_SPOT}, 1 AS side, node_id FROM met")
def face_pairs(spark, sf):
    """Places on the faces of the active nodes with the nodes on both sides, across levels."""
    out = active.active_faces(mixed_active(spark, sf), DEEP, FACE, EPS)
    return out.select("owner", "axis", "front", "k", *[r6(F.col(a)).alias(a) for a in AXES], "side", "node_id")


_TOUCHES = lambda t: " AND ".join("(" + " OR ".join(f"({c} > -0.5 AND {c} < 0.5)" for c in (f"{t}.{a}0", f"{t}.{a}1", f"({t}.{a}0 + {t}.{a}1)")) + ")" for a in AXES)


@query("face_pairs_roi", f"WITH {_TREE}, {_FACES} SELECT owner, axis, count(*) * 2 AS n FROM met JOIN leaf o ON owner = o.node_id JOIN leaf p ON met.node_id = p.node_id WHERE {_TOUCHES('o')} AND {_TOUCHES('p')} GROUP BY 1, 2")
def face_pairs_roi(spark, sf):
    """How many rows the faces of each node give where both nodes touch a region."""
    out = active.active_faces(mixed_active(spark, sf), DEEP, FACE, EPS, roi=((-0.5,) * 3, (0.5,) * 3))
    return out.groupBy("owner", "axis").agg(F.count(F.lit(1)).alias("n"))

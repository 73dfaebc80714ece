"""Queries over trees, rays and points."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import delinearize, in_roi, r6
from ..operators import evolve, metrics, points, rays, tree
from .scenes import SQL, d, leaf_sql, tree_sql, view

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
DEPTH = 2
START = tree.level_start(DEPTH)
#: Diagonal of the unit cell at DEPTH, for sample counts.
DIAGONAL = 0.8660254037844386
ROI = ((-0.5, -0.5, -0.5), (0.5, 0.5, 0.5))


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = " ".join(sql.split())
        return f

    return add


def rnd(x: str, name: str, digits: int = 6) -> str:
    return f'round({x}, {digits}) + {d(0)} AS "{name}"'


def counted(spark, sf, depth=DEPTH, quad=False):
    """The tree's nodes with the number of points in each leaf."""
    p = view(spark, sf, "points").select(points.leaf_key(depth, quad).alias("node_id"))
    n = p.where("node_id is not null").groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))
    return tree.full_tree(spark, depth, quad).join(n, "node_id", "left").fillna(0, ["n"])


_LEVELS = ", ".join(tree_sql(f"t{k}", k) for k in range(DEPTH + 1))
_ALL = " UNION ALL ".join(f"SELECT node_id, parent_id, depth, x0, x1, y0, y1, z0, z1 FROM t{k}" for k in range(DEPTH + 1))
_COUNT = f"{SQL['points']}, c AS (SELECT {leaf_sql(DEPTH)} AS node_id, count(*) AS n FROM points GROUP BY 1)"
_NODES = f"{_LEVELS}, nodes AS ({_ALL}), {_COUNT}, counted AS (SELECT nodes.*, coalesce(n, 0) AS n FROM nodes LEFT JOIN c ON nodes.node_id = c.node_id)"
_ROI = " AND ".join("(" + " OR ".join(f"({c} > -0.5 AND {c} < 0.5)" for c in (f"{a}0", f"{a}1", f"({a}0 + {a}1)")) + ")" for a in "xyz")


@query("tree_nodes", f"WITH {_NODES} SELECT node_id, parent_id, depth, x0, x1, y0, y1, z0, z1, {d('depth')} / 2 * 2 - 1 AS scale, n FROM counted")
def tree_nodes(spark, sf):
    return counted(spark, sf).select("node_id", "parent_id", "depth", "x0", "x1", "y0", "y1", "z0", "z1", "scale", "n")


_QLEAF = " + ".join(f"((({c} >> {b}) & 1) * {1 << (2 * b + i)})" for b in range(3) for i, c in enumerate([f"greatest(CAST(ceil(({a} + {d(1)}) * {d(4)}) AS BIGINT) - 1, 0)" for a in "xz"]))


@query("tree_quad", f"WITH {SQL['points']}, {tree_sql('t', 3, True)}, c AS (SELECT CASE WHEN x BETWEEN -1 AND 1 AND y BETWEEN -1 AND 1 AND z BETWEEN -1 AND 1 THEN 21 + {_QLEAF} END AS node_id, count(*) AS n FROM points GROUP BY 1) SELECT t.node_id, parent_id, x0, x1, z0, z1, coalesce(n, 0) AS n FROM t LEFT JOIN c ON t.node_id = c.node_id")
def tree_quad(spark, sf):
    return counted(spark, sf, 3, True).where("depth = 3").select("node_id", "parent_id", "x0", "x1", "z0", "z1", "n")


@query("active_rank", f"WITH {_NODES} SELECT node_id, n > 0 AND depth = 2 AS active, CASE WHEN n > 0 AND depth = 2 THEN sum(CASE WHEN n > 0 AND depth = 2 THEN 1 ELSE 0 END) OVER (ORDER BY node_id) - 1 END AS active_rank FROM counted")
def active_rank(spark, sf):
    nodes = tree.set_active(counted(spark, sf), DEPTH).withColumn("active", F.col("active") & (F.col("n") > 0))
    return tree.active_rank(nodes).select("node_id", "active", "active_rank")


@query("roi_nodes", f"WITH {_NODES} SELECT node_id, n, {_ROI} AS inside, row_number() OVER (PARTITION BY {_ROI} ORDER BY node_id) - 1 AS place FROM counted WHERE depth = 2")
def roi_nodes(spark, sf):
    nodes = counted(spark, sf).where(F.col("depth") == DEPTH).withColumn("inside", in_roi(*ROI))
    return points.row_in_node(nodes, ["node_id"], "inside").select("node_id", "n", "inside", F.col("place").cast("long").alias("place"))


_AX = []
for _a in "xyz":
    _AX.append((f"least(({_a}0 - o{_a}) / nullif(d{_a}, 0), ({_a}1 - o{_a}) / nullif(d{_a}, 0))", f"greatest(({_a}0 - o{_a}) / nullif(d{_a}, 0), ({_a}1 - o{_a}) / nullif(d{_a}, 0))", f"(d{_a} <> 0 OR (o{_a} >= {_a}0 AND o{_a} < {_a}1))"))
_TMIN = "greatest(" + ", ".join(f"coalesce({x[0]}, -1e30)" for x in _AX) + ")"
_TMAX = "least(" + ", ".join(f"coalesce({x[1]}, 1e30)" for x in _AX) + ")"
_HITS = f"{SQL['rays']}, {tree_sql('leaf', DEPTH)}, tested AS (SELECT rays.*, node_id, {_TMIN} AS tmin, {_TMAX} AS tmax FROM rays CROSS JOIN leaf WHERE {' AND '.join(x[2] for x in _AX)}), hits AS (SELECT * FROM tested WHERE tmin <= tmax AND tmax >= 0 AND tmax - tmin >= 1e-5)"
_N = f"greatest(CAST(ceil((tmax - tmin) / {d(DIAGONAL)} * 8) AS BIGINT), 1)"
_SAMPLES = f"{_HITS}, counts AS (SELECT *, {_N} AS n FROM hits), parts AS (SELECT *, unnest(range(n)) AS j FROM counts), samples AS (SELECT ray_id, node_id, j, tmin, tmax, n, tmin + (j + 0.5) * ((tmax - tmin) / n) AS t, (tmax - tmin) / n AS weight, ox + dx * (tmin + (j + 0.5) * ((tmax - tmin) / n)) AS x, oy + dy * (tmin + (j + 0.5) * ((tmax - tmin) / n)) AS y, oz + dz * (tmin + (j + 0.5) * ((tmax - tmin) / n)) AS z FROM parts)"
_DENS = "x * x + y * y + 0.5 * z + 1"


def hits_of(spark, sf):
    return rays.ray_node_hits(view(spark, sf, "rays"), DEPTH)


def samples_of(spark, sf):
    return rays.ray_samples(hits_of(spark, sf), DIAGONAL, 8).withColumn("value", F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * 0.5 + 1)


@query("ray_node_hits", f"WITH {_HITS} SELECT ray_id, node_id, {rnd('tmin', 'tmin')}, {rnd('tmax', 'tmax')} FROM hits")
def ray_node_hits(spark, sf):
    return hits_of(spark, sf).select("ray_id", "node_id", r6(F.col("tmin")).alias("tmin"), r6(F.col("tmax")).alias("tmax"))


@query("ray_box_hits", f"WITH {SQL['rays']}, box AS (SELECT 0 AS node_id, {', '.join(f'{d(-0.5)} AS {a}0, {d(0.5)} AS {a}1' for a in 'xyz')}), tested AS (SELECT rays.*, node_id, {_TMIN} AS tmin, {_TMAX} AS tmax FROM rays CROSS JOIN box WHERE {' AND '.join(x[2] for x in _AX)}) SELECT ray_id, {rnd('tmin', 'tmin')}, {rnd('tmax', 'tmax')} FROM tested WHERE tmin <= tmax AND tmax >= 0 AND tmax - tmin >= 1e-5")
def ray_box_hits(spark, sf):
    return rays.ray_box_hits(view(spark, sf, "rays"), *ROI).select("ray_id", r6(F.col("tmin")).alias("tmin"), r6(F.col("tmax")).alias("tmax"))


@query("ray_samples", f"WITH {_SAMPLES} SELECT ray_id, node_id, j, {rnd('t', 't')}, {rnd('weight', 'weight')}, {rnd('x', 'x')}, {rnd('y', 'y')}, {rnd('z', 'z')} FROM samples")
def ray_samples(spark, sf):
    s = samples_of(spark, sf)
    return s.select("ray_id", "node_id", "j", *[r6(F.col(c)).alias(c) for c in ("t", "weight", "x", "y", "z")])


@query("sample_offsets", f"WITH {_HITS}, n AS (SELECT ray_id, node_id, tmin, {_N} AS n FROM hits) SELECT ray_id, node_id, n, CAST(coalesce(sum(n) OVER (PARTITION BY ray_id ORDER BY tmin, node_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM n")
def sample_offsets(spark, sf):
    return rays.sample_offsets(hits_of(spark, sf), DIAGONAL, 8).select("ray_id", "node_id", "n", "first")


@query("half_interval_weights", f"WITH {_SAMPLES} SELECT ray_id, node_id, j, round(coalesce((lead(t) OVER w + t) / 2, tmax) - coalesce((lag(t) OVER w + t) / 2, tmin), 6) + {d(0)} AS weight FROM samples WINDOW w AS (PARTITION BY ray_id, node_id ORDER BY j)")
def half_interval_weights(spark, sf):
    s = samples_of(spark, sf).drop("weight").join(hits_of(spark, sf).select("ray_id", "node_id", "tmin", "tmax"), ["ray_id", "node_id"])
    return rays.half_interval_weights(s).select("ray_id", "node_id", "j", r6(F.col("weight")).alias("weight"))


@query("ray_integral", f"WITH {_SAMPLES} SELECT rays.ray_id, round(coalesce(sum(weight), 0), 6) + {d(0)} AS path, round(coalesce(sum(weight * ({_DENS})), 0), 6) + {d(0)} AS integral FROM rays LEFT JOIN samples ON rays.ray_id = samples.ray_id GROUP BY rays.ray_id")
def ray_integral(spark, sf):
    r = view(spark, sf, "rays")
    s = samples_of(spark, sf).groupBy("ray_id").agg(F.sum("weight").alias("p"), F.sum(F.col("weight") * F.col("value")).alias("v"))
    zero = F.lit(0.0)
    return r.select("ray_id").join(s, "ray_id", "left").select("ray_id", r6(F.coalesce("p", zero)).alias("path"), r6(F.coalesce("v", zero)).alias("integral"))


@query("ray_bound_ratio", f"WITH {_SAMPLES} SELECT ray_id, round(sum(CASE WHEN x > 0 THEN weight * ({_DENS}) ELSE 0 END), 6) + {d(0)} AS integral, round(CASE WHEN sum(weight) > 0 THEN sum(CASE WHEN x > 0 THEN weight ELSE 0 END) / sum(weight) ELSE 1 END, 6) + {d(0)} AS in_by_all FROM samples GROUP BY ray_id")
def ray_bound_ratio(spark, sf):
    s = samples_of(spark, sf).withColumn("inside", F.col("x") > 0)
    return rays.integrate_bound(s, "inside").select("ray_id", r6(F.col("integral")).alias("integral"), r6(F.col("in_by_all")).alias("in_by_all"))


@query("alpha_blend", f"WITH {_SAMPLES}, a AS (SELECT ray_id, t, 1 - exp(-0.5 * ({_DENS}) * weight) AS al, x FROM samples), w AS (SELECT *, coalesce(exp(sum(ln(1 - al + 1e-10)) OVER (PARTITION BY ray_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS tr FROM a) SELECT ray_id, round(sum(al * tr * x), 6) + {d(0)} AS blended FROM w GROUP BY ray_id")
def alpha_blend(spark, sf):
    return rays.alpha_blend(samples_of(spark, sf), "value", "x", 0.5).select("ray_id", r6(F.col("blended")).alias("blended"))


_ACTIVE = f"{_NODES}, active AS (SELECT node_id FROM counted WHERE depth = 1 AND node_id <> 3 UNION ALL SELECT node_id FROM counted WHERE parent_id = 3)"


def active_nodes(spark):
    nodes = tree.full_tree(spark, DEPTH)
    return nodes.where("(depth = 1 and node_id <> 3) or parent_id = 3")


@query("point_node", f"WITH {_ACTIVE}, p AS (SELECT *, {leaf_sql(DEPTH)} AS leaf FROM points) SELECT point_id, CASE WHEN leaf IN (SELECT node_id FROM active) THEN leaf WHEN leaf IS NOT NULL THEN 1 + ((leaf - {START}) >> 3) END AS active_node FROM p")
def point_node(spark, sf):
    return points.locate(view(spark, sf, "points"), active_nodes(spark), DEPTH).select("point_id", "active_node")


@query("point_node_boundary", f"WITH {SQL['points_li']} SELECT {leaf_sql(DEPTH)} AS node_id, count(*) AS n, round(sum(value), 2) + {d(0)} AS total FROM points_li GROUP BY 1")
def point_node_boundary(spark, sf):
    return view(spark, sf, "points_li").groupBy(points.leaf_key(DEPTH).alias("node_id")).agg(F.count(F.lit(1)).alias("n"), (F.round(F.sum("value"), 2) + F.lit(0.0)).alias("total"))


@query("node_offsets", f"WITH {SQL['points']}, c AS (SELECT {leaf_sql(DEPTH)} AS node_id, count(*) AS n FROM points GROUP BY 1) SELECT node_id, n, CAST(ceil(n / {d(64)}) AS BIGINT) * 64 AS padded, CAST(coalesce(sum(CAST(ceil(n / {d(64)}) AS BIGINT) * 64) OVER (ORDER BY node_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM c WHERE node_id IS NOT NULL")
def node_offsets(spark, sf):
    p = view(spark, sf, "points").withColumn("node_id", points.leaf_key(DEPTH)).where("node_id is not null")
    return points.group_offsets(p, 64).select("node_id", "n", "padded", "first")


@query("row_in_node", f"WITH {SQL['points']} SELECT point_id, {leaf_sql(DEPTH)} AS node_id, row_number() OVER (PARTITION BY {leaf_sql(DEPTH)} ORDER BY point_id) - 1 AS place FROM points WHERE {leaf_sql(DEPTH)} IS NOT NULL")
def row_in_node(spark, sf):
    p = view(spark, sf, "points").withColumn("node_id", points.leaf_key(DEPTH)).where("node_id is not null")
    return points.row_in_node(p, ["point_id"]).select("point_id", "node_id", F.col("place").cast("long").alias("place"))


_BUSY = f"WITH {_NODES}, busy AS (SELECT node_id FROM counted WHERE depth = 2 AND {_ROI}) SELECT point_id FROM points WHERE coalesce({leaf_sql(DEPTH)}, -1)"


def in_or_out(spark, sf, inside):
    p = view(spark, sf, "points").withColumn("node_id", F.coalesce(points.leaf_key(DEPTH), F.lit(-1)))
    ids = tree.full_tree(spark, DEPTH).where((F.col("depth") == DEPTH) & in_roi(*ROI))
    return points.in_nodes(p, ids, inside).select("point_id")


@query("roi_semi", f"{_BUSY} IN (SELECT node_id FROM busy)")
def roi_semi(spark, sf):
    return in_or_out(spark, sf, True)


@query("roi_anti", f"{_BUSY} NOT IN (SELECT node_id FROM busy)")
def roi_anti(spark, sf):
    return in_or_out(spark, sf, False)


@query("local_coords", f"WITH {SQL['points']}, {tree_sql('leaf', DEPTH)} SELECT point_id, {', '.join(rnd(f'(p.{a} - {a}0) / ({a}1 - {a}0) * 2 - 1', f'l{a}') for a in 'xyz')} FROM (SELECT *, {leaf_sql(DEPTH)} AS leaf FROM points) p JOIN leaf ON p.leaf = leaf.node_id")
def local_coords(spark, sf):
    p = view(spark, sf, "points").withColumn("node_id", points.leaf_key(DEPTH))
    nodes = tree.full_tree(spark, DEPTH).where(F.col("depth") == DEPTH)
    return points.local_coordinates(p.select("point_id", "x", "y", "z", "node_id"), nodes).select("point_id", *[r6(F.col(f"l{a}")).alias(f"l{a}") for a in "xyz"])


@query("delinearize", f"WITH {SQL['points']} SELECT point_id, point_id % 7 AS ix, (point_id // 7) % 5 AS iy, (point_id // 35) % 3 AS iz FROM points")
def delinear(spark, sf):
    a, b, c = delinearize(F.col("point_id"), (7, 5, 3))
    return view(spark, sf, "points").select("point_id", a.alias("ix"), b.alias("iy"), c.alias("iz"))


_GRID = "(SELECT point_id, x, y, z, unnest(range(8)) AS c FROM points)"


@query("node_grid", f"WITH {SQL['points']}, {tree_sql('leaf', DEPTH)}, used AS (SELECT DISTINCT {leaf_sql(DEPTH)} AS node_id FROM points), g AS (SELECT leaf.*, unnest(range(27)) AS c FROM leaf JOIN used ON leaf.node_id = used.node_id) SELECT node_id, c, x0 + (c % 3) / {d(2)} * (x1 - x0) AS x, y0 + ((c // 3) % 3) / {d(2)} * (y1 - y0) AS y, z0 + (c // 9) / {d(2)} * (z1 - z0) AS z FROM g")
def node_grid(spark, sf):
    used = view(spark, sf, "points").select(points.leaf_key(DEPTH).alias("node_id")).distinct()
    nodes = tree.full_tree(spark, DEPTH).where(F.col("depth") == DEPTH).join(used, "node_id")
    g = nodes.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(26).cast("long"))))
    cells = delinearize(F.col("c"), (3, 3, 3))
    return g.select("node_id", "c", *[(F.col(f"{a}0") + i / 2 * (F.col(f"{a}1") - F.col(f"{a}0"))).alias(a) for a, i in zip("xyz", cells, strict=True)])


_NB = " UNION ALL ".join(f"SELECT point_id, '{a}' AS axis, {leaf_sql(DEPTH, *[f'({b} - {d(0.05)})' if a == b else b for b in 'xyz'])} AS n0, {leaf_sql(DEPTH, *[f'({b} + {d(0.05)})' if a == b else b for b in 'xyz'])} AS n1 FROM points" for a in "xyz")


def pairs_of(spark, sf):
    return points.face_neighbours(view(spark, sf, "points"), DEPTH, 0.05)


@query("neighbor_pairs", f"WITH {SQL['points']}, p AS ({_NB}), q AS (SELECT * FROM p WHERE n0 <> n1) SELECT point_id, axis, 0 AS side, n0 AS node_id FROM q UNION ALL SELECT point_id, axis, 1, n1 FROM q")
def neighbor_pairs(spark, sf):
    return pairs_of(spark, sf).select("point_id", "axis", "side", "node_id")


@query("edge_loss", f"WITH {SQL['points']}, p AS ({_NB}), q AS (SELECT * FROM p WHERE n0 <> n1) SELECT round(sqrt(avg((n0 % 10 / {d(10)} - n1 % 10 / {d(10)}) * (n0 % 10 / {d(10)} - n1 % 10 / {d(10)}))), 6) AS edge_loss, count(*) AS pairs FROM q")
def edge_loss(spark, sf):
    p = pairs_of(spark, sf).withColumn("feature", F.col("node_id") % 10 / 10)
    return metrics.edge_loss(p).select(r6(F.col("edge_loss")).alias("edge_loss"), "pairs")


_FLAGS = f"{_NODES}, flagged AS (SELECT *, depth = 2 AND n % 3 <> 0 AS gone, depth = 2 AND n % 3 = 0 AS alive, n / {d(100)} AS error FROM counted)"


def flagged(spark, sf):
    c = counted(spark, sf)
    leaf = F.col("depth") == DEPTH
    return c.withColumn("culled", leaf & (F.col("n") % 3 != 0)).withColumn("active", leaf & (F.col("n") % 3 == 0)).withColumn("error", F.col("n") / 100)


@query("cull_fixpoint", f"WITH {_FLAGS}, l1 AS (SELECT parent_id AS p, bool_and(gone) AS gone FROM flagged WHERE depth = 2 GROUP BY 1), l0 AS (SELECT bool_and(gone) AS gone FROM l1) SELECT node_id, CASE depth WHEN 2 THEN flagged.gone WHEN 1 THEN l1.gone ELSE l0.gone END AS culled, round(CASE WHEN CASE depth WHEN 2 THEN flagged.gone WHEN 1 THEN l1.gone ELSE l0.gone END THEN 0 ELSE error END, 6) + {d(0)} AS error FROM flagged LEFT JOIN l1 ON flagged.node_id = l1.p CROSS JOIN l0")
def cull_fixpoint(spark, sf):
    out = tree.cull_fixpoint(flagged(spark, sf), DEPTH)
    return tree.update_active(out.withColumn("active", F.col("active") & ~F.col("culled"))).select("node_id", "culled", r6(F.col("error")).alias("error"))


@query("error_override", f"WITH {_FLAGS}, e AS (SELECT {leaf_sql(DEPTH)} AS node_id, avg(value) AS error FROM points GROUP BY 1) SELECT flagged.node_id, round(CASE WHEN alive THEN coalesce(e.error, flagged.error) ELSE flagged.error END, 6) + {d(0)} AS replaced, round(CASE WHEN alive THEN least(flagged.error, coalesce(e.error, 1e6)) ELSE flagged.error END, 6) + {d(0)} AS least_error FROM flagged LEFT JOIN e ON flagged.node_id = e.node_id")
def error_override(spark, sf):
    nodes = flagged(spark, sf)
    e = view(spark, sf, "points").groupBy(points.leaf_key(DEPTH).alias("node_id")).agg(F.avg("value").alias("error"))
    a = tree.set_errors(nodes, e, "override").select("node_id", r6(F.col("error")).alias("replaced"))
    b = tree.set_errors(nodes, e, "min").select("node_id", r6(F.col("error")).alias("least_error"))
    return a.join(b, "node_id")


@query("roi_errors", f"WITH {_FLAGS} SELECT node_id, round(CASE WHEN {_ROI} THEN error ELSE 0 END, 6) + {d(0)} AS kept, CASE WHEN {_ROI} THEN {d(1e6)} ELSE {d(0)} END AS pushed FROM flagged")
def roi_errors(spark, sf):
    nodes = flagged(spark, sf)
    a = tree.roi_errors(nodes, *ROI).select("node_id", r6(F.col("error")).alias("kept"))
    return a.join(tree.roi_errors(nodes, *ROI, push=True).select("node_id", F.col("error").alias("pushed")), "node_id")


@query("density_culling", f"WITH {_FLAGS} SELECT node_id, alive AND NOT (n < 150 AND NOT ({_ROI})) AS active, gone OR (alive AND n < 150 AND NOT ({_ROI})) AS culled FROM flagged")
def density_culling(spark, sf):
    nodes = flagged(spark, sf).withColumn("max_density", F.col("n").cast("double"))
    return tree.cull_by_density(nodes, 150.0, *ROI).select("node_id", "active", "culled")


@query("apply_split", f"WITH {_FLAGS}, act AS (SELECT node_id, parent_id, n % 2 = 0 AS split FROM flagged WHERE depth = 1) SELECT node_id, CASE WHEN depth = 2 THEN NOT gone AND parent_id IN (SELECT node_id FROM act WHERE node_id % 2 = 0) WHEN depth = 1 THEN node_id % 2 = 1 ELSE false END AS active FROM flagged")
def apply_split(spark, sf):
    nodes = flagged(spark, sf).withColumn("active", F.col("depth") == 1)
    plan = nodes.where("active").select("node_id", F.when(F.col("node_id") % 2 == 0, "split").otherwise("none").alias("action"))
    return tree.apply_plan(nodes, plan).select("node_id", "active")


#: Nodes that the plans below may use.
PLAN_BUDGET = 90
_PLAN = f"""leaves AS (SELECT node_id, parent_id AS family, round(coalesce(e.error, 0), 6) AS error, coalesce(e.n, 0) / {d(1000)} AS dens FROM counted LEFT JOIN (SELECT {leaf_sql(DEPTH)} AS at, avg(value) AS error, count(*) AS n FROM points GROUP BY 1) e ON node_id = e.at WHERE depth = {DEPTH})"""


def plan_options(spark, sf):
    """Options of the leaves of the counted tree, which stands on a full one a level deeper."""
    deeper = tree.full_tree(spark, DEPTH + 1).select("node_id", "parent_id", (F.col("depth") == DEPTH).alias("active"), F.lit(False).alias("culled"), (F.col("depth") > DEPTH).alias("leaf"))
    dens = view(spark, sf, "points").select(points.leaf_key(DEPTH).alias("node_id"), "value").groupBy("node_id").agg(F.round(F.avg("value"), 6).alias("error"), (F.count(F.lit(1)) / 1000).alias("max_density"))
    return evolve.family_options(deeper.join(dens, "node_id", "left").fillna(0.0, ["error", "max_density"]))


@query("structure_plan")
def structure_plan(spark, sf):
    """Exact split and merge of the tree's leaves under a budget of nodes (held against brute force in the tests)."""
    return evolve.plan(plan_options(spark, sf), PLAN_BUDGET, block=4, fan_in=4)


@query("plan_value", f"""WITH RECURSIVE {_NODES}, {_PLAN},
  gains AS (SELECT family, error * dens AS keep, row_number() OVER (PARTITION BY family ORDER BY error * dens DESC, node_id) AS k FROM leaves),
  ways AS (SELECT family, 8 + 7 * k AS cost, sum(keep) OVER (PARTITION BY family) - 0.25::DOUBLE * sum(keep) OVER (PARTITION BY family ORDER BY k) AS value FROM gains
    UNION ALL SELECT family, 8, sum(keep) FROM gains GROUP BY 1
    UNION ALL SELECT family, 1, 1.1::DOUBLE * sum(greatest(error, 0)) * max(dens) FROM leaves GROUP BY 1),
  families AS (SELECT dense_rank() OVER (ORDER BY family) AS k, cost, value FROM ways),
  r(k, cost, value) AS (SELECT 0::BIGINT, 0::BIGINT, 0::DOUBLE UNION ALL SELECT n.k, r.cost + n.cost, min(r.value + n.value) FROM r JOIN families AS n ON n.k = r.k + 1 WHERE r.cost + n.cost <= {PLAN_BUDGET} GROUP BY 1, 2)
  SELECT round(min(value), 6) + {d(0)} AS value, (SELECT count(*) FROM leaves) AS nodes, true AS fits FROM r WHERE k = (SELECT max(k) FROM families)""")
def plan_value(spark, sf):
    options = plan_options(spark, sf)
    done = evolve.plan(options, PLAN_BUDGET, block=4, fan_in=4).join(options, "node_id")
    cost = F.when(F.col("action") == "split", F.col("split_cost")).when(F.col("action") == "none", 1).otherwise(0)
    value = F.when(F.col("action") == "split", F.col("split_value")).when(F.col("action") == "none", F.col("none_value")).otherwise(0.0)
    merged = F.max(F.when(F.col("action") == "merge", F.col("merge_value")))
    family = done.groupBy("parent_id").agg((F.sum(value) + F.coalesce(merged, F.lit(0.0))).alias("value"), (F.sum(cost) + F.when(merged.isNull(), 0).otherwise(1)).alias("cost"), F.count(F.lit(1)).alias("n"))
    return family.agg(r6(F.sum("value")).alias("value"), F.sum("n").alias("nodes"), (F.sum("cost") <= PLAN_BUDGET).alias("fits"))

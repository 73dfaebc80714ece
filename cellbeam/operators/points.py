"""Point location by Morton key, grouping by node and neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import AXES
from .batches import range_of
from .tree import boxes, level_start, morton_of

#: Node tables up to this many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_NODES = 500_000


def leaf_key(depth: int, quad: bool = False, point: tuple[str, ...] = AXES, y: tuple[float, float] = (-1.0, 1.0)) -> Column:
    """Node id at a level for a point in closed boxes; on a shared side the lower cell wins, outside is NULL."""
    n = 1 << depth
    cells, inside = {}, None
    for p, a in zip(point, AXES, strict=True):
        c = F.col(p)
        lo, hi = (y if quad and a == "y" else (-1.0, 1.0))
        ok = c.between(lo, hi)
        inside = ok if inside is None else inside & ok
        cells[a] = F.greatest(F.ceil((c + 1.0) * (n / 2.0)).cast("long") - 1, F.lit(0).cast("long"))
    return F.when(inside, morton_of(cells, depth, quad) + level_start(depth, 4 if quad else 8))


def ancestors(node_id: Column, depth: int, fan: int = 8) -> Column:
    """Ids of a node of level ``depth`` and of all nodes above it, nearest first."""
    m = node_id - level_start(depth, fan)
    return F.array(*[F.floor(m / fan**k).cast("long") + level_start(depth - k, fan) for k in range(depth + 1)])


def locate(points: DataFrame, active: DataFrame, depth: int, key: str = "point_id", **kw) -> DataFrame:
    """Adds ``active_node``, the active node that holds each point (NULL if none; the deepest of several).

    The ancestors of a point's leaf are looked up level by level in a broadcast table, so points stay where they
    are. Beyond ``BROADCAST_NODES`` nodes, the distinct leaves of the points are explained once by a join of
    their ancestors with the nodes, and points get their leaf's answer by a second one.
    """
    ids = active.select("node_id").distinct()
    up = ancestors(leaf_key(depth, **kw), depth, 4 if kw.get("quad") else 8)
    if ids.count() <= BROADCAST_NODES:
        out = points.withColumn("__up", up)
        for k in range(depth + 1):
            out = out.withColumn(f"__a{k}", F.col("__up")[k]).join(F.broadcast(ids.withColumnRenamed("node_id", f"__n{k}")), F.col(f"__a{k}") == F.col(f"__n{k}"), "left")
        return out.select(*points.columns, F.coalesce(*[F.col(f"__n{k}") for k in range(depth + 1)]).alias("active_node"))
    placed = points.withColumn("__up", up).withColumn("__leaf", F.col("__up")[0])
    leaves = placed.where("__leaf is not null").groupBy("__leaf").agg(F.first("__up").alias("__up")).select(F.col("__leaf").alias("__of"), F.explode("__up").alias("node_id"))
    found = leaves.join(ids, "node_id").groupBy("__of").agg(F.max("node_id").alias("active_node"))
    return placed.join(found, F.col("__leaf") == F.col("__of"), "left").select(*points.columns, "active_node")


def local_coordinates(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds lx, ly, lz in [-1, 1] inside the node of each point."""
    j = points.join(nodes.select("node_id", *[f"{a}{k}" for a in AXES for k in (0, 1)]), "node_id")
    return j.select(*points.columns, *[((F.col(a) - F.col(f"{a}0")) / (F.col(f"{a}1") - F.col(f"{a}0")) * 2 - 1).alias(f"l{a}") for a in AXES])


def group_offsets(points: DataFrame, group_size: int, node: str = "node_id") -> DataFrame:
    """``n, padded, first`` per node: its count, that count padded to whole groups, and where its groups start.

    Only the node counts, bounded by the node budget, are put in one order.
    """
    n = points.groupBy(node).agg(F.count(F.lit(1)).alias("n")).withColumn("padded", (F.ceil(F.col("n") / group_size) * group_size).cast("long"))
    w = W.orderBy(node).rowsBetween(W.unboundedPreceding, -1)
    return n.withColumn("first", F.coalesce(F.sum("padded").over(w), F.lit(0)))


def row_in_node(points: DataFrame, order: list[str], node: str = "node_id") -> DataFrame:
    """Adds ``place`` from 0 by ``order`` inside each node, counted in ranges of the first (numeric) order column.

    No task sorts a whole node: a node's ranges are counted first, then shifted by the counts before them.
    """
    cut = range_of(points, order[0])
    r = points.withColumn("__range", cut)
    counts = r.groupBy(node, "__range").agg(F.count(F.lit(1)).alias("__c"))
    base = counts.select(F.col(node).alias("__node"), F.col("__range").alias("__b"), (F.sum("__c").over(W.partitionBy(node).orderBy("__range")) - F.col("__c")).alias("__base"))
    placed = r.withColumn("__r", F.row_number().over(W.partitionBy(node, "__range").orderBy(*order)) - 1)
    j = placed.join(base, placed[node].eqNullSafe(F.col("__node")) & (placed["__range"] == F.col("__b")))
    return j.select(*points.columns, (F.col("__r") + F.col("__base")).alias("place"))


def in_nodes(points: DataFrame, ids: DataFrame, inside: bool = True, node: str = "node_id") -> DataFrame:
    """Rows whose node is (not) in the list."""
    return points.join(ids.select(node).distinct(), node, "left_semi" if inside else "left_anti")


def face_neighbours(points: DataFrame, depth: int, eps: float, axes: tuple[str, ...] = AXES, key: str = "point_id", **kw) -> DataFrame:
    """Two rows (one per node) for each point and axis where the points eps before and behind lie in different nodes."""
    out = None
    for a in axes:
        moved = points.select(key, *AXES, *[(F.col(b) + (s * eps if a == b else 0.0)).alias(f"{n}{b}") for n, s in (("p", -1), ("q", 1)) for b in AXES])
        p = moved.select(key, *AXES, F.lit(a).alias("axis"), leaf_key(depth, point=("px", "py", "pz"), **kw).alias("n0"), leaf_key(depth, point=("qx", "qy", "qz"), **kw).alias("n1")).where("n0 <> n1")
        out = p if out is None else out.unionByName(p)
    return out.select(key, "axis", *AXES, F.posexplode(F.array("n0", "n1")).alias("side", "node_id"))


def fill_inactive(inactive: DataFrame, active: DataFrame, known: DataFrame, depth: int, size: int) -> DataFrame:
    """``node_id, iz, iy, ix, value`` for all cells of inactive nodes, from the nearest cell of the active node there.

    ``inactive``: node_id, x0..z1; ``active``: node_id, depth (of any level down to ``depth``); ``known``: node_id,
    iz, iy, ix, value of active nodes' grids of ``size`` cells per axis, ends included. A cell's place is looked up
    among the active nodes; where none holds it, or its grid lacks the cell, the value is NULL.
    """
    cells = inactive.select("node_id", *[f"{a}{k}" for a in AXES for k in (0, 1)], F.explode(F.sequence(F.lit(0), F.lit(size**3 - 1))).alias("cell"))
    number = {"x": F.col("cell") % size, "y": F.floor(F.col("cell") / size).cast("int") % size, "z": F.floor(F.col("cell") / (size * size)).cast("int")}
    cells = cells.select("node_id", *[n.alias(f"i{a}") for a, n in number.items()], *[(F.col(f"{a}0") + n / (size - 1) * (F.col(f"{a}1") - F.col(f"{a}0"))).alias(a) for a, n in number.items()])
    found = locate(cells, active, depth, "node_id").join(active.select(F.col("node_id").alias("active_node"), F.col("depth").alias("__d")), "active_node", "left")
    nearest = {a: None for a in AXES}
    for d in range(depth + 1):
        box = boxes(F.col("active_node") - level_start(d), d)
        for k, a in enumerate(AXES):
            at = F.round((F.col(a) - box[2 * k]) / (box[2 * k + 1] - box[2 * k]) * (size - 1)).cast("int")
            nearest[a] = F.when(F.col("__d") == d, at) if nearest[a] is None else nearest[a].when(F.col("__d") == d, at)
    found = found.select("node_id", "active_node", *[f"i{a}" for a in AXES], *[c.alias(f"s{a}") for a, c in nearest.items()])
    source = known.select(F.col("node_id").alias("active_node"), *[F.col(f"i{a}").alias(f"s{a}") for a in AXES], "value")
    return found.join(source, ["active_node", *[f"s{a}" for a in AXES]], "left").select("node_id", "iz", "iy", "ix", "value")

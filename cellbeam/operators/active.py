"""The active nodes of an adaptive tree, which stand on several levels: rays, samples, densities and faces on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import AXES, in_roi
from .points import BROADCAST_NODES, ancestors, locate
from .rays import RAY, ray_samples
from .tree import cell_of, level_start, morton_of


def level_of(node: Column, depth: int, fan: int = 8) -> Column:
    """Level of a node id, from where levels start; ``depth`` is the deepest."""
    return reduce(lambda p, q: p + q, [(node >= level_start(k, fan)).cast("int") for k in range(1, depth + 1)], F.lit(0))


def start_of(level: Column, depth: int, fan: int = 8) -> Column:
    """First node id of a level."""
    return F.element_at(F.array(*[F.lit(level_start(k, fan)).cast("long") for k in range(depth + 1)]), level + 1)


def node_box(node: Column, depth: int, quad: bool = False, y: tuple[float, float] = (-1.0, 1.0)) -> dict[str, Column]:
    """x0..z1 of a node of any level down to ``depth``, from its id alone."""
    fan = 4 if quad else 8
    level = level_of(node, depth, fan)
    cells = cell_of(node - start_of(level, depth, fan), depth, quad)
    width = F.pow(F.lit(2.0), 1 - level)
    out = {}
    for a in AXES:
        flat = quad and a == "y"
        out[f"{a}0"] = F.lit(y[0]) if flat else cells[a] * width - 1.0
        out[f"{a}1"] = F.lit(y[1]) if flat else (cells[a] + 1) * width - 1.0
    return out


def node_diagonal(node: Column, depth: int, quad: bool = False, y: tuple[float, float] = (-1.0, 1.0)) -> Column:
    """Length of a node's diagonal."""
    width = F.pow(F.lit(2.0), 1 - level_of(node, depth, 4 if quad else 8))
    return F.sqrt(width * width * 2 + (y[1] - y[0]) ** 2) if quad else width * 3.0**0.5


def local_in(node: str, depth: int, **kw) -> dict[str, Column]:
    """Coordinates in [-1, 1] of x, y, z inside the node that a column names."""
    box = node_box(F.col(node), depth, **kw)
    return {a: (F.col(a) - box[f"{a}0"]) / (box[f"{a}1"] - box[f"{a}0"]) * 2 - 1 for a in AXES}


def covering(active: DataFrame, depth: int, fan: int = 8) -> DataFrame:
    """``node_id, active`` of the active nodes and of all nodes above them. Below an active node nothing counts."""
    level = level_of(F.col("node_id"), depth, fan)
    up = [F.when(level == k, ancestors(F.col("node_id"), k, fan)) for k in range(depth + 1)]
    every = active.select(F.col("node_id").alias("__own"), F.explode(F.coalesce(*up)).alias("node_id"))
    return every.groupBy("node_id").agg(F.max(F.col("node_id") == F.col("__own")).alias("active"))


def ray_active_hits(rays: DataFrame, active: DataFrame, depth: int, quad: bool = False, y: tuple[float, float] = (-1.0, 1.0), min_length: float = 1e-5) -> DataFrame:
    """``ray_id.., node_id, tmin, tmax`` of every ray and every active node that it crosses, nodes of all levels together.

    Rays go down the tree. At each level a part of a ray is cut at its node's middle planes, at most into four, and
    each piece is looked up among the active nodes and those above them: it has arrived, goes on, or is in a gap and
    goes. A ray costs what it crosses. The node table, bounded by the node budget, is broadcast; a larger one than
    ``BROADCAST_NODES`` is joined by a shuffle of the pieces at each level. Rules of directions, lengths and
    origins are those of ``ray_node_hits``.
    """
    fan = 4 if quad else 8
    table = covering(active.select("node_id"), depth, fan).select(F.col("node_id").alias("__node"), F.col("active").alias("__active"))
    table = F.broadcast(table) if table.count() <= BROADCAST_NODES else table
    ends = {a: y if quad and a == "y" else (-1.0, 1.0) for a in AXES}
    near, far, inside = [], [], F.lit(True)
    for a, (lo, hi) in ends.items():
        o, d = F.col(f"o{a}"), F.col(f"d{a}")
        t0, t1 = (lo - o) / F.nullif(d, F.lit(0.0)), (hi - o) / F.nullif(d, F.lit(0.0))
        near.append(F.coalesce(F.least(t0, t1), F.lit(-1e30)))
        far.append(F.coalesce(F.greatest(t0, t1), F.lit(1e30)))
        inside = inside & ((d != 0) | ((o >= lo) & (o < hi)))
    long = (F.col("tmax") - F.col("tmin") >= min_length) & (F.col("tmax") >= 0)
    zero = [F.lit(0).cast("long").alias(f"c{a}") for a in AXES]
    at = rays.where(inside).select(*RAY, F.greatest(*near).alias("tmin"), F.least(*far).alias("tmax"), *zero, F.lit(0).cast("long").alias("node_id")).where(long)
    for k in range(depth + 1):
        at = at.join(table, F.col("node_id") == F.col("__node")).drop("__node")
        if k == depth:
            break
        width = 2.0 / (1 << k)
        middle = {a: F.lit(-1.0) + (F.col(f"c{a}") + 0.5) * width for a in AXES if not (quad and a == "y")}
        cuts = [F.when((t > F.col("tmin")) & (t < F.col("tmax")), t) for t in ((m - F.col(f"o{a}")) / F.nullif(F.col(f"d{a}"), F.lit(0.0)) for a, m in middle.items())]
        at = at.withColumn("t", F.when(F.col("__active"), F.array("tmin", "tmax")).otherwise(F.array_sort(F.array_compact(F.array("tmin", *cuts, "tmax")))))
        pieces = F.transform(F.sequence(F.lit(1), F.size("t") - 1), lambda i: F.struct(F.element_at("t", i).alias("tmin"), F.element_at("t", i + 1).alias("tmax")))
        at = at.select(*RAY, *[f"c{a}" for a in AXES], "node_id", "__active", F.explode(pieces).alias("p")).select("*", "p.tmin", "p.tmax").drop("p").where(long)
        half = (F.col("tmin") + F.col("tmax")) / 2
        child = {a: F.col(f"c{a}") * 2 + (F.col(f"o{a}") + F.col(f"d{a}") * half >= middle[a]).cast("long") if a in middle else F.col(f"c{a}") for a in AXES}
        at = at.select(*RAY, "tmin", "tmax", "__active", "node_id", *[F.when(F.col("__active"), F.col(f"c{a}")).otherwise(c).alias(f"c{a}") for a, c in child.items()])
        below = morton_of({a: F.col(f"c{a}") for a in AXES}, k + 1, quad) + level_start(k + 1, fan)
        at = at.withColumn("node_id", F.when(F.col("__active"), F.col("node_id")).otherwise(below)).drop("__active")
    return at.where("__active").select(*RAY, "node_id", "tmin", "tmax")


def ray_active_samples(hits: DataFrame, depth: int, per_diagonal: int = 32, jitter=None, **kw) -> DataFrame:
    """``ray_samples`` of hits on nodes of several levels: each node's own diagonal decides how many samples it gets."""
    return ray_samples(hits, node_diagonal(F.col("node_id"), depth, **kw), per_diagonal, jitter)


def active_faces(nodes: DataFrame, depth: int, size: int, eps: float, axes: tuple[str, ...] = AXES, quad: bool = False, y: tuple[float, float] = (-1.0, 1.0), roi: tuple | None = None) -> DataFrame:
    """Two rows, one per node, for each place on a face of an active node behind which another active node stands.

    ``owner, axis, front, k, x, y, z, side, node_id``: every face across ``axes`` carries a lattice of ``size`` times
    ``size`` places, edges included; ``side`` 0 is the owner, 1 the node that holds the place moved ``eps`` outward,
    of any level. With ``roi`` (lower and upper ends) both must touch that region. Nodes are bounded by the node
    budget, so places are too; they are looked up where they are.
    """
    kw = {"quad": quad, "y": y}
    box = node_box(F.col("owner"), depth, **kw)
    own = nodes.select(F.col("node_id").alias("owner"))
    # exploded from an array of one, so that each box is made once and not anew in all that follows
    own = own.select("owner", F.explode(F.array(F.struct(*[c.alias(n) for n, c in box.items()]))).alias("b")).select("owner", "b.*")
    if roi:
        own = own.where(in_roi(*roi))
    places = None
    for a in axes:
        b, c = AXES[(AXES.index(a) + 1) % 3], AXES[(AXES.index(a) + 2) % 3]
        for front in (0, 1):
            k = F.col("k")
            share = {b: (k % size) / (size - 1), c: F.floor(k / size) / (size - 1)}
            at = own.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(size * size - 1))))
            spot = {n: F.col(f"{n}{front}") if n == a else F.col(f"{n}0") + share[n] * (F.col(f"{n}1") - F.col(f"{n}0")) for n in AXES}
            at = at.select("owner", F.lit(a).alias("axis"), F.lit(front).alias("front"), "k", *[s.alias(n) for n, s in spot.items()])
            at = at.select("*", *[(F.col(n) + (eps * (1 if front else -1) if n == a else 0.0)).alias(f"m{n}") for n in AXES])
            places = at if places is None else places.unionByName(at)
    found = locate(places, nodes.select("node_id"), depth, point=("mx", "my", "mz"), **kw).where("active_node <> owner")
    if roi:
        near = own.select(F.col("owner").alias("active_node"))
        found = found.join(F.broadcast(near) if near.count() <= BROADCAST_NODES else near, "active_node", "left_semi")
    return found.select("owner", "axis", "front", "k", *AXES, F.posexplode(F.array("owner", "active_node")).alias("side", "node_id"))

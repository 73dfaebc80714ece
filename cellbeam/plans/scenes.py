"""Views of the given tables as scenes, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def d(x: str | float) -> str:
    return f"CAST({x} AS DOUBLE)"


_DX, _DY, _DZ = d(1), f"({d('(o_orderkey % 13) - 6')} / {d(10)})", f"({d('(o_orderkey % 7) - 3')} / {d(10)})"
_N = f"sqrt({_DX} * {_DX} + {_DY} * {_DY} + {_DZ} * {_DZ})"
_Q = [d("s_suppkey % 5 + 1"), d("s_suppkey % 3 - 1"), d("s_suppkey % 7 - 3"), d("s_suppkey % 4 + 2")]
_QN = "sqrt(" + " + ".join(f"{q} * {q}" for q in _Q) + ")"

#: name -> (table, columns)
VIEWS = {
    "rays": ("orders", f"o_orderkey AS ray_id, {d(-1.5)} AS ox, {d('o_custkey % 101')} / {d(50)} - {d(1)} AS oy, {d('o_orderkey % 89')} / {d(44)} - {d(1)} AS oz, {_DX} / {_N} AS dx, {_DY} / {_N} AS dy, {_DZ} / {_N} AS dz, o_totalprice / {d(500000)} AS target"),
    "points": ("events", f"event_id AS point_id, user_id % 40 AS node_id, {d('user_id % 101')} / {d(50)} - {d(1)} AS x, value / {d(250)} - {d(1)} AS y, {d('event_id % 997')} / {d(498)} - {d(1)} AS z, value"),
    "points_li": ("lineitem", f"l_orderkey AS ray_id, l_quantity / {d(25.5)} - {d(1)} AS x, l_discount * {d(20)} - {d(1)} AS y, l_tax * {d(25)} - {d(1)} AS z, l_extendedprice / {d(100000)} AS value"),
    "poses": ("supplier", "s_suppkey AS image_id, " + ", ".join(f"{q} / {_QN} AS {n}" for q, n in zip(_Q, ("qx", "qy", "qz", "qw"), strict=True)) + f", s_acctbal / {d(10000)} AS tx, {d('s_nationkey')} / {d(25)} AS ty, {d('s_suppkey % 11')} / {d(11)} AS tz"),
    "cameras": ("nation", f"n_nationkey AS camera_id, {d('900 + n_nationkey')} AS fx, {d('910 + n_nationkey')} AS fy, {d('320 + n_regionkey')} AS cx, {d('240 - n_regionkey')} AS cy, {d(0)} AS s, 640 AS w, 480 AS h"),
    "pixels": ("customer", f"c_custkey AS pixel_id, c_nationkey AS camera_id, c_custkey % 10 + 1 AS image_id, {d('c_custkey % 640')} AS px, {d('c_custkey % 479')} AS py, (c_acctbal + {d(1000)}) / {d(11000)} AS target"),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns = VIEWS[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*split_columns(columns))


def split_columns(text: str) -> list[str]:
    """Top-level comma split of a select list."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(text[last:i].strip())
            last = i + 1
    return [*out, text[last:].strip()]


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as an 8 x 8 image: ``image_id, row, col, value, label``."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    x = e.selectExpr("vec_id AS image_id", "label", "posexplode(embedding) AS (pos, v)")
    return x.selectExpr("image_id", "CAST(floor(pos / 8) AS INT) AS row", "pos % 8 AS col", "CAST(v AS DOUBLE) AS value", "label")


#: The same views for DuckDB, to stand after WITH.
SQL = {name: f"{name} AS (SELECT {columns} FROM {table})" for name, (table, columns) in VIEWS.items()}
SQL["images"] = 'images AS (SELECT image_id, CAST(floor(pos / 8) AS INT) AS "row", CAST(pos % 8 AS INT) AS col, CAST(v AS DOUBLE) AS "value", label FROM (SELECT vec_id AS image_id, label, unnest(embedding) AS v, unnest(range(len(embedding))) AS pos FROM embeddings))'


def tree_sql(name: str, depth: int, quad: bool = False) -> str:
    """A full tree's level ``depth`` for DuckDB: node_id, parent_id, morton, x0..z1."""
    k, axes = (2, "xz") if quad else (3, "xyz")
    fan = 1 << k
    start = (fan**depth - 1) // (fan - 1)
    up = (fan ** (depth - 1) - 1) // (fan - 1) if depth else 0
    cell = {a: " + ".join([f"((m >> {k * b + i}) & 1) * {1 << b}" for b in range(depth)] or ["0"]) for i, a in enumerate(axes)}
    w = 2.0 / (1 << depth)
    cols = []
    for a in "xyz":
        cols += [f"({cell[a]}) * {d(w)} - {d(1)} AS {a}0, ({cell[a]} + 1) * {d(w)} - {d(1)} AS {a}1"] if a in cell else [f"{d(-1)} AS {a}0, {d(1)} AS {a}1"]
    parent = f"{up} + (m >> {k})" if depth else "NULL"
    return f"{name} AS (SELECT {start} + m AS node_id, {parent} AS parent_id, {depth} AS depth, m AS morton, {', '.join(cols)} FROM (SELECT \"range\" AS m FROM range({fan**depth})))"


def leaf_sql(depth: int, x: str = "x", y: str = "y", z: str = "z") -> str:
    """Node id of a point at a level, NULL outside, for DuckDB."""
    n = 1 << depth
    start = (8**depth - 1) // 7
    cells = [f"greatest(CAST(ceil(({c} + {d(1)}) * {d(n / 2)}) AS BIGINT) - 1, 0)" for c in (x, y, z)]
    bits = " + ".join(f"((({c} >> {b}) & 1) * {1 << (3 * b + i)})" for b in range(depth) for i, c in enumerate(cells))
    inside = " AND ".join(f"{c} BETWEEN -1 AND 1" for c in (x, y, z))
    return f"CASE WHEN {inside} THEN {start} + {bits} END"


def uniform_sql(seed: int, *keys: str) -> str:
    """``keyed_uniform`` for DuckDB; keys are SQL."""
    return f"(CAST('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(keys)})), 1, 13) AS BIGINT) / {d(float(1 << 52))})"

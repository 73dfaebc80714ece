"""Near duplicates among embeddings by lattice hashing.

Random projections of the unit vectors, eight numbers at a time, are decoded to points of the lattice E8; a table's
cell is made of a few such points. A vector stands in its own cell and in those neighbouring cells that lie nearest,
in several tables. Into a cell it sends a name and a sketch of 96 signs only, and the cell answers with a spanning
forest of the pairs whose sketches are near: candidates. Vectors themselves travel to the component of candidates
that they are in, once; there all are compared by cosine in doubles. So most vectors, which have no candidate, never
travel, and the others do not travel to every cell.

Counts of links and spanning forests leave a component, no pairs. Equal vectors are one class from the start. Of a
component beyond a block the core, whose vectors lie within half the limit's angle of the common direction and so
all link, is counted without comparison; the others are cut into blocks that meet all blocks in tasks of their own.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_stash, mix, shared_dir, stash
from .components import components
from .vectors import matrices, rotation, sum_arrays

#: Tables, E8 points a cell is made of, neighbouring cells that a vector stands in, and the lattice's scale for
#: projections of unit vectors to eight numbers of expected length one.
TABLES, POINTS, PROBES, WIDTH = 3, 2, 5, 0.72
#: Signs of a sketch, and by how many deviations more of them than expected may differ in a candidate at the limit.
SIGNS, SURE = 96, 4.2
#: Vectors of a component that one task compares with each other or with as many others, and pairs a step.
BLOCK, PAIRS = 4096, 1 << 18
#: Vectors of a group from which it is compared as a product of matrices, or sketches against all others.
LARGE = 128
#: Rows up to which a table is broadcast.
BROADCAST_ROWS = 1 << 19
#: Bits of the table that tells most vectors without a candidate where the list of candidates is too long to broadcast.
KNOWN_BITS = 1 << 26
_SEED = 812


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    whole = [[s if k == i else t if k == j else 0.0 for k in range(8)] for i, j in combinations(range(8), 2) for s, t in product((1.0, -1.0), repeat=2)]
    half = [list(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(whole + half)


ROOTS = _roots()
turned = lru_cache(maxsize=32)(rotation)


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points of D8: whole numbers with an even sum."""
    point = np.rint(x)
    gap = x - point
    odd = np.flatnonzero(point.sum(1) % 2 != 0)
    worst = np.abs(gap[odd]).argmax(1)
    point[odd, worst] += np.where(gap[odd, worst] >= 0, 1.0, -1.0)
    return point


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8, the union of D8 and D8 shifted by one half."""
    a, b = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def cells(unit: np.ndarray, tables: int = TABLES, points: int = POINTS, probes: int = PROBES) -> np.ndarray:
    """(rows, tables, 1 + probes) 32-bit cell names: each vector's own cell, then its nearest neighbours."""
    n, d = unit.shape
    wide = max(d, 8 * points)
    unit = np.pad(unit, ((0, 0), (0, wide - d))) * (np.sqrt(wide / 8) / WIDTH)
    names = np.random.default_rng(_SEED).integers(1, 2**63, 8 * points, dtype=np.uint64) | np.uint64(1)
    out = np.empty((n, tables, 1 + probes), np.uint32)
    for t in range(tables):
        y = unit @ turned(wide, _SEED + t)[:, : 8 * points]
        cost, hashed = np.zeros((n, 1)), np.zeros((n, 1), np.uint64)
        for p in range(points):
            z = y[:, 8 * p : 8 * p + 8]
            own = nearest_e8(z)
            # the cost of a neighbour is how much farther it lies than the own point, squared
            far = 2 - 2 * ((z - own) @ ROOTS.T)
            best = np.argpartition(far, min(probes, 239), axis=1)[:, : max(probes, 1)]
            step = np.concatenate([np.zeros((n, 1)), np.take_along_axis(far, best, 1)], 1)
            ends = np.concatenate([own[:, None], own[:, None] + ROOTS[best]], 1)
            with np.errstate(over="ignore"):
                code = ((2 * ends).astype(np.int64).view(np.uint64) * names[8 * p : 8 * p + 8]).sum(-1, dtype=np.uint64)
                hashed = (hashed[:, :, None] + code[:, None]).reshape(n, -1)
            cost = (cost[:, :, None] + step[:, None]).reshape(n, -1)
            order = np.argsort(cost, axis=1, kind="stable")[:, : 1 + probes]
            cost, hashed = np.take_along_axis(cost, order, 1), np.take_along_axis(hashed, order, 1)
        out[:, t, : hashed.shape[1]] = (mix(hashed) >> np.uint64(32)).astype(np.uint32)
    return out


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one without overflow; none may be zero."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def met(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of cell names of one table meet: they share a cell."""
    return (a[:, :, None] == b[:, None, :]).any((1, 2))


def sketches(unit: np.ndarray) -> np.ndarray:
    """(rows, SIGNS / 32) words of the signs of random projections."""
    d = unit.shape[1]
    planes = np.concatenate([turned(d, _SEED + 1000 + k) for k in range(-(-SIGNS // d))], 1)[:, :SIGNS]
    return np.packbits(unit @ planes > 0, axis=1).view(np.uint32)


def most_signs(limit: float) -> int:
    """Differing signs up to which a pair is a candidate for a cosine of at least ``limit``."""
    share = math.acos(max(-1.0, min(1.0, limit))) / math.pi
    return math.floor(SIGNS * share + SURE * math.sqrt(SIGNS * share * (1 - share)))


def differing(a: np.ndarray, b: np.ndarray, high_a: np.ndarray, high_b: np.ndarray) -> np.ndarray:
    """How many signs differ, from the 64 and the 32 of each side."""
    return np.bitwise_count(a ^ b) + np.bitwise_count(high_a ^ high_b)


def near_labels(low: np.ndarray, high: np.ndarray, most: int) -> np.ndarray:
    """A label for each of a crowded cell's sketches: equal where sketches reach each other over near ones.

    Sketches with one label are not compared, so a group of near copies costs its size, not the square.
    """
    n = len(low)
    label, open_ = np.arange(n), np.arange(n)
    while len(open_):
        count = np.bincount(label[open_], minlength=n)
        top = int(count.argmax())
        if count[top] > 1:
            same = label[open_] == top
            take, others = open_[same], open_[~same]
            take = take[: max(256, PAIRS * 8 // max(len(others), 1))]
        else:
            take, others = open_[:256], open_
        reached, by = [], []
        for at in range(0, len(others), 8192):
            to = others[at : at + 8192]
            for lo in range(0, len(take), 256):
                some = take[lo : lo + 256]
                p, q = np.nonzero(differing(low[some, None], low[to], high[some, None], high[to]) <= most)
                reached.append(label[to[q]])
                by.append(label[some[p]])
        if reached:
            p, q = np.concatenate(by), np.concatenate(reached)
            some = p != q
            if some.any():
                names, at = np.unique(np.concatenate([p[some], q[some]]), return_inverse=True)
                half = len(at) // 2
                new = np.arange(n)
                new[names] = names[forest(len(names), at[:half], at[half:])]
                label = new[label]
        shut = np.zeros(n, bool)
        shut[take] = True
        open_ = open_[~shut[open_]]
    return label


def candidates(cell: np.ndarray, c: np.ndarray, low: np.ndarray, high: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forests (a, b) of the near sketches of whole cells; rows are sorted by cell and ``c``."""
    fresh = np.append(True, (cell[1:] != cell[:-1]) | (c[1:] != c[:-1])) if len(c) else np.zeros(0, bool)
    cell, c, low, high = cell[fresh], c[fresh], low[fresh], high[fresh]
    n = len(c)
    heads = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if n else np.zeros(0, np.int64)
    ends = np.append(heads[1:], n)
    size = ends - heads
    start, end = np.repeat(heads, size), np.repeat(ends, size)
    ps, qs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for p, q in pairs_of(start, end, (end - start > 1) & (end - start <= LARGE)):
        near = differing(low[p], low[q], high[p], high[q]) <= most
        ps.append(p[near])
        qs.append(q[near])
    label = forest(n, np.concatenate(ps), np.concatenate(qs))
    for k in np.flatnonzero(size > LARGE).tolist():
        at = slice(int(heads[k]), int(ends[k]))
        label[at] = heads[k] + near_labels(low[at], high[at], most)
    linked = np.flatnonzero(label != np.arange(n))
    return c[label[linked]], c[linked]


class Seen:
    """Which names came before, as far as a small table remembers: most repeats of common names are found."""

    def __init__(self, bits: int = 16):
        self.names, self.bits = np.zeros(1 << bits, np.int64), np.uint64(64 - bits)

    def fresh(self, names: np.ndarray) -> np.ndarray:
        """Positions of the names that are not known to repeat."""
        _, first = np.unique(names, return_index=True)
        at = np.sort(first)
        slot = (mix(names[at].view(np.uint64)) >> self.bits).astype(np.int64)
        new = self.names[slot] != names[at]
        self.names[slot] = names[at]
        return at[new | (names[at] == 0)]


def forest(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The least position that each of n positions reaches over the links (p, q)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[p], label[q])
        new = label.copy()
        np.minimum.at(new, p, low)
        np.minimum.at(new, q, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def pairs_of(start: np.ndarray, end: np.ndarray, own: np.ndarray):
    """(owner, later position) within the groups that ``start`` and ``end`` give by position, about PAIRS at a time."""
    left = np.flatnonzero(own)
    many = end[left] - left - 1
    upto = np.cumsum(many)
    at = 0
    while at < len(left):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
        count = many[at:to]
        p = np.repeat(left[at:to], count)
        yield p, p + 1 + np.arange(len(p)) - np.repeat(np.cumsum(count) - count, count)
        at = to


def close_pairs(x: np.ndarray, start: np.ndarray, end: np.ndarray, own: np.ndarray, limit: float):
    """(owner, later position of its group) with a cosine of at least ``limit``: small groups pair by pair, large ones as products."""
    large = end - start > LARGE
    for p, q in pairs_of(start, end, own & ~large):
        ok = np.einsum("ij,ij->i", x[p], x[q]) >= limit
        yield p[ok], q[ok]
    for lo in np.unique(start[large]).tolist():
        hi = int(end[lo])
        owners = lo + int(own[lo:hi].sum())
        for at in range(lo, owners, 256):
            p, q = np.nonzero(x[at : min(at + 256, owners)] @ x[at:hi].T >= limit)
            yield p[p < q] + at, q[p < q] + at


def links_of(rows: pa.Table, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(class, links, a, b) of whole groups of a component's blocks: sums of links and a spanning forest over least ids."""
    comp, i, j, size, block, c, least, weight = (rows.column(k).to_numpy() for k in ("comp", "i", "j", "size", "block", "c", "least", "weight"))
    own = block == i
    n = len(comp)
    heads = np.flatnonzero(np.append(True, (comp[1:] != comp[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]) | (size[1:] != size[:-1])))
    ends = np.append(heads[1:], n)
    start, end = np.repeat(heads, ends - heads), np.repeat(ends, ends - heads)
    raw = rows.column("x").to_pylist()
    links, label = np.zeros(n, np.int64), np.arange(n)
    for width in np.unique(size).tolist():
        at = np.flatnonzero(size == width)
        place = np.full(n + 1, -1)
        place[at] = np.arange(len(at))
        x = unit_rows(vectors_of([raw[k] for k in at], width))
        for p, q in close_pairs(x, place[start[at]], place[end[at] - 1] + 1, own[at], limit):
            a, b = at[p], at[q]
            ok = (i[a] == j[a]) | (block[a] != block[b])
            a, b = a[ok], b[ok]
            if len(a):
                # weighted sums of longs: exact below 2^53
                links += (np.bincount(a, weight[b], n) + np.bincount(b, weight[a], n)).astype(np.int64)
                label = label[forest(n, label[a], label[b])]
    some, linked = np.flatnonzero(links), np.flatnonzero(label != np.arange(n))
    return c[some], links[some], least[label[linked]], least[linked]


def vectors_of(raw: list[bytes], size: int) -> np.ndarray:
    """Vectors of ``size`` entries from their bytes, as ``bytes_of`` gives them."""
    out = np.empty((len(raw), size))
    short = np.array([len(b) == 4 * size for b in raw], bool)
    for kind, at in ((np.float32, np.flatnonzero(short)), (np.float64, np.flatnonzero(~short))):
        out[at] = np.frombuffer(b"".join(raw[k] for k in at), kind).reshape(len(at), size)
    return out


def bytes_of(x: np.ndarray) -> list[bytes]:
    """Rows as bytes: of four-byte numbers if these hold all entries exactly, else of eight-byte ones."""
    with np.errstate(over="ignore", under="ignore"):
        short = x.astype(np.float32)
    exact = (short == x).all(1)
    return [(s if e else row).tobytes() for s, row, e in zip(short, x, exact.tolist(), strict=True)]


def whole_groups(batches, columns: tuple[str, ...], rows: int = 8192):
    """Tables of about ``rows`` rows that end where a group of equal ``columns`` ends; the input is sorted by them."""
    held: list[pa.RecordBatch] = []
    least, count = rows, 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count < least:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        keys = [table.column(c).to_numpy() for c in columns]
        new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        if len(new):
            yield table.slice(0, int(new[-1]))
            table = table.slice(int(new[-1]))
        held, count = table.to_batches(), table.num_rows
        # a group larger than a step is put together a few times only
        least = max(rows, 2 * count)
    if count:
        yield pa.Table.from_batches(held).combine_chunks()


def similar_vectors(vectors: DataFrame, limit: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES, points: int = POINTS, probes: int = PROBES) -> DataFrame:
    """``id_col (long), n_links, component_id, kept`` of every row: vectors of one cosine of at least ``limit`` link.

    Null, empty and zero vectors, and those with null, infinite or undefined entries, link with nothing, nor do
    vectors of unlike length. Rows that repeat an id and its vector are one vector; one id with several vectors is
    several, and they share a component. A null id links with nothing, has a null component and stays kept.
    ``kept``: the id is its component's least.
    """
    spark = vectors.sparkSession
    paths: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        paths.append(shared_dir(spark))
        return stash(df, paths[-1])

    def small(df: DataFrame) -> DataFrame:
        """A kept table, broadcast where it has few rows."""
        return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df

    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))

    def usable(batch):
        """(rows, matrix, names, checks, bytes) of a batch's vectors that can link, by length."""
        known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
        for rows, x in matrices(batch.column(1)):
            some = (x != 0).any(1) & known[rows] if x.shape[1] else np.zeros(len(x), bool)
            if some.any():
                x = x[some] + 0.0
                raw = bytes_of(x)
                names = np.frombuffer(b"".join(hashlib.sha256(b).digest()[:16] for b in raw), np.int64).reshape(-1, 2)
                yield rows[some], x, names[:, 0], names[:, 1], raw

    name = T.StructType([T.StructField(k, T.LongType()) for k in ("id", "c", "sum")])

    def call(batches):
        for batch in batches:
            c, check, none = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), np.ones(batch.num_rows, bool)
            for rows, _, names, checks, _ in usable(batch):
                c[rows], check[rows], none[rows] = names, checks, False
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(c, mask=none), pa.array(check, mask=none)], names=name.names)

    # vectors are named by 64 bits of their hash, another 64 show two that share a name
    named = keep(source.mapInArrow(call, name))
    once = named.where("c is not null").groupBy("c", "id").agg(F.min("sum").alias("lo"), F.max("sum").alias("hi")).groupBy("c").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("weight"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    copies = keep(once.where("weight > 1 or lo <> hi"))
    if not copies.where("lo <> hi").isEmpty():
        raise ValueError("two vectors have one name of 64 bits")
    copies = small(copies.select("c", "least", "weight"))

    entry = T.StructType([T.StructField(k, T.LongType()) for k in ("key", "c", "low")])
    most = most_signs(limit)

    def enter(batches):
        seen = Seen()
        for batch in batches:
            for _, x, names, _, _ in usable(batch):
                at = seen.fresh(names)
                if not len(at):
                    continue
                unit, c = unit_rows(x[at]), names[at]
                got = (cells(unit, tables, points, probes) ^ np.uint32(x.shape[1])).astype(np.int64)
                sketch = sketches(unit)
                low = np.ascontiguousarray(sketch[:, :2]).view(np.int64)[:, 0]
                for t in range(tables):
                    for k in range(1 + probes):
                        new = np.flatnonzero(~(got[:, t, k : k + 1] == got[:, t, :k]).any(1))
                        # the cell's name, then the last signs; cells of two tables with one name are compared together
                        key = ((got[new, t, k] ^ (t * 0x9E3779B1 & 0xFFFFFFFF)) << 32) | sketch[new, 2].astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(c[new]), pa.array(low[new])], names=entry.names)

    edge = T.StructType([T.StructField(k, T.LongType()) for k in ("a", "b")])

    def pair(batches):
        def parted():
            for batch in batches:
                key = batch.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(key >> 32), *batch.columns], names=["cell", *entry.names])

        for rows in whole_groups(parted(), ("cell",)):
            cell, key, c, low = (rows.column(k).to_numpy() for k in ("cell", "key", "c", "low"))
            a, b = candidates(cell, c, low.view(np.uint64), (key & 0xFFFFFFFF).astype(np.uint32), most)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=edge.names)

    entries = source.mapInArrow(enter, entry).repartition(F.shiftright("key", 32)).sortWithinPartitions("key", "c")
    near = components(entries.mapInArrow(pair, edge))
    sizes = near.groupBy(F.col("component").alias("comp")).agg(F.count(F.lit(1)).alias("m"))
    held = keep(near.select(F.col("node").alias("c"), F.col("component").alias("comp")).join(sizes, "comp").join(copies, "c", "left"))

    known = None if held.count() <= BROADCAST_ROWS else spark.sparkContext.broadcast(_bits_of(held))
    member = T.StructType([T.StructField("id", T.LongType()), T.StructField("c", T.LongType()), T.StructField("size", T.LongType()), T.StructField("x", T.BinaryType())])

    def carry(batches):
        seen = Seen()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for rows, x, names, _, raw in usable(batch):
                own = ids[rows].astype(np.int64)
                at = seen.fresh((mix(own.view(np.uint64)) ^ names.view(np.uint64)).view(np.int64))
                if known is not None:
                    bit = names[at] % KNOWN_BITS
                    at = at[known.value[bit >> 3] >> (bit & 7).astype(np.uint8) & 1 == 1]
                yield pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array(names[at]), pa.array(np.full(len(at), x.shape[1])), pa.array([raw[k] for k in at.tolist()], pa.binary())], names=member.names)

    carried = source.mapInArrow(carry, member).join(small(held), "c").where("least is null or least = id")
    picked = keep(carried.select("comp", "m", "size", "c", F.col("id").alias("least"), F.coalesce("weight", F.lit(1).cast("long")).alias("weight"), "x"))

    found = T.StructType([T.StructField(k, T.LongType()) for k in ("c", "links", "a", "b")])

    def compare(batches):
        for rows in whole_groups(batches, ("comp", "i", "j")):
            c, links, a, b = links_of(rows, limit)
            blank = pa.nulls(len(c), pa.int64()), pa.nulls(len(a), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(links), blank[0], blank[0]], names=found.names)
            yield pa.RecordBatch.from_arrays([blank[1], blank[1], pa.array(a), pa.array(b)], names=found.names)

    # a row may repeat with its id; the task that it went to twice drops it
    zero = F.lit(0).cast("long")
    meeting = picked.where(F.col("m") <= BLOCK).select("comp", zero.alias("i"), zero.alias("j"), zero.alias("block"), "c", "least", "weight", "size", "x")
    cored = None
    if not picked.where(F.col("m") > BLOCK).isEmpty():
        marked = keep(_marked(picked.where(F.col("m") > BLOCK), limit))
        crowd = F.broadcast(keep(marked.select("key", "core", "c", "least", "weight").distinct().groupBy("key").agg(
            F.sum((~F.col("core")).cast("long")).alias("n_rest"), F.sum(F.col("core").cast("long")).alias("n_core"),
            F.sum(F.when(F.col("core"), F.col("weight"))).alias("heavy"), F.min(F.when(F.col("core"), F.col("least"))).alias("first"))))
        inner = marked.join(crowd, "key")
        cored = inner.where("core").select("c", (F.col("heavy") - F.col("weight")).alias("links"), F.col("first").alias("a"), F.col("least").alias("b")).distinct()
        rest, cores = F.expr(f"(n_rest + {BLOCK - 1}) div {BLOCK}"), F.expr(f"(n_core + {4 * BLOCK - 1}) div {4 * BLOCK}")
        dealt = F.xxhash64("c")
        placed = inner.select("*", rest.alias("rest"), cores.alias("cores")).where("rest > 0")
        placed = placed.withColumn("block", F.when(F.col("core"), F.col("rest") + F.pmod(dealt, F.col("cores"))).otherwise(F.pmod(dealt, F.col("rest"))))
        placed = placed.withColumn("other", F.explode(F.sequence(zero, F.when(F.col("core"), F.col("rest") - 1).otherwise(F.col("rest") + F.col("cores") - 1))))
        meeting = meeting.unionByName(placed.select("comp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "c", "least", "weight", "size", "x"))
    order = ("comp", "i", "j", "size", "block", "c")
    links = meeting.repartition("comp", "i", "j").sortWithinPartitions(*order).mapInArrow(_distinct, meeting.schema).mapInArrow(compare, found)
    links = keep(links if cored is None else links.unionByName(cored))

    # an id with several vectors ties their classes together
    several = keep(named.where("c is not null").groupBy("id").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("id"))
    tied = keep(named.where("c is not null").join(small(several), "id").select("c", "id").distinct().join(copies, "c", "left").select("c", "id", F.coalesce("least", "id").alias("least"), F.coalesce("weight", F.lit(1)).alias("weight")))
    groups = components(links.where("a is not null").select("a", "b").unionByName(tied.select(F.col("least").alias("a"), F.col("id").alias("b"))))
    counts = links.where("c is not null").groupBy("c").agg(F.sum("links").alias("links"))
    members = picked.select("c", "least", "weight").unionByName(copies).unionByName(tied.select("c", "least", "weight")).groupBy("c").agg(F.min("least").alias("least"), F.max("weight").alias("weight"))
    judged = members.join(counts, "c", "left").join(groups, F.col("least") == F.col("node"), "left")
    judged = keep(judged.select("c", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("component", "least").alias("component")))
    linked = named.select("id", "c").join(small(judged), "c", "left").select("id", F.coalesce("links", zero).alias("links"), F.coalesce("component", "id").alias("component"))
    out = stash(linked.select(F.col("id").alias(id_col), F.col("links").alias("n_links"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept")), shared_dir(spark))
    for path in paths:
        drop_stash(spark, path)
    return out


def _bits_of(names: DataFrame) -> np.ndarray:
    """One bit for each remainder of ``c`` by KNOWN_BITS, 8 MB however many names there are."""
    bit = F.pmod("c", F.lit(KNOWN_BITS)) + 1
    parts = names.groupBy(F.bitmap_bucket_number(bit).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    out = np.zeros(KNOWN_BITS // 8, np.uint8)
    for r in parts:
        out[(r["part"] - 1) * 4096 : r["part"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def _distinct(batches):
    """Rows of which the row before is not the same class in the same group; the input is sorted by both."""
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(batch.schema.get_field_index(k)).to_numpy() for k in ("comp", "i", "j", "c")], 1)
        new = np.append(True, (keys[1:] != keys[:-1]).any(1))
        new[0] = before is None or (keys[0] != before).any()
        before = keys[-1]
        yield batch.filter(pa.array(new)) if not new.all() else batch


def _marked(rows: DataFrame, limit: float) -> DataFrame:
    """``rows`` with ``key`` of the component and the vectors' length, and ``core``: within half the limit's angle of
    the mean direction, so that any two of a core link."""
    keyed = rows.withColumn("key", F.xxhash64("comp", "size"))
    part = T.StructType([T.StructField("key", T.LongType()), T.StructField("task", T.LongType()), T.StructField("value", T.ArrayType(T.DoubleType()))])

    def add(batches):
        from pyspark import TaskContext

        total: dict[int, np.ndarray] = {}
        for batch in batches:
            key, size = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            raw = batch.column(2).to_pylist()
            for k in np.unique(key).tolist():
                at = np.flatnonzero(key == k)
                total[k] = total.get(k, 0.0) + unit_rows(vectors_of([raw[j] for j in at], int(size[at[0]]))).sum(0)
        task = TaskContext.get().partitionId()
        for k, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([task]), pa.array([v.tolist()], pa.list_(pa.float64()))], names=part.names)

    centres = sum_arrays(keyed.select("key", "size", "x").mapInArrow(add, part))
    fields = list(keyed.schema.fields)
    out = T.StructType([*fields, T.StructField("core", T.BooleanType())])
    # in a core angles to the centre sum to less than the limit's, by more than rounding
    inside = math.cos(math.acos(max(-1.0, min(1.0, limit))) / 2) + 1e-9

    def mark(batches):
        for batch in batches:
            column = {k: batch.column(batch.schema.get_field_index(k)) for k in ("key", "size", "x", "total")}
            key, size, raw, total = column["key"].to_numpy(), column["size"].to_numpy(), column["x"].to_pylist(), column["total"]
            core = np.zeros(len(key), bool)
            for k in np.unique(key).tolist():
                at = np.flatnonzero(key == k)
                centre = np.array(total[int(at[0])].as_py())
                long = np.linalg.norm(centre)
                if long > 0:
                    core[at] = unit_rows(vectors_of([raw[j] for j in at], int(size[at[0]]))) @ (centre / long) >= inside
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(f.name)) for f in fields), pa.array(core)], names=out.names)

    return keyed.join(F.broadcast(centres), "key").select(*keyed.columns, "total").mapInArrow(mark, out)

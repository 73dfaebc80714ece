"""N-gram Jaccard join by vertical partitioning.

All shingles stand in one global order, by the number of classes that hold them and
then by hash. The order is cut into fragments; every fragment counts for itself what
pairs of documents have in common in it, and the partial counts of a pair are summed.
A pair can only reach the limit if its sum over the beginnings of both sets reaches a
bound that follows from both sizes; those pairs are compared in full.

Documents with equal sets are one class from the start, and a class takes part only if
other classes hold enough of its shingles for any link at all. Classes that already
hang together through a common partner are not paired again, and entries of a shingle are
matched by kind before documents are, so a large group of near copies, or many pages
of one template, cost their number, not its square, and no link between groups is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, drop_stash, mix, shared_dir, span_hashes, stash, steps, text_buffer, words_of
from .components import components

#: Shingles that one task of the first count holds about, and bytes of text that a shingle stands for about.
FRAGMENT, SHINGLE_BYTES = 1 << 22, 6
#: Document ids that are broadcast at most (64 MB as a hash table); more are joined by a shuffle.
BROADCAST_IDS = 1 << 20
#: Common shingles at the beginnings of two sets that a pair must show (where the limit asks for that many).
COMMON = 3
#: Classes that a group has at least so that its members are never paired with each other again, and the mark of none.
CROWD, _NO_CROWD = 64, -(1 << 63)
#: What decides by itself whether two entries of a shingle can meet.
KIND = ("n", "own", "at", "crowd")
_LOWER = np.frombuffer(LOWER, np.uint8)


def shingle_sets(raw: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and their n + 1 bounds.

    Fewer words than ``size`` make one shingle of all of them; no words make none.
    """
    low = _LOWER[raw]
    starts, ends, wb = words_of(low, bounds)
    words = span_hashes(low, starts, ends)
    n = np.diff(wb)
    rows = len(bounds) - 1
    step = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        grams = words.copy()
        reach = np.minimum(np.repeat(wb[1:], n) - np.arange(len(words)), size)
        for k in range(1, size):
            at = np.flatnonzero(reach > k)
            grams[at] = mix(grams[at] * step + words[at + k])
        grams = mix(grams + reach.astype(np.uint64))
    full = (reach == size) | (np.arange(len(words)) == np.repeat(wb[:-1], n)) if len(words) else np.zeros(0, bool)
    row = np.repeat(np.arange(rows), n)[full]
    grams = grams[full]
    order = np.lexsort((grams, row))
    grams, row = grams[order], row[order]
    new = np.ones(len(grams), bool)
    if len(grams) > 1:
        new[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
    return grams[new], np.searchsorted(row[new], np.arange(rows + 1))


def keys_of(grams: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums of each set; together with the size they name a class of equal sets."""
    with np.errstate(over="ignore"):
        sums = [np.append(np.uint64(0), np.cumsum(x, dtype=np.uint64)) for x in (grams, mix(grams ^ np.uint64(0x5851F42D4C957F2D)))]
        k1, k2 = [(s[cut[1:]] - s[cut[:-1]]).view(np.int64) for s in sums]
    return k1, k2


def _block(step: int, many: np.ndarray, rows: np.ndarray, keys: np.ndarray, counts: np.ndarray, single: np.ndarray) -> bytes:
    """What one step sends to one fragment: shingles that several of its classes hold, and those that one holds,
    class by class (its row in the step, its key, their number)."""
    return b"".join([np.array([step, len(many), len(keys)], "<i8").tobytes(), *[x.astype("<i8").tobytes() for x in (rows, keys, counts)], many.astype("<u4").tobytes(), single.astype("<u4").tobytes()])


def _read_block(b: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    step, many, classes = np.frombuffer(b, "<i8", 3).tolist()
    rows, keys, counts = np.frombuffer(b, "<i8", 3 * classes, 24).reshape(3, classes)
    low = np.frombuffer(b, "<u4", offset=24 + 24 * classes)
    return step, low[:many], rows, keys, counts, low[many:]


def _runs(batches, key: int, value: int):
    """(key, values) of each run of equal keys over batches that are sorted by the key."""
    now, held = None, []
    for batch in batches:
        for k, v in zip(batch.column(key).to_pylist(), batch.column(value), strict=True):
            if k != now:
                if held:
                    yield now, held
                now, held = k, []
            held.append(v.as_py())
    if held:
        yield now, held


_ANSWER = np.dtype([("row", "<u4"), ("shared", "<u4")])
_ROW = np.dtype([("id", "<i8"), ("valid", "<i8"), ("n", "<i8"), ("k1", "<i8"), ("k2", "<i8"), ("lead", "<i8"), ("shared", "<i8")])


def shared_counts(docs: DataFrame, size: int, id_col: str, text_col: str, fragments: int) -> DataFrame:
    """``id, n_shingles, k1, k2, shared`` of every document; ``shared``: shingles that another class holds as well.

    Each step (a few hundred documents) sends every distinct shingle once, so one that all documents hold arrives
    once per step, and gets one block of counts back from each fragment. Shingles travel as the low half of their
    hash: a collision raises a count, so ``shared`` is an upper bound.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("__text"))
    sent = T.StructType([T.StructField("to", T.LongType()), T.StructField("own", T.BooleanType()), T.StructField("block", T.BinaryType())])
    names = ("id", "n_shingles", "k1", "k2", "shared")
    schema = T.StructType([T.StructField(x, T.LongType()) for x in names])
    width = np.uint64((1 << 64) // fragments + 1)

    def deal(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in steps(batch, "__text"):
                number += 1
                count, valid = part.num_rows, part.column(0).is_valid().to_numpy(zero_copy_only=False)
                grams, cut = shingle_sets(*text_buffer(part.column(1)), size)
                n = np.diff(cut)
                k1, k2 = keys_of(grams, cut)
                _, first, back = np.unique(np.where(valid, k1, 0), return_index=True, return_inverse=True)
                one = np.zeros(count, bool)
                one[first] = True
                owner = np.repeat(np.arange(count), n)
                mine = (one & valid)[owner]
                g, owner = grams[mine], owner[mine]
                order = np.argsort(g)
                g, owner = g[order], owner[order]
                again, last = np.zeros(len(g), bool), np.zeros(len(g), bool)
                again[1:], last[:-1] = g[1:] == g[:-1], g[1:] == g[:-1]
                several = again | last
                local = np.bincount(owner[several], minlength=count)
                many, single, owner = g[several & ~again], g[~several], owner[~several]
                at = (single // width).astype(np.int64)
                order = np.argsort(at * count + owner, kind="stable")
                single, owner, at = single[order], owner[order], at[order]
                edges = np.arange(fragments + 1)
                many_cut, cuts = np.searchsorted((many // width).astype(np.int64), edges), np.searchsorted(at, edges)
                to, blocks = [], []
                for f in np.flatnonzero((np.diff(cuts) > 0) | (np.diff(many_cut) > 0)).tolist():
                    a, b = cuts[f], cuts[f + 1]
                    who, counts = np.unique(owner[a:b], return_counts=True)
                    to.append(f)
                    blocks.append(_block(number, many[many_cut[f] : many_cut[f + 1]], who, k1[who], counts, single[a:b]))
                rows = np.zeros(count, _ROW)
                for name, x in (("id", part.column(0).fill_null(0).to_numpy()), ("valid", valid), ("n", n), ("k1", k1), ("k2", k2), ("lead", first[back]), ("shared", local)):
                    rows[name] = x
                yield pa.RecordBatch.from_arrays([pa.array([number % fragments, *to], pa.int64()), pa.array([True] + [False] * len(to)), pa.array([number.to_bytes(8, "little") + rows.tobytes(), *blocks], pa.binary())], names=sent.names)

    def judge(blocks):
        got = [_read_block(b) for b in blocks]
        keys, row = np.concatenate([b[3] for b in got]), np.concatenate([b[2] for b in got])
        source = np.repeat(np.arange(len(got)), [len(b[3]) for b in got])
        owner = np.repeat(np.arange(len(keys)), np.concatenate([b[4] for b in got]))
        low = np.concatenate([*[b[5] for b in got], *[b[1] for b in got]])
        order = np.argsort(low, kind="stable")
        low = low[order]
        new = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
        group = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(low))))
        whose = np.append(owner, np.full(len(low) - len(owner), -1))[order]
        of = np.append(keys, 0)[whose]
        shared = (np.minimum.reduceat(of, new) != np.maximum.reduceat(of, new)) | (np.minimum.reduceat(whose, new) < 0)
        counts = np.bincount(whose[shared[group] & (whose >= 0)], minlength=len(keys))
        some = np.flatnonzero(counts)
        out = np.empty(len(some), _ANSWER)
        out["row"], out["shared"] = row[some], counts[some]
        cuts = np.searchsorted(source[some], np.arange(len(got) + 1))
        full = np.flatnonzero(np.diff(cuts)).tolist()
        yield pa.RecordBatch.from_arrays([pa.array([got[i][0] for i in full], pa.int64()), pa.array([False] * len(full), pa.bool_()), pa.array([out[cuts[i] : cuts[i + 1]].tobytes() for i in full], pa.binary())], names=sent.names)

    def answer(batches):
        """Counts go back to the steps that asked; a step's own rows pass through."""

        def asked():
            for batch in batches:
                own = batch.column(1)
                for b in batch.column(2).filter(own).to_pylist():
                    passed.append(pa.RecordBatch.from_arrays([pa.array([int.from_bytes(b[:8], "little")]), pa.array([True]), pa.array([b[8:]], pa.binary())], names=sent.names))
                yield batch.filter(pc.invert(own))

        passed: list[pa.RecordBatch] = []
        for _, held in _runs(asked(), 0, 2):
            yield from judge(held)
            while passed:
                yield passed.pop()
        yield from passed

    def total(batches):
        def both():
            for batch in batches:
                kinds = batch.column(1).to_pylist()
                tagged = [(b"r" if own else b"a") + b for own, b in zip(kinds, batch.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tagged, pa.binary())], names=["to", "block"])

        for _, held in _runs(both(), 0, 1):
            rows = np.frombuffer(b"".join(b[1:] for b in held if b[:1] == b"r"), _ROW)
            more = np.frombuffer(b"".join(b[1:] for b in held if b[:1] == b"a"), _ANSWER)
            shared = rows["shared"] + np.bincount(more["row"], more["shared"], len(rows)).astype(np.int64)
            ids = pa.array(np.ascontiguousarray(rows["id"]), mask=rows["valid"] == 0)
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(np.ascontiguousarray(rows[x])) for x in ("n", "k1", "k2")], pa.array(shared[rows["lead"]])], names=names)

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def gathered(df: DataFrame, n: int) -> DataFrame:
        return df.repartition(n, "to").sortWithinPartitions("to")

    return gathered(gathered(src.mapInArrow(deal, sent), min(parts, fragments)).mapInArrow(answer, sent), parts).mapInArrow(total, schema)


def whole_sets(docs: DataFrame, live: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """``id, n, grams`` (sorted 64-bit hashes) of the classes ``live`` (id, k1, k2, n_shingles), each once."""
    ids = live.select("id")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    schema = T.StructType([*[T.StructField(x, T.LongType()) for x in ("id", "n", "k1", "k2")], T.StructField("grams", T.BinaryType())])

    def whole(batches):
        for batch in batches:
            for part in steps(batch, "__text"):
                grams, cut = shingle_sets(*text_buffer(part.column(1)), size)
                k1, k2 = keys_of(grams, cut)
                sets = [grams[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(x) for x in (np.diff(cut), k1, k2)], pa.array(sets, pa.binary())], names=schema.names)

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("__text")).join(ids, "id", "left_semi")
    found = texts.mapInArrow(whole, schema).groupBy("id", "n", "k1", "k2").agg(F.first("grams").alias("grams"))
    return found.join(live.select("id", F.col("n_shingles").alias("n"), "k1", "k2"), ["id", "n", "k1", "k2"]).select("id", "n", "grams")


def beginnings(sets: DataFrame, percent: int, keep) -> DataFrame:
    """``fragment, df, shingle, id, n, own, at``: where each set begins in the global order.

    The order is by ``df``, the number of sets that hold a shingle, then by hash; a fragment is a range of it.
    ``own``: shingles that no other set holds; they come first and are left out. ``at``: place in the order.
    """
    schema = T.StructType([T.StructField(x, T.LongType()) for x in ("shingle", "id", "n")])

    def entries(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                n = part.column(1).to_numpy()
                flat = np.frombuffer(b"".join(part.column(2).to_pylist()), "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(flat), *[pa.array(np.repeat(x, n)) for x in (part.column(0).to_numpy(), n)]], names=schema.names)

    every = sets.select("id", "n", "grams").mapInArrow(entries, schema)
    # written, so that the join below is one of two plain exchanges, whose hot shingles Spark can split
    df = keep(every.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    held = every.join(df, "shingle")
    by_id = W.partitionBy("id")
    placed = held.withColumn("own", F.col("n") - F.count(F.lit(1)).over(by_id)).withColumn("at", F.col("own") + F.row_number().over(by_id.orderBy("df", "shingle")) - 1)
    least = F.expr(f"({percent} * n + 99) div 100")
    placed = placed.where((F.col("n") - F.col("own") >= least) & (F.col("at") < F.col("n") - least + COMMON))
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartitionByRange(parts, "df", "shingle").withColumn("fragment", F.spark_partition_id())


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets reach the limit."""
    two = pairs.join(sets.select(F.col("id").alias("b"), F.col("grams").alias("gb")), "b").join(sets.select(F.col("id").alias("a"), F.col("grams").alias("ga")), "a")
    linked = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def compare(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                ga, gb = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = len(np.intersect1d(ga, gb, assume_unique=True))
                ok.append(100 * both >= percent * (len(ga) + len(gb) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in batch.columns[:2]], names=linked.names)

    return two.select("a", "b", "ga", "gb").mapInArrow(compare, linked)


def least_common(n: Column, m: Column, percent: int) -> Column:
    """How many shingles two linked sets of n and m have in common at least."""
    return F.floor((percent * (n + m) + (99 + percent)) / (100 + percent)).cast("long")


def possible(x: str, y: str, percent: int) -> Column:
    """Whether the entries x and y of one shingle can be among the first COMMON that a linked pair has in common.

    The lengths must allow a link, both sides must have enough shingles that other sets hold, and less must
    stand before the entries than may be missing in the partner.
    """
    (n, own, at), (m, has, on) = ([F.col(p.format(c)) for c in ("n", "own", "at")] for p in (x, y))
    common = least_common(n, m, percent)
    reach = F.least(F.lit(COMMON), common) - 1
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (F.least(n - own, m - has) >= common) & (at <= n - common + reach) & (on <= m - common + reach)


def kinds_that_meet(tagged: DataFrame, percent: int) -> DataFrame:
    """Pairs of kinds of entries of one shingle that can belong to linked sets.

    A kind is what ``possible`` looks at (size, own shingles, place) and the crowd, a large group that already hangs
    together. However many documents share a passage, they are of few kinds, and where no two kinds fit, or all
    stand in one crowd, not one pair of documents is looked at.
    """
    kinds = tagged.select("fragment", "shingle", *KIND).distinct()
    x, y = [kinds.select("fragment", "shingle", F.struct(*KIND).alias("kind" + s), *[F.col(c).alias(c + s) for c in KIND]) for s in ("x", "y")]
    apart = (F.col("crowdx") != F.col("crowdy")) | (F.col("crowdx") == _NO_CROWD)
    met = x.join(y, ["fragment", "shingle"]).where("kindx <= kindy").where(apart & possible("{}x", "{}y", percent))
    return met.select("fragment", "shingle", *[c + s for s in ("x", "y") for c in KIND])


def meetings(tagged: DataFrame, kinds: DataFrame) -> DataFrame:
    """``fragment, a, b, na, nb``: a row for each entry that two documents of different groups share, a < b."""
    x, y = [tagged.select("fragment", "shingle", F.col("id").alias("id" + s), F.col("g").alias("g" + s), *[F.col(c).alias(c + s) for c in KIND]) for s in ("x", "y")]
    met = kinds.join(x, ["fragment", "shingle", *[c + "x" for c in KIND]]).join(y, ["fragment", "shingle", *[c + "y" for c in KIND]])
    one = F.lit(True)
    for c in KIND:
        one = one & (F.col(c + "x") == F.col(c + "y"))
    met = met.where(F.col("gx") != F.col("gy")).where(~one | (F.col("idx") < F.col("idy")))
    first = F.col("idx") < F.col("idy")
    return met.select("fragment", F.least("idx", "idy").alias("a"), F.greatest("idx", "idy").alias("b"), F.when(first, F.col("nx")).otherwise(F.col("ny")).alias("na"), F.when(first, F.col("ny")).otherwise(F.col("nx")).alias("nb"))


def similar_groups(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col (long), n_shingles, component_id`` of every document.

    Two documents link when 100 * intersection >= ``percent`` * union of their sets of ``size``-word shingles
    (A-Z lower-cased). A null text, or one without words, has an empty set and links with nothing. A null id
    keeps its row with itself (null) as component and links with nothing; rows that repeat an id and its text
    count as one document, and of several texts of one id only one is compared. ``component_id``: the least id
    that links reach.
    """
    spark = docs.sparkSession
    paths: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        paths.append(shared_dir(spark))
        return stash(df, paths[-1])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size_of = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    every = keep(shared_counts(docs, size, id_col, text_col, max(parts, size_of // (SHINGLE_BYTES * FRAGMENT) + 1)))
    some = every.where("n_shingles > 0 and id is not null")
    classes = keep(some.groupBy("k1", "k2", "n_shingles").agg(F.min("id").alias("id"), F.max("shared").alias("shared")))
    able = classes.where(f"100 * shared >= {percent} * n_shingles").groupBy("id").agg(F.min(F.struct("k1", "k2", "n_shingles")).alias("c"))
    sets = keep(whole_sets(docs, keep(able.select("id", "c.*")), size, id_col, text_col))
    entries = keep(beginnings(sets, percent, keep))
    # first every class with the one of a shingle that has the least of its own: this joins groups of near copies
    leader = keep(entries.groupBy("shingle").agg(F.min(F.struct("own", "id", "n", "at")).alias("l")))
    stars = entries.join(leader, "shingle").where(F.col("l.id") != F.col("id")).where(possible("l.{}", "{}", percent))
    stars = stars.select(F.least("l.id", "id").alias("a"), F.greatest("l.id", "id").alias("b")).distinct()
    first = keep(verified(keep(stars), sets, percent))
    group = keep(components(first))
    # then all pairs that are not in one group yet: what they have in common is counted by fragment and summed
    known = group.join(group.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "component")
    known = keep(known.select(F.col("node").alias("id"), "component", F.when(F.col("size") >= CROWD, F.col("component")).alias("crowd")))
    tagged = entries.join(known, "id", "left").select("fragment", "shingle", "id", "n", "own", "at", F.coalesce("component", "id").alias("g"), F.coalesce("crowd", F.lit(_NO_CROWD)).alias("crowd"))
    mixed = keep(tagged.groupBy("shingle").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo < hi").select("shingle"))
    tagged = keep(tagged.join(mixed, "shingle", "left_semi"))
    met = meetings(tagged, keep(kinds_that_meet(tagged, percent)))
    partial = met.groupBy("fragment", "a", "b").agg(F.count(F.lit(1)).alias("common"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    pairs = partial.groupBy("a", "b").agg(F.sum("common").alias("common"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    pairs = pairs.where(F.col("common") >= F.least(F.lit(COMMON), least_common(F.col("na"), F.col("nb"), percent)))
    second = verified(keep(pairs.select("a", "b")), sets, percent)
    final = components(keep(first.unionByName(second)))
    least = classes.select("k1", "k2", "n_shingles", F.col("id").alias("least"))
    out = every.join(least, ["k1", "k2", "n_shingles"], "left").join(final, F.col("least") == final["node"], "left")
    alone = (F.col("n_shingles") == 0) | F.col("id").isNull()
    out = out.select(F.col("id").alias(id_col), "n_shingles", F.when(alone, F.col("id")).otherwise(F.coalesce("component", "least")).alias("component_id"))
    out = stash(out, shared_dir(spark))
    for path in paths:
        drop_stash(spark, path)
    return out

"""Hard negatives by exact search over rotated one-bit codes.

Every row is stored as integers and as a few codes: the signs of its rotated vector, then of what that code leaves
over, and so on. With each code go the vector's alignment with the code's direction and the length of the
remainder. For an anchor, popcounts over its quantised entries give each code's share of the inner product, and
Cauchy-Schwarz bounds the remainder's, so a row's score lies in an interval that holds for certain. Rows whose
interval cannot reach the anchor's thresholds are passed over; the others are scored in integers.

Anchors go out in groups of bounded size; each group is one pass over all rows, in which every task keeps its best
rows an anchor, so neither pairs nor labels are ever brought together.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_stash, shared_dir, stash
from .vectors import matrices, rotation

#: Codes a row (each halves what the interval leaves open, about) and bits of a quantised anchor entry.
CODES, BITS = 4, 8
#: Bytes of anchors that one pass sends to every task, and anchors and rows that are compared at a time.
PASS_BYTES, ANCHORS, ROWS = 32 << 20, 512, 2048
#: Part of the lengths' product that rounding can add to a bound at most.
SLACK = 1e-9
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_SEED = 1311


def words_of_signs(signs: np.ndarray) -> np.ndarray:
    """Rows of booleans as 64-bit words."""
    n, d = signs.shape
    packed = np.packbits(np.pad(signs, ((0, 0), (0, -d % 64))), axis=1, bitorder="little")
    return np.ascontiguousarray(packed).view("<u8")


def encode(x: np.ndarray, codes: int = CODES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (codes, rows, words), alignments (codes, rows) and lengths (codes + 1, rows) of integer vectors.

    ``lengths[0]`` is the vector's, ``lengths[k]`` that of what k codes leave over.
    """
    n, d = x.shape
    rest = x.astype(float)
    words, along, lengths = [], [], [np.linalg.norm(rest, axis=1)]
    for k in range(codes):
        turn = rotation(d, _SEED + k)
        turned = rest @ turn
        signs = turned >= 0
        code = np.where(signs, 1.0, -1.0) / np.sqrt(max(d, 1))
        a = (turned * code).sum(1)
        rest = (turned - a[:, None] * code) @ turn.T
        words.append(words_of_signs(signs))
        along.append(a)
        lengths.append(np.linalg.norm(rest, axis=1))
    return np.array(words).reshape(codes, n, -1), np.array(along).reshape(codes, n), np.array(lengths)


class Anchors:
    """Anchors of one length, quantised for popcounts under every code's rotation."""

    def __init__(self, x: np.ndarray, codes: int = CODES, bits: int = BITS):
        self.n, self.d = x.shape
        self.length = np.linalg.norm(x.astype(float), axis=1)
        self.planes, self.low, self.step, self.sums, self.lost = [], [], [], [], []
        for k in range(codes):
            q = x.astype(float) @ rotation(self.d, _SEED + k)
            low = q.min(1, initial=0.0)
            step = np.maximum((q.max(1, initial=0.0) - low) / ((1 << bits) - 1), np.finfo(float).tiny)
            u = np.rint((q - low[:, None]) / step[:, None]).astype(np.int64)
            back = low[:, None] + step[:, None] * u
            self.planes.append([words_of_signs((u >> b) & 1 == 1) for b in range(bits)])
            self.low.append(low)
            self.step.append(step)
            self.sums.append(back.sum(1))
            self.lost.append(np.linalg.norm(q - back, axis=1))

    def share(self, k: int, who: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Inner products of quantised anchors with the directions of codes, by popcounts; pairs stand side by side."""
        ones = np.bitwise_count(words).sum(-1, dtype=np.int64)
        weighted = np.zeros(ones.shape, np.int64)
        for b, plane in enumerate(self.planes[k]):
            weighted += np.bitwise_count(words & plane[who]).sum(-1, dtype=np.int64) << b
        return (2 * (self.low[k][who] * ones + self.step[k][who] * weighted) - self.sums[k][who]) / np.sqrt(max(self.d, 1))


def candidates(anchors: Anchors, row_words, row_along, row_lengths, floor: np.ndarray, ceiling: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (anchor, row) of ``allowed`` whose interval meets [floor, ceiling] of the anchor.

    Pairs go through one code after the other; each narrows the intervals of those that the last one left.
    """
    who, row = np.nonzero(allowed)
    middle = np.zeros(len(who))
    off = np.zeros(len(who))
    for k in range(len(row_words)):
        long = anchors.length[who]
        middle = middle + row_along[k][row] * anchors.share(k, who, row_words[k][row])
        off = off + np.abs(row_along[k][row]) * anchors.lost[k][who]
        reach = off + row_lengths[k + 1][row] * long + SLACK * (1 + row_lengths[0][row] * long)
        keep = (middle + reach >= floor[who]) & (middle - reach <= ceiling[who])
        who, row, middle, off = who[keep], row[keep], middle[keep], off[keep]
    return who, row


def best(score: np.ndarray, ident: np.ndarray, key: np.ndarray, limit: int) -> np.ndarray:
    """Positions of the first ``limit`` entries of every key by falling score, then by rising id."""
    order = np.lexsort((ident, -score, key))
    k = key[order]
    new = np.append(True, k[1:] != k[:-1]) if len(k) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0)) if len(k) else np.zeros(0, np.int64)
    return order[np.arange(len(k)) - start < limit]


class Kept:
    """The first ``limit`` rows of every key seen so far, and the least score with which another row can enter."""

    def __init__(self, keys: int, limit: int):
        self.limit, self.enter = limit, np.full(keys, _LEAST)
        self.key = self.score = self.ident = np.zeros(0, np.int64)

    def add(self, key: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        key, score, ident = (np.concatenate(x) for x in ((self.key, key), (self.score, score), (self.ident, ident)))
        at = best(score, ident, key, self.limit)
        self.key, self.score, self.ident = key[at], score[at], ident[at]
        seen = np.bincount(self.key, minlength=len(self.enter))
        full = np.flatnonzero(seen >= self.limit)
        self.enter[full] = self.score[np.cumsum(seen)[full] - 1]


_INDEX = T.StructType([T.StructField(c, T.LongType()) for c in ("id", "label", "dims")] + [T.StructField("body", T.BinaryType())])


def index(vectors: DataFrame, id_col: str, vector_col: str, label: F.Column, scale: float = 256.0, codes: int = CODES) -> DataFrame:
    """``id, label, dims, body``: usable rows as integers floor(scale * x) with their codes."""

    def build(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                for rows, c in matrices(part.column(2)):
                    with np.errstate(over="ignore"):
                        x = np.floor(scale * c)
                    # what a long can hold as a sum of products
                    ok = (np.abs(x) <= np.sqrt(2.0**62 / max(c.shape[1], 1))).all(1)
                    rows, x = rows[ok], x[ok].astype("<i8")
                    words, along, lengths = encode(x, codes)
                    body = np.concatenate([x, words.transpose(1, 0, 2).reshape(len(x), -1).view("<i8"), along.T.astype("<f8").view("<i8").reshape(len(x), -1), lengths.T.astype("<f8").copy().view("<i8").reshape(len(x), -1)], axis=1) if len(x) else x
                    body = np.ascontiguousarray(body)
                    at = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(np.full(len(rows), c.shape[1])), pa.array([b.tobytes() for b in body], pa.binary())], names=_INDEX.names)

    chosen = vectors.where(label.isNotNull()).select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).alias("v"))
    return chosen.mapInArrow(build, _INDEX)


def unpack(bodies: list[bytes], d: int, codes: int):
    """Integers, words, alignments and lengths of index rows of one vector length."""
    n, w = len(bodies), -(-d // 64)
    flat = np.frombuffer(b"".join(bodies), "<i8").reshape(n, -1)
    x, rest = flat[:, :d], flat[:, d:]
    words = np.ascontiguousarray(rest[:, : codes * w]).view("<u8").reshape(n, codes, w).transpose(1, 0, 2)
    reals = np.ascontiguousarray(rest[:, codes * w :]).view("<f8")
    return x, words, reals[:, :codes].T, reals[:, codes:].T


def integer_scores(ax: np.ndarray, who: np.ndarray, x: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Integer inner products of the pairs (anchor, row)."""
    out = np.empty(len(who), np.int64)
    step = max(1, (1 << 22) // max(x.shape[1], 1))
    for lo in range(0, len(who), step):
        out[lo : lo + step] = np.einsum("ij,ij->i", ax[who[lo : lo + step]], x[row[lo : lo + step]])
    return out


def _blocks(batches, codes: int):
    """Row blocks of one vector length: length, ids, labels and what ``unpack`` gives."""
    for batch in batches:
        dims = batch.column(2).to_numpy()
        for d in np.unique(dims).tolist():
            at, step = np.flatnonzero(dims == d), max(64, ROWS // max(1, -(-d // 64)))
            for lo in range(0, len(at), step):
                part = batch.take(pa.array(at[lo : lo + step]))
                yield d, part.column(0).to_numpy(), part.column(1).to_numpy(), unpack(part.column(3).to_pylist(), d, codes)


def blocks_of_anchors(rows: list[tuple]) -> list[dict]:
    """Anchors (number, id, label, dims, bytes of integers) in blocks of one vector length each."""
    out = []
    for d in sorted({r[3] for r in rows}):
        same = [r for r in rows if r[3] == d]
        for lo in range(0, len(same), ANCHORS):
            number, ident, label = (np.array([r[c] for r in same[lo : lo + ANCHORS]], np.int64) for c in range(3))
            x = np.frombuffer(b"".join(r[4] for r in same[lo : lo + ANCHORS]), "<i8").reshape(len(number), d)
            out.append({"dims": d, "number": number, "id": ident, "label": label, "x": x})
    return out


def _windows(block: dict, positives: int, least: int, most: int, found: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest score that each place of each anchor of the block accepts; empty places accept none."""
    low, high = (np.full((len(block["number"]), positives), x) for x in (1, 0))
    at = np.searchsorted(block["number"], found[0])
    mine = (at < len(block["number"])) & (block["number"][np.minimum(at, len(block["number"]) - 1)] == found[0])
    whole, rest = np.divmod(found[2][mine], 100)
    low[at[mine], found[1][mine]], high[at[mine], found[1][mine]] = least * whole - (-least * rest) // 100, most * whole + most * rest // 100
    return low, high


_HIT = T.StructType([T.StructField(c, T.LongType()) for c in ("number", "anchor_id", "place", "score", "id")])


def _hits(blocks: list[dict], kept: list[Kept], places: int):
    for block, k in zip(blocks, kept, strict=True):
        if len(k.key):
            who = k.key // places
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (block["number"][who], block["id"][who], k.key % places, k.score, k.ident)], names=_HIT.names)


def _first(hits: DataFrame, limit: int) -> DataFrame:
    order = W.partitionBy("number", "place").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def _pass(spark, rows: DataFrame, anchors: list[tuple], positives: int, negatives: int, least: int, most: int, codes: int) -> DataFrame:
    """Hard negatives of a bounded list of anchors: one pass for the positives, one for the negatives."""
    blocks = spark.sparkContext.broadcast(blocks_of_anchors(anchors))

    def scan(batches, same: bool, places: int, limit: int, low, high):
        """The best rows of every key; ``low`` and ``high`` give each block's windows by anchor and place."""
        held = [(b, Anchors(b["x"], codes), Kept(len(b["number"]) * places, limit)) for b in blocks.value]
        for d, ids, labels, (x, words, along, lengths) in _blocks(batches, codes):
            for n, (b, anchor, kept) in enumerate(held):
                if b["dims"] != d:
                    continue
                floor = np.maximum(low[n], kept.enter.reshape(-1, places))
                open_ = floor <= high[n]
                allowed = ((b["label"][:, None] == labels) == same) & (b["id"][:, None] != ids) & open_.any(1)[:, None]
                lowest, highest = np.where(open_, floor, _MOST).min(1, initial=_MOST), np.where(open_, high[n], _LEAST).max(1, initial=_LEAST)
                who, row = candidates(anchor, words, along, lengths, lowest.astype(float), highest.astype(float), allowed)
                score = integer_scores(b["x"], who, x, row)
                pair, place = np.nonzero((score[:, None] >= floor[who]) & (score[:, None] <= high[n][who]))
                kept.add(who[pair] * places + place, score[pair], ids[row[pair]])
        yield from _hits(blocks.value, [k for _, _, k in held], places)

    def near(batches):
        low, high = ([np.full((len(b["number"]), 1), x) for b in blocks.value] for x in (_LEAST, _MOST))
        return scan(batches, True, 1, positives, low, high)

    top = _first(rows.mapInArrow(near, _HIT), positives).select("number", (F.col("rank") - 1).alias("at"), "id", "score").orderBy("number", "at").collect()
    found = tuple(np.array([r[c] for r in top], np.int64) for c in ("number", "at", "score", "id"))
    shared = spark.sparkContext.broadcast(found)

    def hard(batches):
        low, high = zip(*[_windows(b, positives, least, most, shared.value) for b in blocks.value], strict=True)
        return scan(batches, False, positives, negatives, low, high)

    partners = T.StructType([T.StructField(c, T.LongType()) for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")])

    def name(batches):
        number, at, score, ident = shared.value
        keys = number * positives + at
        for batch in batches:
            k = np.searchsorted(keys, batch.column(0).to_numpy() * positives + batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(ident[k]), batch.column(3), batch.column(4), pa.array(score[k]), batch.column(5)], names=partners.names)

    ranked = _first(rows.mapInArrow(hard, _HIT), negatives).select("number", "place", "anchor_id", F.col("rank").cast("long"), "id", "score")
    return ranked.mapInArrow(name, partners).withColumn("rank", F.col("rank").cast("int"))


def mine(
    vectors: DataFrame, positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100, anchors: F.Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label: F.Column | None = None, codes: int = CODES, pass_bytes: int = PASS_BYTES
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: hard negatives of every anchor and positive.

    Rows become integers floor(256 * x); a score is an integer inner product, higher first, ties by smaller id. An
    anchor's positives are its first ``positives`` rows of the same label, and each gets the first ``negatives`` rows
    of other labels with least * positive score <= 100 * score <= most * positive score.

    ``anchors`` chooses the anchors by ``id`` (default: those divisible by 100); ``label`` replaces the column
    ``label``. Rows with a null id, label or vector, a null, infinite or undefined entry, or an entry so large that
    scores could not fit a long, take no part. Vectors of unlike length never meet; empty ones score 0. A row that
    repeats stands for itself, but rows with the anchor's own id are never its partners. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    paths: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        paths.append(shared_dir(spark))
        return stash(df, paths[-1])

    rows = keep(index(vectors.where(F.col(id_col).isNotNull()), id_col, vector_col, label if label is not None else F.col("label"), codes=codes))
    asked = keep(rows.where(anchors if anchors is not None else F.col("id") % 100 == 0).withColumn("number", F.monotonically_increasing_id()))
    size = asked.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    passes = max(1, -(-size // pass_bytes))
    found = []
    for p in range(passes):
        mine_ = asked.where(F.pmod(F.xxhash64("number"), F.lit(passes)) == p).select("number", "id", "label", "dims", F.expr("substring(body, 1, 8 * int(dims))").alias("x")).orderBy("number")
        held = [(k, r["id"], r["label"], r["dims"], bytes(r["x"])) for k, r in enumerate(mine_.toLocalIterator())]
        if held:
            found.append(keep(_pass(spark, rows, held, positives, negatives, least, most, codes)))
    if not found:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    for path in paths[:2]:
        drop_stash(spark, path)
    return reduce(DataFrame.unionByName, found)

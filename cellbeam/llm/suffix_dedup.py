"""Suffix-array dedup: removes every byte of a long string that starts elsewhere as well.

A sparse suffix array is enough: of each window of ``length`` bytes only the
suffix at its anchor (the least hash of a short gram inside) is taken, so equal
windows take the same suffix. Suffixes whose gram is unique in the corpus drop out
by a join. The others are sorted where they are read, exchanged as front-coded
runs by ranges of the gram's hash, and combined with a loser tree that carries the
known common prefixes and compares only what lies behind them. The common prefix
of neighbours and the bytes left of the anchor then tell which windows repeat.
Equal texts are taken once (all of them repeats), and a gram that very many texts
hold is dealt out by a longer prefix and a longer left part in its place.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_stash, mix, shared_dir, span_hashes, stash, steps, text_buffer

#: Texts whose names are broadcast at most (64 MB as a hash table); more are joined by a shuffle.
BROADCAST_KEYS = 1 << 20
#: Suffixes that one fragment of the exchange holds about.
FRAGMENT = 1 << 17
#: Occurrences above which a gram is dealt out by more than its own bytes.
HOT = 1 << 11
#: What names a text: two hashes, one of them of its SHA-256 digest, and its number of bytes.
NAME = ["key", "twin", "size"]
_POS = np.uint64(30)


def anchors(raw: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchors of all windows of ``length`` bytes within rows: row, place in the row, hash of the gram there,
    and the least and largest distance of the anchor from a window's start."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.int64, np.int64))
    rows = np.flatnonzero(np.diff(bounds) >= length)
    if not len(rows):
        return none
    if len(raw) > 1 << 30:
        raise ValueError("a text of over 1 GiB cannot be searched for repeats")
    wide = length - gram + 1
    at = np.arange(len(raw) - gram + 1)
    hashes = span_hashes(raw, at, at + gram)
    least = (hashes >> _POS << _POS) | at.astype(np.uint64)  # ties go to the first
    span = 1
    while 2 * span <= wide:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    least = np.minimum(least[: len(least) - (wide - span)], least[wide - span :]) if wide > span else least
    n = bounds[rows + 1] - bounds[rows] - length + 1
    first = np.cumsum(n) - n
    start = np.repeat(bounds[rows] - first, n) + np.arange(n.sum())
    row = np.repeat(rows, n)
    anchor = (least[start] & np.uint64((1 << 30) - 1)).astype(np.int64)
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(anchor)) - 1
    p = anchor[head]
    return row[head], p - bounds[row[head]], hashes[p], p - start[tail], p - start[head]


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes need no look."""
    n = min(len(a), len(b)) - known
    if n <= 0:
        return min(len(a), len(b))
    x = int.from_bytes(a[known : known + n], "big") ^ int.from_bytes(b[known : known + n], "big")
    return known + n - (x.bit_length() + 7) // 8


def front_code(suffixes: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Common prefix with the one before, and the rest, of sorted strings."""
    shared = [0] + [common_prefix(a, b) for a, b in zip(suffixes, suffixes[1:], strict=False)]
    return shared[: len(suffixes)], [s[k:] for s, k in zip(suffixes, shared, strict=False)]


def merge_runs(runs: list[tuple[list[int], list[bytes]]]):
    """Merge front-coded sorted runs: yields (run, place in it, suffix, common prefix with the one before).

    A loser tree over the runs. Each player knows its common prefix with the last winner: of two players the
    one with the longer prefix is smaller without a look at the bytes; with equal prefixes the bytes behind
    decide, and the loser keeps what it now shares with the winner.
    """
    k = 1
    while k < len(runs):
        k *= 2
    text: list[bytes | None] = [r[1][0] if r[1] else None for r in runs] + [None] * (k - len(runs))
    place = [0] * k
    lcp = [0] * k

    def beats(a: int, b: int) -> bool:
        """Whether player a goes before b; the loser's prefix becomes that with the winner."""
        s, t = text[a], text[b]
        if s is None or t is None:
            return t is None
        if lcp[a] != lcp[b]:
            return lcp[a] > lcp[b]
        h = common_prefix(s, t, lcp[a])
        first = len(s) == h or len(t) > h and s[h] < t[h]
        lcp[b if first else a] = h
        return first

    losers = [0] * k
    level = list(range(k))
    at = k
    while at > 1:  # play all first games, level by level
        at //= 2
        winners = []
        for i in range(at):
            a, b = level[2 * i], level[2 * i + 1]
            won = a if beats(a, b) else b
            losers[at + i] = b if won == a else a
            winners.append(won)
        level = winners
    champion = level[0]
    while text[champion] is not None:
        c = champion
        s = text[c]
        yield c, place[c], s, lcp[c]
        place[c] += 1
        shared, rest = runs[c]
        if place[c] < len(rest):
            lcp[c] = shared[place[c]]
            text[c] = s[: lcp[c]] + rest[place[c]]
        else:
            text[c] = None
        node = (c + k) // 2
        while node:
            other = losers[node]
            if not beats(c, other):
                losers[node], c = c, other
            node //= 2
        champion = c


def common_suffix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if not n:
        return 0
    x = int.from_bytes(a[-n:], "big") ^ int.from_bytes(b[-n:], "big")
    return n if not x else ((x & -x).bit_length() - 1) // 8


#: Groups up to this size are compared pair by pair.
PAIRS = 16


def repeated(group: list[tuple[bytes, bytes, int, int, int]], lcps: list[int], length: int) -> list[tuple[int, int] | None]:
    """For suffixes in order, each with the bytes left of it, its least and largest distance and its number:
    the range (from, to), relative to the anchor, of bytes that repeated windows cover, or None.

    All windows of an anchor cover it, so their union is one range and only the least and the largest distance
    of a repeated window count. ``lcps``: common prefix of each with the one before. Two suffixes share the
    windows that their common prefix and the common bytes on the left reach together: small groups and all
    neighbours are compared that way. In large groups the windows that are still open are then counted distance
    by distance, only where a neighbour shares enough on the right.
    """
    m = len(group)
    least, most = [1 << 30] * m, [-1] * m
    for i, (_, _, lo, hi, number) in enumerate(group):
        if number > 1:
            least[i], most[i] = lo, hi
    for i in range(m):
        right = length
        for j in range(i + 1, m if m <= PAIRS else min(m, i + 2)):
            right = min(right, lcps[j])
            a, b = length - right, max(group[i][3], group[j][3])
            if a > b:
                break
            left = common_suffix(group[i][1], group[j][1])
            for k in (i, j):
                lo, hi = max(a, group[k][2]), min(left, group[k][3])
                if lo <= hi:
                    least[k], most[k] = min(least[k], lo), max(most[k], hi)
    if m > PAIRS:
        open_at: dict[int, list[int]] = {}
        wanted = set()
        for i, (_, _, lo, hi, _) in enumerate(group):
            reach = max(lcps[i] if i else 0, lcps[i + 1] if i + 1 < m else 0)
            for d in range(max(lo, length - reach), hi + 1):
                open_at.setdefault(d, []).append(i)
                if not least[i] <= d <= most[i]:
                    wanted.add(d)
        for d in wanted:
            members = open_at[d]
            if len(members) < 2:
                continue
            windows = [group[i][1][len(group[i][1]) - d :] + group[i][0][: length - d] for i in members]
            often = Counter(windows)
            for i, w in zip(members, windows, strict=True):
                if often[w] > 1:
                    least[i], most[i] = min(least[i], d), max(most[i], d)
    return [(-b, length - a) if b >= 0 else None for a, b in zip(least, most, strict=True)]


_HEAD = np.dtype([("gram", "<i8"), ("mark", "<i8"), ("shared", "<i4"), ("rest", "<i4"), ("left", "<i4"), ("lo", "<i4"), ("hi", "<i4"), ("number", "<i4")])


def _find(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """``gram``, the text's name, ``at, lo, hi`` of all anchors; ``docs``: the name, then text."""
    schema = T.StructType([*[T.StructField(x, T.LongType()) for x in ("gram", "key", "twin")], *[T.StructField(x, T.IntegerType()) for x in ("size", "at", "lo", "hi")]])

    def run(batches):
        for batch in batches:
            for part in steps(batch, "text"):
                row, at, hashes, lo, hi = anchors(*text_buffer(part.column(3)), length, gram)
                named = [part.column(i).take(pa.array(row)) for i in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), *named, *[pa.array(x.astype(np.int32)) for x in (at, lo, hi)]], names=schema.names)

    return docs.mapInArrow(run, schema)


def _halves(raw, row, p, g, lo, hi, hot, length: int, gram: int):
    """Anchors with those of hot grams replaced by up to two: one whose windows reach far to the right, named by
    the longer prefix that they share, and one further left, named by the longer string from there."""
    half = (length - gram) // 2
    back = half + 1
    right, left = np.flatnonzero(hot & (lo <= half)), np.flatnonzero(hot & (hi > half))
    a, b = p[right], p[left] - back
    parts = [
        [x[~hot] for x in (row, p, g, lo, hi)],
        [row[right], a, span_hashes(raw, a, a + length - half).view(np.int64), lo[right], np.minimum(hi[right], half)],
        [row[left], b, span_hashes(raw, b, b + back + gram).view(np.int64), np.maximum(lo[left] - back, 0), hi[left] - back],
    ]
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def _contexts(found: DataFrame, length: int, gram: int, fragments: int) -> DataFrame:
    """Sorted front-coded runs and the occurrences they stand for, by fragment of the gram's hash.

    ``found``: the text's name, text, marks (array of gram, at, lo, hi, hot). Rows with a ``run`` hold one run; rows
    with a ``mark`` say that the suffix ``mark`` of ``gram`` stands at ``at`` of the named text.
    """
    schema = T.StructType([T.StructField("fragment", T.IntegerType()), T.StructField("run", T.BinaryType()), *[T.StructField(x, T.LongType()) for x in ("gram", "mark", "key", "twin")], *[T.StructField(x, T.IntegerType()) for x in ("size", "at")]])
    width = (1 << 64) // fragments + 1

    def run(batches):
        for batch in batches:
            for part in steps(batch, "text"):
                raw, bounds = text_buffer(part.column(3))
                data = raw.tobytes()
                marks = part.column(4)
                counts = marks.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(len(counts)), counts)
                flat = marks.flatten()
                g, at, lo, hi, hot = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(5))
                row, p, g, lo, hi = _halves(raw, row, bounds[row] + at, g, lo, hi, hot, length, gram)
                at = (p - bounds[row]).astype(np.int32)
                mark = span_hashes(raw, p - hi, p + length - lo).view(np.int64) ^ (lo.astype(np.int64) << 8) ^ hi
                named = [part.column(i).take(pa.array(row)) for i in range(3)]
                none = pa.nulls(len(row), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.nulls(len(row), pa.int32()), none, pa.array(g), pa.array(mark), *named, pa.array(at)], names=schema.names)
                both = np.empty(len(g), [("g", "<i8"), ("m", "<i8")])
                both["g"], both["m"] = g, mark
                _, first, number = np.unique(both, return_index=True, return_counts=True)
                fragment = mix(np.ascontiguousarray(g).view(np.uint64)[first]) // np.uint64(width)  # anchors' own hashes are small
                blocks = {}
                for f in np.unique(fragment).tolist():
                    mine = first[fragment == f]
                    often = np.minimum(number[fragment == f], 2)
                    right = [data[a:b] for a, b in zip(p[mine].tolist(), (p + length - lo)[mine].tolist(), strict=True)]
                    order = sorted(range(len(right)), key=right.__getitem__)
                    mine, often = mine[order], often[order]
                    shared, rest = front_code([right[i] for i in order])
                    head = np.empty(len(mine), _HEAD)
                    left = [data[a:b] for a, b in zip((p - hi)[mine].tolist(), p[mine].tolist(), strict=True)]
                    for name, values in (("gram", g[mine]), ("mark", mark[mine]), ("shared", shared), ("rest", [len(x) for x in rest]), ("left", hi[mine]), ("lo", lo[mine]), ("hi", hi[mine]), ("number", often)):
                        head[name] = values
                    blocks[f] = len(head).to_bytes(8, "little") + head.tobytes() + b"".join(rest) + b"".join(left)
                n = len(blocks)
                yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int32()), pa.array(list(blocks.values()), pa.binary()), *[pa.nulls(n, pa.int64())] * 4, *[pa.nulls(n, pa.int32())] * 2], names=schema.names)

    return found.mapInArrow(run, schema)


def _read_run(block: bytes):
    n = int.from_bytes(block[:8], "little")
    head = np.frombuffer(block, _HEAD, n, 8)
    at = 8 + n * _HEAD.itemsize
    parts = []
    for name in ("rest", "left"):
        ends = at + np.cumsum(head[name])
        parts.append([block[a:b] for a, b in zip(np.append(at, ends[:-1]).tolist(), ends.tolist(), strict=True)])
        at = int(ends[-1])
    return head, head["shared"].tolist(), *parts


def _verdicts(runs: DataFrame, length: int, gram: int, fragments: int) -> DataFrame:
    """``gram, mark, start, end`` of the suffixes whose windows repeat; the range is relative to the anchor."""
    schema = T.StructType([T.StructField("gram", T.LongType()), T.StructField("mark", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])

    def judge(blocks):
        runs_in = [_read_run(b) for b in blocks]
        group: list = []
        marks: list = []
        lcps: list[int] = []
        out: dict[tuple[int, int], tuple[int, int]] = {}

        def close():
            if len(group) > 1 or group and group[0][4] > 1:
                for mark, covered in zip(marks, repeated(group, lcps, length), strict=True):
                    if covered:
                        was = out.get(mark, covered)
                        out[mark] = (min(was[0], covered[0]), max(was[1], covered[1]))
            group.clear()
            marks.clear()
            lcps.clear()

        heads = [{k: h[k].tolist() for k in ("gram", "mark", "lo", "hi", "number")} for h, *_ in runs_in]
        for r, i, suffix, lcp in merge_runs([(x[1], x[2]) for x in runs_in]):
            if lcp < gram:
                close()
            h = heads[r]
            group.append((suffix, runs_in[r][3][i], h["lo"][i], h["hi"][i], h["number"][i]))
            marks.append((h["gram"][i], h["mark"][i]))
            lcps.append(lcp)
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in out], pa.int64()), pa.array([k[1] for k in out], pa.int64()), *[pa.array([v[i] for v in out.values()], pa.int32()) for i in (0, 1)]], names=schema.names)

    def run(batches):
        now, held = None, []
        for batch in batches:
            for f, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if f != now:
                    if held:
                        yield from judge(held)
                    now, held = f, []
                held.append(block)
        if held:
            yield from judge(held)

    parts = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return runs.repartition(min(parts, fragments), "fragment").sortWithinPartitions("fragment").mapInArrow(run, schema)


def _named(docs: DataFrame, names: DataFrame, how: str) -> DataFrame:
    """A join by name; ``names`` are broadcast only if they are few enough."""
    return docs.join(F.broadcast(names) if names.count() <= BROADCAST_KEYS else names, NAME, how)


def remove_repeats(df: DataFrame, length: int = 200, gram: int = 51, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes, n_removed, spans, kept`` of every whole text, as UTF-8 bytes.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in this text or
    another; strings never cross texts and are judged on the input. ``spans``: the maximal removed runs
    (start, end); ``kept``: the other bytes. Null counts as empty; texts shorter than ``length`` keep all;
    repeated rows count as different documents, so they lose everything if they are long enough.
    """
    spark = df.sparkSession
    paths: list[str] = []

    def keep(x: DataFrame) -> DataFrame:
        paths.append(shared_dir(spark))
        return stash(x, paths[-1])

    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.xxhash64(text).alias("key"), F.xxhash64(F.sha2(text.cast("binary"), 256)).alias("twin"), F.octet_length(text).alias("size"), text.alias("text"), F.col(id_col).alias("__id"))
    long = docs.where(F.col("size") >= length).select(*NAME, "text", "__id")
    # of equal texts the one with the least id is read, and where that id is null or comes twice, any
    rows = long.groupBy(*NAME, "__id").agg(F.count(F.lit(1)).alias("n")).groupBy(*NAME)
    counts = rows.agg(F.sum("n").alias("all"), F.min("__id").alias("first"), F.min_by("n", "__id").alias("often"))
    copies = keep(counts.where("all > 1").select(*NAME, F.when(F.col("often") == 1, F.col("first")).alias("first"), F.lit(True).alias("copy")))
    texts = _named(long, copies, "left").where(F.col("copy").isNull() | (F.col("__id") == F.col("first"))).select(*NAME, "text")
    unclear = copies.where("first is null").select(*NAME)
    if not unclear.isEmpty():
        texts = texts.unionByName(_named(long, unclear, "left_semi").groupBy(*NAME).agg(F.first("text").alias("text")))
    every = keep(_find(texts, length, gram))
    # written, so that the join below is one of two plain exchanges, whose hot grams Spark can split
    common = keep(every.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    held = every.join(common, "gram").select(*NAME, F.struct("gram", "at", "lo", "hi", (F.col("n") > HOT).alias("hot")).alias("mark"))
    some = keep(held.groupBy(*NAME).agg(F.collect_list("mark").alias("marks"), F.count(F.lit(1)).alias("n")))
    total = some.agg(F.sum("n")).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fragments = max(parts, total // FRAGMENT + 1)
    within = _named(texts, some.select(*NAME), "left_semi")
    contexts = keep(_contexts(within.join(some, NAME).select(*NAME, "text", "marks"), length, gram, fragments))
    drop_stash(spark, paths[1])
    verdicts = _verdicts(contexts.where("run is not null").select("fragment", "run"), length, gram, fragments)
    hits = contexts.where("mark is not null").select("gram", "mark", *NAME, "at").join(verdicts, ["gram", "mark"])
    cover = keep(hits.groupBy(*NAME).agg(F.collect_list(F.struct((F.col("at") + F.col("start")).alias("start"), (F.col("at") + F.col("end")).alias("end"))).alias("marks")))
    for path in paths[2:5]:
        drop_stash(spark, path)
    kind = df.schema[id_col]
    run_type = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([T.StructField(id_col, kind.dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", T.ArrayType(run_type)), T.StructField("kept", T.BinaryType())])
    arrow_runs = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches):
        for batch in batches:
            for part in steps(batch, "text"):
                raw, bounds = text_buffer(part.column(1))
                data = raw.tobytes()
                spans, kept, gone = [], [], []
                for i, marks in enumerate(part.column(2)):
                    lo, hi = int(bounds[i]), int(bounds[i + 1])
                    runs_here: list[list[int]] = []
                    if marks.is_valid:
                        values = marks.values
                        for s, e in sorted(zip(values.field(0).to_pylist(), values.field(1).to_pylist(), strict=True)):
                            if runs_here and s <= runs_here[-1][1]:
                                runs_here[-1][1] = max(e, runs_here[-1][1])
                            else:
                                runs_here.append([s, e])
                    edges = [0, *[x for r in runs_here for x in r], hi - lo]
                    kept.append(b"".join([data[lo + a : lo + b] for a, b in zip(edges[::2], edges[1::2], strict=True)]) if runs_here else data[lo:hi])
                    gone.append(sum(e - s for s, e in runs_here))
                    spans.append([{"start": s, "end": e} for s, e in runs_here])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(bounds)), pa.array(gone, pa.int64()), pa.array(spans, arrow_runs), pa.array(kept, pa.binary())], names=schema.names)

    kind = cover.schema["marks"].dataType
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("size").alias("end"))).cast(kind)
    flagged = _named(docs, copies.select(*NAME, "copy"), "left")
    flagged = _named(flagged, cover.select(*NAME, F.lit(True).alias("covered")), "left")
    part = F.col("copy").isNull() & F.col("covered").isNotNull()
    # only texts of which a part goes are shuffled, to meet their marks
    marked = flagged.where(part).join(cover, NAME).select("__id", "text", "marks")
    others = flagged.where(~part).select("__id", "text", F.when(F.col("copy"), whole).alias("marks"))
    return others.unionByName(marked).mapInArrow(cut, schema)

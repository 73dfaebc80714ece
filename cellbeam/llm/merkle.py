"""Document fingerprints: a Merkle tree over pieces, paragraphs and sections.

Pieces of a few words (cut where the bytes themselves say so) make a paragraph (a
line), paragraphs make a section (closed where a paragraph's hash says so), and
sections make the root. Equal roots mean equal texts; where roots differ, equal
sections and paragraphs are skipped and the differing branches locate the edit.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.batches import bisect
from .common import span_hashes, text_buffer

_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)
#: Hex digits of a piece and of a paragraph or section in the fingerprint; one word end in CUT ends a piece.
PIECE, BRANCH, CUT = 8, 12, 4
#: Most bytes of a piece.
LONGEST = 80


def fingerprints(texts: list[str]) -> list[str]:
    """``root:section=paragraph-pieces.paragraph-pieces/section=...`` of each text, in hexadecimal."""
    raw, bounds = text_buffer(pa.array(texts, pa.string()))
    ends = np.zeros(0, np.int64)
    if len(raw) > 2:
        wide = raw.astype(np.int64)
        chosen = np.zeros(len(raw), bool)
        chosen[2:] = (raw[2:] == 32) & ((wide[1:-1] * 7 + wide[:-2] * 13 >> 2) % CUT == 0)
        for k in (0, 1):  # a cut there would depend on the text before
            chosen[(bounds[:-1] + k)[bounds[:-1] + k < len(raw)]] = False
        ends = np.flatnonzero(chosen | (raw == 10)) + 1
    cuts = np.unique(np.concatenate([bounds, ends]))
    parts = np.maximum((np.diff(cuts) + LONGEST - 1) // LONGEST, 1) if len(cuts) > 1 else np.zeros(0, np.int64)
    if len(parts) and parts.max() > 1:  # words without an end
        within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        cuts = np.append(np.repeat(cuts[:-1], parts) + within * LONGEST, cuts[-1])
    starts, stops = cuts[:-1], cuts[1:]
    codes = span_hashes(raw, starts, stops) if len(starts) else np.zeros(0, np.uint64)
    digits = np.stack([_HEX[(codes >> np.uint64(4 * k + 20)) & np.uint64(15)] for k in range(PIECE)], 1).tobytes().decode() if len(codes) else ""
    out = []
    data = raw.tobytes()
    sha = hashlib.sha256
    begins = starts.tolist()
    place = dict(zip(begins, range(len(begins)), strict=True))
    place[len(data)] = len(begins)
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        sections: list[str] = []
        members: list[str] = []
        inside, whole, at = sha(), sha(), lo

        def close():
            nonlocal inside, members
            h = inside.digest()
            whole.update(h)
            sections.append(f"{h.hex()[:BRANCH]}={'.'.join(members)}")
            inside, members = sha(), []

        while at < hi:
            to = data.find(b"\n", at, hi) + 1 or hi
            h = sha(data[at:to])
            inside.update(h.digest())
            members.append(f"{h.hexdigest()[:BRANCH]}-{digits[PIECE * place[at] : PIECE * place[to]]}")
            if h.digest()[-1] & 3 == 0:
                close()
            at = to
        if members:
            close()
        out.append(f"{whole.hexdigest()[:32]}:{'/'.join(sections)}")
    return out


def _branches(fingerprint: str) -> list[tuple[str, list[tuple[str, str]]]]:
    body = fingerprint.partition(":")[2]
    return [(s[:BRANCH], [(p[:BRANCH], p[BRANCH + 1 :]) for p in s[BRANCH + 1 :].split(".")]) for s in body.split("/")] if body else []


def likeness(a: str, b: str) -> float:
    """Share of pieces that two fingerprints have in common (Dice), 1 for equal roots. Goes down differing branches only."""
    if a == b:
        return 1.0
    left, right = _branches(a), _branches(b)
    size = sum(len(p[1]) for s in left + right for p in s[1]) // PIECE
    if not size:
        return 1.0 if not left and not right else 0.0
    common = 0

    def unmatched(xs, ys, weigh):
        nonlocal common
        both = Counter(x[0] for x in xs) & Counter(y[0] for y in ys)
        rest = []
        for side in (xs, ys):
            left_over, kept = Counter(both), []
            for x in side:
                if left_over[x[0]]:
                    left_over[x[0]] -= 1
                    if side is xs:
                        common += weigh(x[1])
                else:
                    kept.append(x)
            rest.append(kept)
        return rest

    xs, ys = unmatched(left, right, lambda ps: sum(len(p[1]) for p in ps) // PIECE)
    ps, qs = unmatched([p for s in xs for p in s[1]], [p for s in ys for p in s[1]], lambda d: len(d) // PIECE)
    cut = lambda d: [d[i : i + PIECE] for i in range(0, len(d), PIECE)]
    common += sum((Counter(c for p in ps for c in cut(p[1])) & Counter(c for q in qs for c in cut(q[1]))).values())
    return 2 * common / size


def differing(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) numbers of ``a`` between the first and the last branch that differs from ``b``."""

    def middle(x: list[str], y: list[str]) -> tuple[int, int, int]:
        head = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
        most = min(len(x), len(y)) - head
        tail = next((i for i in range(most) if x[-1 - i] != y[-1 - i]), most)
        return head, len(x) - tail, len(y) - tail

    left, right = _branches(a), _branches(b)
    head, end_a, end_b = middle([s[0] for s in left], [s[0] for s in right])
    at = [(i, j) for i in range(head, end_a) for j in range(len(left[i][1]))]
    first, last, _ = middle([left[i][1][j][0] for i, j in at], [p[0] for s in right[head:end_b] for p in s[1]])
    return at[first:last]


def fingerprint(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, fingerprint`` of every whole text; null counts as empty. No shuffle."""
    src = df.select(F.col(id_col), F.col(text_col).alias("__text"))
    schema = T.StructType([src.schema.fields[0], T.StructField("fingerprint", T.StringType())])

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fingerprints([t or "" for t in part.column(1).to_pylist()]), pa.string())], names=schema.names)

    return src.mapInArrow(run, schema)


def with_next(df: DataFrame, use, schema: T.StructType, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Apply ``use(ids, texts, next_texts) -> RecordBatch`` to all rows, each with its follower by ascending id.

    The last row's follower is the first row; rows of one id follow each other by text, null ids come first.
    One shuffle: ids are cut to ranges at approximate quantiles, a range's first row is sent to the range before
    it as well, and each task walks its sorted rows. The driver sees the quantiles and each range's least id.
    """
    spark = df.sparkSession
    least = -(1 << 63)
    src = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(least)).alias("__key"), F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = sorted(set(src.select("__key").stat.approxQuantile("__key", [i / n for i in range(1, n)], 0.1 / n))) if n > 1 else []
    src = src.withColumn("__range", bisect([int(c) for c in cuts], F.col("__key")))
    firsts = sorted((r[0], r[1]) for r in src.groupBy("__range").agg(F.min("__key")).collect())
    before = {firsts[i][0]: (firsts[i - 1][0], firsts[i][1]) for i in range(len(firsts))}
    own = F.struct(F.col("__range").alias("to"), F.lit(0).alias("copy"))
    if before:
        # by range number: where its first row goes as well, and that row's id
        none = F.lit(None).cast("struct<to:int,key:bigint>")
        sent = [F.struct(F.lit(before[k][0]).alias("to"), F.lit(before[k][1]).cast("long").alias("key")) if k in before else none for k in range(len(cuts) + 1)]
        there = F.get(F.array(*sent), F.col("__range"))
        own = F.when(F.col("__key") == there["key"], F.array(own, F.struct(there["to"].alias("to"), F.lit(1).alias("copy")))).otherwise(F.array(own))
    else:
        own = F.array(own)
    dealt = src.withColumn("__at", F.explode(own)).select("__at.to", "__at.copy", "__key", "__id", "__text")
    dealt = dealt.repartition(n, "to").sortWithinPartitions("to", "copy", "__key", "__text")

    def run(batches):
        held = None
        for batch in batches:
            for lo in range(0, batch.num_rows, 400):
                part = batch.slice(lo, 400)
                copy, ids, texts = (part.column(i).to_pylist() for i in (1, 3, 4))
                if held is not None:
                    copy, ids, texts = [held[0], *copy], [held[1], *ids], [held[2], *texts]
                held = (copy[-1], ids[-1], texts[-1])
                rows = [i for i in range(len(ids) - 1) if not copy[i]]
                if rows:
                    yield use([ids[i] for i in rows], [texts[i] for i in rows], [texts[i + 1] for i in rows])

    return dealt.mapInArrow(run, schema)


def compare_with_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they are.

    The edited text has its last floor(n/2) code points replaced by the first as many (or all) of the next text.
    A null text counts as empty. Equal texts have equal fingerprints, so their likeness is 1.
    """
    kind = df.select(id_col).schema.fields[0]
    text, real = T.StringType(), T.DoubleType()
    schema = T.StructType([kind, T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", text), T.StructField("fingerprint", text), T.StructField("edited_fingerprint", text), T.StructField("near_edited", real), T.StructField("near_next", real)])

    def use(ids, texts, followers):
        edited = [t[: len(t) - len(t) // 2] + f[: len(t) // 2] for t, f in zip(texts, followers, strict=True)]
        own, after = fingerprints(texts), fingerprints(edited)
        known = dict(zip(texts, own, strict=True))
        lone = [f for f in dict.fromkeys(followers) if f not in known]
        known.update(zip(lone, fingerprints(lone), strict=True))
        cols = [pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]), pa.array(own, pa.string()), pa.array(after, pa.string()), pa.array([likeness(a, b) for a, b in zip(own, after, strict=True)]), pa.array([likeness(a, known[f]) for a, f in zip(own, followers, strict=True)])]
        return pa.RecordBatch.from_arrays([pa.array(ids, arrow_kind), *cols], names=schema.names)

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_kind = to_arrow_type(kind.dataType)
    return with_next(df, use, schema, id_col, text_col)

"""Quality rules: gradient-boosted trees over document statistics.

The trees are fitted in numpy on a bounded sample of labelled documents, with
monotonic constraints on chosen statistics, and flattened into node arrays, so
that scoring a batch is a few array look-ups per tree level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, mix, span_hashes, steps, text_buffer, words_of
from .labelled import labelled_sample

#: The symbol characters of the base rule.
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_digits", "n_lines", "n_distinct")
#: Feature name -> monotonic constraint on quality: -1 falling, 1 rising, 0 free.
FEATURES = {"log_words": 0, "word_length": 0, "symbol_ratio": -1, "dup_line_ratio": -1, "repeat_ratio": -1, "upper_ratio": -1, "mark_ratio": -1, "digit_ratio": 0, "line_words": 0, "distinct_ratio": 0}
_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_IS_MARK = np.isin(np.arange(256), list(b"!?"))


def _lines(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of each \\n-split line; every row has one line at least."""
    breaks = np.flatnonzero(raw == 10)
    starts = np.sort(np.concatenate([bounds[:-1], breaks + 1]))
    ends = np.sort(np.concatenate([breaks, bounds[1:]]))
    per_row = 1 + np.diff(np.searchsorted(breaks, bounds))
    return starts, ends, np.repeat(np.arange(len(bounds) - 1), per_row)


def count_stats(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """int64 array, one row per text and one column per name in COUNTS."""
    rows = len(bounds) - 1
    out = np.zeros((rows, len(COUNTS)), np.int64)

    def per_row(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[bounds[1:]] - total[bounds[:-1]]

    def distinct(keys: np.ndarray, row: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            both = mix(keys + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, first = np.unique(both, return_index=True)
        return np.bincount(row[first], minlength=rows)

    starts, ends, word_bounds = words_of(raw, bounds)
    n_words = np.diff(word_bounds)
    word_row = np.repeat(np.arange(rows), n_words)
    hashes = span_hashes(raw, starts, ends)
    out[:, 0] = n_words
    out[:, 1] = per_row(((raw & 0xC0) != 0x80) & ~SPACE[raw])
    out[:, 2] = per_row(_IS_SYMBOL[raw])
    line_start, line_end, line_row = _lines(raw, bounds)
    wordy = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_hash = span_hashes(raw, line_start[wordy], line_end[wordy])
    out[:, 3] = np.bincount(line_row[wordy], minlength=rows) - distinct(line_hash, line_row[wordy])
    if len(hashes) >= 3:
        with np.errstate(over="ignore"):
            three = mix(hashes[:-2] + mix(hashes[1:-1] + mix(hashes[2:] + word_row[2:].astype(np.uint64))))
        at = np.flatnonzero(word_row[:-2] == word_row[2:])
        order = at[np.argsort(three[at], kind="stable")]
        key = three[order]
        same = np.zeros(len(order), bool)
        same[1:] = key[1:] == key[:-1]
        same[:-1] |= key[1:] == key[:-1]
        covered = np.zeros(len(hashes), bool)
        for k in range(3):
            covered[order[same] + k] = True
        out[:, 4] = np.bincount(word_row[covered], minlength=rows)
    out[:, 5] = per_row((raw >= 65) & (raw <= 90))
    out[:, 6] = per_row(_IS_MARK[raw])
    out[:, 7] = per_row((raw >= 48) & (raw <= 57))
    out[:, 8] = np.bincount(line_row[wordy], minlength=rows)
    out[:, 9] = distinct(hashes, word_row)
    return out


def features(counts: np.ndarray) -> np.ndarray:
    """The columns named in FEATURES, from COUNTS."""
    c = {k: counts[:, i].astype(float) for i, k in enumerate(COUNTS)}
    words, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1), np.maximum(c["n_lines"], 1)
    return np.column_stack([np.log1p(c["n_words"]), chars / words, c["n_symbols"] / chars, c["n_dup_lines"] / lines, c["n_repeat_words"] / words, c["n_upper"] / chars, c["n_marks"] / chars, c["n_digits"] / chars, words / lines, c["n_distinct"] / words])


@dataclass
class Trees:
    """All trees in shared node arrays: a leaf has ``left`` -1. ``roots`` leads to each tree."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            while True:
                inner = self.left[node] >= 0
                if not inner.any():
                    break
                go_left = x[rows, self.feature[node]] <= self.cut[node]
                node = np.where(inner, np.where(go_left, self.left[node], self.right[node]), node)
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, least: int = 20, l2: float = 2.0) -> Trees:
    """Boosted trees for the logistic loss on histogram bins.

    A split on a constrained feature is taken only if its two values keep the order, and the values below it
    stay on their side of the middle, so the whole score is monotonic. Without rows, or with one label only,
    there are no trees and the score is constant.
    """
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    nodes: list[list] = []
    roots: list[int] = []
    if len(y) and y.min() != y.max():
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins)[1:-1])) for f in range(x.shape[1])]
        codes = [np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)]
        total = np.full(len(y), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-total))
            g, h = y - p, p * (1 - p)
            grown = [(np.arange(len(y)), -np.inf, np.inf, 0)]
            roots.append(len(nodes))
            nodes.append([0, 0.0, -1, -1, 0.0])
            at = [roots[-1]]
            while grown:
                (rows, lo, hi, level), me = grown.pop(), at.pop()
                gs, hs = g[rows].sum(), h[rows].sum()
                best = (1e-6, None)
                for f, e in enumerate(edges if level < depth and len(rows) >= 2 * least else []):
                    c = codes[f][rows]
                    gl = np.cumsum(np.bincount(c, g[rows], len(e) + 1))[:-1]
                    hl = np.cumsum(np.bincount(c, h[rows], len(e) + 1))[:-1]
                    nl = np.cumsum(np.bincount(c, minlength=len(e) + 1))[:-1]
                    wl, wr = np.clip(gl / (hl + l2), lo, hi), np.clip((gs - gl) / (hs - hl + l2), lo, hi)
                    gain = gl * gl / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs * gs / (hs + l2)
                    fine = (nl >= least) & (len(rows) - nl >= least) & (monotone[f] * (wr - wl) >= 0)
                    gain = np.where(fine, gain, -1)
                    if len(gain) and gain.max() > best[0]:
                        k = int(gain.argmax())
                        best = (gain[k], (f, k, wl[k], wr[k]))
                if best[1] is None:
                    value = float(np.clip(gs / (hs + l2), lo, hi)) * rate
                    nodes[me][4] = value
                    total[rows] += value
                    continue
                f, k, wl, wr = best[1]
                go = codes[f][rows] <= k
                mid = (wl + wr) / 2
                left, right = ((lo, mid), (mid, hi)) if monotone[f] > 0 else ((mid, hi), (lo, mid)) if monotone[f] < 0 else ((lo, hi), (lo, hi))
                nodes[me][:4] = [f, float(edges[f][k]), len(nodes), len(nodes) + 1]
                for part, span in ((rows[go], left), (rows[~go], right)):
                    at.append(len(nodes))
                    nodes.append([0, 0.0, -1, -1, 0.0])
                    grown.append((part, *span, level + 1))
    flat = list(zip(*nodes, strict=True)) or [()] * 5
    return Trees(np.array(flat[0], int), np.array(flat[1], float), np.array(flat[2], int), np.array(flat[3], int), np.array(flat[4], float), np.array(roots, int), base)


_STATS = T.StructType([T.StructField(k, T.LongType()) for k in COUNTS])


def document_stats(df: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, the columns ``keep`` and COUNTS of every whole text; a null text counts as empty."""
    src = df.select(id_col, *keep, F.col(text_col).alias("__text"))
    schema = T.StructType([*src.schema.fields[:-1], *_STATS.fields])

    def run(batches):
        for batch in batches:
            for part in steps(batch, "__text"):
                counts = count_stats(*text_buffer(part.column(part.num_columns - 1)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *[pa.array(counts[:, i]) for i in range(len(COUNTS))]], names=schema.names)

    return src.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", bound: int = 20_000) -> Trees:
    """Trees from about ``bound`` labelled documents at most; only their statistics come to the driver."""
    sample = labelled_sample(docs, labels, label_col, bound)
    rows = document_stats(sample, "__id", "__text", ("__label",)).toArrow()
    rows = rows.sort_by([(k, "ascending") for k in rows.schema.names])
    counts = np.column_stack([rows[k].to_numpy() for k in COUNTS]) if rows.num_rows else np.zeros((0, len(COUNTS)), np.int64)
    return fit_trees(features(counts), rows["__label"].to_numpy().astype(float), list(FEATURES.values()))


def judge(df: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text", least_words: int = 50, most_repeat: int = 50, threshold: float = 0.5) -> DataFrame:
    """Statistics and verdict of every whole text.

    ``base_failed``: fewer than ``least_words`` words, or over ``most_repeat`` per cent of them in repeated
    3-word windows. ``kept``: not base_failed and ``score`` of the trees >= ``threshold``. Null and empty texts
    have no words and fail the base rule; repeated rows are judged alike. No shuffle.
    """
    src = df.select(F.col(id_col), F.col(text_col).alias("__text"))
    schema = T.StructType([src.schema.fields[0], *_STATS.fields[:5], T.StructField("base_failed", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())])

    def run(batches):
        for batch in batches:
            for part in steps(batch, "__text"):
                counts = count_stats(*text_buffer(part.column(1)))
                failed = (counts[:, 0] < least_words) | (100 * counts[:, 4] > most_repeat * counts[:, 0])
                score = model.score(features(counts))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(counts[:, i]) for i in range(5)], pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))], names=schema.names)

    return src.mapInArrow(run, schema)

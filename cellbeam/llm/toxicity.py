"""Toxicity: a support vector machine on a subsequence string kernel with Nystrom landmarks.

The kernel counts common subsequences of three letters, each weighted by ``decay``
to the power of the span it takes in either word (spans up to ``SPAN``), so an
insult with gaps or inserted characters stays close to the plain one. Landmark words
come from the labelled sample, and only such as keep their own kernel matrix K
positive definite: K to the power -1/2 turns kernel values with the landmarks into
coordinates whose inner products are K again for the landmarks, and a kernel for all
sentences. A sentence is compared with each landmark by its best word. The machine is
trained on sentences that carry their document's label; a small logistic layer turns
the margins of all sentences of a document into a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_stash, shared_dir, span_hashes, stash, steps, text_buffer, words_of
from .labelled import labelled_sample

#: Longest span of a subsequence of three letters, and the weight of one position of it.
SPAN, DECAY = 6, 0.6
#: Kernel values below this count as none, those of two landmarks as well; the others are taken to this power.
FLOOR, POWER = 0.4, 3
#: Least eigenvalue that the landmarks' own kernel matrix keeps.
DEFINITE = 0.02
#: Text bytes of a step: several arrays of words and subsequences stand beside them.
STEP = 1 << 19
#: Parts of the sample; the layer learns from each by a machine fitted on the others.
FOLDS = 4
#: Far words that a worker remembers (8 bytes each) before it starts anew.
FAR = 1 << 19
_CLASS = np.zeros(256, np.int64)  # 0: dropped; letters 1-26 without case; digits 27; other bytes 28-31
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)
_CLASS[48:58] = 27
_CLASS[128:] = 28 + np.arange(128) % 4
_ENDS = np.isin(np.arange(256), list(b".!?\n"))
_GAPS = [(a, b) for a in range(1, SPAN) for b in range(1, SPAN) if a + b < SPAN]


@dataclass
class Units:
    """Words (runs of one-letter words joined) of some texts, as letter classes laid end to end."""

    letters: np.ndarray
    unit: np.ndarray  # of each letter
    row: np.ndarray  # of each unit
    sentence: np.ndarray  # of each unit, numbered over all rows
    key: np.ndarray  # hash of each unit


def units_of(raw: np.ndarray, bounds: np.ndarray) -> Units:
    starts, ends, word_bounds = words_of(raw, bounds)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(word_bounds))
    classes = _CLASS[raw]
    solid = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(classes > 0, out=solid[1:])
    size = solid[ends] - solid[starts]
    stops = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(_ENDS[raw], out=stops[1:])
    new = np.ones(len(starts), bool)
    if len(starts) > 1:
        new[1:] = (size[1:] != 1) | (size[:-1] != 1) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1 if len(first) else first
    a, b = starts[first], ends[last]
    inside = np.zeros(len(raw) + 1, np.int64)
    np.add.at(inside, a, 1)
    np.add.at(inside, b, -1)
    at = np.flatnonzero((np.cumsum(inside[:-1]) > 0) & (classes > 0))
    small = classes[at].astype(np.uint8)
    lo, hi = solid[a], solid[b]
    # stops before a unit number its sentence; a row's first unit starts one as well
    row_first = np.zeros(len(first), np.int64)
    if len(first):
        row_first[1:] = row[first][1:] != row[first][:-1]
    sentence = stops[a] + np.cumsum(row_first)
    skipped = np.searchsorted(at, a)
    return Units(classes[at], np.repeat(np.arange(len(first)), hi - lo), row[first], sentence, span_hashes(small, skipped, skipped + (hi - lo)))


def subsequences(letters: np.ndarray, unit: np.ndarray):
    """(unit, code, weight) arrays of all subsequences of three letters within one unit, by gap pair."""
    for a, b in _GAPS:
        if len(letters) > a + b:
            same = np.flatnonzero(unit[: -(a + b)] == unit[a + b :])
            yield same, letters[same] << 10 | letters[same + a] << 5 | letters[same + a + b], DECAY ** (a + b + 1)


def sparse_map(letters: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The kernel's own feature map: unit, code, weight with each (unit, code) once."""
    got = [(unit[at], code, np.full(len(at), w)) for at, code, w in subsequences(letters, unit)]
    if not got:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    u, c, w = (np.concatenate(x) for x in zip(*got, strict=True))
    keys, back = np.unique(u << 15 | c, return_inverse=True)
    return keys >> 15, keys & 32767, np.bincount(back, w, len(keys))


#: Sorted keys of words known to be far from all landmarks, by the landmarks' words; of the last model only.
_FAR: dict[tuple[str, ...], np.ndarray] = {}


@dataclass
class Landmarks:
    """Landmark words with unit length in the kernel's space: ``table`` leads from a code to its row of ``weights``."""

    words: list[str]
    table: np.ndarray
    weights: np.ndarray
    most: np.ndarray  # the largest weight of each row

    @staticmethod
    def of(words: list[str]) -> "Landmarks":
        raw, bounds = text_buffer(pa.array(words, pa.string()))
        units = units_of(raw, bounds)
        u, c, w = sparse_map(units.letters, units.unit)
        owner = units.row[u] if len(u) else u
        norm = np.sqrt(np.bincount(owner, w * w, len(words)))
        codes, at = np.unique(c, return_inverse=True)
        table = np.full(32768, -1, np.int64)
        table[codes] = np.arange(len(codes))
        weights = np.zeros((len(codes), len(words)))
        np.add.at(weights, (at, owner), w / norm[owner])
        return Landmarks(words, table, weights, weights.max(1, initial=0))

    def own(self) -> np.ndarray:
        """The landmarks' kernel matrix among themselves."""
        k = self.weights.T @ self.weights
        return np.where(k < FLOOR, 0, k) ** POWER

    def root(self) -> np.ndarray:
        """The Nystrom map: from kernel values with the landmarks to coordinates."""
        value, vector = np.linalg.eigh(self.own())
        return vector @ np.diag(value**-0.5) @ vector.T

    def pick(self, at: list[int]) -> "Landmarks":
        return Landmarks([self.words[i] for i in at], self.table, self.weights[:, at], self.weights[:, at].max(1, initial=0))

    def kernel(self, units: Units) -> tuple[np.ndarray, np.ndarray]:
        """Unit numbers near any landmark, and their normalised kernel rows; other units have zero rows."""
        n, m = len(units.row), len(self.words)
        if not n or not m:
            return np.zeros(0, np.int64), np.zeros((0, m))
        keys, first, back = np.unique(units.key, return_index=True, return_inverse=True)
        name = tuple(self.words)
        if name not in _FAR:
            _FAR.clear()
        far = _FAR.get(name, np.zeros(0, np.uint64))
        known = far[np.minimum(np.searchsorted(far, keys), len(far) - 1)] == keys if len(far) else np.zeros(len(keys), bool)
        chosen = np.zeros(n, bool)
        chosen[first[~known]] = True
        pick = chosen[units.unit]
        letters, unit = units.letters[pick], units.unit[pick]
        bound, length = np.zeros(n), np.bincount(unit, minlength=n)
        parts = []
        for at, code, w in subsequences(letters, unit):
            row = self.table[code]
            hit = np.flatnonzero(row >= 0)
            parts.append((unit[at[hit]], row[hit], np.full(len(hit), w)))
            bound += np.bincount(parts[-1][0], w * self.most[row[hit]], n)
        # a unit's product with any landmark is at most this bound, its own length at least this root: others are under FLOOR
        least = np.zeros(n)
        for a, b in _GAPS:
            least += np.maximum(length - a - b, 0) * DECAY ** (2 * (a + b + 1))
        near = (bound >= FLOOR * np.sqrt(least)) & (least > 0)
        u, r, w = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3
        keep = near[u]
        u, r, w = u[keep], r[keep], w[keep]
        ids = np.flatnonzero(near)
        local = np.full(n, -1, np.int64)
        local[ids] = np.arange(len(ids))
        values = np.zeros((len(ids), m))
        for lo in range(0, len(u), 200_000):
            part = slice(lo, lo + 200_000)
            order = np.argsort(local[u[part]], kind="stable")
            rows = local[u[part]][order]
            cuts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1])) if len(rows) else rows
            if len(rows):
                values[rows[cuts]] += np.add.reduceat(self.weights[r[part][order]] * w[part][order][:, None], cuts, axis=0)
        sub = near[unit]
        su, _, sw = sparse_map(letters[sub], local[unit[sub]])
        norm = np.sqrt(np.bincount(su, sw * sw, len(ids))) if len(su) else np.ones(len(ids))
        values /= np.maximum(norm, 1e-12)[:, None]
        values = np.where(values < FLOOR, 0, values) ** POWER
        close = values.any(1)
        place = np.full(n, -1, np.int64)
        place[ids[close]] = np.flatnonzero(close)
        new = keys[~known & (place[first] < 0)]
        _FAR[name] = new if len(far) + len(new) > FAR else np.insert(far, np.searchsorted(far, new), new)  # both sorted, none in common
        of_unit = place[first][back]
        active = np.flatnonzero(of_unit >= 0)
        return active, values[of_unit[active]]


@dataclass
class ToxicityModel:
    landmarks: Landmarks
    weights: np.ndarray  # on the sentence's landmark kernel values, the Nystrom map included
    bias: float
    layer: np.ndarray  # logistic: constant and the document features

    def margins(self, units: Units) -> tuple[np.ndarray, np.ndarray]:
        """Row and margin of each sentence that has a word near a landmark."""
        rows, _, values = sentence_rows(self.landmarks, units)
        return rows, values @ self.weights + self.bias

    def score(self, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        rows, margin = self.margins(units_of(raw, bounds))
        return 1 / (1 + np.exp(-(self.layer[0] + document_features(rows, margin, self.bias, len(bounds) - 1) @ self.layer[1:])))


def document_features(rows: np.ndarray, margin: np.ndarray, bias: float, n: int) -> np.ndarray:
    """Of each document: its worst sentence's margin, its sentences beyond the border, all margins summed."""
    best = np.full(n, bias)
    np.maximum.at(best, rows, margin)
    many, total = np.bincount(rows, margin > 0, n), np.bincount(rows, np.maximum(margin - bias, 0), n)
    return np.column_stack([np.clip(best, -3, 3), np.log1p(many), np.log1p(total)])


def sentence_rows(landmarks: Landmarks, units: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, sentence and landmark kernel values (best word) of the sentences near any landmark."""
    active, values = landmarks.kernel(units)
    if not len(active):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, len(landmarks.words)))
    s = units.sentence[active]
    cuts = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    return units.row[active[cuts]], s[cuts], np.maximum.reduceat(values, cuts, axis=0)


def fit_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Newton steps; y is -1 or 1."""
    z = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-4
    for _ in range(rounds):
        inside = y * (z @ w) < 1
        zi, ci = z[inside], cost * weight[inside]
        new = np.linalg.solve(ridge + (zi * ci[:, None]).T @ zi, (zi * ci[:, None]).T @ y[inside])
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w[:-1], float(w[-1])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 40) -> np.ndarray:
    z = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z @ w))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-7:
            break
    return w


def landmark_words(sample: DataFrame, n: int, alike: float = 0.85) -> Landmarks:
    """The words and word beginnings of the sample that tell label 1 apart best, none ``alike`` an earlier one or
    (up to the kernel) a sum of earlier ones."""
    words = F.regexp_extract_all(F.lower("__text"), F.lit(r"(\p{L}{3,24})"), 1)
    stems = [F.expr(f"transform(regexp_extract_all(lower(__text), '(\\\\p{{L}}{{3,24}})', 1), w -> substring(w, 1, {n}))") for n in (5, 6, 7)]
    docs = sample.select("__id", "__label", F.explode(F.array_distinct(F.concat(words, *stems))).alias("word"))
    by_word = docs.groupBy("word").agg(F.sum("__label").alias("ones"), F.count(F.lit(1)).alias("docs"))
    total = sample.agg(F.sum("__label"), F.count(F.lit(1))).first()
    ones, zeros = float(total[0] or 0), float((total[1] or 0) - (total[0] or 0))
    odds = F.log((F.col("ones") + 0.5) / (ones + 1)) - F.log((F.col("docs") - F.col("ones") + 0.5) / (zeros + 1))
    best = by_word.where("ones >= 3").withColumn("gain", odds * F.sqrt("ones")).where("gain > 0").orderBy(F.desc("gain"), "word").limit(8 * n)
    words = [r[0] for r in best.select("word").collect()]
    every = Landmarks.of(words)
    near, own = every.weights.T @ every.weights, every.own()
    chosen: list[int] = []
    for i in range(len(words)):
        more = [*chosen, i]
        if len(chosen) < n and all(near[i, j] < alike for j in chosen) and np.linalg.eigvalsh(own[np.ix_(more, more)])[0] >= DEFINITE:
            chosen = more
    return every.pick(chosen)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", bound: int = 8_000, landmarks: int = 64, cost: float = 5_000.0, per_doc: int = 4) -> ToxicityModel:
    """Fit on about ``bound`` labelled documents at most.

    The machine learns from the ``per_doc`` sentences of each sampled document that are nearest to a landmark:
    only these values and the landmark words come to the driver. The layer learns from all sentences of the
    sampled documents, by margins of machines that have not seen the document. Without labels of both kinds
    every score is the share of label 1.
    """
    sample = labelled_sample(docs, labels, label_col, bound).where("__label in (0, 1)")
    sample = sample.select("__id", "__label", "__text", F.pmod(F.xxhash64(F.lit("fold"), "__id"), F.lit(FOLDS)).cast("int").alias("__fold"))
    spark, at = docs.sparkSession, shared_dir(docs.sparkSession)
    sample = stash(sample, at)
    marks = landmark_words(sample, landmarks)
    m = len(marks.words)
    schema = T.StructType([*[T.StructField(x, T.IntegerType()) for x in ("label", "fold")], T.StructField("values", T.ArrayType(T.DoubleType()))])

    def nearest(batches):
        for batch in batches:
            for part in steps(batch, "__text", STEP):
                rows, _, values = sentence_rows(marks, units_of(*text_buffer(part.column(2))))
                order = np.lexsort((-values.max(1), rows)) if len(rows) else rows
                rank = np.arange(len(order)) - np.searchsorted(rows[order], rows[order])
                taken = order[rank < per_doc]
                rest = np.setdiff1d(np.arange(part.num_rows), rows)
                own = pa.array(np.concatenate([rows[taken], rest]))
                vals = [*values[taken].tolist(), *([[0.0] * m] * len(rest))]
                yield pa.RecordBatch.from_arrays([part.column(1).take(own), part.column(3).take(own), pa.array(vals, pa.list_(pa.float64()))], names=schema.names)

    got = sample.mapInArrow(nearest, schema).toArrow()
    y, fold = got["label"].to_numpy().astype(float), got["fold"].to_numpy()
    x = np.array(got["values"].to_pylist(), float).reshape(len(y), m)
    share = (y.sum() + 1) / (len(y) + 2)
    if not m or not len(y) or y.min() == y.max():
        drop_stash(spark, at)
        return ToxicityModel(marks, np.zeros(m), -1.0, np.array([np.log(share / (1 - share)), 0.0, 0.0, 0.0]))
    order = np.lexsort((*x.T, fold, y))  # rows arrive in any order; sums of floats then come out alike
    y, fold, x = y[order], fold[order], x[order]
    root = marks.root()
    z = x @ root

    def machine(use: np.ndarray) -> ToxicityModel:
        """The two labels weigh the same in all."""
        use = use if (y[use] == 1).any() and (y[use] == 0).any() else np.ones(len(y), bool)
        weight = np.where(y == 1, 0.5 / (use & (y == 1)).sum(), 0.5 / (use & (y == 0)).sum())
        w, bias = fit_svm(z[use], np.where(y[use] == 1, 1.0, -1.0), weight[use], cost)
        return ToxicityModel(marks, root @ w, bias, np.zeros(4))

    unseen = [machine(fold != k) for k in range(FOLDS)]
    seen = T.StructType([T.StructField("label", T.IntegerType()), *[T.StructField(k, T.DoubleType()) for k in ("best", "many", "total")]])

    def features(batches):
        for batch in batches:
            for part in steps(batch, "__text", STEP):
                units, folds = units_of(*text_buffer(part.column(2))), part.column(3).to_numpy()
                rows, _, values = sentence_rows(marks, units)
                of = np.zeros((part.num_rows, 3))
                for k, model in enumerate(unseen):
                    here = folds == k
                    of[here] = document_features(rows, values @ model.weights + model.bias, model.bias, part.num_rows)[here]
                yield pa.RecordBatch.from_arrays([part.column(1), *[pa.array(of[:, i].copy()) for i in range(3)]], names=seen.names)

    learned = sample.mapInArrow(features, seen).toArrow().sort_by([(k, "ascending") for k in seen.names])
    layer = fit_logistic(np.column_stack([learned[k].to_numpy() for k in seen.names[1:]]), learned["label"].to_numpy().astype(float))
    drop_stash(spark, at)
    final = machine(np.ones(len(y), bool))
    return ToxicityModel(marks, final.weights, final.bias, layer)


def score(df: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``id_col, score, predicted`` of every whole text. Null and empty texts get the score of a text without
    any word near a landmark; repeated rows score alike. No shuffle."""
    src = df.select(F.col(id_col), F.col(text_col).alias("__text"))
    schema = T.StructType([src.schema.fields[0], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        for batch in batches:
            for part in steps(batch, "__text", STEP):
                s = model.score(*text_buffer(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=schema.names)

    return src.mapInArrow(run, schema)

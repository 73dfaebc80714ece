"""Whitening, lattice dedup and hard negatives against numpy and plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellbeam.llm import hard_negatives, lattice_dedup, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n string, component string, rank string, cell string, x string, id string"
BAD = [None, [], [1.0, None], [math.nan, 1.0], [math.inf, 0.0]]


def frame(spark, rows):
    """(id, vector, label) rows with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], b, *["z"] * 6) for i, v, b in rows], SCHEMA)


def given(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    return [r[0] for r in rows], np.array([r[1] for r in rows], float), [r[2] for r in rows]


def noisy(rng, n, d, spread):
    """Near copies of one random direction."""
    return rng.normal(size=d) * math.sqrt(1 / d) * 3 + rng.normal(size=(n, d)) * spread / math.sqrt(d)


# ---- whitening


@pytest.mark.parametrize("n", [1, 2, 3, 7, 40])
def test_components(n):
    rng = np.random.default_rng(n)
    turn = np.linalg.qr(rng.normal(size=(n, n)))[0]
    close = np.where(np.arange(n) < 6, 5 + 1e-9 * (np.arange(n) // 2), rng.uniform(0, 1, n))
    for v in (turn * rng.uniform(0, 9, n) @ turn.T, turn * close @ turn.T, np.eye(n) * 3, np.zeros((n, n)), np.outer(turn[0], turn[0]) * 1e12):
        v = (v + v.T) / 2
        values, vectors = whitening.components_of(v, 8)
        top = np.linalg.eigvalsh(v)[::-1][:8]
        scale = max(np.abs(top).max(), 1e-300)
        assert np.allclose(values, top, rtol=0, atol=1e-13 * scale)
        assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12) and np.allclose(v @ vectors, vectors * values, atol=1e-12 * scale)


def test_sturm_counts():
    rng = np.random.default_rng(3)
    diag, side = rng.normal(size=30), rng.normal(size=29)
    side[7] = 0.0
    values = np.linalg.eigvalsh(np.diag(diag) + np.diag(side, 1) + np.diag(side, -1))
    at = np.linspace(-4, 4, 99)
    assert whitening.sturm_counts(diag, side, at).tolist() == [(values < x).sum() for x in at]


def brute_whitening(x):
    """Exact sums and numpy's eigenvectors of the longs ``x``."""
    n = len(x)
    c = x - x.sum(0) / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1][:8], vectors[:, ::-1][:, :8]
    total = [int(s) for s in x.sum(0)]
    return [sum((n * int(a) - s) ** 2 for a, s in zip(row, total, strict=True)) for row in x], c @ vectors / np.sqrt(values), values / np.trace(c.T @ c / n)


def test_whitening(spark, sf_dir):
    ids, m, _ = given(spark, sf_dir)
    x = np.floor(1024 * m).astype(np.int64) + 100_000
    deviation, white, explained = brute_whitening(x)
    rows = whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").repartition(7)).collect()
    assert len(rows) == 8 * len(ids)
    place, sign = {i: k for k, i in enumerate(ids)}, {}
    for r in rows:
        k, c = place[r["vec_id"]], r["component"] - 1
        s = sign.setdefault(c, np.sign(r["whitened"] * white[k, c]))
        assert r["n"] == len(ids) and r["deviation"] == deviation[k] and r["whitened"] == pytest.approx(s * white[k, c], rel=1e-7, abs=1e-7)
        assert r["explained"] == pytest.approx(explained[c], rel=1e-10) and 0 <= r["identity_error"] < 1e-10


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(5)
    good = [(i, rng.normal(size=3) * [3, 2, 1], 0) for i in range(20)]
    rows = [*good, good[0], good[0], (None, [1, 2, 3], None), *[(100 + k, b, 1) for k, b in enumerate(BAD)], (200, [1, 2], 1), (201, [3e38, 0, 0], 1)]
    out = whitening.whiten(frame(spark, rows)).collect()
    assert len(out) == 3 * 23 and {r["n"] for r in out} == {23} and {r["component"] for r in out} == {1, 2, 3}
    assert sum(r["vec_id"] == 0 for r in out) == 9 and sum(r["vec_id"] is None for r in out) == 3
    # nothing varies; one row; a deviation beyond a long
    flat = whitening.whiten(frame(spark, [(1, [2, 2], 0), (2, [2, 2], 0)])).collect()
    assert len(flat) == 4 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in flat)
    line = whitening.whiten(frame(spark, [(1, [1, 1], 0), (2, [2, 2], 0), (3, [4, 4], 0)])).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) and r["identity_error"] < 1e-12 for r in line)
    big = whitening.whiten(frame(spark, [(1, [1e15, 0], 0), (2, [0, 0], 0)])).collect()
    x = math.floor(1024 * float(np.float32(1e15)))
    assert {r["deviation"] for r in big} == {None} and {int(r["deviation_text"]) for r in big} == {x * x}
    for rows in ([], [(1, None, 0)], [(1, [], 0)]):
        assert whitening.whiten(frame(spark, rows)).count() == 0
    with pytest.raises(ValueError):
        whitening.whiten(frame(spark, [(1, [1.0] * (whitening.MAX_DIMS + 1), 0)]))


# ---- lattice dedup


def brute_links(rows, limit=0.95):
    """n_links and component of (id, vector) rows; equal rows are one vector."""
    ok = sorted({(i, tuple(v)) for i, v in rows if i is not None and v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v) and any(v)})
    links, reach = {}, {i: {i} for i, _ in rows if i is not None}
    for i, a in ok:
        for j, b in ok:
            if (i, a) != (j, b) and len(a) == len(b) and np.dot(a, b) / math.sqrt(np.dot(a, a) * np.dot(b, b)) >= limit:
                links[i, a] = links.get((i, a), 0) + 1
                if reach[i] is not reach[j]:
                    joined = reach[i] | reach[j]
                    for k in joined:
                        reach[k] = joined
    return links, reach


def test_nearest_e8():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 8)) * 2
    point = lattice_dedup.nearest_e8(x)
    assert len(np.unique(lattice_dedup.ROOTS, axis=0)) == 240 and np.allclose((lattice_dedup.ROOTS**2).sum(1), 2)
    twice = np.rint(2 * point)
    assert np.allclose(2 * point, twice) and ((twice % 2).sum(1) % 8 == 0).all() and (point.sum(1) % 2 == 0).all()
    # no neighbour lies nearer, and none lies farther than the covering radius
    far = ((x - point) ** 2).sum(1)
    assert (far <= 1 + 1e-9).all() and (far[:, None] <= (((x - point)[:, None] - lattice_dedup.ROOTS) ** 2).sum(2) + 1e-9).all()


@pytest.mark.parametrize("block", [1536, 16])
def test_lattice_dedup(spark, monkeypatch, block):
    """Groups of exact and near copies, a chain, vectors of two lengths; crowded cells in many blocks or in one."""
    monkeypatch.setattr(lattice_dedup, "BLOCK", block)
    monkeypatch.setattr(lattice_dedup, "LARGE", 24)
    rng = np.random.default_rng(7)
    parts = [rng.normal(size=(150, 24)), noisy(rng, 120, 24, 0.65), noisy(rng, 60, 24, 0.5), np.repeat(rng.normal(size=(1, 24)), 40, 0)]
    angle = np.arange(30) * 0.29
    parts.append(np.stack([np.cos(angle), np.sin(angle), *[0 * angle] * 22], 1))
    x = np.concatenate(parts).astype(np.float32)
    rows = [(int(i), x[k].tolist()) for k, i in enumerate(rng.permutation(len(x)))] + [(1000 + k, v.tolist()) for k, v in enumerate(noisy(rng, 25, 9, 0.5).astype(np.float32))]
    links, reach = brute_links(rows)
    got = lattice_dedup.similar_vectors(frame(spark, [(i, v, 0) for i, v in rows])).collect()
    want = sum(links.values())
    found = sum(r["n_links"] for r in got)
    assert len(got) == len(rows) and want > 8000 and 0.99 * want <= found <= want
    by_id = dict(rows)
    assert all(r["n_links"] <= links.get((r["vec_id"], tuple(by_id[r["vec_id"]])), 0) for r in got)
    assert all(r["component_id"] == min(reach[r["vec_id"]]) and r["kept"] == (r["component_id"] == r["vec_id"]) for r in got)


def test_recall_at_the_limit():
    """Pairs at the limit itself are the hardest to find."""
    rng = np.random.default_rng(2)
    for d in (8, 64, 300):
        a = lattice_dedup.unit_rows(rng.normal(size=(2000, d)))
        g = rng.normal(size=a.shape)
        g = lattice_dedup.unit_rows(g - (g * a).sum(1)[:, None] * a)
        b = 0.95 * a + math.sqrt(1 - 0.95**2) * g
        names = [lattice_dedup.cells(x) for x in (a, b)]
        found = np.any([lattice_dedup.met(names[0][:, t], names[1][:, t]) for t in range(lattice_dedup.TABLES)], axis=0)
        assert found.mean() > 0.99


def test_lattice_dedup_of_odd_rows(spark):
    one, near, other = [1.0, 0.0, 0.0], [1.0, 0.1, 0.0], [0.0, 0.0, 1.0]
    rows = [(5, one), (5, one), (7, near), (3, [2.0, 0.0, 0.0]), (9, other), (9, near), (1, [0.0, 0.0, 2.0]), (None, one), (20, [1.0, 0.0]), (21, [-0.0, 0.0, 0.0]), (22, [1e38, 1e37, 0.0]), (23, [1e-38, 0.0, -0.0])]
    rows += [(30 + k, b) for k, b in enumerate(BAD)]
    got = {}
    for r in lattice_dedup.similar_vectors(frame(spark, [(i, v, 0) for i, v in rows])).collect():
        got.setdefault(r["vec_id"], set()).add((r["n_links"], r["component_id"], r["kept"]))
    x_side = 6  # 5, 7, 3, 9's second vector, 22 and 23 link with each other
    assert got[5] == got[7] == got[3] == got[22] == got[23] == {(x_side - 1, 1, False)} and got[1] == {(1, 1, True)} and got[9] == {(1, 1, False), (x_side - 1, 1, False)}
    assert got[None] == {(0, None, True)} and all(got[i] == {(0, i, True)} for i in (20, 21, *range(30, 35)))
    assert sum(1 for _ in lattice_dedup.similar_vectors(frame(spark, [(5, one, 0), (5, one, 0)])).collect()) == 2
    assert lattice_dedup.similar_vectors(frame(spark, [])).count() == 0


@pytest.mark.parametrize("broadcast", [1 << 19, 10])
def test_only_vectors_with_candidates_travel(spark, monkeypatch, broadcast):
    """Vectors without a candidate are never written. A tight group beyond a block is counted by its core."""
    rng = np.random.default_rng(11)
    tight = noisy(rng, 90, 24, 0.15)
    x = np.concatenate([rng.normal(size=(400, 24)), tight, tight[:1], tight[:1]]).astype(np.float32)
    rows = [(int(i), x[k].tolist()) for k, i in enumerate(rng.permutation(len(x)))]
    kept, plain = [], lattice_dedup.stash

    def stash(df, path):
        out = plain(df, path)
        kept.append(out.count() if "x" in df.columns else 0)
        return out

    monkeypatch.setattr(lattice_dedup, "stash", stash)
    monkeypatch.setattr(lattice_dedup, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(lattice_dedup, "BLOCK", 16)
    got = {r["vec_id"]: r for r in lattice_dedup.similar_vectors(frame(spark, [(i, v, 0) for i, v in rows])).collect()}
    links, reach = brute_links(rows)
    assert len(got) == len(rows) and 92 * 91 <= sum(links.values())
    assert all(got[i]["n_links"] == links.get((i, tuple(v)), 0) and got[i]["component_id"] == min(reach[i]) for i, v in rows)
    assert 90 <= max(kept) < 140 and sum(kept) < 300


def test_candidates_of_crowded_cells(monkeypatch):
    """Forests of near sketches in cells above and below ``LARGE``, with repeated rows, against all pairs."""
    rng = np.random.default_rng(12)
    most = lattice_dedup.most_signs(0.95)
    assert 15 < most < 30
    unit = lattice_dedup.unit_rows(np.concatenate([rng.normal(size=(300, 16)), noisy(rng, 200, 16, 0.4), noisy(rng, 200, 16, 1.2)]))
    sketch = lattice_dedup.sketches(unit)
    low, high, cell, c = np.ascontiguousarray(sketch[:, :2]).view(np.uint64)[:, 0], sketch[:, 2], rng.integers(0, 3, len(unit)), np.arange(len(unit))
    for large in (4, 1 << 20):
        monkeypatch.setattr(lattice_dedup, "LARGE", large)
        twice = np.repeat(np.lexsort((c, cell)), 2)
        a, b = lattice_dedup.candidates(cell[twice], c[twice], low[twice], high[twice], most)
        near = (np.bitwise_count(low[:, None] ^ low) + np.bitwise_count(high[:, None] ^ high) <= most) & (cell[:, None] == cell)
        assert (lattice_dedup.forest(len(c), a, b) == lattice_dedup.forest(len(c), *np.nonzero(near))).all() and len(a) < len(c)
    seen = lattice_dedup.Seen(4)
    assert seen.fresh(np.array([5, 5, 6, 5])).tolist() == [0, 2] and 6 not in np.array([5, 6, 7])[seen.fresh(np.array([5, 6, 7]))] and len(seen.fresh(np.zeros(1, np.int64))) == 1


# ---- hard negatives


def brute_negatives(rows, positives=5, negatives=5, every=100):
    """(anchor, positive, rank, negative, scores) of (id, vector, label) rows by plain loops."""
    ok = [(i, [math.floor(256 * c) for c in v], b) for i, v, b in rows if i is not None and b is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for a, x, label in (r for r in ok if r[0] % every == 0):
        scored = sorted((-sum(p * q for p, q in zip(x, y, strict=True)), i, b == label) for i, y, b in ok if i != a and len(y) == len(x))
        for s, i, _ in [t for t in scored if t[2]][:positives]:
            fits = [t for t in scored if not t[2] and 80 * -s <= 100 * -t[0] <= 100 * -s][:negatives]
            out += [(a, i, k + 1, t[1], -s, -t[0]) for k, t in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("pass_bytes", [hard_negatives.PASS_BYTES, 2000])
def test_hard_negatives(spark, sf_dir, pass_bytes):
    ids, m, labels = given(spark, sf_dir)
    rows = [(i, v.tolist(), b) for i, v, b in zip(ids, m, labels, strict=True)]
    got = hard_negatives.mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet").repartition(5), pass_bytes=pass_bytes).collect()
    assert sorted(map(tuple, got)) == brute_negatives(rows) and len(got) > 50


def test_hard_negatives_with_ties_and_odd_rows(spark):
    rng = np.random.default_rng(4)
    # few distinct vectors, so that most scores tie; a hot label; two lengths; negative ids
    pool = rng.integers(-2, 3, size=(12, 5)) / 4
    rows = [(i - 50, pool[rng.integers(12)].tolist(), int(rng.integers(3)) if i % 3 else 0) for i in range(260)]
    rows += [(400 + i, rng.normal(size=70).tolist(), i % 2) for i in range(60)] + [(1000, [], 1), (1001, [], 1), (1002, [], 2)]
    rows = [(i, [float(np.float32(c)) for c in v], b) for i, v, b in rows]
    odd = [(None, rows[0][1], 1), (300, None, 1), (200 + 100, [0.5] * 5, None), *[(2000 + k, b, 1) for k, b in enumerate(BAD) if b != []], (3000, [3e38] * 5, 1)]
    for codes in (1, 4):
        got = hard_negatives.mine(frame(spark, rows + odd), codes=codes).collect()
        assert sorted(map(tuple, got)) == brute_negatives(rows) and len(got) > 50
    twice = hard_negatives.mine(frame(spark, [(0, [1, 0], 1), (0, [1, 0], 1), (1, [1, 0], 1), (2, [1, 0], 2), (2, [1, 0], 2)])).collect()
    assert sorted(map(tuple, twice)) == [(0, 1, k, 2, 65536, 65536) for k in (1, 1, 2, 2)]
    assert hard_negatives.mine(frame(spark, [])).count() == 0
    assert hard_negatives.mine(frame(spark, [(1, [1, 0], 1)])).count() == 0
    assert hard_negatives.mine(frame(spark, [(1, [1, 0], 1), (3, [1, 0], 1), (4, [1, 0], 2)]), anchors=F.col("id") == 3).count() == 1


def test_intervals_hold_and_filter():
    """No interval misses the score, and codes leave a small part of random pairs to score."""
    rng = np.random.default_rng(6)
    for d in (3, 64, 130):
        x = np.floor(256 * lattice_dedup.unit_rows(rng.normal(size=(600, d)))).astype(np.int64)
        x[:5] = 0
        a = x[::10]
        scores = (a @ x.T).astype(float)
        words, along, lengths = hard_negatives.encode(x)
        anchors = hard_negatives.Anchors(a)
        for limit in (np.quantile(scores, 0.999), 0.0, scores.min()):
            floor = np.full(len(a), limit)
            for low, high in ((floor, floor + 1e18), (floor - 1e18, floor), (floor, floor)):
                who, row = hard_negatives.candidates(anchors, words, along, lengths, low, high, np.ones(scores.shape, bool))
                need = (scores >= low[:, None]) & (scores <= high[:, None])
                found = np.zeros(scores.shape, bool)
                found[who, row] = True
                assert not (need & ~found).any()
        if d == 64:
            who, _ = hard_negatives.candidates(anchors, words, along, lengths, np.full(len(a), 0.4 * 65536), np.full(len(a), 1e18), np.ones(scores.shape, bool))
            assert len(who) < 0.1 * scores.size

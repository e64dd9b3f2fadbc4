"""Whitening by rank-one updates against numpy's eigendecomposition of the whole covariance."""

import math

import numpy as np
import pytest

from pagemill.llm import whitening
from pagemill.llm.queries import QUERIES


@pytest.mark.parametrize("seed", range(6))
def test_rank_one(seed):
    given = np.random.default_rng(seed)
    d = 12
    lam = np.sort(given.exponential(size=d) * 10.0 ** given.integers(-6, 6))
    if seed % 2:
        lam[3:6] = lam[3]
    vecs = np.linalg.qr(given.normal(size=(d, d)))[0]
    v = given.normal(size=d)
    if seed % 3 == 0:
        v = vecs[:, [2, 4, 7]] @ given.normal(size=3)  # most directions deflate
    want = vecs * lam @ vecs.T + np.outer(v, v)
    new, axes = whitening.rank_one(lam, vecs, v)
    scale = abs(want).max()
    assert np.abs(axes * new @ axes.T - want).max() < 1e-12 * scale
    assert np.abs(axes.T @ axes - np.eye(d)).max() < 1e-12
    assert np.abs(new - np.linalg.eigvalsh(want)).max() < 1e-12 * scale


def test_spectra_combine():
    given = np.random.default_rng(1)
    x = given.integers(-300, 300, (1000, 9)) @ given.integers(-2, 3, (9, 9))
    parts = []
    for part in np.split(x, [3, 200, 205, 700]):
        parts.append(whitening.Spectrum.empty(9))
        parts[-1].add_vectors(part.astype(float))
    whole = whitening.Spectrum.empty(9)
    for part in parts:
        whole.absorb(part)
    want = np.linalg.eigvalsh((x - x.mean(0)).T @ (x - x.mean(0)))
    assert whole.n == 1000 and np.abs(whole.mean - x.mean(0)).max() < 1e-9
    assert np.abs(whole.lam - want).max() < 1e-9 * want.max()


def plain(rows):
    """Rows (vec_id, vector) as {(vec_id, component): ...} by the whole covariance at once."""
    kept = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = [list(v) for v in {tuple(v) for _, v in kept}]
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array(fit, float) - np.array(sums) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    out = []
    for i, v in kept:
        deviation = sum((n * x - s) ** 2 for x, s in zip(v, sums))
        for c in range(min(4, int((values > 1e-9 * values.sum()).sum()))):
            y = (np.array(v) - np.array(sums) / n) @ axes[:, c] / math.sqrt(values[c])
            out.append((i, c + 1, n, deviation, abs(y), values[c] / values.sum()))
    return sorted(out, key=lambda r: (r[0] is None, r))


def compared(df, rows):
    got = sorted(((r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in df.collect()), key=lambda r: (r[0] is None, r))
    want = plain(rows)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.abs(np.array([g[4:] for g in got]) - np.array([w[4:] for w in want])).max() < 1e-8


def test_op11_against_brute_force(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    df = QUERIES["op11_whitening"](spark, sf)
    compared(df, rows)
    assert df.selectExpr("max(identity_error) - min(identity_error) AS d", "max(identity_error) AS m").first()[:] <= (0.0, 1e-9)


def test_signs_are_the_same_for_all_rows(spark, sf):
    found = QUERIES["op11_whitening"](spark, sf).filter("component = 1").collect()
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    x = np.floor(256 * np.array([vectors[r.vec_id] for r in found], float))
    y = np.array([r.whitened for r in found])
    axis, *_ = np.linalg.lstsq(x - x.mean(0), y - y.mean(), rcond=None)
    assert np.abs((x - x.mean(0)) @ axis - (y - y.mean())).max() < 1e-8


def test_op11_edges(spark):
    kind = "vec_id long, embedding array<float>, label int, x string, n int"
    given = np.random.default_rng(5)
    rows = [(i, [float(np.float32(c)) for c in given.normal(size=5)]) for i in range(40)]
    rows += [rows[3], rows[3], (None, rows[4][1]), (100, None), (101, [1.0, None, 0.0, 0.0, 0.0]), (102, [float("nan")] * 5), (103, [float("inf"), 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, "clash", 2) for r in rows], kind).repartition(5)
    compared(whitening.whitened(df), rows)
    short = spark.createDataFrame([(1, [1.0, 2.0], 0, "", 0), (2, [3.0], 0, "", 0), (3, [], 0, "", 0)], kind)
    compared(whitening.whitened(short), [(1, [1.0, 2.0]), (2, [3.0, 0.0]), (3, [0.0, 0.0])])
    for nothing in (df.limit(0), df.filter("vec_id = 3"), df.filter("vec_id >= 100")):
        assert whitening.whitened(nothing).count() == 0


def test_large_values_stay_exact(spark):
    rows = [(1, [float(2**40), 1.0]), (2, [0.0, 3.0]), (3, [float(-(2**39)), 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.vec_id, r.component): r.deviation for r in whitening.whitened(df).collect()}
    want = {(r[0], r[1]): r[3] if r[3] < 2**63 else None for r in plain(rows)}
    assert {k: v for k, v in want.items() if k in got} == got

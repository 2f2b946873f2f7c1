import math

import numpy as np
import pytest

from solvarium.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x string, n long"


def frame(spark, vectors):
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], "clash", 1) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA)


def brute(vectors, k):
    x = [[math.floor(256 * float(np.float32(c))) for c in v] for v in vectors]
    fit = np.array(sorted(set(map(tuple, x))), dtype=float)
    c = fit - fit.mean(0)
    values, vectors = np.linalg.eigh(c.T @ c / len(fit))
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    sums = [sum(int(r[j]) for r in set(map(tuple, x))) for j in range(fit.shape[1])]
    n = len(fit)
    return n, values / np.trace(c.T @ c / n), (np.array(x) - fit.mean(0)) @ vectors / np.sqrt(values), [sum((n * v - s) ** 2 for v, s in zip(r, sums)) for r in x]


def same_up_to_sign(a, b, within=1e-8):
    return min(np.abs(a - b).max(), np.abs(a + b).max()) <= within * max(1.0, np.abs(b).max())


@pytest.mark.parametrize("d,block", [(3, 32), (24, 8), (40, 40)])
def test_equals_an_eigendecomposition(spark, d, block):
    r = np.random.default_rng(d)
    vectors = (r.standard_normal((300, d)) * np.linspace(0.2, 0.6, d)).astype(np.float32).tolist()
    vectors += vectors[:50] * 3  # repeated vectors count once in the fit list
    df = frame(spark, vectors)
    model = whitening.fit(df, block=block)
    assert model.residuals.max() <= whitening.TOLERANCE
    got = sorted(whitening.transform(df, model).collect(), key=lambda r: (r.vec_id, r.component))
    k = min(4, d)
    n, explained, white, deviation = brute(vectors, k)
    assert len(got) == len(vectors) * k and {r.n for r in got} == {n}
    assert [r.deviation for r in got[::k]] == deviation
    for j in range(k):
        assert abs(got[j].explained / explained[j] - 1) < 1e-9
        assert same_up_to_sign(np.array([r.whitened for r in got[j::k]]), white[:, j])
    assert all(r.identity_error < 1e-9 for r in got)


def test_narrow_blocks_grow_on_flat_spectra_and_steep_ones_stay_narrow(spark):
    r = np.random.default_rng(5)
    flat = whitening.fit(frame(spark, (r.standard_normal((400, 48)) / 8).tolist()), block=8)
    assert flat.passes <= 20 and flat.residuals.max() <= whitening.TOLERANCE
    steep = whitening.fit(frame(spark, (r.standard_normal((400, 48)) * 4.0 ** -np.arange(48)).tolist()), block=8)
    assert steep.passes <= 12


def test_rows_that_take_no_part(spark):
    good = [[0.5, 0.25], [-0.5, 0.125], [0.1, -0.7], [0.9, 0.9]]
    bad = [None, [], [None, 1.0], [float("nan"), 0.0], [float("inf"), 1.0], [1.0], [1.0, 2.0, 3.0]]
    df = frame(spark, good + bad)
    got = whitening.transform(df, whitening.fit(df)).collect()
    assert sorted((r.vec_id, r.component) for r in got) == [(i, c) for i in range(4) for c in (1, 2)]
    odd = spark.createDataFrame([(None, [0.5, 0.25])], "vec_id long, embedding array<float>").unionByName(df.select("vec_id", "embedding"))
    assert sum(r.vec_id is None for r in whitening.transform(odd, whitening.fit(odd)).collect()) == 2


def test_without_variance_or_rows(spark):
    one = frame(spark, [[0.5, 0.25]] * 3)
    got = whitening.transform(one, whitening.fit(one)).collect()
    assert len(got) == 6 and all(r.whitened is None and r.explained is None and r.identity_error == 0 and r.deviation == 0 for r in got)
    line = frame(spark, [[i / 8, i / 4, 0.5] for i in range(9)])
    by = {}
    for r in whitening.transform(line, whitening.fit(line)).collect():
        by.setdefault(r.component, []).append(r)
    assert abs(by[1][0].explained - 1) < 1e-12 and all(r.whitened is None and r.explained == 0 for c in (2, 3) for r in by[c])
    none = frame(spark, [None])
    assert whitening.transform(none, whitening.fit(none)).count() == 0


def test_deviations_stay_exact_where_64_bits_do_not_do(spark):
    vectors = [[float(2**20 * i + j) for j in range(3)] for i in range(40)]
    df = frame(spark, vectors)
    got = {r.vec_id: r.deviation for r in whitening.transform(df, whitening.fit(df)).where("component = 1").collect()}
    x = [[256 * int(c) for c in v] for v in vectors]
    s = [sum(c) for c in zip(*x)]
    want = {i: sum((40 * c - t) ** 2 for c, t in zip(v, s)) for i, v in enumerate(x)}
    assert got == {i: v if v < 2**63 else None for i, v in want.items()}
    huge = frame(spark, [[3e38, 1.0], [1.0, 2.0]])
    assert whitening.transform(huge, whitening.fit(huge)).count() == 4


def test_query(spark, tmp_path):
    frame(spark, [[0.1 * i, -0.3 * i * i % 1, 0.2] for i in range(30)]).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = whitening.query(spark, str(tmp_path))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert got.count() == 90

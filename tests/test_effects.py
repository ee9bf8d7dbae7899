"""Effects, identification and biases against explicit dummies in numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
import pytest

from plumbline.functions.dist import chi2_upper, f_upper, t_quantile, t_two_sided
from plumbline.functions.linalg import cgsolve, dependent_columns, mctrace
from plumbline.operators import effects as E
from plumbline.operators.estimate import felm


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(3)
    n = 500
    d = pd.DataFrame({"x": rng.normal(size=n), "x2": rng.normal(size=n), "id": rng.integers(0, 20, n), "firm": rng.integers(0, 8, n), "shoe": rng.integers(0, 5, n), "clu": rng.integers(0, 10, n)})
    d["y"] = 5 + d.x + 0.2 * d.id + 0.5 * d.firm + rng.normal(size=n)
    return d


@pytest.fixture(scope="module")
def df(spark, pdf):
    return spark.createDataFrame(pdf)


def full(pdf, keys, xs):
    d = [pd.get_dummies(pdf[k]) for k in keys]
    m = np.concatenate([pdf[xs].to_numpy(float), *[x.to_numpy(float) for x in d]], 1)
    b = np.linalg.lstsq(m, pdf.y, rcond=1e-10)[0]
    return m, b, d


def test_ref_effects_and_regress_back(df, pdf):
    f = felm("y ~ x + x2 | id + firm", df)
    out = E.getfe(f).toPandas()
    _, b, d = full(pdf, ["id", "firm"], ["x", "x2"])
    a, p = b[2:22], b[22:]
    big = out.loc[out.obs.idxmax()]
    at = int(big.idx)
    shift = p[at] if big.fe == "firm" else a[at]
    ids, firms = out[out.fe == "id"].effect.to_numpy(), out[out.fe == "firm"].effect.to_numpy()
    names = out[out.fe == "id"].idx.astype(int).to_numpy()
    sign = 1 if big.fe == "firm" else -1
    assert ids == pytest.approx(a[names] + sign * shift) and firms == pytest.approx(p - sign * shift)
    t = E.merge_effects(E.merge_effects(df, E.getfe(f), "id", "id", "a"), E.getfe(f), "firm", "firm", "p")
    assert list(felm("y ~ x + x2 + a + p - 1", t).coef().values())[2:] == pytest.approx([1, 1])


@pytest.mark.parametrize("kind", ["zm", "zm2", "ln", "ref"])
def test_builtin_functions_are_estimable(df, pdf, kind):
    f = felm("y ~ x | id + firm", df)
    ef = E.Estimable(f.absorbed, kind)
    assert E.is_estimable(f, ef) == (kind != "ln")
    out = E.getfe(f, kind).toPandas()
    if kind == "zm2":
        assert out[out.fe == "id"].effect.mean() == pytest.approx(0, abs=1e-9) and out[out.fe == "firm"].effect.mean() == pytest.approx(0, abs=1e-9)
    if kind == "ln":
        m, b, _ = full(pdf, ["id", "firm"], ["x"])
        r = pdf.y - b[0] * pdf.x
        d = m[:, 1:]
        want = np.linalg.pinv(d) @ (d @ b[1:])
        assert np.sort(out.effect) == pytest.approx(np.sort(want)) and len(r)
    three = felm("y ~ x | id + firm + shoe", df)
    assert not E.Estimable(three.absorbed, "ref").verified and E.is_estimable(three, E.Estimable(three.absorbed, "ref"))


def test_single_factor_errors_and_bootstrap(df, pdf):
    f = felm("y ~ x | firm | 0 | clu", df)
    m, b, _ = full(pdf, ["firm"], ["x"])
    u = pdf.y - m @ b
    v = (u @ u / f.df) * np.linalg.inv(m.T @ m)
    assert E.fixedse(f) == pytest.approx(np.sqrt(np.diag(v))[1:])
    assert E.getfe(f, se=True).toPandas().effect.to_numpy() == pytest.approx(b[1:])
    for robust in (False, True):
        se = E.btrap(f, lambda v: v, 200, robust)
        assert np.mean(se / E.fixedse(f)) == pytest.approx(1, abs=0.12)
    assert (E.btrap(f, lambda v: v, 25, cluster=True) > 0).all()
    draws = E.bootstrap("y ~ x | firm", df, lambda g: g.coef()["x"], 12)
    assert abs(draws.mean() - b[0]) < 0.15 and draws.std() > 0


def test_biases_exact(df, pdf):
    f = felm("y ~ x | id + firm", df)
    m, b, d = full(pdf, ["id", "firm"], ["x"])
    n = len(pdf)
    s2 = ((pdf.y - m @ b) ** 2).sum() / f.df
    v = s2 * np.linalg.pinv(m.T @ m)
    c = np.eye(n) - 1 / n
    d1, d2 = (x.to_numpy(float) for x in d)
    k = d1.shape[1]
    v11, v22, v12 = v[1 : 1 + k, 1 : 1 + k], v[1 + k :, 1 + k :], v[1 : 1 + k, 1 + k :]
    got = E.bccorr(f)
    assert got["d1"] == pytest.approx(np.trace(d1.T @ c @ d1 @ v11) / n) and got["d2"] == pytest.approx(np.trace(d2.T @ c @ d2 @ v22) / n)
    assert got["d12"] == pytest.approx(np.trace(d1.T @ c @ d2 @ v12.T) / n)
    a, p = d1 @ b[1 : 1 + k], d2 @ b[1 + k :]
    assert got["v1"] == pytest.approx(a.var(ddof=1) - got["d1"]) and got["cov"] == pytest.approx(np.cov(a, p)[0, 1] - got["d12"])
    q = d1.T @ c @ d1
    e = b[1 : 1 + k]
    assert E.varvars(f)[0] == pytest.approx(4 * e @ q @ v11 @ q @ e / n**2)
    assert E.varvars(f, True)[0] == pytest.approx((4 * e @ q @ v11 @ q @ e - 2 * np.trace(v11 @ q @ v11 @ q)) / n**2)


def test_components_and_traces(spark):
    rows = [("a", 1), ("b", 1), ("b", 2), ("c", 3), ("c", 3), ("d", 4)]
    df = spark.createDataFrame(rows, "f string, g long").withColumn("y", F.rand(1))
    got = {(r["f"], r["g"]): r["comp"] for r in E.compfactor(df, ["f", "g"]).collect()}
    assert got == {("a", 1): 1, ("b", 1): 1, ("b", 2): 1, ("c", 3): 2, ("d", 4): 3}
    assert felm("y ~ 0 | f + g", df).refs == 3 and E.projection_trace(df, ["f", "g"]) == 6 - (4 + 4 - 3)
    ww = {(r["f"], r["g"]): r["comp"] for r in E.compfactor(df, ["f", "g"], ww=True).collect()}
    assert ww[("a", 1)] == ww[("b", 2)] != ww[("c", 3)]
    assert E.compfactor(df, ["f"]).select("comp").distinct().collect()[0][0] == 1
    long = E.make_dmatrix(df.withColumn("r", F.monotonically_increasing_id()), ["f", "g"], "r")
    assert long.count() == 12
    x = E.kaczmarz(df.withColumn("z", F.when(F.col("f") == "a", 3.0).otherwise(1.0)), ["f", "g"], "z")
    assert x.set_index(["fe", "idx"]).effect["f", "d"] == pytest.approx(0.5)


def test_distributions():
    assert t_two_sided(2.0, 10) == pytest.approx(0.0733880) and t_quantile(0.975, 10) == pytest.approx(2.2281389)
    assert f_upper(3.0, 4, 20) == pytest.approx(0.625**10 * 4.75) and chi2_upper(7.0, 3) == pytest.approx(0.0718978, abs=1e-6)


def test_algebra():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(40, 40))
    a = a @ a.T + np.eye(40)
    b = rng.normal(size=(40, 3))
    assert a @ cgsolve(a, b) == pytest.approx(b) and mctrace(a) == pytest.approx(np.trace(a))
    assert mctrace(lambda v: a @ v, 40, 0.01) == pytest.approx(np.trace(a), rel=0.05)
    with pytest.warns(UserWarning, match="symmetric"):
        cgsolve(np.triu(a), b[:, 0], rounds=3, symmetric=True)
    g = np.array([[1, 1, 0], [1, 1, 0], [0, 0, 1.0]])
    assert dependent_columns(g) == [1]

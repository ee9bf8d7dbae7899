"""Estimates against explicit dummy regressions in numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from plumbline.operators.absorb import Absorbed, demean
from plumbline.operators.estimate import felm
from plumbline.plans.formula import parse, updated


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(7)
    n = 600
    d = pd.DataFrame({k: rng.normal(size=n) for k in ("x", "x2", "z", "z2", "u")})
    d["id"], d["firm"], d["clu"], d["clu2"] = rng.integers(0, 25, n), rng.integers(0, 9, n), rng.integers(0, 12, n), rng.integers(0, 8, n)
    d["g"] = np.array(list("abcd"))[rng.integers(0, 4, n)]
    d["q"] = 0.7 * d.z + 0.4 * d.z2 + 0.3 * d.x + 0.5 * d.u + rng.normal(size=n)
    d["q2"] = 0.5 * d.z - 0.6 * d.z2 + rng.normal(size=n) + 0.2 * d.u
    d["w"] = rng.uniform(0.2, 3, n)
    d["y"] = 2000 + d.x - 0.5 * d.x2 + 0.8 * d.q + 0.05 * d.id + 0.3 * d.firm + d.u
    d["y2"] = d.y * 0.1 + rng.normal(size=n)
    return d


@pytest.fixture(scope="module")
def df(spark, pdf):
    return spark.createDataFrame(pdf)


def dummies(*keys):
    return np.concatenate([pd.get_dummies(k).to_numpy(float) for k in keys], 1)


def ols(y, x, d, w=None):
    """Coefficients of x, residuals, residualised x, rank of d."""
    s = np.ones(len(y)) if w is None else np.sqrt(np.asarray(w))
    y, x, d = np.asarray(y, float) * s, np.asarray(x, float) * s[:, None], d * s[:, None]
    off = lambda v: v - d @ np.linalg.lstsq(d, v, rcond=1e-10)[0]
    yc, xc = off(y), off(x)
    b = np.linalg.lstsq(xc, yc, rcond=None)[0]
    return b, yc - xc @ b, xc, np.linalg.matrix_rank(d, tol=1e-8)


def test_two_factors_all_covariances(df, pdf):
    f = felm("y ~ x + x2 | id + firm | 0 | clu + clu2", df)
    b, u, xc, rank = ols(pdf.y, pdf[["x", "x2"]], dummies(pdf.id, pdf.firm))
    inv = np.linalg.inv(xc.T @ xc)
    n, dof = len(pdf), len(pdf) - 2 - rank
    assert list(f.coef().values()) == pytest.approx(b.tolist()) and f.df == dof
    assert f.vcov("iid") == pytest.approx(u @ u / dof * inv)
    e = xc * u[:, None]
    assert f.vcov("robust") == pytest.approx(n / dof * inv @ (e.T @ e) @ inv)
    meat = 0
    for keys, sign in ((["clu"], 1), (["clu2"], 1), (["clu", "clu2"], -1)):
        s = pd.DataFrame(e).groupby([pdf[k] for k in keys]).sum().to_numpy()
        meat = meat + sign * (n - 1) / dof * len(s) / (len(s) - 1) * s.T @ s
    assert f.vcov() == pytest.approx(inv @ meat @ inv)
    s = felm("y ~ x + x2 | id + firm | 0 | clu + clu2", df, cmethod="reghdfe")
    assert s.stats["y"].df == min(pdf.clu.nunique(), pdf.clu2.nunique()) - 1
    t = {r["term"]: r for r in f.table("iid").collect()}
    assert t["x"]["t_value"] == pytest.approx(b[0] / np.sqrt(u @ u / dof * inv[0, 0]))
    sm = f.summary()
    tss = ((pdf.y - pdf.y.mean()) ** 2).sum()
    assert sm["r2"] == pytest.approx(1 - u @ u / tss) and sm["n"] == n
    assert sm["residuals"][2] == pytest.approx(np.median(u), abs=1e-6)


def test_weights_slopes_and_several_responses(df, pdf):
    f = felm("y | y2 ~ x + x2 | firm + z:factor(id)", df, weights="w")
    d = np.concatenate([dummies(pdf.firm), dummies(pdf.id) * pdf.z.to_numpy()[:, None]], 1)
    for name in ("y", "y2"):
        b, u, xc, rank = ols(pdf[name], pdf[["x", "x2"]], d, pdf.w)
        assert list(f.coef(name).values()) == pytest.approx(b.tolist(), rel=1e-6) and f.df == len(pdf) - 2 - rank
        assert f.stats[name].rss == pytest.approx(u @ u)
        e = xc * u[:, None]
        inv = np.linalg.inv(xc.T @ xc)
        assert f.vcov("robust", name) == pytest.approx(len(pdf) / f.df * inv @ (e.T @ e) @ inv)


def test_no_factor_factor_covariate_and_interactions(df, pdf):
    f = felm("y ~ x + g + I(x2^2) + x:x2", df)
    x = np.column_stack([np.ones(len(pdf)), pdf.x, *[(pdf.g == c) * 1.0 for c in "bcd"], pdf.x2**2, pdf.x * pdf.x2])
    b = np.linalg.lstsq(x, pdf.y, rcond=None)[0]
    assert f.names == ["(Intercept)", "x", "gb", "gc", "gd", "I(x2^2)", "x:x2"] and list(f.coef().values()) == pytest.approx(b.tolist())
    u = pdf.y - x @ b
    assert f.summary()["F"] == pytest.approx((((pdf.y - pdf.y.mean()) ** 2).sum() - u @ u) / 6 / (u @ u / (len(pdf) - 7)))


def test_collinear_columns_get_nan(spark, pdf):
    d = pdf.assign(x5=pdf.id * 2.0, x6=pdf.x + pdf.x2)
    f = felm("y ~ x + x2 + x5 + x6 | id + firm", spark.createDataFrame(d))
    c = f.coef()
    assert np.isnan(c["x5"]) and sum(map(np.isnan, c.values())) == 2
    b = ols(pdf.y, pdf[["x", "x2"]], dummies(pdf.id, pdf.firm))[0]
    fitted = np.nan_to_num(c["x"]) * pdf.x + np.nan_to_num(c["x2"]) * pdf.x2 + np.nan_to_num(c["x6"]) * d.x6
    assert np.allclose(fitted - fitted.mean(), (pdf[["x", "x2"]] @ b) - (pdf[["x", "x2"]] @ b).mean())


def iv(pdf, dep="y"):
    d = dummies(pdf.id, pdf.firm)
    off = lambda v: np.asarray(v, float) - d @ np.linalg.lstsq(d, np.asarray(v, float), rcond=1e-10)[0]
    return off(pdf[dep]), off(pdf[["x"]]), off(pdf[["q", "q2"]]), off(pdf[["z", "z2", "u"]] + 0.0), np.linalg.matrix_rank(d)


def test_two_stage_least_squares_and_tests(df, pdf):
    d = pdf.assign(u=pdf.u + np.random.default_rng(0).normal(size=len(pdf)))
    spark = df.sparkSession
    f = felm("y ~ x | id + firm | (q | q2 ~ z + z2 + u) | clu", spark.createDataFrame(d))
    y, x, q, z, rank = iv(d)
    w = np.concatenate([x, z], 1)
    hat = w @ np.linalg.lstsq(w, q, rcond=None)[0]
    x2, xo = np.concatenate([x, hat], 1), np.concatenate([x, q], 1)
    b = np.linalg.lstsq(x2, y, rcond=None)[0]
    u = y - xo @ b
    dof = len(y) - 3 - rank
    inv = np.linalg.inv(x2.T @ x2)
    assert f.names == ["x", "`q(fit)`", "`q2(fit)`"] and list(f.coef().values()) == pytest.approx(b.tolist())
    assert f.vcov("iid") == pytest.approx(u @ u / dof * inv)
    s = pd.DataFrame(x2 * u[:, None]).groupby(d.clu).sum().to_numpy()
    g = len(s)
    assert f.vcov() == pytest.approx((len(y) - 1) / dof * g / (g - 1) * inv @ (s.T @ s) @ inv)
    e = u - w @ np.linalg.lstsq(w, u, rcond=None)[0]
    assert f.sargan()["sargan"] == pytest.approx(len(y) * (1 - e @ e / (u @ u))) and f.sargan()["df"] == 1
    k = felm("y ~ x | id + firm | (q | q2 ~ z + z2 + u)", spark.createDataFrame(d), kclass="2sls")
    assert list(k.coef().values()) == pytest.approx(b.tolist()) and k.names == ["x", "q", "q2"]
    lim = felm("y ~ x | id + firm | (q | q2 ~ z + z2 + u)", spark.createDataFrame(d), kclass="liml")
    assert lim.kappa >= 1 - 1e-9
    off = lambda v, m: v - m @ np.linalg.lstsq(m, v, rcond=None)[0]
    cond = []
    zz, qq, hh = off(z, x), off(q, x), off(hat, x)
    for j in range(2):
        r = qq[:, j] - qq[:, [1 - j]] @ np.linalg.lstsq(hh[:, [1 - j]], qq[:, j], rcond=None)[0]
        bz = np.linalg.lstsq(zz, r, rcond=None)[0]
        res = r - zz @ bz
        cond.append(bz @ (zz.T @ zz) @ bz / (res @ res / (len(y) - 3 - rank)) / 2)
    got = f.condfstat("iid")
    assert got["df1"] == 2 and [got["q"], got["q2"]] == pytest.approx(cond)


def test_wald_confint_update_controls(df, pdf):
    f = felm("y ~ x + x2 | id", df)
    b, u, xc, rank = ols(pdf.y, pdf[["x", "x2"]], dummies(pdf.id))
    v = u @ u / (len(pdf) - 2 - rank) * np.linalg.inv(xc.T @ xc)
    w = f.waldtest("~ x - 1 | 2*x + x2 - 0.5")
    r = np.array([b[0] - 1, 2 * b[0] + b[1] - 0.5])
    m = np.array([[1, 0], [2, 1]])
    assert w["chi2"] == pytest.approx(r @ np.linalg.solve(m @ v @ m.T, r))
    assert f.waldtest(lambda c: np.array([c[0] - 1, 2 * c[0] + c[1] - 0.5]))["chi2"] == pytest.approx(w["chi2"], rel=1e-4)
    assert f.waldtest(["x"])["F"] == pytest.approx((b[0] ** 2) / v[0, 0])
    lo, hi = f.confint()["x"]
    assert (lo + hi) / 2 == pytest.approx(b[0]) and (hi - lo) / 2 == pytest.approx(1.9643 * np.sqrt(v[0, 0]), rel=1e-3)
    assert updated(f.model, ". ~ . - x2 | . + firm").factors == ["id", "firm"]
    two = f.update(". ~ . | . + firm")
    assert two.coef()["x"] == pytest.approx(ols(pdf.y, pdf[["x", "x2"]], dummies(pdf.id, pdf.firm))[0][0])
    c = felm("y ~ x | id | 0 | 0 | x2 + z", df)
    full = ols(pdf.y, pdf[["x", "x2", "z"]], dummies(pdf.id))
    assert c.coef()["x"] == pytest.approx(full[0][0]) and c.df == len(pdf) - 3 - rank
    inv = np.linalg.inv(full[2].T @ full[2])
    e = full[2] * full[1][:, None]
    assert c.vcov("robust")[0, 0] == pytest.approx((len(pdf) / c.df * inv @ (e.T @ e) @ inv)[0, 0])
    assert f.nlexpect(lambda c: c["x"] ** 2, ["x"]) == pytest.approx(b[0] ** 2 + v[0, 0] * f.df / (f.df - 2), rel=1e-3)
    assert f.loglik() == pytest.approx(-len(pdf) / 2 * (np.log(2 * np.pi) + 1 + np.log(u @ u / len(pdf))))


def test_demean_rows_and_nan(spark, df, pdf):
    out = demean(df, ["y", "x"], ["id", "firm"]).toPandas()
    for k in ("id", "firm"):
        assert out.groupby(k)[["y", "x"]].mean().abs().to_numpy().max() < 1e-7
    both = demean(df, ["y"], ["id", "firm"], means=True).toPandas()
    assert len(both) == len(pdf) and both["y"].mean() == pytest.approx(pdf.y.mean())
    d = spark.createDataFrame(pd.DataFrame({"f": [1, 1, 2, 2], "g": [1, 2, 2, 1], "a": [1.0, np.nan, 5.0, 7.0], "b": [1.0, 2, 3, 4]}))
    got = demean(d, ["a", "b"], ["f"]).toPandas().sort_values("b")
    assert got["a"].isna().sum() == 2 and sorted(got["a"].dropna()) == [-1, 1] and not got["b"].isna().any()
    assert demean(d, ["a"], ["f", "g"]).toPandas()["a"].isna().all() and len(demean(d, ["a"], ["f"], na_rm=True).collect()) == 3


def test_distributed_solution_agrees(df, pdf, monkeypatch):
    from plumbline.operators import absorb

    f = felm("y ~ x + x2 | id + firm", df)
    monkeypatch.setattr(absorb, "EDGES", 10)
    g = felm("y ~ x + x2 | id + firm", df)
    assert g.absorbed.distributed and list(g.coef().values()) == pytest.approx(list(f.coef().values())) and g.df == f.df


def test_formula_parts():
    m = parse("log(y) ~ a*b + G(f)")
    assert m.covariates == ["a", "b", "a:b"] and m.factors == ["f"] and m.intercept is None
    assert parse("y ~ x | x:f").intercept is None and parse("y ~ x - 1").intercept is False
    assert parse("y ~ x* | 0", ["x1", "x2", "y"], "g").covariates == ["x1", "x2"]
    with pytest.raises(ValueError):
        parse("y ~ a | b | 0 | c | d | e")


def test_nulls_and_empty(spark, pdf):
    d = pdf.copy()
    d.loc[::7, "x"] = np.nan
    f = felm("y ~ x | id", spark.createDataFrame(d))
    keep = d.dropna()
    assert f.n == len(keep) and f.coef()["x"] == pytest.approx(ols(keep.y, keep[["x"]], dummies(keep.id))[0][0])
    with pytest.raises(ValueError, match="non-NA"):
        felm("y ~ x | id", spark.createDataFrame(d.assign(x=np.nan)))
    assert Absorbed is not None

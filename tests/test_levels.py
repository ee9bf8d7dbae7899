"""Level-space products in both modes, exact ranks, robust biases, and what summaries tell."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
import pytest

from plumbline.operators import absorb
from plumbline.operators import effects as E
from plumbline.operators.estimate import felm, quantiles


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(8)
    n = 600
    d = pd.DataFrame({"x": rng.normal(size=n), "x2": rng.normal(size=n), "id": rng.integers(0, 40, n), "firm": rng.integers(0, 25, n), "clu": rng.integers(0, 12, n)})
    d["shoe"] = d.firm // 5 + 10 * (d.id % 2)  # partly in the span of the others
    d["y"] = 2 + d.x + 0.1 * d.id + 0.3 * d.firm + rng.normal(size=n) * (1 + d.x.abs())
    return d


@pytest.fixture(scope="module")
def df(spark, pdf):
    return spark.createDataFrame(pdf)


def dummies(pdf, keys):
    return np.concatenate([pd.get_dummies(pdf[k]).to_numpy(float) for k in keys], 1)


def test_products_agree_in_both_modes(spark, pdf, monkeypatch):
    small = pdf.head(80).copy()
    small["id"], small["firm"] = small["id"] % 6, small["firm"] % 4
    df = spark.createDataFrame(small)

    def told():
        f = felm("y ~ x | id + firm", df)
        k = E.kaczmarz(df, ["id", "firm"], "y")
        return f, k["effect"].to_numpy(), E.getfe(f, "ref").toPandas()["effect"].to_numpy(), [E.is_estimable(f, E.Estimable(f.absorbed, e)) for e in ("ref", "zm2", "ln")]

    here, kaczmarz, effects, fine = told()
    monkeypatch.setattr(absorb, "EDGES", 1)
    there, kaczmarz2, effects2, fine2 = told()
    assert there.absorbed.distributed and not here.absorbed.distributed
    assert kaczmarz2 == pytest.approx(kaczmarz, abs=1e-6) and effects2 == pytest.approx(effects, abs=1e-6)
    assert fine == fine2 == [True, True, False]
    assert there.absorbed.dense() == pytest.approx(here.absorbed.dense())


def test_exact_rank_without_a_bound_on_levels(df, pdf, monkeypatch):
    keys = ["id", "firm", "shoe"]
    d = dummies(pdf, keys)
    want = d.shape[1] - np.linalg.matrix_rank(d)
    assert felm("y ~ x | id + firm + shoe", df, nostats=True, exact_dof=True).refs == want
    monkeypatch.setattr(absorb, "EXACT", 1)
    f = felm("y ~ x | id + firm + shoe", df, nostats=True, exact_dof=True)
    assert f.refs == want > felm("y ~ x | id + firm + shoe", df, nostats=True).refs - 1
    assert felm("y ~ x | id + firm", df, nostats=True, exact_dof=True).refs == 1


def test_a_function_that_is_not_estimable_warns(df):
    f = felm("y ~ x | id + firm + shoe", df, nostats=True)
    with pytest.warns(UserWarning, match="non-estimable"):
        E.getfe(f, "ref")


@pytest.mark.parametrize("clusters", [False, True])
def test_robust_biases(df, pdf, clusters):
    f = felm("y ~ x + x2 | id + firm" + (" | 0 | clu" if clusters else ""), df)
    cov, bias = E.fevcov(f, robust=True)
    d, x = dummies(pdf, ["id", "firm"]), pdf[["x", "x2"]].to_numpy()
    n = len(d)
    z = d - x @ np.linalg.lstsq(x, d, rcond=None)[0]
    inv = np.linalg.pinv(d.T @ z, rcond=1e-10)
    u = pdf.y - np.concatenate([x, d], 1) @ np.linalg.lstsq(np.concatenate([x, d], 1), pdf.y, rcond=1e-10)[0]
    s = z * u.to_numpy()[:, None]
    meat = s.T @ s
    if clusters:
        sums = np.stack([s[pdf.clu == c].sum(0) for c in range(12)])
        meat = sums.T @ sums
    cut = [slice(0, 40), slice(40, 65)]
    centred = d - d.mean(0)
    for i, j in ((0, 0), (0, 1), (1, 1)):
        q = centred[:, cut[i]].T @ centred[:, cut[j]]
        want = (n - 1) / f.df * np.trace(inv[:, cut[i]] @ q @ inv[cut[j]] @ meat) / n
        got = bias[i, j]
        assert got == pytest.approx(min(want, 0.999 * (cov + bias)[i, j]) if i == j else want, rel=1e-6)


def test_quantiles_are_exact(spark, df, pdf):
    assert quantiles(df, F.col("x"), [0, 0.25, 0.5, 0.9, 1]) == pytest.approx(np.quantile(pdf.x, [0, 0.25, 0.5, 0.9, 1]))
    ties = spark.createDataFrame([(float(k % 3),) for k in range(50)] + [(None,)], "v double")
    assert quantiles(ties, F.col("v"), [0.5]) == [1.0] and np.isnan(quantiles(ties.where("false"), F.col("v"), [0.5])[0])


def test_equal_rows_draw_apart(spark):
    twice = spark.createDataFrame([(1.0, 2.0)] * 300, "x double, y double")
    keys = E._numbered(twice, F.xxhash64("x", "y"), "k")
    assert keys.select("k").distinct().count() == 300
    assert sorted(r[0] for r in keys.collect()) == sorted(r[0] for r in E._numbered(twice.repartition(7), F.xxhash64("x", "y"), "k").collect())


def test_accessors_and_reports(df, pdf):
    f = felm("y ~ x + x2 | id", df)
    rows = f.fitted().toPandas()
    assert len(rows) == f.nobs() == len(pdf) and f.weights() is None
    assert (rows.response - rows.fitted).to_numpy() == pytest.approx(rows.residual.to_numpy()) and sorted(rows.response) == pytest.approx(sorted(pdf.y))
    small = felm("y ~ x | id", df)
    v = f.vcov("iid")
    gap = np.array([f.coef()["x"] - small.coef()["x"], f.coef()["x2"]])
    t = f.ftest(small)
    assert t["df1"] == 1 and t["df2"] == f.df and t["F"] == pytest.approx(gap @ np.linalg.inv(v) @ gap)
    text = f.report()
    assert "Residual standard error" in text and "x2" in text and text.startswith("Summary for outcome y")
    assert f.latex().count(r"\\") == 3 and r"\hline" in f.latex()


def test_residuals_are_drawn_by_rank(spark):
    rng = np.random.default_rng(2)
    u = np.append(rng.normal(size=4999), 1000.0)
    rows = spark.createDataFrame(pd.DataFrame({"_u": u}))
    draw = E._residual_draws(rows, 5000)
    got = spark.range(200_000).select(draw((F.col("id") + 0.5) / 200_000).alias("v")).toPandas()["v"].to_numpy()
    # each row has one chance in n, an outlier too
    assert (got == 1000.0).sum() == 40 and got.min() == u.min()
    assert got[got < 100].mean() == pytest.approx(u[:-1].mean(), abs=2e-3) and got[got < 100].std() == pytest.approx(u[:-1].std(), rel=5e-3)
    few = E._residual_draws(rows.limit(7), 7)
    seven = spark.range(7).select(few((F.col("id") + 0.5) / 7).alias("v")).toPandas()["v"]
    assert sorted(seven) == sorted(rows.limit(7).toPandas()["_u"])


def test_the_larger_factor_is_eliminated_in_workers(spark, monkeypatch):
    from plumbline.operators import eliminate

    rng = np.random.default_rng(5)
    n = 600
    rows = pd.DataFrame({"id": rng.integers(0, 150, n), "part": rng.integers(0, 40, n), "x": rng.normal(size=n), "w": rng.integers(1, 4, n).astype(float)})
    rows.loc[rows.id < 70, "part"] = rows.part % 15  # three components: 70 ids, 79 and one alone with its part
    rows.loc[rows.id >= 70, "part"] = 15 + rows.part % 24
    rows.loc[rows.id == 149, "part"] = 99
    rows["y"] = 2 * rows.x + rows.id % 7 + rows.part % 3 + rng.normal(size=n)
    rows["same"] = (rows.id % 5) + (rows.part % 4)  # explained by the factors
    df = spark.createDataFrame(rows.assign(part=rows.part.map("p{}".format)))
    told = lambda f: (f.coef()["x"], f.df, f.refs, f.exact_df(), *f.bad)
    here = [felm("y ~ x + same | part + id", df, w, nostats=True) for w in (None, "w")]
    monkeypatch.setattr(absorb, "EDGES", 1)
    monkeypatch.setattr(eliminate, "CHUNK", 7)
    monkeypatch.setattr(eliminate, "BLOCK", 16)
    monkeypatch.setattr(eliminate, "ENTRIES", 80)

    def steps(self, v):
        raise AssertionError("joins for each step")

    monkeypatch.setattr(absorb.Absorbed, "_distributed_gram", steps)
    there = [felm("y ~ x + same | part + id", df, w, nostats=True) for w in (None, "w")]
    for f, g in zip(here, there, strict=True):
        assert told(g) == pytest.approx(told(f)) and g.refs == 3 and len(g.bad) == 1
        assert "_tables" not in vars(g.absorbed)  # no level of the larger factor reached the driver
    d = dummies(rows, ["id", "part"])
    assert there[0].df == n - np.linalg.matrix_rank(np.column_stack([d, rows.x, rows.same]))

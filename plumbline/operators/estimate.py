"""Least squares, two-stage least squares and k-class estimation on absorbed columns, with their covariances and tests.

Everything but robust and clustered covariances follows from one matrix of moments; those take one pass over
the residual rows.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.dist import chi2_upper, f_upper, t_quantile, t_two_sided
from plumbline.functions.linalg import dependent_columns, inverse_without, pinv
from plumbline.plans.formula import Model, parse, split, updated
from plumbline.plans.frame import Frame, build
from plumbline.plans.shared import ranked

from .absorb import Absorbed, demean


@dataclass
class Stats:
    """One response's covariances and degrees of freedom."""

    vcov: np.ndarray
    df: float
    residual: np.ndarray  # the residual as a combination of the absorbed columns
    rss: float
    robust: np.ndarray | None = None
    cluster: np.ndarray | None = None


@dataclass
class Fit:
    model: Model
    frame: Frame
    absorbed: Absorbed
    lhs: list[str]
    names: list[str]
    coefficients: np.ndarray  # names x responses
    design: np.ndarray  # absorbed columns x names
    stats: dict[str, Stats]
    n: int
    p: int  # parameters, absorbed ones and controls included
    df: float
    refs: int
    bad: list[int]
    moments: np.ndarray
    tss: dict[str, float]
    ptss: dict[str, float]
    has_intercept: bool
    endogenous: list[str] = field(default_factory=list)
    instruments: list[str] = field(default_factory=list)
    stage1: Fit | None = None
    kappa: float | None = None
    iv_rss: dict[str, float] = field(default_factory=dict)
    clusters: list[int] = field(default_factory=list)
    source: DataFrame | None = None
    options: dict = field(default_factory=dict)

    # ------------------------------------------------------------------ accessors

    def one(self, lhs: str | None = None) -> str:
        if lhs is None and len(self.lhs) > 1:
            raise ValueError(f"name one response of {self.lhs}")
        if lhs is not None and lhs not in self.lhs:
            raise ValueError(f"{lhs} is none of {self.lhs}")
        return lhs or self.lhs[0]

    def coef(self, lhs: str | None = None) -> dict[str, float]:
        return dict(zip(self.names, self.coefficients[:, self.lhs.index(self.one(lhs))].tolist(), strict=True))

    def kind(self, kind: str = "default") -> str:
        return ("cluster" if self.clusters else "iid") if kind == "default" else kind

    def vcov(self, kind: str = "default", lhs: str | None = None) -> np.ndarray:
        s = self.stats[self.one(lhs)]
        v = {"iid": s.vcov, "robust": s.robust, "cluster": s.cluster}[self.kind(kind)]
        if v is None:
            raise ValueError(f"this fit has no {self.kind(kind)} covariance")
        return v

    def se(self, kind: str = "default", lhs: str | None = None) -> np.ndarray:
        with np.errstate(invalid="ignore"):
            return np.sqrt(np.diag(self.vcov(kind, lhs)))

    def table(self, kind: str = "default", lhs: str | None = None) -> DataFrame:
        """term, estimate, std_error, t_value, p_value."""
        lhs = self.one(lhs)
        rows = []
        for name, b, se in zip(self.names, self.coefficients[:, self.lhs.index(lhs)], self.se(kind, lhs), strict=True):
            t = b / se if se else np.nan
            rows.append((name, float(b), float(se), float(t), t_two_sided(float(t), self.stats[lhs].df)))
        return self.frame.df.sparkSession.createDataFrame(rows, "term string, estimate double, std_error double, t_value double, p_value double")

    def confint(self, level: float = 0.95, kind: str = "default", lhs: str | None = None, parm: list[str] | None = None) -> dict[str, tuple[float, float]]:
        out = {}
        for one in [lhs] if lhs else self.lhs:
            q = t_quantile((1 + level) / 2, self.stats[one].df)
            for name, b, se in zip(self.names, self.coefficients[:, self.lhs.index(one)], self.se(kind, one), strict=True):
                if parm is None or name in parm:
                    out[name if lhs or len(self.lhs) == 1 else f"{one}:{name}"] = (b - q * se, b + q * se)
        return out

    def loglik(self, lhs: str | None = None) -> float:
        """Gaussian, with true weights."""
        lw = float(self.frame.df.agg(F.sum(F.log("_w"))).first()[0]) if self.frame.weighted else 0.0
        return 0.5 * (lw - self.n * (np.log(2 * np.pi) + 1 - np.log(self.n) + np.log(self.stats[self.one(lhs)].rss)))

    def residual_rows(self, lhs: str | None = None, design: bool = False) -> DataFrame:
        """The frame's rows with _u, the residual, and with design the centred covariates _x0, _x1, ..."""
        rows = self.absorbed.residuals()
        cols = [F.col(c) for c in self.absorbed.columns]
        mix = lambda v: sum((c * float(a) for c, a in zip(cols, v, strict=True) if a), F.lit(0.0))
        out = [mix(self.stats[self.one(lhs)].residual).alias("_u")]
        if design:
            out += [mix(self.design[:, k]).alias(f"_x{k}") for k in range(len(self.names))]
        keep = [c for c in rows.columns if c not in self.absorbed.columns]
        return rows.select(*keep, *out)

    def model_matrix(self, centred: bool = True) -> DataFrame:
        if centred:
            return self.residual_rows(self.lhs[0], True).select(*[F.col(f"_x{k}").alias(n) for k, n in enumerate(self.names)])
        return self.frame.df.select(*[F.col(c).alias(n) for n, c in self.frame.columns["x"]])

    def estfun(self, lhs: str | None = None) -> DataFrame:
        """Scores: weight times residual times centred covariate."""
        return self.residual_rows(lhs, True).select(*[(F.col("_w") * F.col("_u") * F.col(f"_x{k}")).alias(n) for k, n in enumerate(self.names)])

    def bread(self) -> np.ndarray:
        return self.n * inverse_without(self.design.T @ self.moments @ self.design, self.bad)

    def update(self, change: str) -> Fit:
        return felm(updated(self.model, change), self.source, **self.options)

    # ------------------------------------------------------------------ tests

    def waldtest(self, restriction, r=None, kind: str = "default", lhs: str | None = None, df1: float | None = None, df2: float | None = None) -> dict[str, float]:
        """restriction: names (endogenous ones may be bare, 'endovars' means all), positions, a matrix, a formula `~ a - 1 | b + 0.2`, or a function of the coefficients."""
        lhs = self.one(lhs)
        b, v = np.nan_to_num(self.coefficients[:, self.lhs.index(lhs)]), np.nan_to_num(self.vcov(kind, lhs))
        if callable(restriction):
            value = np.atleast_1d(restriction(b))
            step = 1e-6 * np.maximum(1, np.abs(b))
            m = np.stack([(np.atleast_1d(restriction(b + h)) - np.atleast_1d(restriction(b - h))) / (2 * h.max()) for h in np.diag(step)], 1)
        else:
            if isinstance(restriction, str) and restriction.lstrip().startswith("~"):
                m, r = restrictions(restriction, self.names)
            elif isinstance(restriction, np.ndarray) and restriction.ndim == 2:
                m = restriction
            else:
                picked = [restriction] if isinstance(restriction, str) else list(restriction)
                if "endovars" in picked:
                    picked = [x for x in picked if x != "endovars"] + self.endogenous
                if picked and isinstance(picked[0], bool | np.bool_):
                    picked = [k for k, on in enumerate(picked) if on]
                at = [x if isinstance(x, int | np.integer) else self.names.index(f"`{x}(fit)`" if f"`{x}(fit)`" in self.names else x) for x in picked]
                m = np.eye(len(b))[at]
            value = m @ b - (np.zeros(len(m)) if r is None else np.asarray(r, float))
        w = m @ v @ m.T
        try:
            chi2 = float(value @ np.linalg.solve(w, value))
        except np.linalg.LinAlgError:
            chi2 = float(value @ pinv(w)[0] @ value)
        df1 = len(value) if df1 is None else df1
        if df2 is None:
            df2 = self.stats[lhs].df
            if self.clusters and self.kind(kind) == "cluster":
                df2 = min(self.clusters[0] - 1, df2)
        return {"p": chi2_upper(chi2, df1), "chi2": chi2, "df1": df1, "p.F": f_upper(chi2 / df1, df1, df2), "F": chi2 / df1, "df2": df2}

    def sargan(self, lhs: str | None = None) -> dict[str, float]:
        """Over-identification: N (1 - e'e / u'u), e what instruments and covariates leave of the residual u; unweighted."""
        if self.stage1 is None:
            raise ValueError("no instruments")
        m, u = self.moments, self.stats[self.one(lhs)].residual
        d = self.stage1.design
        g = d.T @ m @ d
        left = u - d @ np.nan_to_num(pinv(g)[0] @ (d.T @ m @ u))
        uu, ee = float(u @ m @ u), float(left @ m @ left)
        s = self.n * (1 - ee / uu)
        k = d.shape[1] - len(self.names)
        basmann = s * (self.n - 1) / (self.n - s)
        return {"sargan": s, "df": k, "p": chi2_upper(s, k) if k > 0 else np.nan, "basmann": basmann}

    def condfstat(self, kind: str = "default", lhs: str | None = None) -> dict[str, float]:
        """Conditional F of the first stage, one for each endogenous variable."""
        st = self.stage1
        if st is None:
            raise ValueError("a conditional F needs instruments")
        kind = self.kind(kind)
        if len(st.lhs) == 1:
            df1 = len(st.names)
            return {st.lhs[0]: st.waldtest(st.instruments, kind=kind, df1=df1)["F"], "df1": df1}
        m = self.moments
        x = st.design[:, [k for k, n in enumerate(st.names) if n not in st.instruments]]
        out_x = lambda a: a - x @ (pinv(x.T @ m @ x)[0] @ (x.T @ m @ a)) if x.shape[1] else a
        q = np.stack([self._unit("q", k) for k in range(len(st.lhs))], 1)
        hat = st.design @ np.nan_to_num(st.coefficients)
        z = out_x(st.design[:, [st.names.index(n) for n in st.instruments]])
        q, hat = out_x(q), out_x(hat)
        left = []
        for k in range(q.shape[1]):
            rest = [j for j in range(q.shape[1]) if j != k]
            h = hat[:, rest]
            left.append(q[:, k] - q[:, rest] @ np.linalg.solve(h.T @ m @ h, h.T @ m @ q[:, k]))
        left = np.stack(left, 1)
        fit = _ols(self, z, st.instruments, left, st.lhs, clusters=kind == "cluster", robust=kind == "robust")
        df1 = z.shape[1] - len(st.lhs) + 1
        out = {name: fit.waldtest(st.instruments, kind=kind, lhs=name, df1=df1)["F"] for name in st.lhs}
        return {**out, "df1": df1}

    def _unit(self, role: str, k: int) -> np.ndarray:
        v = np.zeros(len(self.absorbed.columns))
        v[self.absorbed.columns.index(self.frame.columns[role][k][1])] = 1
        return v

    def nlexpect(self, fun: Callable, coefs: list[str], tol: float = 1e-3, lhs: str | None = None, kind: str = "default", most: int = 2_000_000, seed: int = 1) -> float:
        """E f(beta) for independent t coordinates mapped by the covariance's Cholesky factor: Gauss-Legendre on quantiles up to three coefficients, else random draws."""
        lhs = self.one(lhs)
        at = [self.names.index(f"`{c}(fit)`" if f"`{c}(fit)`" in self.names else c) for c in coefs]
        b = self.coefficients[at, self.lhs.index(lhs)]
        low = np.linalg.cholesky(self.vcov(kind, lhs)[np.ix_(at, at)])
        df = self.stats[lhs].df
        if len(at) <= 3:
            old = None
            for n in (16, 32, 64, 128) if len(at) < 3 else (12, 24, 48):
                p, w = np.polynomial.legendre.leggauss(n)
                q = np.array([t_quantile((x + 1) / 2, df) for x in p])
                grid = np.array(list(product(range(n), repeat=len(at))))
                value = np.array([np.asarray(fun(dict(zip(coefs, b + low @ q[g], strict=True)))) for g in grid])
                total = (value.T * np.prod(w[grid] / 2, 1)).sum(-1)
                if old is not None and np.max(np.abs(total - old)) <= tol * max(1e-12, np.max(np.abs(total))):
                    break
                old = total
            return float(total) if np.ndim(total) == 0 else total
        rng, n, total, square = np.random.default_rng(seed), 0, 0.0, 0.0
        while n < most:
            value = np.array([fun(dict(zip(coefs, b + low @ d, strict=True))) for d in rng.standard_t(df, size=(10_000, len(at)))], float)
            n, total, square = n + len(value), total + value.sum(0), square + (value * value).sum(0)
            error = np.sqrt(np.maximum(square / n - (total / n) ** 2, 0) / n)
            if np.all(error <= tol * np.maximum(np.abs(total / n), 1e-12)):
                break
        else:
            warnings.warn(f"the expectation's relative error is {float(np.max(error / np.maximum(np.abs(total / n), 1e-300))):.1e} after {n} draws", stacklevel=2)
        return float(total / n) if np.ndim(total) == 0 else total / n

    def summary(self, robust: bool | None = None, lhs: str | None = None) -> dict:
        lhs = self.one(lhs)
        s = self.stats[lhs]
        robust = bool(self.clusters) if robust is None else robust
        kind = ("cluster" if self.clusters else "robust") if robust else "iid"
        icpt = 1 if self.absorbed.terms else int(self.has_intercept)
        rdf, rss, tss = self.n - self.p, s.rss, self.tss[lhs]
        resvar = rss / rdf if rdf > 0 else np.nan
        r2 = 1 - rss / tss
        mss = tss - self.iv_rss.get(lhs, rss)
        f = mss / (self.p - icpt) / resvar if self.p > icpt else np.nan
        pr2 = 1 - rss / self.ptss[lhs]
        u = self.residual_rows(lhs)
        five = quantiles(u, F.col("_u") * F.sqrt("_w"), [0.0, 0.25, 0.5, 0.75, 1.0])
        out = {
            "coefficients": self.table(kind, lhs), "kind": kind, "n": self.n, "df": rdf, "sigma": float(np.sqrt(resvar)), "r2": r2, "adj_r2": 1 - (1 - r2) * (self.n - icpt) / rdf,
            "projected_r2": pr2, "projected_adj_r2": 1 - (1 - pr2) * (self.n - icpt) / rdf, "F": f, "F_df1": self.p - icpt, "F_df2": rdf, "F_p": f_upper(f, self.p - icpt, rdf),
            "projected_F": self.waldtest([n for k, n in enumerate(self.names) if n != "(Intercept)" and k not in self.bad], kind=kind, lhs=lhs), "residuals": five,
            "df_may_be_too_high": len(self.absorbed.pure()) > 2,
        }
        if self.endogenous and self.stage1 is not None:
            out["endogenous_F"] = self.waldtest("endovars", kind=kind, lhs=lhs)
            out["first_stage_F"] = {q: self.stage1.waldtest(self.stage1.instruments, kind="iid", lhs=q) for q in self.stage1.lhs}
            out["first_stage_robust_F"] = {q: self.stage1.waldtest(self.stage1.instruments, kind="robust", lhs=q) for q in self.stage1.lhs if self.stage1.stats[q].robust is not None}
        return out

    def nobs(self) -> int:
        return self.n

    def exact_df(self) -> float:
        """The residual degrees of freedom that exact_dof=True gives, from the absorption that the fit has."""
        rank = len(self.names) - len(self.bad) + self.controls
        return float(self.n - rank - self.absorbed.total + self.absorbed.references(exact=True))

    def weights(self) -> DataFrame | None:
        """The rows' weights; None if there are none."""
        return self.frame.df.select(F.col("_w").alias("weight")) if self.frame.weighted else None

    def fitted(self, lhs: str | None = None) -> DataFrame:
        """response, fitted and residual of each row of the frame."""
        lhs = self.one(lhs)
        y = self.frame.cols("y")[self.lhs.index(lhs)]
        # the response is a column of the absorbed ones, so it is put aside before absorption
        kept, df = y + "_kept", self.frame.df
        self.frame.df = df.withColumn(kept, F.col(y))
        try:
            rows = self.residual_rows(lhs)
        finally:
            self.frame.df = df
        return rows.select(F.col(kept).alias("response"), (F.col(kept) - F.col("_u")).alias("fitted"), F.col("_u").alias("residual"))

    def ftest(self, other: Fit | None = None, kind: str = "iid", lhs: str | None = None) -> dict[str, float]:
        """F of all coefficients against zero, or against those of a nested fit; the numerator's degrees of freedom are the parameters (or their difference)."""
        lhs = self.one(lhs)
        smaller = other.coef(lhs) if other is not None else {}
        gap = np.nan_to_num(np.array([b - smaller.get(n, 0.0) for n, b in self.coef(lhs).items()]))
        df1 = self.p - (other.p if other is not None else 0)
        f = float(gap @ pinv(np.nan_to_num(self.vcov(kind, lhs)))[0] @ gap) / df1
        return {"F": f, "p": f_upper(f, df1, self.df), "df1": df1, "df2": self.df}

    def report(self, robust: bool | None = None, lhs: str | None = None, digits: int = 4) -> str:
        """The summary as text."""
        s, lhs = self.summary(robust, lhs), self.one(lhs)
        g = lambda x: f"{x:.{digits}g}"
        lines = [f"Summary for outcome {lhs}", "", ("Weighted " if self.frame.weighted else "") + "Residuals:", "  ".join(f"{x:>10}" for x in ("Min", "1Q", "Median", "3Q", "Max")), "  ".join(f"{g(x):>10}" for x in s["residuals"]), "", "Coefficients:"]
        rows = s["coefficients"].collect()
        if not rows:
            return "\n".join([*lines, "(No coefficients)"])
        width = max(len(r["term"]) for r in rows)
        lines.append(f"{'':<{width}} " + " ".join(f"{x:>12}" for x in ("Estimate", "Std. error", "t value", "p")))
        stars = lambda p: next((m for cut, m in ((0.001, "***"), (0.01, "**"), (0.05, "*"), (0.1, ".")) if p < cut), "")
        lines += [f"{r['term']:<{width}} " + " ".join(f"{g(r[c]):>12}" for c in ("estimate", "std_error", "t_value", "p_value")) + f" {stars(r['p_value'])}" for r in rows]
        f = s["projected_F"]
        lines += ["", f"Residual standard error: {g(s['sigma'])} on {s['df']} degrees of freedom", f"R-squared (full model): {g(s['r2'])}  adjusted: {g(s['adj_r2'])}", f"R-squared (projected model): {g(s['projected_r2'])}  adjusted: {g(s['projected_adj_r2'])}",
                  f"F (full model{', iid' if s['kind'] != 'iid' else ''}): {g(s['F'])} on {s['F_df1']} and {s['F_df2']} df, p {g(s['F_p'])}", f"F (projected model): {g(f['F'])} on {f['df1']} and {g(f['df2'])} df, p {g(f['p.F'])}"]
        if "endogenous_F" in s:
            f = s["endogenous_F"]
            lines.append(f"F (endogenous variables): {g(f['F'])} on {f['df1']} and {g(f['df2'])} df, p {g(f['p.F'])}")
        if s["df_may_be_too_high"] and not self.options.get("exact_dof"):
            lines.append("Standard errors may be too high: more than two factors, and the rank is not exact")
        if self.controls:
            lines.append(f"{self.controls} variable(s) were projected out")
        return "\n".join(lines)

    def latex(self, robust: bool | None = None, lhs: str | None = None, digits: int = 4) -> str:
        """The summary's coefficients as a LaTeX table."""
        rows = self.summary(robust, lhs)["coefficients"].collect()
        clean = lambda x: re.sub(r"([&%$#_{}])", r"\\\1", x)
        body = [" & ".join([clean(r["term"]), *(f"{r[c]:.{digits}g}" for c in ("estimate", "std_error", "t_value", "p_value"))]) + r" \\" for r in rows]
        head = [r"\begin{tabular}{lrrrr}", r"\hline", r" & Estimate & Std. Error & t value & Pr($>|t|$) \\", r"\hline"]
        return "\n".join([*head, *body, r"\hline", r"\end{tabular}"])

    def __str__(self) -> str:
        width = max([*map(len, self.names), 4])
        lines = [f"{n:<{width}} " + " ".join(f"{x:>14.6g}" for x in row) for n, row in zip(self.names, self.coefficients, strict=True)]
        return "\n".join([f"{'':<{width}} " + " ".join(f"{x:>14}" for x in self.lhs), *lines])


def order_statistics(df: DataFrame, value: Column, places: list[int]) -> dict[int, float]:
    """The values at the given places (from 1) of the non-null values in order. Rows are put in order by ranges; only the values asked for reach the driver."""
    x = ranked(df.select(value.cast("double").alias("v")).where("v is not null"), [F.col("v")])
    return {r["position"]: r["v"] for r in x.where(F.col("position").isin(places)).collect()}


def quantiles(df: DataFrame, value: Column, probs: list[float]) -> list[float]:
    """Exact quantiles, interpolated between order statistics."""
    n = df.where(value.isNotNull()).count()
    if not n:
        return [float("nan")] * len(probs)
    places = [(n - 1) * q for q in probs]
    got = order_statistics(df, value, sorted({int(f(p)) + 1 for p in places for f in (np.floor, np.ceil)}))
    return [got[int(np.floor(p)) + 1] + (p - np.floor(p)) * (got[int(np.ceil(p)) + 1] - got[int(np.floor(p)) + 1]) for p in places]


def restrictions(text: str, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """`~ a - 1 | 2 * b + c + 0.2`: each part is a linear form that is to be zero."""
    rows, rhs = [], []
    for _, part in split(text.lstrip()[1:], "|"):
        row, r = np.zeros(len(names)), 0.0
        for sign, t in split(part, "+-"):
            if not t:
                continue
            f = -1.0 if sign == "-" else 1.0
            pieces = [p for _, p in split(t, "*")]
            number = [p for p in pieces if re.fullmatch(r"[0-9.eE]+", p)]
            name = [p for p in pieces if p not in number]
            f *= float(np.prod([float(x) for x in number])) if number else 1.0
            if not name:
                r -= f
                continue
            n = name[0]
            row[names.index(f"`{n}(fit)`" if f"`{n}(fit)`" in names else n)] += f
        rows.append(row)
        rhs.append(r)
    return np.array(rows), np.array(rhs)


# ---------------------------------------------------------------------- estimation


def _sandwich_rows(rows: DataFrame, u: Column, xs: list[Column], clusters: list[str] | None) -> np.ndarray:
    """Sum of outer products of scores, by row or by cluster."""
    k = len(xs)
    score = rows.select(*[(F.col("_w") * u * x).alias(f"_e{i}") for i, x in enumerate(xs)], *(clusters or []))
    if clusters:
        score = score.groupBy(*clusters).agg(*[F.sum(f"_e{i}").alias(f"_e{i}") for i in range(k)])
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    got = score.agg(*[F.sum(F.col(f"_e{i}") * F.col(f"_e{j}")).alias(f"m{i}_{j}") for i, j in pairs], F.count(F.lit(1)).alias("n")).first()
    m = np.zeros((k, k))
    for i, j in pairs:
        m[i, j] = m[j, i] = got[f"m{i}_{j}"]
    return m, got["n"]


def nested(frame: Frame, key: str, cluster: str) -> bool:
    """Whether each level of an absorbed term lies in one cluster."""
    return (frame.df.groupBy(key).agg((F.min(cluster) == F.max(cluster)).alias("one")).agg(F.min("one")).first()[0]) is True


def _ols(base: Fit | None, design: np.ndarray, names: list[str], target: np.ndarray, lhs: list[str], *, shell: dict | None = None, clusters: bool = True, robust: bool = True, noinst: np.ndarray | None = None, kappa: float | None = None, outcome: np.ndarray | None = None, cmethod: str = "cgm", psdef: bool = True, stats: bool = True, known_df: float | None = None) -> Fit:
    """Regression of the combinations `target` on the combinations `design` of absorbed columns.

    noinst and kappa make it a k-class estimate; outcome replaces the design when residuals are formed (2SLS).
    """
    s = shell or base.__dict__
    absorbed, frame, m, n = s["absorbed"], s["frame"], s["moments"], s["n"]
    cross = design.T @ m @ design
    xy = design.T @ m @ target
    if kappa is not None:
        cross = cross - kappa * noinst.T @ m @ noinst
        xy = xy - kappa * noinst.T @ m @ target
    raw = np.diag(design.T @ s["raw"] @ design) if "raw" in s else None
    bad = dependent_columns(design.T @ m @ design, raw) if len(names) else []
    inv = inverse_without(cross, bad)
    beta = np.where(np.isin(np.arange(len(names)), bad)[:, None], np.nan, np.nan_to_num(inv) @ xy) if len(names) else np.zeros((0, len(lhs)))
    vinv = inv
    k_design = design
    if kappa is not None:
        k_design = design - kappa * noinst
        vinv = np.nan_to_num(inv) @ (k_design.T @ m @ k_design) @ np.nan_to_num(inv)
    numdum = absorbed.total - s["refs"]
    rank = len(names) - len(bad) + s["controls"]
    df = float(n - rank - numdum) if known_df is None else float(known_df)
    fit = Fit(
        s["model"], frame, absorbed, lhs, names, beta, design, {}, n, int(n - df), df, s["refs"], bad, m, {}, {}, s["has_intercept"],
        clusters=s["cluster_sizes"] if clusters else [], kappa=kappa,
    )
    fit.raw, fit.controls, fit.cluster_sizes, fit.any_nested = s.get("raw"), s["controls"], s["cluster_sizes"], s["any_nested"]
    residual = target - (design if outcome is None else outcome) @ np.nan_to_num(beta)
    rows = absorbed.residuals() if stats and (robust or clusters) and len(names) else None
    cols = [F.col(c) for c in absorbed.columns]
    mix = lambda v: sum((c * float(a) for c, a in zip(cols, v, strict=True) if a), F.lit(0.0))
    keys = frame.cols("c")
    for j, name in enumerate(lhs):
        u = residual[:, j]
        rss = float(u @ m @ u)
        vcov = rss / df * vinv if df > 0 else np.full_like(vinv, np.nan)
        one = Stats(vcov, df, u, rss)
        fit.stats[name] = one
        if outcome is not None:
            v = target[:, j] - design @ np.nan_to_num(beta[:, j])
            fit.iv_rss[name] = float(v @ m @ v)
        if rows is None or df <= 0:
            continue
        bread = np.nan_to_num(vinv)
        xs, uc = [mix(k_design[:, k]) for k in range(len(names))], mix(u)
        if robust:
            meat, _ = _sandwich_rows(rows, uc, xs, None)
            one.robust = bread @ (n / df * meat) @ bread
        if clusters and keys:
            adjust = (n - 1) / df
            least = min(s["cluster_sizes"])
            if s["any_nested"]:
                adjust *= df / (df + numdum + s["controls"] - 1)
                one.df = min(least - 1, one.df)
            if cmethod in ("cgm", "cgm2", "reghdfe"):
                meat = 0
                for picked in range(1, 2 ** len(keys)):
                    use = [c for b, c in enumerate(keys) if picked >> b & 1]
                    part, g = _sandwich_rows(rows, uc, xs, use)
                    g = g if cmethod == "cgm" else least
                    meat = meat + (1 if len(use) % 2 else -1) * adjust * g / (g - 1) * part
                if cmethod != "cgm":
                    one.df = min(least - 1, one.df)
            elif cmethod == "fitted":
                meat = adjust * _fitted_means(rows, uc, xs, keys)
            else:
                raise ValueError(f"unknown cluster method {cmethod}")
            cv = bread @ meat @ bread
            if psdef and len(keys) > 1:
                value, vector = np.linalg.eigh((cv + cv.T) / 2)
                if (value < 0).any():
                    warnings.warn("negative eigenvalues of the multiway clustered covariance are set to zero", stacklevel=3)
                    cv = (vector * np.maximum(value, 0)) @ vector.T
            one.cluster = cv
    return fit


def _fitted_means(rows: DataFrame, u: Column, xs: list[Column], keys: list[str]) -> np.ndarray:
    """Scores are replaced by what cluster effects explain of them, scaled by the mean cluster size of a row."""
    score = rows.select(*[(F.col("_w") * u * x).alias(f"_e{i}") for i, x in enumerate(xs)], *keys)
    for c in keys:
        score = score.join(score.groupBy(F.col(c).alias(f"_k{c}")).count().withColumnRenamed("count", f"_n{c}"), F.col(c) == F.col(f"_k{c}")).drop(f"_k{c}")
    size = sum((F.col(f"_n{c}") for c in keys), F.lit(0)) / len(keys)
    means = demean(score.withColumn("_size", size), [f"_e{i}" for i in range(len(xs))], [f"factor({c})" for c in keys], means=True)
    pairs = [(i, j) for i in range(len(xs)) for j in range(len(xs))]
    got = means.agg(*[F.sum(F.col("_size") * F.col(f"_e{i}") * F.col(f"_e{j}")).alias(f"m{i}_{j}") for i, j in pairs]).first()
    return np.array([[got[f"m{i}_{j}"] for j in range(len(xs))] for i in range(len(xs))])


def _kappa(kclass: str | float, m: np.ndarray, y: np.ndarray, x: np.ndarray, q: np.ndarray, z: np.ndarray, n: int, fuller: float) -> float:
    if not isinstance(kclass, str):
        return float(kclass)
    k, l = z.shape[1], x.shape[1]

    def liml() -> float:
        w = np.concatenate([y, q], 1)
        left = lambda d: w.T @ m @ w - (w.T @ m @ d) @ pinv(d.T @ m @ d)[0] @ (d.T @ m @ w) if d.shape[1] else w.T @ m @ w
        return float(np.linalg.eigvals(np.linalg.solve(left(np.concatenate([x, z], 1)), left(x))).real.min())

    values = {"2sls": lambda: 1.0, "tsls": lambda: 1.0, "nagar": lambda: 1 + (k - 2) / n, "b2sls": lambda: 1 / (1 - (k - 2) / n), "mb2sls": lambda: (1 - l / n) / (1 - k / n - l / n), "liml": lambda: liml() - (fuller / (n - k) if fuller else 0), "fuller": lambda: liml() - fuller / (n - k)}
    values |= {"btsls": values["b2sls"], "mbtsls": values["mb2sls"]}
    if kclass not in values:
        raise ValueError(f"unknown k-class {kclass}")
    return values[kclass]()


def felm(
    formula: str | Model, data: DataFrame, weights: str | None = None, subset: str | Column | None = None, contrasts: dict | None = None, exact_dof: bool | float | str = False,
    cmethod: str = "cgm", kclass: str | float | None = None, fuller: float = 0.0, psdef: bool = True, nostats: bool = False, wildcard: str = "n", robust: bool = True, iv=None, clustervar=None, eps: float | None = None,
) -> Fit:
    """Fits `y ~ covariates | factors | (endogenous ~ instruments) | clusters | controls`.

    exact_dof: True for the exact rank of the dummies, or the residual degrees of freedom as a number. eps: the solver's
    relative tolerance.
    """
    model = formula if isinstance(formula, Model) else parse(formula, data.columns, wildcard, iv, clustervar)
    frame = build(data, model, weights, subset, contrasts)
    said, model = model, frame.model
    columns = frame.cols("y", "x", "q", "z", "d")
    absorbed = Absorbed(frame, columns, **({"eps": eps} if eps else {}))
    m = absorbed.moments()
    raw = absorbed.raw.copy()
    controls = 0
    k = len(columns)
    nd = len(frame.columns["d"])
    if nd:  # controls leave through the moments, and through the rows' columns
        d = np.arange(k - nd, k)
        bad = dependent_columns(m[np.ix_(d, d)], np.diag(raw)[d])
        good = [int(x) for j, x in enumerate(d) if j not in bad]
        gamma = np.linalg.solve(m[np.ix_(good, good)], m[np.ix_(good, range(k - nd))])
        absorbed = _Controlled(absorbed, good, gamma, nd)
        m = m[: k - nd, : k - nd] - m[np.ix_(range(k - nd), good)] @ gamma
        raw, controls, k = raw[: k - nd, : k - nd], len(good), k - nd
    refs = absorbed.references(exact=exact_dof is True or isinstance(exact_dof, str))
    known = float(exact_dof) if not isinstance(exact_dof, bool | str) else None
    keys = frame.cols("c")
    sizes = [int(frame.df.select(c).distinct().count()) for c in keys]
    any_nested = any(nested(frame, t.key, c) for t in absorbed.terms for c in keys)
    shell = {"absorbed": absorbed, "frame": frame, "moments": m, "raw": raw, "n": absorbed.n, "refs": refs, "controls": controls, "model": model, "has_intercept": model.intercept, "cluster_sizes": sizes, "any_nested": any_nested}
    at = {c: i for i, c in enumerate(columns[:k])}
    unit = lambda role: np.stack([np.eye(k)[at[c]] for c in frame.cols(role)], 1) if frame.columns[role] else np.zeros((k, 0))
    y, x, q, z = (unit(r) for r in "yxqz")
    common = {"shell": shell, "cmethod": cmethod, "psdef": psdef, "stats": not nostats, "robust": robust, "clusters": bool(keys)}
    names, lhs = frame.names("x"), frame.names("y")
    if q.shape[1]:
        w, wn = np.concatenate([x, z], 1), names + frame.names("z")
        if kclass is not None:
            kappa = _kappa(kclass, m, y, x, q, z, absorbed.n, fuller)
            stage1 = _ols(None, w, wn, q, frame.names("q"), **{**common, "clusters": bool(keys)})
            xq = np.concatenate([x, q], 1)
            left = xq - w @ pinv(w.T @ m @ w)[0] @ (w.T @ m @ xq)
            fit = _ols(None, xq, names + frame.names("q"), y, lhs, noinst=left, kappa=kappa, known_df=known, **common)
        else:
            stage1 = _ols(None, w, wn, q, frame.names("q"), known_df=known, **common)
            hat = w @ np.nan_to_num(stage1.coefficients)
            fit = _ols(None, np.concatenate([x, hat], 1), names + [f"`{n}(fit)`" for n in frame.names("q")], y, lhs, outcome=np.concatenate([x, q], 1), known_df=known, **common)
        stage1.instruments = frame.names("z")
        fit.stage1, fit.endogenous, fit.instruments = stage1, frame.names("q"), frame.names("z")
    else:
        fit = _ols(None, x, names, y, lhs, known_df=known, **common)
    for j, name in enumerate(lhs):
        c = at[frame.cols("y")[j]]
        mean = absorbed.mean[c] - absorbed.shift[c]
        fit.tss[name] = float(absorbed.raw[c, c] - absorbed.sum_w * mean * mean)
        one = m[c, c] if absorbed.terms or not model.intercept else absorbed.raw[c, c] - absorbed.sum_w * mean * mean
        fit.ptss[name] = float(one)
    fit.model = said
    fit.source, fit.options = data, {"weights": weights, "subset": subset, "contrasts": contrasts, "exact_dof": exact_dof, "cmethod": cmethod, "kclass": kclass, "fuller": fuller, "psdef": psdef, "robust": robust, "eps": eps}
    return fit


class _Controlled:
    """Absorbed columns from which controls are taken off too."""

    def __init__(self, absorbed: Absorbed, good: list[int], gamma: np.ndarray, nd: int):
        self.inner, self.good, self.gamma = absorbed, good, gamma
        self.columns = absorbed.columns[: len(absorbed.columns) - nd]

    def __getattr__(self, name):
        return getattr(self.inner, name)

    def residuals(self) -> DataFrame:
        rows = self.inner.residuals()
        c = self.inner.columns
        new = {n: F.col(n) - sum((F.col(c[g]) * float(self.gamma[j, i]) for j, g in enumerate(self.good)), F.lit(0.0)) for i, n in enumerate(self.columns)}
        return rows.select(*[x for x in rows.columns if x not in c], *[v.alias(n) for n, v in new.items()])


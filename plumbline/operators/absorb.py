"""Absorbing group effects in level space.

Rows are aggregated once: sums of each column by level, and weights by pair of levels. All iteration is then on
vectors of level length, by preconditioned conjugate gradients on the dummies' cross product; rows come back
only when residuals are asked for. Up to EDGES pairs of levels the system is solved on the driver; beyond that,
each product is a join of the written cells to the level vectors for each term, and one aggregation by level. Of two
pure factors the larger one is then eliminated in workers: cross products, levels and components need no other vectors
than the smaller one's.
"""

from __future__ import annotations

from functools import cached_property
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.config import DEFAULTS
from plumbline.functions.linalg import cgsolve, pinv
from plumbline.operators.components import connected_components
from plumbline.operators.eliminate import Eliminated
from plumbline.plans.formula import Model
from plumbline.plans.frame import Frame, Term, build
from plumbline.plans.shared import written

EDGES, DENSE, BROADCAST, EXACT = DEFAULTS.edges, DEFAULTS.dense, DEFAULTS.broadcast, DEFAULTS.exact


def _slope(t: Term):
    return F.col(t.slope) if t.slope else F.lit(1.0)


class Absorbed:
    """Level sums of a frame's columns, and solutions of the normal equations of its terms."""

    def __init__(self, frame: Frame, columns: list[str], shift: bool = True, eps: float = DEFAULTS.eps, need_edges: bool = True):
        self.frame, self.columns, self.terms, self.eps = frame, columns, frame.terms, eps
        df, w = frame.df, F.col("_w")
        sums = df.agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("w"), *[F.sum(w * F.col(c)).alias(c) for c in columns]).first()
        self.n, self.sum_w = sums["n"], sums["w"] or 0.0
        if not self.n:
            raise ValueError("0 (non-NA) cases")
        pure = any(t.pure for t in self.terms)
        self.mean = np.array([sums[c] / self.sum_w for c in columns])
        self.shift = self.mean if shift and pure else np.zeros(len(columns))
        z = [F.col(c) - F.lit(float(m)) for c, m in zip(columns, self.shift, strict=True)]
        k = len(columns)
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        raw = df.agg(*[F.sum(w * z[i] * z[j]).alias(f"m{i}_{j}") for i, j in pairs]).first() if pairs else {}
        self.raw = np.zeros((k, k))
        for i, j in pairs:
            self.raw[i, j] = self.raw[j, i] = raw[f"m{i}_{j}"]
        self._shifted = z
        self.edges: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.distributed = False
        self._pair: Eliminated | None = None
        if len(self.terms) > 1 and need_edges:
            self._collect_edges()
        self._g: np.ndarray | None = None

    @cached_property
    def _tables(self) -> tuple[list[pd.DataFrame], list[np.ndarray]]:
        df, w, z, k = self.frame.df, F.col("_w"), self._shifted, len(self.columns)
        levels, sums = [], []
        for t in self.terms:
            s = _slope(t)
            x = df.groupBy(F.col(t.key).alias("level")).agg(F.count(F.lit(1)).alias("obs"), F.sum(w * s * s).alias("w"), *[F.sum(w * s * z[i]).alias(f"z{i}") for i in range(k)])
            x = x.toPandas().sort_values("level", kind="stable", ignore_index=True)
            levels.append(x[["level", "obs", "w"]])
            sums.append(x[[f"z{i}" for i in range(k)]].to_numpy(float).reshape(len(x), k))
        return levels, sums

    @property
    def levels(self) -> list[pd.DataFrame]:
        return self._tables[0]

    @property
    def sums(self) -> list[np.ndarray]:
        return self._tables[1]

    @cached_property
    def first(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum([len(x) for x in self.levels])]).astype(int)

    @cached_property
    def total(self) -> int:
        return self._pair.levels if self._pair else int(self.first[-1])

    @cached_property
    def diagonal(self) -> np.ndarray:
        return np.concatenate([x["w"].to_numpy(float) for x in self.levels]) if self.terms else np.zeros(0)

    def _collect_edges(self) -> None:
        df, w = self.frame.df, F.col("_w")
        pair = None
        if len(self.terms) == 2 and all(t.pure for t in self.terms) and self.n > EDGES:
            a, b = (F.col(t.key) for t in self.terms)
            pair = df.groupBy(a.alias("a"), b.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("w"), *[F.sum(w * z).alias(f"z{i}") for i, z in enumerate(self._shifted)])
            pair = written(pair, "pairs")
            if pair.count() > EDGES:
                self.distributed, self._pair = True, Eliminated(pair.drop("n"), len(self._shifted))
                return
        index = [pd.Index(x["level"]) for x in self.levels]
        for a, b in combinations(range(len(self.terms)), 2):
            ta, tb = self.terms[a], self.terms[b]
            if pair is not None:
                e = pair.select("a", "b", F.col("w").alias("v"), "n")
            else:
                e = df.groupBy(F.col(ta.key).alias("a"), F.col(tb.key).alias("b")).agg(F.sum(w * _slope(ta) * _slope(tb)).alias("v"), F.count(F.lit(1)).alias("n"))
                if len(self.levels[a]) * len(self.levels[b]) > EDGES:
                    e = written(e, "edges")
                    if e.count() > EDGES:
                        self.distributed, self.edges = True, []
                        return
            e = e.toPandas()
            self.edges.append((index[a].get_indexer(e["a"]) + self.first[a], index[b].get_indexer(e["b"]) + self.first[b], e["v"].to_numpy(float), e["n"].to_numpy(float)))

    def gram(self, v: np.ndarray) -> np.ndarray:
        """The dummies' cross product times level vectors."""
        if self.distributed:
            return self._distributed_gram(v)
        out = self.diagonal[:, None] * v
        for a, b, x, _ in self.edges:
            for c in range(v.shape[1]):
                out[:, c] += np.bincount(a, x * v[b, c], self.total) + np.bincount(b, x * v[a, c], self.total)
        return out

    def dense(self) -> np.ndarray:
        if self.distributed:
            return np.concatenate([self.gram(np.eye(self.total)[:, k : k + 64]) for k in range(0, self.total, 64)], 1)
        out = np.diag(self.diagonal)
        for a, b, x, _ in self.edges:
            np.add.at(out, (a, b), x)
            np.add.at(out, (b, a), x)
        return out

    def solve(self, rhs: np.ndarray, init: np.ndarray | None = None) -> np.ndarray:
        """A solution of gram x = rhs; from a zero start the one of smallest norm, where CG is used plainly."""
        if not self.total or not rhs.shape[1]:
            return np.zeros((self.total, rhs.shape[1]))
        if len(self.terms) == 1:
            return rhs / np.where(self.diagonal > 0, self.diagonal, np.inf)[:, None]
        if self.total <= DENSE and init is None and not self.distributed:
            return pinv(self.dense())[0] @ rhs
        return cgsolve(self.gram, rhs, self.eps, init, self.diagonal)

    @cached_property
    def _cells(self) -> DataFrame:
        """Distinct combinations of levels, named by their places in a level vector, with slopes and summed weights."""
        df, terms = self.frame.df, self.terms
        cells = df.select(*[F.col(t.key) for t in terms], F.col("_w"), *[_slope(t).alias(f"_v{i}") for i, t in enumerate(terms)])
        cells = cells.groupBy(*[t.key for t in terms], *[f"_v{i}" for i in range(len(terms))]).agg(F.sum("_w").alias("_w"))
        for i, t in enumerate(terms):
            part = df.sparkSession.createDataFrame(pd.DataFrame({f"_l{i}": self.levels[i]["level"], f"_at{i}": np.arange(self.first[i], self.first[i + 1])}))
            cells = cells.join(F.broadcast(part) if len(self.levels[i]) <= BROADCAST else part, F.col(t.key) == F.col(f"_l{i}"))
        return written(cells.select("_w", *[c for i in range(len(terms)) for c in (f"_at{i}", f"_v{i}")]), "cells")

    def _distributed_gram(self, v: np.ndarray) -> np.ndarray:
        """The product with vectors as tables: cells are joined to them once for each term, and summed by level in one aggregation."""
        spark, k, x = self.frame.df.sparkSession, v.shape[1], self._cells
        for i in range(len(self.terms)):
            part = pd.DataFrame(v[self.first[i] : self.first[i + 1]], columns=[f"p{i}_{c}" for c in range(k)])
            part.insert(0, f"_of{i}", np.arange(self.first[i], self.first[i + 1]))
            part = spark.createDataFrame(part)
            x = x.join(F.broadcast(part) if len(part.columns) * len(self.levels[i]) <= BROADCAST else part, F.col(f"_at{i}") == F.col(f"_of{i}"))
        n = range(len(self.terms))
        total = [F.col("_w") * sum((F.col(f"_v{i}") * F.col(f"p{i}_{c}") for i in n), F.lit(0.0)) for c in range(k)]
        x = x.select(*[c for i in n for c in (f"_at{i}", f"_v{i}")], *[t.alias(f"u{c}") for c, t in enumerate(total)])
        each = F.array(*[F.struct(F.col(f"_at{i}").alias("at"), *[(F.col(f"_v{i}") * F.col(f"u{c}")).alias(f"u{c}") for c in range(k)]) for i in n])
        got = x.select(F.explode(each).alias("e")).groupBy("e.at").agg(*[F.sum(f"e.u{c}").alias(f"u{c}") for c in range(k)]).toPandas()
        out = np.zeros((self.total, k))
        out[got["at"].to_numpy()] = got[[f"u{c}" for c in range(k)]].to_numpy(float)
        return out

    @property
    def g(self) -> np.ndarray:
        """Level coefficients of each (shifted) column."""
        if self._g is None:
            self._g = self.solve(np.concatenate(self.sums) if self.terms else np.zeros((0, len(self.columns))))
        return self._g

    def moments(self) -> np.ndarray:
        """Cross products of the columns after absorption."""
        if self._pair:
            return self.raw - self._pair.explained(self.eps)
        return self.raw - (np.concatenate(self.sums).T @ self.g if self.terms else 0)

    def residuals(self, extra: list[str] | None = None) -> DataFrame:
        """The frame with each column replaced by what absorption leaves of it."""
        spark, df = self.frame.df.sparkSession, self.frame.df
        value = {c: F.col(c) - F.lit(float(m)) for c, m in zip(self.columns, self.shift, strict=True)}
        for i, t in enumerate(self.terms):
            part = pd.DataFrame(self.g[self.first[i] : self.first[i + 1]], columns=[f"_g{i}_{c}" for c in range(len(self.columns))])
            part.insert(0, f"_l{i}", self.levels[i]["level"])
            part = spark.createDataFrame(part)
            df = df.join(F.broadcast(part) if len(self.levels[i]) <= BROADCAST else part, F.col(t.key) == F.col(f"_l{i}"))
            for c, name in enumerate(self.columns):
                value[name] = value[name] - _slope(t) * F.col(f"_g{i}_{c}")
        keep = [c for c in self.frame.df.columns if c not in self.columns]
        return df.select(*keep, *[v.alias(c) for c, v in value.items()])

    # ------------------------------------------------------------------ identification

    def pure(self) -> list[int]:
        return [i for i, t in enumerate(self.terms) if t.pure]

    def components(self) -> np.ndarray | None:
        """The component, from 1 by falling number of rows, of each level of the first two pure terms; None for fewer terms."""
        pure = self.pure()[:2]
        if len(pure) < 2:
            return None
        n = self.total
        if self.distributed:
            a, b = (self.terms[i] for i in pure)
            e = self.frame.df.select(F.concat(F.lit("a"), F.col(a.key).cast("string")).alias("a"), F.concat(F.lit("b"), F.col(b.key).cast("string")).alias("b")).distinct()
            found = connected_components(e).toPandas().set_index("node")["component"]
            label = np.full(n, -1, np.int64)
            codes = pd.factorize(found)[0]
            for i, tag in zip(pure, "ab", strict=True):
                label[self.first[i] : self.first[i + 1]] = codes[found.index.get_indexer(tag + self.levels[i]["level"].astype(str))]
        else:
            at = list(combinations(range(len(self.terms)), 2)).index(tuple(pure))
            a, b = self.edges[at][:2]
            label = np.arange(n)
            while True:
                low = label.copy()
                np.minimum.at(low, a, label[b])
                np.minimum.at(low, b, label[a])
                low = low[low]
                if (low == label).all():
                    break
                label = low
        one = pure[0]
        own = label[self.first[one] : self.first[one + 1]]
        names, inverse = np.unique(own, return_inverse=True)
        rows = np.bincount(inverse, self.levels[one]["obs"])
        rank = dict(zip(names[np.lexsort((names, -rows))].tolist(), range(1, len(names) + 1), strict=True))
        out = np.zeros(n, np.int64)
        for i in pure:
            for k in range(self.first[i], self.first[i + 1]):
                out[k] = rank[int(label[k])]
        return out

    def references(self, exact: bool = False) -> int:
        """Redundant levels: none for one pure term, the components for two, and one more for each further term (or the exact rank deficiency)."""
        pure = self.pure()
        if exact and self.total and (len(pure) > 2 or len(pure) < len(self.terms)):
            if self.total <= EXACT and not self.distributed:
                return self.total - pinv(self.dense() / np.sqrt(np.outer(self.diagonal, self.diagonal)))[1]
            return self._deficiency()
        if len(pure) < 2:
            return 0
        if self._pair:
            return self._pair.components
        return int(self.components().max()) + len(pure) - 2

    def _deficiency(self) -> int:
        """The dimension of the dummies' null space, by products alone.

        z - x with gram x = gram z is a random element of the null space. The known ones (a component's levels of the
        first two pure terms against each other, and each further pure term against the first) are projected out, and
        vectors are drawn until their rank stays below their number.
        """
        pure = self.pure()
        label = np.zeros(self.total, np.int64)
        sign = np.zeros(self.total)
        further = np.zeros((self.total, 0))
        if len(pure) > 1:
            label = self.components()
            for i, s in zip(pure[:2], (1.0, -1.0), strict=True):
                sign[self.first[i] : self.first[i + 1]] = s
            further = np.zeros((self.total, len(pure) - 2))
            for j, i in enumerate(pure[2:]):
                further[self.first[pure[0]] : self.first[pure[0] + 1], j] = 1
                further[self.first[i] : self.first[i + 1], j] = -1
        size = np.bincount(label, sign * sign)

        def apart(v: np.ndarray) -> np.ndarray:
            share = np.stack([np.bincount(label, sign * v[:, c], len(size)) for c in range(v.shape[1])], 1) / np.maximum(size, 1)[:, None]
            return v - sign[:, None] * share[label]

        known = int(label.max()) + further.shape[1]
        basis = np.linalg.qr(apart(further))[0] if further.shape[1] else further
        rng, many = np.random.default_rng(3), 4
        while True:
            z = rng.normal(size=(self.total, many))
            z = apart(z - cgsolve(self.gram, self.gram(z), 1e-12, None, self.diagonal))
            z -= basis @ (basis.T @ z)
            rank = int((np.linalg.svd(z, compute_uv=False) > 1e-3).sum())
            if rank < many:
                return known + rank
            many *= 2

def demean(df: DataFrame, columns: list[str], factors: list[str], weights: str | None = None, means: bool = False, na_rm: bool = False) -> DataFrame:
    """df with `columns` replaced by their residuals on all factors jointly (or, with means, by what was taken off).

    Slopes are written "x:f". Rows with a null in a column or key are dropped. A NaN spoils its column: within its
    group if there is one factor, everywhere if there are more (they connect groups); na_rm drops such rows instead.
    """
    if not factors:
        return df.select(*[F.lit(0.0).alias(c) if means and c in columns else F.col(f"`{c}`") for c in df.columns])
    if na_rm:
        df = df.na.drop(subset=columns)
    nan = {c: F.isnan(F.col(f"`{c}`").cast("double")) for c in columns}
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    work = df.select("*", row.alias("_row"), *[F.when(nan[c], 0.0).otherwise(F.col(f"`{c}`").cast("double")).alias(f"_val{k}") for k, c in enumerate(columns)])
    frame = build(work, Model([f"_val{k}" for k in range(len(columns))], [], factors, intercept=False), weights, carry="_row")
    names = frame.cols("y")
    old = {c: F.col("_row").getField(c).cast("double") for c in columns}
    out = Absorbed(frame, names).residuals()
    spoilt = {}
    for k, c in enumerate(columns):
        if len(frame.terms) == 1:  # only groups with a NaN are looked up
            key = frame.terms[0].key
            bad = frame.df.where(F.isnan(old[c])).select(F.col(key).alias(f"_nan{k}")).distinct()
            bad = written(bad, "nan-groups")
            out = out.join(F.broadcast(bad) if bad.count() <= BROADCAST else bad, F.col(key) == F.col(f"_nan{k}"), "left")
            spoilt[c] = F.col(f"_nan{k}").isNotNull()
        else:
            spoilt[c] = F.lit(bool(df.where(nan[c]).limit(1).count()))
    value = lambda c: F.when(spoilt[c], F.lit(float("nan"))).otherwise(old[c] - F.col(names[columns.index(c)]) if means else F.col(names[columns.index(c)]))
    return out.select(*[value(c).alias(c) if c in columns else F.col("_row").getField(c).alias(c) for c in df.columns])

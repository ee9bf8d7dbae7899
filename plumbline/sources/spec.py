"""Runs an estimation described by a text of directives, one a line, # beginning a comment.

file, vars, dummy, model, iv, cluster, robust, exactdf, se [replicates], nofe, test, wald, ivftest, savecomp, merge,
fecorr, subset (a condition, a share of rows, or a quantile cut `x <- quantile(x, p)`), tol, usecg. The outputs
are returned, and written below `out` if that is given: coef, fe-<factor>, comp, fe-merged.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import effects
from plumbline.operators.estimate import felm, quantiles
from plumbline.plans.formula import parse, split
from plumbline.plans.frame import chainsubset

from .tables import read_table, write_table

KNOWN = "file vars dummy model iv cluster robust exactdf se nofe test wald ivftest savecomp merge fecorr subset tol usecg out randkac analyze accel complim splitcomp itsbig".split()


def directives(text: str) -> list[tuple[str, str]]:
    out = []
    for line in text.splitlines():
        line = line.split("#", 1)[0].strip()
        if line:
            word, _, rest = line.partition(" ")
            if word not in KNOWN:
                raise ValueError(f"unknown directive {word}")
            out.append((word, rest.strip()))
    return out


def subset(df: DataFrame, rule: str, seed: int = 1) -> DataFrame:
    """A condition with mean() and the like over the rows that are left, a share, or a cut at a quantile."""
    if re.fullmatch(r"[0-9.]+", rule):
        return df.sample(float(rule), seed)
    if m := re.fullmatch(r"(\w+)\s*<-\s*quantile\((\w+)\s*,\s*([0-9.]+)\)", rule):
        at = quantiles(df, F.col(m[2]), [float(m[3])])[0]
        return df.where(F.col(m[1]) < at)
    rule = re.sub(r"\b(mean|median|min|max|sd)\(([^()]*)\)", lambda m: "{" + {"mean": "avg", "sd": "stddev"}.get(m[1], m[1]) + f"({m[2]})" + "}", rule)
    return chainsubset(df, rule.replace("&", " AND ").replace(" | ", " OR "))


def run_spec(text: str, data: DataFrame | None = None, spark: SparkSession | None = None, out: str | None = None) -> dict:
    """fit, coef, and as asked for: effects (by factor), comp, merged, bias, tests."""
    lines = directives(text)
    one = {k: v for k, v in lines}
    every = lambda k: [v for w, v in lines if w == k]
    clusters = [x for v in every("cluster") for x in v.split()]
    dummies = [x for v in every("dummy") for x in v.split()]
    if data is None:
        shape = parse(one["model"])
        data = read_table(spark or SparkSession.getActiveSession(), one["file"], one.get("vars", "").split() or None, [*shape.factors, *dummies, *clusters])
    for rule in every("subset"):
        data = subset(data, rule)
    model = one["model"]
    head, *rest = [p for _, p in split(model.split("~", 1)[1], "|")]
    terms = [f"factor({t})" if t.strip() in dummies else t for _, t in split(head, "+")]
    iv = " | ".join(v.split("~")[0].strip() for v in every("iv"))
    instruments = " + ".join(dict.fromkeys(t.strip() for v in every("iv") for t in v.split("~")[1].split("+")))
    formula = f"{model.split('~', 1)[0]} ~ {' + '.join(terms)} | {rest[0] if rest else '0'} | {f'({iv} ~ {instruments})' if iv else '0'} | {' + '.join(clusters) or '0'}"
    fit = felm(formula, data, exact_dof="exactdf" in one, eps=float(one["tol"]) if one.get("tol") else None)
    kind = "cluster" if clusters else "robust" if "robust" in one else "iid"
    result: dict = {"fit": fit, "coef": fit.table(kind, fit.lhs[0]), "tests": []}
    for v in every("test"):
        result["tests"].append((v, fit.waldtest(v.split(), kind=kind, lhs=fit.lhs[0])))
    for v in every("wald"):
        result["tests"].append((v, fit.waldtest("~ " + v, kind=kind, lhs=fit.lhs[0])))
    if "ivftest" in one and fit.stage1 is not None:
        result["tests"].append(("ivftest", fit.condfstat(kind, fit.lhs[0])))
    factors = [t.name for t in fit.absorbed.terms]
    if factors and "nofe" not in one:
        fe = effects.getfe(fit, se="se" in one, bn=int(one.get("se") or 100), lhs=fit.lhs[0])
        result["effects"] = {f: fe.where(F.col("fe") == f).drop("fe").withColumnRenamed("idx", f) for f in factors}
        if "merge" in one:
            merged = data
            for f in factors:
                if ":" not in f:
                    merged = effects.merge_effects(merged, fe, f, f, f"{f}_effect")
            result["merged"] = merged
        if "fecorr" in one:
            result["bias"] = effects.fevcov(fit, fit.lhs[0])
    if "savecomp" in one:
        result["comp"] = effects.compfactor(data, factors)
    if out:
        write_table(result["coef"], f"{out}/coef.csv")
        for f, x in result.get("effects", {}).items():
            write_table(x, f"{out}/fe-{f}.csv")
        for name in ("merged", "comp"):
            if name in result:
                write_table(result[name], f"{out}/{'fe-merged' if name == 'merged' else name}.csv")
    return result

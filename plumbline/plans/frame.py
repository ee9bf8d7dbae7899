"""From a formula and a DataFrame to the columns of one joint model frame."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .formula import Model, split

#: Levels that a categorical covariate of part 1 may have; group effects belong into part 2.
DUMMIES = 1000


@dataclass
class Term:
    """An absorbed term: a level key, and a slope column if it is not a pure factor."""

    name: str
    key: str
    slope: str | None = None

    @property
    def pure(self) -> bool:
        return self.slope is None


@dataclass
class Frame:
    df: DataFrame
    model: Model
    terms: list[Term] = field(default_factory=list)
    #: role ("y", "x", "q", "z", "d", "c") -> [(name, column)]
    columns: dict[str, list[tuple[str, str]]] = field(default_factory=dict)
    weighted: bool = False

    def names(self, role: str) -> list[str]:
        return [n for n, _ in self.columns[role]]

    def cols(self, *roles: str) -> list[str]:
        return [c for r in roles for _, c in self.columns[r]]


def expression(text: str) -> Column:
    """An expression of a formula: I() and powers are understood, the rest is Spark SQL."""
    text = text.strip()
    if re.fullmatch(r"[A-Za-z_.]\w*", text):
        return F.col(f"`{text}`")
    text = re.sub(r"\bI\(", "(", text)
    text = re.sub(r"(\w+|\([^()]*\))\s*\^\s*(\w+)", r"power(\1, \2)", text)
    return F.expr(text.replace("log(", "ln("))


def is_factor(df: DataFrame, text: str) -> bool:
    if re.fullmatch(r"(as\.)?factor\(.*\)", text.strip()):
        return True
    name = text.strip("` ")
    return name in df.columns and isinstance(df.schema[name].dataType, T.StringType | T.BooleanType | T.DateType)


def bare(text: str) -> Column:
    m = re.fullmatch(r"(?:as\.)?factor\((.*)\)", text.strip())
    return expression(m[1] if m else text)


def chainsubset(df: DataFrame, *conditions: str | Column) -> DataFrame:
    """Filters one after another; an aggregate in a condition, written {avg(x)}, sees the rows that the earlier ones left."""
    for c in conditions:
        if isinstance(c, str) and (found := re.findall(r"\{([^{}]+)\}", c)):
            row = df.agg(*[F.expr(e).alias(f"v{k}") for k, e in enumerate(found)]).first()
            for k, e in enumerate(found):
                c = c.replace("{" + e + "}", "NULL" if row[f"v{k}"] is None else repr(row[f"v{k}"]))
        df = df.where(c)
    return df


def _numeric(df: DataFrame, text: str, contrasts: dict) -> list[tuple[str, Column]]:
    """The columns of a term of part 1: treatment contrasts for factors, products for interactions."""
    out = [("", None)]
    for _, part in split(text, ":"):
        if is_factor(df, part):
            found = [r[0] for r in df.select(bare(part)).distinct().na.drop().limit(DUMMIES + 1).collect()]
            if len(found) > DUMMIES:
                raise ValueError(f"{part} has more than {DUMMIES} levels; absorb it in the second part")
            found.sort()
            base = contrasts.get(part, found[0] if found else None)
            each = [(f"{part}{v}", F.when(bare(part) == F.lit(v), 1.0).otherwise(0.0)) for v in found if v != base]
        else:
            name = part.strip("`")
            if name in df.columns and isinstance(df.schema[name].dataType, T.ArrayType):
                n = df.agg(F.max(F.size(name))).first()[0] or 0
                each = [(f"{part}.{k + 1}", F.get(name, F.lit(k)).cast("double")) for k in range(n)]
            else:
                each = [(part, expression(part).cast("double"))]
        out = [(f"{a}:{n}" if a else n, x if c is None else c * x) for a, c in out for n, x in each]
    return out


def _level(c: Column) -> Column:
    return c.cast("string")


def build(df: DataFrame, model: Model, weights: str | None = None, subset: str | Column | None = None, contrasts: dict | None = None, carry: str | None = None) -> Frame:
    """One row for each row of df without nulls or NaN in any variable of the model; `carry` rides along as it is."""
    if subset is not None:
        df = df.where(subset)
    roles = {"y": model.lhs, "x": model.covariates, "q": model.endogenous, "z": model.instruments, "d": model.controls}
    picked: list[Column] = []
    columns: dict[str, list[tuple[str, str]]] = {}
    for role, texts in roles.items():
        columns[role] = []
        for t in texts:
            for name, c in _numeric(df, t, contrasts or {}):
                col = f"_{role}{len(columns[role])}"
                columns[role].append((name, col))
                picked.append(c.alias(col))
    terms: list[Term] = []
    alone = {t for t in model.factors if ":" not in t}
    for t in model.factors:
        parts = [p for _, p in split(t, ":")]
        slopes = [p for p in parts if len(parts) > 1 and not is_factor(df, p)]
        if len(slopes) > 1:
            raise ValueError(f"{t}: an interaction has one covariate at most")
        groups = [p for p in parts if p not in slopes]
        if not slopes and len(groups) > 1 and any(g in alone for g in groups):
            # main effects are there too: their first levels make the interaction redundant and become one level
            first = {g: df.agg(F.min(bare(g))).first()[0] for g in groups if g in alone}
            at_first = F.lit(False)
            for g, v in first.items():
                at_first = at_first | (bare(g) == F.lit(v))
            level = F.when(at_first, F.lit("(reference)")).otherwise(F.concat_ws(".", *[_level(bare(g)) for g in groups]))
            level = F.when(F.greatest(*[F.isnull(bare(g)).cast("int") for g in groups], F.lit(0)) == 0, level)
        elif len(groups) > 1:
            level = F.concat(*[x for g in groups for x in (_level(bare(g)), F.lit("."))][:-1])
        else:
            level = bare(groups[0])
        for name, c in (_numeric(df, slopes[0], {}) if slopes else [(None, None)]):
            key = f"_f{len(terms)}"
            picked.append(level.alias(key))
            if name is None:
                terms.append(Term(":".join(groups), key))
            else:
                picked.append(c.alias(f"_s{len(terms)}"))
                terms.append(Term(f"{name}:{':'.join(groups)}", key, f"_s{len(terms)}"))
    if model.intercept is None:
        model = replace(model, intercept=not any(t.pure for t in terms))
    if model.intercept:
        columns["x"].insert(0, ("(Intercept)", "_one"))
        picked.append(F.lit(1.0).alias("_one"))
    columns["c"] = []
    for t in model.clusters:
        columns["c"].append((t, f"_c{len(columns['c'])}"))
        picked.append(F.concat_ws(":", *[_level(bare(p)) for _, p in split(t, ":")]).alias(columns["c"][-1][1]) if ":" in t else bare(t).alias(columns["c"][-1][1]))
    weight = F.col(weights).cast("double") if weights else F.lit(1.0)
    out = df.select(*picked, weight.alias("_w"), *([F.col(carry)] if carry else []))
    out = out.na.drop(subset=[c for c in out.columns if c != carry])
    if weights:
        bad = df.agg(F.count(F.when((F.col(weights) < 0) | F.col(weights).isNull() | F.isnan(F.col(weights).cast("double")), 1))).first()[0]
        if bad:
            raise ValueError("weights must be non-negative and not missing")
        out = out.withColumn("_w", F.when(F.col("_w") == 0, 1e-120).otherwise(F.col("_w")))
    return Frame(out, model, terms, columns, weights is not None)

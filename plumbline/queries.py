"""The engine's queries over the driver's tables, and the same in DuckDB's SQL.

Floats are rounded after scaling, counts cast to bigint, so that both sides agree in type and value. SQL absorbs two
factors by unrolled sweeps of alternating projections, which converge quickly on these well-connected tables.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.linalg import cgsolve, mctrace
from plumbline.operators import effects
from plumbline.operators.absorb import Absorbed, demean
from plumbline.operators.estimate import Fit, felm
from plumbline.plans.formula import Model
from plumbline.plans.frame import build, chainsubset


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem with covariates on one scale: y depends on quantity, discount, the part and the supplier."""
    x = table(spark, sf_dir, "lineitem")
    return x.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus",
        (F.col("l_extendedprice") / 1000).alias("price"), F.col("l_quantity").alias("qty"), (100 * F.col("l_discount")).alias("disc"), (100 * F.col("l_tax")).alias("tax"),
        (F.col("l_extendedprice") / 1000 + 0.5 * F.col("l_quantity") - 30 * F.col("l_discount") + 0.01 * F.pmod("l_partkey", F.lit(97)) + 0.02 * F.pmod("l_suppkey", F.lit(13))).alias("y"),
        (1 + F.pmod("l_orderkey", F.lit(3))).cast("double").alias("w"),
        (0.6 * F.col("l_quantity") + 50 * F.col("l_tax") + F.pmod("l_orderkey", F.lit(7))).alias("q"),
    )


L = """l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, l_extendedprice / 1000 AS price, l_quantity AS qty,
  100 * l_discount AS disc, 100 * l_tax AS tax,
  l_extendedprice / 1000 + 0.5 * l_quantity - 30 * l_discount + 0.01 * (l_partkey % 97) + 0.02 * (l_suppkey % 13) AS y,
  CAST(1 + l_orderkey % 3 AS DOUBLE) AS w, 0.6 * l_quantity + 50 * l_tax + l_orderkey % 7 AS q FROM lineitem)"""


def sweeps(names: list[str], keys: list[str], rounds: int, weight: str = "1") -> str:
    """CTEs s1, s2, ...: the columns less their group means by each key in turn. The last is called c."""
    out, last, k = [], "l", 0
    for r in range(rounds):
        for key in keys:
            k += 1
            name = "c" if r == rounds - 1 and key == keys[-1] else f"s{k}"
            cols = ", ".join(f"{n} - sum({weight} * {n}) OVER (PARTITION BY {key}) / sum({weight}) OVER (PARTITION BY {key}) AS {n}" for n in names)
            out.append(f"{name} AS MATERIALIZED (SELECT * REPLACE ({cols}) FROM {last})")
            last = name
    return ", ".join(out)


def r6(c, digits: int = 6):
    return F.round(c, digits) + F.lit(0.0)


def coefs(fit: Fit, kind: str = "iid", digits: int = 6, lhs: str | None = None) -> DataFrame:
    x = fit.table(kind, lhs)
    return x.select("term", r6(F.col("estimate"), digits).alias("estimate"), r6(F.col("std_error"), digits).alias("std_error"), r6(F.col("t_value"), 2).alias("t_value"))


def values(spark: SparkSession, rows: dict[str, float], digits: int = 6) -> DataFrame:
    return spark.createDataFrame([(k, float(v)) for k, v in rows.items()], "name string, value double").select("name", r6(F.col("value"), digits).alias("value"))


# ---------------------------------------------------------------------- queries


def q_ols_one_factor(spark, sf):
    return coefs(felm("price ~ qty + disc | l_suppkey", lines(spark, sf), robust=False))


def q_ols_robust(spark, sf):
    return coefs(felm("price ~ qty + disc | l_suppkey", lines(spark, sf)), "robust")


def q_ols_cluster(spark, sf):
    return coefs(felm("price ~ qty + disc | l_partkey | 0 | l_suppkey", lines(spark, sf), robust=False), "cluster")


def q_ols_two_way_cluster(spark, sf):
    return coefs(felm("price ~ qty | l_returnflag | 0 | l_suppkey + l_linenumber", lines(spark, sf), robust=False), "cluster")


def q_ols_cgm2(spark, sf):
    return coefs(felm("price ~ qty | l_returnflag | 0 | l_suppkey + l_linenumber", lines(spark, sf), robust=False, cmethod="cgm2"), "cluster")


def q_ols_nested_cluster(spark, sf):
    return coefs(felm("price ~ qty + disc | l_suppkey | 0 | l_suppkey", lines(spark, sf), robust=False), "cluster")


def q_ols_two_factors(spark, sf):
    return coefs(felm("y ~ qty + disc | l_partkey + l_suppkey", lines(spark, sf), robust=False))


def q_wls_two_factors(spark, sf):
    return coefs(felm("y ~ qty + disc | l_partkey + l_suppkey", lines(spark, sf), weights="w", robust=False))


def q_ols_no_factor(spark, sf):
    return coefs(felm("price ~ qty", lines(spark, sf), robust=False))


def q_ols_factor_covariate(spark, sf):
    return coefs(felm("y ~ l_returnflag", lines(spark, sf), robust=False))


def q_ols_slopes(spark, sf):
    return coefs(felm("y ~ disc - 1 | qty:factor(l_suppkey)", lines(spark, sf), robust=False))


def q_ols_many_responses(spark, sf):
    fit = felm("price | y ~ qty + disc | l_suppkey", lines(spark, sf), robust=False)
    return coefs(fit, lhs="price").withColumn("lhs", F.lit("price")).unionByName(coefs(fit, lhs="y").withColumn("lhs", F.lit("y")))


def q_ols_nulls(spark, sf):
    x = lines(spark, sf).withColumn("qty", F.when(F.col("l_orderkey") % 17 != 0, F.col("qty")))
    return coefs(felm("price ~ qty + disc | l_suppkey", x, robust=False))


def q_ols_subset(spark, sf):
    x = chainsubset(lines(spark, sf), "l_returnflag = 'R'", "qty > {avg(qty)}", "price > {avg(price)}")
    return coefs(felm("price ~ qty + disc | l_suppkey", x, robust=False))


def q_ols_controls(spark, sf):
    return coefs(felm("price ~ qty | l_suppkey | 0 | 0 | disc", lines(spark, sf), robust=False))


def q_ols_expression(spark, sf):
    return coefs(felm("log(price) ~ sqrt(qty) + I(disc^2) | l_suppkey", lines(spark, sf), robust=False))


def q_ols_collinear(spark, sf):
    x = lines(spark, sf).withColumn("cst", F.col("l_suppkey") * 2.0)
    t = felm("price ~ qty + cst | l_suppkey", x, robust=False).table("iid")
    return t.select("term", F.isnan("estimate").alias("dropped"))


def q_iv_just_identified(spark, sf):
    return coefs(felm("y ~ 0 | l_suppkey | (q ~ tax)", lines(spark, sf), robust=False))


def q_iv_first_stage(spark, sf):
    fit = felm("y ~ 0 | l_suppkey | (q ~ tax)", lines(spark, sf), robust=False)
    w = fit.stage1.waldtest(["tax"], kind="iid")
    return values(spark, {"F": w["F"], "condF": fit.condfstat("iid")["q"]}, 3)


def q_iv_overidentified(spark, sf):
    fit = felm("y ~ 0 | l_suppkey | (q ~ tax + disc)", lines(spark, sf), robust=False)
    return values(spark, {"q": fit.coef()["`q(fit)`"], "sargan": fit.sargan()["sargan"]}, 4)


def q_iv_liml(spark, sf):
    fit = felm("y ~ qty | l_suppkey | (q ~ tax + disc)", lines(spark, sf), robust=False, kclass="liml")
    return values(spark, {"kappa": fit.kappa, **fit.coef()}, 5)


def q_summary(spark, sf):
    s = felm("price ~ qty + disc | l_suppkey", lines(spark, sf), robust=False).summary()
    return values(spark, {"r2": s["r2"], "adj_r2": s["adj_r2"], "projected_r2": s["projected_r2"], "F": s["F"], "projected_F": s["projected_F"]["F"], "sigma": s["sigma"]}, 5)


def q_residual_quantiles(spark, sf):
    s = felm("price ~ qty | l_suppkey", lines(spark, sf), robust=False).summary()
    return values(spark, dict(zip(["Min", "1Q", "Median", "3Q", "Max"], s["residuals"], strict=True)), 4)


def q_wald(spark, sf):
    fit = felm("price ~ qty + disc | l_suppkey", lines(spark, sf), robust=False)
    w = fit.waldtest("~ qty - 0.01 | disc + qty")
    return values(spark, {"chi2": w["chi2"], "F": w["F"]}, 3)


def q_confint(spark, sf):
    c = felm("price ~ qty + disc | l_suppkey", lines(spark, sf), robust=False).confint()
    return spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in c.items()], "term string, low double, high double").select("term", r6(F.col("low")).alias("low"), r6(F.col("high")).alias("high"))


def q_nlexpect(spark, sf):
    fit = felm("price ~ qty + disc | l_suppkey", lines(spark, sf), robust=False)
    return values(spark, {"square": fit.nlexpect(lambda b: b["qty"] ** 2, ["qty"], tol=1e-6)}, 8)


def q_loglik(spark, sf):
    return values(spark, {"loglik": felm("price ~ qty | l_suppkey", lines(spark, sf), robust=False).loglik()}, 3)


def q_update(spark, sf):
    fit = felm("price ~ qty + disc | l_suppkey", lines(spark, sf), robust=False)
    return coefs(fit.update(". ~ . - disc"))


def q_demean_one(spark, sf):
    x = demean(lines(spark, sf).select("l_orderkey", "l_linenumber", "l_suppkey", "price"), ["price"], ["l_suppkey"])
    return x.select("l_orderkey", "l_linenumber", r6(F.col("price"), 7).alias("price"))


def q_demean_two(spark, sf):
    x = demean(lines(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "qty"), ["qty"], ["l_partkey", "l_suppkey"])
    return x.select("l_orderkey", "l_linenumber", r6(F.col("qty"), 5).alias("qty"))


def q_demean_means(spark, sf):
    x = demean(lines(spark, sf).select("l_orderkey", "l_linenumber", "l_suppkey", "qty", "w"), ["qty"], ["l_suppkey"], weights="w", means=True)
    return x.select("l_orderkey", "l_linenumber", r6(F.col("qty")).alias("qty"))


def q_demean_slope(spark, sf):
    x = demean(lines(spark, sf).select("l_orderkey", "l_linenumber", "l_suppkey", "qty", "disc"), ["qty"], ["disc:factor(l_suppkey)"])
    return x.select("l_orderkey", "l_linenumber", r6(F.col("qty")).alias("qty"))


def q_model_matrix(spark, sf):
    x = felm("price ~ qty | l_suppkey", lines(spark, sf), robust=False).model_matrix()
    return x.agg(F.count("*").alias("n"), r6(F.sum(F.col("qty") * F.col("qty")), 2).alias("ss"))


def q_components(spark, sf):
    x = effects.compfactor(lines(spark, sf), ["l_partkey", "l_orderkey"])
    return x.agg(F.countDistinct("comp").alias("components"), F.max(F.when(F.col("comp") == 1, 1)).cast("bigint").alias("first"))


def q_component_sizes(spark, sf):
    x = effects.compfactor(lines(spark, sf).withColumn("block", F.expr("l_orderkey div 40")), ["l_orderkey", "block"])
    return x.groupBy("comp").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("components"))


def q_weeks_williams(spark, sf):
    x = effects.compfactor(lines(spark, sf), ["l_suppkey", "l_linenumber", "l_linestatus"], ww=True)
    return x.agg(F.countDistinct("comp").alias("components"))


def q_degrees_of_freedom(spark, sf):
    one = felm("price ~ qty | l_partkey + l_orderkey", lines(spark, sf), robust=False, nostats=True)
    return values(spark, {"refs": one.refs, "df": one.df, "exact_df": one.exact_df()}, 0)


def q_projection_trace(spark, sf):
    x = lines(spark, sf)
    return values(spark, {"one": effects.projection_trace(x, ["l_suppkey"]), "two": effects.projection_trace(x, ["l_suppkey", "l_linenumber"])}, 0)


def q_effects_one_factor(spark, sf):
    x = effects.getfe(felm("price ~ qty | l_suppkey", lines(spark, sf), robust=False), se=True)
    return x.select("fe", "idx", "obs", r6(F.col("effect"), 5).alias("effect"), r6(F.col("se"), 5).alias("se"))


def q_effects_two_factors(spark, sf):
    x = effects.getfe(felm("y ~ qty | l_suppkey + l_linenumber", lines(spark, sf), robust=False), "zm2")
    return x.where("fe != 'icpt'").select("fe", "idx", r6(F.col("effect"), 4).alias("effect"))


def q_effects_merged(spark, sf):
    x, fit = lines(spark, sf), felm("y ~ qty | l_suppkey + l_linenumber", lines(spark, sf), robust=False)
    fe = effects.getfe(fit)
    x = effects.merge_effects(effects.merge_effects(x, fe, "l_suppkey", "l_suppkey", "a"), fe, "l_linenumber", "l_linenumber", "p")
    return coefs(felm("y ~ qty + a + p - 1", x, robust=False)).select("term", r6(F.col("estimate"), 5).alias("estimate"))


def q_estimable(spark, sf):
    fit = felm("y ~ qty | l_suppkey + l_linenumber", lines(spark, sf), robust=False, nostats=True)
    return spark.createDataFrame([(k, effects.is_estimable(fit, effects.Estimable(fit.absorbed, k))) for k in ("ref", "zm", "zm2", "ln")], "name string, estimable boolean")


def q_dmatrix(spark, sf):
    x = lines(spark, sf).withColumn("row", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    d = effects.make_dmatrix(x, ["l_suppkey", "qty:factor(l_linestatus)"], "row")
    return d.groupBy("level").agg(F.count("*").alias("n"), r6(F.sum("value"), 3).alias("total"))


def q_kaczmarz(spark, sf):
    x = effects.kaczmarz(lines(spark, sf), ["l_suppkey", "l_linenumber"], "qty")
    return spark.createDataFrame(x[["fe", "idx", "effect"]]).select("fe", "idx", r6(F.col("effect"), 4).alias("effect"))


def q_bias(spark, sf):
    return values(spark, effects.bccorr(felm("y ~ qty | l_suppkey + l_linenumber", lines(spark, sf), robust=False)), 8)


def q_effect_covariance(spark, sf):
    fit = felm("y ~ qty | l_suppkey + l_linenumber", lines(spark, sf), robust=False)
    cov, bias = effects.fevcov(fit)
    v = effects.varvars(fit)
    return spark.createDataFrame(pd.DataFrame({"i": [0, 0, 1], "j": [0, 1, 1], "cov": [cov[0, 0], cov[0, 1], cov[1, 1]], "bias": [bias[0, 0], bias[0, 1], bias[1, 1]], "varvar": [v[0], np.nan, v[1]]}))


def q_effect_bootstrap(spark, sf):
    x = effects.getfe(felm("y ~ qty | l_linenumber + l_returnflag", lines(spark, sf)), se=True, bn=25)
    return x.select("fe", "idx", "effect", "se")


def q_bootstrap(spark, sf):
    b = effects.bootstrap("price ~ qty | l_linenumber", lines(spark, sf), lambda f: f.coef()["qty"], 5)
    return spark.createDataFrame([(int(k), float(v)) for k, v in enumerate(b)], "replicate long, qty double")


def q_cgsolve(spark, sf):
    a = Absorbed(build(lines(spark, sf), Model(["qty"], [], ["l_suppkey", "l_linenumber"], intercept=False)), ["_y0"], shift=False)
    x = cgsolve(a.gram, np.concatenate(a.sums), diagonal=a.diagonal)
    return values(spark, {"fitted": float((np.concatenate(a.sums) * x).sum()), "trace": mctrace(a.gram, a.total, diagonal=a.diagonal)}, 2)


def q_interaction_factor(spark, sf):
    x = lines(spark, sf)
    return coefs(felm("y ~ qty | l_returnflag:l_linestatus", x, robust=False))


def q_two_factors_robust(spark, sf):
    return coefs(felm("y ~ qty + disc | l_partkey + l_suppkey", lines(spark, sf)), "robust")


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}


# ---------------------------------------------------------------------- the same in SQL


def two(y: str, a: str, b: str, source: str = "c", w: str = "1") -> str:
    """CTEs m, e: cross products of centred columns, and Cramer's solution for two covariates."""
    return f"""m AS (SELECT sum({w}*{a}*{a}) aa, sum({w}*{a}*{b}) ab, sum({w}*{b}*{b}) bb, sum({w}*{a}*{y}) ay, sum({w}*{b}*{y}) yb, sum({w}*{y}*{y}) yy, count(*) n FROM {source}),
    e AS (SELECT *, (bb*ay - ab*yb)/(aa*bb - ab*ab) b1, (aa*yb - ab*ay)/(aa*bb - ab*ab) b2, bb/(aa*bb - ab*ab) v11, aa/(aa*bb - ab*ab) v22, -ab/(aa*bb - ab*ab) v12 FROM m),
    f AS (SELECT *, yy - b1*ay - b2*yb AS rss FROM e)"""


def tell(rows: list[tuple[str, str, str]], source: str, digits: int = 6) -> str:
    """Coefficient rows: term, estimate, standard error."""
    return " UNION ALL ".join(f"SELECT '{t}' AS term, round({b}, {digits}) + 0.0 AS estimate, round({s}, {digits}) + 0.0 AS std_error, round(({b}) / ({s}), 2) + 0.0 AS t_value FROM {source}" for t, b, s in rows)


def name_value(rows: dict[str, str], source: str, digits: int) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS name, round({v}, {digits}) + 0.0 AS value FROM {source}" for k, v in rows.items())


def absorbed(columns: list[str], keys: list[str], rounds: int = 1, where: str = "", weight: str = "1", base: str = L) -> str:
    """WITH clause up to c; g holds the degrees of freedom used by the keys of connected tables."""
    filtered = base.replace("FROM lineitem)", f"FROM lineitem {where})")
    levels = " + ".join(f"count(DISTINCT {k})" for k in keys)
    return f"WITH {filtered}, {sweeps(columns, keys, rounds, weight)}, g AS (SELECT {levels} - {len(keys) - 1} AS k FROM l)"


SIMPLE = ["price", "qty", "disc"]
IID = [("qty", "b1", "sqrt(rss/(n-2-k)*v11)"), ("disc", "b2", "sqrt(rss/(n-2-k)*v22)")]


def _cluster_one(keys: list[str], cluster: str, k: str, adjust: str) -> str:
    return f"""{absorbed(SIMPLE, keys)}, {two('price', 'qty', 'disc')},
    u AS (SELECT {cluster} AS cl, price - b1*qty - b2*disc AS u, qty, disc FROM c, f),
    s AS (SELECT cl, sum(u*qty) a, sum(u*disc) b FROM u GROUP BY cl),
    t AS (SELECT sum(a*a) aa, sum(a*b) ab, sum(b*b) bb, count(*) gg FROM s),
    z AS (SELECT b1, b2, {adjust} * gg/(gg-1.0) * (v11*v11*t.aa + 2*v11*v12*t.ab + v12*v12*t.bb) AS s1, {adjust} * gg/(gg-1.0) * (v12*v12*t.aa + 2*v12*v22*t.ab + v22*v22*t.bb) AS s2 FROM f, t, g)
    {tell([('qty', 'b1', 'sqrt(s1)'), ('disc', 'b2', 'sqrt(s2)')], 'z')}"""


def _two_way(least: bool) -> str:
    g = "(SELECT least(count(DISTINCT l_suppkey), count(DISTINCT l_linenumber)) FROM l)" if least else "count(*)"
    part = lambda by: f"(SELECT sum(s*s) * {g}/({g}-1.0) FROM (SELECT sum(u*qty) s FROM u GROUP BY {by}))"
    return f"""{absorbed(['price', 'qty'], ['l_returnflag'])}, m AS (SELECT sum(qty*qty) aa, sum(qty*price)/sum(qty*qty) b1, count(*) n FROM c),
    u AS (SELECT l_suppkey, l_linenumber, price - b1*qty AS u, qty FROM c, m),
    z AS (SELECT b1, (n-1.0)/(n-1-k) / (aa*aa) * ({part('l_suppkey')} + {part('l_linenumber')} - {part('l_suppkey, l_linenumber')}) AS v FROM m, g)
    {tell([('qty', 'b1', 'sqrt(v)')], 'z')}"""


ONE = "m AS (SELECT sum(qty*qty) aa, sum(qty*price) ay, sum(price*price) yy, count(*) n FROM c), f AS (SELECT *, ay/aa AS b1, yy - ay*ay/aa AS rss FROM m)"
SLOPE = f"WITH {L}, c AS (SELECT *, qty - disc * sum(disc*qty) OVER (PARTITION BY l_suppkey) / sum(disc*disc) OVER (PARTITION BY l_suppkey) AS r FROM l)"
#: Smallest labels passed between parts and orders; whole tables are settled after a few rounds.
LABELS = ["p0 AS (SELECT l_partkey, l_partkey AS c FROM l GROUP BY 1)"]
for _k in range(1, 13):
    LABELS.append(f"o{_k} AS MATERIALIZED (SELECT l_orderkey, min(c) AS c FROM l JOIN p{_k - 1} USING (l_partkey) GROUP BY 1)")
    LABELS.append(f"p{_k} AS MATERIALIZED (SELECT l_partkey, min(c) AS c FROM l JOIN o{_k} USING (l_orderkey) GROUP BY 1)")
NODES = f"WITH {L}, {', '.join(LABELS)}, d AS (SELECT c AS comp FROM l JOIN p12 USING (l_partkey))"
IV = f"{absorbed(['y', 'q', 'tax', 'disc'], ['l_suppkey'])}"
EFFECTS = f"""{absorbed(['y', 'qty'], ['l_suppkey', 'l_linenumber'], 6)}, m AS (SELECT sum(qty*y)/sum(qty*qty) AS b1 FROM c),
    o AS (SELECT l_suppkey, l_linenumber, l.y - b1*l.qty AS y FROM l, m)"""
GAUSS = ["e0 AS (SELECT l_linenumber, 0.0 AS p FROM o GROUP BY 1)"]
for _k in range(1, 9):
    GAUSS.append(f"a{_k} AS MATERIALIZED (SELECT l_suppkey, avg(y - p) AS a FROM o JOIN e{_k - 1} USING (l_linenumber) GROUP BY 1)")
    GAUSS.append(f"e{_k} AS MATERIALIZED (SELECT l_linenumber, avg(y - a) AS p FROM o JOIN a{_k} USING (l_suppkey) GROUP BY 1)")
GAUSS_SQL = ", ".join(GAUSS)

SQL = {
    "ols_one_factor": f"{absorbed(SIMPLE, ['l_suppkey'])}, {two('price', 'qty', 'disc')} {tell(IID, 'f, g')}",
    "ols_robust": f"""{absorbed(SIMPLE, ['l_suppkey'])}, {two('price', 'qty', 'disc')}, s AS (SELECT (price - b1*qty - b2*disc) * qty AS a, (price - b1*qty - b2*disc) * disc AS b FROM c, f),
        t AS (SELECT sum(a*a) taa, sum(a*b) tab, sum(b*b) tbb FROM s), z AS (SELECT b1, b2, n/(n-2.0-k) * (v11*v11*taa + 2*v11*v12*tab + v12*v12*tbb) s1, n/(n-2.0-k) * (v12*v12*taa + 2*v12*v22*tab + v22*v22*tbb) s2 FROM f, t, g)
        {tell([('qty', 'b1', 'sqrt(s1)'), ('disc', 'b2', 'sqrt(s2)')], 'z')}""",
    "ols_cluster": _cluster_one(["l_partkey"], "l_suppkey", "k", "(n-1.0)/(n-2-k)"),
    "ols_nested_cluster": _cluster_one(["l_suppkey"], "l_suppkey", "k", "(n-1.0)/(n-2-k) * (n-2-k)/(n-2-k+k-1)"),
    "ols_two_way_cluster": _two_way(False),
    "ols_cgm2": _two_way(True),
    "ols_two_factors": f"{absorbed(['y', 'qty', 'disc'], ['l_partkey', 'l_suppkey'], 8)}, {two('y', 'qty', 'disc')} {tell(IID, 'f, g')}",
    "wls_two_factors": f"{absorbed(['y', 'qty', 'disc'], ['l_partkey', 'l_suppkey'], 8, weight='w')}, {two('y', 'qty', 'disc', w='w')} {tell(IID, 'f, g')}",
    "ols_no_factor": f"WITH {L}, c AS (SELECT price - avg(price) OVER () AS price, qty - avg(qty) OVER () AS qty FROM l), {ONE}, h AS (SELECT avg(qty) xm, avg(price) ym FROM l) "
    + tell([("(Intercept)", "ym - b1*xm", "sqrt(rss/(n-2) * (1.0/n + xm*xm/aa))"), ("qty", "b1", "sqrt(rss/(n-2)/aa)")], "f, h"),
    "ols_factor_covariate": f"WITH {L}, h AS (SELECT l_returnflag AS v, avg(y) AS mean, count(*) AS n, sum(y*y) - count(*)*avg(y)*avg(y) AS ss FROM l GROUP BY 1), s AS (SELECT sum(ss)/(sum(n)-3) AS s2 FROM h), "
    "b AS (SELECT mean AS bm, n AS bn FROM h WHERE v = 'A') "
    + tell([("(Intercept)", "bm", "sqrt(s2/bn)")], "b, s")
    + " UNION ALL SELECT 'l_returnflag' || v, round(mean-bm, 6) + 0.0, round(sqrt(s2*(1.0/n+1.0/bn)), 6) + 0.0, round((mean-bm)/sqrt(s2*(1.0/n+1.0/bn)), 2) + 0.0 FROM h, b, s WHERE v <> 'A'",
    "ols_slopes": f"""WITH {L}, c AS (SELECT y - qty*sum(qty*y) OVER p / sum(qty*qty) OVER p AS price, disc - qty*sum(qty*disc) OVER p / sum(qty*qty) OVER p AS qty FROM l WINDOW p AS (PARTITION BY l_suppkey)), {ONE},
        g AS (SELECT count(DISTINCT l_suppkey) AS k FROM l) {tell([('disc', 'b1', 'sqrt(rss/(n-1-k)/aa)')], 'f, g')}""",
    "ols_many_responses": f"SELECT *, 'price' AS lhs FROM ({absorbed(SIMPLE, ['l_suppkey'])}, {two('price', 'qty', 'disc')} {tell(IID, 'f, g')}) UNION ALL SELECT *, 'y' AS lhs FROM ({absorbed(['y', 'qty', 'disc'], ['l_suppkey'])}, {two('y', 'qty', 'disc')} {tell(IID, 'f, g')})",
    "ols_nulls": f"{absorbed(SIMPLE, ['l_suppkey'], where='WHERE l_orderkey % 17 <> 0')}, {two('price', 'qty', 'disc')} {tell(IID, 'f, g')}",
    "ols_subset": f"""WITH {L.replace('l AS', 'l0 AS')}, l1 AS (SELECT * FROM l0 WHERE l_returnflag = 'R'), l2 AS (SELECT * FROM l1 WHERE qty > (SELECT avg(qty) FROM l1)), l AS (SELECT * FROM l2 WHERE price > (SELECT avg(price) FROM l2)),
        {sweeps(SIMPLE, ['l_suppkey'], 1)}, g AS (SELECT count(DISTINCT l_suppkey) AS k FROM l), {two('price', 'qty', 'disc')} {tell(IID, 'f, g')}""",
    "ols_controls": f"{absorbed(SIMPLE, ['l_suppkey'])}, {two('price', 'qty', 'disc')} {tell(IID[:1], 'f, g')}",
    "ols_expression": f"WITH l AS (SELECT l_suppkey, ln(l_extendedprice/1000) AS price, sqrt(l_quantity) AS qty, (100*l_discount)*(100*l_discount) AS disc FROM lineitem), {sweeps(SIMPLE, ['l_suppkey'], 1)}, g AS (SELECT count(DISTINCT l_suppkey) AS k FROM l), {two('price', 'qty', 'disc')} "
    + tell([("sqrt(qty)", *IID[0][1:]), ("I(disc^2)", *IID[1][1:])], "f, g"),
    "ols_collinear": "SELECT 'qty' AS term, false AS dropped UNION ALL SELECT 'cst', true",
    "iv_just_identified": f"{IV}, m AS (SELECT sum(tax*y)/sum(tax*q) AS b, sum(tax*q)*sum(tax*q)/sum(tax*tax) AS hh, count(*) n FROM c), r AS (SELECT sum((y-b*q)*(y-b*q)) AS rss FROM c, m) " + tell([("`q(fit)`", "b", "sqrt(rss/(n-1-k)/hh)")], "m, r, g"),
    "iv_first_stage": f"{IV}, m AS (SELECT sum(tax*q)*sum(tax*q)/sum(tax*tax) AS ess, sum(q*q) AS qq, count(*) n FROM c) " + name_value({"F": "ess/((qq-ess)/(n-1-k))", "condF": "ess/((qq-ess)/(n-1-k))"}, "m, g", 3),
    "iv_overidentified": f"{IV}, {two('q', 'tax', 'disc')}, h AS (SELECT b1*tax + b2*disc AS h, y, q, tax, disc FROM c, f), b AS (SELECT sum(h*y)/sum(h*h) AS b FROM h), u AS (SELECT y - b*q AS u, tax, disc FROM h, b), "
    + two("u", "tax", "disc", "u").replace("m AS", "m2 AS").replace("FROM m)", "FROM m2)").replace("e AS", "e2 AS").replace("FROM e)", "FROM e2)").replace("f AS", "f2 AS")
    + " "
    + name_value({"q": "b"}, "b", 4)
    + " UNION ALL "
    + name_value({"sargan": "n*(1-rss/yy)"}, "f2", 4),
    "summary": f"""{absorbed(SIMPLE, ['l_suppkey'])}, {two('price', 'qty', 'disc')}, h AS (SELECT var_pop(price)*count(*) AS tss FROM l), z AS (SELECT *, n-2-k AS d FROM f, g, h)
        {name_value({'r2': '1-rss/tss', 'adj_r2': '1-(rss/tss)*(n-1)/d', 'projected_r2': '1-rss/yy', 'F': '(tss-rss)/(1+k)/(rss/d)', 'projected_F': '(yy-rss)/2/(rss/d)', 'sigma': 'sqrt(rss/d)'}, 'z', 5)}""",
    "residual_quantiles": f"{absorbed(['price', 'qty'], ['l_suppkey'])}, {ONE}, u AS (SELECT price - b1*qty AS u FROM c, f) " + name_value({n: f"quantile_cont(u, {q})" for n, q in zip(["Min", "1Q", "Median", "3Q", "Max"], [0, 0.25, 0.5, 0.75, 1], strict=True)}, "u", 4),
    "wald": f"""{absorbed(SIMPLE, ['l_suppkey'])}, {two('price', 'qty', 'disc')}, z AS (SELECT b1-0.01 AS r1, b1+b2 AS r2, rss/(n-2-k) AS s2, v11 AS w11, v11+v12 AS w12, v11+2*v12+v22 AS w22 FROM f, g),
        t AS (SELECT (w22*r1*r1 - 2*w12*r1*r2 + w11*r2*r2)/(w11*w22-w12*w12)/s2 AS chi2 FROM z) {name_value({'chi2': 'chi2', 'F': 'chi2/2'}, 't', 3)}""",
    "nlexpect": f"{absorbed(SIMPLE, ['l_suppkey'])}, {two('price', 'qty', 'disc')} " + name_value({"square": "b1*b1 + rss*v11/(n-4-k)"}, "f, g", 8),
    "iv_liml": f"""{absorbed(['y', 'q', 'qty', 'tax', 'disc'], ['l_suppkey'])},
        h AS (SELECT sum(qty*qty) s, sum(qty*y) sy, sum(qty*q) sq, sum(qty*tax) st, sum(qty*disc) sd, sum(y*y) yy, sum(y*q) yq, sum(q*q) qq, sum(y*tax) yt, sum(y*disc) yd, sum(q*tax) qt, sum(q*disc) qd, sum(tax*tax) tt, sum(tax*disc) td, sum(disc*disc) dd FROM c),
        r AS (SELECT s, sy, sq, yy - sy*sy/s ayy, yq - sy*sq/s ayq, qq - sq*sq/s aqq, yt - sy*st/s yt, yd - sy*sd/s yd, qt - sq*st/s qt, qd - sq*sd/s qd, tt - st*st/s tt, td - st*sd/s td, dd - sd*sd/s dd FROM h),
        b AS (SELECT *, ayy - (yt*yt*dd - 2*yt*yd*td + yd*yd*tt)/(tt*dd - td*td) byy, ayq - (yt*qt*dd - (yt*qd + yd*qt)*td + yd*qd*tt)/(tt*dd - td*td) byq, aqq - (qt*qt*dd - 2*qt*qd*td + qd*qd*tt)/(tt*dd - td*td) bqq FROM r),
        t AS (SELECT *, byy*bqq - byq*byq det, ayy*bqq + aqq*byy - 2*ayq*byq mid, ayy*aqq - ayq*ayq top FROM b),
        k AS (SELECT *, 2*top/(mid + sqrt(greatest(mid*mid - 4*det*top, 0))) kappa FROM t),
        z AS (SELECT *, (ayq - kappa*byq)/(aqq - kappa*bqq) bq FROM k) """
    + name_value({"kappa": "kappa", "qty": "(sy - bq*sq)/s", "q": "bq"}, "z", 5),
    "loglik": f"{absorbed(['price', 'qty'], ['l_suppkey'])}, {ONE} " + name_value({"loglik": "-0.5*n*(ln(2*pi()) + 1 - ln(n) + ln(rss))"}, "f", 3),
    "update": f"{absorbed(['price', 'qty'], ['l_suppkey'])}, {ONE} " + tell([("qty", "b1", "sqrt(rss/(n-1-k)/aa)")], "f, g"),
    "demean_one": f"{absorbed(['price'], ['l_suppkey'])} SELECT l_orderkey, l_linenumber, round(price, 7) + 0.0 AS price FROM c",
    "demean_two": f"{absorbed(['qty'], ['l_partkey', 'l_suppkey'], 10)} SELECT l_orderkey, l_linenumber, round(qty, 5) + 0.0 AS qty FROM c",
    "demean_means": f"WITH {L} SELECT l_orderkey, l_linenumber, round(sum(w*qty) OVER p / sum(w) OVER p, 6) + 0.0 AS qty FROM l WINDOW p AS (PARTITION BY l_suppkey)",
    "demean_slope": f"{SLOPE} SELECT l_orderkey, l_linenumber, round(r, 6) + 0.0 AS qty FROM c",
    "model_matrix": f"{absorbed(['qty'], ['l_suppkey'])} SELECT count(*) AS n, round(sum(qty*qty), 2) + 0.0 AS ss FROM c",
    "components": f"{NODES} SELECT count(DISTINCT comp) AS components, CAST(1 AS BIGINT) AS first FROM d",
    "component_sizes": "WITH s AS (SELECT l_orderkey // 40 AS block, count(*) AS n FROM lineitem GROUP BY 1) SELECT n, count(*) AS components FROM s GROUP BY n",
    "degrees_of_freedom": f"{NODES}, z AS (SELECT (SELECT count(DISTINCT comp) FROM d) AS refs, (SELECT count(*) - count(DISTINCT l_partkey) - count(DISTINCT l_orderkey) FROM l) AS free) "
    + name_value({"refs": "refs", "df": "free + refs - 1", "exact_df": "free + refs - 1"}, "z", 0),
    "projection_trace": name_value({"one": "count(*) - count(DISTINCT l_suppkey)", "two": "count(*) - count(DISTINCT l_suppkey) - count(DISTINCT l_linenumber) + 1"}, "lineitem", 0),
    "effects_one_factor": f"""{absorbed(['price', 'qty'], ['l_suppkey'])}, {ONE} SELECT 'l_suppkey' AS fe, CAST(l_suppkey AS VARCHAR) AS idx, count(*) AS obs, round(avg(l.price) - max(b1)*avg(l.qty), 5) + 0.0 AS effect,
        round(sqrt(max(rss/(n-1-k))/count(*) + avg(l.qty)*avg(l.qty)*max(rss/(n-1-k)/aa)), 5) + 0.0 AS se FROM l, f, g GROUP BY l_suppkey""",
    "effects_two_factors": f"{EFFECTS}, {GAUSS_SQL} SELECT 'l_suppkey' AS fe, CAST(l_suppkey AS VARCHAR) AS idx, round(a - avg(a) OVER (), 4) + 0.0 AS effect FROM a8 UNION ALL SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR), round(p - avg(p) OVER (), 4) + 0.0 FROM e8",
    "effects_merged": f"{EFFECTS} SELECT 'qty' AS term, round(b1, 5) + 0.0 AS estimate FROM m UNION ALL SELECT 'a', 1.0 UNION ALL SELECT 'p', 1.0",
    "estimable": "SELECT 'ref' AS name, true AS estimable UNION ALL SELECT 'zm', true UNION ALL SELECT 'zm2', true UNION ALL SELECT 'ln', false",
    "dmatrix": f"SELECT 'l_suppkey.' || l_suppkey AS level, count(*) AS n, round(count(*), 3) + 0.0 AS total FROM lineitem GROUP BY l_suppkey UNION ALL SELECT 'qty:factor(l_linestatus).' || l_linestatus, count(*), round(sum(l_quantity), 3) + 0.0 FROM lineitem GROUP BY l_linestatus",
    "interaction_factor": f"{absorbed(['y', 'qty'], ['l_returnflag || l_linestatus']).replace('count(DISTINCT l_returnflag || l_linestatus)', 'count(DISTINCT (l_returnflag || l_linestatus))')}, {ONE.replace('price', 'y')} " + tell([("qty", "b1", "sqrt(rss/(n-1-k)/aa)")], "f, g"),
    "two_factors_robust": f"""{absorbed(['y', 'qty', 'disc'], ['l_partkey', 'l_suppkey'], 8)}, {two('y', 'qty', 'disc')}, s AS (SELECT (y - b1*qty - b2*disc) * qty AS a, (y - b1*qty - b2*disc) * disc AS b FROM c, f),
        t AS (SELECT sum(a*a) taa, sum(a*b) tab, sum(b*b) tbb FROM s), z AS (SELECT b1, b2, n/(n-2.0-k) * (v11*v11*taa + 2*v11*v12*tab + v12*v12*tbb) s1, n/(n-2.0-k) * (v12*v12*taa + 2*v12*v22*tab + v22*v22*tbb) s2 FROM f, t, g)
        {tell([('qty', 'b1', 'sqrt(s1)'), ('disc', 'b2', 'sqrt(s2)')], 'z')}""",
}

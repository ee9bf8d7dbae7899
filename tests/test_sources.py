from __future__ import annotations

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
import pytest

from plumbline.operators.estimate import felm
from plumbline.plans.frame import chainsubset
from plumbline.sources.spec import directives, run_spec, subset
from plumbline.sources.tables import read_table, write_table
from plumbline.streaming import moments_by_level, slope

SPEC = """
file {path}
vars x x2 year id firm y   # all of them
model y ~ x + x2 + year | id + firm
dummy year
se 10
fecorr
merge
savecomp
robust
test x x2
wald x-x2 | x2
subset x < mean(x) + 3
"""


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(2)
    n = 400
    d = pd.DataFrame({"x": rng.normal(size=n), "x2": rng.normal(size=n), "year": rng.integers(2000, 2003, n), "id": rng.integers(0, 9, n), "firm": rng.integers(0, 6, n)})
    d["y"] = d.x + 2 * d.x2 + 0.1 * d.id + d.firm + (d.year - 2000) + rng.normal(size=n)
    return d


def test_spec_runs_end_to_end(spark, pdf, tmp_path):
    path = tmp_path / "small.csv"
    pdf.to_csv(path, sep=" ", header=False, index=False)
    got = run_spec(SPEC.format(path=path), spark=spark, out=str(tmp_path / "out"))
    want = felm("y ~ x + x2 + factor(year) | id + firm", chainsubset(spark.createDataFrame(pdf), "x < {avg(x)} + 3"))
    assert got["fit"].coef()["x"] == pytest.approx(want.coef()["x"]) and len(got["fit"].names) == 4
    assert set(got["effects"]) == {"id", "firm"} and "se" in got["effects"]["id"].columns and len(got["tests"]) == 2
    assert got["merged"].where(F.col("id_effect").isNull()).count() == 0 and got["bias"][0].shape == (2, 2)
    assert spark.read.csv(str(tmp_path / "out" / "coef.csv"), header=True).count() == 4 and got["comp"].count() == got["merged"].count()
    with pytest.raises(ValueError, match="unknown"):
        directives("nonsense 1")


def test_subsets_and_tables(spark, pdf, tmp_path):
    df = spark.createDataFrame(pdf)
    assert subset(df, "x <- quantile(x, 0.1)").count() == 40
    kept = subset(subset(df, "x < mean(x)"), "y < mean(y)")
    one = pdf[pdf.x < pdf.x.mean()]
    assert kept.count() == (one.y < one.y.mean()).sum()
    for kind in ("parquet", "orc", "json", "csv"):
        write_table(df, f"{tmp_path}/t.{kind}")
        assert read_table(spark, f"{tmp_path}/t.{kind}").count() == len(pdf)
    pdf.to_stata(tmp_path / "t.dta", write_index=False)
    assert read_table(spark, str(tmp_path / "t.dta")).count() == len(pdf)


def test_streamed_moments_equal_the_fit(spark, pdf, tmp_path):
    write_table(spark.createDataFrame(pdf).repartition(4), f"{tmp_path}/s.parquet")
    stream = spark.readStream.schema(spark.createDataFrame(pdf).schema).parquet(f"{tmp_path}/s.parquet")
    q = moments_by_level(stream, "id", "y", "x").writeStream.outputMode("complete").format("memory").queryName("levels").start()
    q.processAllAvailable()
    q.stop()
    got, fit = slope(spark.table("levels")).first(), felm("y ~ x | id", spark.createDataFrame(pdf), robust=False)
    assert got["estimate"] == pytest.approx(fit.coef()["x"]) and got["std_error"] == pytest.approx(fit.se("iid")[0])

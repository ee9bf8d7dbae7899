"""What the plans read and move."""

from __future__ import annotations

import re

import pyspark.sql.functions as F

from plumbline.operators.components import connected_components
from plumbline.plans.formula import parse
from plumbline.plans.frame import build
from plumbline.queries import lines

SMALL = "/root/testdata/sf0.01"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_the_model_s_columns_and_push_filters(spark):
    raw = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    frame = build(raw, parse("l_extendedprice ~ l_discount | l_suppkey"), subset="l_quantity > 10")
    text = plan(frame.df)
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text)[1]
    assert sorted(x.split(":")[0] for x in schema.split(",")) == ["l_discount", "l_extendedprice", "l_quantity", "l_suppkey"]
    assert "GreaterThan(l_quantity,10.0)" in text


def test_level_sums_are_combined_before_the_shuffle(spark):
    frame = build(lines(spark, SMALL), parse("price ~ qty | l_suppkey"))
    text = plan(frame.df.groupBy("_f0").agg(F.sum("_x0"), F.sum("_y0")))
    assert "partial_sum" in text and text.count("Exchange hashpartitioning") == 1


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(k, k + 1) for k in range(300)] + [(1000, k) for k in range(1001, 1400)] + [(5000, 5000)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got.values()) == {0, 1000} and len(got) == 301 + 400
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0

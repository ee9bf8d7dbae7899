from __future__ import annotations

import numpy as np
import pyspark.sql.functions as F
import pytest

from plumbline.llm import toxicity as T

DATA = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    x = T.op2_toxicity(spark, DATA).join(labels, "doc_id").where("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in x}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.85 and n.get((0, 1), 0) / n[0, 0] < 0.01
    assert docs.count() == 10000


def test_held_out_labels_do_not_matter(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("toxic", F.when(T.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r["doc_id"]: r["score"] for r in T.toxicity(docs, y).collect()} for y in (labels, flipped))
    assert a == pytest.approx(b)


def test_odd_rows(spark):
    schema = "doc_id long, text string, label string, votes int"
    docs = spark.createDataFrame([(1, None, "x", 1), (2, "", "x", 1), (None, "you idiot", "x", 1), (3, "You are a st00pid 1d1ot!", None, 2), (3, "You are a st00pid 1d1ot!", None, 2), (4, "a b", "", 0), (5, "x" * 100_000, "", 0)], schema)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = T.toxicity(docs, none).collect()
    assert len(got) == 7 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["score"] == by[2]["score"] < 0.5 and by[None]["held_out"] and by[3]["predicted"] == 1
    assert T.toxicity(docs.where("false"), none).count() == 0
    labels = spark.createDataFrame([(1, None), (2, 0), (2, 1), (None, 1), (4, 0)], "doc_id long, toxic int")
    assert T.toxicity(docs, labels).count() == 7


def test_label_model_recovers_accuracies_and_discounts_copies():
    rng = np.random.default_rng(1)
    y = rng.random(20_000) < 0.2
    a, b, c = (np.where(y, rng.random(20_000) < hit, rng.random(20_000) < miss) for hit, miss in ((0.8, 0.02), (0.7, 0.05), (0.6, 0.03)))
    votes = np.stack([a, b, c, c, c], 1).astype(float)
    keys, count = np.unique(votes, axis=0, return_counts=True)
    q, m = T.label_model(keys, np.full(len(keys), -1), count.astype(float))
    assert abs(m["rate"] - 0.2) < 0.05 and abs(m["fires"][1][0] - 0.8) < 0.08
    assert m["weight"][2] < 0.5 < m["weight"][0] and m["correlation"][2, 3] > 0.7
    assert ((q >= 0) & (q <= 1)).all()


def test_votes_see_whole_texts_and_all_themes():
    voters, at = T.Voters([]), T.VOTERS.index
    vote = lambda text, name: voters.vote(text)[0] >> at(name) & 1
    assert vote("you are disgusting", "addressed") and vote("you are an idiot", "addressed") and not vote("this is disgusting", "addressed")
    assert not vote(("A" + "b" * 3) * 4096, "shouting") and vote(("b" + "ÀC") * 4096, "shouting") and not vote("Ab" * 10_000, "shouting")
    for n in (10, 30, 5000, 50_000):
        text = "".join(chr(0x41 + k * 7 % 700) for k in range(n))
        assert T.upper_case(text) == sum(map(str.isupper, text))

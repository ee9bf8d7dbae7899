from __future__ import annotations

import corpus_pipeline as P
import pyspark.sql.functions as F

from plumbline.llm import toxicity

SMALL = "/root/testdata/sf0.01"


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    x, seen = docs, {}
    for name, stage in P.STAGES[:-1]:
        after = P.written(stage(spark, x, SMALL), "t")
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
        seen[name], x = (x, after), after
    before, after = seen["toxicity"]
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    bad = {r["doc_id"] for r in toxicity.toxicity(docs, labels).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in after.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()} - bad and bad
    before, after = seen["line_dedup"]
    assert after.count() == before.count() and after.where(F.length("text") != F.col("n_chars")).count() == 0
    assert after.join(before.withColumnRenamed("text", "old"), "doc_id").where("length(text) < length(old)").count() > 10
    before, after = seen["near_duplicates"]
    assert 0 < after.count() < before.count() and after.count() == after.select("doc_id").distinct().count()
    before, after = seen["mixing"]
    n = after.groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert 1 < n <= 3
    pieces = P.STAGES[-1][1](spark, x, SMALL)
    tokens = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t")).join(x.groupBy("doc_id").count(), "doc_id", "full")
    assert tokens.where("n != t * count or n is null").count() == 0


def test_near_duplicates_keep_one_of_each_group(spark):
    t = " ".join(f"word{k}" for k in range(200))
    rows = [(3, t), (1, t), (2, t), (9, t + " and more of another kind " * 40), (7, ""), (8, None), (None, "alone here with five words more"), (1, t)]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r["doc_id"] or 0 for r in P.drop_near_duplicates(spark, docs, "").collect())
    assert got == [0, 1, 7, 9]
    for _, stage in P.STAGES[1:]:
        assert stage(spark, docs.where("false"), "").count() == 0


def test_rows_that_share_an_id_or_have_none_are_judged_by_text(spark):
    def text(k, n=60):
        return " ".join(f"w{k}-{i}" for i in range(n))

    rows = [(None, text(1)), (None, text(2)), (None, text(2)), (None, text(3)), (1, text(3) + " end"), (5, text(4)), (5, text(5)), (6, text(4)), (7, text(5) + " end")]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = P.drop_near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    want = [(None, text(1)), (None, text(2)), (1, text(3) + " end"), (5, text(4)), (5, text(5))]
    key = lambda r: (r[0] or 0, r[1])
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=key) == sorted(want, key=key)
    mixed = P.mix_sources(spark, out, "").groupBy("doc_id", "text").count().collect()
    assert mixed and all(r["count"] <= 3 for r in mixed)
    copies = {(r["doc_id"], r["hash"]): r["copies"] for r in P.mixing.mix(out, [5.0, 2.0, 1.0]).collect()}
    assert sum(r["count"] for r in mixed) == sum(copies.values())

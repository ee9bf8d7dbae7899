from __future__ import annotations

import re
from collections import defaultdict

import pytest

from plumbline.llm import mixing

SMALL = "/root/testdata/sf0.01"


def brute_targets(sizes, weights=(5.0, 2.0, 1.0), most=3.0):
    """source -> target, resharing what capped sources leave until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, free, budget = {}, set(order), float(sum(sizes.values()))
    while free:
        level = budget / sum(w[s] for s in free)
        over = [s for s in free if level * w[s] > most * sizes[s]]
        if not over:
            return target | {s: level * w[s] for s in free}
        for s in over:
            target[s] = most * sizes[s]
            budget -= target[s]
            free.remove(s)
    return target


def check(rows, got, near):
    sizes, by = defaultdict(int), defaultdict(int)
    words = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, _, t in rows}
    source = {d: s for d, s, _ in rows}
    for d, s, _ in rows:
        sizes[s] += words[d]
    want = brute_targets(dict(sizes))
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == words[r["doc_id"]] and r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        by[s] += r["taken"]
    for s in sizes:
        # short of the target by less than the smallest document left, beyond it by less than the smallest one that is in
        own = [r for r in got if source[r["doc_id"]] == s and r["size"]]
        least = min((r["copies"] for r in own), default=3)
        left, taken = ([r["size"] for r in own if (r["copies"] == least < 3) == out] for out in (True, False))
        assert not own or abs(by[s] - want[s]) < 1e-6 or abs(by[s] - want[s]) <= min((left if by[s] < want[s] else taken) or left or taken), (s, by[s], want[s])
        assert abs(by[s] - want[s]) <= near, (s, by[s], want[s])


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "source", "text").collect()]
    got = mixing.op5_mixing(spark, SMALL).collect()
    check(rows, got, 150)
    assert {r["doc_id"]: r["taken"] for r in got} == {r["doc_id"]: r["taken"] for r in mixing.op5_mixing(spark, SMALL).collect()}


def test_caps_nulls_and_hot_sources(spark):
    rows = [(k, "big" if k < 900 else "é" if k < 960 else None, " ".join(["w"] * (k % 19))) for k in range(1000)] + [(2000, "none", None), (2001, "A", "one two"), (2002, "B", "")]
    docs = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, source string, text string, bucket string, target double")
    got = mixing.mix(docs, [5.0, 2.0, 1.0]).collect()
    check(rows, got, 10)
    assert len(got) == len(rows) and mixing.mix(docs.where("false"), [5.0, 2.0, 1.0]).count() == 0


def test_budgets_with_one_whole_part_are_nested(spark):
    docs = spark.createDataFrame([(k, "s", "w " * (1 + k % 7)) for k in range(2000)], "doc_id long, source string, text string")
    small, large = ({r["doc_id"] for r in mixing.mix(docs, [1.0], share=s).where("copies > 0").collect()} for s in (0.3, 0.6))
    assert len(small - large) <= 1


def test_small_documents_fill_what_a_large_one_leaves(spark):
    # targets by weight 5 and 2: the first source has some large and many short documents, repeated rows among them
    rows = [(k, "a", "w " * 5000) for k in range(5)] + [(100 + k, "a", "w") for k in range(6000)] + [(9000, "a", "w w w")] * 40
    rows += [(10_000 + k, "b", "w " * (1 + k % 50)) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(docs, [5.0, 2.0], most=3.0, share=0.5).collect()
    by = defaultdict(int)
    for r in got:
        by[r["source"], r["target"]] += r["taken"]
    assert len(by) == 2 and all(abs(taken - target) <= 0.5 + 1e-6 for (_, target), taken in by.items())


def test_many_sources_are_ordered_without_one_task(spark):
    rows = [(k, f"s{k % 2000:04d}" if k % 7 else None, "w " * (k % 13)) for k in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    sizes = defaultdict(int)
    for k, s, t in rows:
        sizes[s] += k % 13
    got = {r["source"]: r["target"] for r in mixing.mix(docs, [5.0, 2.0, 1.0]).select("source", "target").distinct().collect()}
    assert got == pytest.approx(brute_targets(dict(sizes)))

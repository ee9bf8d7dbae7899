from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from plumbline.llm import substrings as S

SMALL = "/root/testdata/sf0.01"


def brute(rows, width=13):
    """(doc_id, text) -> n_words, n_removed, sha."""
    least = {}
    split = [(-(1 << 63) if d is None else d, (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        for s in range(len(w) - width + 1):
            k = tuple(w[s : s + width])
            least[k] = min(least.get(k, d), d)
    out = {}
    for (d, w), row in zip(split, rows, strict=True):
        gone = {s + j for s in range(len(w) - width + 1) if least[tuple(w[s : s + width])] < d for j in range(width)}
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.setdefault(row, []).append((len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def same(spark, rows, schema="doc_id long, text string", **k):
    want = sorted((d is not None, d or 0, *x) for (d, _), v in brute(rows, **k).items() for x in v)
    got = S.dedup_substrings(spark.createDataFrame(rows, schema), **k).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == want
    return sum(r["n_removed"] for r in got)


def test_whole_table_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    want = {d: x[0] for (d, _), x in brute(rows).items()}
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in S.op6_substrings(spark, SMALL).collect()}
    assert got == want and sum(x[1] for x in got.values()) > 1000


@pytest.mark.parametrize("letters", [1, 2, 3, 6])
def test_small_alphabets_with_runs(spark, letters):
    rng = random.Random(letters)
    rows = [(k, " ".join(rng.choice("abcdef"[:letters]) for _ in range(rng.randint(0, 60)))) for k in range(120)]
    assert same(spark, rows) > 0 or letters == 6
    assert same(spark, rows, width=5) > 0


def test_odd_rows(spark):
    p = " ".join(f"w{k}" for k in range(30))
    rows = [(3, p), (1, p + " tail"), (None, "x " + p), (2, p), (2, p), (4, None), (5, ""), (6, " \t\n"), (7, "w1 w2"), (8, "w\x851 \x1c " + p), (9, p.replace(" ", "\n\t")), (10, "q" * 50_000 + " " + p), (2, p + " another text")]
    same(spark, rows)
    extra = spark.createDataFrame([(1, p, 5, "x"), (2, "a " + p, 6, "y")], "doc_id long, text string, id long, marks string")
    out = S.dedup_substrings(extra)
    assert {r["doc_id"]: r["kept"] for r in S.kept_texts(extra, out).collect()} == {1: p, 2: "a"}
    assert S.dedup_substrings(extra.where("false")).count() == 0


def test_equal_windows_have_equal_marks_in_any_surroundings():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(2, 5))
        core = rng.integers(0, n, 13)
        marks = []
        for _ in range(4):
            a, b = rng.integers(0, n, rng.integers(0, 20)), rng.integers(0, n, rng.integers(0, 20))
            text = " ".join(map(str, [*a, *core, *b])).encode()
            word, first = S.words_of([b"x y", text])
            m, room = S.marks(word, first, 13)
            assert room[2 + len(a)]
            marks.append(m[2 + len(a)])
        assert len(set(marks)) == 1

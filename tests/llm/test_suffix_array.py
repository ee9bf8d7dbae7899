from __future__ import annotations

import hashlib
import random

import pytest

from plumbline.llm import suffix_array as S

SMALL = "/root/testdata/sf0.01"


@pytest.mark.parametrize("letters", [1, 2, 3, 26])
def test_order_of_suffixes(letters):
    rng = random.Random(letters)
    for _ in range(300):
        s = [rng.randint(1, letters) for _ in range(rng.randint(0, 80))] + [0]
        assert S.suffix_array(s) == sorted(range(len(s)), key=lambda k: s[k:])


def test_order_of_periodic_and_repeated_texts():
    for t in (b"ab" * 300, b"abcabcabd" * 60, b"aab" * 100 + b"aac" * 100, b"mississippi" * 30, b"a" * 500 + b"b" + b"a" * 500):
        s = [b + 1 for b in t] + [0]
        assert S.suffix_array(s) == sorted(range(len(s)), key=lambda k: s[k:])


def brute(rows, width=100):
    first, out = {}, {}
    split = sorted(((-(1 << 63) if d is None else d), (t or "").encode()) for d, t in rows)
    for d, b in split:
        for s in range(len(b) - width + 1):
            first.setdefault(b[s : s + width], (d, s))
    for (d, t) in rows:
        i, b = (-(1 << 63) if d is None else d), (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - width + 1):
            if first[b[s : s + width]] < (i, s):
                gone[s : s + width] = b"\1" * width
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.setdefault((d, t), []).append((len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def same(spark, rows, width=100):
    want = sorted((d is not None, d or 0, *x) for (d, _), v in brute(rows, width).items() for x in v)
    got = S.dedup_bytes(spark.createDataFrame(rows, "doc_id long, text string"), width).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_bytes"], r["n_removed"], len(r["starts"]), r["kept_sha256"]) for r in got) == want
    return sum(r["n_removed"] for r in got)


def test_whole_table_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    want = {d: x[0] for (d, _), x in brute(rows).items()}
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in S.op8_suffix_array(spark, SMALL).collect()}
    assert got == want and sum(x[1] for x in got.values()) > 10_000


@pytest.mark.parametrize(("letters", "crowd"), [(1, 1 << 20), (2, 1 << 20), (2, 1), (2, 200), (4, 1 << 20), (4, 200)])
def test_small_alphabets(spark, letters, crowd, monkeypatch):
    monkeypatch.setattr(S, "CROWD", crowd if crowd > 1 else 0)
    rng = random.Random(letters)
    rows = [(k, "".join(rng.choice("abcd"[:letters]) for _ in range(rng.randint(0, 150)))) for k in range(60)]
    assert same(spark, rows, 20) > 0 or letters == 4
    same(spark, rows, 100)


def test_odd_rows(spark):
    p = " ".join(f"é{k}w" for k in range(60))
    rows = [(3, p), (1, p + " tail"), (None, "x " + p), (2, p), (2, p), (4, None), (5, ""), (6, "z" * 3000), (7, "z" * 99), (8, "ab" * 400), (9, p + p), (2, p + " other"), (10, "\x00" * 300)]
    same(spark, rows)
    extra = spark.createDataFrame([(1, p, 5, "x")], "doc_id long, text string, id long, mark string")
    assert S.dedup_bytes(extra).first()["n_removed"] == 0 and S.dedup_bytes(extra.where("false")).count() == 0

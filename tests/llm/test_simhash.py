from __future__ import annotations

import random

import pyspark.sql.functions as F
import pytest
import xxhash

from plumbline.llm import simhash as S

SMALL = "/root/testdata/sf0.01"


def brute_print(text, width):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    """print -> smallest member of its component, by comparing all pairs."""
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    ps = sorted(prints)
    for i, a in enumerate(ps):
        for b in ps[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    return {p: find(p) for p in ps}


def test_whole_table_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    prints = {d: brute_print(t, 3) for d, t in rows}
    roots = brute_components(set(prints.values()))
    least: dict = {}
    for d, p in prints.items():
        least[roots[p]] = min(least.get(roots[p], d), d)
    want = {d: (f"{p:016x}", least[roots[p]]) for d, p in prints.items()}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in S.op1_simhash(spark, SMALL).collect()}
    assert got == want and sum(v[1] != d for d, v in got.items()) > 10


@pytest.mark.parametrize("heavy", [64, 2])
def test_links_connect_like_all_pairs(spark, heavy, monkeypatch):
    monkeypatch.setattr(S, "HEAVY", heavy)
    rng = random.Random(heavy)
    prints = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(12):
            prints.add(base)
            base ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
    for _ in range(40):
        prints.add(rng.getrandbits(64))
    base = rng.getrandbits(64)
    prints |= {base ^ 1 << k for k in range(32, 64)} | {base ^ 3 << k for k in range(20)} | {base ^ 7 << 40}
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    found = S.connected_components(S.links(spark.createDataFrame(signed, "print long"))).collect()
    got = {r["node"] % (1 << 64): r["component"] % (1 << 64) for r in found}
    want = brute_components(prints)
    groups = lambda m: sorted(sorted(k for k in prints if m.get(k, k) == v) for v in {m.get(k, k) for k in prints})
    assert groups(got) == groups(want)


def test_odd_rows(spark):
    t = "Éa b C " * 30
    rows = [(5, t), (3, t), (None, t), (1, None), (2, ""), (4, " \t\n"), (6, "one"), (7, "two words"), (8, "x " * 30_000), (3, t)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, print int")
    got = S.near_duplicates(docs, 3).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: (r["print"] % (1 << 64), r["component_id"]) for r in got}
    assert by[5] == by[3] == by[None] and by[5][1] == 3 and by[1] == by[2] == by[4] == (0, 1)
    for d, x in rows:
        assert by[d][0] == brute_print(x, 3)
    assert S.near_duplicates(docs.where("false"), 3).count() == 0


def test_spark_hash_of_a_text_is_plain_xxh64(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("é b c"))).first()[0] % (1 << 64) == xxhash.xxh64_intdigest("é b c".encode(), 42)

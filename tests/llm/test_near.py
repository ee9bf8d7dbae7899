from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline as P
import pyspark.sql.functions as F

from plumbline.llm import _near as M
from plumbline.llm import simhash as S

SMALL = "/root/testdata/sf0.01"


def brute_set(text, width):
    words = (text or "").encode().lower().split()
    n = Counter(b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))) if words else {}
    return frozenset((x, k) for x in n for k in range(n[x]))


def brute_components(sets):
    """doc_id -> smallest doc_id of its component, by comparing all pairs that share a shingle."""
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def join(a, b):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)

    having: dict = {}
    for d, s in sorted(sets.items()):
        met: dict = {}
        for x in s or [None]:
            for e in having.setdefault(x, []):
                met[e] = met.get(e, 0) + 1
            having[x].append(d)
        for e, n in met.items():
            if not s or 5 * n >= 4 * len(s | sets[e]):
                join(d, e)
    return {d: find(d) for d in sets}


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    sets = {r["doc_id"]: brute_set(r["text"], 5) for r in docs.collect()}
    want = brute_components(sets)
    got = {r["doc_id"]: r["component_id"] for r in M.near_copies(docs, 5).collect()}
    assert got == want and sum(sets[d] != sets[e] for d, e in want.items()) >= 5
    assert M.near_copies(docs.where("false"), 5).count() == 0


def test_planted_near_copies_go(spark):
    rng = random.Random(1)
    rows = []
    for g in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        for k in range(5):
            copy = list(words)
            for _ in range(rng.randrange(5)):
                copy[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
            rows.append((g * 5 + k, " ".join(copy)))
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = brute_components({d: brute_set(t, 5) for d, t in rows})
    got = {r["doc_id"] for r in P.drop_near_duplicates(spark, docs, "").collect()}
    assert got == set(want.values()) and len(got) < 60


def test_a_hub_of_many_near_copies(spark):
    words = [f"w{k}" for k in range(100)]
    rows = [(k, " ".join([*words, f"end{k}"])) for k in range(500)] + [(1000 + k, " ".join(words[:50] + [f"y{k}-{i}" for i in range(50)])) for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in M.near_copies(docs, 5).collect()}
    assert got == {d: 0 if d < 1000 else d for d, _ in rows}


def test_fingerprints_link_without_bands(spark, monkeypatch):
    rng = random.Random(4)
    rows = []
    for g in range(30):
        words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        for k in range(3):
            copy = list(words)
            if k:
                copy[rng.randrange(400)] = f"x{rng.randrange(10**6)}"
            rows.append((g * 3 + k, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints = {d: S.fingerprint(t, 5) & (1 << 64) - 1 for d, t in rows}
    want = {d: next(e for e in root if (prints[d] ^ prints[e]).bit_count() <= 2) if (root := [e for e in sorted(prints) if e // 3 == d // 3]) else d for d in prints}
    assert sum(want[d] != d for d in want) > 10
    real = M.classes_of
    monkeypatch.setattr(M, "classes_of", lambda *a: real(*a).withColumn("keys", F.array("class")))  # no two classes share a key
    got = {r["doc_id"]: r["component_id"] for r in M.near_copies(docs, 5).collect()}
    assert all(got[d] == got[e] for d, e in want.items()) and len(set(got.values())) >= 30


def test_print_links_connect_like_all_pairs(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(63) for _ in range(20)]
    prints = [b ^ sum(1 << k for k in rng.sample(range(63), rng.randrange(4))) for b in base for _ in range(6)]
    classes = spark.createDataFrame(list(enumerate(prints + prints[:5])), "class long, print long")
    ps = dict(enumerate(prints + prints[:5]))

    def roots(pairs):
        low = {c: c for c in ps}
        for _ in ps:
            for x, y in pairs:
                low[x] = low[y] = min(low[x], low[y])
        return low

    pairs = [(x, y) for x in ps for y in ps if y < x and (ps[x] ^ ps[y]).bit_count() <= 2]
    got = [(r["x"], r["y"]) for r in M.print_links(classes).collect()]
    assert all(x > y for x, y in got) and roots(got) == roots(pairs)

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plumbline.llm import packing

SMALL = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("word_bpe_49k.json")


def whole(rows, pieces, limits=(4096, 64, 4096)):
    tok = Tokenizer.from_file(PATH)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_seq[p["sequence_id"]].append(p)
    assert set(by_doc) == {d for d, _ in rows}
    for d, text in rows:
        ids, at = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], "<u4"), 0
        for p in sorted(by_doc[d], key=lambda p: p["start"]):
            assert (p["start"], p["doc_tokens"]) == (at, len(ids)) and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= limits[0] and len(ps) <= limits[1] and sum(p["loss_tokens"] for p in ps) <= limits[2]
    return by_seq


def padding(by_seq, limit=4096):
    sizes = [sum(p["length"] for p in ps) for ps in by_seq.values()]
    return sum(0 if n & (n - 1) == 0 else limit - n for n in sizes)


def test_round_trip_of_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert padding(whole(rows, packing.op9_packing(spark, SMALL).collect())) == 0


def test_odd_texts_nulls_and_specials(spark):
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "a\x1cb\x85c\xa0d e"), (5, "x<|startoftext|>y <|endoftext|> z"), (6, "café ́ I'M it's"), (None, "no id"), (7, "word" * 9000), (8, "a " * 9000), (9, "İstanbul 12 345")]
    docs = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], "doc_id long, text string, group string, share int")
    whole(rows, packing.pack(docs, PATH, 2).collect())
    assert packing.pack(docs.where("false"), PATH, 2).count() == 0


def test_segment_limit_with_many_short_documents(spark):
    rows = [(k, "one two") for k in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = whole(rows, packing.pack(docs, PATH, 2).collect())
    assert padding(got) == 0


@pytest.mark.parametrize("loss", [0.0, 0.3, 1.0])
def test_three_limits_hold(loss):
    rng = np.random.default_rng(3)
    n = rng.integers(1, 4096, 300)
    demand = np.stack([n, np.ones(300), np.floor(n * loss * rng.random(300))], 1)
    limits = np.array([4096, 8, 1500.0])
    used = np.zeros(300)
    for chosen in packing.dot_product_pack(demand, limits):
        total = sum((np.array([t, 1, demand[i, 2] * t / demand[i, 0]]) for i, _, t in chosen), np.zeros(3))
        assert (total <= limits + 1e-6).all()
        for i, start, take in chosen:
            assert start == used[i]
            used[i] += take
    assert (used == n).all()


def test_cache_starts_anew_and_gives_the_same_ids(monkeypatch):
    texts = [" ".join(f"w{k}x{j}" for k in range(50)) for j in range(200)] + ["y" * 500 + " z"]
    wide = list(packing.WordTokenizer(PATH, 2).encode(texts))
    monkeypatch.setattr(packing, "CACHE_WORDS", 100)
    assert list(packing.WordTokenizer(PATH, 2).encode(texts)) == wide

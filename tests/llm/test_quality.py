from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import quality as Q

SMALL = "/root/testdata/sf0.001"


def brute_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    n = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if n[w] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_base_rules(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()]
    for t in [*texts, "", "\n\n", "a b c a b c", "a a a a", "x\x85y z\x1cw", "é\té\vé", "a\na\n\n\na"]:
        assert Q.base_rules(t) == brute_rules(t)


def test_probabilities_sum_to_one_and_seen_grams_gain(spark):
    docs = spark.createDataFrame([(k, "en", f"the cat sat on the mat {k % 7} and the dog") for k in range(60)] + [(100, None, "abc")], "doc_id long, lang string, text string")
    orders = Q.kneser_ney(Q.count_grams(docs))
    models = {k: Q.Model(v) for k, v in Q.collected(orders).items()}
    assert set(models) == {"en", None}
    for m, contexts in ((models["en"], (b"\0\0\0\0", b"\0\0th", b" cat", b"the ", b"zzzz", b"xthe")), (models[None], (b"\0\0\0\0", b"\0abc"))):
        for c in contexts:
            key = np.array([int.from_bytes(c + bytes([b]), "big") for b in range(256)])
            assert np.exp(m.logp(key).astype(float)).sum() == pytest.approx(1, abs=1e-4)
    seen, unseen = (models["en"].logp(Q.grams([x])[0]).mean() for x in (b"the cat sat", b"tac eht tas"))
    assert seen > unseen + 1


def test_counts_do_not_cross_texts_or_chunks(spark, monkeypatch):
    monkeypatch.setattr(Q, "CHUNK", 8)
    key, starts = Q.grams([b"abcdef", b"", b"xy"])
    want = [int.from_bytes(x, "big") for x in (b"\0\0\0\0a", b"\0\0\0ab", b"\0\0abc", b"\0abcd", b"abcde", b"bcdef", b"\0\0\0\0x", b"\0\0\0xy")]
    assert key.tolist() == want and starts.tolist() == [0, 6, 6, 8]
    assert [len(p) for p in Q._chunks([b"abcdef", b"", b"xy", b"z"])] == [3, 1]


def brute_perplexities(rows):
    """Log perplexity of each text, by a modified Kneser-Ney model in plain dictionaries: counts, discounts and interpolation by recursion."""
    out = []
    for lang in {r[0] for r in rows}:
        counts = {5: Counter()}
        for x, t in rows:
            b = b"\0\0\0\0" + (t or "").encode()
            if x == lang:
                counts[5].update(b[k - 4 : k + 1] for k in range(4, len(b)))
        for k in (4, 3, 2, 1):
            counts[k] = Counter(g[1:] for g in counts[k + 1])
        total, off, cut = {}, {}, {}
        for k, c in counts.items():
            n = Counter(c.values())
            y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.5
            cut[k] = [min(i - 0.05, max(0.05, i - (i + 1) * y * (n[i + 1] / n[i] if n[i] else i / (i + 1)))) for i in (1, 2, 3)]
            total[k], off[k] = Counter(), Counter()
            for g, v in c.items():
                total[k][g[:-1]] += v
                off[k][g[:-1]] += cut[k][min(v, 3) - 1]

        def p(g):
            if not g:
                return 1 / 256
            k, c = len(g), g[:-1]  # noqa: B023
            v = counts[k][g]  # noqa: B023
            return max(0.0, v - cut[k][min(v, 3) - 1] if v else 0.0) / total[k][c] + off[k][c] / total[k][c] * p(g[1:])  # noqa: B023

        for x, t in rows:
            b = b"\0\0\0\0" + (t or "").encode()
            if x == lang and len(b) > 4:
                out.append(((x, t), -sum(np.log(p(b[k - 4 : k + 1])) for k in range(4, len(b))) / (len(b) - 4)))
    return dict(out)


def test_perplexities_and_bands_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("length(text) < 4000")
    rows = docs.select("lang", "text").collect()
    want = brute_perplexities([tuple(r) for r in rows])
    got = Q.quality(docs).join(docs.select("doc_id", "text"), "doc_id").collect()
    for r in got:
        if r["text"]:
            assert r["log_perplexity"] == pytest.approx(want[r["lang"], r["text"]], rel=1e-5)
    bands = {}
    for lang in {r["lang"] for r in got}:
        v = sorted(r["log_perplexity"] for r in got if r["lang"] == lang and not r["base_failed"])
        if v:
            low, mid, high = (v[max(0, int(np.ceil(q * len(v))) - 1)] for q in (0.25, 0.5, 0.75))
            spread = 5 * max((high - low) / 1.349, 0.005)
            bands[lang] = (mid - spread, mid + spread)
    for r in got:
        inside = r["lang"] in bands and r["text"] and bands[r["lang"]][0] - 1e-9 <= r["log_perplexity"] <= bands[r["lang"]][1] + 1e-9
        assert r["kept"] == (not r["base_failed"] and bool(inside))


def test_a_language_without_text(spark):
    rows = [(k, "en", f"some words of text number {k} " * 12) for k in range(30)] + [(100, "yy", None), (101, "yy", ""), (102, None, None), (103, "zz", " \n ")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = {r["doc_id"]: r for r in Q.quality(docs).collect()}
    assert len(got) == len(rows) and all(got[k]["base_failed"] and not got[k]["kept"] and got[k]["n_words"] == 0 for k in (100, 101, 102, 103))
    assert got[100]["log_perplexity"] is None and got[103]["log_perplexity"] is not None
    assert Q.quality(docs.where("doc_id = 100")).first()["log_perplexity"] is None


def test_verdicts_on_odd_rows(spark):
    good = " ".join(f"word{k * 37 % 101} {k * 53 % 97}and more{k * 7 % 89} text{k}" for k in range(60))
    rows = [(k, "en", good[k:], "x") for k in range(40)] + [(50, "en", " ".join("qzxkj"[j % 5] * (j % 9 + 1) + str(j * 7919) for j in range(90)), "x"), (51, None, None, "x"), (52, "en", "", "x"), (53, None, "a " * 80, "x"), (54, "xx", good, None), (54, "xx", good, None)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string, kept string")
    got = {r["doc_id"]: r for r in Q.quality(docs).collect()}
    assert got[51]["base_failed"] and got[52]["n_words"] == 0 and got[53]["n_repeat_words"] == 80 and not got[53]["kept"]
    assert not got[50]["base_failed"] and not got[50]["kept"] and got[20]["kept"]
    assert Q.quality(docs).count() == len(rows) and Q.quality(docs.where("false")).count() == 0

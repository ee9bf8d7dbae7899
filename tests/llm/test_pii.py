from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict

import regex

from plumbline.llm import pii

SMALL = "/root/testdata/sf0.01"
#: The contract's patterns as given.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    d = [int(c) for c in reversed(s)]
    return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(d)) % 10 == 0


def ok(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 10 <= len(digits) <= 15


def brute(text):
    found = [(m.start(), k, m.end()) for k in BASE for m in re.finditer(BASE[k], text or "") if ok(k, m.group())]
    found.sort(key=lambda x: (x[0], list(BASE).index(x[1])))
    return ",".join(f"{k}:{a}:{b}" for a, k, b in found)


def brute_spans(texts, rounds=3, least=0.5, support=3.0, accept=0.5):
    """All spans of each text: the units and the scores of patterns and strings, in plain loops."""
    left, right = regex.compile(r"^[\"'(\[<{,.;:!?#*$%&|=]++"), regex.compile(r"[\"')\]>},.;:!?#*$%&|=]++$")
    unit = regex.compile(r"(?:\+[0-9](?:[\x20().-]*+[0-9]++)++)|(?<![A-Za-z0-9-])[0-9]{2,}+(?:[\x20-][0-9]{2,}+){2,}+|(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]*?[0-9@][^\x20\x09-\x0D]*+")
    blank = regex.compile(r"[\x20\x09-\x0D]+")
    kinds, units = list(BASE), defaultdict(list)
    base = {d: [(m.start(), kinds.index(k), m.end()) for k in BASE for m in re.finditer(BASE[k], t) if ok(k, m.group())] for d, t in texts.items()}
    for d, t in texts.items():
        found = list(unit.finditer(t))
        for j, m in enumerate(found):
            before = t[found[j - 1].end() if j else 0 : m.start()]
            after = t[m.end() : found[j + 1].start() if j + 1 < len(found) else len(t)]
            words = ["", ""] + [w for w in blank.split(before.lower()) if w]
            following = [w for w in blank.split(after) if w]
            trimmed = left.sub("", m.group())
            core = right.sub("", trimmed)
            start = m.end() - len(trimmed)
            end = start + len(core)
            if len(core) < 6:
                continue
            inside = sorted(b for b in base[d] if b[0] < end and b[2] > start)
            exact = [b[1] for b in inside if (b[0], b[2]) == (start, end)]
            if inside and not exact:
                continue
            shape = regex.sub("[0-9]", "9", regex.sub(r"\p{Ll}+", "a", regex.sub(r"\p{Lu}+", "A", core)))
            family = "at" if "@" in core else "digits" if not re.sub(r"[0-9\x20().+-]", "", core) else "mixed"
            patterns = [("shape", shape), ("before", " ".join(words[-2:]), family), ("word", words[-1], shape), ("after", following[0].lower() if following else "", shape)]
            units[d].append((start, end, core, exact[0] if exact else None, patterns))
    seeds = {(c, k): 1.0 for u in units.values() for _, _, c, k, _ in u if k is not None}
    edges = {(c, p) for u in units.values() for _, _, c, _, ps in u for p in ps}
    sizes, scores = defaultdict(int), dict(seeds)
    for _, p in edges:
        sizes[p] += 1
    for _ in range(rounds):
        f = defaultdict(float)
        for c, p in edges:
            for k in range(4):
                if (c, k) in scores:
                    f[p, k] += scores[c, k]
        best = {}
        for (p, k), x in f.items():
            trust = x / sizes[p] * math.log2(x + 1)
            if trust >= least and x >= support and (trust, k) > best.get(p, (0, -1)):
                best[p] = (trust, k)
        still = defaultdict(float)
        for c, p in edges:
            if p in best and not any((c, k) in seeds for k in range(4)):
                still[c, best[p][1]] += math.log(1 - min(best[p][0], 0.95))
        told = {}
        for (c, k), x in still.items():
            told[c] = max(told.get(c, (0.0, -1)), (1 - math.exp(x), k))
        scores = seeds | {(c, k): x for c, (x, k) in told.items()}
    new = {c: k for (c, k), x in scores.items() if (c, k) not in seeds and x >= accept}
    out = {d: sorted(base[d] + list({(a, new[c], b) for a, b, c, k, _ in units[d] if k is None and c in new})) for d in texts}
    return {d: ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in v) for d, v in out.items()}


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_base_spans_of_the_whole_table(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    got = pii.op7_pii(spark, SMALL).collect()
    assert {r["doc_id"]: r["base_sha256"] for r in got} == {d: sha(brute(t)) for d, t in texts.items()}
    want = brute_spans({d: t or "" for d, t in texts.items()})
    assert {r["doc_id"]: r["spans"] for r in got} == want
    for r in got:
        base, spans = brute(texts[r["doc_id"]]), r["spans"].split(",") if r["spans"] else []
        assert set(base.split(",") if base else []) <= set(spans) and len(spans) == sum(r[f"n_{k}"] for k in pii.KINDS)


def test_base_spans_of_odd_texts(spark):
    texts = [None, "", "a@b.c_d@e.f", "a@b.c.d@e.f", "é x@y.zz 😀 1.2.3.4.5.6.7.8 999.1.1.1 001.002.003.004", "0.0.0.0 10.0.0.1 127.0.0.1 192.168.0.1 255.255.255.0 00.000.0.00 256.0.0.1 0256.0.0.1 0255.0.0.01 1.0.0.300 1.0.0", "0" * 4000 + ".0.0.0 " + "1." * 9000, "4111 1111-1111 1111 4111111111111111", "+1 (017) 555-7713. +12 +1234567890123456 +1", "@@a@b..c a@b-.c. .@.x", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5",
             "9" * 60_000, "1 " * 30_000, "a" * 60_000, "a@" * 20_000, "+1 " * 20_000, "a@b.c " * 3000, "1.2.3.4 " * 2000, ("x.y" * 9 + "@") * 500, "1-1" * 9000, "+1" + " " * 40_000 + "2"]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, key string")
    for r in pii.find(docs).collect():
        assert ",".join(f"{pii.KINDS[s['kind']]}:{s['start']}:{s['end']}" for s in r["base"]) == brute(texts[r["doc_id"]]), r["doc_id"]
    assert pii.find(docs.where("false")).count() == 0


def test_contexts_discover_unseen_identifiers(spark):
    rows = [(k, f"my phone is +1 202 555 {1000 + k} ok") for k in range(40)] + [(100, "my phone is 555-0199-77 ok"), (101, "version 12.345.67 of it"), (None, "my phone is 555-0199-77 ok")]
    got = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(s) for s in got[100]["spans"]] == [(12, 3, 23)] and not got[100]["base"] and got[None]["spans"] == got[100]["spans"]
    assert not got[101]["spans"] and len(got[5]["spans"]) == 1

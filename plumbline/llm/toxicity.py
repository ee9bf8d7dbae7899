"""Toxicity by weak supervision.

Voters look at a whole text and fire or stay silent: seed lexicons by theme, lexicons of words and stems that
were mined from labelled rows, and patterns (disguised spelling, insults addressed to the reader, shouting).
A generative label model is fitted by expectation maximisation to the counts of vote patterns: it estimates
how often each voter fires on either class and how strongly voters agree within a class, and discounts the
votes of correlated voters. The annotators' labels take part in it as one more voter that may err. Its
posterior labels train a linear classifier (logistic regression) on votes and mined lexicon entries, and that
classifier scores every text. Labels, language, source and doc_id are no inputs of a score.

The fit uses a sample of labelled rows: all of them up to `bound`, and beyond that a hash sample of about that
many; so what reaches the driver is bounded by `bound` rows and MINED entries. Scoring covers every document.

Nulls and empty texts have no words and get the score of a text on which nobody votes; a null doc_id counts
as the empty string in the held-out rule; labels that are null are ignored, of repeated ones the largest
counts. Without any usable label the seed lexicons and patterns alone are fitted. Repeated rows get equal
results, an empty table none. Further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import slices, table, written

#: Rows of the labelled sample, mined entries at most, and shards of the mined lexicon.
BOUND, MINED, SHARDS = 20_000, 4_000, 6
#: Fixed seed lexicons by theme: stems as they begin words, in English, German, French and Spanish.
SEEDS = {
    "wits": "idiot moron stupid imbecil dumbass retard clown dumm bloed crétin débile stupide tonto estúpid imbécil".split(),
    "worth": "worthless loser pathetic trash scum garbage wertlos abschaum versager minable ordure raclure basura inútil escoria".split(),
    "disgust": "disgusting repulsive vile filthy ekelhaft widerlich dégoûtant répugnant asqueroso repugnante".split(),
    "threat": "kill murder rape lynch töten umbringen tuer violer matar asesinar".split(),
}
ADDRESS = re.compile(r"\b(?:you|u|your|du|ihr|tu|vous|eres|sois)\b[^.!?\n]{0,40}?\b(?:idiot|moron|stupid|loser|clown|trash|scum|pathetic|worthless|disgusting)", re.I)
DISGUISED = str.maketrans("013457@$", "oieastas")
WORDS = re.compile(r"[^\W\d_]+")
MIXED = re.compile(r"[^\W_]*[A-Za-z][0-9@$][0-9A-Za-z@$]*")
VOTERS = [*SEEDS, *(f"mined{k}" for k in range(SHARDS)), "mined often", "disguised", "addressed", "shouting"]
STEMS = (4, 5, 6, 7)


def entries(words: set[str]) -> set[str]:
    """Words, and stems of longer words marked by a star, that a mined lexicon may hold."""
    return {w for w in words if len(w) > 2} | {f"{w[:k]}*" for w in words for k in STEMS if len(w) > k}


@cache
def _upper() -> np.ndarray:
    return np.fromiter((chr(k).isupper() for k in range(0x110000)), bool, 0x110000)


def upper_case(text: str) -> int:
    """How many of all characters are upper case."""
    if len(text) < 200:
        return sum(map(str.isupper, text))
    return int(_upper()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")].sum())


class Voters:
    def __init__(self, mined: list[str]):
        self.mined = {x: k for k, x in enumerate(mined)}
        self.words = {x: k for x, k in self.mined.items() if not x.endswith("*")}
        self.stems = {n: {x[:-1]: k for x, k in self.mined.items() if x.endswith("*") and len(x) == n + 1} for n in STEMS}
        stems = sorted((s, theme) for theme, v in SEEDS.items() for s in v)
        self.seed = re.compile("|".join(re.escape(s) for s, _ in stems))
        self.theme = {s: list(SEEDS).index(t) for s, t in stems}

    def hits(self, words: set[str]) -> tuple[set[int], int]:
        """The mined entries found, and how many words they are in."""
        out, n = set(self.words[w] for w in words & self.words.keys()), 0
        for w in words:
            found = False
            for k, stems in self.stems.items():
                if len(w) > k and w[:k] in stems:
                    out.add(stems[w[:k]])
                    found = True
            n += found or w in self.words
        return out, n

    def vote(self, text: str | None) -> tuple[int, set[int]]:
        """The votes as bits in the order of VOTERS, and the mined entries found."""
        text = text or ""
        words = set(WORDS.findall(text.lower()))
        bits = 0
        for w in words:
            if m := self.seed.match(w):
                bits |= 1 << self.theme[m[0]]
        hits, n = self.hits(words)
        base = len(SEEDS)
        for k in hits:
            bits |= 1 << (base + k % SHARDS)
        base += SHARDS
        bits |= (n >= 3) << base
        bits |= any(self.seed.match(x.translate(DISGUISED).lower()) for x in MIXED.findall(text)) << (base + 1)
        bits |= bool(bits & 0b111) and bool(ADDRESS.search(text)) and 1 << (base + 2)  # its words are of the first three themes
        bits |= (upper_case(text) * 2 > len(text) > 20) << (base + 3)
        return bits, hits


def label_model(votes: np.ndarray, gold: np.ndarray, count: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, dict]:
    """Posterior of label 1 for each vote pattern. votes: patterns x voters (0/1); gold: 1, 0 or -1 for none."""
    n, rate = count.sum(), 0.05
    if (gold >= 0).any():
        rate = min(0.5, max(0.005, (count * (gold == 1)).sum() / max(1, (count * (gold >= 0)).sum())))
    fires = np.stack([np.full(votes.shape[1], 0.02), np.full(votes.shape[1], 0.5)])
    right = np.array([0.95, 0.95])  # annotators, by class
    weight = np.ones(votes.shape[1])
    rho = np.zeros((votes.shape[1],) * 2)
    for _ in range(rounds):
        like = [votes @ (weight * np.log(fires[y])) + (1 - votes) @ (weight * np.log1p(-fires[y])) for y in (0, 1)]
        said = [np.select([gold == y, gold == 1 - y], [np.log(right[y]), np.log1p(-right[y])], 0.0) for y in (0, 1)]
        odds = like[1] + said[1] - like[0] - said[0] + np.log(rate / (1 - rate))
        q = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
        rate = float(np.clip((count * q).sum() / n, 0.001, 0.6)) if n else rate
        rho[:] = 0
        for y, p in ((0, count * (1 - q)), (1, count * q)):
            total = p.sum()
            prior = (0.1, 5.0) if y == 0 else (1.0, 2.0)
            fires[y] = np.clip((p @ votes + prior[0]) / (total + prior[1]), 1e-5, 1 - 1e-5)
            known = p * (gold >= 0)
            right[y] = np.clip((p[gold == y].sum() + 19) / (known.sum() + 20), 0.6, 0.999)
            off = votes - fires[y]
            cov = (off * p[:, None]).T @ off / max(total, 1)
            sd = np.sqrt(np.diag(cov) + 1e-6)
            rho += cov / np.outer(sd, sd) / 2
        np.fill_diagonal(rho, 0)
        weight = 1 / (1 + np.clip(rho, 0, 1).sum(1))
    return q, {"rate": rate, "fires": fires, "annotators": right, "correlation": rho, "weight": weight}


def logistic(rows: list[list[int]], dims: int, target: np.ndarray, steps: int = 400, l2: float = 1e-4) -> np.ndarray:
    """Weights of dims binary features and, last, of the constant."""
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    at = np.fromiter((k for r in rows for k in r), np.int64, len(of))
    w, m, v = np.zeros(dims + 1), np.zeros(dims + 1), np.zeros(dims + 1)
    w[-1] = -2.0
    for t in range(1, steps + 1):
        z = np.bincount(of, w[at], len(rows)) + w[-1]
        gap = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - target) / max(1, len(rows))
        g = np.append(np.bincount(at, gap[of], dims), gap.sum()) + l2 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return w


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, bound: int) -> DataFrame:
    """text and toxic of the labelled rows that a fit may see."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = known.count()
    if n > bound:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < int(1e6 * bound / n))
    return docs.select(F.col("doc_id").alias("_of"), "text").join(F.broadcast(known), F.col("_of") == F.col("doc_id")).select("text", "toxic")


def _mapped(df: DataFrame, schema: str, f: Callable[[list], Iterator[tuple]]) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = list(f(list(zip(*(c.to_pylist() for c in batch.columns), strict=True))))
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)))

    return df.mapInArrow(run, schema)


def mine(sample: DataFrame, least: int = 4, ratio: float = 12.0) -> list[str]:
    """Entries that toxic texts of the sample, copies counted once, have `ratio` times as often as other rows, most frequent first."""
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return []
    some = lambda x: entries(set(WORDS.findall((x or "").lower())))

    def seen(rows: list) -> Iterator[tuple]:
        for (text,) in rows:
            found = some(text)
            print_ = min((crc32(e.encode()) for e in found if len(e) > 5 and e[-1] != "*"), default=0)
            yield from ((e, print_) for e in found)

    # copies of one text share its smallest word hash and count once, or their words would look like a lexicon
    often = _mapped(sample.where("toxic = 1").select("text"), "entry string, print long", seen)
    apart = often.select(F.countDistinct("print").alias("n")).first()["n"]
    often = often.groupBy("entry").agg(F.countDistinct("print").alias("n"))
    often = often.where(F.col("n") >= max(least, 0.01 * apart)).orderBy(F.desc("n"), "entry").limit(4 * MINED)
    often = {r["entry"]: r["n"] for r in often.collect()}

    def elsewhere(rows: list) -> Iterator[tuple]:
        yield from Counter(e for (text,) in rows for e in some(text) & often.keys()).items()

    rest = _mapped(sample.where("toxic = 0").select("text"), "entry string, n long", elsewhere).groupBy("entry").agg(F.sum("n").alias("n"))
    rest = {r["entry"]: r["n"] for r in rest.collect()}
    good = [(n, e) for e, n in often.items() if n / apart > ratio * (rest.get(e, 0) + 0.5) / clean]
    return [e for _, e in sorted(good, key=lambda x: (-x[0], x[1]))][:MINED]


def fit(docs: DataFrame, labels: DataFrame, bound: int = BOUND) -> tuple[list[str], np.ndarray]:
    """The mined lexicon and the classifier's weights."""
    sample = written(training_rows(docs, labels, bound), "toxicity-sample")
    mined = mine(sample)
    voters = Voters(mined)

    def votes(rows: list) -> Iterator[tuple]:
        for text, toxic in rows:
            bits, hits = voters.vote(text)
            yield bits, sorted(hits), toxic

    seen = _mapped(sample.select("text", "toxic"), "bits long, hits array<long>, toxic long", votes).collect()
    dims = len(mined) + len(VOTERS)
    if not seen:  # no labels: a vote is as likely as one in two on toxic texts, and two in a hundred on others
        return mined, np.append(np.full(dims, np.log(25.0)), np.log(0.05 / 0.95))
    counts = Counter((r["bits"], r["toxic"]) for r in seen)
    keys = sorted(counts)
    bits = np.array([[k >> j & 1 for j in range(len(VOTERS))] for k, _ in keys], float)
    q, _ = label_model(bits, np.array([g for _, g in keys]), np.array([counts[k] for k in keys], float))
    posterior = dict(zip(keys, q, strict=True))
    rows = [[*r["hits"], *(len(mined) + j for j in range(len(VOTERS)) if r["bits"] >> j & 1)] for r in seen]
    return mined, logistic(rows, dims, np.array([posterior[r["bits"], r["toxic"]] for r in seen]))


def score(docs: DataFrame, mined: list[str], weights: np.ndarray) -> DataFrame:
    """docs' rows as doc_id, score, votes."""
    voters, base, w = Voters(mined), len(mined), weights.tolist()

    def scored(rows: list) -> Iterator[tuple]:
        for doc_id, text in rows:
            bits, hits = voters.vote(text)
            z = w[-1] + sum(w[k] for k in sorted(hits)) + sum(w[base + j] for j in range(len(VOTERS)) if bits >> j & 1)
            yield doc_id, float(1 / (1 + np.exp(-min(40.0, max(-40.0, z))))), bits

    return _mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id long, score double, votes long", scored)


def kept(docs: DataFrame, mined: list[str], weights: np.ndarray) -> DataFrame:
    """The rows of docs, as they are, that the classifier does not call toxic. Texts are scored where they are read."""
    voters, base, w = Voters(mined), len(mined), weights.tolist()
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            stay = []
            for text in batch.column(place).to_pylist():
                bits, hits = voters.vote(text)
                stay.append(w[-1] + sum(w[k] for k in sorted(hits)) + sum(w[base + j] for j in range(len(VOTERS)) if bits >> j & 1) < 0)
            yield batch.filter(pa.array(stay, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, bound: int = BOUND) -> DataFrame:
    """doc_id, held_out, score, predicted, votes for each row of docs."""
    x = score(docs, *fit(docs, labels, bound))
    return x.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"), "votes")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op2_toxicity": op2_toxicity}
SQL: dict[str, str] = {}

"""Quality rules: simple text statistics, and bands of n-gram perplexity by language.

The language model is a modified Kneser-Ney model of UTF-8 bytes, one for each language, with no bound on its
n-grams. Executors count the n-grams of the highest order, with start marks, over all texts; Spark adds them up,
derives the lower orders' continuation counts and the discounts, and interpolates probabilities for all n-grams
seen. The model is written to the shared folder; executors fetch those files by Spark's file distribution, past
the driver's memory, and lay each language's n-grams out once as sorted arrays of keys and log probabilities on
disk, which their workers map and search by hash. Every n-gram of a scored text is in the model, as it was counted.

A document is rejected if a base rule fails, or if the logarithm of its perplexity lies outside its language's
band: the median, plus and minus `width` times the spread between quartiles as a normal deviation.

Nulls: a null text has no words (and so fails a base rule), a null language is a language of its own; repeated
rows get equal results, an empty table none. Other columns are ignored. Texts of any length are read whole.
"""

from __future__ import annotations

import os
import zlib
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import SMALL_ROWS, byte_slices, give_back, ship, table, written

ORDER, ENTRIES, CHUNK, SLOT_BITS = 5, 1 << 22, 1 << 22, 21
#: Languages whose model a worker has open at a time.
LANGUAGES = 16
SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
MASK = [0, *((1 << (8 * k)) - 1 for k in range(1, ORDER + 1))]


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ORDER-grams (as numbers) that end in each byte of the texts, and where each text's begin."""
    pad = b"\x00" * (ORDER - 1)
    raw = np.frombuffer(b"".join(pad + t for t in texts), np.uint8).astype(np.int64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    key = np.zeros(max(0, len(raw) - ORDER + 1), np.int64)
    for k in range(ORDER):
        key = (key << 8) | raw[k : len(raw) - ORDER + 1 + k]
    # windows that reach across the next text's padding are dropped
    starts = np.concatenate([[0], np.cumsum(sizes + ORDER - 1)[:-1]]).astype(np.int64) if len(texts) else sizes
    keep = np.ones(len(key), bool)
    for k in range(1, ORDER):
        edge = starts[1:] - k
        keep[edge[(edge >= 0) & (edge < len(key))]] = False
    return key[keep], np.concatenate([[0], np.cumsum(sizes)])


def _chunks(texts: list[bytes]) -> Iterator[list[bytes]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= CHUNK:
            yield part
            part, size = [], 0
    if part:
        yield part


def _by_language(batch: pa.RecordBatch, by: int = 1) -> dict:
    """Rows by their first columns: by the first alone, or by `by` of them as a tuple."""
    out: dict = {}
    for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        out.setdefault(row[0] if by == 1 else row[:by], []).append(row[by:])
    return out


def count_grams(docs: DataFrame) -> DataFrame:
    """lang, gram, n over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, 1, 2 * CHUNK):
            for lang, rows in _by_language(batch).items():
                for part in _chunks([(t or "").encode() for (t,) in rows]):
                    key, n = np.unique(grams(part)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(key), pa.array(n)], ["lang", "gram", "n"])

    counted = docs.select(F.col("lang").cast("string").alias("lang"), "text").mapInArrow(run, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def kneser_ney(counts: DataFrame) -> list[DataFrame]:
    """For each order from 0 up: lang, gram, n, logp, loggamma (the back-off weight of the gram as a context, if it is one)."""
    tables = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        tables[k] = written(tables[k + 1].groupBy("lang", F.col("gram").bitwiseAND(F.lit(MASK[k])).alias("gram")).agg(F.count(F.lit(1)).alias("n")), f"kn-{k}")
    lower, contexts, out = None, None, []
    for k in range(1, ORDER + 1):
        t = tables[k]
        n = [F.count(F.when(F.col("n") == i, 1)).cast("double") for i in (1, 2, 3, 4)]
        d = t.groupBy(F.col("lang").alias("_l")).agg(*[x.alias(f"n{i}") for i, x in enumerate(n, 1)])
        y = F.coalesce(F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2")), F.lit(0.5))
        cut = lambda i: F.least(F.lit(i - 0.05), F.greatest(F.lit(0.05), i - (i + 1) * y * F.coalesce(F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}")), F.lit(i / (i + 1)))))  # noqa: B023, E731
        d = d.select("_l", *[cut(i).alias(f"d{i}") for i in (1, 2, 3)])
        d = written(d, f"kn-discounts-{k}")
        t = t.join(F.broadcast(d) if d.count() <= SMALL_ROWS else d, _same("lang", "_l")).drop("_l").withColumn("ctx", F.shiftright("gram", 8))
        off = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        ctx = t.groupBy(F.col("lang").alias("_l"), F.col("ctx").alias("_c")).agg(F.sum("n").alias("total"), F.sum(off).alias("off"))
        ctx = written(ctx.select("_l", "_c", "total", (F.col("off") / F.col("total")).alias("gamma")), f"kn-contexts-{k}")
        t = t.join(ctx, _same("lang", "_l") & (F.col("ctx") == F.col("_c"))).withColumn("alpha", (F.col("n") - off) / F.col("total")).drop("_l", "_c")
        if lower is None:
            p = t.withColumn("p", F.col("alpha") + F.col("gamma") / 256)
            out.append(ctx.select(F.col("_l").alias("lang"), F.lit(0).cast("long").alias("gram"), F.col("total").alias("n"), F.lit(-np.log(256.0)).alias("logp"), F.log("gamma").alias("loggamma")))
        else:
            low = lower.select(F.col("lang").alias("_l"), F.col("gram").alias("_g"), F.col("p").alias("q"))
            p = t.join(low, _same("lang", "_l") & (F.col("gram").bitwiseAND(F.lit(MASK[k - 1])) == F.col("_g"))).withColumn("p", F.col("alpha") + F.col("gamma") * F.col("q"))
        p = written(p.select("lang", "gram", "n", "p"), f"kn-p-{k}")
        if lower is not None:  # gammas of this order's contexts belong to the order below
            g = ctx.select(F.col("_l"), F.col("_c").alias("_g"), F.log("gamma").alias("loggamma"))
            out.append(lower.join(g, _same("lang", "_l") & (F.col("gram") == F.col("_g")), "left").select("lang", "gram", "n", F.log("p").alias("logp"), "loggamma"))
            # contexts that hold start marks are no grams of their own
            out[-1] = out[-1].unionByName(g.join(lower.select("lang", "gram"), _same("lang", "_l") & (F.col("gram") == F.col("_g")), "left_anti").select(F.col("_l").alias("lang"), F.col("_g").alias("gram"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("logp"), "loggamma"))
        lower = p
    out.append(lower.select("lang", "gram", "n", F.log("p").alias("logp"), F.lit(None).cast("double").alias("loggamma")))
    return out


class Model:
    """One language's arrays: for each order sorted keys, log probabilities and back-off weights."""

    def __init__(self, orders: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.orders = orders
        keys = orders[-1][0]
        self.slots = np.zeros(1 << SLOT_BITS, np.int32)
        self.slots[self._slot(keys)] = np.arange(len(keys), dtype=np.int32)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted

    def backed(self, key: np.ndarray, k: int) -> np.ndarray:
        """Log probabilities of the k-grams in which the keys end."""
        keys, logp, _ = self.orders[k]
        if k == 0:
            return np.full(len(key), -np.log(256.0))
        at, hit = self._find(keys, key & MASK[k])
        out = logp[at].astype(np.float64) if len(logp) else np.full(len(key), np.nan)
        miss = np.flatnonzero(~hit | np.isnan(out))
        if len(miss):
            ckeys, _, gamma = self.orders[k - 1]
            cat, chit = self._find(ckeys, (key[miss] & MASK[k]) >> 8)
            weight = np.where(chit & ~np.isnan(gamma[cat]), gamma[cat], 0.0) if len(gamma) else 0.0
            out[miss] = self.backed(key[miss], k - 1) + weight
        return out

    def logp(self, key: np.ndarray) -> np.ndarray:
        keys, logp, _ = self.orders[-1]
        if not len(keys):
            return self.backed(key, ORDER)
        at = self.slots[self._slot(key)]
        out = logp[at].copy()
        miss = np.flatnonzero(keys[at] != key)
        if len(miss):
            some, back = np.unique(key[miss], return_inverse=True)
            out[miss] = self.backed(some, ORDER)[back]
        return out


def collected(orders: list[DataFrame]) -> dict:
    """language -> arrays by order on the driver, for texts outside the corpus (with back-off). Only for models of at most ENTRIES n-grams of one order."""
    out: dict = {}
    for k, t in enumerate(orders):
        if (rows := t.count()) > ENTRIES:
            raise ValueError(f"{rows} n-grams of one order are too many for the driver")
        x = t.select("lang", "gram", F.col("logp").cast("float"), F.col("loggamma").cast("float")).toArrow() if rows else None
        if x is None:
            continue
        langs = np.array([s or "" for s in x.column(0).to_pylist()])
        null = np.asarray(x.column(0).is_null())
        gram, logp, gamma = (x.column(c).to_numpy() for c in (1, 2, 3))
        for lang, isnull in {(a, bool(b)) for a, b in zip(langs.tolist(), null.tolist(), strict=True)}:
            own = np.flatnonzero((langs == lang) & (null == isnull))
            own = own[np.argsort(gram[own])]
            empty = (np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0, np.float32))
            out.setdefault(None if isnull else lang, [empty] * (ORDER + 1))[k] = (gram[own], logp[own].astype(np.float32), gamma[own].astype(np.float32))
    return out


def published(top: DataFrame) -> list[str]:
    """Writes the model of the highest order (lang, gram, logp) and has Spark send its files to executors; the files' names."""
    spark = top.sparkSession
    model = written(top.select(_key(F.col("lang")).alias("key"), "gram", F.col("logp").cast("float").alias("logp")).repartitionByRange("key", "gram"), "kn-model")
    files = sorted(model.inputFiles())
    for f in files:
        spark.sparkContext.addFile(f)
    return [f.rsplit("/", 1)[1] for f in files]


def _key(lang: Column) -> Column:
    """A language as the name of a file."""
    return F.when(lang.isNull(), "none").otherwise(F.lower(F.hex(F.xxhash64(lang))))


class Shelf:
    """One language's n-grams of the highest order: sorted keys and log probabilities, mapped from files that the executor's workers share."""

    def __init__(self, files: list[str], key: str):
        from pyspark import SparkFiles

        paths = [Path(SparkFiles.get(f)) for f in files]
        base = paths[0].parent / f"kn-{zlib.crc32(files[0].encode()):08x}-{key}"
        names = [base.with_suffix(".keys.npy"), base.with_suffix(".logp.npy")]
        if not names[1].exists():
            import pyarrow.dataset as ds

            x = ds.dataset([str(p) for p in paths], format="parquet").to_table(columns=["gram", "logp"], filter=ds.field("key") == key)
            gram, logp = (x.column(k).to_numpy() for k in range(2))
            order = np.argsort(gram)
            for name, values in zip(names, (gram[order], logp[order]), strict=True):  # complete before it has its name
                part = name.with_suffix(f".{os.getpid()}.npy")
                np.save(part, values)
                os.replace(part, name)
        self.keys, self.values = (np.load(n, mmap_mode="r") for n in names)
        self.slots = np.zeros(1 << SLOT_BITS, np.int32 if len(self.keys) < 1 << 31 else np.int64)
        for k in range(0, len(self.keys), CHUNK):
            self.slots[Model._slot(self.keys[k : k + CHUNK])] = np.arange(k, min(k + CHUNK, len(self.keys)))

    def logp(self, key: np.ndarray) -> np.ndarray:
        at = self.slots[Model._slot(key)].astype(np.int64)
        miss = np.flatnonzero(self.keys[at] != key)
        at[miss] = np.searchsorted(self.keys, key[miss])
        return self.values[at]


def base_rules(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    repeats = 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) < len(windows):
        n, upto = Counter(windows), 0
        for k, w in enumerate(windows):
            if n[w] > 1:
                repeats += k + 3 - max(k, upto)
                upto = k + 3
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeats


SCORED = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_perplexity double"


def scored(docs: DataFrame, files: list[str]) -> DataFrame:
    made: dict[str, Shelf] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, 3, CHUNK):
            out = [[] for _ in range(8)]
            for (lang, key), rows in _by_language(batch, 2).items():
                raw = [(t or "").encode() for _, t in rows]
                found, starts = grams(raw)
                if len(found):
                    if key not in made:
                        if len(made) >= LANGUAGES:
                            made.clear()
                        made[key] = Shelf(files, key)
                    total = np.concatenate([[0.0], np.cumsum(made[key].logp(found), dtype=np.float64)])
                for j, (doc_id, text) in enumerate(rows):
                    n = int(starts[j + 1] - starts[j])
                    row = (doc_id, lang, *base_rules(text or ""), float(total[starts[j]] - total[starts[j + 1]]) / n if n else None)
                    for col, v in zip(out, row, strict=True):
                        col.append(v)
            types = [pa.int64(), pa.string(), *[pa.int64()] * 5, pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], [x.split()[0] for x in SCORED.split(", ")])
        give_back()

    lang = F.col("lang").cast("string")
    return docs.select(lang.alias("lang"), _key(lang).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCORED)


def quality(docs: DataFrame, width: float = 5.0) -> DataFrame:
    """The base figures, base_failed, log_perplexity and kept for each row of docs."""
    ship(docs.sparkSession)
    files = published(kneser_ney(written(count_grams(docs), "kn-counts"))[-1])
    x = written(scored(docs, files), "quality")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    x = x.withColumn("base_failed", failed)
    q = F.percentile_approx("log_perplexity", [0.25, 0.5, 0.75], 10_000)
    bands = x.where(~F.col("base_failed")).groupBy(F.col("lang").alias("_l")).agg(q.alias("q"))
    spread = F.greatest((F.col("q")[2] - F.col("q")[0]) / 1.349, F.lit(0.005))
    bands = written(bands.select("_l", (F.col("q")[1] - width * spread).alias("low"), (F.col("q")[1] + width * spread).alias("high")), "quality-bands")
    few = bands.count() <= SMALL_ROWS
    x = x.join(F.broadcast(bands) if few else bands, _same("lang", "_l"), "left").drop("_l")
    inside = F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(False))
    return x.withColumn("kept", ~F.col("base_failed") & inside)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = quality(table(spark, sf_dir, "documents"))
    return x.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.exp("log_perplexity").alias("perplexity"))


QUERIES = {"op4_quality": op4_quality}
SQL: dict[str, str] = {}

"""Links of near duplicates at a Jaccard similarity of word shingles, for simhash.near_copies().

Candidates are the links of SimHash fingerprints by multi-index hashing, as op1 has them, and the shingles decide. Two
texts at a similarity of 0.8 differ in about ten of 64 bits, more than the halves of a fingerprint can find, so MinHash
bands add candidates to those links. A shingle counts as often as it occurs: the
elements of a text's set are its shingles' first, second, ... occurrences.

1. Documents with one set of shingles are one class, so copies never meet in pairs. Classes whose fingerprints differ
   in at most two bits are candidates.
2. Each class has BANDS keys, each of the minima of ROWS hash functions. A pair of similarity s shares a key with
   probability 1 - (1 - s ** ROWS) ** BANDS, at any number of documents: all but 5 in 10 ** 8 at 0.8, more above.
3. Classes are compared with those that their fingerprints link to, and classes with one key with the smallest of
   them; pairs whose sizes alone rule the similarity out are left aside. Groups that are connected by then are done.
4. The others are dealt to blocks of at most SHINGLES shingles and MEMBERS classes, and each pair of blocks is
   compared by one matrix product in a worker. A pair of blocks returns one row a class at most, its link to the
   smallest class that the block's links reach, so no pairs are written, whatever a group's size.
5. Components of the links.

Nulls: a null or blank text has no shingle; such texts are copies of each other. A null doc_id is no component's
smallest id unless all its ids are null. An empty table gives no rows. Texts of any length are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.components import connected_components

from ._common import ship, slices, with_groups, written

SEED, ROWS, BANDS = 42, 4, 32
SHINGLES, MEMBERS, COLUMNS = 1 << 20, 2048, 2048
#: The similarity from which on documents link is LEAST[0] / LEAST[1].
LEAST = (4, 5)
_rng = np.random.default_rng(SEED)
_XOR, _ODD, _MIX = (_rng.integers(0, 1 << 64, n, dtype=np.uint64) | np.uint64(1) for n in (ROWS * BANDS, ROWS * BANDS, ROWS))


def hashes(text: str | None, width: int) -> np.ndarray:
    """Hashes of the text's shingles, repeats included; a text of fewer words is one shingle."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, "<u8")
    n = max(1, len(words) - width + 1)
    each = map(b" ".join, zip(*(words[k:] for k in range(width)))) if len(words) > width else [b" ".join(words)]
    return np.fromiter(map(xxhash.xxh64_intdigest, each, repeat(SEED)), "<u8", n)


def majority(found: np.ndarray) -> int:
    """The fingerprint of a text's hashes, signed: a bit is set where more than half of them have it set."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(found), 1 << 16):
        bits = np.unpackbits(found[k : k + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += bits.sum(0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(found), bitorder="little").view("<i8")[0])


def shingles(text: str | None, width: int) -> np.ndarray:
    """Hashes of the text's shingles, told apart by occurrence."""
    return occurrences(hashes(text, width))


def occurrences(found: np.ndarray) -> np.ndarray:
    if not len(found):
        return found
    found, n = np.sort(found), len(found)
    starts = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
    earlier = np.arange(n) - np.repeat(starts, np.diff(starts, append=n))
    return np.sort(found + earlier.astype(np.uint64) * _MIX[1])


def bands(found: np.ndarray) -> np.ndarray:
    """The keys of a set of shingles, as signed numbers."""
    low = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(found), 1024):
        low = np.minimum(low, ((found[None, k : k + 1024] ^ _XOR[:, None]) * _ODD[:, None]).min(1))
    low ^= low >> np.uint64(29)
    keys = (low.reshape(BANDS, ROWS) * _MIX).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    keys = (keys ^ keys >> np.uint64(32)) * _MIX[0]
    return keys.view(np.int64)


def classes_of(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, h1, h2 (hashes of the text), class (of equal sets of shingles), n (shingles), print (fingerprint), keys."""
    kind = "doc_id long, h1 long, h2 long, class long, n int, print long, keys array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in slices(batches):
            found = [hashes(x, width) for x in batch.column(3).to_pylist()]
            prints = pa.array([majority(x) for x in found], pa.int64())
            sets = [occurrences(x) for x in found]
            same = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
            keys = pa.array([bands(x) if len(x) else x.view(np.int64) for x in sets], pa.list_(pa.int64()))
            columns = [*batch.columns[:3], pa.array(same), pa.array([len(x) for x in sets], pa.int32()), prints, keys]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "h1", "h2", "class", "n", "print", "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_hashes(), "text").mapInArrow(run, kind)


def text_hashes() -> list:
    return [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2")]


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """class, n, set of the wanted classes, each from one text (h1, h2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = pa.array([shingles(x, width).view(np.int64) for x in batch.column(1).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), sets], ["class", "set"])

    texts = docs.select(*text_hashes(), "text").join(wanted, ["h1", "h2"])
    texts = texts.groupBy("class").agg(F.first("text").alias("text"))
    return texts.mapInArrow(run, "class long, set array<long>")


def print_links(classes: DataFrame) -> DataFrame:
    """(x, y), x > y: pairs of classes that connect all whose fingerprints (`print`) differ in two bits at most, found by multi-index hashing."""
    from .simhash import links

    least = written(classes.groupBy("print").agg(F.min("class").alias("low")), "simhash-prints")
    own = classes.join(least, "print").where("class > low").select(F.col("class").alias("x"), F.col("low").alias("y"))
    ends = links(least.select("print")).join(least.toDF("x", "a"), "x").join(least.toDF("y", "b"), "y")
    return own.union(ends.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y"))).distinct()


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the distinct pairs (x, y) whose sets are similar."""
    pairs = pairs.join(sets.toDF("x", "a"), "x").join(sets.toDF("y", "b"), "y")
    both = F.size(F.array_intersect("a", "b"))
    return pairs.where(both * sum(LEAST) >= (F.size("a") + F.size("b")) * LEAST[0]).select("x", "y")


def _linked(sets: list[np.ndarray], of: np.ndarray) -> np.ndarray:
    """For each set the smallest place that links of similar sets with different `of` reach, its own if none."""
    n = np.array([len(x) for x in sets])
    name, each = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), n)
    often = np.bincount(each, minlength=len(name)) > 1  # others are in no intersection
    row, each = row[often[each]], (np.cumsum(often) - 1)[each[often[each]]]
    order = np.argsort(each, kind="stable")
    row, each = row[order], each[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for k in range(0, int(often.sum()), COLUMNS):
        a, b = np.searchsorted(each, [k, k + COLUMNS])
        held = np.zeros((len(sets), COLUMNS), np.float32)
        held[row[a:b], each[a:b] - k] = 1
        both += held @ held.T
    near = both * sum(LEAST) >= (n[:, None] + n) * LEAST[0]
    near &= of[:, None] != of
    low = np.arange(len(sets))
    x, y = np.nonzero(near)
    while len(x):
        old = low.copy()
        np.minimum.at(low, x, old[y])
        low = np.minimum(low, low[low])
        if (low == old).all():
            break
    return low


def _block_links(side: DataFrame, sets: DataFrame) -> DataFrame:
    """(x, y): links that connect the similar classes of each key's group (key, class, n, of, blocks)."""

    def links(rows: list[tuple]) -> tuple[list, list]:
        names = [r[0] for r in rows]
        low = _linked([r[2] for r in rows], np.array([r[1] for r in rows]))
        at = np.flatnonzero(low != np.arange(len(low))).tolist()
        return [names[k] for k in at], [names[low[k]] for k in at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows = None, []

        def told() -> Iterator[pa.RecordBatch]:
            if len(rows) > 1 and len({r[1] for r in rows}) > 1:
                x, y = links(rows)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["x", "y"])

        for batch in slices(batches):
            for key, a, b, name, of, found in zip(*(c.to_pylist() if k < 5 else c for k, c in enumerate(batch.columns)), strict=True):
                if (key, a, b) != last:
                    yield from told()
                    last, rows = (key, a, b), []
                rows.append((name, of, found.values.to_numpy()))
        yield from told()

    mine = F.pmod(F.xxhash64("class", F.lit(3)), F.col("blocks")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("mine", j).alias("a"), F.greatest("mine", j).alias("b")))
    dealt = side.withColumn("mine", mine).select("key", "class", "of", F.explode(pair).alias("p")).select("key", "p.a", "p.b", "class", "of")
    dealt = dealt.join(sets.select(F.col("class").alias("_c"), "set"), F.col("class") == F.col("_c")).select("key", "a", "b", "class", "of", "set")
    return dealt.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "class").mapInArrow(run, "x long, y long")


def near_copies(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, h1, h2 (hashes of the text), root (of the component), component_id for each row of docs: the smallest doc_id that similar texts reach, itself included."""
    ship(docs.sparkSession)
    slim = written(classes_of(docs, width), "minhash")
    classes = slim.groupBy("class").agg(F.min("n").alias("n"), F.min(F.struct("h1", "h2")).alias("text"), F.first("print").alias("print"), F.first("keys").alias("keys"))
    classes = written(classes, "minhash-classes")
    prints = written(print_links(classes.select("class", "print")), "simhash-links")
    keyed = classes.select("class", "n", F.explode("keys").alias("key"))
    keyed = with_groups(keyed, ["key"], [F.min("class").alias("low"), F.max("class").alias("high"), F.min_by("n", "class").alias("m")])
    keyed = written(keyed.where("low < high").drop("high"), "minhash-keys")
    wanted = keyed.select("class").union(prints.select("x")).union(prints.select("y")).distinct()
    wanted = classes.join(wanted, "class", "left_semi").select("class", "text.h1", "text.h2")
    sets = written(_sets(docs, wanted, width), "minhash-sets")
    fits = lambda n, m: F.least(n, m) * LEAST[1] >= F.greatest(n, m) * LEAST[0]
    star = keyed.where((F.col("class") != F.col("low")) & fits("n", "m")).select(F.col("class").alias("x"), F.col("low").alias("y"))
    # the smallest first: it connects a large group by one pair a member, so that few pairs are left
    smallest = [x.groupBy("x").agg(F.min("y").alias("y")) for x in (prints, star)]
    once = written(_similar(smallest[0].union(smallest[1]).distinct(), sets), "minhash-once")
    joined = written(connected_components(once), "minhash-joined")
    ends = joined.select("node", "component")
    star = star.union(prints).distinct().join(ends.toDF("x", "of_x"), "x", "left").join(ends.toDF("y", "of_y"), "y", "left")
    star = star.where(F.coalesce("of_x", "x") != F.coalesce("of_y", "y")).select("x", "y")
    star = written(once.union(_similar(star, sets)), "minhash-star")
    joined = written(connected_components(star), "minhash-joined")
    side = keyed.join(joined, F.col("class") == F.col("node"), "left").select("key", "class", "n", F.coalesce("component", "class").alias("of"))
    # a key's group that is connected by now has no pair left
    ends = [F.min("of").alias("a"), F.max("of").alias("b"), F.sum(F.col("n").cast("long")).alias("all"), F.count(F.lit(1)).alias("members")]
    side = with_groups(written(side, "minhash-side"), ["key"], ends).where("a < b")
    blocks = F.greatest(F.ceil(F.col("all") / SHINGLES), F.ceil(F.col("members") / MEMBERS)).cast("int").alias("blocks")
    side = written(side.select("key", "class", "n", "of", blocks), "minhash-open")
    rest = written(_block_links(side, sets), "minhash-rest")
    joined = connected_components(star.union(rest))
    rooted = slim.drop("n", "print", "keys").join(joined, F.col("class") == F.col("node"), "left").select("doc_id", "h1", "h2", F.coalesce("component", "class").alias("root"))
    rooted = written(rooted, "minhash-rooted")
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rooted.join(least, "root").select("doc_id", "h1", "h2", "root", "component_id")

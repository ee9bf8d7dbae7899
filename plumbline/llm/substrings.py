"""Substring dedup over words by recompression.

Rounds of run and pair compression give each text ever larger symbols. A symbol's name is a hash of what it
stands for, and whether two symbols pair up depends on their names alone, so naming is global without any
exchange: equal stretches of text get equal symbols, except near their ends. For each symbol the rounds keep
track of the words that determined it. Two equal windows of `width` words therefore hold the same symbols,
as far as those were determined inside the window, and the highest of these, smallest hash first, is the
window's mark. The lowest level, the single word, always gives one.

1. Executors compress texts and send each text's distinct marks. A mark that several texts have is shared.
2. Texts with shared marks come back once more; their windows with a shared mark get a 128-bit hash of their
   words, which verifies the repeat.
3. A window that also starts in a document with a smaller doc_id marks its words for removal.

Both times a batch settles among its own texts what it can: what it has settled is dealt by document, and of the
rows that are dealt by mark or window there is at most one for each batch, whatever the number of documents that
hold it. A text whose exact copy has a smaller doc_id takes no part: all its windows go. Texts are shuffled once,
by the hash of doc_id and text that names a row; both later steps read the same exchange.

Windows are judged on the input. Nulls: a null text has no words; a null doc_id comes before all others.
Rows that repeat a doc_id tie, and a tie removes nothing, whether their texts are equal or not. Texts shorter than a window, empty texts and empty tables come back as they are. Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import give_back, ship, slices, table, with_groups, word_array, written

WIDTH, ROUNDS, CHUNK = 13, 2, 1 << 21
FAR = 1 << 40
ODD = np.uint64(0x9E3779B97F4A7C15)
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
NO_ID = -(1 << 63)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of ODD and of its inverse, as many as were asked for so far."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            inverse = np.uint64(pow(int(ODD), -1, 1 << 64))
            cls.up, cls.down = (np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, x, np.uint64)])) for x in (ODD, inverse))
        return cls.up, cls.down


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the values in [start, end), from running sums."""
    up, down = Powers.of(len(values) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum((values + np.uint64(1)) * up[: len(values)], dtype=np.uint64)])
    return mix((total[end] - total[start]) * down[start])


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the number of each text's first word (one more than texts)."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    blank = BLANK[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank])))
    start, end = edge[::2], edge[1::2]
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return span_hashes(raw.astype(np.uint64), start, end), np.searchsorted(start, offsets)


def levels(word: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each level from 0 up: where the words begin and end that determine its symbols (beyond the text: far off)."""
    n = len(word)
    name, low, high = word, np.arange(n), np.arange(1, n + 1)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    yield low, high
    for level in range(1, ROUNDS + 1):
        # runs: the symbols on both sides show where a run ends
        same = np.concatenate([[False], (name[1:] == name[:-1]) & (doc[1:] == doc[:-1])]) if len(name) else np.zeros(0, bool)
        at = np.flatnonzero(~same)
        length = np.diff(np.append(at, len(name)))
        last = at + length - 1
        fresh, doc_ = name[at], doc[at]
        fresh = np.where(length > 1, mix(fresh + length.astype(np.uint64) * ODD), fresh)
        joined = np.concatenate([[False], doc_[1:] == doc_[:-1]]) if len(at) else np.zeros(0, bool)
        before = np.where(joined, low[np.maximum(at - 1, 0)], -FAR)
        after = np.where(np.append(joined[1:], False) if len(at) else joined, high[np.minimum(last + 1, len(name) - 1)], FAR)
        name, low, high, doc = fresh, np.minimum(before, low[at]), np.maximum(after, high[last]), doc_
        # pairs: a left symbol joins the right symbol after it
        right = (mix(name ^ np.uint64(level)) & np.uint64(1)).astype(bool)
        next_in = np.append(doc[1:] == doc[:-1], False) if len(name) else np.zeros(0, bool)
        pair = ~right & np.append(right[1:], False) & next_in
        prev_in = np.concatenate([[False], next_in[:-1]]) if len(name) else next_in
        second = np.concatenate([[False], pair[:-1]]) if len(name) else pair
        up, down = np.roll(np.arange(len(name)), -1), np.roll(np.arange(len(name)), 1)
        low2 = np.where(pair, np.minimum(low, low[up]), np.where(right, np.where(prev_in, np.minimum(low, low[down]), -FAR), low))
        high2 = np.where(pair, np.maximum(high, high[up]), np.where(right, high, np.where(next_in, np.maximum(high, high[up]), FAR)))
        named = np.where(pair, mix(name * ODD + mix(name[up])), name)
        keep = ~second
        name, low, high, doc = named[keep], low2[keep], high2[keep], doc[keep]
        yield low, high


def marks(word: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The mark of the window that starts at each word, and whether a window fits there."""
    n = len(word)
    best = np.full(n, ~np.uint64(0))
    for level, (low, high) in enumerate(levels(word, first)):
        ok = np.flatnonzero((high - low <= width) & (low >= 0) & (high <= n))
        # of symbols that begin to be determined at one word, the one that is soonest complete
        ok = ok[np.lexsort((high[ok], low[ok]))]
        low_, high_ = low[ok], high[ok]
        once = np.concatenate([[True], low_[1:] != low_[:-1]]) if len(ok) else np.zeros(0, bool)
        low_, high_ = low_[once], high_[once]
        rank = np.uint64(ROUNDS - level) << np.uint64(62)
        key, size = np.full(n, ~np.uint64(0)), np.full(n, width + 1)
        key[low_] = (mix(span_hashes(word, low_, high_) + np.uint64(level)) >> np.uint64(2)) | rank
        size[low_] = high_ - low_
        for back in range(width):
            if back >= n:
                break
            fits = np.where(size[back:] <= width - back, key[back:], ~np.uint64(0))
            np.minimum(best[: n - back], fits, out=best[: n - back])
    room = np.repeat(first[1:], np.diff(first)) - np.arange(n) >= width
    return best.view(np.int64), room


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    at = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK or k == len(texts) - 1:
            yield at, texts[at : k + 1]
            at, size = k + 1, 0


def _arrow(schema: str, *columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "string": pa.string()}
    parts = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kinds[k]) for c, (_, k) in zip(columns, parts, strict=True)], [p[0] for p in parts])


def shared_marks(docs: DataFrame, width: int) -> DataFrame:
    """(row, mark) of the texts of `docs` (row, text) with a mark that another text has."""
    schema = "row long, mark long, known boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: dict[bytes, int] = {}
            for i, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own.setdefault(t.encode(), i)
            texts, rows, found, of = list(own), np.fromiter(own.values(), np.int64, len(own)), [], []
            for at, part in _chunks(texts):
                word, first = words_of(part)
                mark, room = marks(word, first, width)
                doc = np.repeat(np.arange(at, at + len(part)), np.diff(first))
                new = room & np.concatenate([[True], (mark[1:] != mark[:-1]) | (doc[1:] != doc[:-1])])[: len(mark)]
                found.append(mark[new])
                of.append(doc[new])
            if not found:
                continue
            mark, doc = np.concatenate(found), np.concatenate(of)
            order = np.lexsort((doc, mark))
            mark, doc = mark[order], doc[order]
            new = np.concatenate([[True], (mark[1:] != mark[:-1]) | (doc[1:] != doc[:-1])])[: len(mark)]
            mark, doc = mark[new], doc[new]
            start = np.flatnonzero(np.concatenate([[True], mark[1:] != mark[:-1]])[: len(mark)])
            several = np.repeat(np.diff(np.append(start, len(mark))) > 1, np.diff(np.append(start, len(mark))))
            by = np.argsort(doc, kind="stable")  # neighbours in one row make for small files
            yield _arrow(schema, rows[doc[by]], mark[by], several[by])
            # others may share the mark with one text of these, so one of them stands for all
            if len(ahead := start[several[start]]):
                yield _arrow(schema, rows[doc[ahead]], mark[ahead], np.zeros(len(ahead), bool))
        give_back()

    sent = docs.mapInArrow(run, schema)
    other = W.partitionBy("mark", F.when(F.col("known"), F.col("row")))
    sent = sent.withColumn("shared", F.col("known") | (F.min("row").over(other) < F.max("row").over(other)))
    return sent.where("shared").select("row", "mark")


def repeated_windows(texts: DataFrame, width: int) -> DataFrame:
    """(row, id, place, more): windows of `texts` (row, id, text, marks) that start in a document with a smaller id too. Several rows may name a text's places."""
    schema = "h1 long, h2 long, row long, id long, place int, more array<int>, known boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            holders: dict[bytes, dict[tuple[int, int], list[int]]] = {}
            for row, i, t, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = t.encode()
                word, first = words_of([raw])
                mark, room = marks(word, first, width)
                at = np.flatnonzero(room & np.isin(mark, np.array(wanted, np.int64)))
                words, me = raw.split(), (i, row)
                for s in at.tolist():
                    holders.setdefault(xxhash.xxh3_128_digest(b" ".join(words[s : s + width])), {}).setdefault(me, []).append(s)
            gone: dict[tuple[int, int], list[int]] = {}
            rows = []
            for h, by in holders.items():
                least = min(by)[0]
                for me, places in by.items():
                    if me[0] > least:
                        gone.setdefault(me, []).extend(places)
                    else:
                        rows.append((h, me, places))
            h = np.frombuffer(b"".join(r[0] for r in rows), np.int64).reshape(-1, 2)
            yield _arrow(schema, h[:, 0], h[:, 1], [r[1][1] for r in rows], [r[1][0] for r in rows], [r[2][0] for r in rows], [r[2][1:] or None for r in rows], [False] * len(rows))
            yield _arrow(schema, [k[0] for k in gone], [k[1] for k in gone], [k[1] for k in gone], [k[0] for k in gone], [v[0] for v in gone.values()], [v[1:] or None for v in gone.values()], [True] * len(gone))
        give_back()

    found = texts.select("row", "id", "text", "marks").mapInArrow(run, schema)
    same = W.partitionBy("h1", "h2", F.when(F.col("known"), F.col("row")))
    return found.withColumn("gone", F.col("known") | (F.col("id") > F.min("id").over(same))).where("gone").select("row", "id", "place", "more")


def removals(texts: DataFrame, width: int) -> DataFrame:
    """(row, id, n_removed, starts, ends, kept_sha256) of `texts` (row, id, text, found: ids, place and more)."""
    schema = "row long, id long, n_removed long, starts array<int>, ends array<int>, kept_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = [[] for _ in range(6)]
            for row, i, t, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = t.encode().split()
                places = [[x["place"], *(x["more"] or [])] for x in found if x["id"] == i]
                step = np.zeros(len(words) + 1, np.int64)
                at = np.unique(np.concatenate([np.array(x, np.int64) for x in places])) if places else np.zeros(0, np.int64)
                step[at] += 1
                step[at + width] -= 1
                cover = np.concatenate([[False], np.cumsum(step)[:-1] > 0, [False]])
                edge = np.flatnonzero(np.diff(cover))
                kept, last = [], 0
                for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                    kept += words[last:a]
                    last = b
                kept += words[last:]
                for col, v in zip(out, (row, i, len(words) - len(kept), edge[::2].tolist(), edge[1::2].tolist(), hashlib.sha256(b" ".join(kept)).hexdigest()), strict=True):
                    col.append(v)
            yield _arrow(schema, *out)

    return texts.select("row", "id", "text", "found").mapInArrow(run, schema)


def facts(docs: DataFrame) -> DataFrame:
    """row, id, 128 bits of the text's hash, number of words, SHA-256 of the words joined."""
    schema = "row long, id long, h1 long, h2 long, n_words long, sha string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in slices(batches, 2000):
            out = [[] for _ in range(4)]
            for t in batch.column(2).to_pylist():
                raw = t.encode()
                words, h = raw.split(), xxhash.xxh3_128_intdigest(raw)
                for col, v in zip(out, ((h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63), len(words), hashlib.sha256(b" ".join(words)).hexdigest()), strict=True):
                    col.append(v)
            yield _arrow(schema, *batch.columns[:2], *out)

    return docs.select("row", "id", "text").mapInArrow(run, schema)


def rows_of(docs: DataFrame) -> DataFrame:
    """row (a hash of doc_id and text), id (doc_id, with a stand-in for null), text (null: empty)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.xxhash64(F.col("doc_id").cast("long"), text).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), text.alias("text"))


def dedup_substrings(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed, starts and ends of the removed runs of words, kept_sha256, for each row of docs."""
    ship(docs.sparkSession)
    rows = rows_of(docs)
    known = with_groups(written(facts(rows), "substring-facts"), ["h1", "h2"], [F.min("id").alias("least")])
    known = written(known.withColumn("copy", (F.col("id") > F.col("least")) & (F.col("n_words") >= width)).drop("least", "h1", "h2"), "substring-copies")
    wanted = shared_marks(rows.select("row", "text"), width).join(known.where("copy").select("row"), "row", "left_anti").groupBy("row").agg(F.collect_set("mark").alias("marks"))
    found = repeated_windows(rows.join(wanted.withColumnRenamed("row", "of"), F.col("row") == F.col("of")), width)
    found = found.groupBy(F.col("row").alias("of")).agg(F.collect_list(F.struct("id", "place", "more")).alias("found"))
    gone = removals(rows.join(found, F.col("row") == F.col("of")), width)
    gone = gone.dropDuplicates(["row", "id"]).select(F.col("row").alias("_row"), F.col("id").alias("_id"), "n_removed", "starts", "ends", "kept_sha256")
    out = known.join(gone, (F.col("row") == F.col("_row")) & (F.col("id") == F.col("_id")), "left")
    copy, none = F.col("copy"), F.array().cast("array<int>")
    return out.select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"),
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.array(F.lit(0))).otherwise(F.coalesce("starts", none)).alias("starts"),
        F.when(copy, F.array(F.col("n_words").cast("int"))).otherwise(F.coalesce("ends", none)).alias("ends"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def kept_texts(docs: DataFrame, result: DataFrame) -> DataFrame:
    """doc_id, kept: the words that are left of each document, joined by one space. For documents with distinct ids."""
    spans = result.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "starts", "ends")
    words = docs.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), word_array(F.col("text")).alias("words")).join(spans, "id")
    bounds = F.zip_with(F.concat(F.array(F.lit(0)), "ends"), F.concat("starts", F.array(F.size("words"))), lambda a, b: F.struct(a.alias("a"), (b - a).alias("n")))
    return words.select("doc_id", F.array_join(F.flatten(F.transform(bounds, lambda x: F.slice("words", x["a"] + 1, x["n"]))), " ").alias("kept"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


QUERIES = {"op6_substrings": op6_substrings}
SQL = {
    "op6_substrings": r"""WITH d AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS x, generate_subscripts(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''), 1) AS i FROM documents),
 h AS (SELECT doc_id, i, x, string_agg(x, ' ') OVER p AS k, count(*) OVER p AS n FROM d WINDOW p AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
 m AS (SELECT k, min(doc_id) AS least FROM h WHERE n = 13 GROUP BY k),
 g AS (SELECT doc_id, i FROM h JOIN m USING (k) WHERE n = 13 AND doc_id > least),
 r AS (SELECT DISTINCT doc_id, i + j AS i FROM g, (SELECT unnest(range(13)) AS j)),
 z AS (SELECT d.doc_id, count(*) AS n_words, count(r.i) AS n_removed, string_agg(CASE WHEN r.i IS NULL THEN x END, ' ' ORDER BY d.i) AS kept FROM d LEFT JOIN r ON d.doc_id = r.doc_id AND d.i = r.i GROUP BY d.doc_id)
 SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN z USING (doc_id)"""
}

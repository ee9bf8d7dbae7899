"""Substring dedup over bytes with suffix arrays built by linear grouping.

Each byte covered by a string of `width` bytes that also starts earlier (in a document with a smaller doc_id,
or earlier in the same one) is removed. Strings are judged on the input, and never cross documents.

1. A window of `width` bytes is marked by the smallest hash of its GRAM-byte pieces. A mark that occurs in one
   run of windows only can't belong to a repeat. Batches settle what they can among their own texts, so a mark
   reaches the shuffle at most once for each batch.
2. Texts with shared marks come back; each run of windows with one shared mark becomes a passage. Of equal
   passages the earliest stands for all, and the windows of the others go.
3. Passages with a mark in common but different bytes are sorted by suffix: a task cuts the passages that it
   gets down to windows whose hash is not alone, concatenates them and builds their suffix array. suffix_array() groups suffixes by their Lyndon prefixes: groups
   are taken in descending order, each member points to the nearest position before it in a lower group, and
   the positions pointed at split off as new groups; a second pass emits every group's order from the front.
   There is no recursion and no renaming. Neighbours in that order that agree in `width` bytes are repeats.
   Marks whose different passages have more than CROWD bytes take another way, exact too, so that no task gets
   an unbounded group: their windows are compared by 128-bit hashes, with the earliest of each task first.

Nulls: a null text is empty, a null doc_id comes before all others; rows that repeat a doc_id are one
document each, and a tie removes nothing. Empty and short texts, and empty tables, come back as they are.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import give_back, ship, slices, table, with_groups, written
from .substrings import NO_ID, rows_of, span_hashes

WIDTH, GRAM, CHUNK, CROWD, BLOCK = 100, 32, 1 << 21, 1 << 20, 1 << 18


def suffix_array(s: list[int]) -> list[int]:
    """Order of the suffixes of s, whose last number must be smaller than all others."""
    n = len(s)
    count = [0] * (max(s) + 2)
    for c in s:
        count[c + 1] += 1
    for c in range(1, len(count)):
        count[c] += count[c - 1]
    group = [count[c] for c in s]  # a group is named by the place where it starts
    size = [0] * (n + 1)
    order, place = [0] * n, [0] * n
    for i in range(n):
        g = group[i]
        at = g + size[g]
        size[g] += 1
        order[at], place[i] = i, at
    before = [-1] * n
    end = n
    while end > 0:
        g = group[order[end - 1]]
        members = order[g:end]
        members.sort()
        pointed: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and group[p] >= g:
                p = before[p]
            before[i] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        end = g
        if not pointed:
            continue
        if len(pointed) == 1 or max(pointed.values()) == 1:
            waves = [list(pointed)]
        else:  # more members in a row make a larger prefix
            by: dict[int, list[int]] = {}
            for p, k in pointed.items():
                by.setdefault(k, []).append(p)
            waves = [by[k] for k in sorted(by, reverse=True)]
        for wave in waves:
            for p in wave:  # to the end of the group
                h = group[p]
                size[h] -= 1
                at, to = place[p], h + size[h]
                if at != to:
                    q = order[to]
                    order[at], order[to] = q, p
                    place[q], place[p] = at, to
            for p in wave:  # and off
                h = group[p]
                fresh = h + size[h]
                group[p] = fresh
            for p in wave:
                size[group[p]] += 1
    # the second pass: suffixes in front bring in those whose next smaller suffix they are
    done = [False] * n
    filled = [0] * n
    order[0] = n - 1
    done[n - 1] = True
    for at in range(n):
        p = order[at] - 1
        while p >= 0 and not done[p]:
            g = group[p]
            order[g + filled[g]] = p
            filled[g] += 1
            done[p] = True
            p = before[p]
    return order


def marks(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one mark: mark, number of the text, first window's start, windows in the run, and
    whether windows of the run can be equal: then the first mark in the earlier one lies before the later one's start,
    so a window before the run's last starts with the mark."""
    gram = min(GRAM, width)
    raw = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    n = len(raw) - width + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    start = np.arange(len(raw) - gram + 1)
    piece = low = span_hashes(raw, start, start + gram)
    del raw
    reach, span = width - gram + 1, 1
    while span * 2 <= reach:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < reach:
        low = np.minimum(low[: n], low[reach - span : reach - span + n])
    low = low[:n].view(np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    doc = np.repeat(np.arange(len(texts)), sizes)[:n]
    room = np.arange(n) + width <= first[doc + 1]
    new = room & np.concatenate([[True], (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])])
    edge = np.flatnonzero(new)
    # a run ends at the next run, or where windows no longer fit into the text
    last = np.minimum(np.append(edge[1:], n), np.maximum(first[doc[edge] + 1] - width + 1, 0))
    starts = np.concatenate([[0], np.cumsum(piece[:n].view(np.int64) == low)])
    return low[edge], doc[edge], edge - first[doc[edge]], last - edge, starts[last - 1] > starts[edge]


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    at = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK or k == len(texts) - 1:
            yield at, texts[at : k + 1]
            at, size = k + 1, 0


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "string": pa.string(), "binary": pa.binary()}
    parts = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, parts, strict=True)], [p[0] for p in parts])


def shared_marks(docs: DataFrame, width: int) -> DataFrame:
    """(row, mark) of the texts of `docs` (row, text) with a mark that another run of windows has too."""
    schema = "row long, mark long, known boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: dict[bytes, int] = {}
            for i, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own.setdefault(t.encode(), i)
            rows, found, of, again = np.fromiter(own.values(), np.int64, len(own)), [], [], []
            for at, part in _chunks(list(own)):
                mark, doc, _, _, twice = marks(part, width)
                again.append(twice)
                found.append(mark)
                of.append(doc + at)
            if not found or not sum(map(len, found)):
                continue
            mark, doc = np.concatenate(found), np.concatenate(of)
            order = np.argsort(mark, kind="stable")
            mark, doc = mark[order], doc[order]
            start = np.flatnonzero(np.concatenate([[True], mark[1:] != mark[:-1]]))
            runs = np.diff(np.append(start, len(mark)))
            several = np.repeat((runs > 1) | (np.add.reduceat(np.concatenate(again)[order], start) > 0), runs)
            by = np.argsort(doc, kind="stable")  # neighbours in one row make for small files
            yield _batch(schema, [rows[doc[by]], mark[by], several[by]])
            ahead = start[several[start]]  # for other batches' texts
            yield _batch(schema, [rows[doc[ahead]], mark[ahead], np.zeros(len(ahead), bool)])
        give_back()

    sent = docs.mapInArrow(run, schema)
    return sent.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("mark", F.when(F.col("known"), F.col("row"))))).where("known or n > 1").select("row", "mark")


def passages(texts: DataFrame, width: int) -> DataFrame:
    """Runs of windows with a shared mark: the bytes, and the run's place. known: an equal one precedes it."""
    schema = "mark long, h1 long, h2 long, id long, row long, start long, windows long, body binary, twice boolean, known boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            earliest: dict[tuple[int, bytes], tuple] = {}
            gone, ties = [], []
            for i, row, t, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = t.encode()
                mark, _, start, windows, twice = marks([raw], width)
                some = np.flatnonzero(np.isin(mark, np.array(wanted, np.int64)))
                for m, a, n, again in zip(*(x[some].tolist() for x in (mark, start, windows, twice)), strict=True):
                    body = raw[a : a + n + width - 1]
                    key, me = (m, xxhash.xxh3_128_digest(body)), (i, a, row, n, body, again)
                    old = earliest.get(key)
                    if old is None:
                        earliest[key] = me
                    elif old[:2] > me[:2]:
                        earliest[key] = me
                        gone.append(old)
                    elif old[:2] < me[:2]:
                        gone.append(me)
                    else:  # another text with the same id
                        ties.append((key, me))
            each = [*earliest.items(), *ties]
            h, v = np.frombuffer(b"".join(k[1] for k, _ in each), np.int64).reshape(-1, 2), [x for _, x in each]
            yield _batch(schema, [[k[0] for k, _ in each], h[:, 0], h[:, 1], [x[0] for x in v], [x[2] for x in v], [x[1] for x in v], [x[3] for x in v], [x[4] for x in v], [x[5] for x in v], [False] * len(v)])
            yield _batch(schema, [[x[0] for x in gone], [x[1] for x in gone], [0] * len(gone), [x[0] for x in gone], [x[2] for x in gone], [x[1] for x in gone], [x[3] for x in gone], [b""] * len(gone), [False] * len(gone), [True] * len(gone)])

    found = texts.select("id", "row", "text", "marks").mapInArrow(run, schema)
    # rows that are settled are dealt by document
    found = found.withColumn("by", F.when(F.col("known"), F.col("row"))).repartition("mark", "by")
    place, one, least = F.struct("id", "start"), W.partitionBy("mark", "by"), W.partitionBy("mark", "by", "h1", "h2")
    found = found.withColumn("gone", F.col("known") | (place > F.min(place).over(least)))
    open_ = ~F.col("gone")
    found = found.withColumn("many", F.sum(open_.cast("int")).over(one)).withColumn("bulk", F.sum(F.when(open_, F.octet_length("body"))).over(one)).withColumn("any", F.max("twice").over(one))
    found = found.where(F.col("gone") | (F.col("many") > 1) | F.col("any")).drop("any", "by")
    return found.withColumn("body", F.when(open_, F.col("body")))


def _narrowed(rows: list[tuple], width: int) -> list[tuple]:
    """The passages cut down to the windows whose hash occurs twice among them: only these can have an equal."""
    if not rows:
        return rows
    raw = np.frombuffer(b"".join(r[4] for r in rows), np.uint8).astype(np.uint64)
    n = np.array([r[3] for r in rows])
    first = np.concatenate([[0], np.cumsum([len(r[4]) for r in rows])[:-1]])
    at = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    h = span_hashes(raw, at, at + width)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(h), bool)
    twice[order] = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    row = np.repeat(np.arange(len(rows)), n)
    edge = np.flatnonzero(twice & np.concatenate([[True], ~twice[:-1] | (row[1:] != row[:-1])]))
    stop = np.flatnonzero(twice & np.concatenate([~twice[1:] | (row[1:] != row[:-1]), [True]])) + 1
    out = []
    for a, b in zip(edge.tolist(), stop.tolist(), strict=True):
        i, of, start, _, body = rows[row[a]]
        k = int(at[a] - first[row[a]])
        out.append((i, of, start + k, b - a, body[k : k + b - a + width - 1]))
    return out


def _earliest(rows: list[tuple], gone: list[tuple]) -> list[tuple]:
    """The first of equal passages; the places and windows of the others go to `gone`."""
    first: dict[bytes, tuple] = {}
    ties = []
    for r in sorted(rows, key=lambda r: (r[0], r[2])):
        old = first.setdefault(r[4], r)
        if (old[0], old[2]) < (r[0], r[2]):
            gone.append((r[0], r[1], r[2], r[3]))
        elif old is not r:
            ties.append(r)
    return [*first.values(), *ties]


def _repeats(rows: list[tuple], width: int) -> Iterator[tuple[int, int, int]]:
    """(id, row, start) of the windows of passages (id, row, start, windows, body) that are not the first of their kind."""
    if not rows:
        return
    raw = np.frombuffer(b"".join(r[4] for r in rows), np.uint8)
    text: list[int] = []
    for r in rows:
        text += [b + 2 for b in r[4]]
        text.append(1)
    text.append(0)
    order = np.array(suffix_array(text))
    sizes = np.array([len(r[4]) for r in rows])
    first = np.concatenate([[0], np.cumsum(sizes + 1)])
    row = np.searchsorted(first, order, "right") - 1
    ok = row < len(rows)
    order, row = order[ok], row[ok]
    at = order - first[row]
    windows = np.array([r[3] for r in rows])
    ok = at < windows[row]
    row, at = row[ok], at[ok]
    raw_at = at + np.concatenate([[0], np.cumsum(sizes)])[row]
    view = np.lib.stride_tricks.sliding_window_view(raw, width)
    equal = np.zeros(len(row), bool)
    for k in range(1, len(row), 1 << 15):
        e = min(len(row), k + (1 << 15))
        equal[k:e] = (view[raw_at[k:e]] == view[raw_at[k - 1 : e - 1]]).all(1)
    kind = np.cumsum(~equal)
    ids, starts = np.array([r[0] for r in rows])[row], np.array([r[2] for r in rows])[row] + at
    by = np.lexsort((starts, ids, kind))
    kind, ids, starts, row = kind[by], ids[by], starts[by], row[by]
    head = np.concatenate([[True], kind[1:] != kind[:-1]])
    lead = np.maximum.accumulate(np.where(head, np.arange(len(kind)), 0))
    later = (ids != ids[lead]) | (starts != starts[lead])
    for k in np.flatnonzero(later).tolist():
        yield int(ids[k]), int(rows[row[k]][1]), int(starts[k])


GONE = "id long, row long, start long, windows long"


def sorted_repeats(found: DataFrame, width: int) -> DataFrame:
    """GONE rows of passages that share a mark, sorted by it within partitions, each mark in one partition."""

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        gone: list[tuple] = []
        while True:  # cut down, and let the earliest of equal passages stand for all, until neither changes anything
            rows = _narrowed(rows, width)
            kept = _earliest(rows, gone)
            if len(kept) == len(rows):
                break
            rows = kept
        gone += [(*g, 1) for g in _repeats(rows, width)]
        return _batch(GONE, [[g[k] for g in gone] for k in range(4)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, last = [], 0, None
        for batch in batches:
            for mark, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > BLOCK and mark != last:
                    yield emit(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[4])
                last = mark
        if rows:
            yield emit(rows)

    return found.select("mark", "id", "row", "start", "windows", "body").repartition("mark").sortWithinPartitions("mark", "id", "start").mapInArrow(run, GONE)


def hashed_repeats(found: DataFrame, width: int) -> DataFrame:
    """The same for marks with too many passages: windows are compared by hash, one row a window and batch."""
    schema = "h1 long, h2 long, id long, row long, start long, known boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            least: dict[bytes, tuple] = {}
            gone, ties = [], []
            for i, row, start, n, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for k in range(n):
                    h, me = xxhash.xxh3_128_digest(body[k : k + width]), (i, start + k, row)
                    old = least.setdefault(h, me)
                    if old[:2] > me[:2]:
                        least[h] = me
                        gone.append(old)
                    elif old[:2] < me[:2]:
                        gone.append(me)
                    elif old is not me:
                        ties.append((h, me))
            each = [*least.items(), *ties]
            h, v = np.frombuffer(b"".join(k for k, _ in each), np.int64).reshape(-1, 2), [x for _, x in each]
            yield _batch(schema, [h[:, 0], h[:, 1], [x[0] for x in v], [x[2] for x in v], [x[1] for x in v], [False] * len(v)])
            yield _batch(schema, [[x[0] for x in gone], [x[1] for x in gone], [x[0] for x in gone], [x[2] for x in gone], [x[1] for x in gone], [True] * len(gone)])

    place = F.struct("id", "start")
    rows = found.select("id", "row", "start", "windows", "body").mapInArrow(run, schema)
    rows = rows.withColumn("gone", F.col("known") | (place > F.min(place).over(W.partitionBy("h1", "h2", F.when(F.col("known"), F.col("row"))))))
    return rows.where("gone").select("id", "row", "start", F.lit(1).cast("long").alias("windows"))


def facts(rows: DataFrame) -> DataFrame:
    """row, id, 128 bits of the text's hash, number of bytes, their SHA-256."""
    return rows.select("row", "id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"))


def removals(texts: DataFrame, width: int) -> DataFrame:
    """What is left of `texts` (row, id, text, found: ids, starts and windows)."""
    schema = "row long, id long, n_removed long, starts array<long>, ends array<long>, kept_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = [[] for _ in range(6)]
            for row, i, t, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = t.encode()
                step = np.zeros(len(raw) + 1, np.int64)
                a, windows = (np.array([x[k] for x in found if x["id"] == i], np.int64) for k in ("start", "windows"))
                np.add.at(step, a, 1)
                np.add.at(step, a + windows + width - 1, -1)
                edge = np.flatnonzero(np.diff(np.concatenate([[False], np.cumsum(step)[:-1] > 0, [False]])))
                a, b = edge[::2].tolist(), edge[1::2].tolist()
                kept = b"".join(raw[x:y] for x, y in zip([0, *b], [*a, len(raw)], strict=True))
                for col, v in zip(out, (row, i, len(raw) - len(kept), a, b, hashlib.sha256(kept).hexdigest()), strict=True):
                    col.append(v)
            yield _batch(schema, out)

    return texts.select("row", "id", "text", "found").mapInArrow(run, schema)


def dedup_bytes(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, starts and ends of the removed runs of bytes, kept_sha256, for each row of docs."""
    ship(docs.sparkSession)
    rows = rows_of(docs)
    known = with_groups(written(facts(rows), "bytes-facts"), ["h1", "h2"], [F.min("id").alias("least")])
    known = written(known.withColumn("copy", (F.col("id") > F.col("least")) & (F.col("n_bytes") >= width)).drop("least", "h1", "h2"), "bytes-copies")
    wanted = shared_marks(rows.select("row", "text"), width).join(known.where("copy").select("row"), "row", "left_anti").groupBy("row").agg(F.collect_set("mark").alias("marks"))
    # texts are read again at the end, so that those with shared marks needn't be kept till then
    found = written(passages(rows.join(wanted.withColumnRenamed("row", "of"), F.col("row") == F.col("of")), width), "bytes-passages")
    open_ = found.where(~F.col("gone"))
    crowded = F.col("bulk") > CROWD
    gone = found.where("gone").select("id", "row", "start", "windows").union(sorted_repeats(open_.where(~crowded), width)).union(hashed_repeats(open_.where(crowded), width))
    gone = gone.groupBy(F.col("row").alias("of")).agg(F.collect_list(F.struct("id", "start", "windows")).alias("found"))
    gone = removals(rows.join(gone, F.col("row") == F.col("of")), width)
    gone = gone.dropDuplicates(["row", "id"]).select(F.col("row").alias("_row"), F.col("id").alias("_id"), "n_removed", "starts", "ends", "kept_sha256")
    out = known.join(gone, (F.col("row") == F.col("_row")) & (F.col("id") == F.col("_id")), "left")
    copy, none = F.col("copy"), F.array().cast("array<long>")
    return out.select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"),
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.array(F.lit(0).cast("long"))).otherwise(F.coalesce("starts", none)).alias("starts"),
        F.when(copy, F.array("n_bytes")).otherwise(F.coalesce("ends", none)).alias("ends"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = dedup_bytes(table(spark, sf_dir, "documents"))
    return x.select("doc_id", "n_bytes", "n_removed", F.size("starts").cast("long").alias("n_spans"), "kept_sha256")


QUERIES = {"op8_suffix_array": op8_suffix_array}
SQL: dict[str, str] = {}

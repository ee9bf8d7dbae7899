"""Two factors with more pairs of levels than the driver takes: the larger factor is eliminated in workers.

The pairs are written once as chunks of whole levels of the larger factor. With D and E the diagonals of the larger
and the smaller factor and C the weights of their pairs, the smaller one's effects solve (E - C' D^-1 C) x = b. A
product is one pass over the chunks; the larger factor's vectors exist only where a chunk is read. Components are one
pass too: each task unites the smaller factor's levels that meet in a level of the larger one. The driver holds
vectors of the smaller factor alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.config import DEFAULTS
from plumbline.functions.linalg import cgsolve
from plumbline.plans.shared import ranked, written

#: Pairs of a chunk, entries of a block of a vector, tasks of a pass, each of which returns a vector, and entries of all vectors of a product.
CHUNK, BLOCK, TASKS, ENTRIES = 1 << 18, 1 << 15, 32, 1 << 21
ROW = "block int, value binary"


def united(low: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Labels of a forest (each node's label is its own or a smaller node's) after uniting u[i] with v[i]; roots are the smallest of their trees."""
    low = low.copy()
    while True:
        up = low[low]
        while (up != low).any():
            low, up = up, up[up]
        a, b = low[u], low[v]
        apart = a != b
        if not apart.any():
            return low
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(low, np.maximum(a, b), np.minimum(a, b))


def _packed(rows: DataFrame, k: int) -> DataFrame:
    """start, at, w, z: chunks of rows (a, at, w, z0, ...), which lie by a; start has the first pair of each level."""
    chunk = CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def told(last: bool) -> Iterator[pa.RecordBatch]:
            x = pa.Table.from_batches(held).combine_chunks()
            a = x.column("a").combine_chunks()
            a = a.chunk(0) if isinstance(a, pa.ChunkedArray) else a
            start = np.flatnonzero(np.append(True, pc.not_equal(a[1:], a[:-1]).to_numpy(zero_copy_only=False)))
            end = len(x) if last else int(start[-1])
            held[:] = x.slice(end).to_batches() if end < len(x) else []
            start = start[start < end]
            if end:
                at, w = (x.column(c).to_numpy()[:end] for c in ("at", "w"))
                z = np.stack([np.add.reduceat(x.column(f"z{i}").to_numpy()[:end], start) for i in range(k)], 1) if k else np.zeros((len(start), 0))
                values = [y.tobytes() for y in (start.astype("<i4"), at.astype("<i4"), w.astype("<f8"), z.astype("<f8"))]
                yield pa.RecordBatch.from_arrays([pa.array([y], pa.binary()) for y in values], ["start", "at", "w", "z"])

        n, goal = 0, chunk
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n >= goal:
                yield from told(False)
                n = sum(x.num_rows for x in held)
                goal = max(chunk, 2 * n)  # a level that is larger than a chunk is read again only when it has doubled
        if held:
            yield from told(True)

    return rows.repartition("a").sortWithinPartitions("a").mapInArrow(run, "start binary, at binary, w binary, z binary")


def _blocks(x: np.ndarray, block: int) -> Iterator[pa.RecordBatch]:
    """The blocks of the rows of x that are not zero."""
    size = x.shape[1]
    each = -(-size // block)
    for r in range(len(x)):
        for b in range(each):
            part = x[r, b * block : (b + 1) * block]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([r * each + b], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["block", "value"])


def _added(parts: DataFrame, many: int) -> DataFrame:
    """The sums of vectors' blocks, of which there are so many: results stay small enough to come with their tasks' ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                v = np.frombuffer(v.as_buffer(), "<f8")
                total[b] = total[b] + v if b in total else v.copy()
        for b, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([v.tobytes()], pa.binary())], ["block", "value"])

    return parts.repartition(max(1, many), "block").mapInArrow(run, ROW)


class Eliminated:
    """The normal equations of two pure factors. cells: a, b, w, z0, ... for each pair of levels, written; k columns z."""

    def __init__(self, cells: DataFrame, k: int):
        self.k, self.block, names = k, BLOCK, [f"z{i}" for i in range(k)]
        about = cells.agg(F.approx_count_distinct("a").alias("a"), F.approx_count_distinct("b").alias("b")).first()
        if about["a"] < about["b"]:
            cells = cells.select(F.col("b").alias("a"), F.col("a").alias("b"), "w", *names)
        small = cells.groupBy("b").agg(*[F.sum(c).alias(c) for c in ("w", *names)])
        small = written(ranked(small, [F.col("b")]), "levels")
        got = small.select(F.col("position") - 1, "w", *names).toArrow()
        order = np.argsort(got.column(0).to_numpy())
        self.size = len(order)
        self.diagonal = got.column(1).to_numpy()[order]
        self._sums = np.stack([got.column(2 + i).to_numpy()[order] for i in range(k)], 1) if k else np.zeros((self.size, 0))
        part = small.select(F.col("b").alias("_b"), (F.col("position") - 1).cast("int").alias("at"))
        part = F.broadcast(part) if self.size <= DEFAULTS.broadcast else part
        rows = cells.join(part, F.col("b") == F.col("_b")).select("a", "at", "w", *names)
        self.chunks = written(_packed(rows, k), "chunks")

    def _pass(self, run: Callable, columns: list[str]) -> DataFrame:
        sc = self.chunks.sparkSession.sparkContext
        return self.chunks.select(*columns).coalesce(min(TASKS, sc.defaultParallelism)).mapInArrow(run, ROW)

    def _collected(self, parts: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray | None]:
        """The sum of the tasks' k vectors, and of what they give beside them as block -1."""
        each, block, beside = -(-self.size // self.block), self.block, None
        out = np.zeros((k, self.size))
        for r in _added(parts, k * each).collect():
            if r["block"] < 0:
                beside = np.frombuffer(r["value"], "<f8")
                continue
            c, b = divmod(r["block"], each)
            out[c, b * block : (b + 1) * block] = np.frombuffer(r["value"], "<f8")
        return out.T, beside

    @cached_property
    def _reduced(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """What the larger factor alone explains of the columns' cross products, the right side and diagonal that it leaves, and its levels."""
        size, k, block = self.size, self.k, self.block

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, cross, n = np.zeros((k + 1, size)), np.zeros((k, k)), 0
            for start, at, w, z in _read(batches):
                d = np.add.reduceat(w, start)
                z = z.reshape(len(start), k)
                mean, many = z / d[:, None], np.diff(start, append=len(at))
                cross += mean.T @ z
                n += len(start)
                for c in range(k):
                    np.add.at(out[c], at, w * np.repeat(mean[:, c], many))
                np.add.at(out[k], at, w * w / np.repeat(d, many))
            yield from _blocks(out, block)
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([np.append(cross.ravel(), float(n)).tobytes()], pa.binary())], ["block", "value"])

        got, one = self._collected(self._pass(run, ["start", "at", "w", "z"]), k + 1)
        rhs, diagonal = self._sums, np.maximum(self.diagonal - got[:, k], 0)
        rhs -= got[:, :k]
        return one[:-1].reshape(k, k), rhs, diagonal, int(one[-1])

    @property
    def levels(self) -> int:
        """Of both factors."""
        return self.size + self._reduced[3]

    def product(self, v: np.ndarray) -> np.ndarray:
        (size, k), block = v.shape, self.block
        sent = self.chunks.sparkSession.sparkContext.broadcast(np.ascontiguousarray(v.T))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p, out = sent.value, np.zeros((k, size))
            for start, at, w in _read(batches):
                d, many = np.add.reduceat(w, start), np.diff(start, append=len(at))
                for c in range(k):
                    np.add.at(out[c], at, w * np.repeat(np.add.reduceat(w * p[c][at], start) / d, many))
            yield from _blocks(out, block)

        out, _ = self._collected(self._pass(run, ["start", "at", "w"]), k)
        sent.destroy()
        np.negative(out, out=out)
        for c in range(k):
            out[:, c] += self.diagonal * v[:, c]
        return out

    def explained(self, eps: float) -> np.ndarray:
        """The columns' cross products as far as both factors explain them."""
        cross, rhs, diagonal, _ = self._reduced
        if not self.k:
            return cross
        many = max(1, ENTRIES // self.size)  # columns at a time
        return cross + np.concatenate([rhs.T @ cgsolve(self.product, rhs[:, c : c + many], eps, None, diagonal) for c in range(0, self.k, many)], 1)

    @cached_property
    def components(self) -> int:
        size, block = self.size, self.block

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            low, u, v, n = np.arange(size, dtype="<i4"), [], [], 0
            for start, at in _read(batches):
                inner = np.ones(len(at), bool)
                inner[start] = False
                inner = np.flatnonzero(inner)
                u.append(at[inner - 1])
                v.append(at[inner])
                n += len(inner)
                if n > size:
                    low, u, v, n = united(low, np.concatenate(u), np.concatenate(v)), [], [], 0
            if n:
                low = united(low, np.concatenate(u), np.concatenate(v))
            for b in range(-(-size // block)):
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([low[b * block : (b + 1) * block].tobytes()], pa.binary())], ["block", "value"])

        low = np.arange(size, dtype="<i4")
        for r in self._pass(run, ["start", "at"]).collect():
            v = np.frombuffer(r["value"], "<i4")
            u = np.arange(len(v), dtype="<i4") + r["block"] * block
            low = united(low, u[u != v], v[u != v])
        return int((low == np.arange(size)).sum())


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of each chunk."""
    kinds = {"start": "<i4", "at": "<i4", "w": "<f8", "z": "<f8"}
    for batch in batches:
        for k in range(batch.num_rows):
            yield [np.frombuffer(batch.column(c)[k].as_buffer(), kinds[batch.schema.names[c]]) for c in range(batch.num_columns)]

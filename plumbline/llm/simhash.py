"""Near duplicates by SimHash, found with multi-index hashing.

A document's fingerprint has a bit set where more than half of its shingles' XXH64 have it set. Fingerprints
link at two or fewer differing bits. Of two fingerprints that link, either the upper halves differ in at most
one bit, or the lower halves are equal: so each fingerprint looks up the Hamming ball of radius 1 around its
upper half, and its lower half as it is, in a table of halves, and complete distances verify what is found.
Documents with one fingerprint are one class, so copies never meet in pairs.

A half that more than HEAVY classes share is answered another way, which is exact too and linear: each class
near it emits the 65 values within one bit of its whole fingerprint. Two classes link if and only if they emit
a common value, and the classes that emit one value are at most 65.

Nulls: a null or blank text has fingerprint zero, linked like any other; a null doc_id is no component's
smallest id unless all its ids are null. Repeated rows get equal results, an empty table none. Only doc_id and
text are read, so further columns can't clash. Texts of any length are hashed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.components import connected_components

from ._common import slices, table, written
from ._near import hashes, majority, near_copies, text_hashes

DISTANCE, HEAVY = 2, 64


def fingerprint(text: str | None, width: int) -> int:
    """As a signed 64-bit number."""
    return majority(hashes(text, width))


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, print (signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints = [fingerprint(x, width) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["doc_id", "print"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, print long")


def _halves(p) -> tuple:
    return F.shiftrightunsigned(p, 32), p.bitwiseAND(F.lit(0xFFFFFFFF))


def links(prints: DataFrame) -> DataFrame:
    """Edges (x, y) that connect the distinct `print`s at two or fewer differing bits as all such pairs would."""
    high, low = _halves(F.col("print"))
    table_rows = F.array(F.struct(F.lit(0).alias("half"), high.alias("key")), F.struct(F.lit(1).alias("half"), low.alias("key")))
    ball = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.struct(F.lit(0).alias("half"), high.bitwiseXOR(F.pow(F.lit(2), k).cast("long")).alias("key")))
    stored = prints.select("print", F.explode(table_rows).alias("e")).select("e.half", "e.key", F.col("print").alias("y"))
    asked = prints.select("print", F.explode(F.concat(table_rows, ball)).alias("e")).select("e.half", "e.key", F.col("print").alias("x"))
    heavy = written(stored.groupBy("half", "key").count().where(F.col("count") > HEAVY).select("half", "key"), "simhash-heavy")
    crowded = not heavy.isEmpty()
    near = F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= DISTANCE
    if crowded:
        stored_light, asked_heavy = stored.join(heavy, ["half", "key"], "left_anti"), asked.join(heavy, ["half", "key"], "left_semi")
    else:
        stored_light, asked_heavy = stored, None
    found = asked.join(stored_light, ["half", "key"]).where((F.col("x") != F.col("y")) & near).select("x", "y")
    if asked_heavy is None:
        return found
    x = F.col("x")
    around = F.transform(F.sequence(F.lit(0), F.lit(62)), lambda k: x.bitwiseXOR(F.pow(F.lit(2), k).cast("long")))
    around = F.concat(F.array(x, x.bitwiseXOR(F.lit(-(1 << 63)))), around)
    meeting = asked_heavy.select("x").distinct().select("x", F.explode(around).alias("value"))
    met = meeting.groupBy("value").agg(F.collect_set("x").alias("all")).where(F.size("all") > 1)
    met = met.select(F.array_min("all").alias("x"), F.explode("all").alias("y")).where((F.col("x") != F.col("y")) & near)
    return found.union(met)


def near_duplicates(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, print, component_id for each row of docs: the smallest doc_id that links reach, itself included."""
    slim = written(fingerprints(docs, width), "simhash")
    classes = written(slim.groupBy("print").agg(F.min("doc_id").alias("first")), "simhash-classes")
    joined = connected_components(links(classes.select("print")))
    rooted = classes.join(joined, F.col("print") == F.col("node"), "left").select("print", "first", F.coalesce("component", "print").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = rooted.join(least, "root").select(F.col("print").alias("of"), "component_id")
    return slim.join(ids, F.col("print") == F.col("of")).select("doc_id", "print", "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, 3-word shingles."""
    x = near_duplicates(table(spark, sf_dir, "documents"), 3)
    return x.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


__all__ = ["fingerprints", "links", "near_copies", "near_duplicates", "op1_simhash", "text_hashes"]
QUERIES = {"op1_simhash": op1_simhash}
SQL: dict[str, str] = {}

"""Scratch tables in the folder that driver and executors share, and orders and groups that no single task holds."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Applications that have the package.
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python once for each context, as --py-files would: they needn't have it on their path."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="plumbline-")) / "plumbline.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, Path("plumbline") / f.relative_to(package))
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. A temporary folder stands in only where driver and executors are one process."""
    ship(spark)
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="plumbline-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and a lost executor costs nothing."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, order: list[Column], sums: dict[str, str] | None = None) -> DataFrame:
    """df with `position` (from 1, by `order`) and for each of `sums` (new column: its expression) the total over earlier rows.

    Rows are dealt by ranges of the order; only one row for each range meets in a task. df has no column named like these.
    """
    sums = sums or {}
    dealt = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"), *[F.sum(F.expr(e)).alias(f"_{c}") for c, e in sums.items()])
    ahead = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(F.col("_range").alias("_of"), *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(c) for c in ["_rows", *[f"_{c}" for c in sums]]])
    inside = W.partitionBy("_range").orderBy(*order)
    x = dealt.withColumn("position", F.row_number().over(inside))
    for c, e in sums.items():
        x = x.withColumn(c, F.coalesce(F.sum(F.expr(e)).over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    x = x.join(F.broadcast(totals), F.col("_range") == F.col("_of"))  # at most one row for each shuffle partition
    x = x.withColumn("position", F.col("position") + F.col("_rows"))
    for c in sums:
        x = x.withColumn(c, F.col(c) + F.col(f"_{c}"))
    return x.select(*df.columns, "position", *sums)


def with_groups(df: DataFrame, keys: list[str], aggregates: list[Column]) -> DataFrame:
    """The written table df with its groups' aggregates on each row, where one key may hold any share of the rows.

    Groups of more than a thousandth of the rows, at most a thousand, are broadcast; the others meet their rows by key.
    Keys are not null.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    groups = df.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]).agg(F.count(F.lit(1)).alias("_members"), *aggregates)
    groups = written(groups, "groups")
    large = F.col("_members") > max(1000, df.count() // 1000)
    same = [F.col(k) == F.col(n) for k, n in zip(keys, names, strict=True)]
    some = F.broadcast(groups.where(large))
    hot = df.join(some, same)
    rest = df.join(some.select(*names), same, "left_anti").join(groups.where(~large), same)
    return hot.unionByName(rest).drop("_members", *names)

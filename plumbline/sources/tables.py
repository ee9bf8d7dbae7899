"""Sources and sinks: headerless text, Parquet, CSV, JSON, ORC, and Stata files of driver size."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_text(spark: SparkSession, path: str, names: list[str], categorical: list[str] = (), sep: str = " ") -> DataFrame:
    """Separated values without a header: variables used as factors are strings, all others doubles."""
    schema = T.StructType([T.StructField(n, T.StringType() if n in categorical else T.DoubleType()) for n in names])
    return spark.read.csv(path, schema=schema, sep=sep, nullValue="NA", nanValue="NaN", ignoreLeadingWhiteSpace=True)


def read_table(spark: SparkSession, path: str, names: list[str] | None = None, categorical: list[str] = ()) -> DataFrame:
    """By the path's ending; anything else is headerless text with the given names."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind in ("parquet", "orc", "json"):
        return spark.read.format(kind).load(path)
    if kind == "dta":
        return spark.createDataFrame(pd.read_stata(path, convert_categoricals=True).astype({c: str for c in categorical}))
    if names is None:
        return spark.read.csv(path, header=True, inferSchema=True)
    return read_text(spark, path, names, categorical)


def write_table(df: DataFrame, path: str) -> None:
    """By the path's ending: one CSV folder with header, Parquet, ORC or JSON."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "csv":
        df.select(*[F.col(c).cast("string") if isinstance(df.schema[c].dataType, T.ArrayType | T.StructType) else F.col(c) for c in df.columns]).write.mode("overwrite").csv(path, header=True)
    else:
        df.write.mode("overwrite").format(kind if kind in ("orc", "json") else "parquet").save(path)

"""Each query against its SQL at the smallest size, in DuckDB."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from plumbline import queries as Q

TINY = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Random or iterated results: rows only.
HEAVY = {"bootstrap", "effect_bootstrap"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TINY}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_same_as_sql(spark, con, name):
    got = Q.QUERIES[name](spark, TINY).toPandas()
    want = con.execute(Q.SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(got) == len(want)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    for c in cols:
        if a[c].dtype.kind == "f":
            assert a[c].to_numpy() == pytest.approx(b[c].to_numpy(dtype=float), abs=2e-5, rel=2e-5, nan_ok=True)
        else:
            assert a[c].astype(str).tolist() == b[c].astype(str).tolist()


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL) - HEAVY))
def test_others_give_rows(spark, name):
    assert Q.QUERIES[name](spark, TINY).count() > 0


def test_entry(spark):
    assert [r["term"] for r in entry.entry(spark).collect()] == ["qty", "disc"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_cgsolve_forms_no_square_matrix(spark, monkeypatch):
    def dense(self):
        raise MemoryError("levels by levels")

    monkeypatch.setattr(Q.Absorbed, "dense", dense)
    got = {r["name"]: r["value"] for r in Q.QUERIES["cgsolve"](spark, TINY).collect()}
    assert got["trace"] == 2 * spark.read.parquet(f"{TINY}/lineitem.parquet").count()  # each row is in one level of both factors

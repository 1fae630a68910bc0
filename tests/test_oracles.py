"""Every query with an oracle against DuckDB on the same tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from fieldloom.plans import files, numeric, relational, relational_sql, science

QUERIES = {**science.QUERIES, **relational.QUERIES, **files.QUERIES, **numeric.QUERIES}
ORACLES = {**science.ORACLES, **relational_sql.ORACLES, **files.ORACLES, **numeric.ORACLES}


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for name in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{name}')")
    return c


def rows(frame, columns):
    out = []
    for row in frame[columns].itertuples(index=False):
        out.append(tuple(None if not isinstance(x, (list, tuple, np.ndarray)) and pd.isna(x) else float(x) if isinstance(x, (int, float, np.integer, np.floating)) and not isinstance(x, bool) else str(x) for x in row))
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, sf_dir, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.execute(ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    a, b = rows(got, columns), rows(want, columns)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for p, q in zip(x, y, strict=True):
            assert p == q or isinstance(p, float) and isinstance(q, float) and abs(p - q) <= 2e-6 * max(1.0, abs(q)), (x, y)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_coded_streams_come_back(spark, sf_dir):
    got = QUERIES["rans_roundtrip"](spark, sf_dir).toPandas()
    assert len(got) and got["same"].all()


def test_sample_and_farthest_points(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    sample = QUERIES["hash_sample"](spark, sf_dir).count()
    assert 0.05 * n < sample < 0.2 * n
    got = QUERIES["farthest_points"](spark, sf_dir).toPandas()
    assert (got.groupby("cloud")["p"].nunique() == 8).all()

"""Queries on odd tables, against their SQL."""

import duckdb
import pytest

from tests.test_oracles import ORACLES, QUERIES, rows


def compared(spark, folder, name, **tables):
    """The query's rows over ``tables`` are its SQL's."""
    for t, frame in tables.items():
        frame.coalesce(1).write.parquet(f"{folder}/{t}.parquet")
    c = duckdb.connect()
    for t in tables:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    got, want = QUERIES[name](spark, str(folder)).toPandas(), c.execute(ORACLES[name]).fetchdf()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns) and len(want)
    assert rows(got, columns) == rows(want, columns)


@pytest.mark.parametrize("ids", [range(11), [0, 2, 3, 5, 9, 14]])
def test_raw_files_with_fewer_slices(spark, tmp_path, ids):
    made = [(n, [float((n * 37 + i * 11) % 64) / 8 for i in range(64)], n % 3) for n in ids]
    compared(spark, tmp_path, "raw_field_metrics", embeddings=spark.createDataFrame(made, "vec_id long, embedding array<float>, label int"))


def test_numbers_of_more_than_six_digits(spark, tmp_path):
    made = [(7, "STANDARD TIN", 1), (123456, "SMALL TIN", 3), (1199999, "STANDARD TIN", 2)]
    compared(spark, tmp_path, "mesh_paths", part=spark.createDataFrame(made, "p_partkey long, p_type string, p_size int"))


def test_no_group_for_each_side_file(spark, sf_dir):
    assert "FlatMapGroupsInPandas" not in QUERIES["labelled_points"](spark, sf_dir)._jdf.queryExecution().toString()

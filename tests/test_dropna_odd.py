"""dropna_any over tables with NULL, NaN and zeros in every column, against its SQL."""

import itertools

import duckdb

import __spark_entry__ as entry


def test_odd_rows_as_in_sql(spark, tmp_path):
    nan = float("nan")
    parts = [(1, None), (3, 7, None), (0.0, 2.0, 50.0, nan, None), (10.0, nan, None), (0.0, 0.05, nan, None), (0.0, 0.02, nan, None), ("N", None)]
    rows = [(o, n, i, i, *rest) for i, (o, n, *rest) in enumerate(itertools.product(*parts))]
    ddl = "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string"
    spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    df = entry.queries()["dropna_any"](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({entry.oracle_sql()['dropna_any']})").fetchall()
    plain = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert plain(df.collect()) == plain(want) and len(want) > 100

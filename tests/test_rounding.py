"""Rounded columns against DuckDB, where the decimal notation of a number is a tie and the number is not."""

import duckdb
from pyspark.sql import functions as F

from fauntrack.functions import geo
from fauntrack.plans import catalog

VALUES = [(0.5055445,), (-0.5055445,), (0.5062455,), (2.5,), (-2.5,), (1.0000005,), (0.0,), (-1e-9,), (float("nan"),), (float("inf"),), (123456789.0123455,), (None,)]


def test_rounded_goes_as_the_sql_does(spark):
    df = spark.createDataFrame(VALUES, "x double")
    got = [tuple(r) for r in df.select(geo.rounded("x", 6) + 0.0, geo.rounded(F.col("x"), 1) + 0.0, geo.rounded("x", 0) + 0.0).collect()]
    con = duckdb.connect()
    want = [con.execute("SELECT round(x, 6) + 0.0, round(x, 1) + 0.0, round(x, 0) + 0.0 FROM (SELECT CAST(? AS DOUBLE) AS x)", v).fetchone() for v in VALUES]
    assert str(got) == str(want)


def test_posterior_draws_agree_with_their_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM read_parquet('{sf_dir}/supplier.parquet')")
    got = sorted(tuple(r) for r in catalog.queries()["posterior_draws"](spark, sf_dir).collect())
    assert got == sorted(con.execute(catalog.oracle_sql()["posterior_draws"]).fetchall())

"""Every catalogue query with SQL agrees with DuckDB on the smallest tables."""


import duckdb
import pytest

from fauntrack.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events".split()
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(df):
    def cell(v):
        if v is None or v != v:  # null, NaN, NaT
            return "null"
        if isinstance(v, float):
            return repr(round(v, 6) + 0.0)
        return str(v)[:10] if hasattr(v, "year") else str(v)

    return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, duck, sf_dir, name):
    got = catalog.queries()[name](spark, sf_dir).toPandas()
    want = duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["hex_cover", "land_units", "hsi_infill", "kernel_resolvent", "agents", "viterbi_hmm", "astar_paths", "circuit_current"])
def test_runs_without_sql(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).limit(5).count() > 0

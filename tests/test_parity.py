"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import duckdb
import pytest

from pixelloom import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: round(float(v), 6) + 0.0 if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    out = [tuple(value(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    got, expected = normal(df.collect(), df.columns), normal(want.fetchall(), want.columns)
    assert len(got) == len(expected)
    for a, b in zip(got, expected):
        assert a == pytest.approx(b, abs=2e-6) if all(isinstance(x, (int, float)) for x in a) else a == b


@pytest.mark.parametrize("name", ["psf_fit", "frame_psf", "nlm_medium"])
def test_kernels_run(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0

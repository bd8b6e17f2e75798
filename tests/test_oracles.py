"""Every registered query that SQL can express, against DuckDB on the same tables."""

import os

import duckdb
import pytest

from weftline.plans.registry import ORACLES, QUERIES

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables aren't here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def split_rows(df):
    """Rows as (exact values, doubles), in order: keys, texts and whole numbers must be equal, doubles may differ in the last place."""
    rows = []
    for r in df[sorted(df.columns)].astype(object).itertuples(index=False):
        exact = tuple("-" if v is None or v != v else str(int(v)) if not isinstance(v, str) and float(v).is_integer() and not isinstance(v, float) else str(v) for v in r if not isinstance(v, float) or v != v)
        rows.append((exact, tuple(float(v) for v in r if isinstance(v, float) and v == v)))
    return sorted(rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    got, want = QUERIES[name](spark, FOLDER).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = split_rows(got), split_rows(want)
    assert len(a) == len(b)
    for (exact_a, a_), (exact_b, b_) in zip(a, b, strict=True):
        assert exact_a == exact_b
        assert len(a_) == len(b_) and all(abs(x - y) <= 1.1e-5 * max(1, abs(x)) for x, y in zip(a_, b_, strict=True)), (exact_a, a_, b_)

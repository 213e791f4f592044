"""Every query of the catalogue against its SQL in DuckDB, on the smallest tables."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"

from graphloom.plans import catalog_checks, catalog_views  # noqa: E402, F401 (add queries)
from graphloom.plans.catalog import QUERIES, SQL  # noqa: E402


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    found = QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=repr)
    if name not in SQL:
        assert ours
        return
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{DATA}/{file}'")
    result = con.sql(SQL[name])
    theirs = [dict(zip(result.columns, r, strict=True)) for r in result.fetchall()]
    assert columns == sorted(result.columns)
    assert ours == sorted((tuple(plain(float(r[c]) if type(r[c]).__name__ == "Decimal" else r[c]) for c in columns) for r in theirs), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_whole_tables(spark):
    """No filter leaves out line items or parts."""
    n = {t: spark.read.parquet(f"{DATA}/{t}.parquet").count() for t in ("orders", "lineitem", "part")}
    assert QUERIES["induced_subgraph"](spark, DATA).count() == n["orders"] + n["lineitem"]
    assert QUERIES["token_overlap"](spark, DATA).count() == n["part"]

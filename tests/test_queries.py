"""Every registered query of the tables' operators gives what its SQL gives."""

import math
from itertools import product

import duckdb
import pandas as pd
import pytest

from tablekeel.queries import ORACLE_SQL, QUERIES


def values(df):
    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
            return "-"
        if isinstance(v, float) or hasattr(v, "item") and isinstance(v.item(), float):
            return repr(round(float(v), 6))
        if hasattr(v, "item"):
            v = v.item()
        if isinstance(v, int) and not isinstance(v, bool):
            return repr(round(float(v), 6))
        return str(v)[:10] if hasattr(v, "year") else repr(v)

    return sorted(tuple(map(one, r)) for r in df[sorted(df)].astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in ("nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got) == sorted(want)
    assert values(got) == values(want)


def test_divide_equals_sql_on_odd_values(spark, tmp_path):
    """Null and NaN are told apart here, ``values`` takes them for the same."""
    odd = (None, math.nan, math.inf, -math.inf, 0.0, -0.0, 1.0, -1.0, 50.0, 0.07, 5e-324, 1.7976931348623157e308)
    lines = spark.createDataFrame([(i, 1, *pair) for i, pair in enumerate(product(odd, odd))], "l_orderkey long, l_linenumber int, l_quantity double, l_discount double")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    got = QUERIES["drv_04_divide"](spark, str(tmp_path)).select("l_orderkey", "made").collect()
    want = con.sql(f"SELECT l_orderkey, made FROM ({ORACLE_SQL['drv_04_divide']})").fetchall()
    assert {k: repr(v) for k, v in got} == {k: repr(v) for k, v in want}

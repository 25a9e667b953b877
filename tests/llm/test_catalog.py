from __future__ import annotations

import glob
import os

import duckdb
import pytest

from chatsieve.llm.catalog import ORACLE, QUERIES
from tests.conftest import SF_SMALL
from tests.test_catalog import canonical

NATIVE = ("op1_decontaminate", "op3_surrogates", "op5_line_dedup")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for path in glob.glob(f"{SF_SMALL}/*.parquet"):
        table = os.path.basename(path).removesuffix(".parquet")
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    frame = QUERIES[name](spark, SF_SMALL)
    cursor = duck.execute(ORACLE[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    rows = [tuple(r) for r in frame.collect()]
    assert canonical(frame.columns, rows) == canonical(columns, cursor.fetchall())


@pytest.mark.parametrize("name", NATIVE)
def test_native_plans_have_no_python(spark, name):
    plan = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().toString()
    for unwanted in ("CartesianProduct", "BroadcastNestedLoop", "Python", "InPandas", "MapInArrow"):
        assert unwanted not in plan

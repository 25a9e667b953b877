from __future__ import annotations

import glob
import os
import re

import duckdb
import pytest

import __spark_entry__ as driver
from chatsieve import storage
from chatsieve.catalog.inputs import conversations
from chatsieve.catalog.queries import QUERIES
from tests.conftest import SF_CHECK, SF_SMALL


# Queries that have tests of their own are not in the package's catalog.
NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF_SMALL}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    yield connection
    connection.close()


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def test_every_query_has_sql():
    assert set(NAMES) <= set(driver.queries())
    assert set(NAMES) <= set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    frame = driver.queries()[name](spark, SF_SMALL)
    cursor = duck.execute(driver.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    rows = [tuple(r) for r in frame.collect()]
    assert canonical(frame.columns, rows) == canonical(columns, cursor.fetchall())


def test_entry(spark):
    rows = driver.entry(spark).collect()
    assert len(rows) == 19 and sum(r.drop_reason is None for r in rows) == 16


@pytest.mark.parametrize("name", NAMES)
def test_plan_has_no_product_and_no_python(spark, name):
    plan = driver.queries()[name](spark, SF_CHECK)._jdf.queryExecution().toString()
    for unwanted in ("CartesianProduct", "BroadcastNestedLoop", "Python", "InPandas"):
        assert unwanted not in plan


def test_scans_read_only_what_is_needed(spark):
    plan = conversations(spark, SF_CHECK).select("role")._jdf.queryExecution()
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan.toString())
    assert schemas == ["role:string"]
    plan = driver.queries()["prompt_messages"](spark, SF_CHECK)._jdf.queryExecution()
    assert "EqualTo(role,user)" in plan.toString()


def test_scratch_folder_comes_from_the_session(spark):
    assert storage.scratch_path(spark, "x").startswith(
        spark.conf.get("spark.checkpoint.dir")
    )

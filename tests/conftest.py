from __future__ import annotations

import glob
import json
import os

import duckdb
import pytest
from pyspark.sql import SparkSession

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("scratch")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def duck():
    """DuckDB connections with the tables of a folder as views."""
    opened = []

    def connect(sf_dir):
        connection = duckdb.connect()
        opened.append(connection)
        for path in glob.glob(f"{sf_dir}/*.parquet"):
            name = os.path.basename(path).removesuffix(".parquet")
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
        return connection

    yield connect
    for connection in opened:
        connection.close()


@pytest.fixture
def write_lines(tmp_path):
    """Write samples (or ready-made lines) as one JSON Lines file."""

    def write(samples, name="data.jsonl"):
        path = tmp_path / name
        lines = [s if isinstance(s, str) else json.dumps(s) for s in samples]
        path.write_text("\n".join(lines) + "\n", encoding="utf-8")
        return str(path)

    return write


def sample(user="Why is the sky blue?", said="Because air scatters blue light.", system=None):
    turns = [("system", system)] if system else []
    turns += [("user", user), ("assistant", said)]
    return {"messages": [{"role": r, "content": c} for r, c in turns]}


def turn_rows(spark, conversations):
    """Turn table from ``{conv_id: [(role, content), ...]}``."""
    rows = [
        (conv_id, i, role, content)
        for conv_id, messages in conversations.items()
        for i, (role, content) in enumerate(messages)
    ]
    return spark.createDataFrame(
        rows, "conv_id BIGINT, turn BIGINT, role STRING, content STRING"
    )


def sample_rows(spark, conversations):
    """The same conversations as nested rows."""
    return spark.createDataFrame(
        [(conv_id, messages) for conv_id, messages in conversations.items()],
        "conv_id BIGINT, messages ARRAY<STRUCT<role STRING, content STRING>>",
    )

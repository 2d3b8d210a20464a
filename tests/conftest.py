"""A local session, small frames, and comparison helpers."""

from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from groundswell.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("warehouse")
    session = local_session(
        4,
        app="tests",
        spark__driver__memory="6g",
        spark__sql__warehouse__dir=str(folder),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(autouse=True, scope="module")
def own_run_log():
    """Loads of one test file do not show in the run log of the next."""
    session = SparkSession.getActiveSession()
    if session is not None and session.catalog.tableExists("bronze._ingestion_log"):
        session.sql("DROP TABLE bronze._ingestion_log")


@pytest.fixture
def frame(spark):
    """Frame of tuples and a schema text."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)


def rows(df, *order):
    """Rows as dictionaries, sorted by the named columns (all columns if none)."""
    names = order or df.columns
    found = [row.asDict(recursive=True) for row in df.collect()]
    return sorted(found, key=lambda row: [(row[n] is not None, row[n]) for n in names])


def column(df, name, *order):
    return [row[name] for row in rows(df, *order)]

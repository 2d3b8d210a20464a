"""Overwrites that a lost job cannot break, and the versions behind them."""

import threading
import time

import pytest
from conftest import rows
from pyspark.sql import functions as F

from groundswell.sources import tables

NAME = "swap.readings"


@pytest.fixture
def clean(spark):
    def drop():
        spark.sql("DROP DATABASE IF EXISTS swap CASCADE")

    drop()
    yield spark
    drop()


def numbers(spark, n, **columns):
    df = spark.range(n, numPartitions=4)
    return df.withColumns({name: F.lit(value) for name, value in columns.items()})


def ids(spark):
    return [r["id"] for r in rows(tables.read_required(spark, NAME))]


def dying(spark, n):
    """Rows whose last partition fails after the others are written."""
    late = F.when(F.col("id") == n - 1, F.raise_error(F.lit("executor gone"))).otherwise(F.col("id"))
    return spark.range(n, numPartitions=4).select(late.cast("long").alias("id"))


def test_overwrite_replaces_rows_and_can_read_itself(clean):
    tables.overwrite(numbers(clean, 5), NAME)
    tables.overwrite(numbers(clean, 3), NAME)
    assert ids(clean) == [0, 1, 2]
    tables.overwrite(tables.read_required(clean, NAME).where("id > 0"), NAME)
    assert ids(clean) == [1, 2]


def test_write_that_dies_half_way_leaves_the_old_rows(clean):
    tables.overwrite(numbers(clean, 6), NAME)
    with pytest.raises(Exception, match="executor gone"):
        tables.overwrite(dying(clean, 40), NAME)
    assert ids(clean) == list(range(6))
    tables.overwrite(numbers(clean, 9), NAME)  # the same job again, now to the end
    assert ids(clean) == list(range(9))


def test_first_write_that_dies_leaves_no_table(clean):
    with pytest.raises(Exception, match="executor gone"):
        tables.overwrite(dying(clean, 40), NAME)
    assert not tables.table_exists(clean, NAME)
    assert tables.read_optional(clean, NAME, numbers(clean, 1).schema).count() == 0
    tables.overwrite(numbers(clean, 2), NAME)
    assert ids(clean) == [0, 1]


def test_cancelled_write_leaves_the_old_rows(clean):
    """The job is killed while its tasks write."""
    tables.overwrite(numbers(clean, 4), NAME)
    failures = []

    def write():
        clean.addTag("doomed")
        slow = numbers(clean, 400).mapInArrow(_slowly, "id long")
        try:
            tables.overwrite(slow, NAME)
        except Exception as error:
            failures.append(str(error))

    worker = threading.Thread(target=write)
    worker.start()
    for _ in range(100):
        time.sleep(0.1)
        if clean.interruptTag("doomed"):
            break
    worker.join(60)
    clean.clearTags()
    assert failures and ids(clean) == [0, 1, 2, 3]
    tables.overwrite(numbers(clean, 5), NAME)
    assert ids(clean) == [0, 1, 2, 3, 4]


def _slowly(batches):
    for batch in batches:
        time.sleep(3)
        yield batch


def test_death_before_the_name_moves_leaves_the_old_rows(clean, monkeypatch):
    tables.overwrite(numbers(clean, 4), NAME)

    def die(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(tables, "_point", die)
        with pytest.raises(KeyboardInterrupt):
            tables.overwrite(numbers(clean, 7), NAME)
    assert ids(clean) == [0, 1, 2, 3]
    tables.overwrite(numbers(clean, 8), NAME)
    assert ids(clean) == list(range(8))


def test_new_columns(clean):
    tables.overwrite(numbers(clean, 3), NAME)
    tables.overwrite(numbers(clean, 2, name="x", Location="here"), NAME)
    assert rows(tables.read_required(clean, NAME), "id") == [
        {"id": 0, "name": "x", "Location": "here"},
        {"id": 1, "name": "x", "Location": "here"},
    ]
    tables.overwrite(numbers(clean, 3, name=1, Location="there"), NAME)  # another type
    assert [r["name"] for r in rows(tables.read_required(clean, NAME))] == [1, 1, 1]


@pytest.mark.parametrize("cut", ["before", "after"])
def test_interrupted_change_of_columns_is_finished(clean, monkeypatch, cut):
    """The job dies beside the old name, or after it is gone."""
    tables.overwrite(numbers(clean, 3), NAME)
    sql = clean.sql

    def dies(text, *args, **kwargs):
        if text.startswith("ALTER TABLE") or (cut == "before" and text.startswith("DROP TABLE IF EXISTS `swap`.`readings`")):
            raise KeyboardInterrupt
        return sql(text, *args, **kwargs)

    with monkeypatch.context() as patch:
        patch.setattr(type(clean), "sql", lambda self, text, *a, **k: dies(text, *a, **k))
        with pytest.raises(KeyboardInterrupt):
            tables.overwrite(numbers(clean, 2, name="x"), NAME)
    found = rows(tables.read_required(clean, NAME), "id")
    assert found == ([{"id": i} for i in range(3)] if cut == "before" else [{"id": i, "name": "x"} for i in range(2)])
    tables.overwrite(numbers(clean, 1, name="y"), NAME)
    assert rows(tables.read_required(clean, NAME)) == [{"id": 0, "name": "y"}]
    assert not clean.catalog.tableExists(f"{NAME}__next")


def test_a_plain_table_becomes_a_name_for_versions(clean):
    clean.sql("CREATE DATABASE swap")
    numbers(clean, 4).write.saveAsTable(NAME)  # as written before there were versions
    with pytest.raises(Exception, match="executor gone"):
        tables.overwrite(dying(clean, 40), NAME)
    assert ids(clean) == [0, 1, 2, 3]
    tables.overwrite(numbers(clean, 2), NAME)
    assert ids(clean) == [0, 1]


def test_old_versions_go_and_running_readers_finish(clean):
    tables.overwrite(numbers(clean, 4), NAME)
    reader = tables.read_required(clean, NAME)
    reader.schema  # planned, not run
    tables.overwrite(numbers(clean, 5), NAME)
    assert reader.count() in (4, 5)
    first, second = tables.versions(clean, NAME)
    tables.overwrite(numbers(clean, 6), NAME)
    found = tables.versions(clean, NAME)
    assert len(found) == 2 and found[0] == second and first not in found
    assert ids(clean) == list(range(6))
    assert not clean.catalog.tableExists(first)


def test_two_tables_whose_names_begin_alike(clean):
    other = "swap.readings__v_other"
    tables.overwrite(numbers(clean, 2), NAME)
    tables.overwrite(numbers(clean, 3), other)
    for n in (4, 5, 6):
        tables.overwrite(numbers(clean, n), NAME)
    assert tables.read_required(clean, other).count() == 3

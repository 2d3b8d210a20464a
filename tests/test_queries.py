"""Every registered query against its SQL, on the smallest data."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "scripts"))

import check_oracles  # noqa: E402

import __spark_entry__ as registry  # noqa: E402
from groundswell.plans import catalog, oracles  # noqa: E402

SMALL = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.queries(), oracles.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return check_oracles.connect(SMALL)


@pytest.fixture(autouse=True, scope="module")
def one_indicator_table():
    """Queries on the stored indicator table share one here, to save test time."""
    store, tables = catalog._stored, {}

    def stored(v, **options):
        key = tuple(sorted(options))
        if key not in tables:
            tables[key] = store(v, **options)
        return tables[key]

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(catalog, "_stored", stored)
        yield


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(registry.queries())
    assert set(ORACLES) <= set(registry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    assert not check_oracles.differences(QUERIES[name](spark, SMALL), duck, ORACLES[name])


def test_entry(spark):
    df = registry.entry(spark)
    assert "composite_score" in df.columns and df.count() > 0

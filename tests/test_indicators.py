"""The indicator table and its derived metrics."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from groundswell.operators import indicators
from groundswell.schemas import GOLD_SCHEMAS
from groundswell.sources.tables import conform

DEMOGRAPHICS = (
    "fips string, report_year int, population int, median_income double, median_age double, "
    "households int"
)
PERMITS = (
    "fips string, county_name string, report_year int, report_quarter int, "
    "total_units_permitted bigint, single_family_units bigint, multi_family_units bigint"
)


@pytest.fixture
def sources(frame):
    return {
        "acs_demographics": frame(
            [("12086", 2022, 1000, 50.0, 1.0, 1), ("12086", 2021, 1, 1.0, 1.0, 1),
             ("06037", 2022, 0, None, 1.0, 1), ("99001", 2022, 2000, 9.0, 1.0, 1)],
            DEMOGRAPHICS,
        ),
        "building_permits": frame(
            [("12086", "Dade", 2024, 1, 10, 6, 4), ("12086", "Dade", 2023, 4, 99, 9, 90),
             ("36061", "NY", 2024, 1, 5, 5, 0), ("06037", "LA", 2024, 1, 5, 5, 0)],
            PERMITS,
        ),
        "migration": frame(
            [("12086", 2023, 4, 9, 1, 8, 8.0), ("55555", 2023, 4, 9, 1, 8, 8.0)],
            "fips string, report_year int, report_quarter int, inflow bigint, outflow bigint, "
            "net_migration bigint, net_migration_rate double",
        ),
        "vacancy": frame(
            [("12086", 2024, 1, 0.08, None)],
            "fips string, report_year int, report_quarter int, vacancy_rate double, "
            "vacancy_rate_yoy_change double",
        ),
        "ssp_projections": frame(
            [("12", 2030, "SSP2", 10, 0.2), ("12", 2025, "SSP2", 9, 0.9), ("12", 2040, "SSP1", 9, 0.4),
             ("99", 2030, "SSP2", 10, None)],
            "fips string, projection_year int, scenario string, projected_population bigint, "
            "projected_growth_rate double",
        ),
    }


def compounded(population, growth, years):
    """The published formula: annual rate, compounded back, cut to a whole number."""
    annual = (1 + growth) ** (1 / years) - 1
    return int(population * (1 + annual) ** years)


def table(spark, sources, **options):
    found = indicators.build_indicator_table(spark, sources, **options)
    return {row["fips"]: row for row in rows(found, "fips")}


def test_one_row_per_area_of_permits_or_demographics(spark, sources):
    found = table(spark, sources)
    assert sorted(found) == ["06037", "12086", "36061", "99001"]  # 55555 only migrates
    dade = found["12086"]
    assert (dade["county_name"], dade["report_year"], dade["acs_year"]) == ("Dade", 2024, 2022)
    assert dade["permits_per_1k_pop"] == pytest.approx(10.0)
    assert dade["state"] == "FL" and found["99001"]["state"] == "??"


def test_missing_values_follow_the_defaults(spark, sources):
    found = table(spark, sources)
    assert found["99001"]["permits_per_1k_pop"] == 0.0  # no permits count as 0
    assert found["99001"]["occupancy_rate"] == 1.0  # no vacancy counts as full
    assert found["06037"]["permits_per_1k_pop"] is None  # population 0
    assert found["36061"]["permits_per_1k_pop"] is None  # population unknown
    assert found["12086"]["occupancy_rate"] == pytest.approx(0.92)


def test_missing_values_can_stay_unknown(spark, sources):
    found = table(spark, sources, missing="null")
    assert found["99001"]["permits_per_1k_pop"] is None
    assert found["99001"]["occupancy_rate"] is None


def test_growth_blend_and_projection(spark, sources):
    dade = table(spark, sources)["12086"]
    blend = 0.5 * 0.2 + 0.25 * (10 / 100) + 0.25 * (8 / 1000)
    assert dade["ssp_growth_rate"] == pytest.approx(blend)
    assert dade["ssp_projection_year"] == 2030
    assert dade["ssp_projected_pop"] == compounded(1000, blend, 2030 - 2022)


def test_other_scenario(spark, sources):
    dade = table(spark, sources, scenario="SSP1")["12086"]
    assert dade["ssp_projection_year"] == 2040


def test_state_column_is_found(frame):
    df = frame(
        [("00001", "12", 2030, "SSP2", 0.1)],
        "fips string, state_fips string, projection_year int, scenario string, "
        "projected_growth_rate double",
    )
    assert indicators.latest_projection(df).first()["state_code"] == "12"
    assert indicators.latest_projection(df, state_key="fips").first()["state_code"] == "00001"


def test_null_state_rate_counts_as_zero(spark, sources):
    assert table(spark, sources)["99001"]["ssp_growth_rate"] == 0.0


def test_optional_sources_may_be_missing(spark, sources):
    few = {k: sources[k] for k in ("acs_demographics", "building_permits")}
    found = indicators.build_indicator_table(spark, few)
    every = indicators.build_indicator_table(spark, sources)
    assert found.columns == every.columns and found.count() == 4
    row = {r["fips"]: r for r in found.collect()}["12086"]
    assert row["net_migration_rate"] is None and row["ssp_projection_year"] is None
    assert row["ssp_projected_pop"] == compounded(1000, 0.25 * 0.1, 10)


def test_details_schema(spark, sources):
    details = conform(
        indicators.build_indicator_table(spark, sources), GOLD_SCHEMAS["gold_county_details"]
    )
    expected = GOLD_SCHEMAS["gold_county_details"]
    assert [(f.name, f.dataType) for f in details.schema] == [
        (f.name, f.dataType) for f in expected
    ]


@pytest.mark.parametrize(
    ("state", "permits", "migration", "expected"),
    [(9.0, 0.0, 0.0, 0.50), (-9.0, 0.0, 0.0, -0.30), (None, None, None, 0.0), (0.1, 4.0, 10.0, 0.0625)],
)
def test_blend_is_clamped(frame, state, permits, migration, expected):
    df = frame([(state, permits, migration)], "s double, p double, m double")
    blend = indicators.growth_blend(F.col("s"), F.col("p"), F.col("m"))
    assert df.select(blend.alias("g")).first()["g"] == pytest.approx(expected)


def test_projection_edges(frame):
    df = frame(
        [(1000, 0.1, 2032, 2022), (1000, 0.1, 2022, 2022), (1000, 0.1, 2020, 2022),
         (1000, 0.1, None, 2022), (None, 0.1, 2030, 2022)],
        "p int, g double, y int, b int",
    )
    grown = indicators.projected_population(F.col("p"), F.col("g"), F.col("y"), F.col("b"))
    assert [r["n"] for r in df.select(grown.alias("n")).collect()] == [1099, 1000, 1000, 1099, None]

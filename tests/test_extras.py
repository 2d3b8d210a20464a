"""Operators of the design documents."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from groundswell.operators import extras


def test_crosswalk_rollup(frame):
    values = frame([("z1", 100), ("z1", 20), ("z2", 10)], "zip string, v bigint")
    shares = frame(
        [("z1", "a", 0.25), ("z1", "b", 0.75), ("z2", "a", 1.0)],
        "zip string, fips string, ratio double",
    )
    found = rows(extras.crosswalk_rollup(values, shares, "v"), "fips")
    assert [(r["fips"], r["v"]) for r in found] == [("a", 40.0), ("b", 90.0)]


def test_data_coverage(frame):
    columns = {"one": "a", "two": "b", "three": "c"}
    df = frame([("x", 1, 2, 3), ("y", 1, None, None)], "fips string, a int, b int, c int")
    found = rows(extras.data_coverage(df, columns, minimum=2), "fips")
    assert [(r["sources_present"], r["missing_sources"], r["data_coverage"]) for r in found] == [
        (3, "", "Scored"),
        (1, "two,three", "Insufficient Data"),
    ]


def test_quality_checks(frame):
    scores = frame(
        [("a", 50.0), ("b", 101.0), ("c", None), (None, 1.0)], "fips string, composite_score double"
    )
    expected = frame([("a",), ("d",), ("d",), ("e",)], "fips string")
    row = extras.quality_checks(scores, expected).first()
    assert row.asDict() == {
        "rows_checked": 4,
        "null_keys": 1,
        "scores_out_of_range": 2,
        "missing_areas": 2,
    }


def test_permit_trend(frame):
    quarterly = frame(
        [("a", "n", 2023, 1, 100, 60, 40), ("a", "n", 2024, 1, 150, 150, 0),
         ("a", "m", 2024, 2, 0, 0, 0), ("b", "n", 2024, 1, 1, 1, 0)],
        "fips string, county_name string, report_year int, report_quarter int, "
        "total_units_permitted bigint, single_family_units bigint, multi_family_units bigint",
    )
    found = rows(extras.permit_trend(quarterly, "a"), "report_year", "report_quarter")
    assert [r["yoy_change"] for r in found] == [None, 0.5, None]
    assert [r["single_family_share"] for r in found] == [0.6, 1.0, None]


def test_rank_shift(frame):
    columns = {"x": "u", "y": "v"}
    df = frame([("a", 1.0, 0.0), ("b", 0.0, 1.0)], "fips string, u double, v double")
    found = rows(extras.rank_shift(df, {"x": 1.0}, {"y": 1.0}, columns), "fips")
    assert [(r["rank_before"], r["rank_after"], r["rank_shift"]) for r in found] == [
        (1, 2, -1),
        (2, 1, 1),
    ]


def test_state_compounding(frame):
    people = frame(
        [("12086", 2020, 100), ("12001", 2020, 65), ("12086", 2019, 150), ("06037", 2020, 7)],
        "fips string, report_year int, population int",
    )
    states = extras.state_growth(people, 2020)
    assert [r["annual_rate"] for r in rows(states, "state_fips")] == [None, pytest.approx(0.1)]
    grown = extras.state_compounding(states.filter("state_fips = '12'"), 2020, [2020, 2021])
    found = rows(grown, "projection_year")
    assert [r["projected_population"] for r in found] == [
        pytest.approx(165.0),
        pytest.approx(181.5),
    ]


def test_feeder_areas(frame):
    flows = frame(
        [("36", "061", "12", "086", "5"), ("36", "061", "12", "086", "5"),
         ("06", "037", "12", "086", "10"), ("01", "001", "12", "086", "1"),
         ("96", "000", "12", "086", "99"), ("36", "061", "48", "453", "3")],
        "y1_statefips string, y1_countyfips string, y2_statefips string, y2_countyfips string, "
        "n2 string",
    )
    found = rows(extras.feeder_areas(flows, 2), "fips", "feeder_rank")
    assert [(r["fips"], r["origin"], r["people"], r["feeder_rank"]) for r in found] == [
        ("12086", "06037", 10, 1),
        ("12086", "36061", 10, 2),
        ("48453", "36061", 3, 1),
    ]


def test_scenario_range(frame):
    df = frame(
        [("12", 2030, "SSP1", 5), ("12", 2030, "SSP2", 9), ("12", 2040, "SSP1", 7)],
        "fips string, projection_year int, scenario string, projected_population bigint",
    )
    found = rows(extras.scenario_range(df), "projection_year")
    assert [(r["min_population"], r["max_population"], r["scenarios"]) for r in found] == [
        (5, 9, 2),
        (7, 7, 1),
    ]


def test_places_and_roads(frame):
    roads = frame([("motorway",), ("residential",), ("path",), (None,)], "c string")
    found = roads.select(extras.traffic_class(F.col("c")).alias("t")).collect()
    assert [r["t"] for r in found] == [5, 1, None, None]
    places = frame([("fast_food",), ("bank",)], "category string")
    assert extras.places_in(places).count() == 1

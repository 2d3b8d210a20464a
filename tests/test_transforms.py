"""Bronze to Silver transforms."""

import pytest
from conftest import column, rows

from groundswell.operators import transforms


def test_permits_are_summed_to_quarters(frame):
    monthly = frame(
        [
            ("12086", "Miami-Dade", "202501", 450, 330, 780),
            ("12086", "Miami-Dade", "202502", 400, 350, 750),
            ("12086", "Miami-Dade", "202503", 430, 350, 780),
            ("12086", "Miami-Dade", "202504", 1, 1, 2),
            ("12086", "Miami-Dade", "01/2025", 5, 5, 10),
        ],
        "fips string, county_name string, survey_date string, single_family_units bigint, "
        "multi_family_units bigint, total_units bigint",
    )
    found = rows(transforms.permits_quarterly(monthly), "report_year", "report_quarter")
    assert [(r["report_quarter"], r["total_units_permitted"]) for r in found] == [
        (None, 10),
        (1, 2310),
        (2, 2),
    ]
    assert found[1]["single_family_units"] == 1280 and found[1]["multi_family_units"] == 1030


def test_migration_rate(frame):
    bronze = frame(
        [
            ("12086", 2025, 1, 8500, 6200, 2300),
            ("36061", 2025, 1, 4200, 7800, -3600),
            ("01001", 2025, 1, 1, 0, 1),
            ("01003", 2025, 1, 1, 0, 1),
        ],
        "fips string, report_year int, report_quarter int, inflow bigint, outflow bigint, "
        "net_migration bigint",
    )
    people = frame(
        [("12086", 2800000), ("36061", 1600000), ("01001", 0)], "fips string, population int"
    )
    found = column(transforms.migration_rate(bronze, people), "net_migration_rate", "fips")
    assert found[2] == pytest.approx(2300 / 2800000 * 1000)
    assert found[3] < 0
    assert found[:2] == [None, None]


def test_vacancy_change(frame):
    bronze = frame(
        [
            ("a", 2025, 2, 100000, 4500),
            ("a", 2025, 1, 100000, 5000),
            ("a", 2025, 3, 0, 0),
            ("b", 2025, 1, 100, 50),
        ],
        "fips string, report_year int, report_quarter int, total_addresses bigint, "
        "vacant_addresses bigint",
    )
    found = rows(transforms.vacancy_change(bronze), "fips", "report_quarter")
    assert [r["vacancy_rate"] for r in found] == [0.05, 0.045, None, 0.5]
    assert found[1]["vacancy_rate_yoy_change"] == pytest.approx(-0.005)
    assert [found[i]["vacancy_rate_yoy_change"] for i in (0, 2, 3)] == [None] * 3


def test_employment_growth(frame):
    bronze = frame(
        [("a", 2025, 1, 50000, 500000000, 1), ("a", 2025, 2, 52000, 520000000, 1),
         ("b", 2025, 1, 0, 10, 1), ("b", 2025, 2, 5, 10, 1)],
        "fips string, report_year int, report_quarter int, total_employment bigint, "
        "total_wages bigint, establishments bigint",
    )
    found = rows(transforms.employment_growth(bronze), "fips", "report_quarter")
    assert found[1]["employment_growth_rate"] == pytest.approx(0.04)
    assert found[0]["avg_weekly_wage"] == pytest.approx(500000000 / (50000 * 13))
    assert found[2]["avg_weekly_wage"] is None  # nobody employed
    assert found[3]["employment_growth_rate"] is None  # base 0


def test_enrollment_sums_districts(frame):
    bronze = frame(
        [("a", 2024, "D1", 5000), ("a", 2024, "D2", 3000), ("a", 2025, "D1", 5200),
         ("a", 2025, "D2", 3100)],
        "fips string, report_year int, district_id string, total_enrollment bigint",
    )
    found = rows(transforms.enrollment_growth(bronze), "report_year")
    assert [r["total_enrollment"] for r in found] == [8000, 8300]
    assert found[1]["enrollment_growth_rate"] == pytest.approx(300 / 8000)


def test_demographics_types(frame):
    bronze = frame(
        [("a", 2025, 2800000, 55000, 38.5, 950000, "x")],
        "fips string, report_year int, population bigint, median_income bigint, "
        "median_age double, households bigint, data_source string",
    )
    assert transforms.demographics(bronze).dtypes == [
        ("fips", "string"),
        ("report_year", "int"),
        ("population", "int"),
        ("median_income", "double"),
        ("median_age", "double"),
        ("households", "int"),
    ]


def test_business_density(frame):
    bronze = frame(
        [("a", 2021, "7222", 10, 1), ("a", 2021, "44", 90, 1), ("b", 2021, "44", 5, 1)],
        "fips string, report_year int, naics_code string, establishments bigint, employees bigint",
    )
    people = frame([("a", 2000)], "fips string, population int")
    found = rows(transforms.business_density(bronze, people), "fips")
    assert [
        (r["total_establishments"], r["qsr_establishments"], r["retail_density"]) for r in found
    ] == [(100, 10, 50.0), (5, None, None)]


def test_construction_growth(frame):
    bronze = frame(
        [("a", 2023, 4, 100), ("a", 2024, 1, 150)],
        "fips string, report_year int, report_quarter int, permitted_units bigint",
    )
    found = column(
        transforms.construction_growth(bronze), "construction_growth_rate", "report_year"
    )
    assert found == [None, 0.5]


def test_projection_growth(frame):
    bronze = frame(
        [("12", 2040, "SSP2", 3500), ("12", 2030, "SSP2", 3000), ("12", 2030, "SSP1", 100),
         ("13", 2030, "SSP2", 0), ("13", 2040, "SSP2", 5)],
        "fips string, projection_year int, scenario string, projected_population bigint",
    )
    found = column(
        transforms.projection_growth(bronze),
        "projected_growth_rate",
        "fips",
        "scenario",
        "projection_year",
    )
    assert found == [0.0, 0.0, pytest.approx(500 / 3000), None, None]


def test_state_projections(frame):
    bronze = frame(
        [("12", 2030, 25000000, "x")],
        "state_fips string, projection_year int, projected_population int, data_source string",
    )
    assert dict(transforms.state_projections(bronze).dtypes)["projected_population"] == "bigint"


FLOWS = (
    "y1_statefips string, y1_countyfips string, y2_statefips string, y2_countyfips string, "
    "n2 string"
)


def test_flow_totals_skip_summary_and_bad_rows(frame):
    flows = frame(
        [
            ("36", "061", "12", "086", "100"),
            ("36", "061", " 12 ", "86", "50.9"),
            ("36", "061", "96", "000", "999"),
            ("36", "061", "97", "001", "999"),
            ("36", "061", "12", "000", "300"),
            ("36", "061", "12", "086", "d"),
            ("36", "061", "12", "086", "inf"),
            ("36", "061", "12", "086", ""),
            ("36", "061", "1x", "086", "5"),
            ("36", "061", "", "", "5"),
            ("36", "061", "1", "1", "7"),
            ("36", "061", "12", "088", None),
        ],
        FLOWS,
    )
    found = {r["fips"]: r["people"] for r in rows(transforms.flow_totals(flows, "y2"))}
    assert found == {"12086": 150, "01001": 7, "12088": 0}


def test_net_migration_keeps_both_sides(frame):
    inflow = frame(
        [("48", "453", "12", "086", "500"), ("12", "086", "48", "453", "300")], FLOWS
    )
    outflow = frame(
        [("12", "086", "48", "453", "200"), ("48", "453", "12", "086", "400"),
         ("01", "001", "48", "453", "9")],
        FLOWS,
    )
    found = {r["fips"]: r for r in rows(transforms.net_migration(inflow, outflow, 2023, 1))}
    assert {k: v["net_migration"] for k, v in found.items()} == {
        "12086": 300,
        "48453": -100,
        "01001": -9,
    }
    assert found["12086"]["data_source"] == "irs_soi"
    assert found["12086"]["report_year"] == 2023


FLOWS = """y1_statefips string, y1_countyfips string, y2_statefips string, y2_countyfips string,
    n2 string"""


def test_short_totals_and_odd_numbers_are_no_flows(frame):
    """A state total is one however it is padded, and 5d is a mark, not five people."""
    flows = frame(
        [("1", "0", "12", "086", "1"), ("2", "00", "12", "086", "2"), ("12", "00", "1", "1", "4"),
         ("1", "1", "12", "086", "5d"), ("1", "1", "12", "086", "7f"),
         ("1", "1", "12", "086", "0x1p3"), ("1", "1", "12", "86", "8.9"),
         ("1", "3", "12", "086", "1e1"), ("1", "5", "12", "086", None)],
        FLOWS,
    )
    both = rows(transforms.flow_rows(flows, origin="y1", fips="y2"), "origin")
    assert [(r["origin"], r["fips"], r["people"]) for r in both] == [
        ("01001", "12086", 8), ("01003", "12086", 10), ("01005", "12086", 0)
    ]
    out = {r["fips"]: r["people"] for r in rows(transforms.flow_totals(flows, "y1"))}
    assert out == {"01001": 8, "01003": 10, "01005": 0}


def test_one_file_for_both_sides_is_read_once(frame):
    flows = frame(
        [("36", "061", "12", "086", "5"), ("12", "086", "36", "061", "2"),
         ("97", "000", "12", "086", "9"), ("06", "037", "96", "000", "4")],
        FLOWS,
    )
    once, twice = (
        rows(transforms.net_migration(flows, other, 2023, 1), "fips")
        for other in (flows, flows.select("*"))
    )
    assert once == twice
    assert [(r["fips"], r["inflow"], r["outflow"], r["net_migration"]) for r in once] == [
        ("06037", 0, 4, -4), ("12086", 14, 2, 12), ("36061", 2, 5, -3)
    ]

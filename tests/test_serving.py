"""Lists, detail, map attributes, filters and sorting."""

import pytest
from conftest import column, rows
from pyspark.sql import functions as F

from groundswell.operators import serving
from groundswell.schemas import COMPONENTS

COMPONENT_TYPE = COMPONENTS.simpleString()
SCORES = (
    "fips string, state string, composite_score double, score_tier string, rank_national bigint, "
    f"population int, median_income double, ssp_growth_rate double, component_scores {COMPONENT_TYPE}"
)
PARTS = (1.0, None, 0.125, 0.0, None, 0.5)


@pytest.fixture
def scores(frame):
    return frame(
        [("12086", "FL", 90.0, "A", 1, 1000, 50.0, 0.1, PARTS),
         ("06037", "CA", 70.0, "B", 2, 2000, None, 0.2, PARTS),
         ("06001", "CA", 70.0, "C", 3, None, 30.0, 0.3, PARTS)],
        SCORES,
    )


@pytest.fixture
def details(frame):
    return frame(
        [("12086", 1111, None, 5.0, 1.0, 0.9, 0.4), ("06037", None, 77.0, 6.0, None, 1.0, 0.5)],
        "fips string, population int, median_income double, permits_per_1k_pop double, "
        "net_migration_rate double, occupancy_rate double, employment_per_capita double",
    )


@pytest.fixture
def features(frame, scores, details):
    boundaries = frame(
        [("12086", "12", "Dade"), ("06037", "06", None), ("06001", "06", "Alameda"),
         ("99999", "99", "Nowhere"), (None, "12", "No key"), ("", "12", "Blank key")],
        "GEOID string, STATE string, NAME string",
    )
    return serving.map_attributes(boundaries, scores, details)


def test_list_and_top(scores):
    assert [r["fips"] for r in serving.list_areas(scores).collect()] == ["12086", "06001", "06037"]
    assert [r["fips"] for r in serving.list_areas(scores, "CA").collect()] == ["06001", "06037"]
    assert serving.list_areas(scores, "ca").count() == 0
    assert [r["fips"] for r in serving.top_areas(scores, 1).collect()] == ["12086"]
    assert serving.top_areas(scores).count() == 3
    for n in (0, 501):
        with pytest.raises(ValueError):
            serving.top_areas(scores, n)


def test_detail_values_win_unless_null(scores, details):
    exported = serving.export_scores(scores)
    found = {r["fips"]: r for r in rows(serving.area_detail(exported, details))}
    assert found["12086"]["population"] == 1111 and found["12086"]["median_income"] == 50.0
    assert found["06037"]["population"] == 2000 and found["06037"]["median_income"] == 77.0
    assert found["06001"]["permits_per_1k_pop"] is None
    assert found["12086"]["component_scores"]["vacancy_change"] == 0.125
    assert found["12086"]["component_scores"]["net_migration"] is None
    assert serving.area_detail(scores, details, "06037").count() == 1
    assert serving.area_detail(scores, details, "00000").count() == 0


def test_json_export_and_bad_json(scores, frame):
    text = serving.export_scores(scores).first()["component_scores"]
    assert "net_migration" not in text and '"building_permits":1.0' in text
    bad = frame([("not json",), ('{"net_migration": 0.5',), (None,)], "t string")
    parsed = bad.select(serving.parse_components(F.col("t")).alias("c")).collect()
    assert [r["c"] for r in parsed] == [None, None, None]


def test_component_long(scores):
    found = rows(serving.component_long(scores).filter("fips = '12086'"), "indicator")
    shown = {r["indicator"]: (r["display_value"], r["has_data"]) for r in found}
    assert len(found) == 6
    assert shown["building_permits"] == (100, True)
    assert shown["net_migration"] == (0, False)
    assert shown["vacancy_change"] == (13, True)
    assert {r["tier_label"] for r in found} == {"Top 10%"}


def test_map_keeps_unscored_boundaries(features):
    found = {r["GEOID"]: r for r in rows(features)}
    assert len(found) == 6
    assert found["99999"]["composite_score"] is None
    assert found["12086"]["permits_per_1k_pop"] == 5.0
    assert found["06001"]["permits_per_1k_pop"] is None and found["06001"]["rank_national"] == 3


def test_bounds_ignore_missing_and_infinite(frame):
    df = frame(
        [(1, float("nan")), (5, float("inf")), (None, None)], "population int, x double"
    )
    row = serving.filter_bounds(df, ["population", "x"]).first()
    assert (row["min_population"], row["max_population"], row["min_x"], row["max_x"]) == (1, 5, 0, 0)


def kept(features, **criteria):
    return sorted(column(serving.filter_areas(features, serving.AreaFilter(**criteria)), "GEOID"))


def test_filter_lets_missing_values_pass(features):
    assert kept(features) == ["06001", "06037", "12086", "99999"]  # no key, no row
    assert kept(features, ranges={"population": (1500, 3000)}) == ["06001", "06037", "99999"]
    assert kept(features, score=(70.0, 70.0)) == ["06001", "06037", "99999"]
    assert kept(features, tiers=("A", "B")) == ["06037", "12086"]
    assert kept(features, tiers=()) == []
    assert kept(features, states=("06",)) == ["06001", "06037"]
    assert kept(features, states=("06",), tiers=("C",), ranges={"median_income": (0, 29)}) == []


def test_match_count(features):
    row = serving.match_count(features, serving.AreaFilter(tiers=("A", "B"))).first()
    assert (row["matching"], row["total"]) == (2, 6)


def test_default_filter_matches_every_keyed_feature(features):
    criteria = serving.default_filter(serving.filter_bounds(features))
    assert serving.filter_areas(features, criteria).count() == 4


def test_highlight_takes_missing_as_lowest(features):
    def shown(**options):
        found = serving.highlight_areas(features, **options).filter("highlighted")
        return sorted(column(found, "GEOID"), key=str)

    assert len(shown()) == 6
    assert shown(min_score=70.0) == ["06001", "06037", "12086"]
    assert shown(tier="F") == ["", "99999", None]
    assert shown(state="06", tier="B") == ["06037"]


def names(df):
    return [r["GEOID"] for r in df.filter("GEOID <> ''").collect()]


def test_sorting_defaults(features):
    assert names(serving.sorted_results(features, "score")) == ["12086", "06001", "06037", "99999"]
    assert names(serving.sorted_results(features, "population", descending=False))[:2] == [
        "06001",
        "99999",
    ]
    assert names(serving.sorted_results(features, "tier", descending=False))[-1] == "99999"
    assert names(serving.sorted_results(features, "name", descending=False))[0] == "06037"
    assert names(serving.sorted_results(features, "state"))[0] == "12086"
    assert names(serving.sorted_results(features, "rank", descending=False))[-1] == "06001"
    assert names(serving.sorted_results(features, "income"))[0] == "12086"
    with pytest.raises(KeyError):
        serving.sorted_results(features, "colour")


def test_state_list(features):
    assert [(r["state_code"], r["state"]) for r in serving.state_list(features).collect()] == [
        ("06", "CA"),
        ("12", "FL"),
    ]


def test_area_trends(frame):
    grain = "fips string, report_year int, report_quarter int, "
    found = rows(
        serving.area_trends(
            frame(
                [("a", 2024, 1, "x", 5), ("a", 2024, 1, "y", 5), ("b", 2024, 1, "x", 5)],
                grain + "county_name string, total_units_permitted bigint",
            ),
            frame([("a", 2024, 2, 1.5)], grain + "net_migration_rate double"),
            frame([("a", 2024, 1, 0.1)], grain + "vacancy_rate_yoy_change double"),
            frame([("a", 2023, 4, 0.2)], grain + "employment_growth_rate double"),
            frame(
                [("a", 2022, 1000), ("a", 2021, 1)],
                "fips string, report_year int, population int",
            ),
            fips="a",
        ),
        "report_year",
        "report_quarter",
    )
    assert [(r["report_year"], r["report_quarter"]) for r in found] == [
        (2023, 4),
        (2024, 1),
        (2024, 2),
    ]
    assert found[1]["permits_per_1k_pop"] == 10.0
    assert found[1]["vacancy_rate_yoy_change"] == 0.1
    assert found[2]["net_migration_rate"] == 1.5


def test_names_sort_as_people_read_them(spark):
    """Spaces and marks before letters, accents after plain letters, small before capital."""
    order = [
        "", "De Kalb", "dekalb", "Dekalb", "DeKalb", "Dona Ana", "Doña Ana", "Donz",
        "La Salle", "lasalle", "LaSalle", "O'Brien", "Obrien", "Zapata", "Zäpata", "zebra",
    ]
    rows_ = [(f"{i * 7 % 16:05d}", name or None, "01", 1.0, "A", 1) for i, name in enumerate(order)]
    schema = "GEOID string, NAME string, STATE string, composite_score double, score_tier string, rank_national int"
    features = spark.createDataFrame(rows_, schema).repartition(5)
    found = rows(serving.sorted_results(features, "name", descending=False), "position")
    assert [r["NAME"] or "" for r in found] == order
    assert [r["position"] for r in found] == list(range(1, 17))
    down = rows(serving.sorted_results(features, "name"), "position")
    assert [r["NAME"] or "" for r in down] == order[::-1]
    assert serving.sorted_results(features, "name").schema["NAME"].dataType == features.schema["NAME"].dataType

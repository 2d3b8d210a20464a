"""Bronze, Silver and Gold jobs over catalog tables, and the landing stream."""

import json

import pytest
from conftest import rows

from groundswell.config import DEFAULT_WEIGHTS
from groundswell.plans import bronze, pipeline
from groundswell.schemas import GOLD_SCHEMAS, SILVER_SCHEMAS
from groundswell.sources import run_log, tables
from groundswell.streaming import landing

PERMIT = "{date},{state},{county},3,5,{name},1,{one},0,0,{two},0,0,{few},0,0,{many}\n"


def permit_lines(*cells):
    text = "Survey,FIPS,FIPS,Region\nDate,State,County,Code\n"
    for date, state, county, name, units in cells:
        text += PERMIT.format(
            date=date, state=state, county=county, name=name, one=units, two=1, few=1, many=1
        )
    return text


def write(folder, name, text):
    path = folder / name
    path.write_text(text if isinstance(text, str) else json.dumps(text))
    return str(path)


COUNTIES = [("12", "086"), ("36", "061"), ("06", "037")]


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    """Every Bronze table but the wages and vacancy ones, loaded from staged files."""
    folder = tmp_path_factory.mktemp("staged")
    for month in ("202401", "202402"):
        path = write(
            folder,
            f"p{month}.txt",
            permit_lines(*[(month, s, c, f"Area {s}", 10 * int(s)) for s, c in COUNTIES]),
        )
        bronze.load_building_permits(spark, path, 2024, int(month[4:]))
        bronze.load_building_permits(spark, path, 2024, int(month[4:]))  # a repeated download
    census = [["B01003_001E", "B19013_001E", "B01002_001E", "B11001_001E", "NAME", "state", "county"]]
    census += [[str(1000 * (i + 1)), "50000", "40.0", "300", "x", s, c] for i, (s, c) in enumerate(COUNTIES)]
    census += [["none", "1", "1", "1", "x", "48", "453"]]
    bronze.load_acs_demographics(spark, write(folder, "acs.json", census), 2022)
    enrolled = [["B14001_002E", "NAME", "state", "county"]]
    enrolled += [[str(100 * (i + 1)), "x", s, c] for i, (s, c) in enumerate(COUNTIES)]
    bronze.load_school_enrollment(spark, write(folder, "school.json", enrolled), 2022)
    firms = [["ESTAB", "EMP", "NAICS2017", "state", "county"]]
    firms += [["10", "-", code, s, c] for s, c in COUNTIES for code in ("44", "7222")]
    bronze.load_business_patterns(spark, write(folder, "cbp.json", firms), 2021)
    people = [["POP", "YEAR", "SEX", "state"], ["100", "2030", "0", "6"]]
    bronze.load_national_projections(spark, write(folder, "proj.json", people))
    bronze.load_hud_construction(
        spark, write(folder, "hud.txt", permit_lines(("202312", "12", "086", "A", 7))), 2023, 4
    )
    flows = "y1_statefips,y1_countyfips,y2_statefips,y2_countyfips,n1,n2\n36,061,12,086,1,50\n"
    moved = write(folder, "flows.csv", flows)
    bronze.load_migration(spark, moved, moved, 2023, 4)
    return folder


def log(spark, source):
    return rows(spark.table("bronze._ingestion_log").filter(f"source_name = '{source}'"), "started_at")


def test_run_log_counts_loaded_and_rejected_rows(spark, loaded):
    runs = log(spark, "building_permits")
    assert [(r["status"], r["rows_loaded"], r["rows_rejected"]) for r in runs] == [
        ("success", 3, 0)
    ] * 4
    (run,) = log(spark, "acs_demographics")
    assert (run["rows_loaded"], run["rows_rejected"], run["error_msg"]) == (3, 1, None)
    assert run["completed_at"] >= run["started_at"]


def test_bronze_stamps(spark, loaded):
    table = spark.table("bronze.migration")
    row = rows(table, "fips")[0]
    assert str(row["source_date"]) == "2023-12-01" and row["ingested_at"] is not None
    assert rows(spark.table("bronze.acs_demographics"))[0]["source_year"] == 2022
    assert str(rows(spark.table("bronze.building_permits"))[0]["source_date"]) == "2024-01-01"


def test_empty_load_is_a_success(spark, loaded, tmp_path):
    bronze.load_vacancy(
        spark,
        write(tmp_path, "v.json", [["B25002_001E", "B25002_003E", "state", "county"]]),
        2024,
        1,
    )
    assert [(r["status"], r["rows_loaded"]) for r in log(spark, "vacancy")] == [("success", 0)]
    spark.sql("DROP TABLE bronze.vacancy")


def test_failed_load_is_logged_and_raised(spark):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        bronze.load_employment(spark, "/no/such/file.csv", 2024, 1)
    (run,) = log(spark, "employment")
    assert run["status"] == "failure" and run["rows_loaded"] is None
    assert "PATH_NOT_FOUND" in run["error_msg"] and len(run["error_msg"]) <= run_log.MAX_ERROR


def test_silver_then_gold(spark, loaded):
    written = pipeline.run_silver(spark)
    assert written[0] == "silver_acs_demographics"
    assert "silver_employment" not in written and "silver_migration" in written
    for name in written:
        types = [f.dataType for f in spark.table(f"silver.{name}").schema]
        assert types == [f.dataType for f in SILVER_SCHEMAS[name]]
    permits = rows(spark.table("silver.silver_building_permits"), "fips")
    # two months, each once although loaded twice
    assert [r["total_units_permitted"] for r in permits] == [126, 246, 726]

    pipeline.run_gold(spark)
    scores = rows(spark.table("gold.gold_county_growth_score"), "rank_national")
    assert [r["rank_national"] for r in scores] == [1, 2, 3]
    assert {r["state"] for r in scores} == {"FL", "NY", "CA"}
    assert [f.name for f in spark.table("gold.gold_county_growth_score").schema] == (
        GOLD_SCHEMAS["gold_county_growth_score"].fieldNames()
    )
    assert spark.table("gold.gold_county_details").count() == 3
    assert pipeline.current_weights(spark) == DEFAULT_WEIGHTS
    assert all(r["component_scores"]["employment_growth"] is None for r in scores)


def test_saved_weights_survive_and_apply(spark, loaded):
    pipeline.run_silver(spark)
    pipeline.run_gold(spark)
    updates = {name: 0.0 for name in DEFAULT_WEIGHTS} | {"school_enrollment_growth": 1.0, "x": 9.0}
    pipeline.save_weights(spark, updates)
    pipeline.run_gold(spark)  # keeps the saved weights
    saved = pipeline.current_weights(spark)
    assert saved["school_enrollment_growth"] == 1.0 and "x" not in saved
    scores = rows(spark.table("gold.gold_county_growth_score"), "fips")
    enrolled = rows(spark.table("gold.gold_county_details"), "fips")
    low = min(r["enrollment_per_capita"] for r in enrolled)
    high = max(r["enrollment_per_capita"] for r in enrolled)
    for score, row in zip(scores, enrolled):
        share = 0.5 if high == low else (row["enrollment_per_capita"] - low) / (high - low)
        assert score["composite_score"] == pytest.approx(share * 100)
    for name in ("gold_scoring_config", "gold_scoring_config_next"):
        spark.sql(f"DROP TABLE gold.{name}")


def test_weights_of_a_change_cut_off_are_found(spark, loaded):
    pipeline.save_weights(spark, {"net_migration": 0.5})
    spark.sql("DROP TABLE gold.gold_scoring_config")  # as when the replacement died
    assert pipeline.current_weights(spark)["net_migration"] == 0.5
    pipeline.save_weights(spark, {"vacancy_change": 0.1})
    saved = pipeline.current_weights(spark)
    assert (saved["net_migration"], saved["vacancy_change"]) == (0.5, 0.1)
    for name in ("gold_scoring_config", "gold_scoring_config_next"):
        spark.sql(f"DROP TABLE gold.{name}")


def test_export_has_no_nested_types(spark, loaded):
    pipeline.run_silver(spark)
    pipeline.run_gold(spark)
    pipeline.run_export(spark)
    row = spark.table("serving.gold_county_growth_score").first()
    assert set(json.loads(row["component_scores"])) <= set(DEFAULT_WEIGHTS)
    assert spark.table("serving.gold_county_details").count() == 3
    assert spark.table("serving.gold_scoring_config").count() == 6


def test_optional_table(spark):
    schema = SILVER_SCHEMAS["silver_vacancy"]
    missing = tables.read_optional(spark, "silver.no_such_table", schema)
    assert missing.count() == 0 and missing.schema == schema


@pytest.fixture
def landing_table(spark):
    name = "bronze.building_permits_landed"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    yield name
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_landing_loads_each_file_once(spark, tmp_path, landing_table):
    drop, state = tmp_path / "drop", str(tmp_path / "state")
    drop.mkdir()
    first = permit_lines(("202401", "12", "086", "A", 5), ("202401", "xx", "086", "A", 5))
    write(drop, "one.txt", first)
    assert landing.load_new_permits(spark, str(drop), state) == 1
    assert landing.load_new_permits(spark, str(drop), state) == 0  # nothing new
    write(drop, "two.txt", permit_lines(("202402", "12", "086", "A", 6)))
    assert landing.load_new_permits(spark, str(drop), state) == 1
    found = rows(spark.table(landing_table), "survey_date")
    assert [str(r["source_date"]) for r in found] == ["2024-01-01", "2024-02-01"]
    assert [(r["survey_date"], r["total_units"], r["batch_id"]) for r in found] == [
        ("202401", 8, 0),
        ("202402", 9, 1),
    ]
    runs = log(spark, "building_permits")[-2:]
    assert [(r["rows_loaded"], r["rows_rejected"]) for r in runs] == [(1, 1), (1, 0)]


def test_failed_landing_batch_is_logged_and_raised(spark, tmp_path, landing_table):
    drop = tmp_path / "drop"
    drop.mkdir()
    write(drop, "one.txt", permit_lines(("202401", "12", "086", "A", 5)))

    def parse(lines):
        raise ValueError("no such layout")

    with pytest.raises(Exception, match="no such layout"):
        landing.load_new_files(
            spark, "building_permits", str(drop), str(tmp_path / "state"), parse
        )
    last = log(spark, "building_permits")[-1]
    assert last["status"] == "failure" and "no such layout" in last["error_msg"]


def test_landing_batch_retry_does_not_double(spark, tmp_path, landing_table):
    """Without the checkpoint the same batch number is written again, over itself."""
    drop = tmp_path / "drop"
    drop.mkdir()
    write(drop, "one.txt", permit_lines(("202401", "12", "086", "A", 5)))
    landing.load_new_permits(spark, str(drop), str(tmp_path / "first"))
    landing.load_new_permits(spark, str(drop), str(tmp_path / "second"))
    assert spark.table(landing_table).count() == 1


def test_silver_reads_landed_rows_too(spark, loaded, tmp_path, landing_table):
    """A landed file of a new month adds to the loaded ones; a repeated month does not."""
    drop = tmp_path / "drop"
    drop.mkdir()
    write(drop, "new.txt", permit_lines(("202403", "12", "086", "Area 12", 97)))
    write(drop, "again.txt", permit_lines(("202402", "36", "061", "Area 36", 360)))
    landing.load_new_permits(spark, str(drop), str(tmp_path / "state"))
    pipeline.run_silver(spark)
    permits = rows(spark.table("silver.silver_building_permits"), "fips")
    assert [r["total_units_permitted"] for r in permits] == [126, 246 + 100, 726]

"""Landing folders of every source: each file once, whatever its format."""

import json

import pytest
from conftest import rows
from test_files import PERMITS, WAGES

from groundswell.plans import pipeline
from groundswell.streaming import landing

COUNTIES = [("12", "086"), ("36", "061"), ("06", "037")]


@pytest.fixture
def place(spark, tmp_path):
    """Writes a file of the landing folder; runs a source's stream over it."""

    class Place:
        drop, state = tmp_path / "drop", str(tmp_path / "state")

        def write(self, name, content):
            path = self.drop / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(content if isinstance(content, str) else json.dumps(content, indent=1))

        def run(self, source, state=None, **options):
            return landing.load_landed(spark, source, str(self.drop), state or self.state, **options)

    Place.drop.mkdir()
    yield Place()
    for source in landing.SOURCES:
        for name in (f"{source}_landed", f"{source}_landed_files"):
            spark.sql(f"DROP TABLE IF EXISTS bronze.{name}")


def table(spark, source, *order):
    return rows(spark.table(f"bronze.{source}_landed"), *order)


def status(spark, source):
    found = rows(spark.table(f"bronze.{source}_landed_files"), "batch_id", "file")
    return [(r["file"].rsplit("/", 1)[1], r["status"], r["rows_loaded"], r["rows_rejected"]) for r in found]


def last_run(spark, source):
    runs = spark.table("bronze._ingestion_log").filter(f"source_name = '{source}'")
    return rows(runs, "started_at")[-1]


def people(*values):
    header = ["B01003_001E", "B19013_001E", "B01002_001E", "B11001_001E", "NAME", "state", "county"]
    return [header] + [[v, "5", "40.0", "3", "x", s, c] for v, (s, c) in zip(values, COUNTIES)]


def test_census_payloads_by_path_period(spark, place):
    place.write("year=2022/a.json", people("10", "none", "30"))
    place.write("year=2023/b.json", people("11"))
    place.write("c.json", people("12"))  # no year
    place.write("year=2021/d.json", "not a payload")
    assert place.run("acs_demographics") == 1
    found = table(spark, "acs_demographics", "report_year", "fips")
    assert [(r["fips"], r["report_year"], r["source_year"], r["population"]) for r in found] == [
        ("06037", 2022, 2022, 30),
        ("12086", 2022, 2022, 10),
        ("12086", 2023, 2023, 11),
    ]
    assert status(spark, "acs_demographics") == [
        ("c.json", "failure", None, None),
        ("d.json", "success", 0, 1),
        ("a.json", "success", 2, 1),
        ("b.json", "success", 1, 0),
    ]
    run = last_run(spark, "acs_demographics")
    assert (run["status"], run["rows_loaded"], run["rows_rejected"]) == ("success", 3, 2)
    assert "c.json: no year in the path" in run["error_msg"]
    assert place.run("acs_demographics") == 0  # nothing new
    place.write("year=2024/e.json", people("13"))
    assert place.run("acs_demographics") == 1
    assert len(table(spark, "acs_demographics")) == 4


def test_other_census_sources(spark, place):
    place.write("vacancy/year=2024/quarter=1/v.json", [["B25002_001E", "B25002_003E", "state", "county"], ["40", "3", "6", "37"]])
    place.write("school/year=2022_quarter=1.json", [["B14001_002E", "state", "county"], ["7", "12", "086"], ["-", "36", "061"]])
    place.write("firms/year=2021.json", [["ESTAB", "EMP", "NAICS2017", "state", "county"], ["10", "-", "44", "12", "086"]])
    place.write("people/p.json", [["POP", "YEAR", "SEX", "state"], ["100", "2030", "0", "6"], ["x", "2030", "0", "6"]])

    def run(source, folder):
        assert landing.load_landed(spark, source, str(place.drop / folder), f"{place.state}-{folder}") == 1
        return table(spark, source)

    (vacancy,) = run("vacancy", "vacancy")
    assert (vacancy["fips"], vacancy["report_quarter"], str(vacancy["source_date"])) == ("06037", 1, "2024-03-01")
    (school,) = run("school_enrollment", "school")
    assert (school["total_enrollment"], str(school["source_date"])) == (7, "2022-01-01")
    (firms,) = run("business_patterns", "firms")
    assert (firms["establishments"], firms["employees"], firms["source_year"]) == (10, 0, 2021)
    (state,) = run("national_projections", "people")
    assert (state["state_fips"], state["projected_population"]) == ("06", 100)
    assert status(spark, "national_projections") == [("p.json", "success", 1, 1)]


def test_headed_and_line_formats(spark, place):
    place.write("wages/year=2024/quarter=1/w.csv", WAGES)
    header, *body = WAGES.splitlines()
    order = [3, 0, 1, 2, *range(4, 12)]  # another order of columns
    swap = lambda line: ",".join(line.split(",")[i] for i in order)
    place.write("wages/year=2024/quarter=2/x.csv", "\n".join(map(swap, [header, *body])) + "\n")
    place.write("wages/year=2024/quarter=3/y.csv", "a,b\n1,2\n")
    place.write("permits/p.txt", PERMITS)
    place.write("annual/year=2022/quarter=4/h.txt", PERMITS)

    def run(source, folder):
        assert landing.load_landed(spark, source, str(place.drop / folder), f"{place.state}-{folder}") == 1

    run("employment", "wages")
    found = table(spark, "employment", "report_quarter", "fips")
    assert [(r["fips"], r["report_quarter"]) for r in found] == [("08014", 1), ("20091", 1), ("31055", 1), ("08014", 2)]
    by_file = status(spark, "employment")
    assert by_file[:2] == [("w.csv", "success", 3, 1), ("x.csv", "success", 1, 0)]
    assert [row[:2] for row in by_file[2:]] == [("y.csv", "failure")]
    run("building_permits", "permits")
    assert status(spark, "building_permits") == [("p.txt", "success", 3, 3)]
    assert {str(r["source_date"]) for r in table(spark, "building_permits")} == {"2024-07-01"}
    run("hud_construction", "annual")
    assert status(spark, "hud_construction") == [("h.txt", "success", 3, 3)]
    assert {r["report_quarter"] for r in table(spark, "hud_construction")} == {4}


FLOWS = "y1_statefips,y1_countyfips,y2_statefips,y2_countyfips,n1,n2\n36,061,12,086,1,{}\n"


def test_flows_wait_for_the_other_direction(spark, place):
    place.write("year=2023/quarter=4/direction=in/a.csv", FLOWS.format(50))
    place.write("year=2022/quarter=4/direction=in/b.csv", FLOWS.format(7))
    place.write("year=2022/quarter=4/direction=out/c.csv", FLOWS.format(3))
    assert place.run("migration") == 1
    assert [r[:2] for r in status(spark, "migration")] == [
        ("b.csv", "success"), ("c.csv", "success"), ("a.csv", "waiting"),
    ]
    found = table(spark, "migration", "fips")
    assert [(r["fips"], r["report_year"], r["inflow"], r["outflow"]) for r in found] == [
        ("12086", 2022, 7, 0),
        ("36061", 2022, 0, 3),
    ]
    place.write("year=2023/quarter=4/direction=out/d.csv", FLOWS.format(20))
    assert place.run("migration") == 1
    late = [r for r in table(spark, "migration", "fips") if r["report_year"] == 2023]
    assert [(r["fips"], r["net_migration"], r["batch_id"]) for r in late] == [("12086", 50, 1), ("36061", -20, 1)]
    place.write("year=2023/quarter=4/direction=in/e.csv", FLOWS.format(60))  # a new download
    assert place.run("migration") == 1
    clean = pipeline.RELOADS["migration"](pipeline.read_bronze(spark, "migration").where("report_year = 2023 AND batch_id >= 0"))
    assert [(r["fips"], r["net_migration"]) for r in rows(clean, "fips")] == [("12086", 60), ("36061", -20)]


def test_repeated_batch_overwrites_its_first_try(spark, place, monkeypatch):
    place.write("year=2022/a.json", people("10", "20"))
    place.write("year=2023/b.json", people("11"))
    write, calls = landing.replace_partition, []

    def dies(df, name, *args):
        write(df, name, *args)
        calls.append(name)
        if len(calls) == 1:  # the rows are there, the batch is not committed
            raise RuntimeError("driver gone")

    with monkeypatch.context() as patch:
        patch.setattr(landing, "replace_partition", dies)
        with pytest.raises(Exception, match="driver gone"):
            place.run("acs_demographics")
    assert last_run(spark, "acs_demographics")["status"] == "failure"
    assert place.run("acs_demographics") == 1
    found = table(spark, "acs_demographics", "report_year", "fips")
    assert [(r["fips"], r["report_year"], r["batch_id"]) for r in found] == [
        ("12086", 2022, 0), ("36061", 2022, 0), ("12086", 2023, 0),
    ]
    assert [r[1:] for r in status(spark, "acs_demographics")] == [("success", 2, 0), ("success", 1, 0)]


def test_batches_are_bounded(spark, place):
    for year in range(2010, 2015):
        place.write(f"year={year}/a b[{year}].json", people("10"))
    assert place.run("acs_demographics", max_files=2) == 3
    assert len(table(spark, "acs_demographics")) == 5

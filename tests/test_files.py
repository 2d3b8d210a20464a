"""Staged-file loaders on small files."""

import json

import pytest
from conftest import rows

from groundswell.sources import files, records

HEADERS = "When,Where,Where,Part,Part,Who,,size 1,,,size 2,,,size 3,,,size 5,,"
PERMITS = HEADERS + """
Month,State,Area,R,D,Title,B,U,V,B,U,V,B,U,V,B,U,V

202407,20,91,2,4,Alder County     ,70,72,900,3,6,80,1,4,60,2,31,400
202407,08,014,4,8,"Birch, ""Old"" County",11,12,500,2,,30,1, 9 ,20,3,15,7
202407,31,055,2,4,Cedar County,5,8,100,0,2,0,0,3,0,0,0,0
202407,08,014,4,8,Short row,11,12
202407,xx,014,4,8,Bad code,1,1,1,1,1,1,1,1,1,1,1,1
202407,08,001,4,8,Bad number,1,some,1,1,1,1,1,1,1,1,1,1
July 24,08,001,4,8,Bad date,1,1,1,1,1,1,1,1,1,1,1,1
"""


def write(folder, name, text):
    path = folder / name
    path.write_text(text)
    return str(path)


def payload(header, *records):
    return json.dumps([header, *records])


def test_monthly_permits(spark, tmp_path):
    parsed = files.parse_permits(files.read_permits(spark, write(tmp_path, "p.txt", PERMITS)))
    good = rows(files.accepted(parsed), "fips")
    assert [r["fips"] for r in good] == ["08014", "20091", "31055"]
    alder = good[1]
    assert alder["county_name"] == "Alder County" and alder["survey_date"] == "202407"
    assert alder["single_family_units"] == 72 and alder["single_family_bldgs"] == 70
    assert alder["multi_family_units"] == 6 + 4 + 31
    assert alder["total_units"] == 72 + 41
    birch = good[0]  # quoted comma, doubled quote, blank field, padded number
    assert birch["county_name"] == 'Birch, "Old" County'
    assert birch["multi_family_units"] == 0 + 9 + 15
    reasons = [r["reject_reason"] for r in rows(files.rejected(parsed), "reject_reason")]
    assert reasons == ["bad fips", "bad survey_date", "bad total_units"]


def test_annual_permits(spark, tmp_path):
    text = (
        "Title line\nNames\n"
        "202212,20,091,2,4,Alder County,-,61,-,-,8,-,-,7,-,-,24\n"
        "202212,31,055,2,4,Cedar County,-,19,-,-,1,-,-,0,-,-,5\n"
    )
    fields = files.read_permits(spark, write(tmp_path, "a.txt", text))
    good = rows(files.accepted(files.parse_construction(fields, 2022, 4)), "fips")
    assert [(r["fips"], r["permitted_units"]) for r in good] == [("20091", 100), ("31055", 25)]
    assert good[0]["report_year"] == 2022 and good[0]["report_quarter"] == 4
    assert good[0]["data_source"] == "census_bps"


def census(spark, folder, header, *records):
    return files.read_census(spark, write(folder, "c.json", payload(header, *records)))


def test_demographics(spark, tmp_path):
    header = ["B01003_001E", "B19013_001E", "B01002_001E", "B11001_001E", "NAME", "state", "county"]
    raw = census(
        spark,
        tmp_path,
        header,
        ["61500", "48250", "41.2", "23100", "Alder County, State", "20", "091"],
        ["9300", "-", "44.0", "", "Cedar County, State", "31", "055"],
        ["-", "1", "1", "1", "No population", "06", "037"],
        ["5", "many", "1", "1", "Bad income", "06", "039"],
        ["5", "1", "old", "1", "Bad age", "06", "041"],
    )
    parsed = files.parse_demographics(raw, 2022)
    good = rows(files.accepted(parsed), "fips")
    assert len(good) == 2
    assert good[0] == {
        "fips": "20091",
        "report_year": 2022,
        "county_name": "Alder County, State",
        "population": 61500,
        "median_income": 48250,
        "median_age": 41.2,
        "households": 23100,
        "data_source": "census_acs",
    }
    assert good[1]["median_income"] is None and good[1]["households"] is None
    assert files.rejected(parsed).count() == 3


def test_vacancy_pads_codes_and_rejects_bad_numbers(spark, tmp_path):
    raw = census(
        spark,
        tmp_path,
        ["B25002_001E", "B25002_003E", "NAME", "state", "county"],
        ["40200", "3015", "a", "6", "37"],
        ["10", None, "b", "36", "061"],
    )
    parsed = files.parse_vacancy(raw, 2024, 1)
    (good,) = rows(files.accepted(parsed))
    assert (good["fips"], good["total_addresses"], good["vacant_addresses"]) == (
        "06037",
        40200,
        3015,
    )
    assert good["report_year"] == 2024
    assert [r["reject_reason"] for r in rows(files.rejected(parsed))] == ["bad vacant_addresses"]


def test_enrollment_skips_null_tokens(spark, tmp_path):
    raw = census(
        spark,
        tmp_path,
        ["B14001_002E", "NAME", "state", "county"],
        ["7710", "a", "12", "086"],
        ["-", "b", "36", "061"],
        ["", "c", "36", "063"],
        [None, "d", "36", "065"],
    )
    parsed = files.parse_enrollment(raw, 2023)
    assert [(r["fips"], r["total_enrollment"]) for r in rows(files.accepted(parsed))] == [
        ("12086", 7710)
    ]
    assert files.rejected(parsed).count() == 0


def test_business_null_tokens_are_zero(spark, tmp_path):
    raw = census(
        spark,
        tmp_path,
        ["ESTAB", "EMP", "NAICS2017", "state", "county"],
        ["1250", "18500", "7222", "12", "086"],
        ["280", "-", "72", "36", "061"],
        ["many", "1", "72", "36", "063"],
    )
    parsed = files.parse_business(raw, 2021)
    good = rows(files.accepted(parsed), "fips")
    assert [(r["naics_code"], r["establishments"], r["employees"]) for r in good] == [
        ("7222", 1250, 18500),
        ("72", 280, 0),
    ]
    assert files.rejected(parsed).count() == 1


def test_state_projections_keep_both_sexes_together(spark, tmp_path):
    raw = census(
        spark,
        tmp_path,
        ["POP", "YEAR", "SEX", "state"],
        ["24500000", "2030", "0", "12"],
        ["12000000", "2030", "1", "12"],
        ["19800000", "2030", "0", "6"],
        ["1", "2030", "0", ""],
        ["x", "2030", "0", "36"],
    )
    parsed = files.parse_state_projections(files.state_projection_rows(raw))
    good = rows(files.accepted(parsed), "state_fips")
    assert [(r["state_fips"], r["projected_population"]) for r in good] == [
        ("06", 19800000),
        ("12", 24500000),
    ]
    assert files.rejected(parsed).count() == 1


def test_state_projections_without_sex_column(spark, tmp_path):
    raw = census(spark, tmp_path, ["POP", "YEAR", "state"], ["5", "2030", "12"])
    parsed = files.parse_state_projections(files.state_projection_rows(raw))
    assert files.accepted(parsed).count() == 1


def test_payload_with_only_a_header_is_empty(spark, tmp_path):
    raw = census(spark, tmp_path, ["POP", "YEAR", "SEX", "state"])
    assert files.state_projection_rows(raw).count() == 0


def test_large_payloads_are_read_by_line(spark, tmp_path):
    """Files with their own column order; a bracket in a text; records sharing a line."""
    write(tmp_path, "a.json", '[["POP","YEAR","SEX","state"],\n["1","2030","0","06"],\n["2","2030","0","1]2"]]\n')
    write(tmp_path, "b.json", '[["state","POP","YEAR","SEX"],["36","3","2040","0"],\n ["48","4","2040","0"] ]')
    write(tmp_path, "c.json", '[["POP","YEAR","SEX","state"]]')
    whole = files.read_census(spark, str(tmp_path))
    by_line = files.read_census(spark, str(tmp_path), layout="lines")
    assert whole.count() == 3 and by_line.count() == 4
    found = [rows(files.state_projection_rows(df), "POP") for df in (whole, by_line)]
    assert found[0] == found[1]
    assert [(r["POP"], r["state"]) for r in found[0]] == [
        ("1", "06"),
        ("2", "1]2"),
        ("3", "36"),
        ("4", "48"),
    ]


def test_payloads_that_cannot_be_read_are_rejects(spark, tmp_path):
    header = ["POP", "YEAR", "SEX", "state"]
    record = ["7", "2030", "0", "06"]
    for folder in ("indented", "broken", "headless", "half"):
        (tmp_path / folder).mkdir()
    write(tmp_path / "indented", "a.json", json.dumps([header, record], indent=2))
    write(tmp_path / "broken", "a.json", json.dumps([header, record])[:-9])
    write(tmp_path / "headless", "a.json", json.dumps([record, record]))
    write(tmp_path / "half", "a.json", json.dumps([header]) [:-1] + ',\n["7","2030","0","06"],\n["8","20')

    def counts(folder, layout):
        raw = files.read_census(spark, str(tmp_path / folder), layout)
        parsed = files.parse_state_projections(files.state_projection_rows(raw))
        reasons = {r["reject_reason"] for r in rows(files.rejected(parsed))}
        assert reasons <= {"bad payload"}
        return files.accepted(parsed).count(), files.rejected(parsed).count()

    assert counts("indented", "whole") == (1, 0)
    assert counts("broken", "whole") == (0, 1)
    assert counts("headless", "whole") == (0, 1)
    assert counts("half", "whole") == (0, 1)
    assert counts("half", "lines") == (1, 1)
    assert counts("indented", "lines")[0] == 0 and counts("indented", "lines")[1] > 0
    assert counts("headless", "lines")[0] == 0 and counts("headless", "lines")[1] > 0


def test_malformed_permit_date_is_a_reject(spark, tmp_path):
    line = ",01,003,3,6,Alder County,1,2,3,4,5,6,7,8,9,10,11"
    text = "Survey,x\n" + "\n".join(f"{date}{line}" for date in ("202501", "2025-01", "202513"))
    parsed = files.parse_permits(files.read_permits(spark, write(tmp_path, "d.txt", text)))
    assert [r["survey_date"] for r in rows(files.accepted(parsed))] == ["202501"]
    assert [r["reject_reason"] for r in rows(files.rejected(parsed))] == ["bad survey_date"] * 2
    fields = files.read_permits(spark, str(tmp_path / "d.txt"))
    assert files.rejected(files.parse_construction(fields, 2025, 1)).count() == 2


WAGES = """area_fips,own_code,industry_code,agglvl_code,size_code,year,qtr,qtrly_estabs,month1_emplvl,month2_emplvl,month3_emplvl,total_qtrly_wages
"20091","0","10","70","0",2024,1,2100,30500,30700,30900,512000000
"31055","0","10","70","0",2024,1,310,4000,4010,4020,61000000
"08014","0","10","70","0",2024,1,880,12100,12300,,155000000
"08014","0","10","70","0",2024,2,880,1,1,1,1
"08014","5","10","70","0",2024,1,880,1,1,1,1
"08014","0","1011","70","0",2024,1,880,1,1,1,1
"08014","0","10","40","0",2024,1,880,1,1,1,1
"US000","0","10","70","0",2024,1,880,1,1,1,1
"99001","0","10","70","0",2024,1,880,1,1,1,1
"08001","0","10","70","0",2024,1,880,lots,1,1,1
"""


def test_quarterly_wages(spark, tmp_path):
    raw = files.read_wages(spark, write(tmp_path, "w.csv", WAGES))
    parsed = files.parse_employment(raw, 1)
    good = rows(files.accepted(parsed), "fips")
    assert [r["fips"] for r in good] == ["08014", "20091", "31055"]
    assert good[1]["total_employment"] == 30700
    assert good[1]["establishments"] == 2100
    assert good[1]["total_wages"] == 512_000_000
    assert good[2]["total_wages"] == 61_000_000
    assert good[0]["total_employment"] == round((12100 + 12300 + 0) / 3)
    assert [r["reject_reason"] for r in rows(files.rejected(parsed))] == ["bad total_employment"]
    assert files.accepted(files.parse_employment(raw)).count() == 4


def test_flows_header_and_values_are_stripped(spark, tmp_path):
    text = " Y1_STATEFIPS,y1_countyfips,y2_statefips,y2_countyfips,n1, N2 \n12, 086 ,48,453,100,250\n"
    flows = files.read_flows(spark, write(tmp_path, "f.csv", text))
    assert flows.columns[0] == "y1_statefips" and flows.columns[-1] == "n2"
    (row,) = rows(flows)
    assert row["y1_countyfips"] == "086" and row["n2"] == "250"


def test_boundaries(spark, tmp_path):
    feature = {"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2]}}
    collection = {
        "type": "FeatureCollection",
        "features": [
            {**feature, "properties": {"GEO_ID": "0500000US01001", "STATE": "01", "NAME": "A"}},
            {**feature, "properties": {"GEOID": "01003", "GEO_ID": "0500000US99999"}},
        ],
    }
    path = write(tmp_path, "b.json", json.dumps(collection, indent=1))
    found = rows(files.boundary_keys(files.read_boundaries(spark, path)), "GEOID")
    assert [r["GEOID"] for r in found] == ["01001", "01003"]
    assert json.loads(found[0]["geometry"])["coordinates"] == [1, 2]


# --- one large array, many tasks -----------------------------------------------------

PROJECTION_HEADER = ["POP", "YEAR", "SEX", "state"]
ODD = ["]2", "[[", 'a"]b', "\\\\", '\\"', "{}", "],[", "é]漢", "a\\", "]", '"']


@pytest.fixture
def small_ranges(spark):
    """Files split every few hundred bytes."""
    sizes = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}
    before = {key: spark.conf.get(key) for key in sizes}
    for key, value in sizes.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def projections(n):
    return [[str(i), "2030", "0", ODD[i % len(ODD)] if i % 3 else "06"] for i in range(n)]


@pytest.mark.parametrize("style", ["one line", "line each", "indented", "spaced"])
def test_arrays_of_any_formatting_split(spark, tmp_path, small_ranges, style):
    for name, n in (("a", 150), ("b", 40), ("c", 0), ("d", 1)):
        rows_ = [PROJECTION_HEADER, *projections(n)]
        if style == "line each":
            text = "[" + ",\n".join(json.dumps(r) for r in rows_) + "]"
        elif style == "spaced":
            text = " \n" + json.dumps(rows_, separators=(" ,\r\n\t", " : ")) + "\n \n"
        else:
            text = json.dumps(rows_, indent=2 if style == "indented" else None, ensure_ascii=False)
        write(tmp_path, f"{name}.json", text)
    whole = files.state_projection_rows(files.read_census(spark, str(tmp_path)))
    split = files.state_projection_rows(files.read_census(spark, str(tmp_path), layout="records"))
    assert rows(split, "POP", "state") == rows(whole, "POP", "state")
    assert split.count() == 191
    pieces = records._pieces(spark, str(tmp_path / "a.json"), "]")
    assert pieces.rdd.getNumPartitions() > 3  # a file is read by many tasks
    assert pieces.select("block").distinct().count() > 3


@pytest.mark.parametrize("ending", ['"9', '"9","2030"', '"9","2030","0","06"', '"9","2030","0","06"]', '"9","2030","0","06"],'])
def test_array_that_breaks_off(spark, tmp_path, small_ranges, ending):
    text = json.dumps([PROJECTION_HEADER, *projections(60)])[:-1] + ", [" + ending
    path = write(tmp_path, "a.json", text)
    parsed = files.parse_state_projections(
        files.state_projection_rows(files.read_census(spark, path, layout="records"))
    )
    whole_record = ending.endswith(("]", "],"))
    assert files.accepted(parsed).count() == 60 + whole_record
    assert [r["reject_reason"] for r in rows(files.rejected(parsed))] == ["bad payload"]


@pytest.mark.parametrize("text", ["hello", "[]", "{}", '{"error": "none"}', '[["x"],["1"]]', " \n"])
def test_payloads_without_records(spark, tmp_path, text):
    path = write(tmp_path, "a.json", text)
    counts = []
    for layout in ("whole", "records"):
        parsed = files.parse_state_projections(
            files.state_projection_rows(files.read_census(spark, path, layout))
        )
        counts.append((files.accepted(parsed).count(), files.rejected(parsed).count()))
    assert counts[0] == counts[1] == (0, 1)


def test_records_without_a_comma_are_rejects(spark, tmp_path):
    path = write(tmp_path, "a.json", '[["POP","YEAR","SEX","state"] ["1","2030","0","06"], ["2","2030","0","06"]]')
    parsed = files.parse_state_projections(
        files.state_projection_rows(files.read_census(spark, path, "records"))
    )
    assert [r["projected_population"] for r in rows(files.accepted(parsed))] == [2]
    assert files.rejected(parsed).count() == 1


def features(n):
    for i in range(n):
        rings = [[[i, 0.5], [i, 1]], [[i + 1, 1], [i, 0.5]]]
        properties = {"GEOID": f"{i:05d}", "STATE": f"{i % 50:02d}", "NAME": ODD[i % len(ODD)], "x": {"y": [{}]}}
        if i % 4 == 0:
            properties["GEO_ID"] = "0500000US" + properties.pop("GEOID")
        parts = {"type": "Feature", "properties": properties, "geometry": {"type": "Polygon", "coordinates": rings}}
        if i % 5 == 0:
            parts["geometry"] = {"type": "GeometryCollection", "geometries": [{"type": "Point"}, {"type": "Point"}]}
        if i % 7 == 0:
            parts = dict(reversed(parts.items()))
        yield parts


@pytest.mark.parametrize("indent", [None, 1])
def test_boundaries_split(spark, tmp_path, small_ranges, indent):
    every = list(features(60))
    crs = {"type": "name", "properties": {"name": "urn"}}
    collection = {"type": "FeatureCollection", "crs": crs, "features": every, "bbox": [1, 2, 3, 4], "more": {"a": {}}}
    path = write(tmp_path, "a.json", json.dumps(collection, indent=indent) + "\n")
    found = rows(files.boundary_keys(files.read_boundaries(spark, path)), "GEOID")
    assert [r["GEOID"] for r in found] == [f"{i:05d}" for i in range(60)]
    assert [r["NAME"] for r in found] == [ODD[i % len(ODD)] for i in range(60)]
    assert [json.loads(r["geometry"]) for r in found] == [f["geometry"] for f in every]
    assert files.rejected(files.parse_boundaries(files.read_features(spark, path))).count() == 0
    assert records._pieces(spark, path, "}").rdd.getNumPartitions() > 3


def test_boundaries_that_break_off(spark, tmp_path, small_ranges):
    text = json.dumps({"type": "FeatureCollection", "features": list(features(20))})
    write(tmp_path, "a.json", text[:-40])
    write(tmp_path, "b.json", "no collection")
    write(tmp_path, "c.json", '{"type": "FeatureCollection", "features": []}')
    parsed = files.parse_boundaries(files.read_features(spark, str(tmp_path)))
    assert files.accepted(parsed).count() == 19
    assert [r["reject_reason"] for r in rows(files.rejected(parsed))] == ["bad feature"] * 3

"""Plans: what must hold at any size, read from the physical plan."""

import re

import pytest
from pyspark.sql import functions as F

from groundswell.operators import extras, indicators, ordering, panel, scoring, serving
from groundswell.plans import catalog, views
from groundswell.plans.views import Views
from groundswell.sources.files import accepted, parse_employment

SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def lines(df, word):
    return [line for line in plan(df).splitlines() if word in line]


def test_latest_row_is_limited_before_the_shuffle(spark):
    text = plan(panel.latest_per_key(Views(spark, SMALL).readings(), ["reading"]))
    assert re.search(r"Final.*Exchange hashpartitioning\(fips.*Partial", text, re.DOTALL)


def test_top_origins_are_limited_before_the_shuffle(spark):
    text = plan(catalog.queries()["feeder_areas"](spark, SMALL))
    assert "row_number(), 3, Partial" in text


def test_row_numbers_need_no_single_partition_of_rows(spark):
    """Only the per-partition sizes (one row each) meet in one task."""
    df = spark.range(1000).select(F.col("id").cast("string").alias("fips"))
    text = plan(ordering.number_rows(df, F.col("fips").asc(), name="n"))
    probe, _, sizes = text.partition("BroadcastExchange")
    assert "SinglePartition" not in probe
    assert "SinglePartition" in sizes


def test_normalizing_moves_no_rows(spark):
    df = spark.range(10).select("id", F.col("id").cast("double").alias("v"))
    text = plan(scoring.normalize(df, {"x": "v"}))
    main = text.split("Subquer")[0]
    for word in ("Exchange", "Window", "Join"):
        assert word not in main


def test_scans_read_only_needed_columns(spark):
    (scan,) = lines(Views(spark, SMALL).enrollment_b(), "o_orderpriority#")[-1:]
    schema = scan.split("ReadSchema: ")[1]
    assert "o_totalprice" not in schema and "o_comment" not in schema
    items = [s for s in lines(Views(spark, SMALL).vacancy(), "ReadSchema") if "l_orderkey" in s]
    read = items[0].split("ReadSchema: ")[1]
    assert sorted(re.findall(r"(l_\w+):", read)) == [
        "l_orderkey",
        "l_quantity",
        "l_returnflag",
        "l_shipdate",
    ]


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "scores")
    scores = spark.createDataFrame([("01001", "AL", 1.0)], "fips string, state string, composite_score double")
    scores.write.parquet(path)
    scans = lines(serving.list_areas(spark.read.parquet(path), "AL"), "PushedFilters")
    assert any("EqualTo(state,AL)" in scan for scan in scans)


def fact_scans(df):
    return len([line for line in lines(df, "FileScan") if "lineitem.parquet" in line])


@pytest.mark.parametrize(
    ("name", "most"),
    [("indicator_table", 1), ("area_trends", 1), ("net_migration", 1), ("permit_trend", 1)],
)
def test_facts_are_read_once(spark, name, most):
    """Besides the one pass that is written out for all sources made of line items."""
    assert fact_scans(catalog.queries()[name](spark, SMALL)) <= most


def test_shared_flows_read_no_line_items(spark):
    """The pass that is written out for all sources made of line items holds the flows too."""
    v, direct = Views(spark, SMALL), Views(spark, SMALL)
    v.share_items()
    assert fact_scans(v.net_flows()) == 0
    columns = direct.net_flows().columns
    shared = rows_of(v.net_flows().select(*columns).orderBy("fips"))
    assert shared == rows_of(direct.net_flows().orderBy("fips"))


def test_tasks_on_line_items_do_not_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(views, "ITEMS_A_TASK", 200)
    v = Views(spark, SMALL)
    count = v.table("lineitem").count()
    assert v.lines().rdd.getNumPartitions() == count // 200
    sizes = v.lines().groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert sizes < 1000


def test_items_of_unknown_parts_are_permits(spark, tmp_path):
    """Without a part an item is no business, but its units are permitted all the same."""
    folder = tmp_path / "tables"
    folder.mkdir()
    for name in ("customer", "supplier", "orders", "lineitem"):
        (folder / f"{name}.parquet").symlink_to(f"{SMALL}/{name}.parquet")
    known = spark.read.parquet(f"{SMALL}/part.parquet").filter("p_partkey % 2 = 0")
    known.write.parquet(str(folder / "part.parquet"))
    v = Views(spark, str(folder))
    v.share_items()
    units = v.table("lineitem").withColumn("units", F.col("l_quantity").cast("bigint"))
    total = lambda df, c: df.agg(F.sum(c)).first()[0]
    assert total(v.permits_b(), "total_units") == total(units, "units")
    assert total(v.vacancy_b(), "total_addresses") == total(units, "units")
    businesses = units.join(known, F.col("l_partkey") == F.col("p_partkey"))
    assert total(v.business_b(), "establishments") == total(businesses, "units")


def test_wages_are_parsed_once(spark):
    """Checks of parsed fields do not parse the text again."""
    text = plan(accepted(parse_employment(Views(spark, SMALL).qcew_raw())))
    assert text.count("^[0-9]{1,5}$") == 1


def test_other_sources_are_read_once(spark):
    for name, table in (("projection_growth", "supplier"), ("state_compounding", "customer")):
        scans = lines(catalog.queries()[name](spark, SMALL), "FileScan")
        assert len([line for line in scans if f"{table}.parquet" in line]) == 1


def test_views_read_every_row(spark):
    """Totals of the views equal those of the tables."""
    v = Views(spark, SMALL)
    units = v.table("lineitem").agg(F.sum(F.col("l_quantity").cast("bigint"))).first()[0]
    total = lambda df, c: df.agg(F.sum(c)).first()[0]
    v.share_items()
    assert total(v.permits_b(), "total_units") == total(v.vacancy_b(), "total_addresses") == units
    assert total(v.business_b(), "establishments") == units
    direct = Views(spark, SMALL)
    assert total(direct.permits_b(), "total_units") == units
    assert direct.enrollment_b().count() == v.table("orders").count()
    spent = v.table("orders").agg(F.sum(F.floor("o_totalprice"))).first()[0]
    shared = rows_of(catalog.queries()["crosswalk_rollup"](spark, SMALL))
    assert abs(sum(r["spending"] for r in shared) - spent) < 1


def rows_of(df):
    return df.collect()


def test_more_customers_than_codes_keep_their_people(spark, tmp_path):
    """150,001 customers share 50,000 codes; an area's people are summed."""
    people = spark.range(150_001).selectExpr(
        "id AS c_custkey", "concat('c', id) AS c_name", "10.0D AS c_acctbal",
        "cast(id % 25 AS int) AS c_nationkey", "'BUILDING' AS c_mktsegment",
    )
    people.write.parquet(str(tmp_path / "customer.parquet"))
    spark.read.parquet(f"{SMALL}/supplier.parquet").write.parquet(str(tmp_path / "supplier.parquet"))
    v = Views(spark, str(tmp_path))
    suppliers = v.table("supplier").filter("s_suppkey % 97 <> 0")
    theirs = suppliers.agg(F.sum(F.floor(F.abs("s_acctbal")) + 100)).first()[0]
    customers = people.filter("c_custkey % 97 <> 0").count() * 110
    areas = v.areas()
    assert areas.agg(F.sum("people")).first()[0] == customers + theirs
    assert areas.count() == areas.select("fips").distinct().count()
    assert v.acs_b().filter("report_year = 1999").count() == areas.count()


@pytest.mark.parametrize(
    "name", ["indicator_table", "net_migration", "area_trends", "map_attributes", "quality_checks"]
)
def test_no_cross_joins_and_no_python(spark, name):
    text = plan(catalog.queries()[name](spark, SMALL))
    for word in ("CartesianProduct", "NestedLoop", "PythonUDF", "ArrowEvalPython", "BatchEval"):
        assert word not in text


def test_state_outlook_moves_no_areas(spark):
    """The outlook is a constant of the projection: no join and no shuffle of the areas by state."""
    df = catalog.queries()["indicator_table"](spark, SMALL)
    main, _, subqueries = plan(df).partition("Subqueries")
    assert "state_code" not in "".join(line for line in main.splitlines() if "Exchange" in line)
    areas = spark.range(100).selectExpr("lpad(cast(id AS string), 5, '0') AS fips")
    outlook = spark.createDataFrame([("00", 2030, 0.1)], "state_code string, y int, r double")
    text = plan(indicators.with_state_projection(areas, outlook)).split("Subquer")[0]
    assert "Join" not in text and "Exchange" not in text


def test_rank_shift_writes_its_rows_once(spark, monkeypatch):
    written = []
    keep = ordering.checkpointed
    monkeypatch.setattr(ordering, "checkpointed", lambda df: written.append(df.columns) or keep(df))
    df = spark.range(50).selectExpr("cast(id AS string) AS fips", "id * 7 % 50 AS u", "id AS v", "id AS w")
    extras.rank_shift(df, {"x": 1.0}, {"y": 1.0}, {"x": "u", "y": "v"})
    assert written == [["fips", "second", "score", "_pos"]]

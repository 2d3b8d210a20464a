"""Latest row, previous row, first row, reload handling, whole-frame row numbers."""

import pytest
from conftest import rows
from pyspark.sql import Window, functions as F

from groundswell.operators import ordering, panel


def test_latest_per_key_takes_newest_period(frame):
    df = frame(
        [("a", 2024, 4, 1), ("a", 2025, 1, 2), ("b", 2023, 2, 3), ("b", 2023, 1, 4)],
        "fips string, report_year int, report_quarter int, v int",
    )
    found = rows(panel.latest_per_key(df, ["report_year", "v"]), "fips")
    assert [(r["report_year"], r["v"]) for r in found] == [(2025, 2), (2023, 3)]


def test_latest_per_key_year_only_and_ties(frame):
    df = frame([("a", 2024, 9), ("a", 2024, 3), ("a", 2020, 1)], "fips string, report_year int, v int")
    assert [r["v"] for r in rows(panel.latest_per_key(df, ["v"]))] == [3]


def test_latest_per_key_without_period_keeps_rows(frame):
    df = frame([("a", 1), ("a", 2)], "fips string, v int")
    assert panel.latest_per_key(df, ["v"]).count() == 2


def test_drop_reloads_and_last_load(frame):
    df = frame(
        [("a", 1, "D1", 5, "2025-01-01"), ("a", 1, "D1", 6, "2025-02-01"),
         ("a", 1, "D2", 7, "2025-02-01"), ("b", 1, "D1", 8, "2025-01-01")],
        "fips string, y int, district string, v int, ingested_at string",
    )
    one = rows(panel.drop_reloads(df, ["fips", "y"]), "fips")
    assert [r["v"] for r in one] == [6, 8]
    whole = rows(panel.last_load(df, ["fips", "y"]), "v")
    assert [r["v"] for r in whole] == [6, 7, 8]


def lag_reference(data):
    """Previous value per key in (year, quarter, value) order."""
    previous, out = {}, []
    for fips, year, quarter, v in sorted(data, key=lambda r: (r[0], r[1], r[2], r[3])):
        out.append((fips, year, quarter, v, previous.get(fips)))
        previous[fips] = v
    return sorted(out, key=str)


def test_previous_value_follows_the_periods(frame):
    """One row per key and period: the lag does not depend on how rows are dealt."""
    data = [("long", 2000 + i // 4, i % 4 + 1, float(i * 7 % 13)) for i in range(120)]
    data += [(f"k{i}", 2024, q, float(q)) for i in range(30) for q in (1, 2, 3)]
    df = frame(data, "fips string, report_year int, report_quarter int, v double").repartition(7)
    found = panel.previous_value(df, "v", "prev")
    assert sorted(found.columns) == ["fips", "prev", "report_quarter", "report_year", "v"]
    got = sorted(
        [(r["fips"], r["report_year"], r["report_quarter"], r["v"], r["prev"])
         for r in found.collect()],
        key=str,
    )
    assert got == lag_reference(data)


def test_reloads_without_a_stamp(frame):
    df = frame([("a", 1, 5), ("a", 1, 4), ("b", 1, 6)], "fips string, y int, v int")
    assert [r["v"] for r in rows(panel.drop_reloads(df, ["fips", "y"]), "fips")] == [4, 6]
    assert panel.drop_reloads(df.select("fips", "y"), ["fips", "y"]).count() == 2
    assert panel.last_load(df, ["fips", "y"]).count() == 3


def test_with_base_value_uses_first_period(frame):
    df = frame([("a", 2040, 4), ("a", 2030, 3), ("b", 2035, 9)], "k string, y int, v int")
    found = rows(panel.with_base_value(df, "v", "base", ["k"], "y"), "k", "y")
    assert [r["base"] for r in found] == [3, 3, 9]


@pytest.mark.parametrize("n", [1, 5, 99, 100, 150, 305, 1500, 3209])
def test_tile_equals_ntile(spark, n):
    df = spark.range(1, n + 1).select(
        F.col("id"),
        F.ntile(100).over(Window.orderBy("id")).alias("native"),
        ordering.tile(F.col("id"), F.lit(n).cast("bigint"), 100).alias("ours"),
    )
    assert df.filter("native <> ours").count() == 0


def test_number_rows_with_heavy_ties(spark):
    """A third of the rows share one value; numbers are total and follow the order."""
    df = spark.range(0, 9000, 1, 11).select(
        F.format_string("%05d", "id").alias("fips"),
        F.when(F.col("id") % 3 == 0, 50.0).otherwise((F.col("id") * 7919 % 1000) / 10).alias("s"),
    )
    found = ordering.number_rows(df, F.col("s").desc(), F.col("fips").asc(), name="rank")
    native = F.row_number().over(Window.orderBy(F.col("s").desc(), F.col("fips").asc()))
    wrong = found.withColumn("native", native).filter("rank <> native OR rank_total <> 9000")
    assert wrong.count() == 0


def test_number_rows_on_one_and_no_row(spark):
    one = ordering.number_rows(spark.range(1), F.col("id").asc(), name="n").first()
    assert (one["n"], one["n_total"]) == (1, 1)
    assert ordering.number_rows(spark.range(0), F.col("id").asc(), name="n").count() == 0


def test_latest_of_all_equals_latest_per_key(frame):
    one = frame(
        [("a", 2020, 1, 5, "x"), ("a", 2021, None, 6, "y"), ("a", 2021, 3, 9, "z"), ("a", 2021, 3, 7, None),
         ("b", None, 2, 1, "n"), ("b", 2019, 1, 2, "m"), ("c", None, None, None, None)],
        "fips string, report_year int, report_quarter int, v int, name string",
    )
    two = frame([("a", 2020, 0.5), ("d", 2020, None), ("d", 2019, 1.5)], "fips string, report_year int, w double")
    none = frame([], "fips string, report_year int, q double")
    tables = {
        "one": (one, {"year": "report_year", "report_quarter": "report_quarter", "v": "v", "name": "name"}),
        "two": (two, {"w": "w"}),
        "none": (none, {"q": "q"}),
    }
    found = {r["fips"]: r for r in rows(panel.latest_of_all(tables), "fips")}
    assert set(found) == {"a", "b", "c", "d"}
    want = rows(panel.latest_per_key(one, ["report_year", "report_quarter", "v", "name"]), "fips")
    for row in want:
        got = found[row["fips"]]
        assert (got["year"], got["report_quarter"], got["v"], got["name"]) == (
            row["report_year"], row["report_quarter"], row["v"], row["name"],
        )
        assert got["has_one"]
    for row in rows(panel.latest_per_key(two, ["w"]), "fips"):
        assert found[row["fips"]]["w"] == row["w"] and found[row["fips"]]["has_two"]
    assert not found["d"]["has_one"] and not any(r["has_none"] or r["q"] for r in found.values())

"""Area codes, safe numbers and display values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from groundswell.config import DEFAULT_WEIGHTS, SCORE_TIERS, table_name
from groundswell.functions import display, keys, values


def evaluate(frame, kind, inputs, expression):
    df = frame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    found = df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()
    return [row["y"] for row in found]


def test_area_code_pads_and_rejects(frame):
    raw = ["1001", "6037", "36061", " 1001\t", "abc", "", "123456", "12 86", None, "1001\n"]
    expected = ["01001", "06037", "36061", "01001", None, None, None, None, None, "01001"]
    assert evaluate(frame, "string", raw, keys.area_code) == expected


def test_valid_area_needs_a_known_state(frame):
    raw = ["01001", "36061", "00000", "03001", "abc", "", "1001", None]
    expected = [True, True, False, False, False, False, False, False]
    assert evaluate(frame, "string", raw, keys.is_valid_area) == expected


def test_state_of_an_area(frame):
    assert evaluate(frame, "string", ["1001", "12086", "x"], keys.state_code) == ["01", "12", None]
    assert evaluate(frame, "string", ["12086", "06037", "99001", None], keys.state_abbr) == [
        "FL",
        "CA",
        "??",
        "??",
    ]
    assert len(keys.STATE_ABBR) == 51


def test_period_date(frame):
    df = frame([(2024, 1), (2023, 4)], "y int, q int")
    found = df.select(keys.period_date(F.col("y"), F.col("q")).alias("d")).collect()
    assert [r["d"] for r in found] == [dt.date(2024, 3, 1), dt.date(2023, 12, 1)]


def test_numbers_from_text(frame):
    raw = ["12", " 7 ", "", "  ", "x", "1.5", "-", None]
    assert evaluate(frame, "string", raw, values.to_long) == [12, 7] + [None] * 6
    assert evaluate(frame, "string", raw, values.blank_as_zero) == [
        12, 7, 0, 0, None, None, None, 0,
    ]
    assert evaluate(frame, "string", raw, values.is_null_token) == [
        False, False, True, False, False, False, True, True,
    ]


def test_zfill_never_cuts(frame):
    assert evaluate(frame, "string", ["1", "12", "1234", ""], lambda c: values.zfill(c, 3)) == [
        "001",
        "012",
        "1234",
        "000",
    ]


def test_ratio_is_null_for_zero(frame):
    df = frame([(1, 2), (1, 0), (None, 2), (1, None)], "a bigint, b bigint")
    found = df.select(values.ratio(F.col("a"), F.col("b")).alias("r")).collect()
    assert [row["r"] for row in found] == [0.5, None, None, None]


def test_finite(frame):
    raw = [1.0, float("nan"), float("inf"), float("-inf"), None]
    assert evaluate(frame, "double", raw, values.is_finite) == [True] + [False] * 4


def test_display(frame):
    assert evaluate(frame, "double", [0.0, 0.125, 0.5, 1.0, None], display.component_value) == [
        0, 13, 50, 100, 0,
    ]
    assert evaluate(frame, "string", ["A", "F", None, "Z"], display.tier_label) == [
        "Top 10%",
        "Bottom 15%",
        "Bottom 15%",
        None,
    ]
    assert evaluate(frame, "string", ["12", "99", None], display.state_label) == ["FL", "", ""]


def test_configuration():
    assert sum(DEFAULT_WEIGHTS.values()) == pytest.approx(1.0)
    assert min(low for low, _ in SCORE_TIERS.values()) == 0
    assert max(high for _, high in SCORE_TIERS.values()) == 100
    assert table_name("gold", "t") == "gold.t"
    assert table_name("gold", "t", "c") == "c.gold.t"

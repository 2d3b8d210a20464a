"""Normalizing, scoring, tiers, ranks and weights."""

import pytest
from conftest import column, rows
from pyspark.sql import functions as F

from groundswell.config import DEFAULT_WEIGHTS, INDICATOR_COLUMNS, SEVEN_WEIGHTS
from groundswell.operators import scoring

ONE = {"x": "v"}
TABLE = "fips string, " + ", ".join(f"{c} double" for c in INDICATOR_COLUMNS.values())


def areas(frame, *data):
    return frame([(f"{i:05d}", *values) for i, values in enumerate(data)], TABLE)


def norms(df, **options):
    return column(scoring.normalize(df, ONE, **options), "norm_x", "i")


@pytest.mark.parametrize(
    ("data", "expected"),
    [([10, 20, 30, 40, 50], [0, 0.25, 0.5, 0.75, 1]), ([42], [0]), ([5, 5, 5], [0, 0, 0])],
)
def test_library_normalize(frame, data, expected):
    df = frame(list(enumerate(map(float, data))), "i int, v double")
    assert norms(df, constant=0.0) == expected


def test_job_normalize(frame):
    df = frame([(0, 1.0), (1, None), (2, 3.0)], "i int, v double")
    assert norms(df) == [0.0, None, 1.0]
    assert norms(df, inverted={"x"}) == [1.0, None, 0.0]
    assert norms(df.filter("i = 0")) == [0.5]
    assert norms(df.filter("i = 1")) == [None]


def test_absent_column_is_null(frame):
    df = frame([(0,)], "i int")
    assert norms(df) == [None]


def test_plain_score_of_seven_indicators(frame):
    given = [0.8, 0.6, 0.7, 0.5, 0.9, 0.4, 0.3]
    names = list(SEVEN_WEIGHTS)
    df = frame([tuple(given)], ", ".join(f"norm_{n} double" for n in names))
    expected = sum(x * w for x, w in zip(given, SEVEN_WEIGHTS.values())) * 100
    score = df.select(scoring.plain_score(SEVEN_WEIGHTS).alias("s")).first()["s"]
    assert score == pytest.approx(expected)


def test_plain_score_counts_missing_as_zero(frame):
    df = frame([(1.0, None)], "norm_a double, norm_b double")
    assert df.select(scoring.plain_score({"a": 0.5, "b": 0.5}).alias("s")).first()["s"] == 50.0
    assert df.select(scoring.adaptive_score({"a": 0.5, "b": 0.5}).alias("s")).first()["s"] == 100.0


def test_adaptive_score_by_hand(frame):
    df = areas(frame, (0.0, 0.0, 0.0, 0.0, 0.0, 0.0), (10.0, 1.0, 1.0, 1.0, 1.0, 1.0),
               (5.0, None, 0.5, None, None, 0.0), (None,) * 6)
    found = column(scoring.composite(df), "composite_score", "fips")
    third = (0.5 * 0.25 + 0.5 * 0.15 + 0.0 * 0.15) / (0.25 + 0.15 + 0.15) * 100
    assert found == [0.0, pytest.approx(100.0), pytest.approx(third), 0.0]


@pytest.mark.parametrize(
    ("score", "tier"),
    [(95, "A"), (80, "A"), (79.5, "B"), (79, "B"), (60, "B"), (59, "C"), (40, "C"), (39, "D"),
     (20, "D"), (19, "F"), (0, "F"), (100, "A"), (101, "F"), (-1, "F"), (None, "F")],
)
def test_threshold_tier(frame, score, tier):
    df = frame([(None if score is None else float(score),)], "s double")
    assert df.select(scoring.threshold_tier(F.col("s")).alias("t")).first()["t"] == tier


def test_percentile_tiers_of_a_hundred_areas(frame):
    df = areas(frame, *[(float(i),) * 6 for i in range(100)])
    found = rows(scoring.score_areas(df), "rank_national")
    assert [r["rank_national"] for r in found] == list(range(1, 101))
    assert found[0]["fips"] == "00099"
    assert "".join(r["score_tier"] for r in found) == "A" * 10 + "B" * 20 + "C" * 30 + "D" * 25 + (
        "F" * 15
    )


def test_few_areas_all_get_the_best_tier(frame):
    df = areas(frame, *[(float(i),) * 6 for i in range(7)])
    assert set(column(scoring.score_areas(df), "score_tier")) == {"A"}


def test_ties_are_ranked_by_key(frame):
    df = areas(frame, *[(1.0,) * 6 for _ in range(40)])
    found = rows(scoring.score_areas(df), "fips")
    assert [r["rank_national"] for r in found] == list(range(1, 41))
    assert all(r["composite_score"] == pytest.approx(50.0) for r in found)


def test_components_keep_nulls(frame):
    df = areas(frame, (1.0, None, 1.0, 1.0, 1.0, 1.0), (2.0, None, 2.0, 2.0, 2.0, 2.0))
    found = rows(scoring.score_areas(df), "fips")[1]["component_scores"]
    assert found["net_migration"] is None and found["building_permits"] == 1.0
    assert list(found) == list(DEFAULT_WEIGHTS)


def test_weights(frame):
    assert scoring.checked_weights({}) == DEFAULT_WEIGHTS
    assert scoring.checked_weights({"net_migration": 1})["building_permits"] == 0.0
    with pytest.raises(ValueError, match="qsr"):
        scoring.checked_weights({"qsr": 1.0})
    df = areas(frame, (1.0, 5.0, 0.0, 0.0, 0.0, 0.0), (2.0, 0.0, 0.0, 0.0, 0.0, 0.0))
    found = column(scoring.composite(df, {"net_migration": 1.0}), "composite_score", "fips")
    assert found == [100.0, 0.0]


def test_weight_updates(spark, frame):
    updates = frame(
        [("building_permits", 0.1, 0), ("unknown", 0.9, 1), ("building_permits", 0.4, 2)],
        "indicator string, weight double, seq int",
    )
    config = scoring.apply_weight_updates(scoring.weight_table(spark), updates)
    saved = scoring.read_weights(config)
    assert saved == {**DEFAULT_WEIGHTS, "building_permits": 0.4}
    assert not scoring.weights_valid(config).first()["weights_valid"]
    assert scoring.weights_valid(scoring.weight_table(spark)).first()["weights_valid"]


def test_seven_indicator_score(frame):
    from groundswell.config import SEVEN_COLUMNS

    schema = ", ".join(f"{c} double" for c in SEVEN_COLUMNS.values())
    df = frame([(1.0, 1.0, 0.0, 1.0, 1.0, 1.0, 0.0), (0.0, 0.0, 1.0, 0.0, 0.0, 0.0, None)], schema)
    found = sorted(r["composite_score"] for r in scoring.seven_indicator_score(df).collect())
    assert found == [0.0, pytest.approx(95.0)]  # the one-valued count weighs nothing

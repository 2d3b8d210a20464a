"""Operators of the design documents: crosswalks, coverage, checks, trends, outlooks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from groundswell.config import INDICATOR_COLUMNS, MIN_SOURCES_FOR_SCORE
from groundswell.functions.values import lookup, ratio
from groundswell.operators.ordering import number_rows
from groundswell.operators.scoring import TIES, adaptive_score, checked_weights, normalize
from groundswell.operators.transforms import flow_rows

# Road class -> traffic score; categories of quick-service places.
TRAFFIC_CLASS = {"motorway": 5, "trunk": 4, "primary": 3, "secondary": 2, "residential": 1}
QSR_CATEGORIES = ("restaurant", "fast_food")


def crosswalk_rollup(
    values: DataFrame, crosswalk: DataFrame, value: str, source_key: str = "zip"
) -> DataFrame:
    """Values of finer areas shared out to areas by the crosswalk's ratios.

    Summed per finer area first, so the join sees each of them once.
    """
    summed = values.groupBy(source_key).agg(F.sum(value).alias("_value"))
    shares = crosswalk.join(summed, source_key)
    return shares.groupBy("fips").agg(F.sum(F.col("_value") * F.col("ratio")).alias(value))


# Per source, the column of the indicator table whose presence shows the source has the area.
COVERAGE_COLUMNS = {
    "building_permits": "total_units_permitted",
    "acs_demographics": "population",
    "migration": "net_migration",
    "vacancy": "vacancy_rate",
    "employment": "total_employment",
    "school_enrollment": "total_enrollment",
    "business_patterns": "retail_density",
    "ssp_projections": "ssp_projection_year",
}


def data_coverage(
    indicators: DataFrame,
    columns: Mapping[str, str] = COVERAGE_COLUMNS,
    minimum: int = MIN_SOURCES_FOR_SCORE,
) -> DataFrame:
    """Per area: sources present, the missing ones, and whether they are enough."""
    count = F.lit(0)
    for column in columns.values():
        count = count + F.col(column).isNotNull().cast("int")
    missing = [F.when(F.col(c).isNull(), F.lit(name)) for name, c in columns.items()]
    return indicators.select(
        "fips",
        count.alias("sources_present"),
        F.concat_ws(",", *missing).alias("missing_sources"),
        F.when(count >= minimum, F.lit("Scored"))
        .otherwise(F.lit("Insufficient Data"))
        .alias("data_coverage"),
    )


def quality_checks(scores: DataFrame, expected: DataFrame) -> DataFrame:
    """One row of violation counts: null keys, scores out of range, absent areas."""
    absent = expected.select("fips").distinct().join(scores.select("fips"), "fips", "left_anti")
    score = F.col("composite_score")
    return scores.agg(
        F.count(F.lit(1)).alias("rows_checked"),
        F.count_if(F.col("fips").isNull()).alias("null_keys"),
        F.count_if(score.isNull() | ~score.between(0, 100)).alias("scores_out_of_range"),
    ).withColumn("missing_areas", absent.agg(F.count(F.lit(1))).scalar())


def permit_trend(quarterly: DataFrame, fips: str | None = None) -> DataFrame:
    """Quarterly units per area with unit-type shares and change on the year before.

    Each row counts for its own quarter and, as the year before, for the same quarter a
    year later; one aggregate sums both.
    """
    chosen = quarterly if fips is None else quarterly.filter(F.col("fips") == fips)
    grain = ["fips", "report_year", "report_quarter"]
    placed = chosen.withColumn("later", F.explode(F.array(F.lit(0), F.lit(1))))
    now = F.col("later") == 0

    def total_of(name: str) -> Column:
        return F.sum(F.when(now, F.col(name))).alias(name)

    series = (
        placed.withColumn("report_year", F.col("report_year") + F.col("later"))
        .groupBy(*grain)
        .agg(
            total_of("total_units_permitted"),
            total_of("single_family_units"),
            total_of("multi_family_units"),
            F.sum(F.when(~now, F.col("total_units_permitted"))).alias("units_year_ago"),
            F.bool_or(now).alias("in_series"),
        )
    )
    total, ago = F.col("total_units_permitted"), F.col("units_year_ago")
    return series.filter("in_series").select(
        *grain,
        "total_units_permitted",
        ratio(F.col("single_family_units"), total).alias("single_family_share"),
        ratio(F.col("multi_family_units"), total).alias("multi_family_share"),
        ratio(total - ago, ago).alias("yoy_change"),
    )


def rank_shift(
    indicators: DataFrame,
    before: Mapping[str, float] | None,
    after: Mapping[str, float] | None,
    columns: Mapping[str, str] = INDICATOR_COLUMNS,
) -> DataFrame:
    """Rank of each area under two weight sets and how far it moves up.

    Both scores come from one normalization. Each area has a row per score in one range
    sort, the first scores before the second ones; a second score's place, less the number of
    areas, is its rank.
    """
    scored = normalize(indicators, columns)
    scores = [
        F.struct(
            F.lit(second).alias("second"),
            F.round(adaptive_score(checked_weights(weights, columns)), TIES).alias("score"),
        )
        for second, weights in ((False, before), (True, after))
    ]
    placed = number_rows(
        scored.select("fips", F.inline(F.array(*scores))),
        F.col("second").asc(),
        F.col("score").desc(),
        F.col("fips").asc(),
        name="place",
    )
    areas = F.expr("place_total div 2")

    def rank(second: bool) -> Column:
        place = F.col("place") - (areas if second else F.lit(0))
        return F.max(F.when(F.col("second") == second, place))

    ranks = placed.groupBy("fips").agg(rank(False).alias("rank_before"), rank(True).alias("rank_after"))
    return ranks.withColumn("rank_shift", F.col("rank_before") - F.col("rank_after"))


def state_growth(demographics: DataFrame, base_year: int) -> DataFrame:
    """(state_fips, base_population, annual_rate): a state's areas in the base year, and
    the growth from the year before. Both years are summed in one aggregate.
    """

    def total(year: int) -> Column:
        return F.sum(F.when(F.col("report_year") == year, F.col("population")))

    before = total(base_year - 1)
    return demographics.groupBy(F.substring("fips", 1, 2).alias("state_fips")).agg(
        total(base_year).alias("base_population"),
        ratio(total(base_year) - before, before).alias("annual_rate"),
    )


def state_compounding(states: DataFrame, base_year: int, years: Sequence[int]) -> DataFrame:
    """State population compounded at the state's annual rate.

    ``states`` is (state_fips, base_population, annual_rate), one row per state, as
    ``state_growth`` gives it; one row comes out per state and target year.
    """
    targets = F.explode(F.array(*[F.lit(year) for year in years])).alias("projection_year")
    grown = states.select("*", targets)
    factor = F.pow(F.lit(1.0) + F.col("annual_rate"), F.col("projection_year") - base_year)
    return grown.select(
        "state_fips",
        "projection_year",
        "base_population",
        (F.col("base_population") * factor).alias("projected_population"),
    )


def feeder_areas(flows: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` largest origins of each destination, ties by origin.

    Flows are summed per pair before the shuffle, and the ranking keeps ``k`` rows per
    destination and task before its own, so a popular destination stays cheap.
    """
    pairs = (
        flow_rows(flows, fips="y2", origin="y1")
        .groupBy("fips", "origin")
        .agg(F.sum("people").alias("people"))
    )
    largest = Window.partitionBy("fips").orderBy(F.col("people").desc(), F.col("origin").asc())
    return pairs.withColumn("feeder_rank", F.row_number().over(largest)).filter(
        F.col("feeder_rank") <= k
    )


def scenario_range(projections: DataFrame) -> DataFrame:
    """Lowest and highest projection across scenarios per area and year."""
    return projections.groupBy("fips", "projection_year").agg(
        F.min("projected_population").alias("min_population"),
        F.max("projected_population").alias("max_population"),
        F.count("scenario").alias("scenarios"),
    )


def traffic_class(road_class: Column) -> Column:
    """Traffic score of a road class, null for other classes."""
    return lookup(TRAFFIC_CLASS, road_class)


def places_in(places: DataFrame, categories: Sequence[str] = QSR_CATEGORIES) -> DataFrame:
    """Places of the given categories."""
    return places.filter(F.col("category").isin(*categories))

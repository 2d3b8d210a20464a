"""Normalize indicators, score, tier and rank areas."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from groundswell.config import (
    DEFAULT_WEIGHTS,
    INDICATOR_COLUMNS,
    PERCENTILE_TIERS,
    SCORE_TIERS,
    SEVEN_COLUMNS,
    SEVEN_INVERTED,
    SEVEN_WEIGHTS,
)
from groundswell.operators.ordering import number_rows, tile

TIES = 6  # decimals of a score that count for its rank


def norm(indicator: str) -> str:
    return f"norm_{indicator}"


def weight_table(spark: SparkSession, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Weights as a two-column frame."""
    rows = [(name, float(weight)) for name, weight in (weights or DEFAULT_WEIGHTS).items()]
    return spark.createDataFrame(rows, "indicator string, weight double")


def weights_valid(config: DataFrame) -> DataFrame:
    """One row: the weight total and whether it is 1 within 0.01."""
    total = F.sum("weight")
    return config.agg(
        total.alias("weight_total"), (F.abs(total - 1) < 0.01).alias("weights_valid")
    )


def checked_weights(
    weights: Mapping[str, float] | None, columns: Mapping[str, str] = INDICATOR_COLUMNS
) -> dict[str, float]:
    """Weight per indicator, in indicator order.

    None or an empty mapping means the defaults; a missing indicator weighs 0; an
    unknown one is an error.
    """
    given = dict(weights or DEFAULT_WEIGHTS)
    unknown = sorted(set(given) - set(columns))
    if unknown:
        raise ValueError(f"unknown indicators: {', '.join(unknown)}")
    return {name: float(given.get(name, 0.0)) for name in columns}


def indicator_bounds(
    areas: DataFrame, columns: Mapping[str, str] = INDICATOR_COLUMNS
) -> DataFrame:
    """One row: minimum and maximum of every indicator, in a single aggregate."""
    return areas.agg(
        *[
            bound(F.col(source)).cast("double").alias(f"{side}_{name}")
            for name, source in columns.items()
            for side, bound in (("min", F.min), ("max", F.max))
        ]
    )


def normalize(
    areas: DataFrame,
    columns: Mapping[str, str] = INDICATOR_COLUMNS,
    inverted: Collection[str] = (),
    constant: float = 0.5,
) -> DataFrame:
    """Add ``norm_<indicator>`` between 0 and 1 for each indicator.

    Null stays null, an absent source column is null, and a column with one distinct
    value becomes ``constant``. Inverted indicators run from 1 to 0. The bounds are a
    scalar subquery: computed once by a two-step aggregate and read as constants, so
    no row moves and nothing is joined.
    """
    present = {name: source for name, source in columns.items() if source in areas.columns}
    absent = {norm(name): F.lit(None).cast("double") for name in columns if name not in present}
    if not present:
        return areas.withColumns(absent)
    bounds = indicator_bounds(areas, present)
    limits = bounds.select(F.struct(*bounds.columns).alias("bounds"))

    def scaled(name: str, source: str) -> Column:
        value = F.col(source).cast("double")
        low, high = F.col(f"_bounds.min_{name}"), F.col(f"_bounds.max_{name}")
        share = (value - low) / (high - low)
        return (
            F.when(value.isNull(), F.lit(None).cast("double"))
            .when(high == low, F.lit(constant))
            .otherwise(F.lit(1.0) - share if name in inverted else share)
        )

    scaled_columns = {norm(name): scaled(name, source) for name, source in present.items()}
    with_bounds = areas.withColumn("_bounds", limits.scalar())
    return with_bounds.withColumns({**scaled_columns, **absent}).drop("_bounds")


def _weighted(weights: Mapping[str, float]) -> Column:
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.coalesce(F.col(norm(name)), F.lit(0.0)) * weight
    return total


def adaptive_score(weights: Mapping[str, float]) -> Column:
    """Weighted sum over the indicators an area has, rescaled to their weight, 0-100."""
    available = F.lit(0.0)
    for name, weight in weights.items():
        available = available + F.when(F.col(norm(name)).isNotNull(), weight).otherwise(0.0)
    return _weighted(weights) / F.greatest(available, F.lit(0.01)) * 100


def plain_score(weights: Mapping[str, float]) -> Column:
    """Weighted sum with missing indicators as 0 and no rescaling, 0-100."""
    return _weighted(weights) * 100


def components(names: Collection[str]) -> Column:
    """Normalized indicators packed into one struct, nulls kept."""
    return F.struct(*[F.col(norm(name)).alias(name) for name in names])


def threshold_tier(score: Column) -> Column:
    """First tier whose inclusive range holds the score; F outside 0-100."""
    letter = F.when(F.lit(False), F.lit(None).cast("string"))
    for tier, (low, high) in SCORE_TIERS.items():
        letter = letter.when(score.between(low, high), F.lit(tier))
    return letter.otherwise(F.lit("F"))


def percentile_tier(percentile: Column) -> Column:
    """Tier of a 1-100 tile."""
    letter = F.when(F.lit(False), F.lit(None).cast("string"))
    for tier, bound in PERCENTILE_TIERS.items():
        letter = letter.when(percentile <= bound, F.lit(tier))
    return letter.otherwise(F.lit("F"))


def ranked(scored: DataFrame, key: str = "fips") -> DataFrame:
    """Add ``rank_national``, ``percentile`` and the percentile ``score_tier``.

    Best score first; equal scores (to 6 decimals) go by key, so ranks are total.
    """
    best = F.round("composite_score", TIES).desc()
    numbered = number_rows(scored, best, F.col(key).asc(), name="rank_national")
    percentile = tile(F.col("rank_national"), F.col("rank_national_total"), 100)
    return (
        numbered.withColumn("percentile", percentile)
        .withColumn("score_tier", percentile_tier(F.col("percentile")))
        .drop("rank_national_total")
    )


def composite(
    indicators: DataFrame,
    weights: Mapping[str, float] | None = None,
    columns: Mapping[str, str] = INDICATOR_COLUMNS,
    inverted: Collection[str] = (),
) -> DataFrame:
    """Normalized indicators and the adaptive ``composite_score``, unranked."""
    chosen = checked_weights(weights, columns)
    normalized = normalize(indicators, columns, inverted)
    return normalized.withColumn("composite_score", adaptive_score(chosen))


def score_areas(
    indicators: DataFrame,
    weights: Mapping[str, float] | None = None,
    columns: Mapping[str, str] = INDICATOR_COLUMNS,
    inverted: Collection[str] = (),
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Score, tier and rank every area; adds the ``component_scores`` struct.

    ``indicators`` is read several times (bounds, sort sample, sort): pass a written
    table or a checkpointed frame, not a long unevaluated plan. ``keep`` names the
    input columns the result needs (all by default); the others are dropped before
    the sort, which makes its shuffle narrower.
    """
    scored = composite(indicators, weights, columns, inverted).select(
        *(indicators.columns if keep is None else keep),
        "composite_score",
        components(columns).alias("component_scores"),
    )
    return ranked(scored).drop("percentile")


def seven_indicator_score(indicators: DataFrame) -> DataFrame:
    """The older seven-indicator variant: missing as 0, threshold tiers.

    Vacancy change and quick-service count are inverted (less is better).
    """
    normalized = normalize(indicators, SEVEN_COLUMNS, SEVEN_INVERTED, constant=0.0)
    scored = normalized.withColumn("composite_score", plain_score(SEVEN_WEIGHTS))
    return scored.withColumn("score_tier", threshold_tier(F.col("composite_score")))


def apply_weight_updates(config: DataFrame, updates: DataFrame) -> DataFrame:
    """New weights for known indicators; updates of unknown ones are ignored.

    With several updates of one indicator the last one given wins (``seq``).
    """
    last = updates.groupBy("indicator").agg(F.max_by("weight", "seq").alias("new_weight"))
    return config.join(last, "indicator", "left").select(
        "indicator", F.coalesce("new_weight", "weight").alias("weight")
    )


def read_weights(config: DataFrame) -> dict[str, float]:
    """The weight table as a mapping; it has one row per indicator."""
    return {row["indicator"]: row["weight"] for row in config.collect()}

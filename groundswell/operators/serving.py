"""Queries on scored areas: lists, detail, map attributes, filters, sorting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from groundswell.functions.display import component_value, state_label, tier_label
from groundswell.functions.keys import STATE_ABBR, abbreviation
from groundswell.functions.values import is_finite, ratio
from groundswell.operators.ordering import number_rows
from groundswell.operators.panel import latest_per_key
from groundswell.operators.scoring import TIES
from groundswell.schemas import COMPONENTS, GOLD_SCHEMAS

SCORE_COLUMNS = GOLD_SCHEMAS["gold_county_growth_score"].fieldNames()
# Those a score row takes over from the indicator table.
AREA_COLUMNS = [c for c in SCORE_COLUMNS if c in GOLD_SCHEMAS["gold_county_details"].fieldNames()]

# Metrics with a range filter.
METRICS = (
    "population",
    "median_income",
    "permits_per_1k_pop",
    "net_migration_rate",
    "occupancy_rate",
    "employment_per_capita",
    "ssp_growth_rate",
)
ALL_TIERS = ("A", "B", "C", "D", "F")
Range = tuple[float, float]


def score_table(scored: DataFrame) -> DataFrame:
    """The published score columns that the frame has."""
    return scored.select(*[c for c in SCORE_COLUMNS if c in scored.columns])


def export_scores(scores: DataFrame) -> DataFrame:
    """Scores with the component struct as JSON text (null components left out)."""
    return scores.withColumn("component_scores", F.to_json("component_scores"))


def parse_components(text: Column) -> Column:
    """JSON text back to the component struct, null when it is not JSON."""
    return F.when(F.get_json_object(text, "$").isNotNull(), F.from_json(text, COMPONENTS))


def component_long(scores: DataFrame, key: str = "fips") -> DataFrame:
    """One row per area and indicator with its display value."""
    names = scores.schema["component_scores"].dataType.fieldNames()
    pairs = F.array(
        *[
            F.struct(
                F.lit(name).alias("indicator"),
                F.col(f"component_scores.{name}").alias("component"),
            )
            for name in names
        ]
    )
    long = scores.select(key, "score_tier", F.inline(pairs))
    return long.select(
        key,
        "indicator",
        component_value(F.col("component")).alias("display_value"),
        F.col("component").isNotNull().alias("has_data"),
        tier_label(F.col("score_tier")).alias("tier_label"),
    )


def list_areas(scores: DataFrame, state: str | None = None) -> DataFrame:
    """Areas, best first, equal scores by code; ``state`` must match exactly."""
    chosen = scores if state is None else scores.filter(F.col("state") == state)
    return chosen.orderBy(*_best_first())


def listed_areas(scores: DataFrame, state: str | None = None) -> DataFrame:
    """``list_areas`` with each area's ``position`` in the list, from 1."""
    chosen = scores if state is None else scores.filter(F.col("state") == state)
    return number_rows(chosen, *_best_first(), name="position").drop("position_total")


def _best_first() -> list[Column]:
    return [F.round("composite_score", TIES).desc(), F.col("fips").asc()]


def top_areas(scores: DataFrame, n: int = 25, state: str | None = None) -> DataFrame:
    """The ``n`` best areas (1 to 500)."""
    if not 1 <= n <= 500:
        raise ValueError("n must be between 1 and 500")
    return list_areas(scores, state).limit(n)


def area_detail(scores: DataFrame, details: DataFrame, fips: str | None = None) -> DataFrame:
    """Score columns with the detail columns; a non-null detail value wins.

    One area when ``fips`` is given. JSON component text becomes a struct again.
    """
    if fips is not None:
        scores, details = scores.filter(F.col("fips") == fips), details.filter(
            F.col("fips") == fips
        )
    shared = [c for c in scores.columns if c in details.columns and c != "fips"]
    only = [c for c in details.columns if c not in scores.columns]
    merged = scores.alias("s").join(details.alias("d"), "fips", "left").select(
        "fips",
        *[
            F.coalesce(f"d.{c}", f"s.{c}").alias(c) if c in shared else F.col(f"s.{c}")
            for c in scores.columns
            if c != "fips"
        ],
        *[F.col(f"d.{c}") for c in only],
    )
    if dict(merged.dtypes).get("component_scores") == "string":
        parsed = parse_components(F.col("component_scores"))
        merged = merged.withColumn("component_scores", parsed)
    return merged


def map_attributes(boundaries: DataFrame, scores: DataFrame, details: DataFrame) -> DataFrame:
    """Boundary attributes with the area's metrics; unscored boundaries are kept."""
    metrics = scores.select(
        "fips",
        "composite_score",
        "score_tier",
        "rank_national",
        "population",
        "median_income",
        "ssp_growth_rate",
    ).join(
        details.select(
            "fips",
            "permits_per_1k_pop",
            "net_migration_rate",
            "occupancy_rate",
            "employment_per_capita",
        ),
        "fips",
        "left",
    )
    joined = boundaries.join(metrics, boundaries["GEOID"] == metrics["fips"], "left")
    return joined


def filter_bounds(features: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """One row: range of each metric over its finite values, 0 to 0 when it has none."""
    aggregates = []
    for name in metrics:
        value = F.when(is_finite(F.col(name)), F.col(name).cast("double"))
        aggregates.append(F.coalesce(F.min(value), F.lit(0.0)).alias(f"min_{name}"))
        aggregates.append(F.coalesce(F.max(value), F.lit(0.0)).alias(f"max_{name}"))
    return features.agg(*aggregates)


@dataclass(frozen=True)
class AreaFilter:
    """Criteria of the analysis view; a metric without a range is not filtered."""

    score: Range = (0.0, 100.0)
    tiers: Sequence[str] = ALL_TIERS
    states: Sequence[str] = ()
    ranges: Mapping[str, Range] = field(default_factory=dict)


def default_filter(bounds: DataFrame, metrics: Sequence[str] = METRICS) -> AreaFilter:
    """Every score, tier and state, and each metric's own bounds (a one-row frame)."""
    row = bounds.first()
    return AreaFilter(ranges={m: (row[f"min_{m}"], row[f"max_{m}"]) for m in metrics})


def _in_range(name: str, limits: Range) -> Column:
    """Inclusive; a missing or non-finite value passes."""
    return ~is_finite(F.col(name)) | F.col(name).between(*limits)


def matches(criteria: AreaFilter) -> Column:
    """All criteria at once. Tiers apply only when some are left out."""
    passed = _in_range("composite_score", criteria.score)
    if len(criteria.tiers) < len(ALL_TIERS):
        tier = F.col("score_tier").isin(*criteria.tiers) if criteria.tiers else F.lit(False)
        passed = passed & F.coalesce(tier, F.lit(False))
    if criteria.states:
        passed = passed & F.coalesce(F.col("STATE").isin(*criteria.states), F.lit(False))
    for name, limits in criteria.ranges.items():
        passed = passed & _in_range(name, limits)
    return passed


def has_key() -> Column:
    return F.coalesce(F.col("GEOID") != "", F.lit(False))


def filter_areas(features: DataFrame, criteria: AreaFilter) -> DataFrame:
    """Features with a key that meet the criteria."""
    return features.filter(has_key() & matches(criteria))


def match_count(features: DataFrame, criteria: AreaFilter) -> DataFrame:
    """One row: how many features match, out of how many."""
    return features.agg(
        F.count_if(has_key() & matches(criteria)).alias("matching"),
        F.count(F.lit(1)).alias("total"),
    )


def highlight_areas(
    features: DataFrame, state: str = "", tier: str = "", min_score: float = 0.0
) -> DataFrame:
    """Add ``highlighted``. Here a missing tier is F and a missing score 0."""
    shown = F.coalesce("composite_score", F.lit(0.0)) >= min_score
    if state:
        shown = shown & F.coalesce(F.col("STATE") == state, F.lit(False))
    if tier:
        shown = shown & (F.coalesce("score_tier", F.lit("F")) == tier)
    return features.withColumn("highlighted", shown)


#: Order of names as people read them: accents and case count after the letters.
READING_ORDER = "UNICODE"


def sort_key(name: str) -> Column:
    """Sort value with the view's default for a missing one (rank has none).

    Texts sort by the Unicode collation, as a browser sorts them, not by bytes.
    """

    def text(value: Column) -> Column:
        return F.collate(value, READING_ORDER)

    keys = {
        "rank": F.col("rank_national"),
        "name": text(F.coalesce("NAME", F.lit(""))),
        "state": text(state_label(F.col("STATE"))),
        "score": F.coalesce("composite_score", F.lit(0.0)),
        "tier": text(F.coalesce("score_tier", F.lit("Z"))),
        "population": F.coalesce(F.col("population"), F.lit(0)),
        "income": F.coalesce("median_income", F.lit(0.0)),
    }
    return keys[name]


def sorted_results(features: DataFrame, by: str = "score", descending: bool = True) -> DataFrame:
    """Features with their ``position`` in display order, from 1; ties by key.

    Pass the features that match (``filter_areas``), as the results list shows them.
    """
    key = sort_key(by)
    order = key.desc() if descending else key.asc()
    return number_rows(features, order, F.col("GEOID").asc(), name="position").drop(
        "position_total"
    )


def state_list(features: DataFrame) -> DataFrame:
    """Distinct known states and their ``position`` by abbreviation, from 1."""
    known = (
        features.filter(F.col("STATE").isin(*STATE_ABBR))
        .select(F.col("STATE").alias("state_code"))
        .distinct()
        .withColumn("state", abbreviation(F.col("state_code")))
    )
    # At most one row per entry of the fixed table of states.
    return known.withColumn("position", F.row_number().over(Window.orderBy("state")))


def area_trends(
    permits: DataFrame,
    migration: DataFrame,
    vacancy: DataFrame,
    employment: DataFrame,
    demographics: DataFrame,
    fips: str | None = None,
) -> DataFrame:
    """Quarterly series per area from four Silver tables (one area if ``fips``).

    Permits are per 1,000 of the area's latest population. A quarter appears when any
    table has it. Each table has one row per area and quarter, so the outer join of
    the four is one aggregate of their union: one shuffle for all of them.
    """
    grain = ["fips", "report_year", "report_quarter"]
    people = latest_per_key(demographics, ["report_year", "population"])
    units = permits.groupBy(*grain).agg(F.sum("total_units_permitted").alias("_units"))
    per_1k = units.join(people.select("fips", "population"), "fips", "left").select(
        *grain, (ratio(F.col("_units"), F.col("population")) * 1000).alias("permits_per_1k_pop")
    )
    tables = {
        "permits_per_1k_pop": per_1k,
        "net_migration_rate": migration,
        "vacancy_rate_yoy_change": vacancy,
        "employment_growth_rate": employment,
    }
    series = None
    for metric, table in tables.items():
        chosen = table if fips is None else table.filter(F.col("fips") == fips)
        part = chosen.select(
            *grain,
            *[
                (F.col(m) if m == metric else F.lit(None)).cast("double").alias(m)
                for m in tables
            ],
        )
        series = part if series is None else series.unionByName(part)
    return series.groupBy(*grain).agg(*[F.max(m).alias(m) for m in tables])

"""The registered queries: every operator over the driver's whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from groundswell.config import INDICATOR_COLUMNS, SEVEN_COLUMNS
from groundswell.functions.keys import area_code, is_valid_area, state_abbr, state_code
from groundswell.functions.values import rounded, zfill
from groundswell.operators import extras, indicators, scoring, serving, transforms
from groundswell.operators.panel import drop_reloads, latest_per_key
from groundswell.plans.settings import (
    CUSTOM_WEIGHTS,
    FILTER_METRICS,
    FILTER_STATES,
    FILTER_TIERS,
    HIGHLIGHT,
    WEIGHT_UPDATES,
)
from groundswell.plans.views import Views
from groundswell.schemas import BRONZE_SCHEMAS, GOLD_SCHEMAS
from groundswell.session import checkpointed
from groundswell.sources import files
from groundswell.sources.run_log import load_counts
from groundswell.sources.tables import conform, quarter_stamp, stamped

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def _query(build: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
    """Register ``build`` under its own name; doubles are rounded for comparison."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return rounded(build(Views(spark, folder)))

    _REGISTRY[build.__name__] = run
    return build


def queries() -> dict[str, Query]:
    return dict(_REGISTRY)


# --- loaders -------------------------------------------------------------------------


def _parsed(v: Views) -> dict[str, Callable[[], DataFrame]]:
    """Parsed rows, with reject reasons, of each staged source."""
    return {
        "building_permits": lambda: files.parse_permits(v.bps_raw()),
        "hud_construction": lambda: files.parse_construction(v.bps_raw(), 2001, 4),
        "acs_demographics": lambda: files.parse_demographics(v.census_raw(), 2000),
        "vacancy": lambda: files.parse_vacancy(v.census_raw(), 2001, 4),
        "school_enrollment": lambda: files.parse_enrollment(v.census_raw(), 2000),
        "business_patterns": lambda: files.parse_business(v.census_raw(), 2000),
        "national_projections": lambda: files.parse_state_projections(v.popproj_raw()),
        "employment": lambda: files.parse_employment(v.qcew_raw(), 1),
    }


def _loaded(v: Views, source: str) -> DataFrame:
    return files.accepted(_parsed(v)[source]())


@_query
def load_permits(v: Views) -> DataFrame:
    return _loaded(v, "building_permits")


@_query
def load_construction(v: Views) -> DataFrame:
    return _loaded(v, "hud_construction")


@_query
def load_demographics(v: Views) -> DataFrame:
    return _loaded(v, "acs_demographics")


@_query
def load_vacancy(v: Views) -> DataFrame:
    return _loaded(v, "vacancy")


@_query
def load_enrollment(v: Views) -> DataFrame:
    return _loaded(v, "school_enrollment")


@_query
def load_business(v: Views) -> DataFrame:
    return _loaded(v, "business_patterns")


@_query
def load_state_projections(v: Views) -> DataFrame:
    return _loaded(v, "national_projections")


@_query
def load_employment(v: Views) -> DataFrame:
    # summed by nothing: one row per order, as in a file with repeated areas
    return _loaded(v, "employment")


@_query
def load_migration(v: Views) -> DataFrame:
    """Net flows of one year from a flows file read for both sides."""
    return conform(v.net_flows(), BRONZE_SCHEMAS["migration"]).drop("source_date", "ingested_at")


@_query
def bronze_vacancy(v: Views) -> DataFrame:
    """Rows as a load appends them, with the period's date (without the time taken in)."""
    rows = stamped(_loaded(v, "vacancy"), source_date=quarter_stamp(2001, 4))
    rows = conform(rows, BRONZE_SCHEMAS["vacancy"]).drop("ingested_at")
    return rows.withColumn("source_date", F.col("source_date").cast("string"))


@_query
def traffic_classes(v: Views) -> DataFrame:
    """Traffic score of each part, whose container word stands for a road class."""
    roads = list(extras.TRAFFIC_CLASS)
    kind = F.element_at(F.array(*map(F.lit, [*roads, "track"])), F.col("p_size") % 6 + 1)
    parts = v.table("part").select("p_partkey", kind.alias("road_class"))
    score = extras.traffic_class(F.col("road_class"))
    return parts.withColumn("traffic_score", score)


@_query
def places_of_kind(v: Views) -> DataFrame:
    """Suppliers as places, by the categories of quick service."""
    kinds = F.array(*map(F.lit, [*extras.QSR_CATEGORIES, "bank", "school"]))
    category = F.element_at(kinds, (F.col("s_nationkey") % 4 + 1).cast("int"))
    places = v.table("supplier").select("s_suppkey", category.alias("category"))
    return extras.places_in(places)


@_query
def boundary_keys(v: Views) -> DataFrame:
    return files.boundary_keys(v.boundaries_raw())


@_query
def run_log_summary(v: Views) -> DataFrame:
    """Run log rows (without times) of loading every source."""
    logs = [
        parse()
        .agg(*load_counts())
        .select(F.lit(source).alias("source_name"), F.lit("success").alias("status"), "*")
        for source, parse in _parsed(v).items()
    ]
    whole = logs[0]
    for log in logs[1:]:
        whole = whole.unionByName(log)
    return whole


@_query
def optional_source(v: Views) -> DataFrame:
    """Indicator table when only demographics, permits and vacancy exist."""
    some = {
        "acs_demographics": v.demographics(),
        "building_permits": v.permits(),
        "vacancy": v.vacancy(),
    }
    return indicators.build_indicator_table(v.spark, some).select(
        "fips",
        "state",
        "population",
        "net_migration_rate",
        "permits_per_1k_pop",
        "employment_per_capita",
        "enrollment_per_capita",
        "occupancy_rate",
        "ssp_growth_rate",
        "ssp_projection_year",
    )


# --- functions -----------------------------------------------------------------------


def _raw_codes(v: Views) -> DataFrame:
    """Codes as dirty files hold them: unpadded, blank-padded, no number, too long."""
    number = (F.col("c_custkey") * 37).cast("string")
    segment = F.col("c_mktsegment")
    raw = (
        F.when(segment == "AUTOMOBILE", number)
        .when(segment == "BUILDING", F.concat(F.lit("  "), number, F.lit(" ")))
        .when(segment == "FURNITURE", F.col("c_name"))
        .when(segment == "HOUSEHOLD", F.concat(F.lit("000"), number))
        .otherwise(zfill(number, 5))
    )
    return v.table("customer").select(raw.alias("raw"))


@_query
def normalize_code(v: Views) -> DataFrame:
    raw = F.col("raw")
    return _raw_codes(v).select(
        raw, area_code(raw).alias("code"), state_code(raw).alias("state_code")
    )


@_query
def validate_code(v: Views) -> DataFrame:
    return _raw_codes(v).select("raw", is_valid_area(F.col("raw")).alias("valid"))


@_query
def state_abbreviation(v: Views) -> DataFrame:
    return v.areas().select("fips", state_abbr(F.col("fips")).alias("state"))


_REGISTRY["state_abbr"] = _REGISTRY.pop("state_abbreviation")


# --- Silver --------------------------------------------------------------------------


@_query
def permits_quarterly(v: Views) -> DataFrame:
    return v.permits()


@_query
def demographics(v: Views) -> DataFrame:
    return v.demographics()


@_query
def migration_rate(v: Views) -> DataFrame:
    return v.migration()


@_query
def vacancy_change(v: Views) -> DataFrame:
    return v.vacancy()


@_query
def employment_growth(v: Views) -> DataFrame:
    return v.employment()


@_query
def enrollment_growth(v: Views) -> DataFrame:
    return v.enrollment()


@_query
def business_density(v: Views) -> DataFrame:
    return v.business()


@_query
def construction_growth(v: Views) -> DataFrame:
    return v.construction()


@_query
def projection_growth(v: Views) -> DataFrame:
    return v.projections()


@_query
def state_projections(v: Views) -> DataFrame:
    return transforms.state_projections(_loaded(v, "national_projections"))


@_query
def flow_totals(v: Views) -> DataFrame:
    return transforms.flow_totals(v.flows_raw(), "y2")


@_query
def net_migration(v: Views) -> DataFrame:
    return v.net_flows()


@_query
def latest_permits(v: Views) -> DataFrame:
    return latest_per_key(v.permits(), indicators.PERMIT_COLUMNS)


_REGISTRY["latest_per_key"] = _REGISTRY.pop("latest_permits")


@_query
def latest_projection(v: Views) -> DataFrame:
    return indicators.latest_projection(v.projections())


@_query
def dedup_bronze(v: Views) -> DataFrame:
    """Several readings of an area and quarter: the last one taken in stays."""
    return drop_reloads(v.readings(), ["fips", "report_year", "report_quarter"])


# --- indicators ----------------------------------------------------------------------


def _indicators(v: Views, **options) -> DataFrame:
    v.share_items()
    return indicators.build_indicator_table(v.spark, v.sources(), **options)


def _details(table: DataFrame) -> DataFrame:
    return conform(table, GOLD_SCHEMAS["gold_county_details"])


@_query
def indicator_base(v: Views) -> DataFrame:
    return indicators.indicator_base(v.permits(), v.demographics())


@_query
def indicator_table(v: Views) -> DataFrame:
    return _indicators(v)


@_query
def gold_details(v: Views) -> DataFrame:
    return _details(_indicators(v))


@_query
def state_projection_join(v: Views) -> DataFrame:
    outlook = indicators.latest_projection(v.projections())
    return indicators.with_state_projection(v.areas().select("fips"), outlook)


@_query
def permits_per_1k(v: Views) -> DataFrame:
    base = indicators.indicator_base(v.permits(), v.demographics())
    units, people = F.col("total_units_permitted"), F.col("population")
    return base.select(
        "fips",
        indicators.permits_per_1k(units, people).alias("permits_per_1k_pop"),
        indicators.permits_per_1k(units, people, missing="null").alias("permits_or_null"),
    )


@_query
def per_capita(v: Views) -> DataFrame:
    jobs = latest_per_key(v.employment(), ["total_employment"])
    pupils = latest_per_key(v.enrollment(), ["total_enrollment"])
    joined = v.population().join(jobs, "fips", "left").join(pupils, "fips", "left")
    people = F.col("population")
    return joined.select(
        "fips",
        F.try_divide("total_employment", people).alias("employment_per_capita"),
        F.try_divide("total_enrollment", people).alias("enrollment_per_capita"),
    )


@_query
def occupancy(v: Views) -> DataFrame:
    rates = latest_per_key(v.vacancy(), ["vacancy_rate"])
    rate = F.col("vacancy_rate")
    return v.population().join(rates, "fips", "left").select(
        "fips",
        indicators.occupancy(rate).alias("occupancy_rate"),
        indicators.occupancy(rate, missing="null").alias("occupancy_or_null"),
    )


def _growth_sources(v: Views) -> DataFrame:
    """Indicator table from only the sources the growth blend reads."""
    names = ("acs_demographics", "building_permits", "migration", "ssp_projections")
    every = v.sources()
    return indicators.build_indicator_table(v.spark, {name: every[name] for name in names})


@_query
def growth_blend(v: Views) -> DataFrame:
    return _growth_sources(v).select("fips", "ssp_growth_rate")


@_query
def projected_population(v: Views) -> DataFrame:
    return _growth_sources(v).select(
        "fips", "population", "acs_year", "ssp_projection_year", "ssp_projected_pop"
    )


# --- scoring -------------------------------------------------------------------------


def _stored(v: Views, **options) -> DataFrame:
    """The indicator table, written once because scoring reads it several times."""
    return checkpointed(_indicators(v, **options))


def _norms(names=INDICATOR_COLUMNS) -> list[Column]:
    return [F.col(scoring.norm(name)) for name in names]


@_query
def indicator_bounds(v: Views) -> DataFrame:
    return scoring.indicator_bounds(_indicators(v))


@_query
def normalize_indicators(v: Views) -> DataFrame:
    return scoring.normalize(_stored(v)).select("fips", *_norms())


@_query
def normalize_zero(v: Views) -> DataFrame:
    return scoring.normalize(_stored(v), constant=0.0).select("fips", *_norms())


@_query
def composite_score(v: Views) -> DataFrame:
    return scoring.composite(_stored(v)).select("fips", "composite_score")


def _plain(v: Views) -> DataFrame:
    normalized = scoring.normalize(_stored(v), constant=0.0)
    weights = scoring.checked_weights(None)
    return normalized.withColumn("composite_score", scoring.plain_score(weights))


@_query
def plain_composite(v: Views) -> DataFrame:
    return _plain(v).select("fips", "composite_score")


@_query
def threshold_tiers(v: Views) -> DataFrame:
    tier = scoring.threshold_tier(F.col("composite_score"))
    return _plain(v).select("fips", tier.alias("score_tier"))


def _ranks(v: Views) -> DataFrame:
    return scoring.ranked(scoring.composite(_stored(v)).select("fips", "composite_score"))


@_query
def score_tiers(v: Views) -> DataFrame:
    return _ranks(v).select("fips", "percentile", "score_tier")


@_query
def national_rank(v: Views) -> DataFrame:
    return _ranks(v).select("fips", "rank_national")


def _flat(scores: DataFrame) -> DataFrame:
    """Component struct as plain columns, which compare between engines."""
    parts = [
        F.col(f"component_scores.{name}").alias(f"component_{name}") for name in INDICATOR_COLUMNS
    ]
    return scores.select("*", *parts).drop("component_scores")


def _gold(v: Views) -> tuple[DataFrame, DataFrame]:
    """Score and detail tables."""
    details = _stored(v)
    scored = scoring.score_areas(details, keep=serving.AREA_COLUMNS)
    return serving.score_table(scored), _details(details)


@_query
def gold_score(v: Views) -> DataFrame:
    return _flat(_gold(v)[0])


@_query
def export_scores(v: Views) -> DataFrame:
    """JSON components, read back; ``json_keys`` counts those the text holds."""
    exported = serving.export_scores(_gold(v)[0])
    keys = F.size(F.json_object_keys("component_scores")).alias("json_keys")
    parsed = exported.select("*", keys).withColumn(
        "component_scores", serving.parse_components(F.col("component_scores"))
    )
    return _flat(parsed)


@_query
def component_long(v: Views) -> DataFrame:
    return serving.component_long(_gold(v)[0])


@_query
def custom_weights(v: Views) -> DataFrame:
    scored = scoring.score_areas(_stored(v), CUSTOM_WEIGHTS, keep=["fips"])
    return scored.select("fips", "composite_score", "score_tier", "rank_national")


@_query
def update_weights(v: Views) -> DataFrame:
    """Scores under the saved weights after an update, and the weight check."""
    rows = [(name, weight, i) for i, (name, weight) in enumerate(WEIGHT_UPDATES.items())]
    updates = v.spark.createDataFrame(rows, "indicator string, weight double, seq int")
    config = scoring.apply_weight_updates(scoring.weight_table(v.spark), updates)
    check = scoring.weights_valid(config).first()
    scored = scoring.composite(_stored(v), scoring.read_weights(config))
    return scored.select(
        "fips",
        "composite_score",
        F.lit(check["weight_total"]).alias("weight_total"),
        F.lit(check["weights_valid"]).alias("weights_valid"),
    )


# --- serving -------------------------------------------------------------------------

_SUMMARY = [
    "fips",
    "county_name",
    "state",
    "composite_score",
    "score_tier",
    "rank_national",
    "population",
    "median_income",
]


@_query
def list_areas(v: Views) -> DataFrame:
    return serving.listed_areas(_gold(v)[0]).select("position", *_SUMMARY)


@_query
def top_areas(v: Views) -> DataFrame:
    return serving.top_areas(_gold(v)[0], 25).select(*_SUMMARY)


@_query
def area_detail(v: Views) -> DataFrame:
    scores, details = _gold(v)
    return _flat(serving.area_detail(serving.export_scores(scores), details))


def _features(v: Views) -> DataFrame:
    scores, details = _gold(v)
    return serving.map_attributes(files.boundary_keys(v.boundaries_raw()), scores, details)


@_query
def map_attributes(v: Views) -> DataFrame:
    return _features(v)


@_query
def filter_bounds(v: Views) -> DataFrame:
    return serving.filter_bounds(_features(v))


def _criteria() -> serving.AreaFilter:
    return serving.AreaFilter(tiers=FILTER_TIERS, states=FILTER_STATES, ranges=FILTER_METRICS)


@_query
def filter_areas(v: Views) -> DataFrame:
    return serving.filter_areas(_features(v), _criteria())


@_query
def filter_defaults(v: Views) -> DataFrame:
    features = _features(v)
    criteria = serving.default_filter(serving.filter_bounds(features))
    return serving.filter_areas(features, criteria).select("GEOID", "NAME")


@_query
def match_count(v: Views) -> DataFrame:
    return serving.match_count(_features(v), _criteria())


@_query
def highlight_areas(v: Views) -> DataFrame:
    shown = serving.highlight_areas(_features(v), **HIGHLIGHT)
    return shown.select("GEOID", "STATE", "score_tier", "highlighted")


@_query
def sorted_results(v: Views) -> DataFrame:
    """The matching features, as the results list shows them."""
    matching = serving.filter_areas(_features(v), _criteria())
    ordered = serving.sorted_results(matching, "population")
    return ordered.select("position", "GEOID", "NAME", "STATE", "population")


@_query
def state_list(v: Views) -> DataFrame:
    return serving.state_list(_features(v))


@_query
def area_trends(v: Views) -> DataFrame:
    v.share_items(business=False)
    return serving.area_trends(
        v.permits(), v.migration(), v.vacancy(), v.employment(), v.demographics()
    )


# --- design documents ----------------------------------------------------------------


@_query
def crosswalk_rollup(v: Views) -> DataFrame:
    spending = v.table("orders").select(
        F.col("o_custkey").cast("string").alias("zip"),
        F.floor("o_totalprice").alias("spending"),
    )
    return extras.crosswalk_rollup(spending, v.crosswalk_b(), "spending")


@_query
def data_coverage(v: Views) -> DataFrame:
    return extras.data_coverage(_indicators(v))


@_query
def quality_checks(v: Views) -> DataFrame:
    expected = files.boundary_keys(v.boundaries_raw()).select(F.col("GEOID").alias("fips"))
    return extras.quality_checks(_gold(v)[0], expected)


@_query
def permit_trend(v: Views) -> DataFrame:
    return extras.permit_trend(v.permits())


@_query
def rank_shift(v: Views) -> DataFrame:
    return extras.rank_shift(_stored(v), None, CUSTOM_WEIGHTS)


@_query
def seven_indicator_score(v: Views) -> DataFrame:
    more = {
        "vacancy": ["vacancy_rate_yoy_change"],
        "employment": ["employment_growth_rate"],
        "school_enrollment": ["enrollment_growth_rate"],
    }
    needed = _indicators(v, more_columns=more).select("fips", *SEVEN_COLUMNS.values())
    scored = scoring.seven_indicator_score(checkpointed(needed))
    return scored.select("fips", "composite_score", "score_tier")


@_query
def state_compounding(v: Views) -> DataFrame:
    """Rates come from the two survey years; projections to 2005, 2010 and 2015."""
    states = extras.state_growth(v.demographics(), 2000)
    grown = extras.state_compounding(states, 2000, [2005, 2010, 2015])
    return rounded(grown, 2)


@_query
def feeder_areas(v: Views) -> DataFrame:
    return extras.feeder_areas(v.flows_raw())


@_query
def scenario_range(v: Views) -> DataFrame:
    return extras.scenario_range(v.ssp_b())

"""The Silver and Gold jobs over catalog tables."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from groundswell.config import (
    BRONZE,
    CONFIG_TABLE,
    DETAILS_TABLE,
    GOLD,
    SCORES_TABLE,
    SILVER,
    landed,
    table_name,
)
from groundswell.operators import transforms
from groundswell.operators.indicators import AREA_COLUMNS, build_indicator_table
from groundswell.operators.panel import drop_reloads, last_load, latest_per_key
from groundswell.operators.scoring import (
    apply_weight_updates,
    read_weights,
    score_areas,
    weight_table,
)
from groundswell.operators.serving import AREA_COLUMNS as SCORE_INPUTS
from groundswell.operators.serving import export_scores, score_table
from groundswell.schemas import GOLD_SCHEMAS, SILVER_SCHEMAS
from groundswell.sources.tables import (
    conform,
    overwrite,
    read_optional,
    read_required,
    table_exists,
)

logger = logging.getLogger(__name__)

QUARTERLY = ("fips", "report_year", "report_quarter")
OPTIONAL_SOURCES = (*AREA_COLUMNS, "ssp_projections")


def _one_per(*grain: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: drop_reloads(df, grain)


def _last_load_of(*grain: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: last_load(df, grain)


# How each Bronze table sheds repeated downloads before its transform.
RELOADS: Mapping[str, Callable[[DataFrame], DataFrame]] = {
    "acs_demographics": _one_per("fips", "report_year"),
    "building_permits": _last_load_of("fips", "survey_date"),
    "migration": _one_per(*QUARTERLY),
    "vacancy": _one_per(*QUARTERLY),
    "hud_construction": _one_per(*QUARTERLY),
    "employment": _one_per(*QUARTERLY),
    "school_enrollment": _last_load_of("fips", "report_year"),
    "business_patterns": _last_load_of("fips", "report_year"),
    "ssp_projections": _one_per("fips", "scenario", "projection_year"),
    "national_projections": _one_per("state_fips", "projection_year"),
}


# Transform of each source from its clean Bronze rows and (fips, population).
# RELOADS has left one row per period wherever a transform looks at the previous row.
TRANSFORMS: Mapping[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "building_permits": lambda bronze, _: transforms.permits_quarterly(bronze),
    "migration": transforms.migration_rate,
    "vacancy": lambda bronze, _: transforms.vacancy_change(bronze),
    "hud_construction": lambda bronze, _: transforms.construction_growth(bronze),
    "employment": lambda bronze, _: transforms.employment_growth(bronze),
    "school_enrollment": lambda bronze, _: transforms.enrollment_growth(bronze),
    "business_patterns": transforms.business_density,
    "ssp_projections": lambda bronze, _: transforms.projection_growth(bronze),
    "national_projections": lambda bronze, _: transforms.state_projections(bronze),
}


def bronze_tables(spark: SparkSession, name: str, catalog: str | None = None) -> list[str]:
    """Existing tables of a source: the one of its loads and the one of its landing stream."""
    names = [table_name(BRONZE, table, catalog) for table in (name, landed(name))]
    return [table for table in names if spark.catalog.tableExists(table)]


def read_bronze(spark: SparkSession, name: str, catalog: str | None = None) -> DataFrame:
    """All rows of a source; an error when it has no table."""
    tables = bronze_tables(spark, name, catalog) or [table_name(BRONZE, name, catalog)]
    rows = read_required(spark, tables[0])
    for other in tables[1:]:
        rows = rows.unionByName(read_required(spark, other), allowMissingColumns=True)
    return rows


def run_silver(spark: SparkSession, catalog: str | None = None) -> list[str]:
    """Write every Silver table whose Bronze table exists; returns their names.

    Demographics go first. The others read population back from the written table,
    latest year per area, so rates do not fan out over survey years.
    """

    def write(name: str, df: DataFrame) -> str:
        silver = f"silver_{name}"
        target = table_name(SILVER, silver, catalog)
        overwrite(conform(df, SILVER_SCHEMAS[silver]), target)
        return silver

    def clean(name: str) -> DataFrame:
        return RELOADS[name](read_bronze(spark, name, catalog))

    written = [write("acs_demographics", transforms.demographics(clean("acs_demographics")))]
    people = read_required(spark, table_name(SILVER, "silver_acs_demographics", catalog))
    population = latest_per_key(people, ["population"])
    for name, transform in TRANSFORMS.items():
        if not bronze_tables(spark, name, catalog):
            logger.warning("no Bronze table %s; skipped", name)
            continue
        written.append(write(name, transform(clean(name), population)))
    return written


def silver_sources(spark: SparkSession, catalog: str | None = None) -> dict[str, DataFrame]:
    """Silver frames by source; optional ones are empty when their table is missing."""
    sources = {
        name: read_required(spark, table_name(SILVER, f"silver_{name}", catalog))
        for name in ("acs_demographics", "building_permits")
    }
    for name in OPTIONAL_SOURCES:
        silver = f"silver_{name}"
        table = table_name(SILVER, silver, catalog)
        sources[name] = read_optional(spark, table, SILVER_SCHEMAS[silver])
    return sources


def _config_tables(catalog: str | None) -> tuple[str, str]:
    """The weight table and the staging table of a change in progress."""
    name = table_name(GOLD, CONFIG_TABLE, catalog)
    return name, f"{name}_next"


def current_weights(spark: SparkSession, catalog: str | None = None) -> dict[str, float] | None:
    """Saved weights, or None when none are saved.

    The staging table counts when a change was cut off while it replaced the table.
    """
    for name in _config_tables(catalog):
        if table_exists(spark, name):
            return read_weights(read_required(spark, name))
    return None


def save_weights(
    spark: SparkSession, updates: Mapping[str, float], catalog: str | None = None
) -> None:
    """Replace the weights of known indicators; run Gold again to apply them.

    The change is written whole to the staging table first, so a job that dies on the
    way leaves either the old weights or the new ones.
    """
    name, staging = _config_tables(catalog)
    rows = [(key, float(value), i) for i, (key, value) in enumerate(updates.items())]
    changed = apply_weight_updates(
        weight_table(spark, current_weights(spark, catalog)),
        spark.createDataFrame(rows, "indicator string, weight double, seq int"),
    )
    overwrite(changed.coalesce(1), staging)
    overwrite(read_required(spark, staging), name)


def run_gold(
    spark: SparkSession, catalog: str | None = None, weights: Mapping[str, float] | None = None
) -> None:
    """Write details, scores and weights.

    The indicator table is computed once, as the details table; scoring reads it back.
    Weights are those passed, else the saved ones, else the defaults.
    """
    details = table_name(GOLD, DETAILS_TABLE, catalog)
    table = build_indicator_table(spark, silver_sources(spark, catalog))
    overwrite(conform(table, GOLD_SCHEMAS[DETAILS_TABLE]), details)
    chosen = weights or current_weights(spark, catalog)
    scored = score_areas(read_required(spark, details), chosen, keep=SCORE_INPUTS)
    scores = conform(score_table(scored), GOLD_SCHEMAS[SCORES_TABLE])
    overwrite(scores, table_name(GOLD, SCORES_TABLE, catalog))
    if current_weights(spark, catalog) is None:
        overwrite(weight_table(spark).coalesce(1), _config_tables(catalog)[0])


def run_export(spark: SparkSession, layer: str = "serving", catalog: str | None = None) -> None:
    """Copy the Gold tables for a database that takes no nested types.

    Component scores become JSON text; details and weights go as they are.
    """
    shapes = {SCORES_TABLE: export_scores, DETAILS_TABLE: None, CONFIG_TABLE: None}
    for name, shape in shapes.items():
        gold = read_required(spark, table_name(GOLD, name, catalog))
        overwrite(shape(gold) if shape else gold, table_name(layer, name, catalog))

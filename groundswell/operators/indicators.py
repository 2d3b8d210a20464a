"""The indicator table: every source's latest reading joined to one row per area."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from groundswell.functions.keys import state_abbr
from groundswell.functions.values import or_zero, ratio
from groundswell.operators.panel import latest_of_all, latest_per_key
from groundswell.schemas import SILVER_SCHEMAS

# Columns taken from the optional per-area sources.
AREA_COLUMNS = {
    "migration": ("net_migration", "net_migration_rate"),
    "vacancy": ("vacancy_rate",),
    "employment": ("total_employment", "avg_weekly_wage"),
    "school_enrollment": ("total_enrollment",),
    "business_patterns": ("qsr_establishments", "retail_density"),
}
PERMIT_COLUMNS = (
    "county_name",
    "report_year",
    "report_quarter",
    "total_units_permitted",
    "single_family_units",
    "multi_family_units",
)

# Fixed values of the growth blend and its projection.
STATE_SHARE, PERMIT_SHARE, MIGRATION_SHARE = 0.50, 0.25, 0.25
PERMITS_PER_UNIT_GROWTH, MIGRATION_PER_UNIT_GROWTH = 100.0, 1000.0
GROWTH_FLOOR, GROWTH_CEILING = -0.30, 0.50
DEFAULT_HORIZON = 10

Sources = Mapping[str, DataFrame]


def source_or_empty(spark: SparkSession, sources: Sources, name: str) -> DataFrame:
    """The named Silver frame, or an empty one with its schema."""
    found = sources.get(name)
    if found is not None:
        return found
    return spark.createDataFrame([], SILVER_SCHEMAS[f"silver_{name}"])


def area_permits(permits: DataFrame) -> DataFrame:
    """Quarterly permits per area: an area spelled two ways keeps the units of both.

    Its name is the last one in order.
    """
    units = ("total_units_permitted", "single_family_units", "multi_family_units")
    return permits.groupBy("fips", "report_year", "report_quarter").agg(
        F.max("county_name").alias("county_name"), *[F.sum(c).alias(c) for c in units]
    )


def indicator_base(permits: DataFrame, demographics: DataFrame) -> DataFrame:
    """Latest permits and latest demographics, areas of either side kept."""
    people = latest_per_key(demographics, ["report_year", "population", "median_income"])
    return latest_per_key(area_permits(permits), PERMIT_COLUMNS).join(
        people.withColumnRenamed("report_year", "acs_year"), "fips", "full"
    )


def latest_projection(
    projections: DataFrame, scenario: str = "SSP2", state_key: str | None = None
) -> DataFrame:
    """Per state: last projected year of one scenario and its growth rate (null as 0).

    The state code is in ``state_key``; by default ``state_fips`` if there, else ``fips``.
    """
    if state_key is None:
        state_key = "state_fips" if "state_fips" in projections.columns else "fips"
    newest = Window.partitionBy("_state").orderBy(
        F.col("projection_year").desc(), F.col("projected_growth_rate").asc()
    )
    return (
        projections.filter(F.col("scenario") == scenario)
        .select(F.col(state_key).alias("_state"), "projection_year", "projected_growth_rate")
        .withColumn("_rn", F.row_number().over(newest))
        .filter("_rn = 1")
        .select(
            F.col("_state").alias("state_code"),
            F.col("projection_year").alias("ssp_projection_year"),
            or_zero(F.col("projected_growth_rate")).alias("state_growth_rate"),
        )
    )


def with_state_projection(areas: DataFrame, projection: DataFrame) -> DataFrame:
    """Add the projection of each area's state, by the first two digits of the code.

    ``projection`` has one row per ``state_code``. Two digits make at most a hundred keys, so
    the projection is one map, read as a constant through a scalar subquery: no row of
    the areas moves, however many of them one state has.
    """
    values = [c for c in projection.columns if c != "state_code"]
    two_digits = projection.filter(F.col("state_code").rlike("^[0-9]{2}$"))
    entries = F.collect_list(F.struct("state_code", F.struct(*values)))
    by_state = two_digits.agg(F.map_from_entries(entries).alias("by_state")).scalar()
    found = F.try_element_at(by_state, F.substring("fips", 1, 2))
    return areas.withColumn("_state", found).select(
        *areas.columns, *[F.col("_state")[c].alias(c) for c in values]
    )


def permits_per_1k(units: Column, population: Column, missing: str = "default") -> Column:
    """Permitted units per 1,000 people; missing permits count as 0 by default."""
    return ratio(units if missing == "null" else or_zero(units), population) * 1000


def occupancy(vacancy_rate: Column, missing: str = "default") -> Column:
    """Share of occupied units; a missing vacancy rate counts as 0 by default."""
    return F.lit(1.0) - (
        vacancy_rate if missing == "null" else F.coalesce(vacancy_rate, F.lit(0.0))
    )


def growth_blend(state_rate: Column, permits_1k: Column, migration_rate: Column) -> Column:
    """Blend of state outlook, permits and migration, clamped; nulls count as 0."""
    zero = F.lit(0.0)
    blended = (
        F.lit(STATE_SHARE) * F.coalesce(state_rate, zero)
        + F.lit(PERMIT_SHARE) * (F.coalesce(permits_1k, zero) / PERMITS_PER_UNIT_GROWTH)
        + F.lit(MIGRATION_SHARE) * (F.coalesce(migration_rate, zero) / MIGRATION_PER_UNIT_GROWTH)
    )
    return F.greatest(F.least(blended, F.lit(GROWTH_CEILING)), F.lit(GROWTH_FLOOR))


def projected_population(
    population: Column, growth: Column, projection_year: Column, base_year: Column
) -> Column:
    """Population compounded over the years to the projection, cut to a whole number."""
    years = F.coalesce(projection_year - base_year, F.lit(DEFAULT_HORIZON)).cast("double")
    annual = F.when(
        years > 0, F.pow(F.lit(1.0) + growth, F.lit(1.0) / years) - F.lit(1.0)
    ).otherwise(F.lit(0.0))
    return (population * F.pow(F.lit(1.0) + annual, years)).try_cast("bigint")


def build_indicator_table(
    spark: SparkSession,
    sources: Sources,
    scenario: str = "SSP2",
    state_key: str | None = None,
    missing: str = "default",
    more_columns: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """One row per area with permits or demographics.

    ``sources`` maps Silver names (without ``silver_``) to frames; permits and
    demographics are required, the rest may be absent and then yield null columns.
    ``missing="null"`` keeps unknown permits and vacancy unknown instead of 0.
    ``more_columns`` names further columns to take per source. The latest rows of all
    sources come from one aggregate; nothing is joined that could multiply rows.
    """
    tables = {
        "permits": (area_permits(sources["building_permits"]), {c: c for c in PERMIT_COLUMNS}),
        "people": (
            sources["acs_demographics"],
            {"acs_year": "report_year", "population": "population", "median_income": "median_income"},
        ),
    }
    for name, columns in AREA_COLUMNS.items():
        taken = [*columns, *(more_columns or {}).get(name, ())]
        tables[name] = source_or_empty(spark, sources, name), {c: c for c in taken}
    table = latest_of_all(tables).filter("has_permits OR has_people")
    table = table.drop(*[f"has_{name}" for name in tables])
    outlook = latest_projection(
        source_or_empty(spark, sources, "ssp_projections"), scenario, state_key
    )
    people = F.col("population")
    return (
        with_state_projection(table, outlook)
        .withColumn("state", state_abbr(F.col("fips")))
        .withColumns(
            {
                "permits_per_1k_pop": permits_per_1k(
                    F.col("total_units_permitted"), people, missing
                ),
                "employment_per_capita": ratio(F.col("total_employment"), people),
                "enrollment_per_capita": ratio(F.col("total_enrollment"), people),
                "occupancy_rate": occupancy(F.col("vacancy_rate"), missing),
            }
        )
        .withColumn(
            "ssp_growth_rate",
            growth_blend(
                F.col("state_growth_rate"),
                F.col("permits_per_1k_pop"),
                F.col("net_migration_rate"),
            ),
        )
        .withColumn(
            "ssp_projected_pop",
            projected_population(
                people,
                F.col("ssp_growth_rate"),
                F.col("ssp_projection_year"),
                F.col("acs_year"),
            ),
        )
        .drop("state_growth_rate")
    )

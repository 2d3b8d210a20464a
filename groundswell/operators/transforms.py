"""Bronze to Silver: one transform per source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from groundswell.functions.values import ratio, strip
from groundswell.operators.panel import growth, previous_value, with_base_value
from groundswell.sources.files import flow_counts

QSR_INDUSTRY = "7222"

# State codes of summary rows, and the county code of state totals.
SUMMARY_STATES = ("96", "97", "98")
STATE_TOTAL = "000"


def permits_quarterly(bronze: DataFrame) -> DataFrame:
    """Monthly permits summed to quarters per area and name."""
    month = F.try_to_date("survey_date", "yyyyMM")
    return (
        bronze.withColumn("report_year", F.year(month))
        .withColumn("report_quarter", F.quarter(month))
        .groupBy("fips", "county_name", "report_year", "report_quarter")
        .agg(
            F.sum("total_units").alias("total_units_permitted"),
            F.sum("single_family_units").alias("single_family_units"),
            F.sum("multi_family_units").alias("multi_family_units"),
        )
    )


def migration_rate(bronze: DataFrame, population: DataFrame) -> DataFrame:
    """Net migration per 1,000 people; ``population`` is (fips, population)."""
    return bronze.join(population, "fips", "left").select(
        "fips",
        "report_year",
        "report_quarter",
        "inflow",
        "outflow",
        "net_migration",
        (ratio(F.col("net_migration"), F.col("population")) * 1000).alias("net_migration_rate"),
    )


def vacancy_change(bronze: DataFrame) -> DataFrame:
    """Vacancy rate and its change from the area's previous row."""
    rated = bronze.select(
        "fips",
        "report_year",
        "report_quarter",
        ratio(F.col("vacant_addresses"), F.col("total_addresses")).alias("vacancy_rate"),
    )
    lagged = previous_value(rated, "vacancy_rate", "_previous")
    change = F.col("vacancy_rate") - F.col("_previous")
    return lagged.withColumn("vacancy_rate_yoy_change", change).drop("_previous")


def employment_growth(bronze: DataFrame) -> DataFrame:
    """Employment growth from the previous row, and the average weekly wage."""
    picked = bronze.select(
        "fips", "report_year", "report_quarter", "total_employment", "total_wages"
    )
    lagged = previous_value(picked, "total_employment", "_previous")
    return lagged.select(
        "fips",
        "report_year",
        "report_quarter",
        "total_employment",
        growth("total_employment", "_previous").alias("employment_growth_rate"),
        ratio(F.col("total_wages"), F.col("total_employment") * 13).alias("avg_weekly_wage"),
    )


def enrollment_growth(bronze: DataFrame) -> DataFrame:
    """Districts summed to areas, then growth from the area's previous year."""
    yearly = bronze.groupBy("fips", "report_year").agg(
        F.sum("total_enrollment").alias("total_enrollment")
    )
    lagged = previous_value(yearly, "total_enrollment", "_previous", order=["report_year"])
    return lagged.select(
        "fips",
        "report_year",
        "total_enrollment",
        growth("total_enrollment", "_previous").alias("enrollment_growth_rate"),
    )


def demographics(bronze: DataFrame) -> DataFrame:
    """Column pick with enforced types."""
    return bronze.select(
        "fips",
        "report_year",
        F.col("population").cast("int").alias("population"),
        F.col("median_income").cast("double").alias("median_income"),
        F.col("median_age").cast("double").alias("median_age"),
        F.col("households").cast("int").alias("households"),
    )


def business_density(
    bronze: DataFrame, population: DataFrame, industry: str = QSR_INDUSTRY
) -> DataFrame:
    """All establishments, those of one industry, and the total per 1,000 people.

    One pass: the industry's sum is a conditional sum, null where it has no rows.
    """
    counted = bronze.groupBy("fips", "report_year").agg(
        F.sum("establishments").alias("total_establishments"),
        F.sum(F.when(F.col("naics_code") == industry, F.col("establishments"))).alias(
            "qsr_establishments"
        ),
    )
    return counted.join(population, "fips", "left").select(
        "fips",
        "report_year",
        "total_establishments",
        "qsr_establishments",
        (ratio(F.col("total_establishments"), F.col("population")) * 1000).alias(
            "retail_density"
        ),
    )


def construction_growth(bronze: DataFrame) -> DataFrame:
    """Growth of permitted units from the area's previous row."""
    picked = bronze.select("fips", "report_year", "report_quarter", "permitted_units")
    lagged = previous_value(picked, "permitted_units", "_previous")
    rate = growth("permitted_units", "_previous")
    return lagged.withColumn("construction_growth_rate", rate).drop("_previous")


def projection_growth(bronze: DataFrame) -> DataFrame:
    """Growth of each projection against the first projected year of its scenario."""
    picked = bronze.select("fips", "projection_year", "scenario", "projected_population")
    based = with_base_value(
        picked, "projected_population", "_base", ["fips", "scenario"], "projection_year"
    )
    return based.select(
        "fips",
        "projection_year",
        "scenario",
        "projected_population",
        growth("projected_population", "_base").alias("projected_growth_rate"),
    )


def state_projections(bronze: DataFrame) -> DataFrame:
    """Column pick with enforced types."""
    return bronze.select(
        "state_fips",
        "projection_year",
        F.col("projected_population").cast("bigint").alias("projected_population"),
    )


def _area_of(state: Column, county: Column) -> Column:
    """Area code of a flow's side, null for summary rows and malformed codes.

    Parts are padded first, so that 1 and 1 is 01001 and county 0 is the state total.
    """
    usable = state.rlike("^[0-9]{1,2}$") & county.rlike("^[0-9]{1,3}$")
    state, county = F.lpad(state, 2, "0"), F.lpad(county, 3, "0")
    return F.when(
        usable & ~state.isin(*SUMMARY_STATES) & (county != STATE_TOTAL), F.concat(state, county)
    )


def flow_rows(flows: DataFrame, **areas: str) -> DataFrame:
    """Usable flows: one area column per ``name=side``, and ``people``.

    A side is ``y1`` (origin) or ``y2`` (destination). Summary states, state totals,
    blank or malformed codes and bad numbers are left out.
    """
    found = flows.select(
        *[
            _area_of(strip(F.col(f"{side}_statefips")), strip(F.col(f"{side}_countyfips"))).alias(
                name
            )
            for name, side in areas.items()
        ],
        flow_counts(F.col("n2")).alias("people"),
    )
    return found.dropna()


def flow_totals(flows: DataFrame, side: str) -> DataFrame:
    """People per area over all flows of one side."""
    return _per_area(_sided(flows, side)).groupBy("fips").agg(F.sum("people").alias("people"))


def _sided(flows: DataFrame, *sides: str) -> DataFrame:
    """(side, state, county, people), codes as written; with two sides, each flow counts on both."""
    each = [
        F.struct(
            F.lit(side).alias("side"),
            F.col(f"{side}_statefips").alias("state"),
            F.col(f"{side}_countyfips").alias("county"),
        )
        for side in sides
    ]
    people = flow_counts(F.col("n2")).alias("people")
    return flows.select(people, *[c for s in sides for c in (f"{s}_statefips", f"{s}_countyfips")]).select(
        F.inline(F.array(*each)), "people"
    )


def _per_area(rows: DataFrame) -> DataFrame:
    """(side, fips, people) of usable flows, one row per code as it is written.

    There are few codes and many flows: people are summed by the written codes first (with
    map-side combine), and only the sums' codes are read.
    """
    summed = rows.groupBy("side", "state", "county").agg(F.sum("people").alias("people"))
    area = _area_of(strip(F.col("state")), strip(F.col("county"))).alias("fips")
    return summed.select("side", area, "people").dropna()


def net_migration(inflows: DataFrame, outflows: DataFrame, year: int, quarter: int) -> DataFrame:
    """Inflow, outflow and their difference for every area on either side.

    ``inflows`` is read by destination and ``outflows`` by origin, and both sides are
    summed in one aggregate. A frame passed for both is read once.
    """
    if inflows is outflows:
        rows = _sided(inflows, "y2", "y1")
    else:
        rows = _sided(inflows, "y2").unionByName(_sided(outflows, "y1"))

    def total(side: str) -> Column:
        return F.sum(F.when(F.col("side") == side, F.col("people")).otherwise(0))

    both = _per_area(rows).groupBy("fips").agg(total("y2").alias("inflow"), total("y1").alias("outflow"))
    return both.select(
        "fips",
        F.lit(year).alias("report_year"),
        F.lit(quarter).alias("report_quarter"),
        "inflow",
        "outflow",
        (F.col("inflow") - F.col("outflow")).alias("net_migration"),
        F.lit("irs_soi").alias("data_source"),
    )

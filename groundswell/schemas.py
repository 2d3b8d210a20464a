"""Explicit schemas of every Bronze, Silver and Gold table."""

from __future__ import annotations

from pyspark.sql import types as T

_BY_DATE = ", source_date date, ingested_at timestamp"
_BY_YEAR = ", source_year int, ingested_at timestamp"

_BRONZE = {
    "building_permits": "fips string, county_name string, survey_date string, "
    "single_family_units bigint, multi_family_units bigint, total_units bigint, "
    "single_family_bldgs bigint" + _BY_DATE,
    "hud_construction": "fips string, county_name string, report_year int, report_quarter int, "
    "permitted_units bigint, data_source string" + _BY_DATE,
    "acs_demographics": "fips string, report_year int, county_name string, population bigint, "
    "median_income bigint, median_age double, households bigint, data_source string" + _BY_YEAR,
    "vacancy": "fips string, report_year int, report_quarter int, total_addresses bigint, "
    "vacant_addresses bigint, data_source string" + _BY_DATE,
    "school_enrollment": "fips string, report_year int, total_enrollment bigint, "
    "data_source string" + _BY_DATE,
    "business_patterns": "fips string, report_year int, naics_code string, "
    "establishments bigint, employees bigint, data_source string" + _BY_YEAR,
    "national_projections": "state_fips string, projection_year int, "
    "projected_population bigint, data_source string, ingested_at timestamp",
    "ssp_projections": "fips string, projection_year int, scenario string, "
    "projected_population bigint, ingested_at timestamp",
    "employment": "fips string, report_year int, report_quarter int, total_employment bigint, "
    "total_wages bigint, establishments bigint, data_source string" + _BY_DATE,
    "migration": "fips string, report_year int, report_quarter int, inflow bigint, "
    "outflow bigint, net_migration bigint, data_source string" + _BY_DATE,
}

_SILVER = {
    "silver_acs_demographics": "fips string, report_year int, population int, "
    "median_income double, median_age double, households int",
    "silver_building_permits": "fips string, county_name string, report_year int, "
    "report_quarter int, total_units_permitted bigint, single_family_units bigint, "
    "multi_family_units bigint",
    "silver_migration": "fips string, report_year int, report_quarter int, inflow bigint, "
    "outflow bigint, net_migration bigint, net_migration_rate double",
    "silver_vacancy": "fips string, report_year int, report_quarter int, "
    "vacancy_rate double, vacancy_rate_yoy_change double",
    "silver_employment": "fips string, report_year int, report_quarter int, "
    "total_employment bigint, employment_growth_rate double, avg_weekly_wage double",
    "silver_school_enrollment": "fips string, report_year int, total_enrollment bigint, "
    "enrollment_growth_rate double",
    "silver_business_patterns": "fips string, report_year int, total_establishments bigint, "
    "qsr_establishments bigint, retail_density double",
    "silver_hud_construction": "fips string, report_year int, report_quarter int, "
    "permitted_units bigint, construction_growth_rate double",
    "silver_ssp_projections": "fips string, projection_year int, scenario string, "
    "projected_population bigint, projected_growth_rate double",
    "silver_national_projections": "state_fips string, projection_year int, "
    "projected_population bigint",
}

_COMPONENTS = (
    "building_permits double, net_migration double, vacancy_change double, "
    "employment_growth double, school_enrollment_growth double, ssp_projected_growth double"
)

_GOLD = {
    "gold_county_growth_score": "fips string, county_name string, state string, "
    "report_year int, report_quarter int, population int, median_income double, "
    "composite_score double, score_tier string, rank_national bigint, "
    "component_scores components, "
    "ssp_projected_pop bigint, ssp_projection_year int, ssp_growth_rate double",
    "gold_county_details": "fips string, county_name string, report_year int, "
    "report_quarter int, total_units_permitted bigint, single_family_units bigint, "
    "multi_family_units bigint, acs_year int, population int, median_income double, "
    "net_migration bigint, net_migration_rate double, vacancy_rate double, "
    "total_employment bigint, avg_weekly_wage double, total_enrollment bigint, "
    "qsr_establishments bigint, retail_density double, ssp_projection_year int, "
    "state string, permits_per_1k_pop double, employment_per_capita double, "
    "enrollment_per_capita double, occupancy_rate double, ssp_growth_rate double, "
    "ssp_projected_pop bigint",
    "gold_scoring_config": "indicator string, weight double",
}

_LOG = (
    "source_name string, status string, rows_loaded bigint, rows_rejected bigint, "
    "error_msg string, started_at timestamp, completed_at timestamp"
)

_LANDED = (
    "file string, period string, status string, rows_loaded bigint, rows_rejected bigint, "
    "error_msg string, started_at timestamp, completed_at timestamp"
)


_TYPES: dict[str, T.DataType] = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
}


def _schema(columns: str) -> T.StructType:
    """Schema of ``name type, ...``; needs no session, unlike ``StructType.fromDDL``."""
    pairs = [column.split() for column in columns.split(", ")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


COMPONENTS = _schema(_COMPONENTS)
_TYPES["components"] = COMPONENTS

BRONZE_SCHEMAS = {name: _schema(columns) for name, columns in _BRONZE.items()}
SILVER_SCHEMAS = {name: _schema(columns) for name, columns in _SILVER.items()}
GOLD_SCHEMAS = {name: _schema(columns) for name, columns in _GOLD.items()}
LOG_SCHEMA = _schema(_LOG)
LANDED_SCHEMA = _schema(_LANDED)

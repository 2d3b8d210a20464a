"""Scoring constants and table names."""

from __future__ import annotations

# They must equal the published scoring rules.
DEFAULT_WEIGHTS = {
    "building_permits": 0.25,
    "net_migration": 0.20,
    "vacancy_change": 0.15,
    "employment_growth": 0.15,
    "school_enrollment_growth": 0.10,
    "ssp_projected_growth": 0.15,
}

# Indicator -> column of the indicator table it is read from.
INDICATOR_COLUMNS = {
    "building_permits": "permits_per_1k_pop",
    "net_migration": "net_migration_rate",
    "vacancy_change": "occupancy_rate",
    "employment_growth": "employment_per_capita",
    "school_enrollment_growth": "enrollment_per_capita",
    "ssp_projected_growth": "ssp_growth_rate",
}

# Percentile tiers, upper ntile(100) bound of each letter; the rest is F.
PERCENTILE_TIERS = {"A": 10, "B": 30, "C": 60, "D": 85}

# Threshold tiers, inclusive score range of each letter, tried in this order.
SCORE_TIERS = {
    "A": (80, 100),
    "B": (60, 80),
    "C": (40, 60),
    "D": (20, 40),
    "F": (0, 20),
}

# The older seven-indicator variant, weights, columns, and inverted indicators.
SEVEN_WEIGHTS = {
    "building_permits": 0.25,
    "net_migration": 0.20,
    "vacancy_change": 0.15,
    "employment_growth": 0.15,
    "school_enrollment_growth": 0.10,
    "ssp_projected_growth": 0.10,
    "qsr_density_inv": 0.05,
}
SEVEN_COLUMNS = {
    "building_permits": "permits_per_1k_pop",
    "net_migration": "net_migration_rate",
    "vacancy_change": "vacancy_rate_yoy_change",
    "employment_growth": "employment_growth_rate",
    "school_enrollment_growth": "enrollment_growth_rate",
    "ssp_projected_growth": "ssp_projected_pop",
    "qsr_density_inv": "qsr_establishments",
}
SEVEN_INVERTED = frozenset({"vacancy_change", "qsr_density_inv"})

MIN_SOURCES_FOR_SCORE = 5

BRONZE, SILVER, GOLD = "bronze", "silver", "gold"
SCORES_TABLE = "gold_county_growth_score"
DETAILS_TABLE = "gold_county_details"
CONFIG_TABLE = "gold_scoring_config"
LOG_TABLE = "_ingestion_log"


def table_name(layer: str, table: str, catalog: str | None = None) -> str:
    """``[catalog.]layer.table``; the session catalog when none is named."""
    return ".".join(part for part in (catalog, layer, table) if part)


def landed(source: str) -> str:
    """Bronze table that a source's landing stream fills."""
    return f"{source}_landed"


def landed_files(source: str) -> str:
    """Bronze table with a row per file that the landing stream took in."""
    return f"{source}_landed_files"

"""Parameters of the registered queries, shared with their SQL."""

from __future__ import annotations

from groundswell.config import DEFAULT_WEIGHTS

CUSTOM_WEIGHTS = {
    "building_permits": 0.10,
    "net_migration": 0.30,
    "vacancy_change": 0.10,
    "employment_growth": 0.30,
    "school_enrollment_growth": 0.20,
    "ssp_projected_growth": 0.0,
}

# One update of a known indicator, one of an unknown one (ignored).
WEIGHT_UPDATES = {"building_permits": 0.40, "qsr_density_inv": 0.50}
UPDATED_WEIGHTS = {**DEFAULT_WEIGHTS, "building_permits": 0.40}

FILTER_TIERS = ("A", "B", "C")
FILTER_STATES = ("01", "04", "06", "08", "12", "17", "36", "48", "53")
FILTER_METRICS = {
    "population": (500.0, 9000.0),
    "median_income": (32000.0, 78000.0),
    "occupancy_rate": (0.4, 1.0),
    "net_migration_rate": (-5000.0, 5000.0),
}
HIGHLIGHT = {"state": "06", "tier": "C", "min_score": 20.0}

"""Labels and display numbers of a scored area."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from groundswell.functions.keys import abbreviation
from groundswell.functions.values import lookup

# Fixed values.
TIER_LABELS = {
    "A": "Top 10%",
    "B": "Top 30%",
    "C": "Top 60%",
    "D": "Top 85%",
    "F": "Bottom 15%",
}


def component_value(component: Column) -> Column:
    """A normalized component as a whole number out of 100; 0 when missing."""
    return F.coalesce(F.floor(component * 100 + 0.5), F.lit(0).cast("bigint"))


def tier_label(tier: Column) -> Column:
    """Label of a tier letter; a missing letter counts as F."""
    return lookup(TIER_LABELS, F.coalesce(tier, F.lit("F")))


def state_label(prefix: Column) -> Column:
    """Abbreviation of a state code, empty when unknown."""
    return F.coalesce(abbreviation(prefix), F.lit(""))

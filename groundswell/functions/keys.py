"""Area codes: five digits, of which the first two are the state."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from groundswell.functions.values import lookup, strip

# State code -> abbreviation. The keys are also the valid prefixes.
STATE_ABBR = {
    "01": "AL", "02": "AK", "04": "AZ", "05": "AR", "06": "CA", "08": "CO",
    "09": "CT", "10": "DE", "11": "DC", "12": "FL", "13": "GA", "15": "HI",
    "16": "ID", "17": "IL", "18": "IN", "19": "IA", "20": "KS", "21": "KY",
    "22": "LA", "23": "ME", "24": "MD", "25": "MA", "26": "MI", "27": "MN",
    "28": "MS", "29": "MO", "30": "MT", "31": "NE", "32": "NV", "33": "NH",
    "34": "NJ", "35": "NM", "36": "NY", "37": "NC", "38": "ND", "39": "OH",
    "40": "OK", "41": "OR", "42": "PA", "44": "RI", "45": "SC", "46": "SD",
    "47": "TN", "48": "TX", "49": "UT", "50": "VT", "51": "VA", "53": "WA",
    "54": "WV", "55": "WI", "56": "WY",
}

UNKNOWN_STATE = "??"


def area_code(raw: Column) -> Column:
    """Stripped and zero-padded to five digits; null unless 1-5 digits."""
    code = strip(raw)
    return F.when(code.rlike("^[0-9]{1,5}$"), F.lpad(code, 5, "0"))


def is_valid_area(code: Column) -> Column:
    """Five digits with a known state prefix; false (not null) for null."""
    known = code.rlike("^[0-9]{5}$") & F.substring(code, 1, 2).isin(*STATE_ABBR)
    return F.coalesce(known, F.lit(False))


def state_code(raw: Column) -> Column:
    """First two digits of the normalized code."""
    return F.substring(area_code(raw), 1, 2)


def abbreviation(prefix: Column) -> Column:
    """Abbreviation of a two-digit state code, null when unknown."""
    return lookup(STATE_ABBR, prefix)


def state_abbr(code: Column) -> Column:
    """Abbreviation of an area's state, ``??`` when unknown."""
    return F.coalesce(abbreviation(F.substring(code, 1, 2)), F.lit(UNKNOWN_STATE))


def period_date(year: Column, quarter: Column) -> Column:
    """First day of the last month of a quarter."""
    return F.make_date(year, quarter * 3, F.lit(1))

"""ANSI SQL for every registered query, for DuckDB on the same tables.

Written from the semantics, not from the Spark plans: global windows, ``ntile`` and
cross joins are fine here because a check runs on one machine at a small scale.
``SHARED`` holds common table expressions; ``_sql`` prepends those a query needs.
"""

from __future__ import annotations

import re

from groundswell.plans.settings import (
    CUSTOM_WEIGHTS,
    FILTER_METRICS,
    FILTER_STATES,
    FILTER_TIERS,
    HIGHLIGHT,
)

# Fixed values, written out here again so that the SQL does not lean on the code it checks.
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
DEFAULT_WEIGHTS = {
    "building_permits": 0.25,
    "net_migration": 0.2,
    "vacancy_change": 0.15,
    "employment_growth": 0.15,
    "school_enrollment_growth": 0.1,
    "ssp_projected_growth": 0.15,
}
UPDATED_WEIGHTS = {
    "building_permits": 0.4,
    "net_migration": 0.2,
    "vacancy_change": 0.15,
    "employment_growth": 0.15,
    "school_enrollment_growth": 0.1,
    "ssp_projected_growth": 0.15,
}
INDICATOR_COLUMNS = {
    "building_permits": "permits_per_1k_pop",
    "net_migration": "net_migration_rate",
    "vacancy_change": "occupancy_rate",
    "employment_growth": "employment_per_capita",
    "school_enrollment_growth": "enrollment_per_capita",
    "ssp_projected_growth": "ssp_growth_rate",
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
SEVEN_WEIGHTS = {
    "building_permits": 0.25,
    "net_migration": 0.2,
    "vacancy_change": 0.15,
    "employment_growth": 0.15,
    "school_enrollment_growth": 0.1,
    "ssp_projected_growth": 0.1,
    "qsr_density_inv": 0.05,
}
SEVEN_INVERTED = frozenset(["qsr_density_inv", "vacancy_change"])
TIER_LABELS = {
    "A": "Top 10%",
    "B": "Top 30%",
    "C": "Top 60%",
    "D": "Top 85%",
    "F": "Bottom 15%",
}
COVERAGE_COLUMNS = {
    "building_permits": "total_units_permitted",
    "acs_demographics": "population",
    "migration": "net_migration",
    "vacancy": "vacancy_rate",
    "employment": "total_employment",
    "school_enrollment": "total_enrollment",
    "business_patterns": "retail_density",
    "ssp_projections": "ssp_projection_year",
}
METRICS = (
    "population",
    "median_income",
    "permits_per_1k_pop",
    "net_migration_rate",
    "occupancy_rate",
    "employment_per_capita",
    "ssp_growth_rate",
)
_STATES = ", ".join(f"('{code}', '{abbr}')" for code, abbr in STATE_ABBR.items())
_ITEMS = """FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN homes g ON c_custkey = o_custkey"""


def _area(key: str, odd: int = 0) -> str:
    """Area code of a customer's key (even) or a supplier's (odd)."""
    return f"lpad(cast((({key} * 37) % 50000) * 2 + {odd} AS varchar), 5, '0')"


def _code(raw: str) -> str:
    """Area code of a text, null when malformed."""
    return (
        f"CASE WHEN regexp_full_match(trim({raw}), '[0-9]{{1,5}}') "
        f"THEN lpad(trim({raw}), 5, '0') END"
    )


def _flow(side: str) -> str:
    """Area of one side of a flow, null when unusable."""
    state = f"lpad(trim({side}_statefips), 2, '0')"
    county = f"lpad(trim({side}_countyfips), 3, '0')"
    return (
        f"CASE WHEN {state} NOT IN ('96', '97', '98') AND {county} <> '000' "
        f"THEN {state} || {county} END"
    )


# People of a flow, null when the text is no decimal number.
_PEOPLE = "cast(trunc(CASE WHEN regexp_full_match(n2, '[0-9]+') THEN cast(n2 AS double) END) AS bigint)"


def _latest(table: str, columns: str, order: str, ties: str) -> str:
    picked = ", ".join(f"{t} ASC NULLS FIRST" for t in ties.split(", ") if t)
    by = order + (", " + picked if picked else "")
    return (
        f"SELECT fips, {columns} FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY fips ORDER BY {by}) AS rn FROM {table}) WHERE rn = 1"
    )


YQ = "report_year DESC, report_quarter DESC"

SHARED: dict[str, str] = {
    # --- source-shaped views ---
    "homes": f"""SELECT c_custkey, {_area("c_custkey")} AS fips, c_name AS county_name
FROM customer""",
    "geo": f"""SELECT c_custkey AS owner, fips, county_name, c_acctbal AS acctbal
FROM homes JOIN customer USING (c_custkey)
UNION ALL SELECT s_suppkey, {_area("s_suppkey", 1)}, s_name, s_acctbal FROM supplier""",
    "areas": """SELECT fips, max(owner) AS owner,
  cast(sum(CASE WHEN owner % 97 = 0 THEN 0 ELSE cast(floor(abs(acctbal)) AS bigint) + 100 END)
    AS bigint) AS people
FROM geo GROUP BY 1""",
    "acs_b": """SELECT g.fips, y.report_year,
  CASE WHEN people = 0 THEN 0 ELSE people + (y.report_year - 1999) * (owner % 7) END AS population,
  CASE WHEN owner % 11 = 0 THEN NULL
    ELSE cast(30000 + (owner * 131) % 50000 AS double) END AS median_income,
  cast(20 + owner % 45 AS double) AS median_age,
  owner % 3000 AS households
FROM areas g CROSS JOIN (SELECT 1999 AS report_year UNION ALL SELECT 2000) y""",
    "permits_b": f"""SELECT g.fips, g.county_name,
  cast(extract(year FROM o_orderdate) * 100 + extract(month FROM o_orderdate) AS varchar)
    AS survey_date,
  cast(sum(CASE WHEN l_returnflag = 'N' THEN cast(l_quantity AS bigint) ELSE 0 END) AS bigint)
    AS single_family_units,
  cast(sum(CASE WHEN l_returnflag <> 'N' THEN cast(l_quantity AS bigint) ELSE 0 END) AS bigint)
    AS multi_family_units,
  cast(sum(cast(l_quantity AS bigint)) AS bigint) AS total_units
{_ITEMS}
GROUP BY 1, 2, 3""",
    "flows_raw": f"""SELECT
  substr({_area("l_suppkey", 1)}, 1, 2) AS y1_statefips,
  substr({_area("l_suppkey", 1)}, 3, 3) AS y1_countyfips,
  CASE WHEN l_discount = 0.1 THEN '96' ELSE substr(g.fips, 1, 2) END AS y2_statefips,
  CASE WHEN l_discount = 0 THEN '000' ELSE substr(g.fips, 3, 3) END AS y2_countyfips,
  CASE WHEN l_tax = 0 THEN 'd' WHEN l_linenumber = 7 THEN cast(cast(l_quantity AS bigint) AS varchar) || 'd'
    ELSE cast(cast(l_quantity AS bigint) AS varchar) END AS n2
{_ITEMS}""",
    "vacancy_b": f"""SELECT g.fips,
  cast(extract(year FROM l_shipdate) AS int) AS report_year,
  cast(extract(quarter FROM l_shipdate) AS int) AS report_quarter,
  sum(cast(l_quantity AS bigint)) AS total_addresses,
  sum(CASE WHEN l_returnflag = 'R' THEN cast(l_quantity AS bigint) ELSE 0 END)
    AS vacant_addresses
{_ITEMS}
GROUP BY 1, 2, 3""",
    "qcew_raw": """SELECT g.fips AS area_fips,
  CASE WHEN o_orderstatus = 'F' THEN '5' ELSE '0' END AS own_code,
  CASE WHEN o_orderpriority = '5-LOW' THEN '1011' ELSE '10' END AS industry_code,
  '70' AS agglvl_code,
  cast(extract(year FROM o_orderdate) AS varchar) AS year,
  cast(extract(quarter FROM o_orderdate) AS varchar) AS qtr,
  cast(o_orderkey % 500 AS varchar) AS month1_emplvl,
  cast(o_orderkey % 700 AS varchar) AS month2_emplvl,
  CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE cast(o_orderkey % 900 AS varchar) END
    AS month3_emplvl,
  cast(cast(floor(o_totalprice) AS bigint) AS varchar) AS total_qtrly_wages,
  cast(1 + o_orderkey % 40 AS varchar) AS qtrly_estabs
FROM orders JOIN homes g ON c_custkey = o_custkey""",
    "enrollment_b": """SELECT g.fips, cast(extract(year FROM o_orderdate) AS int) AS report_year,
  o_orderpriority AS district_id, o_orderkey % 1000 AS total_enrollment
FROM orders JOIN homes g ON c_custkey = o_custkey""",
    "business_b": f"""SELECT g.fips, cast(extract(year FROM o_orderdate) AS int) AS report_year,
  CASE WHEN p_size % 10 = 0 THEN '7222' ELSE cast(1100 + p_size AS varchar) END AS naics_code,
  cast(l_quantity AS bigint) AS establishments, cast(l_quantity AS bigint) * 12 AS employees
{_ITEMS}
  JOIN part ON p_partkey = l_partkey""",
    "ssp_b": """SELECT s.fips, y.projection_year, c.scenario,
  cast(1000000 + cast(s.fips AS int) * 10007
    + (y.projection_year - 2025) * (cast(s.fips AS int) % 7 * 2 - 7) * c.k AS bigint)
    AS projected_population
FROM (SELECT DISTINCT substr(fips, 1, 2) AS fips FROM geo) s
  CROSS JOIN (SELECT 2030 AS projection_year UNION ALL SELECT 2035 UNION ALL SELECT 2040) y
  CROSS JOIN (SELECT 'SSP1' AS scenario, 900 AS k UNION ALL SELECT 'SSP2', 1700) c""",
    "popproj_raw": """SELECT cast(people + (y.yr - 2020) * (owner % 7) AS varchar) AS POP,
  cast(y.yr AS varchar) AS YEAR, cast(x.sex AS varchar) AS SEX,
  cast(cast(substr(fips, 1, 2) AS int) AS varchar) AS state
FROM areas
  CROSS JOIN (SELECT 2030 AS yr UNION ALL SELECT 2040) y
  CROSS JOIN (SELECT 0 AS sex UNION ALL SELECT 1 UNION ALL SELECT 2) x""",
    "bps_raw": """SELECT survey_date AS c0, substr(fips, 1, 2) AS c1,
  cast(cast(substr(fips, 3, 3) AS int) AS varchar) AS c2,
  county_name || '   ' AS c5,
  cast(single_family_units % 9 AS varchar) AS c6,
  cast(single_family_units AS varchar) AS c7,
  CASE WHEN multi_family_units % 4 = 0 THEN '' ELSE cast(multi_family_units % 4 AS varchar) END
    AS c10,
  '0' AS c13,
  cast(multi_family_units - multi_family_units % 4 AS varchar) AS c16
FROM permits_b
UNION ALL SELECT 'Survey', 'FIPS', 'FIPS', 'County', '', '1-unit', '2-units', '3-4 units',
  '5+ units'
UNION ALL SELECT '202001', '01', '001', 'Short row', NULL, NULL, NULL, NULL, NULL""",
    "census_raw": """SELECT cast(population AS varchar) AS pop,
  CASE WHEN median_income IS NULL THEN '-' ELSE cast(cast(median_income AS int) AS varchar) END
    AS income,
  cast(median_age AS varchar) AS age, cast(households AS varchar) AS homes,
  cast(households + 100 AS varchar) AS units, cast(households % 50 AS varchar) AS vacant,
  CASE WHEN households % 10 = 0 THEN '' ELSE cast(households * 3 AS varchar) END AS enrolled,
  cast(households % 70 AS varchar) AS estab,
  CASE WHEN households % 8 = 0 THEN '-' ELSE cast(households % 900 AS varchar) END AS emp,
  '7222' AS naics, 'Area ' || fips || ', State' AS name,
  substr(fips, 1, 2) AS state, substr(fips, 3, 3) AS county
FROM acs_b WHERE report_year = 2000""",
    "boundaries_raw": """SELECT CASE WHEN max(c_custkey) % 2 = 0 THEN fips END AS GEOID,
  '0500000US' || fips AS GEO_ID, substr(fips, 1, 2) AS STATE, max(county_name) AS NAME
FROM homes GROUP BY fips
UNION ALL SELECT NULL, '0500000US99999', '99', 'Unscored area'""",
    "crosswalk_b": f"""SELECT cast(c_custkey AS varchar) AS zip,
  {_area("(c_custkey + k.k)")} AS fips, k.ratio
FROM customer CROSS JOIN (SELECT 0 AS k, cast(0.25 AS double) AS ratio
                          UNION ALL SELECT 1, cast(0.75 AS double)) k""",
    # --- parsed sources ---
    "permit_rows": """SELECT trim(c1) || lpad(trim(c2), 3, '0') AS fips,
  trim(c5) AS county_name, trim(c0) AS survey_date,
  coalesce(try_cast(nullif(c6, '') AS bigint), 0) AS bldgs,
  coalesce(try_cast(nullif(c7, '') AS bigint), 0) AS one_unit,
  coalesce(try_cast(nullif(c10, '') AS bigint), 0)
    + coalesce(try_cast(nullif(c13, '') AS bigint), 0)
    + coalesce(try_cast(nullif(c16, '') AS bigint), 0) AS more_units
FROM bps_raw WHERE regexp_full_match(c0, '[0-9]{6}') AND c16 IS NOT NULL""",
    "wage_rows": f"""SELECT lpad(area_fips, 5, '0') AS fips, cast(year AS int) AS report_year,
  cast(qtr AS int) AS report_quarter,
  cast(round((cast(month1_emplvl AS bigint) + cast(month2_emplvl AS bigint)
    + coalesce(cast(nullif(month3_emplvl, '') AS bigint), 0)) / 3.0) AS bigint)
    AS total_employment,
  cast(total_qtrly_wages AS bigint) AS total_wages,
  cast(qtrly_estabs AS bigint) AS establishments, 'bls_qcew' AS data_source
FROM qcew_raw
WHERE own_code = '0' AND industry_code = '10' AND agglvl_code = '70'
  AND substr(area_fips, 1, 2) IN ({", ".join(f"'{code}'" for code in STATE_ABBR)})""",
    "state_names": f"SELECT * FROM (VALUES {_STATES}) t(state_code, state)",
    # --- Silver ---
    "demog": """SELECT fips, report_year, cast(population AS int) AS population, median_income,
  median_age, cast(households AS int) AS households FROM acs_b""",
    "pop": _latest("demog", "population", "report_year DESC", "population"),
    "permits_q": """SELECT fips, county_name,
  cast(substr(survey_date, 1, 4) AS int) AS report_year,
  cast(ceil(cast(substr(survey_date, 5, 2) AS int) / 3.0) AS int) AS report_quarter,
  cast(sum(total_units) AS bigint) AS total_units_permitted,
  cast(sum(single_family_units) AS bigint) AS single_family_units,
  cast(sum(multi_family_units) AS bigint) AS multi_family_units
FROM permits_b GROUP BY 1, 2, 3, 4""",
    "inflows": f"""SELECT fips, cast(sum(people) AS bigint) AS people FROM (
  SELECT {_flow("y2")} AS fips, {_PEOPLE} AS people
  FROM flows_raw) WHERE fips IS NOT NULL AND people IS NOT NULL GROUP BY 1""",
    "outflows": f"""SELECT fips, cast(sum(people) AS bigint) AS people FROM (
  SELECT {_flow("y1")} AS fips, {_PEOPLE} AS people
  FROM flows_raw) WHERE fips IS NOT NULL AND people IS NOT NULL GROUP BY 1""",
    "net": """SELECT coalesce(i.fips, o.fips) AS fips, 2000 AS report_year, 4 AS report_quarter,
  coalesce(i.people, 0) AS inflow, coalesce(o.people, 0) AS outflow,
  coalesce(i.people, 0) - coalesce(o.people, 0) AS net_migration, 'irs_soi' AS data_source
FROM inflows i FULL JOIN outflows o ON i.fips = o.fips""",
    "migration": """SELECT net.fips, report_year, report_quarter, inflow, outflow, net_migration,
  net_migration / nullif(population, 0) * 1000 AS net_migration_rate
FROM net LEFT JOIN pop ON pop.fips = net.fips""",
    "vacancy_rates": """SELECT fips, report_year, report_quarter,
  vacant_addresses / nullif(total_addresses, 0) AS vacancy_rate FROM vacancy_b""",
    "vacancy": """SELECT fips, report_year, report_quarter, vacancy_rate,
  vacancy_rate - lag(vacancy_rate) OVER (PARTITION BY fips ORDER BY report_year, report_quarter)
    AS vacancy_rate_yoy_change FROM vacancy_rates""",
    "wages": """SELECT fips, report_year, report_quarter,
  cast(sum(total_employment) AS bigint) AS total_employment,
  cast(sum(total_wages) AS bigint) AS total_wages
FROM wage_rows GROUP BY 1, 2, 3""",
    "employment": """SELECT fips, report_year, report_quarter, total_employment,
  (total_employment - prev) / nullif(prev, 0) AS employment_growth_rate,
  total_wages / nullif(total_employment * 13, 0) AS avg_weekly_wage
FROM (SELECT *, lag(total_employment) OVER (PARTITION BY fips
        ORDER BY report_year, report_quarter) AS prev FROM wages)""",
    "enrollment": """SELECT fips, report_year, total_enrollment,
  (total_enrollment - prev) / nullif(prev, 0) AS enrollment_growth_rate
FROM (SELECT *, lag(total_enrollment) OVER (PARTITION BY fips ORDER BY report_year) AS prev
      FROM (SELECT fips, report_year, cast(sum(total_enrollment) AS bigint) AS total_enrollment
            FROM enrollment_b GROUP BY 1, 2))""",
    "business": """SELECT t.fips, t.report_year, t.total_establishments, q.qsr_establishments,
  t.total_establishments / nullif(population, 0) * 1000 AS retail_density
FROM (SELECT fips, report_year, cast(sum(establishments) AS bigint) AS total_establishments
      FROM business_b GROUP BY 1, 2) t
  LEFT JOIN (SELECT fips, report_year, cast(sum(establishments) AS bigint) AS qsr_establishments
             FROM business_b WHERE naics_code = '7222' GROUP BY 1, 2) q
    ON q.fips = t.fips AND q.report_year = t.report_year
  LEFT JOIN pop ON pop.fips = t.fips""",
    "construction": """SELECT fips, report_year, report_quarter, permitted_units,
  (permitted_units - prev) / nullif(prev, 0) AS construction_growth_rate
FROM (SELECT *, lag(permitted_units) OVER (PARTITION BY fips
        ORDER BY report_year, report_quarter) AS prev
      FROM (SELECT fips, report_year, report_quarter,
              cast(sum(total_units_permitted) AS bigint) AS permitted_units
            FROM permits_q GROUP BY 1, 2, 3))""",
    "projections": """SELECT fips, projection_year, scenario, projected_population,
  (projected_population - base) / nullif(base, 0) AS projected_growth_rate
FROM (SELECT *, first_value(projected_population) OVER (PARTITION BY fips, scenario
        ORDER BY projection_year) AS base FROM ssp_b)""",
    # --- indicators ---
    "permits_latest": _latest(
        "permits_q",
        "county_name, report_year, report_quarter, total_units_permitted, "
        "single_family_units, multi_family_units",
        YQ,
        "county_name, total_units_permitted, single_family_units, multi_family_units",
    ),
    "area_permits": """SELECT fips, report_year, report_quarter, max(county_name) AS county_name,
  cast(sum(total_units_permitted) AS bigint) AS total_units_permitted,
  cast(sum(single_family_units) AS bigint) AS single_family_units,
  cast(sum(multi_family_units) AS bigint) AS multi_family_units
FROM permits_q GROUP BY 1, 2, 3""",
    "area_permits_latest": _latest(
        "area_permits",
        "county_name, report_year, report_quarter, total_units_permitted, "
        "single_family_units, multi_family_units",
        YQ,
        "county_name",
    ),
    "demog_latest": _latest(
        "demog",
        "report_year AS acs_year, population, median_income",
        "report_year DESC",
        "population, median_income",
    ),
    "base": """SELECT coalesce(p.fips, d.fips) AS fips, county_name, report_year, report_quarter,
  total_units_permitted, single_family_units, multi_family_units, acs_year, population,
  median_income
FROM area_permits_latest p FULL JOIN demog_latest d ON p.fips = d.fips""",
    "migration_latest": _latest(
        "migration", "net_migration, net_migration_rate", YQ, "net_migration, net_migration_rate"
    ),
    "vacancy_latest": _latest(
        "vacancy",
        "vacancy_rate, vacancy_rate_yoy_change",
        YQ,
        "vacancy_rate, vacancy_rate_yoy_change",
    ),
    "employment_latest": _latest(
        "employment",
        "total_employment, avg_weekly_wage, employment_growth_rate",
        YQ,
        "total_employment, avg_weekly_wage, employment_growth_rate",
    ),
    "enrollment_latest": _latest(
        "enrollment",
        "total_enrollment, enrollment_growth_rate",
        "report_year DESC",
        "total_enrollment, enrollment_growth_rate",
    ),
    "business_latest": _latest(
        "business",
        "qsr_establishments, retail_density",
        "report_year DESC",
        "qsr_establishments, retail_density",
    ),
    "outlook": """SELECT fips AS state_code, projection_year AS ssp_projection_year,
  coalesce(projected_growth_rate, 0) AS state_growth_rate
FROM (SELECT *, row_number() OVER (PARTITION BY fips ORDER BY projection_year DESC,
        projected_growth_rate NULLS FIRST) AS rn FROM projections WHERE scenario = 'SSP2')
WHERE rn = 1""",
    "joined": """SELECT base.*, net_migration, net_migration_rate, vacancy_rate,
  vacancy_rate_yoy_change, total_employment, avg_weekly_wage, employment_growth_rate,
  total_enrollment, enrollment_growth_rate, qsr_establishments, retail_density,
  ssp_projection_year, state_growth_rate, coalesce(state_names.state, '??') AS state,
  coalesce(total_units_permitted, 0) / nullif(population, 0) * 1000 AS permits_per_1k_pop,
  total_employment / nullif(population, 0) AS employment_per_capita,
  total_enrollment / nullif(population, 0) AS enrollment_per_capita,
  cast(1.0 AS double) - coalesce(vacancy_rate, cast(0 AS double)) AS occupancy_rate
FROM base
  LEFT JOIN migration_latest m ON m.fips = base.fips
  LEFT JOIN vacancy_latest v ON v.fips = base.fips
  LEFT JOIN employment_latest e ON e.fips = base.fips
  LEFT JOIN enrollment_latest s ON s.fips = base.fips
  LEFT JOIN business_latest b ON b.fips = base.fips
  LEFT JOIN outlook ON outlook.state_code = substr(base.fips, 1, 2)
  LEFT JOIN state_names ON state_names.state_code = substr(base.fips, 1, 2)""",
    "blended": """SELECT *, greatest(least(
    cast(0.50 AS double) * coalesce(state_growth_rate, cast(0 AS double))
    + cast(0.25 AS double) * (coalesce(permits_per_1k_pop, cast(0 AS double)) / 100)
    + cast(0.25 AS double) * (coalesce(net_migration_rate, cast(0 AS double)) / 1000),
    cast(0.50 AS double)), cast(-0.30 AS double)) AS ssp_growth_rate,
  cast(coalesce(ssp_projection_year - acs_year, 10) AS double) AS years
FROM joined""",
    "indicators": """SELECT *, cast(trunc(population * power(1 + CASE WHEN years > 0
    THEN power(1 + ssp_growth_rate, 1 / years) - 1 ELSE 0 END, years)) AS bigint)
  AS ssp_projected_pop
FROM blended""",
}


def _normalized(
    table: str, columns: dict[str, str], constant: str, inverted: frozenset = frozenset()
) -> str:
    """Table plus ``norm_*`` columns, with whole-table windows."""
    parts = []
    for name, source in columns.items():
        low, high = f"min({source}) OVER ()", f"max({source}) OVER ()"
        share = f"({source} - {low}) / ({high} - {low})"
        share = f"1 - {share}" if name in inverted else share
        parts.append(
            f"CASE WHEN {source} IS NULL THEN NULL WHEN {high} = {low} "
            f"THEN cast({constant} AS double) ELSE {share} END AS norm_{name}"
        )
    return f"SELECT *, {', '.join(parts)} FROM {table}"


def _sum_of(weights: dict[str, float]) -> str:
    return " + ".join(
        f"coalesce(norm_{n}, cast(0 AS double)) * cast({w} AS double)" for n, w in weights.items()
    )


def _adaptive(weights: dict[str, float]) -> str:
    available = " + ".join(
        f"CASE WHEN norm_{n} IS NOT NULL THEN cast({w} AS double) ELSE cast(0 AS double) END"
        for n, w in weights.items()
    )
    return f"({_sum_of(weights)}) / greatest({available}, cast(0.01 AS double)) * 100"


def _ranked(table: str) -> str:
    order = "ORDER BY round(composite_score, 6) DESC, fips"
    return f"""SELECT *, CASE WHEN percentile <= 10 THEN 'A' WHEN percentile <= 30 THEN 'B'
  WHEN percentile <= 60 THEN 'C' WHEN percentile <= 85 THEN 'D' ELSE 'F' END AS score_tier
FROM (SELECT *, cast(ntile(100) OVER ({order}) AS int) AS percentile,
        row_number() OVER ({order}) AS rank_national FROM {table})"""


_THRESHOLD = """CASE WHEN composite_score BETWEEN 80 AND 100 THEN 'A'
  WHEN composite_score BETWEEN 60 AND 80 THEN 'B'
  WHEN composite_score BETWEEN 40 AND 60 THEN 'C'
  WHEN composite_score BETWEEN 20 AND 40 THEN 'D' ELSE 'F' END"""

SHARED |= {
    "normalized": _normalized("indicators", INDICATOR_COLUMNS, "0.5"),
    "normalized_zero": _normalized("indicators", INDICATOR_COLUMNS, "0.0"),
    "scored": f"SELECT *, {_adaptive(DEFAULT_WEIGHTS)} AS composite_score FROM normalized",
    "ranked": _ranked("scored"),
    "features": """SELECT coalesce(b.GEOID, string_split(b.GEO_ID, 'US')[-1]) AS GEOID,
  b.GEO_ID, b.STATE, b.NAME, r.fips, r.composite_score, r.score_tier, r.rank_national,
  r.population, r.median_income, r.ssp_growth_rate, r.permits_per_1k_pop, r.net_migration_rate,
  r.occupancy_rate, r.employment_per_capita
FROM boundaries_raw b
  LEFT JOIN ranked r ON r.fips = coalesce(b.GEOID, string_split(b.GEO_ID, 'US')[-1])""",
    "feature_bounds": "SELECT "
    + ", ".join(
        f"coalesce({side}(cast({m} AS double)), 0) AS {side}_{m}"
        for m in METRICS
        for side in ("min", "max")
    )
    + " FROM features",
}


def _needed(sql: str, seen: list[str]) -> list[str]:
    """Names of the shared expressions a statement needs, each after its own needs."""
    for name in SHARED:
        if name not in seen and re.search(rf"\b{name}\b", sql):
            _needed(SHARED[name], seen)
            if name not in seen:
                seen.append(name)
    return seen


def _sql(select: str) -> str:
    parts = [f"{name} AS MATERIALIZED ({SHARED[name]})" for name in _needed(select, [])]
    return (f"WITH {', '.join(parts)}\n" if parts else "") + select


def _r(*columns: str, places: int = 6) -> str:
    return ", ".join(f"round({c}, {places}) AS {c}" for c in columns)


_COMP = ", ".join(f"round(norm_{n}, 6) AS component_{n}" for n in INDICATOR_COLUMNS)
_NORM = _r(*[f"norm_{n}" for n in INDICATOR_COLUMNS])
_DETAILS = (
    "fips, county_name, report_year, report_quarter, total_units_permitted, "
    "single_family_units, multi_family_units, acs_year, population, "
    + _r("median_income")
    + ", net_migration, "
    + _r("net_migration_rate", "vacancy_rate")
    + ", total_employment, "
    + _r("avg_weekly_wage")
    + ", total_enrollment, qsr_establishments, "
    + _r("retail_density")
    + ", ssp_projection_year, state, "
    + _r(
        "permits_per_1k_pop",
        "employment_per_capita",
        "enrollment_per_capita",
        "occupancy_rate",
        "ssp_growth_rate",
    )
    + ", ssp_projected_pop"
)
_SCORES = (
    "fips, county_name, state, report_year, report_quarter, population, "
    + _r("median_income", "composite_score")
    + ", score_tier, rank_national, ssp_projected_pop, ssp_projection_year, "
    + _r("ssp_growth_rate")
)
_SUMMARY = "fips, county_name, state, " + _r("composite_score") + (
    ", score_tier, rank_national, population, " + _r("median_income")
)
_FEATURE = "GEOID, GEO_ID, STATE, NAME, fips, " + _r("composite_score") + (
    ", score_tier, rank_national, population, "
) + _r(*[m for m in METRICS if m != "population"])


def _matches() -> str:
    """The multi-criteria filter: a missing metric passes."""
    ranges = " AND ".join(
        f"({m} IS NULL OR {m} BETWEEN {low} AND {high})"
        for m, (low, high) in FILTER_METRICS.items()
    )
    states = ", ".join(f"'{s}'" for s in FILTER_STATES)
    tiers = ", ".join(f"'{t}'" for t in FILTER_TIERS)
    return (
        "GEOID <> '' AND (composite_score IS NULL OR composite_score BETWEEN 0 AND 100) "
        f"AND score_tier IN ({tiers}) AND STATE IN ({states}) AND {ranges}"
    )


def _default_matches() -> str:
    ranges = " AND ".join(
        f"(f.{m} IS NULL OR f.{m} BETWEEN b.min_{m} AND b.max_{m})" for m in METRICS
    )
    return f"f.GEOID <> '' AND {ranges}"


def _log(source: str, rows: str) -> str:
    return (
        f"SELECT '{source}' AS source_name, 'success' AS status, count(*) AS rows_loaded, "
        f"cast(0 AS bigint) AS rows_rejected FROM ({rows})"
    )


_CENSUS_CODE = "state || county AS fips"
_LOADS = {
    "load_permits": """SELECT fips, county_name, survey_date,
  one_unit AS single_family_units, more_units AS multi_family_units,
  one_unit + more_units AS total_units, bldgs AS single_family_bldgs FROM permit_rows""",
    "load_construction": """SELECT fips, county_name, 2001 AS report_year, 4 AS report_quarter,
  one_unit + more_units AS permitted_units, 'census_bps' AS data_source FROM permit_rows""",
    "load_demographics": f"""SELECT {_CENSUS_CODE}, 2000 AS report_year, name AS county_name,
  cast(pop AS bigint) AS population,
  cast(nullif(income, '-') AS bigint) AS median_income,
  round(cast(age AS double), 6) AS median_age, cast(homes AS bigint) AS households,
  'census_acs' AS data_source FROM census_raw""",
    "load_vacancy": f"""SELECT {_CENSUS_CODE}, 2001 AS report_year, 4 AS report_quarter,
  cast(units AS bigint) AS total_addresses, cast(vacant AS bigint) AS vacant_addresses,
  'census_acs' AS data_source FROM census_raw""",
    "load_enrollment": f"""SELECT {_CENSUS_CODE}, 2000 AS report_year,
  cast(enrolled AS bigint) AS total_enrollment, 'census_acs' AS data_source
FROM census_raw WHERE enrolled NOT IN ('', '-')""",
    "load_business": f"""SELECT {_CENSUS_CODE}, 2000 AS report_year, naics AS naics_code,
  cast(CASE WHEN estab IN ('', '-') THEN '0' ELSE estab END AS bigint) AS establishments,
  cast(CASE WHEN emp IN ('', '-') THEN '0' ELSE emp END AS bigint) AS employees,
  'census_cbp' AS data_source FROM census_raw""",
    "load_state_projections": """SELECT lpad(state, 2, '0') AS state_fips,
  cast(YEAR AS int) AS projection_year, cast(POP AS bigint) AS projected_population,
  'census_popproj' AS data_source FROM popproj_raw WHERE SEX = '0'""",
    "load_employment": "SELECT * FROM wage_rows WHERE report_quarter = 1",
}

_RAW_CODES = """SELECT CASE c_mktsegment
    WHEN 'AUTOMOBILE' THEN number
    WHEN 'BUILDING' THEN '  ' || number || ' '
    WHEN 'FURNITURE' THEN c_name
    WHEN 'HOUSEHOLD' THEN '000' || number
    ELSE CASE WHEN length(number) < 5 THEN lpad(number, 5, '0') ELSE number END END AS raw
  FROM (SELECT *, cast(c_custkey * 37 AS varchar) AS number FROM customer)"""

_LABELS = " ".join(f"WHEN '{t}' THEN '{label}'" for t, label in TIER_LABELS.items())
_LONG = " UNION ALL ".join(
    f"SELECT fips, '{n}' AS indicator, cast(coalesce(floor(norm_{n} * 100 + 0.5), 0) AS bigint) "
    f"AS display_value, norm_{n} IS NOT NULL AS has_data, "
    f"CASE score_tier {_LABELS} END AS tier_label FROM ranked"
    for n in INDICATOR_COLUMNS
)
_COVERAGE = " + ".join(
    f"CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END" for c in COVERAGE_COLUMNS.values()
)
_MISSING = ", ".join(
    f"CASE WHEN {c} IS NULL THEN '{name}' END" for name, c in COVERAGE_COLUMNS.items()
)
_SEVEN = f"""SELECT *, ({_sum_of(SEVEN_WEIGHTS)}) * 100 AS composite_score
FROM ({_normalized("indicators", SEVEN_COLUMNS, "0.0", SEVEN_INVERTED)})"""


def _rank_under(weights: dict[str, float]) -> str:
    return f"""SELECT fips, row_number() OVER (ORDER BY round(composite_score, 6) DESC, fips) AS rn
FROM (SELECT fips, {_adaptive(weights)} AS composite_score FROM normalized)"""


_QUERIES: dict[str, str] = {
    **_LOADS,
    "load_migration": "SELECT * FROM net",
    "bronze_vacancy": f"SELECT *, '2001-12-01' AS source_date FROM ({_LOADS['load_vacancy']})",
    "traffic_classes": """SELECT p_partkey, road_class, CASE road_class WHEN 'motorway' THEN 5
  WHEN 'trunk' THEN 4 WHEN 'primary' THEN 3 WHEN 'secondary' THEN 2 WHEN 'residential' THEN 1
  END AS traffic_score
FROM (SELECT p_partkey, ['motorway', 'trunk', 'primary', 'secondary', 'residential', 'track']
        [p_size % 6 + 1] AS road_class FROM part)""",
    "places_of_kind": """SELECT s_suppkey, category
FROM (SELECT s_suppkey, ['restaurant', 'fast_food', 'bank', 'school']
        [s_nationkey % 4 + 1] AS category FROM supplier)
WHERE category IN ('restaurant', 'fast_food')""",
    "boundary_keys": """SELECT coalesce(GEOID, string_split(GEO_ID, 'US')[-1]) AS GEOID, GEO_ID,
  STATE, NAME FROM boundaries_raw""",
    "run_log_summary": " UNION ALL ".join(
        _log(source, _LOADS[key])
        for source, key in {
            "building_permits": "load_permits",
            "hud_construction": "load_construction",
            "acs_demographics": "load_demographics",
            "vacancy": "load_vacancy",
            "school_enrollment": "load_enrollment",
            "business_patterns": "load_business",
            "national_projections": "load_state_projections",
            "employment": "load_employment",
        }.items()
    ),
    "optional_source": """SELECT fips, state, population,
  cast(NULL AS double) AS net_migration_rate,
  round(coalesce(total_units_permitted, 0) / nullif(population, 0) * 1000, 6)
    AS permits_per_1k_pop,
  cast(NULL AS double) AS employment_per_capita,
  cast(NULL AS double) AS enrollment_per_capita,
  round(occupancy_rate, 6) AS occupancy_rate,
  round(greatest(least(cast(0.25 AS double) *
    (coalesce(coalesce(total_units_permitted, 0) / nullif(population, 0) * 1000, 0) / 100),
    cast(0.5 AS double)), cast(-0.3 AS double)), 6) AS ssp_growth_rate,
  cast(NULL AS int) AS ssp_projection_year
FROM joined""",
    # --- functions ---
    "normalize_code": f"""SELECT raw, {_code("raw")} AS code,
  substr({_code("raw")}, 1, 2) AS state_code FROM ({_RAW_CODES})""",
    "validate_code": f"""SELECT raw, coalesce(regexp_full_match(raw, '[0-9]{{5}}')
  AND substr(raw, 1, 2) IN ({", ".join(f"'{c}'" for c in STATE_ABBR)}), false) AS valid
FROM ({_RAW_CODES})""",
    "state_abbr": """SELECT fips, coalesce(state, '??') AS state
FROM areas LEFT JOIN state_names ON state_code = substr(fips, 1, 2)""",
    # --- Silver ---
    "permits_quarterly": "SELECT * FROM permits_q",
    "demographics": f"""SELECT fips, report_year, population, {_r("median_income")},
  {_r("median_age")}, households FROM demog""",
    "migration_rate": f"""SELECT fips, report_year, report_quarter, inflow, outflow,
  net_migration, {_r("net_migration_rate")} FROM migration""",
    "vacancy_change": f"""SELECT fips, report_year, report_quarter,
  {_r("vacancy_rate", "vacancy_rate_yoy_change")} FROM vacancy""",
    "employment_growth": f"""SELECT fips, report_year, report_quarter, total_employment,
  {_r("employment_growth_rate", "avg_weekly_wage")} FROM employment""",
    "enrollment_growth": f"""SELECT fips, report_year, total_enrollment,
  {_r("enrollment_growth_rate")} FROM enrollment""",
    "business_density": f"""SELECT fips, report_year, total_establishments, qsr_establishments,
  {_r("retail_density")} FROM business""",
    "construction_growth": f"""SELECT fips, report_year, report_quarter, permitted_units,
  {_r("construction_growth_rate")} FROM construction""",
    "projection_growth": f"""SELECT fips, projection_year, scenario, projected_population,
  {_r("projected_growth_rate")} FROM projections""",
    "state_projections": """SELECT lpad(state, 2, '0') AS state_fips,
  cast(YEAR AS int) AS projection_year, cast(POP AS bigint) AS projected_population
FROM popproj_raw WHERE SEX = '0'""",
    "flow_totals": "SELECT fips, people FROM inflows",
    "net_migration": "SELECT * FROM net",
    "latest_per_key": "SELECT * FROM permits_latest",
    "latest_projection": f"""SELECT state_code, ssp_projection_year, {_r("state_growth_rate")}
FROM outlook""",
    "dedup_bronze": """SELECT fips, report_year, report_quarter, reading, ingested_at
FROM (SELECT fips, cast(extract(year FROM o_orderdate) AS int) AS report_year,
        cast(extract(quarter FROM o_orderdate) AS int) AS report_quarter,
        o_orderkey AS reading, o_orderdate AS ingested_at,
        row_number() OVER (PARTITION BY fips, extract(year FROM o_orderdate),
          extract(quarter FROM o_orderdate) ORDER BY o_orderdate DESC, o_orderkey) AS rn
      FROM orders JOIN homes ON c_custkey = o_custkey) WHERE rn = 1""",
    # --- indicators ---
    "indicator_base": f"""SELECT fips, county_name, report_year, report_quarter,
  total_units_permitted, single_family_units, multi_family_units, acs_year, population,
  {_r("median_income")} FROM base""",
    "indicator_table": f"SELECT {_DETAILS} FROM indicators",
    "gold_details": f"SELECT {_DETAILS} FROM indicators",
    "state_projection_join": f"""SELECT fips, ssp_projection_year, {_r("state_growth_rate")}
FROM areas LEFT JOIN outlook ON state_code = substr(fips, 1, 2)""",
    "permits_per_1k": """SELECT fips,
  round(coalesce(total_units_permitted, 0) / nullif(population, 0) * 1000, 6)
    AS permits_per_1k_pop,
  round(total_units_permitted / nullif(population, 0) * 1000, 6) AS permits_or_null
FROM base""",
    "per_capita": """SELECT pop.fips,
  round(total_employment / nullif(population, 0), 6) AS employment_per_capita,
  round(total_enrollment / nullif(population, 0), 6) AS enrollment_per_capita
FROM pop LEFT JOIN employment_latest e ON e.fips = pop.fips
  LEFT JOIN enrollment_latest s ON s.fips = pop.fips""",
    "occupancy": """SELECT pop.fips,
  round(1 - coalesce(vacancy_rate, cast(0 AS double)), 6) AS occupancy_rate,
  round(1 - vacancy_rate, 6) AS occupancy_or_null
FROM pop LEFT JOIN vacancy_latest v ON v.fips = pop.fips""",
    "growth_blend": f"SELECT fips, {_r('ssp_growth_rate')} FROM indicators",
    "projected_population": """SELECT fips, population, acs_year, ssp_projection_year,
  ssp_projected_pop FROM indicators""",
    # --- scoring ---
    "indicator_bounds": "SELECT "
    + ", ".join(
        f"round({side}({c}), 6) AS {side}_{n}"
        for n, c in INDICATOR_COLUMNS.items()
        for side in ("min", "max")
    )
    + " FROM indicators",
    "normalize_indicators": f"SELECT fips, {_NORM} FROM normalized",
    "normalize_zero": f"SELECT fips, {_NORM} FROM normalized_zero",
    "composite_score": f"SELECT fips, {_r('composite_score')} FROM scored",
    "plain_composite": f"""SELECT fips,
  round(({_sum_of(DEFAULT_WEIGHTS)}) * 100, 6) AS composite_score FROM normalized_zero""",
    "threshold_tiers": f"""SELECT fips, {_THRESHOLD} AS score_tier
FROM (SELECT fips, ({_sum_of(DEFAULT_WEIGHTS)}) * 100 AS composite_score FROM normalized_zero)""",
    "score_tiers": "SELECT fips, percentile, score_tier FROM ranked",
    "national_rank": "SELECT fips, rank_national FROM ranked",
    "gold_score": f"SELECT {_SCORES}, {_COMP} FROM ranked",
    "export_scores": f"""SELECT {_SCORES}, {_COMP},
  {" + ".join(f"CASE WHEN norm_{n} IS NULL THEN 0 ELSE 1 END" for n in INDICATOR_COLUMNS)}
    AS json_keys FROM ranked""",
    "component_long": _LONG,
    "custom_weights": f"""SELECT fips, round(composite_score, 6) AS composite_score, score_tier,
  rank_national FROM ({_ranked(f"(SELECT *, {_adaptive(CUSTOM_WEIGHTS)} AS composite_score "
                               "FROM normalized)")})""",
    "update_weights": f"""SELECT fips, round({_adaptive(UPDATED_WEIGHTS)}, 6) AS composite_score,
  round(cast({sum(UPDATED_WEIGHTS.values())} AS double), 6) AS weight_total,
  {str(abs(sum(UPDATED_WEIGHTS.values()) - 1) < 0.01).lower()} AS weights_valid
FROM normalized""",
    # --- serving ---
    "list_areas": f"SELECT rank_national AS position, {_SUMMARY} FROM ranked",
    "top_areas": f"""SELECT {_SUMMARY} FROM ranked
ORDER BY ranked.composite_score DESC, fips LIMIT 25""",
    "area_detail": f"""SELECT {_DETAILS}, {_r("composite_score")}, score_tier, rank_national,
  {_COMP} FROM ranked""",
    "map_attributes": f"SELECT {_FEATURE} FROM features",
    "filter_bounds": "SELECT "
    + _r(*[f"{side}_{m}" for m in METRICS for side in ("min", "max")])
    + " FROM feature_bounds",
    "filter_areas": f"SELECT {_FEATURE} FROM features WHERE {_matches()}",
    "filter_defaults": f"""SELECT f.GEOID, f.NAME FROM features f CROSS JOIN feature_bounds b
WHERE {_default_matches()}""",
    "match_count": f"""SELECT count(*) FILTER (WHERE {_matches()}) AS matching,
  count(*) AS total FROM features""",
    "highlight_areas": f"""SELECT GEOID, STATE, score_tier,
  coalesce(STATE = '{HIGHLIGHT["state"]}', false)
    AND coalesce(score_tier, 'F') = '{HIGHLIGHT["tier"]}'
    AND coalesce(composite_score, 0) >= {HIGHLIGHT["min_score"]} AS highlighted
FROM features""",
    "sorted_results": f"""SELECT row_number() OVER (ORDER BY coalesce(population, 0) DESC, GEOID)
  AS position, GEOID, NAME, STATE, population FROM features WHERE {_matches()}""",
    "state_list": """SELECT state_code, state, cast(row_number() OVER (ORDER BY state) AS int)
  AS position
FROM (SELECT DISTINCT n.state_code, n.state
      FROM features f JOIN state_names n ON n.state_code = f.STATE)""",
    "area_trends": f"""SELECT * FROM (
  SELECT fips, report_year, report_quarter,
    round(units / nullif(population, 0) * 1000, 6) AS permits_per_1k_pop
  FROM (SELECT fips, report_year, report_quarter, sum(total_units_permitted) AS units
        FROM permits_q GROUP BY 1, 2, 3) LEFT JOIN pop USING (fips)) p
FULL JOIN (SELECT fips, report_year, report_quarter, {_r("net_migration_rate")}
           FROM migration) m USING (fips, report_year, report_quarter)
FULL JOIN (SELECT fips, report_year, report_quarter, {_r("vacancy_rate_yoy_change")}
           FROM vacancy) v USING (fips, report_year, report_quarter)
FULL JOIN (SELECT fips, report_year, report_quarter, {_r("employment_growth_rate")}
           FROM employment) e USING (fips, report_year, report_quarter)""",
    # --- design documents ---
    "crosswalk_rollup": """SELECT fips, round(sum(v * ratio), 6) AS spending
FROM crosswalk_b JOIN (SELECT cast(o_custkey AS varchar) AS zip,
    cast(sum(cast(floor(o_totalprice) AS bigint)) AS bigint) AS v FROM orders GROUP BY 1)
  USING (zip) GROUP BY 1""",
    "data_coverage": f"""SELECT fips, {_COVERAGE} AS sources_present,
  concat_ws(',', {_MISSING}) AS missing_sources,
  CASE WHEN {_COVERAGE} >= 5 THEN 'Scored' ELSE 'Insufficient Data' END AS data_coverage
FROM indicators""",
    "quality_checks": """SELECT count(*) AS rows_checked,
  count(*) FILTER (WHERE fips IS NULL) AS null_keys,
  count(*) FILTER (WHERE composite_score IS NULL OR composite_score NOT BETWEEN 0 AND 100)
    AS scores_out_of_range,
  (SELECT count(DISTINCT b) FROM (SELECT coalesce(GEOID, string_split(GEO_ID, 'US')[-1]) AS b
     FROM boundaries_raw) WHERE b NOT IN (SELECT fips FROM ranked)) AS missing_areas
FROM ranked""",
    "permit_trend": """SELECT t.fips, t.report_year, t.report_quarter,
  t.units AS total_units_permitted,
  round(t.single / nullif(t.units, 0), 6) AS single_family_share,
  round(t.multi / nullif(t.units, 0), 6) AS multi_family_share,
  round((t.units - y.units) / nullif(y.units, 0), 6) AS yoy_change
FROM trend t LEFT JOIN trend y ON y.fips = t.fips AND y.report_year = t.report_year - 1
  AND y.report_quarter = t.report_quarter""",
    "rank_shift": f"""SELECT a.fips, a.rn AS rank_before, b.rn AS rank_after,
  a.rn - b.rn AS rank_shift
FROM ({_rank_under(DEFAULT_WEIGHTS)}) a JOIN ({_rank_under(CUSTOM_WEIGHTS)}) b USING (fips)""",
    "seven_indicator_score": f"""SELECT fips, round(composite_score, 6) AS composite_score,
  {_THRESHOLD} AS score_tier FROM ({_SEVEN})""",
    "state_compounding": """SELECT state_fips, y AS projection_year, base AS base_population,
  round(base * power(1 + rate, y - 2000), 2) AS projected_population
FROM (SELECT substr(fips, 1, 2) AS state_fips,
        cast(sum(population) FILTER (WHERE report_year = 2000) AS bigint) AS base,
        (sum(population) FILTER (WHERE report_year = 2000)
          - sum(population) FILTER (WHERE report_year = 1999))
          / nullif(sum(population) FILTER (WHERE report_year = 1999), 0) AS rate
      FROM demog GROUP BY 1)
  CROSS JOIN (SELECT unnest([2005, 2010, 2015]) AS y)""",
    "feeder_areas": f"""SELECT fips, origin, people, feeder_rank
FROM (SELECT *, cast(row_number() OVER (PARTITION BY fips ORDER BY people DESC, origin) AS int)
        AS feeder_rank
      FROM (SELECT {_flow("y2")} AS fips, {_flow("y1")} AS origin,
              cast(sum({_PEOPLE}) AS bigint) AS people
            FROM flows_raw WHERE {_PEOPLE} IS NOT NULL
              AND ({_flow("y2")}) IS NOT NULL AND ({_flow("y1")}) IS NOT NULL
            GROUP BY 1, 2)) WHERE feeder_rank <= 3""",
    "scenario_range": """SELECT fips, projection_year, min(projected_population) AS min_population,
  max(projected_population) AS max_population, count(*) AS scenarios
FROM ssp_b GROUP BY 1, 2""",
}

SHARED["trend"] = """SELECT fips, report_year, report_quarter,
  cast(sum(total_units_permitted) AS bigint) AS units,
  cast(sum(single_family_units) AS bigint) AS single,
  cast(sum(multi_family_units) AS bigint) AS multi
FROM permits_q GROUP BY 1, 2, 3"""


def oracle_sql() -> dict[str, str]:
    return {name: _sql(select) for name, select in _QUERIES.items()}

"""Loaders for staged files.

Every source has a ``read_*`` (files to string columns) and a ``parse_*`` (string
columns to typed rows). Parsing is column expressions only, so it runs inside the
scan's own tasks. A parsed row carries ``reject_reason``: null when the row is
good, else why it cannot be loaded. Rows a source skips on purpose (headers,
summary rows, other quarters) are filtered out and are not rejects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from groundswell.functions.keys import area_code, is_valid_area
from groundswell.functions.values import (
    blank_as_zero,
    is_null_token,
    known,
    strip,
    to_long,
    unquote,
    zfill,
)
from groundswell.sources.records import split_records

Paths = str | list[str]
REJECT = "reject_reason"

PERMIT_FIELDS = 17
_RECORDS = "array<array<string>>"
BAD_PAYLOAD = "bad payload"
# A decimal number as files write it; a cast alone also takes 5d, 7f and 0x1p3.
_DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

# Codes of the county total over all owners and industries.
OWNERSHIP_ALL, INDUSTRY_ALL, LEVEL_COUNTY = "0", "10", "70"


def accepted(parsed: DataFrame) -> DataFrame:
    """Good rows of a parsed source."""
    return parsed.filter(F.col(REJECT).isNull()).drop(REJECT)


def rejected(parsed: DataFrame) -> DataFrame:
    """Rows that could not be loaded, with the reason."""
    return parsed.filter(F.col(REJECT).isNotNull())


def to_decimal(text: Column) -> Column:
    """Decimal number, or null when the text is not one."""
    return F.when(text.rlike(_DECIMAL), text).try_cast("double")


def _reject(required: list[str], extra: Column | None = None) -> Column:
    """First failed check: a missing required column, then the extra condition."""
    reason = F.lit(None).cast("string")
    if extra is not None:
        reason = F.when(extra, F.lit("bad optional value"))
    for name in reversed(required):
        reason = F.when(F.col(name).isNull(), F.lit(f"bad {name}")).otherwise(reason)
    return reason.alias(REJECT)


# --- permits files -----------------------------------------------------------------


def read_permits(spark: SparkSession, path: Paths) -> DataFrame:
    """Lines of permits files as string fields ``c0`` … ``c16``."""
    return split_permits(spark.read.text(path))


def split_permits(lines: DataFrame) -> DataFrame:
    """Text lines (column ``value``) as string fields ``c0`` … ``c16``.

    The CSV parser of Spark splits the line, in one pass. It gives null both for a blank
    field (counts as 0) and for an absent one (the row is too short), so the commas
    outside quotes are counted and a blank field that is there becomes an empty text.
    """
    names = [f"c{i}" for i in range(PERMIT_FIELDS)]
    schema = ", ".join(f"{n} string" for n in names)
    # With an escape equal to the quote a doubled quote inside quotes is one quote.
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    unquoted = F.regexp_replace("value", '"[^"]*"', "")
    commas = F.length(unquoted) - F.length(F.replace(unquoted, F.lit(","), F.lit("")))
    parsed = lines.select(F.from_csv("value", schema, options).alias("f"), commas.alias("commas"))
    return parsed.select(
        *[
            F.when(F.col("commas") >= i, F.coalesce(f"f.{n}", F.lit(""))).alias(n)
            for i, n in enumerate(names)
        ]
    )


def _permit_rows(fields: DataFrame) -> DataFrame:
    """Data rows: a first field, and no missing field.

    Drops blank lines, lines that are too short, and the two header lines. A file that many
    tasks read has no line numbers, so a header is known by its fields: where data has five
    codes (date, state, county, region, division) it has no digit at all.
    """
    last = f"c{PERMIT_FIELDS - 1}"
    header = ~F.concat_ws("", *[f"c{i}" for i in range(5)]).rlike("[0-9]")
    return fields.filter((strip(F.col("c0")) != "") & F.col(last).isNotNull() & ~header)


def _survey_month() -> Column:
    """The ``yyyyMM`` of a data row, null when it is malformed."""
    date = strip(F.col("c0"))
    return F.when(date.rlike("^[0-9]{4}(0[1-9]|1[0-2])$"), date)


def _permit_code() -> Column:
    return area_code(F.concat(strip(F.col("c1")), zfill(strip(F.col("c2")), 3)))


def _units(*positions: int) -> Column:
    total = blank_as_zero(F.col(f"c{positions[0]}"))
    for position in positions[1:]:
        total = F.try_add(total, blank_as_zero(F.col(f"c{position}")))
    return total


def parse_permits(fields: DataFrame) -> DataFrame:
    """Monthly permits: single, multi and total units per area and month."""
    rows = _permit_rows(fields).select(
        _permit_code().alias("fips"),
        strip(F.col("c5")).alias("county_name"),
        _survey_month().alias("survey_date"),
        _units(7).alias("single_family_units"),
        _units(10, 13, 16).alias("multi_family_units"),
        _units(7, 10, 13, 16).alias("total_units"),
        _units(6).alias("single_family_bldgs"),
    )
    return rows.select("*", _reject(["survey_date", "fips", "total_units", "single_family_bldgs"]))


def parse_construction(fields: DataFrame, year: int, quarter: int) -> DataFrame:
    """Annual permits in the same layout; the caller names the period."""
    rows = _permit_rows(fields).select(
        _permit_code().alias("fips"),
        strip(F.col("c5")).alias("county_name"),
        F.lit(year).alias("report_year"),
        F.lit(quarter).alias("report_quarter"),
        _units(7, 10, 13, 16).alias("permitted_units"),
        F.lit("census_bps").alias("data_source"),
        _survey_month().alias("survey_date"),
    )
    checked = rows.select("*", _reject(["survey_date", "fips", "permitted_units"]))
    return checked.drop("survey_date")


# --- census tables (JSON array of arrays, first row is the header) -------------------


def read_census(spark: SparkSession, path: Paths, layout: str = "whole") -> DataFrame:
    """Staged payloads as rows ``value``: JSON arrays whose first row is the header.

    ``layout`` says how the files were written. With ``whole`` a file is one payload,
    in any formatting, read in one task. With ``lines`` each record has a line of its
    own, as the service writes them, the first line opening with the header; such a
    file splits over many tasks and its header is put in front of each record again.
    A line that cannot be read stays as it is and is rejected by ``census_rows``. With
    ``records`` a file may have any formatting and splits over many tasks all the same; of
    a file that breaks off, the whole records count and its rest is a reject.
    """
    if layout == "whole":
        return spark.read.text(path, wholetext=True)
    if layout == "records":
        return _headed_records(split_records(spark, path, "]", braces=0, brackets=1))
    if layout != "lines":
        raise ValueError("layout is whole, lines or records")
    line = strip(F.col("value"))
    inner = F.regexp_replace(line, r"^\[\s*(?=\[)", "")
    inner = F.regexp_replace(inner, r"((?<=\])\s*\]|,)$", "")
    lines = (
        spark.read.text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            line.alias("line"),
            line.rlike(r"^\[\s*\[").alias("opens"),
            F.from_json(F.concat(F.lit("["), inner, F.lit("]")), _RECORDS).alias("rows"),
        )
        .filter(~F.col("line").isin("", "[", "]"))
    )
    headers = lines.filter("opens").groupBy("file").agg(
        F.min(F.get("rows", F.lit(0))).alias("header")
    )
    records = F.when(F.col("opens"), _after_first("rows")).otherwise(F.col("rows"))
    whole = F.to_json(F.concat(F.array("header"), records))
    return (
        lines.join(headers, "file", "left")
        .filter(records.isNull() | (F.size(records) > 0))
        .select(F.coalesce(whole, "line").alias("value"))
    )


def _headed_records(records: DataFrame) -> DataFrame:
    """A payload of the file's header and one record for each record of the file."""
    opening = F.regexp_extract("text", r"(?s)^\s*\[\s*(\[.*\])$", 1)
    headers = records.filter("opens AND complete").select("file", opening.alias("header"))
    record = F.regexp_extract("text", r"(?s)^\s*,\s*(\[.*\])$", 1)
    payload = F.concat(F.lit("["), "header", F.lit(","), record, F.lit("]"))
    sound = F.col("complete") & (record != "") & (F.col("header") != "")
    return (
        records.filter("NOT opens OR NOT complete")
        .join(headers, "file", "left")
        # what is no record stays as it is, and is no payload
        .select(F.when(sound, payload).otherwise(F.concat(F.lit("!"), "text")).alias("value"))
    )


def _after_first(rows: str) -> Column:
    return F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0)))


def census_rows(payloads: DataFrame, *names: str) -> DataFrame:
    """Records of JSON payloads with the named header columns as strings.

    Header positions are found once per payload, so exploded records carry a few
    integers and not the header; a column the payload lacks comes out null. A payload
    that is no array of records under a header with one of the names gives one row,
    with ``readable`` false.
    """
    tables = payloads.select(F.from_json("value", _RECORDS).alias("rows"))
    header = F.get("rows", F.lit(0))
    readable = F.coalesce(F.arrays_overlap(header, F.array(*map(F.lit, names))), F.lit(False))
    no_record = F.array(F.array().cast("array<string>"))
    located = tables.select(
        *[(F.array_position(header, n).cast("int") - 1).alias(f"at_{n}") for n in names],
        readable.alias("readable"),
        F.explode(F.when(readable, _after_first("rows")).otherwise(no_record)).alias("r"),
    )
    return located.select(
        *[F.when(F.col(f"at_{n}") >= 0, F.get("r", F.col(f"at_{n}"))).alias(n) for n in names],
        "readable",
    )


def _checked(rows: DataFrame, required: list[str], extra: Column | None = None) -> DataFrame:
    """Rows of a payload with their reject reason; an unreadable payload is one reject."""
    reason = F.when(~F.col("readable"), F.lit(BAD_PAYLOAD)).otherwise(_reject(required, extra))
    return rows.select("*", reason.alias(REJECT)).drop("readable")


def _census_code() -> Column:
    return area_code(F.concat("state", "county"))


def _bad_long(name: str) -> Column:
    """Neither a null token nor a whole number."""
    return ~is_null_token(F.col(name)) & to_long(F.col(name)).isNull()


def parse_demographics(payloads: DataFrame, year: int) -> DataFrame:
    """Population is required; income, age and households may be unknown."""
    pop, income, age, homes = "B01003_001E", "B19013_001E", "B01002_001E", "B11001_001E"
    raw = census_rows(payloads, pop, income, age, homes, "NAME", "state", "county")
    age_value = to_decimal(strip(known(F.col(age))))
    bad = (
        _bad_long(income)
        | _bad_long(homes)
        | (~is_null_token(F.col(age)) & age_value.isNull())
    )
    rows = raw.select(
        _census_code().alias("fips"),
        F.lit(year).alias("report_year"),
        F.coalesce("NAME", F.lit("")).alias("county_name"),
        to_long(F.col(pop)).alias("population"),
        to_long(known(F.col(income))).alias("median_income"),
        age_value.alias("median_age"),
        to_long(known(F.col(homes))).alias("households"),
        F.lit("census_acs").alias("data_source"),
        "readable",
        bad.alias("_bad"),
    )
    return _checked(rows, ["fips", "population"], F.col("_bad")).drop("_bad")


def parse_vacancy(payloads: DataFrame, year: int, quarter: int) -> DataFrame:
    """Total and vacant units. Stage the payload of ``year - 1``; rows say ``year``."""
    total, vacant = "B25002_001E", "B25002_003E"
    raw = census_rows(payloads, total, vacant, "state", "county")
    rows = raw.select(
        area_code(F.concat(zfill(F.col("state"), 2), zfill(F.col("county"), 3))).alias("fips"),
        F.lit(year).alias("report_year"),
        F.lit(quarter).alias("report_quarter"),
        to_long(F.col(total)).alias("total_addresses"),
        to_long(F.col(vacant)).alias("vacant_addresses"),
        F.lit("census_acs").alias("data_source"),
        "readable",
    )
    return _checked(rows, ["fips", "total_addresses", "vacant_addresses"])


def parse_enrollment(payloads: DataFrame, year: int) -> DataFrame:
    """Enrollment per area; rows with a null token are skipped."""
    enrolled = "B14001_002E"
    raw = census_rows(payloads, enrolled, "state", "county")
    rows = raw.filter(~F.col("readable") | ~is_null_token(F.col(enrolled))).select(
        _census_code().alias("fips"),
        F.lit(year).alias("report_year"),
        to_long(F.col(enrolled)).alias("total_enrollment"),
        F.lit("census_acs").alias("data_source"),
        "readable",
    )
    return _checked(rows, ["fips", "total_enrollment"])


def parse_business(payloads: DataFrame, year: int) -> DataFrame:
    """Establishments and employees per industry; null tokens count as 0."""
    raw = census_rows(payloads, "ESTAB", "EMP", "NAICS2017", "state", "county")

    def count(name: str) -> Column:
        return F.when(is_null_token(F.col(name)), F.lit(0).cast("bigint")).otherwise(
            to_long(F.col(name))
        )

    rows = raw.select(
        _census_code().alias("fips"),
        F.lit(year).alias("report_year"),
        F.coalesce("NAICS2017", F.lit("")).alias("naics_code"),
        count("ESTAB").alias("establishments"),
        count("EMP").alias("employees"),
        F.lit("census_cbp").alias("data_source"),
        "readable",
    )
    return _checked(rows, ["fips", "establishments", "employees"])


def state_projection_rows(payloads: DataFrame) -> DataFrame:
    """String rows of a state projections payload."""
    return census_rows(payloads, "POP", "YEAR", "SEX", "state")


def parse_state_projections(rows: DataFrame) -> DataFrame:
    """Both sexes together (an absent ``SEX`` counts as total); blank states skipped."""
    if "readable" not in rows.columns:
        rows = rows.withColumn("readable", F.lit(True))
    total = (F.coalesce("SEX", F.lit("0")) == "0") & (F.coalesce("state", F.lit("")) != "")
    kept = rows.filter(~F.col("readable") | total).select(
        zfill(F.col("state"), 2).alias("state_fips"),
        to_long(F.col("YEAR")).try_cast("int").alias("projection_year"),
        to_long(F.col("POP")).alias("projected_population"),
        F.lit("census_popproj").alias("data_source"),
        "readable",
    )
    return _checked(kept, ["projection_year", "projected_population"])


# --- quarterly wages file -----------------------------------------------------------


def read_wages(spark: SparkSession, path: Paths) -> DataFrame:
    """Wages file with its own header, all strings; unused columns are pruned."""
    return spark.read.csv(path, header=True, quote='"')


def parse_employment(rows: DataFrame, quarter: int | None = None) -> DataFrame:
    """County totals of one quarter (every quarter when none is named)."""

    def text(name: str) -> Column:
        return unquote(F.col(name))

    total = (
        (text("own_code") == OWNERSHIP_ALL)
        & (text("industry_code") == INDUSTRY_ALL)
        & (text("agglvl_code") == LEVEL_COUNTY)
        & text("area_fips").rlike("^[0-9]+$")
    )
    if quarter is not None:
        total = total & (text("qtr") == str(quarter))
    months = [blank_as_zero(text(f"month{i}_emplvl")) for i in (1, 2, 3)]
    fields = F.struct(
        area_code(text("area_fips")).alias("fips"),
        to_long(text("year")).try_cast("int").alias("report_year"),
        to_long(text("qtr")).try_cast("int").alias("report_quarter"),
        F.round(F.try_add(F.try_add(months[0], months[1]), months[2]) / 3)
        .cast("bigint")
        .alias("total_employment"),
        blank_as_zero(text("total_qtrly_wages")).alias("total_wages"),
        blank_as_zero(text("qtrly_estabs")).alias("establishments"),
    )
    # Generated fields: a filter on them stays above the parsing instead of repeating it.
    kept = rows.filter(total).select(F.inline(F.array(fields)), F.lit("bls_qcew").alias("data_source"))
    # An over-long code is a reject; a well-formed code of no known state is skipped.
    in_state = kept.filter(F.col("fips").isNull() | is_valid_area(F.col("fips")))
    return in_state.select(
        "*",
        _reject(
            ["fips", "report_year", "report_quarter", "total_employment", "total_wages",
             "establishments"]
        ),
    )


# --- flows and boundaries ------------------------------------------------------------


def read_flows(spark: SparkSession, path: Paths) -> DataFrame:
    """Origin-destination file: header lowercased and stripped, values stripped."""
    raw = spark.read.csv(path, header=True)
    return raw.select(
        *[strip(F.col(f"`{name}`")).alias(name.strip().lower()) for name in raw.columns]
    )


_FEATURE = (
    "type string, properties struct<GEOID: string, GEO_ID: string, STATE: string, NAME: string>, "
    "geometry string"
)


def read_boundaries(spark: SparkSession, path: str) -> DataFrame:
    """Feature attributes of GeoJSON files; the geometry stays one opaque text.

    A file's features are read by many tasks. Of a file that breaks off, the whole features
    count.
    """
    return accepted(parse_boundaries(read_features(spark, path)))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """The text (``value``) of each feature of the collections at ``path``."""
    records = split_records(spark, path, "}", braces=1, brackets=1)
    prefix = F.when(F.col("opens"), r'(?s)^.*?"features"\s*:\s*\[\s*').otherwise(r"^[\s,]*")
    return records.select(F.regexp_replace(F.col("text"), prefix, F.lit("")).alias("value"))


def parse_boundaries(features: DataFrame) -> DataFrame:
    """Attributes of features; a text that is no feature is a reject."""
    read = features.select(F.from_json("value", _FEATURE).alias("f"))
    is_feature = F.coalesce(F.col("f.type"), F.lit("Feature")) == "Feature"
    found = is_feature & (F.col("f.properties").isNotNull() | F.col("f.geometry").isNotNull())
    bad = ~F.coalesce(found, F.lit(False))
    return read.select(
        "f.properties.*",
        F.col("f.geometry").alias("geometry"),
        F.when(bad, F.lit("bad feature")).alias(REJECT),
    )


def boundary_keys(boundaries: DataFrame) -> DataFrame:
    """Fill an absent ``GEOID`` with the text after the last ``US`` of ``GEO_ID``."""
    return boundaries.withColumn(
        "GEOID", F.coalesce("GEOID", F.substring_index("GEO_ID", "US", -1))
    )


def flow_counts(n: Column) -> Column:
    """Number of people in a flow: decimal text cut to a whole number, absent is 0."""
    return to_decimal(F.coalesce(n, F.lit("0"))).try_cast("bigint")

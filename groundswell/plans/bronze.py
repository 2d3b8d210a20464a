"""Bronze jobs: one staged source to its Bronze table, with a run log entry.

``layout`` says how census payloads were written (``files.read_census``); ``lines`` and
``records`` let many tasks read one payload.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from groundswell.operators.transforms import net_migration
from groundswell.sources import files
from groundswell.sources.run_log import load_bronze
from groundswell.sources.tables import quarter_stamp, stamped

Stamp = Callable[[DataFrame], DataFrame]


def _by_quarter(year: int, quarter: int) -> Stamp:
    return lambda df: stamped(df, source_date=quarter_stamp(year, quarter))


def _by_year(year: int) -> Stamp:
    return lambda df: stamped(df, source_year=year)


def load_building_permits(
    spark: SparkSession, path: str, year: int, month: int, catalog: str | None = None
) -> None:
    day = dt.date(year, month, 1)
    load_bronze(
        spark,
        "building_permits",
        lambda: files.parse_permits(files.read_permits(spark, path)),
        lambda df: stamped(df, source_date=day),
        catalog,
    )


def load_hud_construction(
    spark: SparkSession, path: str, year: int, quarter: int, catalog: str | None = None
) -> None:
    load_bronze(
        spark,
        "hud_construction",
        lambda: files.parse_construction(files.read_permits(spark, path), year, quarter),
        _by_quarter(year, quarter),
        catalog,
    )


def load_acs_demographics(
    spark: SparkSession,
    path: str,
    year: int,
    catalog: str | None = None,
    layout: str = "whole",
) -> None:
    load_bronze(
        spark,
        "acs_demographics",
        lambda: files.parse_demographics(files.read_census(spark, path, layout), year),
        _by_year(year),
        catalog,
    )


def load_vacancy(
    spark: SparkSession,
    path: str,
    year: int,
    quarter: int,
    catalog: str | None = None,
    layout: str = "whole",
) -> None:
    load_bronze(
        spark,
        "vacancy",
        lambda: files.parse_vacancy(files.read_census(spark, path, layout), year, quarter),
        _by_quarter(year, quarter),
        catalog,
    )


def load_school_enrollment(
    spark: SparkSession,
    path: str,
    year: int,
    catalog: str | None = None,
    layout: str = "whole",
) -> None:
    day = dt.date(year, 1, 1)
    load_bronze(
        spark,
        "school_enrollment",
        lambda: files.parse_enrollment(files.read_census(spark, path, layout), year),
        lambda df: stamped(df, source_date=day),
        catalog,
    )


def load_business_patterns(
    spark: SparkSession,
    path: str,
    year: int,
    catalog: str | None = None,
    layout: str = "whole",
) -> None:
    load_bronze(
        spark,
        "business_patterns",
        lambda: files.parse_business(files.read_census(spark, path, layout), year),
        _by_year(year),
        catalog,
    )


def load_national_projections(
    spark: SparkSession, path: str, catalog: str | None = None, layout: str = "whole"
) -> None:
    load_bronze(
        spark,
        "national_projections",
        lambda: files.parse_state_projections(
            files.state_projection_rows(files.read_census(spark, path, layout))
        ),
        stamped,
        catalog,
    )


def load_employment(
    spark: SparkSession, path: str, year: int, quarter: int, catalog: str | None = None
) -> None:
    load_bronze(
        spark,
        "employment",
        lambda: files.parse_employment(files.read_wages(spark, path), quarter),
        _by_quarter(year, quarter),
        catalog,
    )


def load_migration(
    spark: SparkSession,
    inflow_path: str,
    outflow_path: str,
    year: int,
    quarter: int,
    catalog: str | None = None,
) -> None:
    def parse() -> DataFrame:
        net = net_migration(
            files.read_flows(spark, inflow_path),
            files.read_flows(spark, outflow_path),
            year,
            quarter,
        )
        return net.withColumn(files.REJECT, F.lit(None).cast("string"))

    load_bronze(spark, "migration", parse, _by_quarter(year, quarter), catalog)

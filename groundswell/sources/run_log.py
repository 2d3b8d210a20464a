"""Bronze loads with a run log."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from groundswell.config import BRONZE, LOG_TABLE, table_name
from groundswell.schemas import BRONZE_SCHEMAS, LOG_SCHEMA
from groundswell.sources.files import REJECT, accepted
from groundswell.sources.tables import append, conform

MAX_ERROR = 500


def load_counts() -> list:
    """Aggregates of a load: rows that go in, and rows turned away."""
    good = F.col(REJECT).isNull()
    return [
        F.count_if(good).alias("rows_loaded"),
        F.count_if(~good).alias("rows_rejected"),
    ]


def log_run(
    spark: SparkSession,
    source: str,
    status: str,
    started_at: dt.datetime,
    rows_loaded: int | None = None,
    rows_rejected: int | None = None,
    error: str | None = None,
    catalog: str | None = None,
) -> None:
    """Append one row to the run log."""
    row = (
        source,
        status,
        rows_loaded,
        rows_rejected,
        error[:MAX_ERROR] if error is not None else None,
        started_at,
        dt.datetime.now(dt.timezone.utc),
    )
    name = table_name(BRONZE, LOG_TABLE, catalog)
    append(spark.createDataFrame([row], LOG_SCHEMA).coalesce(1), name)


def load_bronze(
    spark: SparkSession,
    source: str,
    parse: Callable[[], DataFrame],
    stamp: Callable[[DataFrame], DataFrame],
    catalog: str | None = None,
) -> None:
    """Append the accepted rows of ``parse()`` to ``bronze.<source>`` and log the run.

    Counts come from the write itself (``observe``), not from a second pass. An empty
    load is a success with 0 rows; a failed one is logged and raised again.
    """
    started = dt.datetime.now(dt.timezone.utc)
    try:
        counts = Observation(f"load_{source}")
        rows = accepted(parse().observe(counts, *load_counts()))
        target = conform(stamp(rows), BRONZE_SCHEMAS[source])
        append(target, table_name(BRONZE, source, catalog))
        found = counts.get
    except Exception as error:
        log_run(spark, source, "failure", started, error=str(error), catalog=catalog)
        raise
    log_run(
        spark,
        source,
        "success",
        started,
        rows_loaded=found["rows_loaded"],
        rows_rejected=found["rows_rejected"],
        catalog=catalog,
    )

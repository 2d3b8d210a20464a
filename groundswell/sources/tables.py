"""Table reads and writes.

Tables are Parquet through the session catalog; pass ``fmt`` for another format.

A table that is overwritten is a name for one of its versions. Each overwrite writes a
version of its own (``<name>__v<time>``, a managed table) and then points the name at the
version's folder, in one catalog change. A job that dies on the way leaves the old version in
place, whole; readers that have begun keep it until the next overwrite but one.
"""

from __future__ import annotations

import datetime as dt
import logging
import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from groundswell.functions.keys import period_date

logger = logging.getLogger(__name__)
FORMAT = "parquet"


#: Formats whose own overwrite is one transaction.
TRANSACTIONAL = ("delta", "iceberg")
#: Versions before the current one that stay, for readers that began before an overwrite.
KEPT_VERSIONS = 1
_VERSION, _NEXT = "__v", "__next"


def table_exists(spark: SparkSession, name: str) -> bool:
    """Whether the table is there, after an interrupted change of its columns is finished."""
    _finish(spark, name)
    return spark.catalog.tableExists(name)


def read_required(spark: SparkSession, name: str) -> DataFrame:
    _finish(spark, name)
    return spark.table(name)


def read_optional(spark: SparkSession, name: str, schema: StructType) -> DataFrame:
    """The table, or an empty frame of ``schema`` when it does not exist.

    With an empty frame in place of a missing source the later plan keeps its shape;
    errors other than a missing table still surface.
    """
    if table_exists(spark, name):
        return spark.table(name)
    logger.warning("table %s does not exist; going on without it", name)
    return spark.createDataFrame([], schema)


def stamped(
    df: DataFrame, source_date: dt.date | Column | None = None, source_year: int | None = None
) -> DataFrame:
    """Add the load stamp: where the rows come from and when they were taken in."""
    if source_date is not None:
        date = source_date if isinstance(source_date, Column) else F.lit(source_date)
        df = df.withColumn("source_date", date.cast("date"))
    if source_year is not None:
        df = df.withColumn("source_year", F.lit(source_year))
    return df.withColumn("ingested_at", F.current_timestamp())


def quarter_stamp(year: int, quarter: int) -> Column:
    return period_date(F.lit(year), F.lit(quarter))


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """The schema's columns in its order and types; an absent column becomes null."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )


def append(df: DataFrame, name: str, fmt: str = FORMAT) -> None:
    """Append, one folder per report year or source date so later reads prune."""
    _ensure_database(df.sparkSession, name)
    writer = df.write.format(fmt).mode("append")
    parts = [c for c in ("report_year", "source_date") if c in df.columns][:1]
    (writer.partitionBy(*parts) if parts else writer).saveAsTable(name)


def replace_partition(
    df: DataFrame, name: str, partition: str, value: int, fmt: str = FORMAT
) -> None:
    """Replace one partition of ``name`` by the rows of ``df`` (without that column).

    The table is made if missing.
    """
    spark = df.sparkSession
    _ensure_database(spark, name)
    if not spark.catalog.tableExists(name):
        empty = spark.createDataFrame([], df.schema).withColumn(partition, F.lit(value))
        empty.write.format(fmt).partitionBy(partition).saveAsTable(name)
    spark.sql(
        f"INSERT OVERWRITE TABLE {name} PARTITION ({partition} = {value}) SELECT * FROM {{rows}}",
        rows=df,
    )


def overwrite(df: DataFrame, name: str, fmt: str = FORMAT) -> None:
    """Replace the table and its schema, whole or not at all; one writer at a time.

    ``df`` may read the table itself. With the same columns the change is one step in the
    catalog. With others (and for a table that is no name for a version yet) the new
    name is made beside the old one, which is then replaced; should the job die between
    these two, the next read or overwrite finishes the change.
    """
    spark = df.sparkSession
    _ensure_database(spark, name)
    if fmt in TRANSACTIONAL:
        df.write.format(fmt).mode("overwrite").option("overwriteSchema", "true").saveAsTable(name)
        return
    _finish(spark, name)
    stamp = dt.datetime.now(dt.timezone.utc).strftime("%Y%m%d%H%M%S%f")
    version = f"{name}{_VERSION}{stamp}_{uuid.uuid4().hex[:8]}"
    df.write.format(fmt).saveAsTable(version)  # in the catalog only once it is whole
    _point(spark, name, version, fmt)
    for old in versions(spark, name)[: -1 - KEPT_VERSIONS]:
        spark.sql(f"DROP TABLE IF EXISTS {_quoted(old)}")


def versions(spark: SparkSession, name: str) -> list[str]:
    """Whole versions of a table up to the current one, oldest first."""
    database, _, table = name.rpartition(".")
    where = f" IN {_quoted(database)}" if database else ""
    pattern = re.compile(f"{re.escape(table)}{_VERSION}[0-9]{{20}}_[0-9a-f]{{8}}", re.IGNORECASE)
    found = spark.sql(f"SHOW TABLES{where}").select("tableName").collect()
    names = sorted(row["tableName"] for row in found if pattern.fullmatch(row["tableName"]))
    at = _location(spark, name) if spark.catalog.tableExists(name) else None
    every = [f"{database}.{n}" if database else n for n in names]
    current = [n for n in every if _location(spark, n) == at]
    return every[: every.index(current[0]) + 1] if current else every


def _point(spark: SparkSession, name: str, version: str, fmt: str) -> None:
    """Make ``name`` stand for a version."""
    schema, location = spark.table(version).schema, _location(spark, version)
    if _is_pointer(spark, name) and spark.table(name).schema == schema:
        place = location.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"ALTER TABLE {_quoted(name)} SET LOCATION '{place}'")
        spark.catalog.refreshTable(name)
        return
    beside = f"{name}{_NEXT}"
    spark.sql(f"DROP TABLE IF EXISTS {_quoted(beside)}")
    spark.catalog.createTable(beside, path=location, source=fmt, schema=schema)
    spark.sql(f"DROP TABLE IF EXISTS {_quoted(name)}")
    _finish(spark, name)


def _finish(spark: SparkSession, name: str) -> None:
    """Put the new name of an interrupted change in place of the old one that is gone."""
    beside = f"{name}{_NEXT}"
    if spark.catalog.tableExists(name) or not spark.catalog.tableExists(beside):
        return
    try:
        spark.sql(f"ALTER TABLE {_quoted(beside)} RENAME TO {_quoted(name)}")
    except AnalysisException:
        if not spark.catalog.tableExists(name):  # else another reader was faster
            raise


def _is_pointer(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name) and spark.catalog.getTable(name).tableType == "EXTERNAL"


def _location(spark: SparkSession, name: str) -> str:
    found = spark.sql(f"DESCRIBE TABLE EXTENDED {_quoted(name)}")
    # the last one: a column of the table may be called so, too
    return found.where("col_name = 'Location'").collect()[-1]["data_type"]


def _quoted(name: str) -> str:
    return ".".join(f"`{part}`" for part in name.split("."))


def _ensure_database(spark: SparkSession, name: str) -> None:
    database = name.rpartition(".")[0]
    if database:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {_quoted(database)}")

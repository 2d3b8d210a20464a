"""Incremental Bronze loads: new files of a landing folder, once each.

``load_landed`` takes the files of any source, whatever their format: the stream finds
the new files, and each is read as the source's own job reads it, by many tasks where it is
large. ``load_new_permits`` streams the lines of permits files.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from groundswell.config import BRONZE, landed, landed_files, table_name
from groundswell.operators.transforms import net_migration
from groundswell.schemas import BRONZE_SCHEMAS, LANDED_SCHEMA
from groundswell.sources import files
from groundswell.sources.files import accepted, parse_permits, split_permits
from groundswell.sources.run_log import MAX_ERROR, load_counts, log_run
from groundswell.sources.tables import (
    conform,
    quarter_stamp,
    replace_partition,
    stamped,
    table_exists,
)


def load_new_files(
    spark: SparkSession,
    source: str,
    landing: str,
    checkpoint: str,
    parse: Callable[[DataFrame], DataFrame],
    catalog: str | None = None,
    source_date: Column | None = None,
) -> int:
    """Load the files that arrived in ``landing`` since the last run; returns batches.

    The query's checkpoint (on storage all executors share) remembers the files it has
    read. Each batch replaces its own ``batch_id`` partition of ``bronze.<source>_landed``,
    so a batch that is repeated after a failure overwrites its first try and rows
    never double. ``parse`` turns text lines (column ``value``) into parsed rows;
    ``source_date`` is a parsed row's period. A batch that fails is logged as a failure
    and raised.
    """
    batches = 0

    def write_batch(lines: DataFrame, batch_id: int) -> None:
        nonlocal batches
        started = dt.datetime.now(dt.timezone.utc)
        try:
            counts = Observation(f"{source}_{batch_id}")
            rows = accepted(parse(lines).observe(counts, *load_counts()))
            table = conform(stamped(rows, source_date), BRONZE_SCHEMAS[source])
            target = table_name(BRONZE, landed(source), catalog)
            replace_partition(table, target, "batch_id", batch_id)
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
        batches += 1

    query = (
        spark.readStream.text(landing)
        .writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return batches


def load_new_permits(
    spark: SparkSession, landing: str, checkpoint: str, catalog: str | None = None
) -> int:
    """Monthly permits files from a landing folder."""
    return load_new_files(
        spark,
        "building_permits",
        landing,
        checkpoint,
        lambda lines: parse_permits(split_permits(lines)),
        catalog,
        F.try_to_date("survey_date", "yyyyMM"),
    )


# --- files of any source -------------------------------------------------------------

#: Files of one batch; each is planned on the driver.
MAX_FILES = 100
_FILES = "path string, modificationTime timestamp, length long, content binary"
_PART = re.compile(r"(?:^|[/_.-])(year|quarter|direction)=([0-9]+|in|out)(?=[/_.-]|$)")

Period = Mapping[str, str]


@dataclass(frozen=True)
class Landed:
    """How the files of one source are loaded.

    ``needs``: parts of the period that a path has to name, as in ``year=2024/quarter=1/f.csv`` or
    ``year=2024_quarter=1.csv``. ``parse`` takes the paths of one load, the period and
    the layout of census payloads. With ``paired`` a period is loaded when its files of both
    directions are there.
    """

    parse: Callable[[SparkSession, Sequence[str], Period, str], DataFrame]
    stamp: Callable[[DataFrame, Period], DataFrame]
    needs: Sequence[str] = ()
    paired: bool = False


def _year(period: Period) -> int:
    return int(period["year"])


def _quarter(period: Period) -> int:
    return int(period["quarter"])


def _by_quarter(df: DataFrame, period: Period) -> DataFrame:
    return stamped(df, source_date=quarter_stamp(_year(period), _quarter(period)))


def _by_year(df: DataFrame, period: Period) -> DataFrame:
    return stamped(df, source_year=_year(period))


def _census(parse: Callable[..., DataFrame], *args: Callable[[Period], int]):
    def run(spark: SparkSession, paths: Sequence[str], period: Period, layout: str) -> DataFrame:
        payloads = files.read_census(spark, list(paths), layout)
        return parse(payloads, *[arg(period) for arg in args])

    return run


def _flows(spark: SparkSession, paths: Sequence[str], period: Period, _: str) -> DataFrame:
    sides = {
        side: files.read_flows(spark, [p for p in paths if path_period(p)["direction"] == side])
        for side in ("in", "out")
    }
    net = net_migration(sides["in"], sides["out"], _year(period), _quarter(period))
    return net.withColumn(files.REJECT, F.lit(None).cast("string"))


SOURCES: Mapping[str, Landed] = {
    "building_permits": Landed(
        lambda spark, paths, *_: parse_permits(files.read_permits(spark, list(paths))),
        lambda df, _: stamped(df, source_date=F.try_to_date("survey_date", "yyyyMM")),
    ),
    "hud_construction": Landed(
        lambda spark, paths, period, _: files.parse_construction(
            files.read_permits(spark, list(paths)), _year(period), _quarter(period)
        ),
        _by_quarter,
        ("year", "quarter"),
    ),
    "acs_demographics": Landed(_census(files.parse_demographics, _year), _by_year, ("year",)),
    "vacancy": Landed(
        _census(files.parse_vacancy, _year, _quarter), _by_quarter, ("year", "quarter")
    ),
    "school_enrollment": Landed(
        _census(files.parse_enrollment, _year),
        lambda df, period: stamped(df, source_date=dt.date(_year(period), 1, 1)),
        ("year",),
    ),
    "business_patterns": Landed(_census(files.parse_business, _year), _by_year, ("year",)),
    "national_projections": Landed(
        _census(lambda payloads: files.parse_state_projections(files.state_projection_rows(payloads))),
        lambda df, _: stamped(df),
    ),
    "employment": Landed(
        lambda spark, paths, period, _: files.parse_employment(
            files.read_wages(spark, list(paths)), _quarter(period)
        ),
        _by_quarter,
        ("year", "quarter"),
    ),
    "migration": Landed(_flows, _by_quarter, ("year", "quarter", "direction"), paired=True),
}


@dataclass
class _Load:
    """Files that are read together, and what became of them."""

    new: list[str]
    period: Period
    earlier: list[str] = field(default_factory=list)  # the other direction, from an earlier batch
    frame: DataFrame | None = None
    counts: Observation | None = None
    status: str = "success"
    error: str | None = None


def path_period(path: str) -> dict[str, str]:
    """Parts of the period that a path names; the last one of a kind counts."""
    return dict(_PART.findall(path))


def _label(period: Period, needs: Sequence[str]) -> str:
    return ",".join(f"{part}={period[part]}" for part in needs if part in period)


def _plain(path: str) -> str:
    """A path as a reader's argument: not as a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def load_landed(
    spark: SparkSession,
    source: str,
    landing: str,
    checkpoint: str,
    catalog: str | None = None,
    layout: str = "records",
    max_files: int = MAX_FILES,
) -> int:
    """Load the files of ``source`` that arrived below ``landing`` since the last run; returns batches.

    Each file is one load (a source in two directions: the files of a period), and all
    loads of a batch are one write of the batch's own partition of ``bronze.<source>_landed``:
    a batch that is repeated after a failure overwrites its first try. What became of
    each file is a row of ``bronze.<source>_landed_files``: ``success`` with its loaded and
    rejected rows; ``failure`` with the reason, for a file that names no period or lacks a
    column (the other files still load); ``waiting`` while the other direction is not there.
    A file that cannot be read for another reason ends the batch, which is logged and raised.
    Files of one period in one batch count as parts of one download; empty files have nothing
    to load and are passed over.
    """
    how = SOURCES[source]
    target = table_name(BRONZE, landed(source), catalog)
    status_table = table_name(BRONZE, landed_files(source), catalog)
    batches = 0

    def write_batch(found: DataFrame, batch_id: int) -> None:
        nonlocal batches
        started = dt.datetime.now(dt.timezone.utc)
        try:
            paths = sorted(row["path"] for row in found.select("path").collect())
            loads = _loads(spark, how, paths, status_table, batch_id)
            for number, load in enumerate(loads):
                _plan(spark, source, how, load, layout, f"{source}_{batch_id}_{number}")
            frames = [load.frame for load in loads if load.frame is not None]
            if not frames:
                frames = [spark.createDataFrame([], BRONZE_SCHEMAS[source])]
            replace_partition(reduce(DataFrame.unionByName, frames), target, "batch_id", batch_id)
            rows = _status_rows(how, loads, started)
            status = spark.createDataFrame(rows, LANDED_SCHEMA).coalesce(1)
            replace_partition(status, status_table, "batch_id", batch_id)
        except Exception as error:
            log_run(spark, source, "failure", started, error=str(error), catalog=catalog)
            raise
        failed = [f"{row[0]}: {row[5]}" for row in rows if row[2] == "failure"]
        log_run(
            spark,
            source,
            "success",
            started,
            rows_loaded=sum(row[3] or 0 for row in rows),
            rows_rejected=sum(row[4] or 0 for row in rows),
            error="; ".join(failed) or None,
            catalog=catalog,
        )
        batches += 1

    query = (
        spark.readStream.format("binaryFile")
        .schema(_FILES)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", max_files)
        .load(landing)
        .select("path")  # names only: the contents are read by the source's own reader
        .writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return batches


def _loads(
    spark: SparkSession, how: Landed, paths: Sequence[str], status_table: str, batch_id: int
) -> list[_Load]:
    """The batch's files as loads; those of a period together where directions are paired."""
    loads: dict[str, _Load] = {}
    for path in paths:
        period = path_period(path)
        absent = [part for part in how.needs if part not in period]
        if absent:
            loads[path] = _Load([path], period, status="failure", error=f"no {absent[0]} in the path")
        elif not how.paired:
            loads[path] = _Load([path], period)
        else:
            key = _label(period, [part for part in how.needs if part != "direction"])
            loads.setdefault(key, _Load([], period)).new.append(path)
    for load in loads.values():
        if not how.paired or load.error:
            continue
        sides = {path_period(path)["direction"] for path in load.new}
        for side in {"in", "out"} - sides:
            label = _label({**load.period, "direction": side}, how.needs)
            load.earlier = _earlier(spark, status_table, label, batch_id)
            if not load.earlier:
                load.status = "waiting"
    return list(loads.values())


def _earlier(spark: SparkSession, status_table: str, label: str, batch_id: int) -> list[str]:
    """Files of a period that came last before this batch."""
    if not table_exists(spark, status_table):
        return []
    before = spark.table(status_table).where(
        (F.col("period") == label) & (F.col("batch_id") < batch_id) & (F.col("status") != "failure")
    )
    last = before.agg(F.max("batch_id").alias("b")).scalar()
    return [row["file"] for row in before.where(F.col("batch_id") == last).collect()]


def _plan(
    spark: SparkSession, source: str, how: Landed, load: _Load, layout: str, name: str
) -> None:
    """Set the load's frame, or the reason why its files do not fit the source."""
    if load.status != "success":
        return
    paths = [_plain(path) for path in [*load.new, *load.earlier]]
    counts = Observation(name)
    try:
        parsed = how.parse(spark, paths, load.period, layout)
        rows = accepted(parsed.observe(counts, *load_counts()))
        load.frame = conform(how.stamp(rows, load.period), BRONZE_SCHEMAS[source])
        load.counts = counts
    except AnalysisException as error:  # a column that the source needs is not there
        load.status, load.error = "failure", str(error)


def _status_rows(how: Landed, loads: Sequence[_Load], started: dt.datetime) -> list[tuple]:
    """A row per file; the first file of a load has the load's counts, the others 0."""
    now = dt.datetime.now(dt.timezone.utc)
    rows = []
    for load in loads:
        counts = load.counts.get if load.counts else {}
        for number, path in enumerate(load.new):
            counted = [
                (counts[name] if number == 0 else 0) if counts else None
                for name in ("rows_loaded", "rows_rejected")
            ]
            error = load.error[:MAX_ERROR] if load.error else None
            label = _label(path_period(path), how.needs)
            rows.append((path, label, load.status, *counted, error, started, now))
    return rows

"""Per-key operators on panel tables: latest row, previous row, first row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from groundswell.functions.values import ratio

PERIOD = ("report_year", "report_quarter")


def latest_per_key(
    df: DataFrame,
    columns: Sequence[str],
    key: str = "fips",
    order: Sequence[str] = PERIOD,
) -> DataFrame:
    """The newest row of each key, as ``key`` and ``columns``.

    Orders by those of ``order`` the frame has; with none of them the rows are
    returned as they are. Rows of one period are told apart by their values, so the
    choice does not depend on row order. Spark keeps one row per key before the
    shuffle (``WindowGroupLimit``), so a hot key costs one row per task.
    """
    present = [c for c in order if c in df.columns]
    picked = df.select(key, *columns, *[c for c in present if c not in columns])
    if not present:
        return picked
    newest = [F.col(c).desc() for c in present]
    ties = [F.col(c).asc() for c in columns if c not in present]
    ranked = picked.withColumn(
        "_rn", F.row_number().over(Window.partitionBy(key).orderBy(*newest, *ties))
    )
    return ranked.filter("_rn = 1").select(key, *columns)


def latest_of_all(
    tables: Mapping[str, tuple[DataFrame, Mapping[str, str]]],
    key: str = "fips",
    order: Sequence[str] = PERIOD,
) -> DataFrame:
    """Each key's newest row of every table, side by side: ``key``, and the tables' columns.

    ``tables``: name -> (frame, {output column: its column}). As ``latest_per_key`` picks a row,
    for a table with or without a period; ``has_<name>`` says whether a table has the key.
    All tables are one union and one aggregate (with map-side combine), so a single shuffle
    moves a row per key and task at most, however many tables there are.
    """
    rows, picked = None, []
    for name, (frame, columns) in tables.items():
        present = [c for c in order if c in frame.columns]
        newest = [F.coalesce(-F.col(c), F.lit(2**31 - 1)).alias(f"_{c}") for c in present]
        ties = [F.col(c).alias(out) for out, c in columns.items() if c not in present]
        periods = [F.col(c).alias(out) for out, c in columns.items() if c in present]
        row = F.struct(*newest, *ties, *periods) if (newest or columns) else F.struct(F.lit(1))
        part = frame.select(key, row.alias(f"_{name}"))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
        picked += [F.col(f"_{name}.{out}").alias(out) for out in columns]
        picked.append(F.col(f"_{name}").isNotNull().alias(f"has_{name}"))
    first = rows.groupBy(key).agg(*[F.min(f"_{name}").alias(f"_{name}") for name in tables])
    return first.select(key, *picked)


def drop_reloads(df: DataFrame, grain: Sequence[str], stamp: str = "ingested_at") -> DataFrame:
    """One row per ``grain``: the last one taken in. Undoes repeated downloads.

    Rows of one load, and all rows of a table without a stamp, are told apart by their
    values, so the choice does not depend on row order.
    """
    newest = [F.col(stamp).desc()] if stamp in df.columns else []
    ties = [F.col(c).asc() for c in df.columns if c not in grain and c != stamp]
    order = Window.partitionBy(*grain).orderBy(*newest, *(ties or [F.lit(0)]))
    return df.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")


def last_load(df: DataFrame, grain: Sequence[str], stamp: str = "ingested_at") -> DataFrame:
    """All rows of each grain's last load, for sources with several rows per grain.

    The newest stamp per grain is a small aggregate; the join back spreads a hot grain.
    A table without a stamp is one load.
    """
    if stamp not in df.columns:
        return df
    newest = df.groupBy(*grain).agg(F.max(stamp).alias(stamp))
    return df.join(newest, [*grain, stamp], "left_semi")


def previous_value(
    df: DataFrame,
    value: str,
    name: str,
    keys: Sequence[str] = ("fips",),
    order: Sequence[str] = PERIOD,
) -> DataFrame:
    """Add ``name``: ``value`` of the key's previous row (null on its first).

    ``df`` has one row per key and period, as after aggregating or ``drop_reloads`` on
    the period. The calendar then bounds a key's rows, so one window per key is small
    whatever the data's size, and the order is total.
    """
    return df.withColumn(name, F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)))


def growth(value: str, base: str):
    """Relative change from ``base`` to ``value``; null for a zero or missing base."""
    return ratio(F.col(value) - F.col(base), F.col(base))


def with_base_value(
    df: DataFrame, value: str, name: str, keys: Sequence[str], order: str
) -> DataFrame:
    """Add ``name``: ``value`` in the key's first period.

    One window over one row per key and period, which the calendar bounds.
    """
    first = Window.partitionBy(*keys).orderBy(order, value)
    return df.withColumn(name, F.first(value).over(first))

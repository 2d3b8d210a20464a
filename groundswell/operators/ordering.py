"""Row numbers over a whole frame, without sending it through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from groundswell.session import checkpointed

_LOW_BITS = 33  # monotonically_increasing_id: partition above, row in partition below
_POS, _PART = "_pos", "_part"


def number_rows(df: DataFrame, *order: Column, name: str = "row_number") -> DataFrame:
    """Add the 1-based position under ``order`` and the row total ``<name>_total``.

    One range shuffle sorts the rows; ``order`` should end in a unique key, so that a
    value shared by a third of the rows still splits over many partitions. The
    position inside a partition plus the size of the partitions before it is the row
    number. Positions are written out first: a redone task cannot change them. The
    broadcast side has one row per partition, so the shuffle setting bounds it, never
    the data.
    """
    placed = checkpointed(df.orderBy(*order).withColumn(_POS, F.monotonically_increasing_id()))
    part = F.shiftright(_POS, _LOW_BITS)
    whole = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sizes = placed.groupBy(part.alias(_PART)).agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.select(
        _PART,
        F.coalesce(F.sum("_size").over(whole), F.lit(0)).alias("_before"),
        F.sum("_size").over(every).alias(f"{name}_total"),
    )
    within = F.col(_POS).bitwiseAND(F.lit((1 << _LOW_BITS) - 1))
    return (
        placed.withColumn(_PART, part)
        .join(F.broadcast(offsets), _PART)
        .withColumn(name, F.col("_before") + within + 1)
        .drop(_PART, _POS, "_before")
    )


def tile(position: Column, total: Column, buckets: int) -> Column:
    """``ntile(buckets)`` of a row from its position and the row total.

    The first ``total % buckets`` tiles hold one row more than the others.
    """
    size = F.floor(total / buckets)
    extra = total % buckets
    in_larger = extra * (size + 1)
    larger = F.ceil(position / (size + 1))
    # With fewer rows than buckets every row is in the larger part; never divide by 0.
    smaller = extra + F.ceil((position - in_larger) / F.greatest(size, F.lit(1)))
    return F.when(position <= in_larger, larger).otherwise(smaller).cast("int")

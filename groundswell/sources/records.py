"""Records of one large JSON array, read by many tasks whatever its formatting.

The text source splits a file at byte ranges and, with the character that closes a record
as its line separator, hands every range its own pieces. Whether a piece starts inside a
quoted text, and how many braces and brackets are open around it, follows from what stands
before it in the file: running sums within each range, for both ways it may start, and one
row per range to chain them. Pieces up to the next closing character at the records'
depth are one record. Nothing is read by one task but a range and one row per range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

_TEXT = '"[^"]*("|$)'  # a quoted text; one that is still open ends with the piece


def _count(text: Column, character: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(character), F.lit("")))


def _opened(text: Column, closer: str, quoted: Column) -> tuple[Column, Column]:
    """Braces and brackets that stay open over a piece and the closer behind it."""
    braces = _count(text, "{") - _count(text, "}")
    brackets = _count(text, "[") - _count(text, "]")
    closes = F.when(quoted, 0).otherwise(1)
    return (braces - closes, brackets) if closer == "}" else (braces, brackets - closes)


def _pieces(spark: SparkSession, path: str | list[str], closer: str) -> DataFrame:
    """Pieces between closers, with what each opens if it starts outside (0) or inside (1) a text."""
    lines = spark.read.text(path, lineSep=closer).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("bytes"),
        F.monotonically_increasing_id().alias("id"),  # in file order within a range
        F.col("value"),
        F.regexp_replace("value", r"\\.", "").alias("bare"),
    )
    lines = lines.withColumn("quotes", _count(F.col("bare"), '"'))
    for start, text in ((0, F.col("bare")), (1, F.concat(F.lit('"'), "bare"))):
        inside = (F.col("quotes") + start) % 2 == 1
        braces, brackets = _opened(F.regexp_replace(text, _TEXT, ""), closer, inside)
        lines = lines.withColumns({f"braces{start}": braces, f"brackets{start}": brackets})
    return lines.drop("bare")


def split_records(
    spark: SparkSession, path: str | list[str], closer: str, braces: int, brackets: int
) -> DataFrame:
    """(file, text, opens, complete) per record of the files at ``path``.

    A record ends with a ``closer`` (``]`` or ``}``) outside quoted texts behind which
    ``braces`` and ``brackets`` are open. ``text`` runs from the end of the record
    before it, or from the start of the file (``opens``); what stands between records is left
    to the caller. A file that ends within a record, leaves something open or has no record
    gives its rest as a row that is not ``complete``.
    """
    within = Window.partitionBy("file", "block").orderBy("id")
    before = F.coalesce(F.sum("quotes").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    running = within.rowsBetween(Window.unboundedPreceding, 0)
    swapped = F.col("before") % 2 == 1
    pieces = _pieces(spark, path, closer).withColumn("before", before)
    for kind in ("braces", "brackets"):
        # the piece starts inside a text if just one of its range's start and its own place does
        for start in (0, 1):
            own = F.when(swapped, F.col(f"{kind}{1 - start}")).otherwise(F.col(f"{kind}{start}"))
            pieces = pieces.withColumn(f"{kind}_from{start}", F.sum(own).over(running))

    last = {f"{kind}_from{start}" for kind in ("braces", "brackets") for start in (0, 1)}
    ranges = pieces.groupBy("file", "block").agg(
        F.first("bytes").alias("bytes"),
        F.sum("quotes").alias("quotes"),
        F.sum(F.octet_length("value") + 1).alias("read"),
        F.min("id").alias("first_id"),
        F.max("id").alias("last_id"),
        *[F.max_by(name, "id").alias(name) for name in sorted(last)],
    )
    # one row per range from here to the join
    in_file = Window.partitionBy("file").orderBy("block")
    earlier, whole = in_file.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("file")
    chained = ranges.withColumn("starts", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2)
    # the file's last piece has no closer behind it if that makes one byte too many
    loose = F.sum("read").over(whole) > F.col("bytes")
    closed = F.sum("quotes").over(whole) % 2 == 0
    for kind in ("braces", "brackets"):
        own = F.when(F.col("starts") == 1, F.col(f"{kind}_from1")).otherwise(F.col(f"{kind}_from0"))
        chained = chained.withColumn(f"{kind}_own", own).withColumn(
            f"{kind}_before", F.coalesce(F.sum(f"{kind}_own").over(earlier), F.lit(0))
        )
        uncounted = loose.cast("int") if kind == ("braces" if closer == "}" else "brackets") else 0
        closed = closed & (F.sum(f"{kind}_own").over(whole) + uncounted == 0)
    chained = chained.select(
        "file",
        "block",
        "starts",
        "braces_before",
        "brackets_before",
        closed.alias("closed"),
        F.when(F.col("block") == F.min("block").over(whole), F.col("first_id")).alias("first_id"),
        F.when(F.col("block") == F.max("block").over(whole), F.col("last_id")).alias("last_id"),
        loose.alias("loose"),
    )
    placed = pieces.join(chained, ["file", "block"])
    at_end = F.coalesce(F.col("id") == F.col("last_id"), F.lit(False))
    loose = at_end & F.col("loose")
    quoted = (F.col("starts") + F.col("before") + F.col("quotes")) % 2 == 1

    def depth(kind: str) -> Column:
        own = F.when(F.col("starts") == 1, F.col(f"{kind}_from1")).otherwise(F.col(f"{kind}_from0"))
        return F.col(f"{kind}_before") + own

    ends = ~quoted & ~loose & (depth("braces") == braces) & (depth("brackets") == brackets)
    marked = placed.select(
        "file",
        "block",
        "id",
        F.when(loose, F.col("value")).otherwise(F.concat("value", F.lit(closer))).alias("text"),
        F.coalesce(F.col("id") == F.col("first_id"), F.lit(False)).alias("opens"),
        F.when(ends, F.col("id")).alias("end"),
        (at_end & ~F.col("closed")).alias("breaks_off"),
    )
    backwards = Window.partitionBy("file", "block").orderBy(F.col("id").desc())
    upwards = backwards.rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("record", F.last("end", ignorenulls=True).over(upwards))
    firsts = marked.groupBy("file", "block").agg(F.min("end").alias("end"))
    later = Window.partitionBy("file").orderBy(F.col("block").desc())
    later = later.rowsBetween(Window.unboundedPreceding, -1)
    following = firsts.select(
        "file",
        "block",
        F.last("end", ignorenulls=True).over(later).alias("following"),
        F.max(F.col("end").isNotNull()).over(Window.partitionBy("file")).alias("any_record"),
    )
    record = F.coalesce("record", "following")
    joined = marked.join(following, ["file", "block"]).withColumn("record", record)
    in_order = F.array_sort(F.collect_list(F.struct("block", "id", "text")))
    records = joined.groupBy("file", "record").agg(
        F.array_join(F.transform(in_order, lambda piece: piece["text"]), "").alias("text"),
        F.bool_or("opens").alias("opens"),
        F.bool_or("breaks_off").alias("breaks_off"),
        F.bool_and("any_record").alias("any_record"),
    )
    rest = F.col("record").isNull()
    whole_record = F.struct("text", "opens", F.lit(True).alias("complete"))
    broken = F.struct(
        F.when(rest, F.col("text")).otherwise("").alias("text"),
        (rest & F.col("opens")).alias("opens"),
        F.lit(False).alias("complete"),
    )
    is_broken = F.col("breaks_off") | (rest & ~F.col("any_record"))
    nothing = F.array().cast("array<struct<text: string, opens: boolean, complete: boolean>>")
    return records.select(
        "file",
        F.inline(
            F.concat(
                F.when(rest, nothing).otherwise(F.array(whole_record)),
                F.when(is_broken, F.array(broken)).otherwise(nothing),
            )
        ),
    )

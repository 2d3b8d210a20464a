"""Text-to-number and null-safe arithmetic helpers.

Spark runs in ANSI mode, so every cast or division that may fail on dirty input
goes through ``try_*`` and gives null instead of ending the job.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

WHITESPACE = " \t\r\n\f\v"
NULL_TOKENS = ("", "-")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def unquote(text: Column) -> Column:
    """Strip blanks, then surrounding double quotes."""
    return F.btrim(strip(text), F.lit('"'))


def zfill(text: Column, width: int) -> Column:
    """Zero-padded to ``width``; unlike ``lpad`` a longer text stays whole."""
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def to_long(text: Column) -> Column:
    """Whole number, or null when the text is not one; the cast ignores outer blanks."""
    return text.try_cast("bigint")


def blank_as_zero(text: Column) -> Column:
    """0 for blank or absent, null for text that is no whole number."""
    return F.when(F.coalesce(strip(text), F.lit("")) == "", F.lit(0).cast("bigint")).otherwise(
        to_long(text)
    )


def is_null_token(text: Column) -> Column:
    """Absent, empty or a lone dash."""
    return text.isNull() | text.isin(*NULL_TOKENS)


def known(text: Column) -> Column:
    """The text, or null when it is a null token."""
    return F.when(~is_null_token(text), text)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that is null for a null or zero denominator."""
    return F.try_divide(numerator, denominator)


def lookup(table: Mapping[str, object], key: Column) -> Column:
    """Value of ``key`` in a small constant table, null when it is not there."""
    pairs = ", ".join(f"{_literal(k)}, {_literal(v)}" for k, v in table.items())
    return F.try_element_at(F.expr(f"map({pairs})"), key)


def _literal(value: object) -> str:
    return f"'{value}'" if isinstance(value, str) else str(value)


def or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def is_finite(value: Column) -> Column:
    """Neither null, NaN nor infinite."""
    number = value.cast("double")
    return number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf"))


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every double column, for comparing results between engines."""
    return df.select(
        *[
            F.round(F.col(name), places).alias(name) if kind == "double" else F.col(name)
            for name, kind in df.dtypes
        ]
    )

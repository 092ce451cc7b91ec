"""Text helpers shared by the typed conversions, the filters and the lists."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters a Python ``str.strip()`` removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# The same characters as a regex class.
BLANKS = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]*"

# Upper-case letters, decimal digits and whitespace, as Java regex classes.
CODE_PATTERN = r"^[\p{IsUppercase}\p{Nd}\p{IsWhite_Space}\x1c-\x1f]*$"


def quote(name: str) -> str:
    """A literal column name, which may hold dots, spaces or backticks, for use in ``select``."""
    return "`" + name.replace("`", "``") + "`"


def free_name(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores before it until no taken name is equal to it in any case."""
    used = {other.lower() for other in taken}
    while name.lower() in used:
        name = "_" + name
    return name


def col(name: str) -> Column:
    return F.col(quote(name))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    """Trimming the left side is enough, and stops at the first other character."""
    return F.ltrim(text, F.lit(WHITESPACE)) == ""


def nan_to_null(value: Column, dtype: T.DataType) -> Column:
    """NaN means "missing" in a float column."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(value), value)
    return value


def display_text(value: Column, dtype: T.DataType) -> Column:
    """The value as a user sees it: ``True``, ``12345678.0``, ``1e-05``, ``2023-01-05``."""
    if isinstance(dtype, T.StringType):
        return value
    if isinstance(dtype, T.BooleanType):
        return F.initcap(value.cast("string"))
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return float_text(value)
    return value.cast("string")


def float_text(value: Column) -> Column:
    """Shortest decimal text: plain from 1e-4 up to 1e16, scientific outside, NaN as null."""
    text = value.cast("string")
    size = F.abs(value)
    plain = F.regexp_replace(text.cast("decimal(38,21)").cast("string"), r"(\.\d+?)0+$", "$1")
    mantissa = F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", "")
    exponent = F.substring_index(text, "E", -1)
    digits = F.ltrim(exponent, F.lit("-"))
    scientific = F.concat(
        mantissa,
        F.when(exponent.startswith("-"), "e-").otherwise("e+"),
        F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits),
    )
    return (
        F.when(F.isnan(value), F.lit(None).cast("string"))
        .when(size == float("inf"), F.when(value > 0, "inf").otherwise("-inf"))
        .when(~text.contains("E"), text)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(scientific)
    )

"""Typed conversions CODE, INTEGE, DECIMA and DATE as built-in Spark expressions.

A conversion is a few steps, each computed once as a column of its own, and a result on top of
them: the converted value, and a problem text that is null when the value is acceptable. A null
input gives a null value and no problem.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from steploom.functions.dates import date_text, day_text, digit_shape, parse_day
from steploom.functions.text import BLANKS, CODE_PATTERN, display_text, float_text, nan_to_null, strip

MAX_LENGTH = 12
MAX_DIGITS = 12

# Text forms read as a number by the required types (digit groups may use "_") ...
FLOAT_PATTERN = (
    r"[+-]?(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)"
    r"(?:[eE][+-]?\d+(?:_\d+)*)?"
)
# ... and by the optional types (no "_", infinities allowed).
NUMERIC_PATTERN = r"(?i:[+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?|[+-]?inf(?:inity)?)"
# Fixed value: text that DECIMA reads as a missing number.
NAN_PATTERN = rf"(?i)^{BLANKS}[+-]?nan{BLANKS}$"
INTEGER_PATTERN = r"^[+-]?\d+(?:_\d+)*$"

_NUMBERS = (T.NumericType, T.BooleanType)


class Conversion(NamedTuple):
    value: Column
    problem: Column


class TypedValue(NamedTuple):
    """``steps`` take the raw value, its type and the earlier steps; ``result`` takes value, type, steps."""

    steps: Sequence[Callable[..., Column]]
    result: Callable[..., Conversion]


def parse_float(value: Column, dtype: T.DataType, pattern: str = FLOAT_PATTERN) -> Column:
    """Double, or null where the value is not a number."""
    if isinstance(dtype, _NUMBERS):
        return nan_to_null(value, dtype).cast("double")
    if isinstance(dtype, T.StringType):
        # The cast drops the usual outer blanks itself; rarer ones are stripped first.
        plain = F.replace(value, F.lit("_"), F.lit(""))
        return F.when(value.rlike(rf"^\s*{pattern}\s*$"), plain.try_cast("double")).when(
            value.rlike(rf"^{BLANKS}{pattern}{BLANKS}$"), strip(plain).try_cast("double")
        )
    return F.lit(None).cast("double")


def _numeric(value: Column, dtype: T.DataType) -> Column:
    return parse_float(value, dtype, NUMERIC_PATTERN)


def _present(value: Column, dtype: T.DataType) -> Column:
    return nan_to_null(value, dtype).isNotNull()


def _no_problem() -> Column:
    return F.lit(None).cast("string")


def _stripped(value: Column, dtype: T.DataType) -> Column:
    return strip(display_text(value, dtype))


def _code_problem(value: Column, dtype: T.DataType, text: Column) -> Column:
    return F.when(~text.rlike(CODE_PATTERN), "only upper-case letters, digits and spaces are allowed").when(
        F.length(text) > MAX_LENGTH, f"longer than {MAX_LENGTH} characters"
    )


def _code_result(value: Column, dtype: T.DataType, text: Column, problem: Column) -> Conversion:
    return Conversion(F.when(problem.isNull(), text), problem)


def _whole_problem(value: Column, dtype: T.DataType, number: Column) -> Column:
    return F.when(_present(value, dtype) & number.isNull(), "not a number").when(
        F.abs(number) >= 10.0**MAX_DIGITS, f"more than {MAX_DIGITS} digits"
    )


def _whole_result(value: Column, dtype: T.DataType, number: Column, problem: Column) -> Conversion:
    return Conversion(F.when(problem.isNull(), number.cast("bigint")), problem)


def _rounded(value: Column, dtype: T.DataType, number: Column) -> Column:
    """Four decimals, half-even on the exact binary value; null from 10^12 on.

    ``format_number`` rounds that way, while ``bround`` goes by the shortest decimal text. The one
    tie ``format_number`` gets wrong is 0.00005, which is stored above the tie.
    """
    return F.when(F.abs(number) == 0.00005, (F.signum(number) * 0.0001).cast("decimal(38,4)")).when(
        F.abs(number) < 10.0**MAX_DIGITS,
        F.call_function("format_number", number, F.lit("0.0000")).cast("decimal(38,4)"),
    )


def _digits(value: Column, dtype: T.DataType, number: Column, rounded: Column) -> Column:
    """Digits left of the point, plus those right of it without trailing zeros, but at least one."""
    return F.length(F.regexp_replace(F.abs(rounded).cast("string"), r"(\.\d+?)0+$", "$1")) - 1


def _decimal_problem(value: Column, dtype: T.DataType, number: Column, rounded: Column, digits: Column) -> Column:
    unread = _present(value, dtype) & number.isNull()
    if isinstance(dtype, T.StringType):
        unread = unread & ~value.rlike(NAN_PATTERN)
    return F.when(unread, "not a number").when(
        number.isNotNull() & (digits.isNull() | (digits > MAX_DIGITS)), f"more than {MAX_DIGITS} digits"
    )


def _decimal_result(
    value: Column, dtype: T.DataType, number: Column, rounded: Column, digits: Column, problem: Column
) -> Conversion:
    return Conversion(F.when(problem.isNull(), rounded.cast("double")), problem)


def _date_problem(value: Column, dtype: T.DataType, shape: Column, day: Column) -> Column:
    return F.when(_present(value, dtype) & day.isNull(), "not a date")


def _date_result(value: Column, dtype: T.DataType, shape: Column, day: Column, problem: Column) -> Conversion:
    return Conversion(day_text(day), problem)


def _optional_code_result(value: Column, dtype: T.DataType) -> Conversion:
    text = display_text(value, dtype)
    return Conversion(F.when(text != "nan", text), _no_problem())


def _optional_whole_result(value: Column, dtype: T.DataType, number: Column) -> Conversion:
    if isinstance(dtype, (T.IntegralType, T.BooleanType)):
        return Conversion(value.cast("bigint"), _no_problem())
    whole = (number == F.rint(number)) & (F.abs(number) < 2.0**63)
    return Conversion(F.when(whole, number.cast("bigint")), F.when(~whole, "not a whole number"))


def _optional_decimal_result(value: Column, dtype: T.DataType, number: Column) -> Conversion:
    return Conversion(number, _no_problem())


# Required and optional dates share one rule: an unreadable value is a problem.
_DATE = TypedValue([digit_shape, parse_day, _date_problem], _date_result)

REQUIRED = {
    "CODE": TypedValue([_stripped, _code_problem], _code_result),
    "INTEGE": TypedValue([parse_float, _whole_problem], _whole_result),
    "DECIMA": TypedValue([parse_float, _rounded, _digits, _decimal_problem], _decimal_result),
    "DATE": _DATE,
}
OPTIONAL = {
    "CODE": TypedValue([], _optional_code_result),
    "INTEGE": TypedValue([_numeric], _optional_whole_result),
    "DECIMA": TypedValue([_numeric], _optional_decimal_result),
    "DATE": _DATE,
}


def list_elements(data_type: str, sources: Sequence[tuple[Column, T.DataType]]) -> Column:
    """Array of the values as text, without those that are missing or not of the type."""
    if data_type == "DECIMA":
        numbers = F.array_compact(F.array(*[parse_float(value, dtype) for value, dtype in sources]))
        return F.transform(numbers, float_text)
    element = date_text if data_type == "DATE" else _whole_text
    return F.array_compact(F.array(*[element(value, dtype) for value, dtype in sources]))


def _whole_text(value: Column, dtype: T.DataType) -> Column:
    """Numbers truncated to whole ones; of text, only whole numbers."""
    if isinstance(dtype, T.StringType):
        text = strip(value)
        return F.when(
            text.rlike(INTEGER_PATTERN),
            F.replace(text, F.lit("_"), F.lit("")).try_cast("decimal(38,0)").cast("string"),
        )
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return value.try_cast("bigint").cast("string")
    if isinstance(dtype, _NUMBERS):
        return value.cast("bigint").cast("string")
    return F.lit(None).cast("string")

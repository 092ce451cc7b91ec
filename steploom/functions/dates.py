"""Dates as ``dd/MM/yyyy`` text.

The shape of a date text decides on one rewrite to ``yyyy-m-d``, followed by one
``try_cast(... AS date)``. Nothing is parsed by trial and error. The usual shapes are told by
comparing the text with all digits made 0, the others by regular expressions.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from steploom.functions.text import BLANKS, nan_to_null, strip

OUTPUT_FORMAT = "dd/MM/yyyy"

# Day zero of spreadsheet serials, and the serials and years that stand for a date of the years 1 to 9999.
SERIAL_ORIGIN = "1899-12-30"
FIRST_SERIAL, END_SERIAL = -693593, 2958466
YEAR = r"(?!0000)\d{4}"
#: The last year that two digits can mean, unless another is given: 00-75 are 2000-2075, 76-99 are 1976-1999.
LAST_SHORT_YEAR = 2075

# Month names, of which the first three letters count.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_NAME = r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)(?:uary|ruary|ch|il|e|y|ust|t|tember|ober|ember)?"
_WEEKDAY = r"(?:(?:mon|tue|tues|wed|thu|thur|thurs|fri|sat|sun)(?:day|nesday|sday|rsday|urday)?,? +)?"
_TIME = r"(?:[ t]+(?:[01]?\d|2[0-3]):[0-5]\d(?::[0-5]\d(?:\.\d+)?)? *(?:am|pm)? *(?:z|utc|[+-]\d{2}:?\d{2})?)?"


def _shape(pattern: str) -> str:
    return f"(?i)^{BLANKS}{pattern}{BLANKS}$"


# Accepted shapes, in any case, and the same date as year-month-day.
# With two numbers before the year, the first is the month unless it is above 12.
_MONTH_DAY, _DAY_MONTH = r"(0?[1-9]|1[0-2])([-.])(\d{1,2})\2", r"(1[3-9]|[23]\d)([-.])(\d{1,2})\2"
_DAY_NAME = rf"{_WEEKDAY}(\d{{1,2}})(?:st|nd|rd|th)?[- ]*{_NAME}[-, ]*"
_NAME_DAY = rf"{_WEEKDAY}{_NAME}[- ]*(\d{{1,2}})(?:st|nd|rd|th)?[-, ]+"
NUMBER_SHAPES = (
    (_shape(rf"({YEAR})([-. ])(\d{{1,2}})\2(\d{{1,2}}){_TIME}"), "$1-$3-$4"),
    (_shape(rf"{_MONTH_DAY}({YEAR}){_TIME}"), "$4-$1-$3"),
    (_shape(rf"{_DAY_MONTH}({YEAR}){_TIME}"), "$4-$3-$1"),
    (_shape(rf"({YEAR})(\d{{2}})(\d{{2}}){_TIME}"), "$1-$2-$3"),
    (_shape(rf"({YEAR})-(\d{{1,2}})"), "$1-$2-1"),
    (_shape(rf"(\d{{1,2}})[-/]({YEAR})"), "$2-$1-1"),
)
SHORT_NUMBER_SHAPES = (
    (_shape(rf"{_MONTH_DAY}(\d{{2}}){_TIME}"), "$4-$1-$3"),
    (_shape(rf"{_DAY_MONTH}(\d{{2}}){_TIME}"), "$4-$3-$1"),
)
NAME_SHAPES = (
    (_shape(rf"{_DAY_NAME}({YEAR}){_TIME}"), "$3-$2-$1"),
    (_shape(rf"{_NAME_DAY}({YEAR}){_TIME}"), "$3-$1-$2"),
    (_shape(rf"({YEAR})[- ]{_NAME}[- ](\d{{1,2}}){_TIME}"), "$1-$2-$3"),
    (_shape(rf"{_NAME}[- ]+({YEAR})"), "$2-$1-1"),
)
SHORT_NAME_SHAPES = (
    (_shape(rf"{_DAY_NAME}(\d{{2}}){_TIME}"), "$3-$2-$1"),
    (_shape(rf"{_NAME_DAY}(\d{{2}}){_TIME}"), "$3-$1-$2"),
)
SLASHES = _shape(r"(\d{0,2})/(\d{0,2})/(\d{0,4})")
# A number is a serial, except eight digits, which are a calendar date.
SERIAL = _shape(r"(?!\d{8}\b(?![.]))[+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?")


def _with_century(year_month_day: Column, last_short_year: int) -> Column:
    """A two-digit year becomes the latest one with these digits up to ``last_short_year``."""
    century, years = divmod(last_short_year, 100)
    recent = F.substring(year_month_day, 1, 2) <= f"{years:02d}"
    return F.concat(F.when(recent, str(century)).otherwise(str(century - 1)), year_month_day)


def slash_day(text: Column) -> Column:
    """Day/month/year with short parts padded to 2/2/4; null unless it is a calendar date."""
    padded = F.regexp_replace(text, SLASHES, "000$3-0$2-0$1")
    return F.regexp_replace(padded, r"^0*?(\d{4})-0?(\d{2})-0?(\d{2})$", "$1-$2-$3").try_cast("date")


def _rewritten(
    text: Column, shapes: Sequence, short_shapes: Sequence, otherwise: Column, last_short_year: int
) -> Column:
    for shape, rewrite in reversed(short_shapes):
        rewritten = _with_century(F.regexp_replace(text, shape, rewrite), last_short_year)
        otherwise = F.when(text.rlike(shape), rewritten).otherwise(otherwise)
    for shape, rewrite in reversed(shapes):
        otherwise = F.when(text.rlike(shape), F.regexp_replace(text, shape, rewrite)).otherwise(otherwise)
    return otherwise


def _month(name: Column) -> Column:
    """The number of a month from its first three letters, by their place in one text; null for other letters."""
    place = F.instr(F.lit(" ".join(MONTHS)), F.lower(F.substring(name, 1, 3)))
    return F.when(place % 4 == 1, F.lpad(((place + 3) / 4).cast("int").cast("string"), 2, "0"))


NAMED_SHAPES = ("0 aaa 0000", "00 aaa 0000", "0-aaa-0000", "00-aaa-0000")


def _usual_named_day(value: Column, shape: Column) -> Column:
    """Days of the shapes ``d MMM yyyy``, ``dd MMM yyyy`` and the same with ``-``; null for others."""
    short = shape.isin("0 aaa 0000", "0-aaa-0000")
    long = shape.isin("00 aaa 0000", "00-aaa-0000")
    start = F.when(short, 3).when(long, 4)
    year, name = F.substring(value, start + F.lit(4), F.lit(4)), F.substring(value, start, F.lit(3))
    day = F.concat(year, F.lit("-"), _month(name), F.lit("-"), F.substring(value, F.lit(1), start - F.lit(2)))
    return F.when(short | long, day.try_cast("date"))


def general_day(text: Column, last_short_year: int = LAST_SHORT_YEAR) -> Column:
    """The date of general date text; null where no shape fits."""
    nothing = F.lit(None).cast("string")
    named = F.lower(_rewritten(text, NAME_SHAPES, SHORT_NAME_SHAPES, nothing, last_short_year))
    for n, name in enumerate(MONTHS):
        named = F.replace(named, F.lit(name), F.lit(str(n + 1)))
    numbered = _rewritten(text, NUMBER_SHAPES, SHORT_NUMBER_SHAPES, nothing, last_short_year)
    return F.when(text.rlike(f"(?i){'|'.join(MONTHS)}"), named).otherwise(numbered).try_cast("date")


def serial_day(days: Column) -> Column:
    """The date of a spreadsheet day number, fractions allowed; null out of range."""
    return F.when(
        (days >= FIRST_SERIAL) & (days < END_SERIAL),
        F.date_add(F.lit(SERIAL_ORIGIN).cast("date"), F.floor(days).cast("int")),
    )


def digit_shape(value: Column, dtype: T.DataType) -> Column:
    """The text with every digit as 0 and every ASCII letter as ``a``; null for other types and for long texts."""
    if not isinstance(dtype, T.StringType):
        return F.lit(None).cast("string")
    letters = string.ascii_letters.replace("a", "")
    return F.when(F.length(value) <= 12, F.translate(value, "123456789" + letters, "0" * 9 + "a" * len(letters)))


def _parts(year: Column, month: Column, day: Column) -> Column:
    return F.concat_ws("-", year, month, day).try_cast("date")


def parse_day(value: Column, dtype: T.DataType, shape: Column, last_short_year: int = LAST_SHORT_YEAR) -> Column:
    """The date meant by any accepted value; null where it cannot be read."""
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return value.cast("date")
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return serial_day(nan_to_null(value, dtype).cast("double"))
    if not isinstance(dtype, T.StringType):
        return F.lit(None).cast("date")
    first, second, year = F.substring(value, 1, 2), F.substring(value, 4, 2), F.substring(value, 7, 4)
    return (
        F.when(shape == "0000-00-00", F.when(value >= "0001", value.try_cast("date")))
        .when(shape == "00/00/0000", _parts(year, second, first))
        .when(
            shape == "00-00-0000",
            F.when(year >= "0001", F.when(first <= "12", _parts(year, first, second)).otherwise(_parts(year, second, first))),
        )
        .when(shape.isin(*NAMED_SHAPES) & (F.right(value, F.lit(4)) >= "0001"), _usual_named_day(value, shape))
        .when(value.rlike(SLASHES), slash_day(value))
        .when(value.rlike(SERIAL), serial_day(strip(value).try_cast("double")))
        .otherwise(general_day(value, last_short_year))
    )


def day_text(day: Column) -> Column:
    return F.date_format(day, OUTPUT_FORMAT)


def date_text(value: Column, dtype: T.DataType, last_short_year: int = LAST_SHORT_YEAR) -> Column:
    """Any accepted date value as ``dd/MM/yyyy``; null where it cannot be read."""
    return day_text(parse_day(value, dtype, digit_shape(value, dtype), last_short_year))

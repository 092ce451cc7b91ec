"""Sums of doubles that are exact and rounded once, so neither partitions nor the order of rows can change a digit.

Every double is a whole multiple of 2^-1074. It is cut into whole parts of WIDTH bits by its exponent; parts of the same
place are added as longs, which is exact in any order and combined before the shuffle. At the end the parts of a sum, at most
some ninety, are carried into one number and rounded to the nearest double, ties to even.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steploom.functions.text import col

#: Bits of a part. Sums of up to 2^38 values fit into longs; beyond that Spark stops with an overflow, it does not wrap around.
WIDTH = 24
#: Parts that hold all 53 bits of a double wherever it begins in its first part.
PARTS = 4
#: Places of all parts, of the smallest double to sums of 2^38 of the largest.
PLACES = 96

# Fixed: the exponent of the smallest double.
_LOWEST = -1074
_ZERO, _NAN = -20, -10


def _unit(place: Column) -> Column:
    return F.pow(F.lit(2.0), (F.greatest(place, F.lit(0)) * WIDTH + _LOWEST).cast("double"))


def _parts(values: DataFrame) -> DataFrame:
    """``values`` (with ``_x``) with the place of its first part and its PARTS parts, from the highest down."""
    x = F.col("_x")
    finite = ~F.isnan(x) & (F.abs(x) != float("inf"))
    place = F.floor((F.log2(F.abs(x)) - _LOWEST) / WIDTH).cast("int")
    out = values.withColumn("_place", F.when(~finite, _NAN).when(x == 0, _ZERO).otherwise(place))
    # The rest after each part is exact, as it is what is left of the bits.
    out = out.withColumn("_rest", F.when(F.col("_place") >= 0, x).otherwise(0.0))
    for n in range(PARTS):
        unit = _unit(F.col("_place") - n)
        part = F.when(F.col("_place") >= n, F.col("_rest") / unit).otherwise(0.0).cast("long")
        out = out.withColumn(f"_p{n}", part).withColumn("_rest", F.col("_rest") - F.col(f"_p{n}") * unit)
    special = (F.isnan(x), x == float("inf"), x == float("-inf"))
    for n, is_so in enumerate(special):
        out = out.withColumn(f"_p{n}", F.when(F.col("_place") == _NAN, is_so.cast("long")).otherwise(F.col(f"_p{n}")))
    return out


def _digits(parts: Column, sign: int) -> Column:
    """The parts as one number: digits of WIDTH bits from the lowest up, after PARTS zeros, and what is carried beyond."""
    base = 1 << WIDTH

    def carry(at: Column, place: Column) -> Column:
        value = F.coalesce(F.try_element_at(parts, place), F.lit(0)) * sign + at["carry"]
        digit = F.pmod(value, F.lit(base).cast("long"))
        return F.struct(F.call_function("div", value - digit, F.lit(base).cast("long")).alias("carry"), F.concat(at["digits"], F.array(digit)).alias("digits"))

    start = F.struct(F.lit(0).cast("long").alias("carry"), F.array_repeat(F.lit(0).cast("long"), PARTS).alias("digits"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(PLACES - 1)), start, carry)


def _rounded(digits: Column) -> Column:
    """The nearest double of a number that is not negative."""
    places = F.transform(digits, lambda digit, at: F.when(digit != 0, at))
    top = F.array_max(places)
    at = lambda n: F.get(digits, top - n)
    high, low = at(0) * (1 << WIDTH) + at(1), at(2) * (1 << WIDTH) + at(3)
    below = (F.array_min(places) < top - 3).cast("long")
    # Both are exact doubles, so their sum is rounded once; the last bit stands for all digits below.
    value = high.cast("double") * 2.0 ** (2 * WIDTH + 1) + (low * 2 + below).cast("double")
    exponent = (top - PARTS - 3) * WIDTH + _LOWEST - 1
    first = F.greatest(exponent, F.lit(-1000))
    scaled = value * F.pow(F.lit(2.0), first.cast("double")) * F.pow(F.lit(2.0), (exponent - first).cast("double"))
    return F.coalesce(scaled, F.lit(0.0))


def _total(parts: Column) -> Column:
    seen = lambda n: F.coalesce(F.try_element_at(parts, F.lit(_NAN - n)), F.lit(0)) > 0
    # Each array of one is computed once for all that reads it.
    plus = F.transform(F.array(_digits(parts, 1)), lambda n: F.when(n["carry"] >= 0, _rounded(n["digits"])))[0]
    minus = F.transform(F.array(_digits(parts, -1)), lambda n: -_rounded(n["digits"]))[0]
    return (
        F.when(seen(0) | (seen(1) & seen(2)), float("nan"))
        .when(seen(1), float("inf"))
        .when(seen(2), float("-inf"))
        .otherwise(F.coalesce(plus, minus))
    )


def exact_parts(df: DataFrame, columns: Sequence[Column], keys: Sequence[str] = ()) -> DataFrame:
    """The parts of the sums of ``columns`` in each group of ``keys`` (as ``k0``, ``k1``, ...): a few rows for each group, which can be
    summed up further by any of the keys."""
    entries = [F.struct(F.lit(n).alias("_of"), value.cast("double").alias("_x")) for n, value in enumerate(columns)]
    groups = [f"k{n}" for n in range(len(keys))]
    values = df.select(*[col(key).alias(k) for key, k in zip(keys, groups, strict=True)], F.inline(F.array(*entries)))
    first = _parts(values.filter(F.col("_x").isNotNull())).groupBy(*groups, "_of", "_place").agg(*[F.sum(f"_p{n}").alias(f"_p{n}") for n in range(PARTS)])
    spread = F.array(*[F.struct((F.col("_place") - n).alias("_at"), F.col(f"_p{n}").alias("_sum")) for n in range(PARTS)])
    return first.select(*groups, "_of", F.inline(spread))


def totals_of_parts(parts: DataFrame, names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """The sums, under ``names``, by the first of the keys that ``parts`` were taken by."""
    groups = [f"k{n}" for n in range(len(keys))]
    placed = parts.groupBy(*groups, "_of", "_at").agg(F.sum("_sum").alias("_sum"))
    sums = placed.groupBy(*groups, "_of").agg(F.map_from_entries(F.collect_list(F.struct("_at", "_sum"))).alias("_parts"))
    totals = sums.select(*groups, "_of", _total(F.col("_parts")).alias("_total"))
    picked = [F.coalesce(F.max(F.when(F.col("_of") == n, F.col("_total"))), F.lit(0.0)) for n in range(len(names))]
    return totals.groupBy(*groups).agg(*picked).toDF(*keys, *names)


def exact_totals(df: DataFrame, columns: Mapping[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """The sum of each of ``columns`` (doubles or floats) in each group of ``keys``, under its name.

    Nulls are skipped; 0 for no value. Infinities and NaN give what adding them gives, sums beyond the largest double an infinity.
    Without keys there is one row. With keys, groups without any value are left out.
    """
    return totals_of_parts(exact_parts(df, list(columns.values()), keys), list(columns), keys)

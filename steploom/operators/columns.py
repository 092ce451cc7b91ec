"""Header matching, required-source check and projection onto the mapped columns."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame

from steploom.functions.text import col
from steploom.specs import ColumnRule, SpecError, targets


def _normal(header: str) -> str:
    return header.lower().replace("_", " ").strip()


def find_column(wanted: str, headers: Sequence[str]) -> str | None:
    """The exact header, else the first that is equal up to case, ``_``/space and outer blanks."""
    if wanted in headers:
        return wanted
    return next((header for header in headers if _normal(header) == _normal(wanted)), None)


def resolve_columns(df: DataFrame, wanted: Iterable[str]) -> DataFrame:
    """The wanted columns, under the wanted names, from whatever spelling the input has."""
    names = list(wanted)
    found = {name: find_column(name, df.columns) for name in names}
    missing = [name for name in names if found[name] is None]
    if missing:
        raise SpecError(f"columns not found: {', '.join(missing)}")
    return df.select([col(found[name]).alias(name) for name in names])


def missing_required(df: DataFrame, rules: Iterable[ColumnRule]) -> list[str]:
    """Required source columns that the table does not have, in rule order."""
    return [
        rule.source
        for target in targets(rules)
        for rule in target.rules
        if not rule.optional and find_column(rule.source, df.columns) is None
    ]


def check_required(df: DataFrame, rules: Iterable[ColumnRule]) -> DataFrame:
    """The input unchanged, or an error naming every missing required source column."""
    missing = missing_required(df, rules)
    if missing:
        raise SpecError(f"required columns not found: {', '.join(missing)}")
    return df


def project_mapped(df: DataFrame, rules: Iterable[ColumnRule]) -> DataFrame:
    """Raw values of the single-source targets, in rule order, under their output names.

    An optional source that the input does not have leaves its target out.
    """
    rules = list(rules)
    check_required(df, rules)
    chosen = []
    for target in targets(rules):
        found = find_column(target.rules[0].source, df.columns)
        if not target.is_list and found is not None:
            chosen.append(col(found).alias(target.name))
    return df.select(chosen)

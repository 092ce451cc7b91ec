"""Rules and comparison specs: small driver-side arguments, checked on construction."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property

# The data types, and the accepted spellings of List and Required.
DATA_TYPES = ("CODE", "INTEGE", "DECIMA", "DATE")
LIST_VALUES = ("Y", "N")
REQUIRED_VALUES = ("YES", "NO", "Y", "N")
NB, RN = "NB", "RN"
OVERALL = "Overall"
MISSING, OUT_OF_RANGE = "Missing", "Out of Range"


class SpecError(ValueError):
    """A rule, band or request that cannot be run."""


def _field(row: Mapping, header: str):
    if header not in row:
        raise SpecError(f"rule table has no column {header!r}")
    return row[header]


@dataclass(frozen=True)
class ColumnRule:
    """One source column and what becomes of it."""

    source: str
    target: str
    data_type: str
    is_list: bool = False
    optional: bool = False

    def __post_init__(self):
        object.__setattr__(self, "source", str(self.source).strip())
        object.__setattr__(self, "target", str(self.target).strip().upper())
        object.__setattr__(self, "data_type", str(self.data_type).strip().upper())
        if self.data_type not in DATA_TYPES:
            raise SpecError(f"data type {self.data_type!r} is not one of {', '.join(DATA_TYPES)}")

    @classmethod
    def from_row(cls, row: Mapping) -> ColumnRule:
        """Rule from a row with headers Original Column, New Column, Data Type, List, Required."""
        is_list = str(_field(row, "List")).strip().upper()
        required = str(_field(row, "Required")).strip().upper()
        if is_list not in LIST_VALUES:
            raise SpecError(f"List value {is_list!r} is not one of {', '.join(LIST_VALUES)}")
        if required not in REQUIRED_VALUES:
            raise SpecError(f"Required value {required!r} is not one of {', '.join(REQUIRED_VALUES)}")
        return cls(
            _field(row, "Original Column"),
            _field(row, "New Column"),
            _field(row, "Data Type"),
            is_list == "Y",
            required in ("NO", "N"),
        )


@dataclass(frozen=True)
class Target:
    """One output column with the rules that feed it, in rule order."""

    name: str
    rules: tuple[ColumnRule, ...]

    @property
    def is_list(self) -> bool:
        return len(self.rules) > 1 or self.rules[0].is_list

    @property
    def data_type(self) -> str:
        return self.rules[0].data_type


def targets(rules: Iterable[ColumnRule]) -> list[Target]:
    """Rules grouped by target; a repeated source keeps its first place and its last rule."""
    by_source = {}
    for rule in rules:
        by_source[rule.source] = rule
    if not by_source:
        raise SpecError("no column rules given")
    by_target: dict[str, list[ColumnRule]] = {}
    for rule in by_source.values():
        by_target.setdefault(rule.target, []).append(rule)
    return [Target(name, tuple(group)) for name, group in by_target.items()]


@dataclass(frozen=True)
class Band:
    """A band starts at ``start`` (included) and ends before the next band's start."""

    name: str
    start: float

    @classmethod
    def from_row(cls, row: Mapping) -> Band:
        """Band from a row with headers Name, From."""
        return cls(str(_field(row, "Name")), float(_field(row, "From")))


def check_bands(bands: Sequence[Band]) -> tuple[Band, ...]:
    bands = tuple(bands)
    if not bands:
        raise SpecError("no bands given")
    names = [band.name for band in bands]
    starts = [band.start for band in bands]
    if len(set(names)) < len(names):
        raise SpecError("band names must differ")
    if any(start is None or math.isnan(start) or start == math.inf for start in starts):
        raise SpecError("band starts must be numbers below infinity")
    if any(a >= b for a, b in zip(starts, starts[1:])):
        raise SpecError("band starts must ascend")
    return bands


@dataclass(frozen=True)
class StageRule:
    """Where one item's value at one stage comes from; ``rn_column`` is its renewal version."""

    id_column: str
    item: str
    stage: int
    stage_name: str
    table: str
    column: str
    rn_column: str | None = None

    @classmethod
    def from_row(cls, row: Mapping) -> StageRule:
        """Rule from a row with headers ID, Item, Stage, StageName, File, Column and maybe RNColumn."""
        rn_column = row.get("RNColumn")
        if not isinstance(rn_column, str) or not rn_column.strip():
            rn_column = None
        return cls(
            _field(row, "ID"),
            str(_field(row, "Item")),
            int(_field(row, "Stage")),
            str(_field(row, "StageName")),
            str(_field(row, "File")),
            str(_field(row, "Column")),
            rn_column,
        )


@dataclass(frozen=True)
class Step:
    """The move between two stages of one item; number 0 is first to last."""

    item: str
    segment: str
    number: int
    name: str
    from_stage: int
    to_stage: int
    from_column: str
    to_column: str

    @property
    def suffix(self) -> str:
        return f"{self.item}_step_{self.number}" + ("_rn" if self.segment == RN else "")

    @property
    def diff_column(self) -> str:
        return f"diff_{self.suffix}"

    @property
    def percent_column(self) -> str:
        return f"percent_diff_{self.suffix}"


class Comparison:
    """Items, stages and steps of a staged comparison, built from stage rules."""

    def __init__(self, rules: Iterable[StageRule], renewal: bool = False):
        self.rules = tuple(rules)
        self.renewal = renewal
        if not self.rules:
            raise SpecError("no stage rules given")
        self.id_column = self.rules[0].id_column
        by_item: dict[str, dict[int, StageRule]] = {}
        for rule in self.rules:
            by_item.setdefault(rule.item, {})[rule.stage] = rule
        self._stages = {
            item: [rules_of[stage] for stage in sorted(rules_of)] for item, rules_of in by_item.items()
        }
        for item, stages in self._stages.items():
            names = [rule.stage_name for rule in stages]
            repeated = sorted({name for name in names if names.count(name) > 1})
            if repeated:  # reports have a column or cell for each name
                raise SpecError(f"item {item!r} has more than one stage named {', '.join(map(repr, repeated))}")

    @property
    def items(self) -> list[str]:
        return list(self._stages)

    def stages(self, item: str) -> list[StageRule]:
        """The item's rules in stage order."""
        if item not in self._stages:
            raise SpecError(f"unknown item {item!r}; items are {', '.join(self.items)}")
        return self._stages[item]

    def source(self, rule: StageRule, segment: str = NB) -> str | None:
        return rule.column if segment == NB else rule.rn_column

    def column(self, rule: StageRule, segment: str = NB) -> str | None:
        """Merged column of a stage: ``{item}_{stage}``, with ``_rn`` for the renewal version."""
        name = f"{rule.item}_{rule.stage}"
        if segment == NB:
            return name
        return f"{name}_rn" if self.renewal and rule.rn_column is not None else None

    @property
    def segments(self) -> tuple[str, ...]:
        return (NB, RN) if self.renewal else (NB,)

    @property
    def base_table(self) -> str:
        return self._stages[self.items[0]][0].table

    @property
    def tables(self) -> list[str]:
        """Distinct tables, the base table first."""
        used = [rule.table for item in self.items for rule in self._stages[item]]
        return list(dict.fromkeys([self.base_table, *used]))

    @cached_property
    def stage_columns(self) -> list[tuple[str, str, str]]:
        """(table, source column, merged column) for every stage of every item and segment."""
        found = []
        for item in self.items:
            for segment in self.segments:
                for rule in self._stages[item]:
                    name = self.column(rule, segment)
                    if name is not None:
                        found.append((rule.table, self.source(rule, segment), name))
        return found

    def stage_names(self) -> list[str]:
        """Stage names of all items, in order of first appearance."""
        return list(dict.fromkeys(rule.stage_name for item in self.items for rule in self._stages[item]))

    def steps(self, item: str, segment: str = NB) -> list[Step]:
        """Overall step first, then one step per pair of neighbouring stages."""
        stages = self.stages(item)
        if len(stages) < 2:
            return []
        pairs = [(0, OVERALL, stages[0], stages[-1])]
        pairs += [(a.stage, b.stage_name, a, b) for a, b in zip(stages, stages[1:])]
        # A step replaces an earlier one of the same number.
        steps = {}
        for number, name, a, b in pairs:
            from_column, to_column = self.column(a, segment), self.column(b, segment)
            if from_column is not None and to_column is not None:
                steps[number] = Step(item, segment, number, name, a.stage, b.stage, from_column, to_column)
        return [steps[number] for number in sorted(steps)]

    def all_steps(self, segments: Sequence[str] | None = None) -> list[Step]:
        chosen = self.segments if segments is None else segments
        return [step for item in self.items for segment in chosen for step in self.steps(item, segment)]

    def step(self, item: str, number: int, segment: str = NB) -> Step:
        if segment not in (NB, RN):
            raise SpecError(f"segment must be {NB} or {RN}, not {segment!r}")
        found = {step.number: step for step in self.steps(item, segment)}
        if number not in found:
            raise SpecError(f"item {item!r} has no step {number} for {segment}; steps are {sorted(found)}")
        return found[number]

"""Rule-driven table conversion and staged comparison on Spark DataFrames."""

from steploom.plans.conversion import run_conversion
from steploom.plans.impact import Impact, analyse
from steploom.specs import Band, ColumnRule, Comparison, SpecError, StageRule

__all__ = ["Band", "ColumnRule", "Comparison", "Impact", "SpecError", "StageRule", "analyse", "run_conversion"]

"""Registered queries against their SQL, and contract columns."""

import pytest

from steploom.llm.oracle import ORACLE
from steploom.llm.queries import QUERIES
from suite.compare import _rows, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    got, want = QUERIES[name](spark, SF).toArrow(), connect(SF).execute(ORACLE[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert _rows(got) == _rows(want)


def test_main_path_of_native_operators_has_no_python(spark):
    for name in ("op1_decontaminate", "op3_licences", "op7_line_dedup", "op13_sharding"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow")), name

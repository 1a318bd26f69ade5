"""Every registered plan: no all-pairs join operators in the physical plan,
and scans read only the columns the plan needs."""

import pytest

SF = "/root/testdata/sf0.001"
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")


def _plans():
    import __spark_entry__ as E
    return sorted(E.queries().items())


@pytest.mark.parametrize("name,fn", _plans(), ids=[n for n, _ in _plans()])
def test_no_all_pairs_join(spark, name, fn):
    df = fn(spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for op in FORBIDDEN:
        assert op not in plan, f"{name} plans a {op}"


def test_text_plan_prunes_columns(spark):
    import __spark_entry__ as E
    df = E.queries()["text_clean"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan

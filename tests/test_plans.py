"""Plan properties over every registered query."""

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
USES_HTML_EXTRACTION = {"x9_extract_main_text", "x6_link_prompt", "m9_request_outcome", "x13_skip_notice"}


def test_plan_properties(spark):
    bad = []
    for name, fn in sorted(E.queries().items()):
        plan = fn(spark, SF)._jdf.queryExecution().executedPlan().toString()
        if "BatchEvalPython" in plan or "ArrowEvalPython" in plan:
            bad.append((name, "python udf"))
        if "MapInPandas" in plan and name not in USES_HTML_EXTRACTION:
            bad.append((name, "mapInPandas"))
        if "CartesianProduct" in plan or "BroadcastNestedLoopJoin" in plan:
            bad.append((name, "nested loop / cartesian"))
    assert bad == []


def test_permutation_invariance(spark):
    from pyspark.sql import functions as F
    from tidewire.operators import similarity as G
    from tidewire.plans.queries import ingested
    from tidewire.sources import fixtures as X
    snap = ingested(spark, SF)
    a = {(r.id, r.story_group_id, r.is_duplicate) for r in G.story_groups(snap, X.as_of()).collect()}
    shuffled = snap.orderBy(F.rand(5)).repartition(3)
    b = {(r.id, r.story_group_id, r.is_duplicate) for r in G.story_groups(shuffled, X.as_of()).collect()}
    assert a == b

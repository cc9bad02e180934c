"""Every registered query: no cross / nested-loop joins, no row caps, no samples, in its result and in its passes."""

import pytest

from ridgeline.operators import passes
from ridgeline.workload.queries import QUERIES

from conftest import SF001

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "GlobalLimit", "LocalLimit", "CollectLimit", "TakeOrdered", "Sample")
FITS = {n for n in QUERIES if n.endswith("_fit") and n not in ("lbfgs_logistic_fit", "ml_linear_fit")}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_has_no_cross_join_or_row_cap(spark, name, monkeypatch):
    plans = []

    def kept(base, sums, run=passes.bucketed):
        out = run(base, sums)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(passes, "bucketed", kept)
    df = QUERIES[name](spark, SF001)
    arrow = name in ("cg_array_fit", "lbfgs_sparse_fit") or name.startswith("wide_")
    assert arrow or name not in FITS or plans, "a fit ran without a recorded pass"
    for plan in [*plans, df._jdf.queryExecution().executedPlan().toString()]:
        for op in FORBIDDEN:
            assert op not in plan, f"{name}: {op} in plan"


def test_partial_sums_meet_in_two_steps(spark, lineitem01):
    from ridgeline.workload.fixtures import LIN3

    plan = passes.loss_table(LIN3.design(lineitem01), (0.5, -0.25, 0.1))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("SinglePartition") < plan.index("hashpartitioning(_bucket")


def test_a_pass_of_a_fit_adds_up_without_a_key(spark):
    base = spark.createDataFrame([(k, float(k)) for k in range(100)], "k long, v double").repartition(7)
    out = passes.bucketed(base, {"n": "count(v)", "s": "sum(v)"})
    assert [tuple(r) for r in out.collect()] == [(100, 4950.0)]
    assert "HashAggregate(keys=[]" in out._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in passes.bucketed(base.filter("k < 0"), {"n": "count(v)", "s": "sum(v)"}).collect()] == [(0, None)]


def test_a_fit_starts_no_job_before_its_first_pass(spark, lineitem01, monkeypatch):
    import ridgeline as rl
    from ridgeline.workload.fixtures import LIN3

    seen = []
    first = passes.Evaluator._run

    def run(self, *a):
        seen.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup("fit")))
        return first(self, *a)

    monkeypatch.setattr(passes.Evaluator, "_run", run)
    spark.sparkContext.setJobGroup("fit", "fit")
    try:
        rl.fit_linear(LIN3.design(lineitem01.groupBy("l_orderkey", "l_linenumber").agg(*[_max(c) for c in ("l_extendedprice", "l_quantity", "l_discount")])), max_iter=1)
    finally:
        spark.sparkContext._jsc.sc().clearJobGroup()
    assert seen[0] == 0


def _max(c):
    from pyspark.sql import functions as F

    return F.max(c).alias(c)

"""Single-pass operators: gradient vs finite differences, form A vs B, SQL-text vs Column paths, plans."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import ridgeline as rl
from ridgeline.operators.passes import GramEvaluator
from ridgeline.workload.fixtures import LIN3, LOG2, embedding_design

from conftest import SF01

W_LIN = (0.5, -0.25, 0.1)


@pytest.fixture(scope="module")
def lin3(lineitem01):
    return LIN3.design(lineitem01)


def _np_lin3(lineitem01):
    pdf = lineitem01.select("l_quantity", "l_discount", "l_extendedprice").toPandas()
    x = np.c_[pdf.l_quantity / 50, pdf.l_discount * 10, np.ones(len(pdf))]
    return x, pdf.l_extendedprice.to_numpy() / 100000


def test_fused_pass_matches_numpy(lin3, lineitem01):
    x, y = _np_lin3(lineitem01)
    w = np.array(W_LIN)
    f, g = rl.Evaluator(lin3, "squared").value_and_gradient(w)
    r = x @ w - y
    assert f == pytest.approx(0.5 * np.mean(r * r), rel=1e-12)
    np.testing.assert_allclose(g, x.T @ r / len(y), rtol=1e-11)


def test_tables_match_evaluator(lin3):
    f, g = rl.Evaluator(lin3, "squared").value_and_gradient(W_LIN)
    rows = rl.gradient_table(lin3, W_LIN).orderBy("feature_index").collect()
    assert [r.feature for r in rows] == ["qty", "disc", "bias"]
    np.testing.assert_allclose([r.gradient for r in rows], g, rtol=1e-12)
    t = rl.loss_table(lin3, W_LIN).first()
    assert t.n == 60000 and t.loss == pytest.approx(f, rel=1e-12)


def test_gram_matches_passes(lin3):
    ev = rl.Evaluator(lin3, "squared", reg_param=0.1)
    gram = GramEvaluator(rl.Evaluator(lin3, "squared", reg_param=0.1))
    for w in (W_LIN, (0.0, 0.0, 0.0), (1.0, 2.0, -3.0)):
        f1, g1 = ev.value_and_gradient(w)
        f2, g2 = gram.value_and_gradient(w)
        assert f2 == pytest.approx(f1, rel=1e-9)
        np.testing.assert_allclose(g2, g1, rtol=1e-9, atol=1e-12)


def test_probe_matches_point_evaluations(lineitem01):
    ds = LOG2.design(lineitem01)
    ev = rl.Evaluator(ds, "logistic", reg_param=0.05)
    w, d = np.array([0.3, -0.7]), np.array([-0.2, -0.3])
    trials = ev.probe(w, d, [0.5, 2.0], grad_for=2)
    for t in trials:
        f, g = ev.value_and_gradient(w + t.alpha * d)
        assert t.loss == pytest.approx(f, rel=1e-12)
        assert t.slope == pytest.approx(float(d @ g), rel=1e-9)
        np.testing.assert_allclose(t.grad, g, rtol=1e-10)


def test_partitioning_does_not_change_gradient(lin3):
    base = rl.Evaluator(lin3, "squared").value_and_gradient(W_LIN)[1]
    for n in (1, 3, 8):
        ds = rl.Design(lin3.df.repartition(n), lin3.features, bias=True)
        np.testing.assert_allclose(rl.Evaluator(ds, "squared").value_and_gradient(W_LIN)[1], base, rtol=1e-12)


def test_array_form_equals_column_form(spark):
    arr = embedding_design(spark, SF01, width=4, keep=("embedding",))
    cols = rl.labeled_points(
        arr.df, "label", {f"e{j}": F.col("embedding")[j].cast("double") for j in range(4)}, bias=True
    )
    w = [0.1, -0.2, 0.3, -0.4, 0.05]
    _, g_arr = rl.Evaluator(arr, "logistic").value_and_gradient(w)
    _, g_col = rl.Evaluator(cols, "logistic").value_and_gradient(w)
    np.testing.assert_allclose(g_arr, g_col, rtol=1e-12)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    seed=st.integers(0, 10_000),
    loss=st.sampled_from(["squared", "logistic"]),
    reg=st.sampled_from([0.0, 0.3]),
)
def test_gradient_is_derivative_of_loss(spark, seed, loss, reg):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(25, 3))
    y = (rng.random(25) > 0.5).astype(float) if loss == "logistic" else rng.normal(size=25)
    df = spark.createDataFrame([(float(a), float(b), float(c), float(t)) for (a, b, c), t in zip(x, y)], "a double, b double, c double, y double")
    ds = rl.labeled_points(df, "y", ["a", "b", "c"], bias=True)
    ev = rl.Evaluator(ds, loss, reg)
    w = rng.normal(size=4)
    _, g = ev.value_and_gradient(w)
    h = 1e-5
    for j in range(4):
        e = np.zeros(4)
        e[j] = h
        num = (ev.value_and_gradient(w + e)[0] - ev.value_and_gradient(w - e)[0]) / (2 * h)
        assert num == pytest.approx(g[j], rel=1e-5, abs=1e-8)


def test_line_search_profile_flags(lineitem01):
    ds = LOG2.design(lineitem01)
    w, d = [0.3, -0.7], [-0.2, -0.3]
    rows = rl.line_search_profile(ds, w, d, [0.25, 1.0, 4.0], "logistic").collect()
    ev = rl.Evaluator(ds, "logistic")
    f0, g0 = ev.value_and_gradient(w)
    s0 = float(np.dot(d, g0))
    assert s0 < 0
    for r in rows:
        assert r.armijo_ok == (r.loss <= f0 + 1e-4 * r.alpha * s0)
        assert r.curvature_ok == (abs(r.slope) <= -0.1 * s0)


def test_pass_plan_is_one_pruned_scan_and_an_aggregate(lineitem01):
    plan = rl.gradient_table(LIN3.design(lineitem01), W_LIN)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_discount:double>" in plan
    assert plan.count("FileScan") == 1 and "Python" not in plan


@pytest.mark.parametrize("dim", [12, 13, 94, 95, 300])
def test_forms_agree_at_any_width(spark, dim):
    """Columns, arrays and sparse rows: same loss, gradient, trials, names and weights."""
    rng = np.random.default_rng(dim)
    x = np.round(rng.normal(size=(40, dim)), 3) * (rng.random((40, dim)) < 0.5)
    y = (x[:, 0] + rng.normal(size=40) > 0).astype(float)
    names = [f"name_{j}" for j in range(dim)]
    df = spark.createDataFrame([(float(t), row.tolist()) for row, t in zip(x, y)], "y double, f array<double>")
    array = rl.array_points(df, "y", "f", dim, bias=True, names=names)
    columns = rl.labeled_points(df, "y", {n: F.col("f")[j] for j, n in enumerate(names)}, bias=True)
    pairs = F.filter(F.transform("f", lambda v, i: F.struct(i.alias("i"), v.alias("v"))), lambda p: p["v"] != 0)
    sparse = rl.sparse_points(df.withColumn("p", pairs), "y", F.col("p.i"), F.col("p.v"), dim, bias=True, names=names)
    evs = [rl.Evaluator(array, "logistic", 0.1), rl.Evaluator(sparse, "logistic", 0.1), rl.Evaluator(columns, "logistic", 0.1, form="arrow")]
    assert [e.form for e in evs] == ["arrow"] * 3
    if dim <= 95:
        evs.append(rl.Evaluator(columns, "logistic", 0.1))
        assert evs[-1].form == "elements"
    w, d = np.linspace(-0.1, 0.1, dim + 1), np.linspace(0.05, -0.05, dim + 1)
    f, g = evs[0].value_and_gradient(w)
    t = evs[0].probe(w, d, [0.5, 2.0], grad_for=2)
    for e in evs[1:]:
        f2, g2 = e.value_and_gradient(w)
        assert f2 == pytest.approx(f, rel=1e-12) and e.value(w) == pytest.approx(f, rel=1e-12)
        np.testing.assert_allclose(g2, g, rtol=1e-9, atol=1e-14)
        for a, b in zip(t, e.probe(w, d, [0.5, 2.0], grad_for=2)):
            assert b.loss == pytest.approx(a.loss, rel=1e-12) and b.slope == pytest.approx(a.slope, rel=1e-9, abs=1e-14)
            np.testing.assert_allclose(b.grad, a.grad, rtol=1e-9, atol=1e-14)
    rows = rl.gradient_table(array, w, "logistic", 0.1).orderBy("feature_index").collect()
    assert [r.feature for r in rows] == [*names, "bias"]
    np.testing.assert_allclose([r.gradient for r in rows], g, rtol=1e-12)
    if dim in (13, 300):
        a, b = (rl.fit_logistic(ds, reg_param=0.1, max_iter=8) for ds in (array, sparse))
        np.testing.assert_allclose(a.weights, b.weights, atol=1e-9)
        assert a.iterations == b.iterations and a.final_loss == pytest.approx(b.final_loss, rel=1e-9)


def test_one_row_rule_for_columns_and_arrays(spark):
    nan = float("nan")
    rows = [(0.0, [1.0, 2.0]), (1.0, [nan, 2.0]), (1.0, [None, 2.0]), (None, [1.0, 1.0]), (nan, [1.0, 1.0]), (1.0, None), (1.0, [3.0, 4.0])]
    df = spark.createDataFrame(rows, "y double, f array<double>")
    array = rl.array_points(df, "y", "f", 2)
    columns = rl.labeled_points(df, "y", {"x0": F.col("f")[0], "x1": F.col("f")[1]})
    assert array.dropped_rows() == columns.dropped_rows() == 5
    a, b = rl.Evaluator(array), rl.Evaluator(columns)
    np.testing.assert_allclose(a.value_and_gradient([0.5, 0.1])[1], b.value_and_gradient([0.5, 0.1])[1])
    assert a.n == b.n == 2
    assert rl.fit_linear(array).report_df(spark).first().dropped_rows == 5
    for bad in ([1.0], [1.0, 2.0, 3.0]):
        wrong = rl.array_points(spark.createDataFrame([(1.0, bad)], "y double, f array<double>"), "y", "f", 2)
        with pytest.raises(Exception, match="an array of 2 features is expected"):
            rl.Evaluator(wrong).value_and_gradient([0.0, 0.0])


def test_rows_without_a_loss_are_not_counted(spark):
    df = spark.createDataFrame([(0.0, 1.0), (1.0, 2.0), (None, 3.0), (None, 4.0)], "y double, a double")
    ds = rl.labeled_points(df, "y", ["a"], drop_nulls=False)
    ev = rl.Evaluator(ds, "logistic")
    f, _ = ev.value_and_gradient([0.3])
    assert ev.n == 2 and f == pytest.approx(rl.loss_table(ds, [0.3], "logistic").first().loss)


@pytest.mark.parametrize("solver", ["gram", "passes"])
def test_final_loss_under_a_large_label_level(spark, solver):
    x = np.arange(1000) / 1000
    r = 5e-4 * (-1) ** np.arange(1000)
    df = spark.createDataFrame([(float(1e8 + 3 * a + e), float(a)) for a, e in zip(x, r)], "y double, a double")
    res = rl.fit_linear(rl.labeled_points(df, "y", ["a"], bias=True), solver=solver)
    assert res.final_loss == pytest.approx(1.25e-7, rel=0.05)


def test_table_operators_include_ridge_like_the_evaluator(lineitem01):
    ds = LOG2.design(lineitem01)
    w, d, reg = np.array([0.3, -0.7]), np.array([-0.2, -0.3]), 0.25
    ev = rl.Evaluator(ds, "logistic", reg_param=reg)
    f, g = ev.value_and_gradient(w)
    assert rl.loss_table(ds, w, "logistic", reg).first().loss == pytest.approx(f, rel=1e-12)
    rows = rl.gradient_table(ds, w, "logistic", reg).orderBy("feature_index").collect()
    np.testing.assert_allclose([r.gradient for r in rows], g, rtol=1e-11)
    prof = rl.line_search_profile(ds, w, d, [0.5, 2.0], "logistic", reg).orderBy("alpha").collect()
    for r, t in zip(prof, ev.probe(w, d, [0.5, 2.0])):
        assert r.loss == pytest.approx(t.loss, rel=1e-12) and r.slope == pytest.approx(t.slope, rel=1e-10)

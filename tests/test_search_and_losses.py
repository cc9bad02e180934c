"""The differenced objective, pass counts, losses and updaters as parameters, batches."""

from decimal import Decimal, getcontext

import numpy as np
import pytest
from pyspark.sql import functions as F

import ridgeline as rl
from ridgeline.functions.losses import LogisticLoss, SquaredLoss, get_loss, hinge_loss, huber_loss
from ridgeline.operators.passes import merged_moments
from ridgeline.plans.lbfgs import two_loop
from ridgeline.workload.fixtures import LIN3, LIN_NET, LOG_SIG, embedding_design, lineitem_design

from conftest import SF01

SF1 = "/root/testdata/sf0.1"


def exact_change(m, q, y):
    """log(1 + e^(m+q)) - log(1 + e^m) - y*q with 60 digits."""
    getcontext().prec = 60
    m, q, y = map(Decimal, (m, q, y))
    return float((1 + (m + q).exp()).ln() - (1 + m.exp()).ln() - y * q)


@pytest.mark.parametrize("loss", ["logistic", "squared"])
def test_change_keeps_its_digits(spark, loss):
    ls = get_loss(loss)
    cases = [(m, q, y) for m in (-30.0, -2.5, -1e-9, 0.0, 0.3, 7.0, 40.0) for q in (-50.0, -1.0, -1e-3, -1e-9, 1e-14, 1e-9, 0.4, 3.0) for y in (0.0, 1.0, 0.25)]
    df = spark.createDataFrame(cases, "m double, q double, y double")
    got = [r[0] for r in df.selectExpr(f"CAST({ls.change_sql('m', 'q', 'y')} AS DOUBLE)").collect()]
    m, q, y = (np.array(c) for c in zip(*cases))
    batch = ls.change_of_batch(m, q, y)
    for k, (a, b, c) in enumerate(cases):
        want = exact_change(a, b, c) if loss == "logistic" else float(Decimal(b) * (Decimal(a) - Decimal(c) + Decimal(b) / 2))
        # to the digits of q for a label in between or a large step, else to those of the change itself
        room = 1e-14 * abs(b) if loss == "logistic" and (c == 0.25 or abs(b) > 1) else 1e-13 * abs(want)
        assert abs(got[k] - want) <= room + 1e-14 * (abs(b) > 1) * (abs(a) + abs(b)), cases[k]
        assert abs(batch[k] - want) <= room + 1e-14 * (abs(b) > 1) * (abs(a) + abs(b)), cases[k]


@pytest.mark.parametrize("form", ["elements", "arrow"])
def test_a_million_equal_rows_near_the_optimum(spark, form):
    """Steps whose effect drowns in the loss itself are still told apart."""
    df = spark.range(1_000_000).select(F.lit(1.0).alias("a"), (F.col("id") % 4 == 0).cast("double").alias("y"))
    ev = rl.Evaluator(rl.labeled_points(df, "y", ["a"]), "logistic", form=form)
    best = np.log(0.25 / 0.75)
    w = np.array([best + 1e-9])
    steps = [0.5, 0.9, 1.0, 1.1, 1.5]
    trials = ev.probe(w, np.array([-1e-9]), steps)
    curve = 0.25 * 0.75
    for a, t in zip(steps, trials):
        want = curve * 1e-18 * (0.5 * (1 - a) ** 2 - 0.5)
        assert t.change == pytest.approx(want, rel=1e-4) and ev.n == 1_000_000
    assert len({t.loss for t in trials}) == 1  # the losses themselves cannot tell


def test_pass_counts_at_sf01(spark):
    log = rl.fit_logistic(lineitem_design(spark, SF1, LOG_SIG))
    assert log.total_passes <= 15 and log.passes["zoom"] <= 2 * log.iterations
    lin = rl.fit_linear(lineitem_design(spark, SF1, LIN_NET), solver="passes", line_search="wolfe")
    assert lin.total_passes <= 6
    np.testing.assert_allclose(lin.weights, rl.fit_linear(lineitem_design(spark, SF1, LIN_NET), solver="gram").weights, atol=1e-7)


def test_moments_merge_about_each_others_means():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1000, 3)) + 1e8
    parts = [(len(p), p.mean(axis=0), np.cov(p.T, bias=True)) for p in np.split(x, [10, 400, 401, 900])]
    parts = [(n, m, np.zeros((3, 3)) if n == 1 else c) for n, m, c in parts]
    n, mean, cov = merged_moments(parts, 3)
    assert n == 1000
    np.testing.assert_allclose(mean, x.mean(axis=0), rtol=1e-14)
    np.testing.assert_allclose(cov, np.cov(x.T, bias=True), atol=1e-7)


# --- losses ------------------------------------------------------------------------
def test_checked_losses(spark):
    assert hinge_loss().checked(spark, kinks=1) == hinge_loss() and huber_loss(0.7).checked(spark, kinks=4)
    with pytest.raises(ValueError, match="slope"):
        rl.SqlLoss("bad", "{z} * {z}", "{z}").checked(spark)
    with pytest.raises(ValueError, match="not smooth"):
        rl.SqlLoss("bent", "2.0D * {z} * {z}", "4.0D * {z}", "3.0D").checked(spark)
    with pytest.raises(ValueError, match="not smooth"):
        hinge_loss().checked(spark, margins=[1.0, -1.0])
    with pytest.raises(TypeError, match="slope_sql"):
        get_loss(object())
    with pytest.raises(ValueError, match="states no curvature"):
        hinge_loss().curvature_sql("z", "y")


def test_sql_loss_equals_the_built_in_one_in_every_form(spark):
    own = rl.SqlLoss("own", LogisticLoss().term_sql("{z}", "{y}"), LogisticLoss().slope_sql("{z}", "{y}"), LogisticLoss().curvature_sql("{z}", "{y}"))
    arr = embedding_design(spark, SF01, width=4, keep=("embedding",))
    cols = rl.labeled_points(arr.df, "label", {f"x{j}": F.col("embedding")[j] for j in range(4)}, bias=True)
    sparse = rl.sparse_points(arr.df, "label", F.array(*[F.lit(j) for j in range(4)]), "features", 4, bias=True)
    w, d = np.array([0.1, -0.2, 0.3, 0.0, 0.05]), np.array([0.3, 0.1, -0.1, 0.2, 0.1])
    ref = rl.Evaluator(cols, "logistic", 0.1)
    f, g = ref.value_and_gradient(w)
    t = ref.probe(w, d, [0.5, 2.0], grad_for=2)
    for ds in (cols, arr, sparse):
        ev = rl.Evaluator(ds, own.checked(spark), 0.1)
        f2, g2 = ev.value_and_gradient(w)
        assert f2 == pytest.approx(f, rel=1e-12) and ev.value(w) == pytest.approx(f, rel=1e-12)
        np.testing.assert_allclose(g2, g, rtol=1e-10)
        for a, b in zip(t, ev.probe(w, d, [0.5, 2.0], grad_for=2)):
            assert b.change == pytest.approx(a.change, rel=1e-9) and b.slope == pytest.approx(a.slope, rel=1e-9)
            np.testing.assert_allclose(b.grad, a.grad, rtol=1e-9)
    a, b = rl.fit_cg(arr, own, reg_param=0.1), rl.fit_cg(cols, "logistic", reg_param=0.1)
    np.testing.assert_allclose(a.weights, b.weights, atol=1e-6)


def test_huber_ignores_outliers(spark):
    x = np.arange(200) / 100
    y = 2 * x + 1
    y[::20] += 50
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "a double, y double")
    r = rl.fit_cg(rl.labeled_points(df, "y", ["a"], bias=True), "huber", max_iter=200)
    np.testing.assert_allclose(r.weights, [2.0, 1.0], atol=0.2)


# --- updaters and L-BFGS --------------------------------------------------------------
def test_two_loop_is_exact_on_a_quadratic():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(4, 4))
    a = a @ a.T + np.eye(4)
    s = [np.eye(4)[k] for k in range(4)]
    # conjugate steps: the recursion gives Newton's direction
    base = []
    for v in s:
        for u in base:
            v = v - u * float(u @ a @ v) / float(u @ a @ u)
        base.append(v)
    g = rng.normal(size=4)
    np.testing.assert_allclose(two_loop(g, [(u, a @ u) for u in base]), -np.linalg.solve(a, g), rtol=1e-9)


def wide_and_thin(spark):
    arr = embedding_design(spark, SF01, width=6, keep=("embedding",))
    cols = rl.labeled_points(arr.df, "label", {f"x{j}": F.col("embedding")[j] for j in range(6)}, bias=True)
    sparse = rl.sparse_points(arr.df, "label", F.array(*[F.lit(j) for j in range(6)]), "features", 6, bias=True)
    return cols, arr, sparse


def test_lbfgs_on_every_design(spark):
    cols, arr, sparse = wide_and_thin(spark)
    ref = rl.fit_logistic(cols, reg_param=0.1).weights
    for ds in (cols, arr, sparse):
        r = rl.fit_lbfgs(ds, reg_param=0.1)
        np.testing.assert_allclose(r.weights, ref, atol=1e-6)
        assert r.stop_reason in ("gradient", "step") and r.method == "lbfgs_own"
    np.testing.assert_allclose(rl.fit_lbfgs(cols, updater=rl.ridge(0.1)).weights, ref, atol=1e-6)
    np.testing.assert_allclose(rl.fit_logistic(arr, updater=rl.ridge(0.1)).weights, ref, atol=1e-6)


@pytest.mark.parametrize("weight", [0.001, 0.02, 0.5, (0.0, 0.01, 0.01, 0.2, 0.0, 0.01, 0.0)])
def test_l1_meets_its_conditions(spark, weight):
    cols, arr, sparse = wide_and_thin(spark)
    v = np.broadcast_to(weight, 7)
    seen = []
    for ds in (cols, arr, sparse):
        r = rl.fit_logistic(ds, reg_param=0.01, updater=rl.l1(weight))
        _, g = rl.Evaluator(ds, "logistic", 0.01).value_and_gradient(r.weights)
        zero = r.weights == 0
        assert (np.abs(g[zero]) <= v[zero] + 1e-8).all()
        np.testing.assert_allclose(g[~zero], -v[~zero] * np.sign(r.weights[~zero]), atol=1e-6)
        seen.append(r.weights)
    np.testing.assert_allclose(seen[1], seen[0], atol=1e-5)
    np.testing.assert_allclose(seen[2], seen[0], atol=1e-5)
    if weight == 0.5:
        assert zero.all()


def test_bounds_meet_their_conditions(spark):
    cols, arr, sparse = wide_and_thin(spark)
    lo, hi = -0.05, 0.1
    for ds in (cols, arr, sparse):
        r = rl.fit_logistic(ds, reg_param=0.01, updater=rl.bounds(lo, hi))
        _, g = rl.Evaluator(ds, "logistic", 0.01).value_and_gradient(r.weights)
        assert (r.weights >= lo).all() and (r.weights <= hi).all()
        free = (r.weights > lo) & (r.weights < hi)
        np.testing.assert_allclose(g[free], 0, atol=1e-6)
        assert (g[r.weights == lo] >= -1e-9).all() and (g[r.weights == hi] <= 1e-9).all()
    with pytest.raises(ValueError, match="above"):
        rl.fit_logistic(cols, updater=rl.bounds(1.0, 0.0))
    with pytest.raises(ValueError, match="negative"):
        rl.fit_logistic(cols, updater=rl.l1(-1.0))


def test_lbfgs_on_an_empty_table(spark):
    df = spark.createDataFrame([], "a double, y double")
    r = rl.fit_lbfgs(rl.labeled_points(df, "y", ["a"], bias=True), updater=rl.l1(0.1))
    assert r.stop_reason == "empty" and not r.weights.any()


# --- batches -------------------------------------------------------------------------
def test_batches_do_not_depend_on_partitioning(lineitem01):
    kw = dict(step_size=1.0, max_iter=6, tol=0.0, batch_fraction=0.1, batch_key="l_orderkey * 7 + l_linenumber")
    keys = ("l_orderkey", "l_linenumber")
    a = rl.fit_gd(LIN3.design(lineitem01, keep=keys), **kw)
    b = rl.fit_gd(LIN3.design(lineitem01.repartition(13), keep=keys), **kw)
    np.testing.assert_allclose(a.weights, b.weights, atol=1e-12)
    assert a.n_rows == 60000 and a.iterations == 6  # the final loss is over all rows
    other = rl.fit_gd(LIN3.design(lineitem01, keep=keys), seed=12, **kw)
    assert np.abs(other.weights - a.weights).max() > 1e-6


def test_batch_sizes_and_empty_batches(spark, lineitem01):
    from ridgeline.plans.gd import batch_columns, in_batch

    rows = lineitem01.withColumns(batch_columns("l_orderkey * 7 + l_linenumber", 11))
    picks = rows.select(*[in_batch(i, 0.25).cast("int").alias(f"b{i}") for i in (1, 2, 3)])
    r = picks.selectExpr("avg(b1)", "avg(b2)", "avg(b1 * b2)", "avg(b2 * b3)").first()
    np.testing.assert_allclose(r, [0.25, 0.25, 0.0625, 0.0625], atol=0.006)
    df = spark.createDataFrame([(1.0, 2.0, 1)], "a double, y double, k int")
    ds = rl.labeled_points(df, "y", ["a"], keep=["k"])
    res = rl.fit_gd(ds, max_iter=30, tol=0.0, batch_fraction=0.2, batch_key="k")
    assert 0 < len(res.history) < 20  # iterations without rows change nothing
    none = rl.fit_gd(rl.labeled_points(df.limit(0), "y", ["a"], keep=["k"]), max_iter=3, batch_fraction=0.2, batch_key="k")
    assert none.stop_reason == "empty"
    with pytest.raises(ValueError, match="batch_key"):
        rl.fit_gd(ds, batch_fraction=0.5)


def test_squared_is_the_only_quadratic_loss():
    assert SquaredLoss().quadratic and not LogisticLoss().quadratic and not huber_loss().quadratic

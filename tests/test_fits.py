"""Fits: known answers (FIXTURES.md), optimality, agreement between methods, metamorphic and edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import ridgeline as rl
from ridgeline.workload.fixtures import LIN3, LIN_NET, LIN_RAW, LOG2, LOG_SIG


@pytest.fixture(scope="module")
def lin3(lineitem01):
    return LIN3.design(lineitem01)


@pytest.fixture(scope="module")
def log_sig(lineitem01):
    return LOG_SIG.design(lineitem01)


LS_LIN3 = [0.00359323, 0.00680391, 0.52532078]


@pytest.mark.parametrize("solver,line_search", [("gram", "exact"), ("passes", "exact"), ("passes", "wolfe"), ("gram", "wolfe")])
def test_cg_least_squares(lin3, solver, line_search):
    r = rl.fit_cg(lin3, "squared", solver=solver, line_search=line_search, max_iter=50)
    np.testing.assert_allclose(r.weights, LS_LIN3, atol=5e-8)
    assert r.stop_reason in ("gradient", "step")
    assert r.n_rows == 60000


@pytest.mark.parametrize("solver", ["passes", "gram"])
def test_wolfe_search_reaches_least_squares_on_lin_net(lineitem01, solver):
    r = rl.fit_linear(LIN_NET.design(lineitem01), solver=solver, line_search="wolfe", max_iter=50)
    np.testing.assert_allclose(r.weights, [0.98818573, -0.05535229, 0.02748464], atol=5e-6)


def test_cg_linear_preset_lin_net(lineitem01):
    r = rl.fit_linear(LIN_NET.design(lineitem01))
    np.testing.assert_allclose(r.weights, [0.98818573, -0.05535229, 0.02748464], atol=5e-8)
    assert r.iterations <= 10


@pytest.mark.parametrize("solver", ["gram", "passes"])
def test_gd_known_answer(lin3, solver):
    r = rl.fit_gd(lin3, step_size=1.0, max_iter=1000, tol=1e-3, solver=solver)
    assert r.iterations == 61 and r.stop_reason == "step"
    np.testing.assert_allclose(r.weights, [0.0854386, 0.0852831, 0.4399125], atol=1e-7)
    assert len(r.history) == 61


def test_gd_stock_raw_columns(lineitem01):
    r = rl.fit_gd_stock(LIN_RAW.design(lineitem01), step_size=1e-5, max_iter=200, tol=0.01)
    assert r.iterations == 53
    np.testing.assert_allclose(r.weights, [168.2705388, 0.3355502, 6.7066635], atol=1e-6)


def test_gd_not_converged_within_limit(lineitem01):
    r = rl.fit_linear_gd(LIN_NET.design(lineitem01), max_iter=100, step_size=1.0)
    assert r.iterations == 100 and r.stop_reason == "max_iter"
    np.testing.assert_allclose(r.weights, [0.7965107, -0.0514515, 0.1334089], atol=1e-6)


def test_cg_logistic_known_answer(log_sig):
    r = rl.fit_logistic(log_sig)
    np.testing.assert_allclose(r.weights, [4.9322744573, -2.2899554046], atol=1e-6)
    assert r.total_passes < 40


@pytest.mark.parametrize("reg,want", [(0.0, [4.9322744573, -2.2899554046]), (0.1, [0.6164299455, -0.1175961781])])
def test_plain_bracket_and_zoom_search(log_sig, reg, want):
    r = rl.fit_logistic(log_sig, reg_param=reg, newton_steps=False)
    np.testing.assert_allclose(r.weights, want, atol=1e-6)
    assert r.passes["bracket"] > 0 and r.passes["newton"] == 0


def test_sequential_search_same_optimum_more_passes(log_sig):
    seq = rl.fit_logistic(log_sig, newton_steps=False, batched=False)
    bat = rl.fit_logistic(log_sig, newton_steps=False)
    np.testing.assert_allclose(seq.weights, bat.weights, atol=1e-9)  # same decisions, same iterates
    assert seq.iterations == bat.iterations and seq.total_passes > bat.total_passes


def test_newton_candidates_save_passes(log_sig):
    fast = rl.fit_logistic(log_sig, newton_steps=True)
    plain = rl.fit_logistic(log_sig, newton_steps=False)
    assert fast.passes["newton"] > 0
    assert fast.total_passes < plain.total_passes
    np.testing.assert_allclose(fast.weights, plain.weights, atol=1e-6)


def test_cg_logistic_ridge(log_sig):
    r = rl.fit_logistic(log_sig, reg_param=0.1)
    np.testing.assert_allclose(r.weights, [0.6164299455, -0.1175961781], atol=1e-6)


def test_cg_log2(lineitem01):
    r = rl.fit_logistic(LOG2.design(lineitem01))
    np.testing.assert_allclose(r.weights, [-0.0120762447, -0.6835658997], atol=1e-6)


def test_cg_agrees_with_lbfgs(log_sig):
    a = rl.fit_logistic(log_sig).weights
    b = rl.fit_lbfgs_logistic(log_sig).weights
    np.testing.assert_allclose(a, b, atol=1e-5)


def test_loss_never_above_start_and_history(log_sig):
    r = rl.fit_logistic(log_sig)
    losses = [h[1] for h in r.history]
    assert all(b <= a + 1e-12 for a, b in zip(losses, losses[1:]))
    assert r.final_loss <= losses[0]
    h = r.history_df(log_sig.df.sparkSession)
    assert h.count() == 2 * r.iterations


def test_repartitioning_does_not_change_weights(log_sig):
    ref = rl.fit_logistic(log_sig).weights
    for n in (1, 3):
        ds = rl.Design(log_sig.df.repartition(n), log_sig.features, bias=True)
        np.testing.assert_allclose(rl.fit_logistic(ds).weights, ref, atol=1e-5)  # within the step test


def test_permuting_features_permutes_weights(lineitem01):
    label = F.expr(LOG2.label)
    feats = {"qty": F.expr("l_quantity / 50"), "disc": F.expr("l_discount * 10")}
    # converge far below the compared tolerance: the two runs take different rounding paths
    kw = dict(step_tol=1e-13, grad_tol=1e-13)
    a = rl.fit_logistic(rl.labeled_points(lineitem01, label, feats, bias=True), **kw).weights
    b = rl.fit_logistic(rl.labeled_points(lineitem01, label, dict(reversed(list(feats.items()))), bias=True), **kw).weights
    np.testing.assert_allclose([b[1], b[0], b[2]], a, atol=1e-7)


def test_start_at_optimum_and_input_untouched(lin3):
    w0 = np.array(LS_LIN3)
    keep = w0.copy()
    r = rl.fit_cg(lin3, "squared", init=w0, solver="passes")
    assert r.iterations <= 1
    np.testing.assert_array_equal(w0, keep)
    np.testing.assert_allclose(r.weights, LS_LIN3, atol=5e-8)


def _small(spark, rows, schema="a double, b double, y double"):
    return spark.createDataFrame(rows, schema)


def test_empty_table(spark):
    ds = rl.labeled_points(_small(spark, []), "y", ["a", "b"], bias=True)
    for r in (rl.fit_cg(ds, "logistic"), rl.fit_cg(ds, "squared"), rl.fit_gd(ds)):
        assert r.stop_reason == "empty"
        np.testing.assert_array_equal(r.weights, [0.0, 0.0, 0.0])


def test_one_row(spark):
    ds = rl.labeled_points(_small(spark, [(1.0, 2.0, 3.0)]), "y", ["a", "b"], bias=True)
    r = rl.fit_cg(ds, "squared")
    assert float(np.dot(r.weights, [1.0, 2.0, 1.0])) == pytest.approx(3.0, abs=1e-9)


def test_constant_feature_and_nulls(spark):
    rows = [(1.0, 1.0, 2.0), (2.0, 1.0, 3.0), (3.0, 1.0, 4.0), (None, 1.0, 9.0), (4.0, None, 9.0)]
    ds = rl.labeled_points(_small(spark, rows), "y", ["a", "b"], bias=True)
    r = rl.fit_cg(ds, "squared", solver="passes")
    assert r.n_rows == 3  # rows with a NULL feature are dropped, not half-counted
    pred = np.array([[1, 1, 1], [2, 1, 1], [3, 1, 1]]) @ r.weights
    np.testing.assert_allclose(pred, [2.0, 3.0, 4.0], atol=1e-7)


def test_nan_rows_dropped_infinite_feature_stops(spark):
    rows = [(1.0, 1.0, 1.0), (2.0, 0.0, 0.0), (float("nan"), 0.0, 0.0)]
    ds = rl.labeled_points(_small(spark, rows), "y", ["a", "b"], bias=True)
    assert rl.fit_cg(ds, "logistic", max_iter=3).n_rows == 2  # dropna drops NaN like NULL
    rows = [(1.0, 1.0, 1.0), (float("inf"), 0.0, 0.0)]
    ds = rl.labeled_points(_small(spark, rows), "y", ["a", "b"], bias=True)
    assert rl.fit_cg(ds, "logistic").stop_reason == "non_finite"
    assert rl.fit_gd(ds, solver="passes").stop_reason == "non_finite"


def test_separable_logistic_stays_finite(spark):
    rows = [(float(i), 0.0, 1.0 if i > 5 else 0.0) for i in range(11) if i != 5]
    ds = rl.labeled_points(_small(spark, rows), "y", ["a", "b"], bias=True)
    r = rl.fit_cg(ds, "logistic", max_iter=15)
    assert np.all(np.isfinite(r.weights))
    acc = rl.accuracy(rl.predict(ds, r.model())).first().accuracy
    assert acc == 1.0


def test_report_and_weights_frames(spark, log_sig):
    r = rl.fit_logistic(log_sig)
    rep = r.report_df(spark).first()
    assert rep.method == "cg_logistic" and rep.iterations == r.iterations and rep.passes == r.total_passes
    assert rep.passes == (
        rep.gradient_passes + rep.bracket_passes + rep.zoom_passes + rep.newton_passes + rep.exact_passes
        + rep.gram_passes
    )
    w = r.weights_df(spark).orderBy("feature_index").collect()
    assert [x.feature for x in w] == ["qty", "bias"]


def test_storage_modes(log_sig):
    ref = rl.fit_logistic(log_sig).weights
    for storage in ("none", "checkpoint"):
        np.testing.assert_allclose(rl.fit_logistic(log_sig, storage=storage).weights, ref, atol=1e-9)


def test_fit_restores_adaptive_setting(spark, log_sig):
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    rl.fit_logistic(log_sig, max_iter=2)
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_gd_takes_any_loss(log_sig):
    r = rl.fit_gd(log_sig, loss="logistic", step_size=20.0, max_iter=15, tol=1e-6)
    losses = [h[1] for h in r.history]
    assert r.loss == "logistic" and r.passes["gradient"] == r.iterations == 15  # no Gram form for logistic
    assert losses[-1] < losses[0] and np.all(np.isfinite(r.weights))


def test_fit_survives_losing_the_cached_table(log_sig, monkeypatch):
    """Cached blocks vanish mid-fit (as when executors are lost): passes recompute from lineage."""
    ref = rl.fit_logistic(log_sig).weights
    original = rl.Evaluator._run
    calls = {"n": 0}

    def run(self, *args, **kwargs):
        calls["n"] += 1
        if calls["n"] == 3:
            self.design.df.unpersist(blocking=True)
        return original(self, *args, **kwargs)

    monkeypatch.setattr(rl.Evaluator, "_run", run)
    got = rl.fit_logistic(log_sig).weights
    assert calls["n"] > 3
    np.testing.assert_allclose(got, ref, atol=1e-9)


def test_gram_fit_takes_two_passes(lin3):
    """Moments and the final loss; the iterations run on the driver."""
    r = rl.fit_linear(lin3, solver="gram")
    assert r.passes == {"gram": 1, "final": 1}
    np.testing.assert_allclose(r.weights, LS_LIN3, atol=5e-8)
    g = rl.fit_gd(lin3, step_size=1.0, max_iter=1000, tol=1e-3, solver="gram")
    assert g.iterations == 61 and g.total_passes == 2


@pytest.mark.parametrize("kind", ["wolfe", "newton", "exact"])
def test_a_stopped_fit_goes_on(log_sig, lineitem01, tmp_path, monkeypatch, kind):
    """A driver that dies after some iterations: the fit started again has the same history."""
    from ridgeline.plans import state

    ds, kw = log_sig, {"loss": "logistic", "newton_steps": kind == "newton"}
    if kind == "exact":
        ds, kw = LIN_NET.design(lineitem01), {"loss": "squared"}
    whole = rl.fit_cg(ds, **kw)
    assert whole.iterations >= 3
    folder = str(tmp_path / "fit")
    save = state.FitState.save

    def dying(self, step, data):
        save(self, step, data)
        if step == 2:
            raise KeyboardInterrupt

    monkeypatch.setattr(state.FitState, "save", dying)
    with pytest.raises(KeyboardInterrupt):
        rl.fit_cg(ds, resume=folder, **kw)
    monkeypatch.setattr(state.FitState, "save", save)
    (tmp_path / "fit" / "step-9").mkdir()  # a step that was never completed
    before = rl.Evaluator.value_and_gradient
    monkeypatch.setattr(rl.Evaluator, "value_and_gradient", lambda *a, **k: pytest.fail("started from the beginning") if not np.any(a[1]) else before(*a, **k))
    again = rl.fit_cg(ds, resume=folder, **kw)
    assert again.iterations == whole.iterations and again.passes == whole.passes and again.stop_reason == whole.stop_reason
    assert [h[0] for h in again.history] == [h[0] for h in whole.history]
    np.testing.assert_allclose(again.weights, whole.weights, atol=1e-12)
    np.testing.assert_allclose([h[2] for h in again.history], [h[2] for h in whole.history], rtol=1e-9)
    assert not list((tmp_path / "fit").glob("step-*"))
    with pytest.raises(ValueError, match="resumed"):
        rl.fit_logistic(log_sig, updater=rl.l1(0.1), resume=folder)


@pytest.mark.parametrize("fit", [rl.fit_cg, rl.fit_gd, rl.fit_lbfgs])
def test_a_report_starts_no_job(spark, fit):
    """Rows read and dropped are counted by the first pass; columns, arrays and sparse rows."""
    rows = [(float(k % 7), float(k % 5), None if k % 10 == 0 else float("nan") if k % 10 == 1 else float(k % 2)) for k in range(200)]
    df = _small(spark, rows)
    one = F.array(F.col("a"), F.col("b"))
    designs = [rl.labeled_points(df, "y", ["a", "b"]), rl.array_points(df, "y", one, 2), rl.sparse_points(df, "y", F.array(F.lit(0), F.lit(1)), one, 2)]
    sc = spark.sparkContext
    for ds in designs:
        res = fit(ds, "squared", max_iter=2)
        sc.setJobGroup("report", "report")
        try:
            row = res.report_row()
        finally:
            sc._jsc.sc().clearJobGroup()
        assert res.n_rows == 160 and res.dropped_rows() == 40 and 40 in row
        assert not sc.statusTracker().getJobIdsForGroup("report")
    assert fit(designs[0], "squared", max_iter=2, storage="none").dropped_rows() == 40
    assert fit(rl.labeled_points(df.limit(0), "y", ["a", "b"]), "squared").dropped_rows() == 0

"""Sparse designs in every operation, LibSVM damage rules, models as tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import ridgeline as rl
from ridgeline.session import scratch_path
from ridgeline.sources import design as design_module
from ridgeline.sources.libsvm import densified

DIM = 9


@pytest.fixture(scope="module")
def three(spark):
    """The same rows as columns, arrays and sparse rows."""
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=(120, DIM)), 3) * (rng.random((120, DIM)) < 0.5)
    x[5] = 0.0  # a row without entries
    y = (x[:, 0] - x[:, 1] + 0.5 * rng.normal(size=120) > 0).astype(float)
    df = spark.createDataFrame([(k, float(t), row.tolist()) for k, (row, t) in enumerate(zip(x, y))], "k int, y double, f array<double>")
    pairs = F.filter(F.transform("f", lambda v, i: F.struct(i.alias("i"), v.alias("v"))), lambda p: p["v"] != 0)
    array = rl.array_points(df, "y", "f", DIM, bias=True, keep=["k"])
    columns = rl.labeled_points(df, "y", {f"x{j}": F.col("f")[j] for j in range(DIM)}, bias=True, keep=["k"])
    sparse = rl.sparse_points(df.withColumn("p", pairs), "y", F.col("p.i"), F.col("p.v"), DIM, bias=True, keep=["k"])
    return x, y, {"columns": columns, "arrays": array, "sparse": sparse}


@pytest.mark.parametrize("literal", [1 << 16, 2])
def test_every_operation_on_every_design(spark, three, literal, monkeypatch):
    """Predict, MSE, accuracy, loss, profile, derivative, gradient, writer; with weights as literals and as arrays."""
    monkeypatch.setattr(design_module, "LITERAL_WEIGHTS", literal)
    x, y, designs = three
    w, d = np.linspace(-0.6, 0.8, DIM + 1), np.linspace(0.3, -0.2, DIM + 1)
    z = x @ w[:-1] + w[-1]
    out = {}
    for kind, ds in designs.items():
        model = rl.LinearModel("linear", ds.features, tuple(w))
        p = rl.predict(ds, model, keep=["k"]).orderBy("k").collect()
        np.testing.assert_allclose([r.prediction for r in p], z, atol=1e-12)
        m = rl.mse(rl.predict(ds, model)).first()
        logistic = rl.LinearModel("logistic", ds.features, tuple(w))
        q = rl.predict(ds, logistic, keep=["k"]).orderBy("k").collect()
        np.testing.assert_allclose([r.probability for r in q], 1 / (1 + np.exp(-z)), atol=1e-12)
        acc = rl.accuracy(rl.predict(ds, logistic)).first()
        loss = rl.loss_table(ds, w, "logistic", 0.1).first()
        prof = rl.line_search_profile(ds, w, d, [0.5, 2.0], "logistic", 0.1).orderBy("alpha").collect()
        der = rl.directional_derivative_table(ds, w, d, [0.5], "logistic", 0.1).first()
        grad = {r.feature: r.gradient for r in rl.gradient_table(ds, w, "logistic", 0.1).collect()}
        path = scratch_path(spark, "libsvm-three")
        rl.write_libsvm(ds, path)
        back = rl.libsvm_design(spark, path, bias=True)
        assert back.dim == DIM + 1
        again = rl.loss_table(back, w, "logistic", 0.1).first()
        out[kind] = [m.n, m.mse, acc.n, acc.accuracy, loss.n, loss.loss, *[v for r in prof for v in r], der.slope, *[grad[n] for n in ds.features], again.n, again.loss]
    np.testing.assert_allclose(out["columns"], out["arrays"], rtol=1e-10)
    np.testing.assert_allclose(out["columns"], out["sparse"], rtol=1e-10)
    assert out["sparse"][0] == 120


def test_flow_of_a_libsvm_file(spark, three):
    """Write, read with the dimension inferred, fit, predict, evaluate: sparse as from the dense design."""
    x, y, designs = three
    path = scratch_path(spark, "libsvm-flow")
    rl.write_libsvm(designs["arrays"], path)
    ds = rl.libsvm_design(spark, path, bias=True)
    assert ds.sparse
    res = rl.fit_linear(ds)
    a = np.c_[x, np.ones(len(x))]
    want = np.linalg.lstsq(a, y, rcond=None)[0]
    np.testing.assert_allclose(res.weights, want, atol=1e-5)
    assert rl.mse(rl.predict(ds, res.model())).first().mse == pytest.approx(np.mean((a @ want - y) ** 2), abs=1e-8)
    log = rl.fit_logistic(ds, reg_param=0.1)
    np.testing.assert_allclose(log.weights, rl.fit_logistic(designs["columns"], reg_param=0.1).weights, atol=1e-6)


def test_densified_and_single_features(three):
    _, _, designs = three
    sparse = designs["sparse"]
    dense = densified(sparse)
    got = dense.df.orderBy("k").select("features").collect()
    want = designs["arrays"].df.orderBy("k").select("features").collect()
    assert [r.features for r in got] == [r.features for r in want]
    assert [r[0] for r in sparse.df.orderBy("k").select(sparse.x(3)).collect()] == [r.features[3] for r in want]


def test_gradient_of_a_sparse_design_lists_what_occurs(spark):
    rows = [(1.0, [2, 5], [1.0, 1.0]), (0.0, [2], [1.0]), (None, [7], [1.0])]
    ds = rl.sparse_points(spark.createDataFrame(rows, "y double, i array<int>, v array<double>"), "y", "i", "v", 1000, bias=True)
    got = {r.feature: r.gradient for r in rl.gradient_table(ds, np.zeros(1001), "logistic").collect()}
    assert got == {"x2": 0.0, "x5": -0.25, "bias": 0.0}  # a sum of zero stays, a dropped row's feature does not come
    w = np.zeros(1001)
    w[3] = 2.0
    got = {r.feature: r.gradient for r in rl.gradient_table(ds, w, "logistic", 0.5).collect()}
    assert got["x3"] == 1.0 and set(got) == {"x2", "x3", "x5", "bias"}
    empty = rl.sparse_points(spark.createDataFrame([], "y double, i array<int>, v array<double>"), "y", "i", "v", 10)
    assert rl.gradient_table(empty, np.zeros(10)).count() == 0


def test_rows_that_do_not_fit(spark):
    schema = "y double, i array<int>, v array<double>"
    for bad in ([1.0, [3], [1.0]], [1.0, [-1], [1.0]], [1.0, [None], [1.0]], [1.0, [0, 1], [1.0]]):
        ds = rl.sparse_points(spark.createDataFrame([tuple(bad)], schema), "y", "i", "v", 3)
        with pytest.raises(Exception, match="does not fit 3 features"):
            rl.Evaluator(ds).value_and_gradient([0.0] * 3)
    rows = [(1.0, None, [1.0]), (1.0, [0], None), (1.0, [0], [None]), (float("nan"), [0], [1.0]), (1.0, [0], [2.0])]
    ds = rl.sparse_points(spark.createDataFrame(rows, schema), "y", "i", "v", 3)
    assert ds.dropped_rows() == 4 and rl.loss_table(ds, [0.0] * 3).first().n == 1


# --- LibSVM text -----------------------------------------------------------------------
LINES = ["1 1:0.5 3:2", "0", "# note", "", "  0.5   2:1e-3 # end", "x 1:1", "1 0:1", "1 3:1 2:1", "1 2:1 2:2", "1 2:", "1 :2", "1 a:1", "1 2", "-1 7:4.25", "1 1:2:3", "1 99999999999:1"]


def test_scan_and_damage(spark):
    path = scratch_path(spark, "lines")
    spark.createDataFrame([(t,) for t in LINES], "value string").coalesce(1).write.text(path)
    found = rl.scan_libsvm(spark, path)
    assert (found.rows, found.damaged, found.num_features, found.entries) == (4, 10, 7, 4)
    ds = rl.libsvm_design(spark, path, damaged="drop")
    rows = sorted((r.label, r.features.indices, r.features["values"]) for r in ds.df.collect())
    assert rows == [(-1.0, [6], [4.25]), (0.0, [], []), (0.5, [1], [0.001]), (1.0, [0, 2], [0.5, 2.0])]
    assert ds.dim == 7 and ds.dropped_rows() == 10
    with pytest.raises(Exception, match="damaged LibSVM line"):
        rl.libsvm_design(spark, path).df.collect()
    small = rl.libsvm_design(spark, path, num_features=3, damaged="drop")
    assert small.df.count() == 3  # an index beyond the stated dimension is damage
    with pytest.raises(ValueError, match="damaged"):
        rl.libsvm_design(spark, path, damaged="ignore")


def test_reads_what_sparks_own_writer_wrote(spark):
    from pyspark.ml.linalg import Vectors

    path = scratch_path(spark, "libsvm-stock")
    spark.createDataFrame([(1.0, Vectors.sparse(5, {0: 1.5, 4: -2.0})), (0.0, Vectors.dense([0, 1, 0, 0, 3.25]))], ["label", "features"]).write.format("libsvm").save(path)
    ds = rl.libsvm_design(spark, path, sparse=False)
    assert sorted((r.label, r.features) for r in ds.df.collect()) == [(0.0, [0.0, 1.0, 0.0, 0.0, 3.25]), (1.0, [1.5, 0.0, 0.0, 0.0, -2.0])]
    back = scratch_path(spark, "libsvm-back")
    rl.write_libsvm(ds, back)
    own = rl.read_libsvm(spark, back, 5).collect()
    assert sorted((r.label, r.features.toArray().tolist()) for r in own) == [(0.0, [0.0, 1.0, 0.0, 0.0, 3.25]), (1.0, [1.5, 0.0, 0.0, 0.0, -2.0])]


# --- models as tables ---------------------------------------------------------------------
def as_array(weights, dim):
    out = np.zeros(dim)
    for r in weights.collect():
        out[r["index"]] = r["weight"]
    return out


@pytest.fixture(scope="module")
def wide(spark, three):
    _, _, designs = three
    rows = designs["sparse"].df.select("label", "features.indices", "features.values")
    with rl.wide_design(rows, "label", "indices", "values", DIM, bias=True, rows_a_part=7, partitions=5) as ds:
        yield ds


def test_wide_gradient_and_scores(spark, three, wide):
    x, y, designs = three
    w = np.linspace(-0.6, 0.8, DIM + 1)
    weights = spark.createDataFrame([(int(j), float(v)) for j, v in enumerate(w)], "index long, weight double")
    assert wide.rows.select("part").distinct().count() >= 120 // 7
    for reg in (0.0, 0.3):
        _, g = rl.Evaluator(designs["columns"], "logistic", reg).value_and_gradient(w)
        got = rl.wide_gradient(wide, weights, "logistic", reg).withColumnRenamed("gradient", "weight")
        np.testing.assert_allclose(as_array(got, DIM + 1), g, atol=1e-14)
    z = x @ w[:-1] + w[-1]
    scores = rl.wide_scores(wide, weights)
    np.testing.assert_allclose(sorted(r.prediction for r in scores.collect()), sorted(z), atol=1e-12)
    assert rl.mse(scores).first().mse == pytest.approx(np.mean((z - y) ** 2))


@pytest.mark.parametrize("loss,reg", [("logistic", 0.1), ("squared", 0.05), ("logistic", 0.0)])
def test_wide_cg_equals_cg(three, wide, loss, reg):
    _, _, designs = three
    ref = rl.fit_cg(designs["sparse"], loss, reg, max_iter=60, line_search="wolfe")
    got = rl.fit_wide(wide, loss, reg, max_iter=60)
    np.testing.assert_allclose(as_array(got.weights, DIM + 1), ref.weights, atol=2e-5 if reg == 0 else 1e-6)
    assert got.stop_reason in ("step", "gradient") and got.n_rows == 120
    assert got.final_loss == pytest.approx(ref.final_loss, rel=1e-9)
    if loss == "logistic":  # the same search: the same steps
        few = rl.fit_wide(wide, loss, reg, max_iter=3)
        np.testing.assert_allclose([h[2] for h in few.history], [h[2] for h in ref.history[:3]], rtol=1e-7)
        np.testing.assert_allclose(as_array(few.weights, DIM + 1), ref.history[2][3], atol=1e-9)


def test_wide_gd_equals_gd(three, wide):
    _, _, designs = three
    ref = rl.fit_gd(designs["sparse"], "logistic", step_size=0.5, max_iter=5, tol=0.0, reg_param=0.1)
    got = rl.fit_wide_gd(wide, "logistic", step_size=0.5, max_iter=5, reg_param=0.1)
    np.testing.assert_allclose(as_array(got.weights, DIM + 1), ref.weights, atol=1e-12)
    start = spark_weights(wide, ref.weights)
    more = rl.fit_wide_gd(wide, "logistic", step_size=0.5, max_iter=1, reg_param=0.1, init=start)
    want = ref.weights - 0.5 * rl.Evaluator(designs["sparse"], "logistic", 0.1).value_and_gradient(ref.weights)[1]
    np.testing.assert_allclose(as_array(more.weights, DIM + 1), want, atol=1e-12)


def spark_weights(wide, w):
    return wide.rows.sparkSession.createDataFrame([(int(j), float(v)) for j, v in enumerate(w)], "index long, weight double")


def test_wide_models_hold_what_occurs(spark):
    """2**40 features: nothing may be as long as the model."""
    rows = [(1.0, [5, 1 << 39], [1.0, 2.0]), (0.0, [5], [1.0]), (1.0, [], []), (None, [7], [1.0])]
    df = spark.createDataFrame(rows, "y double, i array<bigint>, v array<double>")
    with rl.wide_design(df, "y", "i", "v", 1 << 40) as ds:
        got = {r["index"]: r["weight"] for r in rl.fit_wide(ds, reg_param=0.1, max_iter=30).weights.collect()}
        assert set(got) == {5, 1 << 39} and got[1 << 39] > 0
        assert rl.wide_scores(ds, spark.createDataFrame([(5, 1.0)], "index long, weight double")).count() == 3
    with rl.wide_design(df.limit(0), "y", "i", "v", 1 << 40) as ds:
        assert rl.fit_wide(ds).stop_reason == "empty" and rl.fit_wide_gd(ds).stop_reason == "empty"
        assert rl.wide_scores(ds, spark.createDataFrame([(5, 1.0)], "index long, weight double")).count() == 0
    with pytest.raises(ValueError, match="batch form"):
        rl.fit_wide(ds, loss="hinge")


def test_wide_pass_moves_only_what_parts_need(wide):
    """The rows stay in their parts: the pass shuffles the model's rows and the sums."""
    from ridgeline.plans import wide as W

    model = W._start(wide, None).withColumn("d", F.lit(0.0))
    sent = wide.needs.join(model, "index").select(F.col("part").alias("to"), "index", "w", "d")
    found = wide.rows.groupBy("part").cogroup(sent.groupBy("to")).applyInArrow(W._part_sums(W._batch_loss("logistic"), [], [0.0]), "index long, g0 double")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    side = plan[plan.index("FlatMapCoGroups") : plan.index("InMemoryTableScan")]
    assert "Exchange" not in side  # between the cogroup and the persisted rows


def test_packed_blocks_end_by_their_entries(monkeypatch):
    import pyarrow as pa

    from ridgeline.operators.passes import Block

    monkeypatch.setattr(design_module, "PACKED_ENTRIES", 4)
    rows = [[(0, 1.0), (2, 2.0)], [], [(1, 3.0), (2, 4.0), (3, 5.0)], [(0, 6.0)], []]
    features = pa.array([{"indices": [i for i, _ in r], "values": [v for _, v in r]} for r in rows], pa.struct([("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))]))
    [blocks] = design_module._packed([pa.RecordBatch.from_arrays([pa.array([1.0, 0.0, 1.0, 0.0, 1.0]), features], names=["label", "features"])])
    assert blocks.column(0).to_pylist() == [3, 2]
    shape = design_module.Design(df=None, features=("a", "b", "c", "d"), array_col="features", sparse=True, packed=True)
    got = [(b.dot(np.array([1.0, 10.0, 100.0, 1000.0])).tolist(), y.tolist()) for b, y in Block.unpacked(shape, blocks)]
    assert got == [([201.0, 0.0, 5430.0], [1.0, 0.0, 1.0]), ([6.0, 0.0], [0.0, 1.0])]


def test_sparse_rows_are_kept_as_blocks_and_give_the_sums_of_rows(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(700):
        at = sorted(rng.choice(40, int(rng.integers(0, 9)), replace=False).tolist())
        rows.append((float(k % 3 % 2), at, rng.normal(size=len(at)).tolist()))
    rows += [(None, [0], [1.0]), (1.0, [1], [float("nan")])]
    df = spark.createDataFrame(rows, "label double, i array<int>, v array<double>").repartition(3)
    ds = rl.sparse_points(df, "label", "i", "v", 40, bias=True)
    w, d = rng.normal(size=41), rng.normal(size=41)
    by_row = rl.Evaluator(ds, "logistic")
    with rl.materialized(ds, pack=True) as kept:
        assert kept.packed and kept.df.agg(F.sum("n")).first()[0] == 700
        by_block = rl.Evaluator(kept, "logistic")
        for got, want in zip(by_block.value_and_gradient(w), by_row.value_and_gradient(w), strict=True):
            np.testing.assert_allclose(got, want, rtol=1e-12, atol=1e-15)
        assert by_block.n == by_row.n == 700
        for a, b in zip(by_block.probe(w, d, [0.1, 3.0], 1), by_row.probe(w, d, [0.1, 3.0], 1), strict=True):
            np.testing.assert_allclose([a.loss, a.slope, a.change], [b.loss, b.slope, b.change], rtol=1e-12)
    assert rl.fit_logistic(ds, max_iter=3).dropped_rows() == 2


def test_logistic_batches_agree_with_the_plain_formulas():
    from ridgeline.functions.losses import LogisticLoss

    rng = np.random.default_rng(2)
    m, q = rng.normal(size=900) * 4, rng.normal(size=900)
    loss = LogisticLoss()
    for y in (rng.integers(0, 2, 900).astype(float), rng.random(900)):
        np.testing.assert_array_equal(loss.slope_of_batch(m, y), loss.of_batch(m, y)[1])
        np.testing.assert_allclose(loss.change_of_batch(m, q, y), loss.of_batch(m + q, y)[0] - loss.of_batch(m, y)[0], rtol=1e-9, atol=1e-13)

"""Registered Spark queries: one per operator of the inventory, each over whole tables.

Every query takes ``(spark, sf_dir)`` and returns a DataFrame whose column
names, types and rounding match the DuckDB oracle of the same name
(``ridgeline.workload.oracles``).  Computed doubles are rounded (and ``+ 0.0``
washes out ``-0.0``) so that summation order cannot change the hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions.losses import get_loss, hinge_loss, huber_loss
from ridgeline.functions.updaters import bounds, l1
from ridgeline.operators.metrics import accuracy, mse, predict
from ridgeline.operators.passes import (
    directional_derivative_table,
    gradient_table,
    line_search_profile,
    loss_table,
    two_level,
)
from ridgeline.plans.baselines import fit_lbfgs_logistic, fit_ml_linear
from ridgeline.plans.cg import fit_cg
from ridgeline.plans.gd import fit_gd
from ridgeline.plans.lbfgs import fit_lbfgs
from ridgeline.plans.presets import (
    fit_gd_stock,
    fit_linear,
    fit_linear_gd,
    fit_logistic,
    linear_train_mse,
    logistic_train_accuracy,
)
from ridgeline.plans.result import FitResult, LinearModel
from ridgeline.plans.wide import fit_wide, fit_wide_gd, wide_design, wide_gradient
from ridgeline.session import scratch_path
from ridgeline.sources.libsvm import libsvm_design, scan_libsvm, write_libsvm
from ridgeline.sources.design import array_points, labeled_points, sparse_points
from ridgeline.sources.prepare import append_bias, binarize_label, key_part, random_part
from ridgeline.workload.fixtures import (
    EMB_NEGATIVE,
    LIN3,
    LIN_NET,
    LIN_RAW,
    LOG2,
    LOG_SIG,
    SPLIT_KEY,
    SPLIT_PARTS,
    embedding_design,
    lineitem_design,
    read_table,
    split_designs,
)

# --- fixed parameters of the checks ------------------------------------------
W_LIN = (0.5, -0.25, 0.1)  # lin3: qty, disc, bias
D_LIN = (-1.0, 0.5, 0.25)
ALPHAS_LIN = (0.0, 0.5, 1.0, 2.0)
W_LOG = (0.3, -0.7)  # log2: qty, bias
D_LOG = (-0.2, -0.3)  # a descent direction at W_LOG (about -10 x the gradient)
ALPHAS_LOG = (0.25, 0.5, 1.0, 2.0, 4.0)
W_NET = (0.9, -0.05, 0.03)  # lin_net: price, disc, bias
W_SIG = (4.9, -2.3)  # log_sig: qty, bias
GD_STEP, GD_TOL, GD_MAX = 1.0, 1e-3, 1000
STOCK_STEP, STOCK_TOL, STOCK_MAX = 1e-5, 0.01, 200
SGD_STEP, SGD_MAX = 1.0, 100
RIDGE = 0.1
KEYS = ("l_orderkey", "l_linenumber")


def emb_weights(dim: int = 64) -> tuple[float, ...]:
    """Fixed weights for the array-form check: ((j mod 7) - 3) / 100, bias 0.05."""
    return tuple(((j % 7) - 3) / 100.0 for j in range(dim)) + (0.05,)


def rnd(c: Column | str, k: int) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, k) + F.lit(0.0)


def _keys() -> list[Column]:
    return [F.col(k).cast("bigint").alias(k) for k in KEYS]


def _weights(spark: SparkSession, res: FitResult, digits: int, iterations: bool = False) -> DataFrame:
    cols = [F.col("feature_index").cast("bigint").alias("feature_index"), "feature", rnd("weight", digits).alias("weight")]
    if iterations:
        cols.append(F.lit(res.iterations).cast("bigint").alias("iterations"))
    return res.weights_df(spark).select(*cols)


# --- S: sources ---------------------------------------------------------------
def q_labeled_points(spark, sf_dir):
    ds = lineitem_design(spark, sf_dir, LIN3, keep=KEYS)
    return ds.df.select(*_keys(), rnd("label", 9).alias("label"), rnd("qty", 9).alias("qty"), rnd("disc", 9).alias("disc"),
                        F.lit(1.0).alias("bias"))


def q_libsvm_scan(spark, sf_dir):
    """Write lin3 as LibSVM text to the shared folder, read it back, total per index."""
    path = scratch_path(spark, "libsvm")
    write_libsvm(lineitem_design(spark, sf_dir, LIN3), path)
    ds = libsvm_design(spark, path, num_features=2, sparse=False)
    cols = {-1: "label"} | {j: ds.x_sql(j) for j in range(2)}
    one = ds.df.selectExpr(*[f"{c} AS c{k + 1}" for k, c in cols.items()])
    one = two_level(one, {f"{f}{k + 1}": f"{f}(c{k + 1})" for k in cols for f in ("count", "sum")})
    cells = ", ".join(f"{k}L, count{k + 1}, sum{k + 1}" for k in cols)
    out = one.selectExpr(f"stack({len(cols)}, {cells}) AS (feature_index, n, total)")
    return out.select("feature_index", "n", rnd("total", 6).alias("total"))


# --- P: preparation -----------------------------------------------------------
def q_binarize_label(spark, sf_dir):
    emb = read_table(spark, sf_dir, "embeddings")
    return emb.select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.col("label").cast("bigint").alias("label"),
        binarize_label("label", EMB_NEGATIVE).alias("label_bin"),
    )


def q_append_bias(spark, sf_dir):
    emb = read_table(spark, sf_dir, "embeddings")
    arr = emb.select("vec_id", append_bias("embedding").alias("features"))
    return arr.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.posexplode("features").alias("pos", "value")
    ).select("vec_id", F.col("pos").cast("bigint").alias("feature_index"), "value")


def q_random_split(spark, sf_dir):
    """The seeded 80/20 split: every row in one part, no key in both, shares within a percent."""
    src = lineitem_design(spark, sf_dir, LIN3, keep=KEYS).df
    tagged = src.select(*KEYS, random_part([F.col(k) for k in KEYS], (0.8, 0.2), seed=11).alias("part"))
    by_key = tagged.groupBy(*KEYS).agg(F.count("part").alias("n"), F.count_if(F.col("part") == 0).alias("train"))
    agg = by_key.agg(F.sum("n").alias("n_total"), F.sum("train").alias("n_train"), F.count_if((F.col("train") > 0) & (F.col("train") < F.col("n"))).alias("n_overlap"))
    return agg.select("n_total", "n_overlap", (F.abs(F.col("n_train") / F.col("n_total") - 0.8) < 0.01).alias("share_ok"))


def q_key_split(spark, sf_dir):
    """Sizes and label totals of the two sides: one scan, partial aggregate on two keys."""
    src = read_table(spark, sf_dir, "lineitem").withColumn("part", key_part(F.expr(SPLIT_KEY), SPLIT_PARTS, 0))
    ds = LIN3.design(src, keep=("part",))
    return ds.df.groupBy("part").agg(F.count("*").alias("n"), rnd(F.sum("label"), 6).alias("label_sum"))


# --- E: per-row expressions -------------------------------------------------------
def q_linear_margin(spark, sf_dir):
    ds = lineitem_design(spark, sf_dir, LIN3, keep=KEYS)
    return ds.df.select(*_keys(), rnd(ds.dot(W_LIN), 9).alias("margin"))


def q_squared_loss_terms(spark, sf_dir):
    ds = lineitem_design(spark, sf_dir, LIN3, keep=KEYS)
    loss, m, y = get_loss("squared"), ds.dot(W_LIN), ds.y()
    s = loss.slope(m, y)
    return ds.df.select(
        *_keys(),
        rnd(loss.term(m, y), 9).alias("loss"),
        *[rnd(s * ds.x(j), 9).alias(f"grad_{name}") for j, name in enumerate(ds.features)],
    )


def q_logistic_loss_terms(spark, sf_dir):
    ds = lineitem_design(spark, sf_dir, LOG2, keep=KEYS)
    loss, m, y = get_loss("logistic"), ds.dot(W_LOG), ds.y()
    return ds.df.select(*_keys(), rnd(loss.term(m, y), 9).alias("loss"), rnd(loss.slope(m, y), 9).alias("slope"))


def q_predict_linear(spark, sf_dir):
    ds = lineitem_design(spark, sf_dir, LIN3, keep=KEYS)
    model = LinearModel("linear", ds.features, W_LIN)
    p = predict(ds, model, keep=KEYS)
    return p.select(*_keys(), rnd("label", 9).alias("label"), rnd("prediction", 9).alias("prediction"))


def q_predict_logistic(spark, sf_dir):
    ds = lineitem_design(spark, sf_dir, LOG_SIG, keep=KEYS)
    model = LinearModel("logistic", ds.features, W_SIG)
    p = predict(ds, model, keep=KEYS)
    return p.select(*_keys(), "label", rnd("probability", 9).alias("probability"), "prediction")


# --- A: single-pass aggregates ----------------------------------------------------
def q_loss_ls(spark, sf_dir):
    t = loss_table(lineitem_design(spark, sf_dir, LIN3), W_LIN, "squared")
    return t.select("n", rnd("loss", 9).alias("loss"))


def q_loss_logistic(spark, sf_dir):
    t = loss_table(lineitem_design(spark, sf_dir, LOG2), W_LOG, "logistic")
    return t.select("n", rnd("loss", 9).alias("loss"))


def _grad_rows(t: DataFrame) -> DataFrame:
    return t.select(F.col("feature_index").cast("bigint").alias("feature_index"), "feature",
                    rnd("gradient", 9).alias("gradient"))


def q_gradient_ls(spark, sf_dir):
    return _grad_rows(gradient_table(lineitem_design(spark, sf_dir, LIN3), W_LIN, "squared"))


def q_gradient_logistic(spark, sf_dir):
    return _grad_rows(gradient_table(lineitem_design(spark, sf_dir, LOG2), W_LOG, "logistic"))


def q_gradient_array_form(spark, sf_dir):
    ds = embedding_design(spark, sf_dir)
    return _grad_rows(gradient_table(ds, emb_weights(), "logistic"))


def q_gradient_vector_form(spark, sf_dir):
    """The same gradient as ``gradient_array_form`` with the arrow form asked for by name."""
    ds = embedding_design(spark, sf_dir)
    return _grad_rows(gradient_table(ds, emb_weights(), "logistic", form="arrow"))


def q_gradient_wide_columns(spark, sf_dir):
    """The same gradient from 64 columns, in the form of wide designs."""
    emb = embedding_design(spark, sf_dir)
    wide = labeled_points(emb.df, "label", {f"x{j}": F.col("features")[j] for j in range(64)}, bias=True)
    return _grad_rows(gradient_table(wide, emb_weights(), "logistic", form="arrow"))


def wide_names(dim: int = 320) -> list[str]:
    return [f"e{j % 64}_p{j // 64}" for j in range(dim)]


def q_gradient_wide_named(spark, sf_dir):
    """320 named features: the first five powers of each embedding entry."""
    emb = embedding_design(spark, sf_dir)
    powers = F.concat(*[F.expr(f"transform(features, x -> pow(x, {k}D))") for k in range(1, 6)])
    ds = array_points(emb.df.select("label", powers.alias("p")), "label", "p", 320, bias=True, names=wide_names())
    return _grad_rows(gradient_table(ds, [((j % 7) - 3) / 100.0 for j in range(320)] + [0.05], "logistic"))


def q_dirty_rows_array(spark, sf_dir):
    """NULL and NaN elements, labels and arrays: columns and arrays leave out the same rows."""
    emb = read_table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 3).cast("array<double>").alias("x"), "label")
    hole = F.pmod("vec_id", F.lit(5)) == 1
    x = F.when(F.pmod("vec_id", F.lit(11)) == 3, F.lit(None)).otherwise(
        F.transform("x", lambda v, i: F.when(hole & (i == 1), F.lit(None)).when((F.pmod("vec_id", F.lit(7)) == 2) & (i == 2), F.lit(float("nan"))).otherwise(v))
    )
    y = F.when(F.pmod("vec_id", F.lit(13)) != 4, (F.col("label") != EMB_NEGATIVE).cast("double"))
    dirty = emb.select(x.alias("x"), y.alias("y"))
    array = array_points(dirty, "y", "x", 3, bias=True)
    columns = labeled_points(dirty, "y", {f"x{j}": F.col("x")[j] for j in range(3)}, bias=True)
    w = (0.5, -0.25, 0.125, 0.05)
    parts = [gradient_table(ds, w, "logistic").select(F.lit(kind).alias("kind"), "*", F.lit(ds.dropped_rows()).cast("bigint").alias("dropped_rows")) for kind, ds in (("array", array), ("columns", columns))]
    return parts[0].unionByName(parts[1]).select(
        "kind", F.col("feature_index").cast("bigint").alias("feature_index"), "feature", rnd("gradient", 9).alias("gradient"), "dropped_rows"
    )


SPARSE_DIM = 1 << 20
HASHES_HELD = 300_000  # distinct words whose hash a task remembers
WIDE_DIGITS = 6  # hex digits of a hashed word: 2**24 features


def _word_cells(digits: int):
    """Texts to sorted (indices, counts) of their hashed words, a text at a time; hashes of words are remembered."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from hashlib import md5

        class Index(dict):
            def __missing__(self, word: str) -> int:
                value = int(md5(word.encode()).hexdigest()[:digits], 16)
                if len(self) >= HASHES_HELD:
                    self.clear()
                self[word] = value
                return value

        index = Index()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, sizes, ids, counts = batch.slice(at, 512), [0], [], []
                for text in part.column(2).to_pylist():
                    words = text.decode("utf-8", "replace").split(" ")
                    i, n = np.unique(np.fromiter(map(index.__getitem__, words), np.int32, len(words)), return_counts=True)
                    ids.append(i)
                    counts.append(n.astype(float))
                    sizes.append(len(i))
                ends = pa.array(np.cumsum(sizes), pa.int32())
                i = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids)))
                v = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(counts)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), i, v], names=["doc_id", "label", "i", "v"])

    return run


def _added(batches):
    """(parts of a document: lists of indices and of counts) to one sorted list of each, and the total."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            sizes, ids, values, totals = [0], [], [], []
            lists, counts = part.column(2), part.column(3)
            for k in range(part.num_rows):
                i, v = lists[k].values, counts[k].values
                i, v = i.flatten().to_numpy(), v.flatten().to_numpy()
                if len(lists[k]) > 1:
                    i, inverse = np.unique(i, return_inverse=True)
                    v = np.bincount(inverse, v, len(i))
                ids.append(i)
                values.append(v)
                totals.append(v.sum())
                sizes.append(len(i))
            ends = pa.array(np.cumsum(sizes), pa.int32())
            cells = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(c))) for c in (ids, values)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cells, pa.array(totals)], names=["doc_id", "label", "i", "v", "total"])


def hashed_words(spark, sf_dir, digits: int) -> DataFrame:
    """(doc_id, label, x, total): x.i, x.v are the counts of each document's words by hash, in order of the hash; label: English.

    Words are counted where a text is read; one row per text is shuffled, to meet the rows of the same document.
    """
    docs = read_table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    texts = docs.select("doc_id", (F.col("lang") == "en").cast("double").alias("label"), F.col("text").cast("binary").alias("text"))
    key = f"doc_id {dict(docs.dtypes)['doc_id']}, label double"
    cells = texts.mapInArrow(_word_cells(digits), f"{key}, i array<int>, v array<double>")
    met = cells.groupBy("doc_id", "label").agg(F.collect_list("i").alias("i"), F.collect_list("v").alias("v"))
    added = met.mapInArrow(_added, f"{key}, i array<int>, v array<double>, total double")
    return added.select("doc_id", "label", F.struct("i", "v").alias("x"), "total")


def q_gradient_sparse(spark, sf_dir):
    """Sparse design 2**20 wide: counts of each document's hashed words; the gradient of the features that occur."""
    cells = hashed_words(spark, sf_dir, 5)
    ds = sparse_points(cells, "label", F.col("x.i"), F.col("x.v"), SPARSE_DIM)
    w = [((j % 7) - 3) / 1000.0 for j in range(SPARSE_DIM)]
    rows = gradient_table(ds, w, "logistic")
    return rows.select(F.col("feature_index").cast("bigint").alias("feature_index"), rnd("gradient", 9).alias("gradient"))


# --- wide models: weights and gradients are tables ----------------------------------------
WIDE_STEP, WIDE_STEPS, WIDE_RIDGE = 1.0, 3, 1.0


def wide_words(spark, sf_dir):
    """2**24 features: the shares of a document's hashed words in its text."""
    cells = hashed_words(spark, sf_dir, WIDE_DIGITS)
    share = F.transform("x.v", lambda v: v / F.col("total"))
    return wide_design(cells, "label", F.col("x.i"), share, 16**WIDE_DIGITS)


def _wide_rows(weights: DataFrame, column: str, digits: int) -> DataFrame:
    return weights.select(F.col("index").cast("bigint").alias("feature_index"), rnd(column, digits).alias(column))


def q_wide_gradient(spark, sf_dir):
    ds = wide_words(spark, sf_dir)
    weights = ds.needs.select("index").distinct().withColumn("weight", (F.col("index") % 7 - 3) / 10.0)
    return _wide_rows(wide_gradient(ds, weights, "logistic"), "gradient", 9)


def q_wide_gd_fit(spark, sf_dir):
    """Three steps of gradient descent on 2**24 features."""
    return _wide_rows(fit_wide_gd(wide_words(spark, sf_dir), step_size=WIDE_STEP, max_iter=WIDE_STEPS).weights, "weight", 9)


def q_wide_cg_fit(spark, sf_dir):
    """Ridge logistic regression on 2**24 features by CG, to its optimum."""
    return _wide_rows(fit_wide(wide_words(spark, sf_dir), reg_param=WIDE_RIDGE).weights, "weight", 6)


def q_directional_derivative(spark, sf_dir):
    t = directional_derivative_table(lineitem_design(spark, sf_dir, LIN3), W_LIN, D_LIN, ALPHAS_LIN, "squared")
    return t.select("alpha", rnd("slope", 9).alias("slope"))


def q_line_search_profile(spark, sf_dir):
    t = line_search_profile(lineitem_design(spark, sf_dir, LOG2), W_LOG, D_LOG, ALPHAS_LOG, "logistic")
    return t.select("alpha", rnd("loss", 9).alias("loss"), rnd("slope", 9).alias("slope"), "armijo_ok", "curvature_ok")


def q_mse(spark, sf_dir):
    ds = lineitem_design(spark, sf_dir, LIN_NET)
    t = mse(predict(ds, LinearModel("linear", ds.features, W_NET)))
    return t.select("n", rnd("mse", 9).alias("mse"))


def q_accuracy(spark, sf_dir):
    _, test = split_designs(spark, sf_dir, LOG_SIG)
    t = accuracy(predict(test, LinearModel("logistic", test.features, W_SIG)))
    return t.select("n", rnd("accuracy", 9).alias("accuracy"))


# --- F: iterative fits --------------------------------------------------------------
def q_gd_fit(spark, sf_dir):
    res = fit_gd(lineitem_design(spark, sf_dir, LIN3), step_size=GD_STEP, max_iter=GD_MAX, tol=GD_TOL, solver="gram")
    return _weights(spark, res, 6, iterations=True)


def q_gd_passes_fit(spark, sf_dir):
    """The per-iteration job: one pass over the rows for every step."""
    res = fit_gd(lineitem_design(spark, sf_dir, LIN3), step_size=GD_STEP, max_iter=GD_MAX, tol=GD_TOL, solver="passes")
    return _weights(spark, res, 6, iterations=True)


def q_gd_history(spark, sf_dir):
    res = fit_gd(lineitem_design(spark, sf_dir, LIN3), step_size=GD_STEP, max_iter=GD_MAX, tol=GD_TOL, solver="gram")
    return res.history_df(spark).select(
        F.col("iteration").cast("bigint").alias("iteration"),
        F.col("feature_index").cast("bigint").alias("feature_index"),
        rnd("weight", 6).alias("weight"),
    )


def q_gd_baseline_fit(spark, sf_dir):
    res = fit_gd_stock(lineitem_design(spark, sf_dir, LIN_RAW), step_size=STOCK_STEP, max_iter=STOCK_MAX, tol=STOCK_TOL, solver="gram")
    return _weights(spark, res, 6, iterations=True)


def q_linear_baseline_fit(spark, sf_dir):
    res = fit_linear_gd(lineitem_design(spark, sf_dir, LIN_NET), max_iter=SGD_MAX, step_size=SGD_STEP, solver="gram")
    return _weights(spark, res, 6, iterations=True)


def q_cg_linear_fit(spark, sf_dir):
    return _weights(spark, fit_linear(lineitem_design(spark, sf_dir, LIN_NET), solver="gram"), 6)


def q_cg_linear_passes_fit(spark, sf_dir):
    """Least squares by CG, one pass per iteration with the exact step."""
    return _weights(spark, fit_linear(lineitem_design(spark, sf_dir, LIN_NET), solver="passes"), 6)


def q_cg_linear_wolfe_fit(spark, sf_dir):
    """Least squares by CG with the bracket + zoom search."""
    return _weights(spark, fit_linear(lineitem_design(spark, sf_dir, LIN_NET), solver="passes", line_search="wolfe", max_iter=30), 5)


def q_ml_linear_fit(spark, sf_dir):
    return _weights(spark, fit_ml_linear(lineitem_design(spark, sf_dir, LIN_NET)), 6)


def q_cg_logistic_fit(spark, sf_dir):
    return _weights(spark, fit_logistic(lineitem_design(spark, sf_dir, LOG_SIG), newton_steps=True), 3)


def q_cg_logistic_search_fit(spark, sf_dir):
    """The bracket + zoom search, bracketing steps in one pass."""
    return _weights(spark, fit_logistic(lineitem_design(spark, sf_dir, LOG_SIG)), 3)


def q_cg_logistic_sequential_fit(spark, sf_dir):
    """The bracket + zoom search, a pass for every trial step."""
    return _weights(spark, fit_logistic(lineitem_design(spark, sf_dir, LOG_SIG), batched=False), 3)


def q_cg_logistic_l2_fit(spark, sf_dir):
    return _weights(spark, fit_logistic(lineitem_design(spark, sf_dir, LOG_SIG), reg_param=RIDGE, newton_steps=True), 3)


# --- F2: updaters and losses as parameters ---------------------------------------------------
L1_WEIGHT, BOUND = 0.02, (-0.5, 1.5)
HUBER_DELTA = 0.01
HINGE_STEP, HINGE_STEPS = 1.0, 40
BATCH, BATCH_STEPS, BATCH_SEED = 0.25, 20, 11
LOG_SIG3 = {"qty": "l_quantity / 50", "disc": "l_discount * 10"}


def log_sig3(spark, sf_dir):
    src = read_table(spark, sf_dir, "lineitem")
    return labeled_points(src, F.expr(LOG_SIG.label), {n: F.expr(e) for n, e in LOG_SIG3.items()}, bias=True)


def q_cg_logistic_l1_fit(spark, sf_dir):
    """An L1 term as updater: the weight of the feature without signal is exactly zero."""
    return _weights(spark, fit_logistic(log_sig3(spark, sf_dir), updater=l1(L1_WEIGHT)), 4)


def q_cg_logistic_bounds_fit(spark, sf_dir):
    """Weights held between bounds."""
    return _weights(spark, fit_logistic(log_sig3(spark, sf_dir), updater=bounds(*BOUND)), 4)


def q_huber_cg_fit(spark, sf_dir):
    """A loss given as SQL: Huber's, by CG."""
    loss = huber_loss(HUBER_DELTA).checked(spark, kinks=3)
    return _weights(spark, fit_cg(lineitem_design(spark, sf_dir, LIN_NET), loss, max_iter=60, step_tol=1e-10), 4)


def q_hinge_gd_fit(spark, sf_dir):
    """A loss with a kink, given as SQL, by subgradient descent."""
    res = fit_gd(lineitem_design(spark, sf_dir, LOG_SIG), hinge_loss().checked(spark, kinks=1), step_size=HINGE_STEP, max_iter=HINGE_STEPS, tol=0.0)
    return _weights(spark, res, 6, iterations=True)


def q_sgd_minibatch_fit(spark, sf_dir):
    """Gradient descent on a quarter of the rows per iteration, drawn by a hash of the row key and the iteration."""
    ds = lineitem_design(spark, sf_dir, LIN3, keep=KEYS)
    res = fit_gd(ds, step_size=GD_STEP, max_iter=BATCH_STEPS, tol=0.0, batch_fraction=BATCH, batch_key="l_orderkey * 7 + l_linenumber", seed=BATCH_SEED)
    return _weights(spark, res, 6, iterations=True)


def q_lbfgs_own_fit(spark, sf_dir):
    return _weights(spark, fit_lbfgs(lineitem_design(spark, sf_dir, LOG_SIG)), 3)


# --- the whole flow on LibSVM text: write, read sparse, fit, predict, evaluate ------------------
def _as_libsvm(spark, design, **options):
    path = scratch_path(spark, "libsvm")
    write_libsvm(design, path)
    return libsvm_design(spark, path, bias=True, **options)


def q_libsvm_sparse_mse(spark, sf_dir):
    _, t = linear_train_mse(_as_libsvm(spark, lineitem_design(spark, sf_dir, LIN_NET)))
    return t.select("n", rnd("mse", 9).alias("mse"))


def q_sparse_logistic_accuracy(spark, sf_dir):
    train, test = (_as_libsvm(spark, ds, num_features=1) for ds in split_designs(spark, sf_dir, LOG_SIG))
    _, t = logistic_train_accuracy(train, test)
    return t.select("n", rnd("accuracy", 9).alias("accuracy"))


def q_lbfgs_sparse_fit(spark, sf_dir):
    return _weights(spark, fit_lbfgs(_as_libsvm(spark, lineitem_design(spark, sf_dir, LOG_SIG), names=["qty"])), 3)


def q_libsvm_infer(spark, sf_dir):
    """Dimension and damage of LibSVM text: the documents' hashed words, and a damaged line for every fifth of them."""
    cells = hashed_words(spark, sf_dir, 5)
    good, bad = scratch_path(spark, "libsvm"), scratch_path(spark, "libsvm-damaged")
    write_libsvm(sparse_points(cells, "label", F.col("x.i"), F.col("x.v"), SPARSE_DIM), good)
    kinds = F.array(*[F.lit(t) for t in ("x 1:2", "1 0:2", "1 3:1 2:1", "1 2:1 2:1", "1 5:", "1 a:1", "1 7", " # no row", "")])
    read_table(spark, sf_dir, "documents").filter("doc_id % 5 = 0").select(F.get(kinds, (F.col("doc_id") % 9).cast("int"))).write.text(bad)
    found = scan_libsvm(spark, [good, bad])
    return spark.createDataFrame([(found.rows, found.damaged, found.num_features, found.entries)], "n long, damaged long, num_features long, entries long")


def q_lbfgs_logistic_fit(spark, sf_dir):
    return _weights(spark, fit_lbfgs_logistic(lineitem_design(spark, sf_dir, LOG_SIG)), 3)


def q_linear_pipeline_mse(spark, sf_dir):
    _, t = linear_train_mse(lineitem_design(spark, sf_dir, LIN_NET), solver="gram")
    return t.select("n", rnd("mse", 9).alias("mse"))


def q_logistic_pipeline_accuracy(spark, sf_dir):
    train, test = split_designs(spark, sf_dir, LOG_SIG)
    _, t = logistic_train_accuracy(train, test, newton_steps=True)
    return t.select("n", rnd("accuracy", 9).alias("accuracy"))


def q_cg_fit_report(spark, sf_dir):
    """The parts of a fit's report that do not depend on timing."""
    report = fit_logistic(lineitem_design(spark, sf_dir, LOG_SIG)).report_df(spark)
    kinds = sum((F.col(f"{k}_passes") for k in ("gradient", "bracket", "zoom", "newton", "exact", "gram", "final")), F.lit(0))
    return report.select(
        "method", "n_rows", F.col("dim").cast("bigint").alias("dim"), F.col("stop_reason").isin("step", "gradient").alias("converged"),
        (F.col("passes") == kinds).alias("passes_add_up"),
        ((F.col("bracket_losses") == 10 * F.col("bracket_passes")) & F.col("zoom_losses").between(F.col("zoom_passes"), 8 * F.col("zoom_passes"))).alias("losses_add_up"),
        rnd("final_loss", 6).alias("final_loss"), "dropped_rows",
    )


def q_linear_final_loss(spark, sf_dir):
    """Reported loss of a least-squares fit on labels with a level of 1e8."""
    src = read_table(spark, sf_dir, "lineitem")
    ds = labeled_points(src, F.expr("1e8D + l_quantity * 0.5D + 0.001D * (l_linenumber % 3)"), {"qty": F.expr("l_quantity / 50")}, bias=True)
    res = fit_linear(ds, solver="gram")
    return spark.createDataFrame([(res.n_rows, float(res.final_loss))], "n long, loss double").select("n", F.round(F.col("loss") * 1e7, 1).alias("loss_e7"))


def q_cg_array_fit(spark, sf_dir):
    """Form B fit: ridge logistic CG on all 64 embedding entries plus bias."""
    return _weights(spark, fit_logistic(embedding_design(spark, sf_dir), reg_param=RIDGE), 3)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name[2:]: f for name, f in list(globals().items()) if name.startswith("q_")}

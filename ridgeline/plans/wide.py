"""Fits of very wide sparse models: weights, gradient and direction are tables, never arrays.

The rows stay where they are, in parts of bounded size, and every part's distinct features
are listed once (``needs``).  A pass joins the model with that list, so each part is sent the
weights of its own features only; a task computes the margins of a part's rows, the loss terms
at all trial steps, and the part's sums by feature, which Spark adds up by feature.  No task,
and not the driver, ever holds an array as long as the model; what moves per pass is one row
per part and distinct feature, and a feature that occurs everywhere is one row per part.

The model holds the features that occur.  All others keep weight 0, which is their optimum
with and without a ridge term.

The loop is that of :func:`ridgeline.plans.cg.fit_cg` (Hestenes-Stiefel directions, batched
strong-Wolfe search); per iteration it writes one table of the model and fetches a few sums.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.losses import get_loss
from ridgeline.operators.passes import EmptyDesign, Trial
from ridgeline.plans.cg import RESTART_COS, strong_wolfe
from ridgeline.session import stored
from ridgeline.sources.design import FEATURES, LABEL, sparse_rows

ROWS_A_PART = 4096
ROWS = "part long, label double, indices array<bigint>, values array<double>"


@dataclass(frozen=True)
class WideDesign:
    rows: DataFrame  # ROWS, hash-partitioned by part and persisted
    needs: DataFrame  # (index, part): the distinct features of every part, persisted
    dim: int
    bias: bool = False

    def __enter__(self) -> WideDesign:
        return self

    def __exit__(self, *_) -> None:
        self.rows.unpersist()
        self.needs.unpersist()


def wide_design(df: DataFrame, label, indices, values, dim: int, bias: bool = False, rows_a_part: int = ROWS_A_PART, partitions: int | None = None) -> WideDesign:
    """Sparse rows for wide fits; the row rule is that of ``sparse_points``.

    With ``bias`` feature ``dim`` is a constant 1.0.  Use as a context manager, or unpersist.
    """
    source, rule = sparse_rows(df, label, indices, values, dim, index_type="bigint")
    rows = source.filter(rule)
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()
    part = F.shiftleft(F.shiftright(at, 33), 33) + F.floor(at.bitwiseAND(F.lit((1 << 33) - 1)) / rows_a_part).cast("long")
    one = lambda c, v: F.concat(c, F.array(v)) if bias else c
    rows = rows.select(part.alias("part"), LABEL, one(F.col(f"{FEATURES}.indices"), F.lit(dim).cast("long")).alias("indices"), one(F.col(f"{FEATURES}.values"), F.lit(1.0)).alias("values"))
    # parts are numbered as the table is written, once; afterwards they do not depend on where a task runs
    rows = stored(rows, "wide-rows").repartition(n, "part").persist(StorageLevel.MEMORY_AND_DISK)
    needs = rows.select(F.explode("indices").alias("index"), "part").distinct().repartition(n, "index").persist(StorageLevel.MEMORY_AND_DISK)
    return WideDesign(rows, needs, dim + bias, bias)


def _part_sums(loss, alphas, grads):
    """Sums of one part: scalars at index -1 .., (loss at w, then change and slope per step, rows), gradients by feature."""

    def run(left, right):
        import pyarrow as pa

        names = ["index"] + [f"g{k}" for k in range(max(1, len(grads)))]
        if not left.num_rows:
            return pa.table({c: pa.array([], pa.int64() if c == "index" else pa.float64()) for c in names})
        index = right.column("index").to_numpy()
        order = np.argsort(index)
        index = index[order]
        w, d = (right.column(c).to_numpy()[order] for c in "wd")
        cells = left.column("indices").combine_chunks()
        row = np.repeat(np.arange(left.num_rows), np.diff(cells.offsets.to_numpy()))
        local = np.searchsorted(index, cells.flatten().to_numpy())
        value = left.column("values").combine_chunks().flatten().to_numpy()
        y = left.column("label").to_numpy()
        z, p = (np.bincount(row, v[local] * value, left.num_rows).astype(float) for v in (w, d))
        scalars = [loss.of_batch(z, y)[0].sum()]
        for a in alphas:
            scalars += [loss.change_of_batch(z, a * p, y).sum(), loss.of_batch(z + a * p, y)[1] @ p]
        scalars.append(left.num_rows)
        out = [np.concatenate([-1 - np.arange(len(scalars)), index])]
        for k in range(max(1, len(grads))):
            g = np.bincount(local, loss.of_batch(z + grads[k] * p, y)[1][row] * value, len(index)).astype(float) if grads else np.zeros(len(index))
            out.append(np.concatenate([scalars if k == 0 else np.zeros(len(scalars)), g]))
        return pa.table(dict(zip(names, out, strict=True)))

    return run


def _pass(design: WideDesign, model: DataFrame, loss, alphas, grads) -> tuple[np.ndarray, DataFrame | None]:
    """Scalars of a pass (sums and the row count), and the table (index, g0, g1, ..) of gradient sums at w + grads[k] * d."""
    sent = design.needs.join(model.select("index", "w", "d"), "index").select(F.col("part").alias("to"), "index", "w", "d")
    schema = ", ".join(["index long", *[f"g{k} double" for k in range(max(1, len(grads)))]])
    found = design.rows.groupBy("part").cogroup(sent.groupBy("to")).applyInArrow(_part_sums(loss, list(alphas), list(grads)), schema)
    sums = found.groupBy("index").agg(*[F.sum(f"g{k}").alias(f"g{k}") for k in range(max(1, len(grads)))])
    if grads:
        sums = stored(sums, "wide-sums")
    scalars = {r["index"]: r["g0"] for r in sums.filter("index < 0").collect()}  # 2 + 2 * steps rows
    if not scalars:
        raise EmptyDesign("the design has no rows")
    return np.array([scalars[-1 - k] for k in range(len(scalars))]), sums.filter("index >= 0") if grads else None


def wide_gradient(design: WideDesign, weights: DataFrame, loss="squared", reg_param: float = 0.0) -> DataFrame:
    """Rows (index, gradient) of the features that occur, at ``weights`` (index, weight; others 0)."""
    start = _start(design, weights).withColumn("d", F.lit(0.0))
    scalars, sums = _pass(design, start, _batch_loss(loss), (), (0.0,))
    data = sums.select("index", (F.col("g0") / float(scalars[-1])).alias("gradient"))
    if not reg_param:
        return data
    return data.join(start, "index").select("index", (F.col("gradient") + reg_param * F.col("w")).alias("gradient"))


def wide_scores(design: WideDesign, weights: DataFrame) -> DataFrame:
    """(label, prediction): every row's margin under ``weights`` (index, weight; others 0)."""

    def run(left, right):
        import pyarrow as pa

        if not left.num_rows:
            return pa.table({"label": pa.array([], pa.float64()), "prediction": pa.array([], pa.float64())})
        index, w = right.column("index").to_numpy(), right.column("w").to_numpy()
        order = np.argsort(index)
        cells = left.column("indices").combine_chunks()
        row = np.repeat(np.arange(left.num_rows), np.diff(cells.offsets.to_numpy()))
        local = order[np.searchsorted(index[order], cells.flatten().to_numpy())]
        z = np.bincount(row, w[local] * left.column("values").combine_chunks().flatten().to_numpy(), left.num_rows).astype(float)
        return pa.table({"label": left.column("label").combine_chunks(), "prediction": z})

    sent = design.needs.join(_start(design, weights), "index").select(F.col("part").alias("to"), "index", "w")
    return design.rows.groupBy("part").cogroup(sent.groupBy("to")).applyInArrow(run, "label double, prediction double")


def _start(design: WideDesign, weights: DataFrame | None) -> DataFrame:
    """(index, w) of every feature that occurs."""
    own = design.needs.select(F.col("index").alias("index")).distinct()
    if weights is None:
        return own.withColumn("w", F.lit(0.0))
    return own.join(weights.select("index", F.col("weight").cast("double").alias("w")), "index", "left").fillna(0.0, ["w"])


@dataclass
class WideFit:
    weights: DataFrame | None = None  # (index, weight)
    iterations: int = 0
    stop_reason: str = "max_iter"
    final_loss: float | None = None
    grad_norm: float | None = None
    n_rows: int = 0
    passes: Counter = field(default_factory=Counter)
    history: list = field(default_factory=list)  # (iteration, loss at its start, step)


@dataclass
class _Steps:
    """What the line search asks for: trials along the model's direction, one pass per call."""

    design: WideDesign
    model: DataFrame  # (index, w, g, d)
    lossf: object
    reg: float
    dots: dict  # ww, wd, dd
    passes: Counter
    loss = None  # the search's closed form for quadratics needs gradients as arrays

    def probe(self, w, d, alphas, grad_for=0, kind="bracket", hess_for=None) -> list[Trial]:
        mask = [k < grad_for for k in range(len(alphas))] if isinstance(grad_for, int) else list(grad_for)
        grads = [a for a, full in zip(alphas, mask, strict=True) if full]
        scalars, sums = _pass(self.design, self.model, self.lossf, alphas, grads)
        self.passes[kind] += 1
        n, q = scalars[-1], self.dots
        base = scalars[0] / n + 0.5 * self.reg * q["ww"]
        out, at = [], iter(range(len(grads)))
        for k, a in enumerate(alphas):
            change = scalars[1 + 2 * k] / n + self.reg * (a * q["wd"] + 0.5 * a * a * q["dd"])
            slope = scalars[2 + 2 * k] / n + self.reg * (q["wd"] + a * q["dd"])
            grad = (sums, f"g{next(at)}", n) if mask[k] else None
            out.append(Trial(float(a), float(base + change), float(slope), grad, None, float(change)))
        return out


def fit_wide(
    design: WideDesign, loss="logistic", reg_param: float = 0.0, max_iter: int = 20, init: DataFrame | None = None,
    step_tol: float = 1e-7, grad_tol: float = 1e-9, max_bracket: int = 10, max_zoom: int = 50,
) -> WideFit:
    """Nonlinear CG as :func:`ridgeline.plans.cg.fit_cg`, on tables."""
    lossf, res = _batch_loss(loss), WideFit()
    start = _start(design, init).withColumn("d", F.lit(0.0))
    try:
        scalars, sums = _pass(design, start, lossf, (), (0.0,))
    except EmptyDesign:
        res.stop_reason, res.weights = "empty", start.select("index", F.col("w").alias("weight"))
        return res
    res.passes["gradient"] += 1
    n = scalars[-1]
    res.n_rows = int(n)
    g = F.col("g0") / n + reg_param * F.col("w")
    model = stored(start.join(sums, "index").select("index", "w", g.alias("g")), "wide-model").withColumn("d", -F.col("g"))
    gg, ww, wg = _dots(model, "g*g", "w*w", "w*g")
    f = float(scalars[0] / n + 0.5 * reg_param * ww)
    dots, gd, g0, last_change = {"ww": ww, "wd": -wg, "dd": gg}, -gg, math.sqrt(gg), None
    for it in range(1, max_iter + 1):
        res.final_loss, res.grad_norm = f, math.sqrt(gg)
        if not (math.isfinite(f) and math.isfinite(gg)):
            res.stop_reason = "non_finite"
            break
        if res.grad_norm <= grad_tol * max(1.0, g0):
            res.stop_reason = "gradient"
            break
        if not gd < -RESTART_COS * math.sqrt(gg * dots["dd"]):
            model = model.withColumn("d", -F.col("g"))
            dots, gd = {"ww": dots["ww"], "wd": -wg, "dd": gg}, -gg
        steps = _Steps(design, model, lossf, reg_param, dots, res.passes)
        t = strong_wolfe(steps, None, None, f, gd, None, max_bracket=max_bracket, max_zoom=max_zoom, last_change=last_change)
        if not (math.isfinite(t.alpha) and math.isfinite(t.loss) and t.alpha > 0):
            res.stop_reason = "line_search"
            break
        if t.grad is None:  # a step that the pass took no gradient at
            t.grad = steps.probe(None, None, [t.alpha], 1, "gradient")[0].grad
        sums, column, n = t.grad
        new = model.join(sums.select("index", F.col(column).alias("sum")), "index").select("index", (F.col("w") + t.alpha * F.col("d")).alias("w"), F.col("g").alias("g_old"), "d", "sum")
        new = stored(new.withColumn("g", F.col("sum") / float(n) + reg_param * F.col("w")).drop("sum"), "wide-model")
        gg, g_old, dg, d_old, ww, wd, wg = _dots(new, "g*g", "g*g_old", "d*g", "d*g_old", "w*w", "w*d", "w*g")
        res.history.append((it, f, t.alpha))
        res.iterations, step, f, last_change = it, t.alpha * math.sqrt(dots["dd"]), t.loss, t.change
        res.final_loss, res.grad_norm = f, math.sqrt(gg)
        below = dg - d_old
        beta = (gg - g_old) / below if below != 0 else float("nan")
        beta = beta if math.isfinite(beta) else 0.0
        model = new.select("index", "w", "g", (beta * F.col("d") - F.col("g")).alias("d"))
        dots, gd = {"ww": ww, "wd": beta * wd - wg, "dd": beta * beta * dots["dd"] - 2 * beta * dg + gg}, beta * dg - gg
        if step < step_tol * max(math.sqrt(ww), 1.0):
            res.stop_reason = "step"
            break
    res.weights = model.select("index", F.col("w").alias("weight"))
    return res


def fit_wide_gd(design: WideDesign, loss="logistic", step_size: float = 1.0, max_iter: int = 20, reg_param: float = 0.0, tol: float = 0.0, init: DataFrame | None = None) -> WideFit:
    """Gradient descent as :func:`ridgeline.plans.gd.fit_gd`, on tables: one pass per iteration, step ``step_size / sqrt(i)``."""
    lossf, res = _batch_loss(loss), WideFit()
    model = _start(design, init)
    for it in range(1, max_iter + 1):
        step = step_size / math.sqrt(it)
        try:
            scalars, sums = _pass(design, model.withColumn("d", F.lit(0.0)), lossf, (), (0.0,))
        except EmptyDesign:
            res.stop_reason = "empty"
            break
        res.passes["gradient"] += 1
        n = float(scalars[-1])
        new = model.join(sums, "index").select("index", (F.col("w") - step * (F.col("g0") / n + reg_param * F.col("w"))).alias("w"), (F.col("g0") / n + reg_param * F.col("w")).alias("g"), F.col("w").alias("w_old"))
        new = stored(new, "wide-model")
        gg, ww, was = _dots(new, "g*g", "w*w", "w_old*w_old")
        res.n_rows, res.iterations, res.grad_norm = int(n), it, math.sqrt(gg)
        res.final_loss = float(scalars[0] / n + 0.5 * reg_param * was)  # at the step's start
        res.history.append((it, res.final_loss, step))
        model = new.select("index", "w")
        if not math.isfinite(ww):
            res.stop_reason = "non_finite"
            break
        if step * res.grad_norm < tol * max(math.sqrt(ww), 1.0):
            res.stop_reason = "step"
            break
    res.weights = model.select("index", F.col("w").alias("weight"))
    return res


def _batch_loss(loss):
    lossf = get_loss(loss)
    if getattr(lossf, "of_batch", None) is None:
        raise ValueError(f"the loss {lossf.name!r} has no batch form, which wide fits need")
    return lossf


def _dots(model: DataFrame, *products: str) -> list[float]:
    row = model.selectExpr(*[f"sum({p})" for p in products]).first()
    return [float(v) if v is not None else 0.0 for v in row]

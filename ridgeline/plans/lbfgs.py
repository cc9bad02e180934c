"""Limited-memory BFGS on the library's own passes, for every kind of design (F8, and updaters of F2).

Each iteration turns the gradient into a direction by the last ``memory`` steps and gradient
changes (two-loop recursion, O(memory * d) on the driver).  Smooth objectives take a strong-Wolfe
step along it, whose trials are one pass.  With an updater that is not smooth the trials lie
on a path bent by the updater (orthant-wise for L1, projected for bounds); a pass evaluates
several of them at once, and the first that lowers the whole objective enough is taken.
Bias and ridge are those of :func:`ridgeline.plans.cg.fit_cg`.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Sequence

import numpy as np

from ridgeline.functions.losses import get_loss, takes_batches
from ridgeline.functions.updaters import Ridge
from ridgeline.operators.passes import EmptyDesign, Evaluator, evaluator
from ridgeline.plans.cg import C1, strong_wolfe
from ridgeline.plans.result import FitResult
from ridgeline.sources.design import Design, materialized

MEMORY = 10
TRIALS = 4  # halvings of a bent step in one pass
MOST_HALVINGS = 40


def two_loop(g: np.ndarray, pairs: Sequence[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """-H g, H being the inverse Hessian that the (step, gradient change) pairs, oldest first, estimate."""
    q, kept = g.copy(), []
    for s, y in reversed(pairs):
        rho = 1.0 / float(y @ s)
        a = rho * float(s @ q)
        q -= a * y
        kept.append((rho, a, s, y))
    if pairs:
        s, y = pairs[-1]
        q *= float(s @ y) / float(y @ y)
    for rho, a, s, y in reversed(kept):
        q += (a - rho * float(y @ q)) * s
    return -q


def fit_lbfgs(
    design: Design,
    loss="logistic",
    reg_param: float = 0.0,
    updater=None,
    max_iter: int = 100,
    init: Sequence[float] | None = None,
    memory: int = MEMORY,
    step_tol: float = 1e-9,
    grad_tol: float = 1e-9,
    storage: str = "memory_and_disk",
    method: str = "lbfgs_own",
    form: str | None = None,
) -> FitResult:
    """Fit by L-BFGS; ``updater``: None, ``ridge(v)`` (added to ``reg_param``), ``l1(v)`` or ``bounds(lo, hi)``."""
    t0 = time.perf_counter()
    if isinstance(updater, Ridge):
        reg_param, updater = reg_param + updater.value, None
    w = np.zeros(design.dim) if init is None else np.array(init, dtype=float)
    if updater is not None:
        w = updater.start(w)
    passes: Counter = Counter()
    res = FitResult(method, get_loss(loss).name, design.features, w, reg_param=reg_param, passes=passes)
    res.design, ev = design, None
    with materialized(design, storage, pack=takes_batches(get_loss(loss))) as ds:
        try:
            ev = evaluator(ds, loss, reg_param, "passes", passes, res.evaluations, form)
            _run(ev, res, w, updater, max_iter, memory, step_tol, grad_tol)
        except EmptyDesign:
            res.stop_reason = "empty"
        res.n_rows = (ev.n if ev is not None else None) or 0
        res.observed(ds)
    res.elapsed_ms = int((time.perf_counter() - t0) * 1000)
    return res


def _run(ev: Evaluator, res: FitResult, w, updater, max_iter: int, memory: int, step_tol: float, grad_tol: float) -> None:
    f, g = ev.value_and_gradient(w)
    pairs: list = []
    first = None
    for it in range(1, max_iter + 1):
        slope = g if updater is None else updater.descent(w, g)
        gn = float(np.linalg.norm(slope))
        first = gn if first is None else first
        whole = f + (updater.value(w) if updater is not None else 0.0)
        res.final_loss, res.grad_norm = whole, gn
        if not np.isfinite([whole, gn]).all():
            res.stop_reason = "non_finite"
            return
        if gn <= grad_tol * max(1.0, first):
            res.stop_reason = "gradient"
            return
        d = two_loop(slope, pairs)
        if updater is not None:
            d = updater.aligned(w, d, slope)
        if not float(d @ slope) < 0:
            d, pairs = -slope, []
            res.restarts += 1
        if updater is None:
            t = strong_wolfe(ev, w, d, f, float(d @ slope), None)
            to, taken = w + t.alpha * d, t.alpha > 0 and np.isfinite(t.loss)
        else:
            to, t = _bent_step(ev, w, d if pairs else d / max(1.0, gn), slope, updater)
            taken = t is not None
        if not taken:
            if pairs:  # once more, along the steepest descent
                pairs = []
                res.restarts += 1
                continue
            res.stop_reason = "line_search"
            return
        g_new = t.grad if t.grad is not None else ev.value_and_gradient(to)[1]
        res.history.append((it, whole, t.alpha, to.copy()))
        s, y = to - w, g_new - g
        if float(s @ y) > 1e-12 * float(np.linalg.norm(s)) * float(np.linalg.norm(y)):
            pairs = [*pairs, (s, y)][-memory:]
        w, f, g = to, t.loss, g_new
        res.weights, res.iterations = w, it
        if float(np.linalg.norm(s)) < step_tol * max(float(np.linalg.norm(w)), 1.0):
            res.stop_reason = "step"
            break
    slope = g if updater is None else updater.descent(w, g)
    res.final_loss, res.grad_norm = f + (updater.value(w) if updater is not None else 0.0), float(np.linalg.norm(slope))


def _bent_step(ev: Evaluator, w, d, slope, updater):
    """(weights, trial) of the first step 1, 1/2, 1/4 .. that lowers the whole objective enough; TRIALS of them a pass."""
    for k in range(0, MOST_HALVINGS, TRIALS):
        steps = [0.5**j for j in range(k, k + TRIALS)]
        ends = [updater.bent(w, w + a * d, slope) for a in steps]
        trials = ev.at_points(w, ends, grad_for=[True, *[False] * (TRIALS - 1)])
        for a, to, t in zip(steps, ends, trials, strict=True):
            t.alpha = a
            down = float(slope @ (to - w))
            if np.isfinite(t.change) and down < 0 and t.change + updater.change(w, to) <= C1 * down:
                return to, t
    return w, None

"""Nonlinear conjugate gradient with a strong-Wolfe line search.

The objective is ``mean loss + reg/2 * ||w||^2``; every evaluation of it is one
Spark aggregate over the (persisted) design, and only O(d) numbers return to
the driver.

Direction update (Hestenes-Stiefel): ``y = g' - g``, ``beta = g'.y / d.y``,
``d <- beta*d - g'``; restart with ``d = -g`` when beta is not finite or ``d`` is
not a descent direction, or is nearly orthogonal to the gradient (such a
direction makes the line search return a vanishing step and the step test
would stop the fit far from the optimum).

Stops: gradient norm ``<= grad_tol * max(1, ||g0||)`` (tested before each line
search), step ``||w - w'|| < step_tol * max(||w'||, 1)``, ``max_iter``, or a
failed line search.

Line searches:

* ``"wolfe"`` (any smooth loss): bracketing then zoom.  The bracketing trial steps are
  fixed in advance (``a1, 2a1, 4a1, ...``), so all of them are evaluated in ONE pass,
  together with the full gradient at the first few, and the usual sequential decisions
  are then taken on the driver.  A zoom round likewise evaluates a list of points inside
  the bracket in one pass (the minimizers of the cubic and the quadratic through its ends,
  the zero of the secant of the slopes, and fixed fractions; points in the outer 10% of the
  bracket are left out), takes the first that meets the conditions, and otherwise narrows
  the bracket by all of them.  Trials are compared by their change of the objective, which
  the passes sum up from the rows' changes: no rounding allowance enters a decision, and
  a search next to the optimum ends like any other.  For the squared loss the bracketing
  pass already determines the minimizer along d and the gradient there.
* ``"exact"`` (squared loss only): phi is an exact quadratic, so one pass at
  ``(w, d)`` yields the exact minimizer along ``d`` (which satisfies the strong
  Wolfe conditions) and the next gradient: one pass per iteration.
"""

from __future__ import annotations

import math
import time
from collections import Counter
from collections.abc import Sequence

import numpy as np

from ridgeline.functions.losses import get_loss, takes_batches
from ridgeline.functions.updaters import Ridge
from ridgeline.operators.passes import EmptyDesign, Evaluator, Trial, evaluator
from ridgeline.plans.result import FitResult
from ridgeline.plans.state import FitState
from ridgeline.sources.design import Design, materialized

# Defaults of the line search (fixed values of the method).
C1 = 1e-4
C2 = 0.1
MAX_BRACKET = 10
MAX_ZOOM = 50
INITIAL_STEP_FACTOR = 2.02  # first trial from the second iteration: 2.02 * (f - f_prev) / phi'(0)
ZOOM_TRIM = 0.1
ZOOM_FRACTIONS = (0.5, 0.25, 0.75, 0.11, 0.89)  # of the bracket, behind the interpolated points
GRADIENT_TRIALS = 2  # bracketing trials of one pass that also carry the gradient
RESTART_COS = 1e-3  # restart with -g when cos(angle(-g, d)) falls below this
NEWTON_RATIOS = (1.0, 0.8, 1.25)  # trial steps around the Newton step along d (likeliest first)


def _finite(*xs: float) -> bool:
    return all(x is not None and math.isfinite(x) for x in xs)


def _quad_min(a: float, b: float, fa: float, fb: float, ga: float) -> float:
    """Minimizer of the quadratic q with q(a)=fa, q'(a)=ga, q(b)=fb (NaN if q is not convex)."""
    db = b - a
    if db == 0:
        return float("nan")
    curv = (fb - fa - ga * db) / (db * db)
    if not curv > 0:
        return float("nan")
    return a - ga / (2.0 * curv)


def _secant(a: float, b: float, ga: float, gb: float) -> float:
    """Zero of the line through (a, ga), (b, gb): the slope-only step of a flat objective."""
    if not (ga * gb < 0):
        return float("nan")
    return a - ga * (b - a) / (gb - ga)


def _cubic_min(a: float, b: float, fa: float, fb: float, ga: float, gb: float) -> float:
    """Minimizer of the cubic with these values and slopes at a and b (NaN if it has none)."""
    if a == b:
        return float("nan")
    d1 = ga + gb - 3.0 * (fa - fb) / (a - b)
    inside = d1 * d1 - ga * gb
    if not inside >= 0:
        return float("nan")
    d2 = math.copysign(math.sqrt(inside), b - a)
    below = gb - ga + 2.0 * d2
    return b - (b - a) * (gb + d2 - d1) / below if below != 0 else float("nan")


def _inside(lo: Trial, hi: Trial) -> list[float]:
    """Steps to try between two ends, likeliest first."""
    left, right = min(lo.alpha, hi.alpha), max(lo.alpha, hi.alpha)
    width = right - left
    points = []
    if _finite(hi.change, hi.slope):
        points = [
            _cubic_min(lo.alpha, hi.alpha, lo.change, hi.change, lo.slope, hi.slope),
            _secant(lo.alpha, hi.alpha, lo.slope, hi.slope),
            _quad_min(lo.alpha, hi.alpha, lo.change, hi.change, lo.slope),
        ]
    points = [a for a in points if _finite(a) and left + ZOOM_TRIM * width <= a <= right - ZOOM_TRIM * width]
    return list(dict.fromkeys(points + [left + f * width for f in ZOOM_FRACTIONS]))


def _zoom(
    ev: Evaluator, w, d, s0: float, lo: Trial, hi: Trial, c1: float, c2: float, max_zoom: int,
    with_hess: bool = False, batched: bool = True,
) -> Trial:
    """Narrow the bracket [lo, hi] round by round; at most ``max_zoom`` trials."""
    tried = 0
    while tried < max_zoom:
        if not abs(hi.alpha - lo.alpha) > 1e-15 * max(1.0, lo.alpha, hi.alpha):
            break  # bracket collapsed: nothing left to resolve
        points = _inside(lo, hi)
        if batched:
            mask = [k < GRADIENT_TRIALS for k in range(len(points))]
            trials = iter(ev.probe(w, d, points, grad_for=mask, kind="zoom", hess_for=mask if with_hess else None))
            tried += len(points)
        else:  # one pass each, until one is taken
            trials = (ev.probe(w, d, [a], grad_for=1, kind="zoom", hess_for=[with_hess])[0] for a in points)
        seen = [lo, hi]
        for t in trials:
            tried += not batched
            if _finite(t.change, t.slope) and t.change <= c1 * t.alpha * s0 and abs(t.slope) <= -c2 * s0:
                return t
            seen.append(t)
        # the lowest point of sufficient decrease, and its neighbour in the direction of descent
        low = [t for t in seen if t is lo or (_finite(t.change, t.slope) and t.change <= c1 * t.alpha * s0)]
        best = min(low, key=lambda t: t.change)
        seen.sort(key=lambda t: t.alpha)
        at = next(k for k, t in enumerate(seen) if t is best)
        other = at - 1 if best.slope > 0 else at + 1
        if not 0 <= other < len(seen):
            other = at + 1 if other < 0 else at - 1
        lo, hi = best, seen[other]
    return lo  # best point satisfying the sufficient-decrease test (alpha 0 if none)


def _quadratic_step(trials: list[Trial], s0: float) -> Trial | None:
    """The minimizer along d of a quadratic objective, from two trials with gradients: slopes and gradients are linear in the step."""
    if len(trials) < 2 or any(t.grad is None or not _finite(t.slope) for t in trials[:2]):
        return None
    a, b = trials[:2]
    bend = (b.slope - a.slope) / (b.alpha - a.alpha)
    if not bend > 0:
        return None
    step = -s0 / bend
    share = (step - a.alpha) / (b.alpha - a.alpha)
    change = step * s0 + 0.5 * step * step * bend
    return Trial(step, a.loss - a.change + change, 0.0, a.grad + share * (b.grad - a.grad), a.hess, change)


def strong_wolfe(
    ev: Evaluator,
    w: np.ndarray,
    d: np.ndarray,
    f0: float,
    s0: float,
    f_prev: float | None,
    c1: float = C1,
    c2: float = C2,
    max_bracket: int = MAX_BRACKET,
    max_zoom: int = MAX_ZOOM,
    newton: float | None = None,
    with_hess: bool = False,
    batched: bool = True,
    last_change: float | None = None,
) -> Trial:
    """Step length along descent direction ``d`` (``s0 = phi'(0) < 0``) meeting strong Wolfe.

    When the Newton step along ``d`` is known (``newton = -phi'(0) / d.H.d``,
    from the Hessian carried by the previous accepted trial), one light pass
    first tries it and two neighbours; a step meeting the strong Wolfe
    conditions ends the search there.  Otherwise ONE pass evaluates the whole
    bracketing sequence ``a1 * 2^k``, the usual sequential bracketing decisions
    are taken on the driver, and a zoom is skipped when an already evaluated
    Newton candidate inside its bracket meets the conditions.

    The first trial step follows from how much the last accepted step changed the objective
    (``last_change``, or ``f0 - f_prev`` where that is not known).
    """
    if last_change is None and f_prev is not None:
        last_change = f0 - f_prev
    a1 = 1.0
    if last_change is not None and s0 != 0:
        a1 = min(1.0, INITIAL_STEP_FACTOR * last_change / s0)
        if not (_finite(a1) and a1 > 0):
            a1 = 1.0

    def evaluate(alphas: list[float], kind: str) -> list[Trial]:
        """One pass over trial steps; the first ones carry gradients (and Hessians)."""
        mask = [k < GRADIENT_TRIALS for k in range(len(alphas))]
        return ev.probe(w, d, alphas, grad_for=mask, kind=kind, hess_for=mask if with_hess else None)

    def wolfe_ok(t: Trial) -> bool:
        return (
            t.grad is not None
            and _finite(t.change, t.slope)
            and t.change <= c1 * t.alpha * s0
            and abs(t.slope) <= -c2 * s0
        )

    extra: list[Trial] = []
    if newton is not None and _finite(newton) and newton > 0:
        extra = evaluate([newton * r for r in NEWTON_RATIOS], "newton")
        ok = [t for t in extra if wolfe_ok(t)]
        if ok:
            return min(ok, key=lambda t: t.change)

    def zoom(lo: Trial, hi: Trial) -> Trial:
        left, right = min(lo.alpha, hi.alpha), max(lo.alpha, hi.alpha)
        inside = [t for t in extra if left < t.alpha < right]
        ok = [t for t in inside if wolfe_ok(t)]
        if ok:
            return min(ok, key=lambda t: t.change)
        return _zoom(ev, w, d, s0, lo, hi, c1, c2, max_zoom, with_hess, batched)

    sequence = [a1 * 2.0**k for k in range(max_bracket)]
    if batched:
        bracket = evaluate(sequence, "bracket")
        exact = _quadratic_step(bracket, s0) if getattr(ev.loss, "quadratic", False) else None
        if exact is not None and wolfe_ok(exact):
            return exact
    else:  # one trial step per pass, as a sequential search does (for comparison)
        bracket = (evaluate([a], "bracket")[0] for a in sequence)
    prev = Trial(0.0, f0, s0, None)
    t = prev
    for i, t in enumerate(bracket, 1):
        if (
            not _finite(t.change, t.slope)
            or t.change > c1 * t.alpha * s0
            or (i > 1 and t.change > prev.change)
        ):
            return zoom(prev, t)
        if abs(t.slope) <= -c2 * s0:
            return t
        if t.slope >= 0:
            return zoom(t, prev)
        prev = t
    return t


def fit_cg(
    design: Design,
    loss="squared",
    reg_param: float = 0.0,
    max_iter: int = 100,
    init: Sequence[float] | None = None,
    step_tol: float = 1e-7,
    grad_tol: float = 1e-9,
    line_search: str = "auto",
    c1: float = C1,
    c2: float = C2,
    max_bracket: int = MAX_BRACKET,
    max_zoom: int = MAX_ZOOM,
    newton_steps: bool = False,
    batched: bool = True,
    solver: str = "passes",
    storage: str = "memory_and_disk",
    method: str = "cg",
    form: str | None = None,
    updater=None,
    resume: str | None = None,
) -> FitResult:
    """Fit by nonlinear CG.

    ``resume``: a folder that all executors share; the loop's state goes there after every
    iteration, a fit started again with the same folder (and the same arguments) goes on from
    it, and a fit that ends removes it.

    ``updater``: None, ``ridge(v)`` (added to ``reg_param``), or one that is not smooth (``l1(v)``,
    ``bounds(lo, hi)``): conjugate directions do not survive its kinks, so such a fit runs the
    orthant-wise or projected steps of :func:`ridgeline.plans.lbfgs.fit_lbfgs`.

    No default depends on the number of features.  ``newton_steps=True`` carries Hessians
    (d(d+1)/2 sums per trial, for column designs of few features) and tries the Newton step
    along the direction first; ``batched=False`` evaluates the bracketing steps one pass
    each.  ``solver="gram"`` (squared loss) reads the table three times, once for the means,
    once for the moments and once for the final loss, and iterates on the driver.
    """
    if isinstance(updater, Ridge):
        reg_param, updater = reg_param + updater.value, None
    if updater is not None:
        from ridgeline.plans.lbfgs import fit_lbfgs

        if resume is not None:
            raise ValueError("fits with an updater that is not smooth cannot be resumed")
        return fit_lbfgs(design, loss, reg_param, updater, max_iter, init, step_tol=step_tol, grad_tol=grad_tol, storage=storage, method=method, form=form)
    t0 = time.perf_counter()
    w = np.zeros(design.dim) if init is None else np.array(init, dtype=float)  # copy: input untouched
    lossf = get_loss(loss)
    mode = line_search
    if mode == "auto":
        mode = "exact" if lossf.name == "squared" else "wolfe"
    if mode not in ("exact", "wolfe"):
        raise ValueError(f"unknown line search {line_search!r}")
    if mode == "exact" and lossf.name != "squared":
        raise ValueError("the exact line search needs the squared loss")
    passes: Counter = Counter()
    res = FitResult(method, lossf.name, design.features, w, reg_param=reg_param, passes=passes)
    ev = None
    res.design = design
    kept = FitState(design.df.sparkSession, resume) if resume is not None else None
    with materialized(design, storage, pack=takes_batches(lossf)) as ds:
        try:
            ev = evaluator(ds, lossf, reg_param, solver, passes, res.evaluations, form)
            if mode == "exact":
                _run_exact(ev, res, w, max_iter, step_tol, grad_tol, kept)
            else:
                _run_wolfe(ev, res, w, max_iter, step_tol, grad_tol, c1, c2, max_bracket, max_zoom, newton_steps, batched, kept)
            if mode == "exact" or solver == "gram":
                res.final_loss = ev.value(res.weights)  # of the fitted weights, not by the quadratic
        except EmptyDesign:
            res.stop_reason = "empty"
        res.n_rows = (ev.n if ev is not None else None) or 0
        res.observed(ds)
    if kept is not None:
        kept.clear()
    res.elapsed_ms = int((time.perf_counter() - t0) * 1000)
    return res


def _saved(res, **own) -> dict:
    """The loop's state with the counters and the history of its result."""
    history = [[it, f, a, w.tolist()] for it, f, a, w in res.history]
    return own | {"history": history, "restarts": res.restarts, "passes": dict(res.passes), "evaluations": dict(res.evaluations), "final_loss": res.final_loss}


def _restored(res, state: dict) -> None:
    res.history = [(it, f, a, np.array(w)) for it, f, a, w in state["history"]]
    res.iterations, res.restarts, res.final_loss = len(res.history), state["restarts"], state["final_loss"]
    res.passes.update(state["passes"])
    res.evaluations.update(state["evaluations"])
    res.weights = state["w"]


def _run_wolfe(
    ev, res, w, max_iter, step_tol, grad_tol, c1, c2, max_bracket, max_zoom, with_hess, batched, kept=None
) -> None:
    state = kept.load() if kept is not None else None
    done = 0
    if state is not None:
        _restored(res, state)
        ev.n, done = state["n"], state["it"]
        w, d, g, f, g0, last_change, hess = (state[k] for k in ("w", "d", "g", "f", "g0", "last_change", "hess"))
    else:
        if with_hess:
            f, g, hess = ev.value_gradient_hessian(w)
        else:
            (f, g), hess = ev.value_and_gradient(w), None
        g0 = float(np.linalg.norm(g))
        d = -g
        last_change = None
        res.final_loss = f
    res.grad_norm = float(np.linalg.norm(g))
    res.stop_reason = "max_iter"
    for it in range(done + 1, max_iter + 1):
        gn = float(np.linalg.norm(g))
        if not _finite(f, gn):
            res.stop_reason = "non_finite"
            break
        if gn <= grad_tol * max(1.0, g0):
            res.stop_reason = "gradient"
            break
        s0 = float(g @ d)
        if not s0 < -RESTART_COS * gn * float(np.linalg.norm(d)):
            # not a descent direction, or nearly orthogonal to the gradient: restart
            d, s0 = -g, -(gn * gn)
            res.restarts += 1
        newton = None
        if hess is not None:
            dhd = float(d @ hess @ d)
            newton = -s0 / dhd if dhd > 0 else None
        t = strong_wolfe(
            ev, w, d, f, s0, None, c1, c2, max_bracket, max_zoom, newton, with_hess, batched, last_change
        )
        if not (_finite(t.alpha, t.loss) and t.alpha > 0):
            res.stop_reason = "line_search"
            break
        w_new = w + t.alpha * d
        res.history.append((it, f, t.alpha, w_new.copy()))
        res.iterations = it
        step = float(np.linalg.norm(w - w_new))
        w, last_change, f = w_new, t.change, t.loss
        res.weights, res.final_loss = w, f
        if step < step_tol * max(float(np.linalg.norm(w)), 1.0):
            res.stop_reason = "step"
            res.grad_norm = None if t.grad is None else float(np.linalg.norm(t.grad))
            break
        g_new, hess = t.grad, t.hess
        if g_new is None:
            if with_hess:
                _, g_new, hess = ev.value_gradient_hessian(w)
            else:
                _, g_new = ev.value_and_gradient(w)
        yv = g_new - g
        denom = float(d @ yv)
        beta = float(g_new @ yv) / denom if denom != 0 else float("nan")
        if _finite(beta):
            d = beta * d - g_new
        else:
            d = -g_new
            res.restarts += 1
        g = g_new
        res.grad_norm = float(np.linalg.norm(g))
        if kept is not None:
            kept.save(it, _saved(res, it=it, n=ev.n, w=w, d=d, g=g, f=f, g0=g0, last_change=last_change, hess=hess))
    res.weights = w


def _run_exact(ev, res, w, max_iter, step_tol, grad_tol, kept=None) -> None:
    """Squared loss: one pass per iteration (exact f, g at w plus q = avg((d.x) x))."""
    state = kept.load() if kept is not None else None
    done = 0
    if state is not None:
        _restored(res, state)
        done, w, d, g0 = (state[k] for k in ("it", "w", "d", "g0"))
    else:
        f, g = ev.value_and_gradient(w)
        g0 = float(np.linalg.norm(g))
        d = -g
        res.final_loss, res.grad_norm = f, g0
    res.stop_reason = "max_iter"
    for it in range(done + 1, max_iter + 1):
        f, g_exact, q = ev.curvature(w, d, kind="exact")
        gn = float(np.linalg.norm(g_exact))
        res.final_loss, res.grad_norm = f, gn
        if not _finite(f, gn):
            res.stop_reason = "non_finite"
            break
        if gn <= grad_tol * max(1.0, g0):
            res.stop_reason = "gradient"
            break
        s0 = float(g_exact @ d)
        if not s0 < 0:
            d = -g_exact
            res.restarts += 1
            f, g_exact, q = ev.curvature(w, d, kind="exact")
            s0 = float(g_exact @ d)
        curv = float(d @ q)
        if not (curv > 0 and s0 < 0):
            res.stop_reason = "line_search"
            break
        alpha = -s0 / curv
        w_new = w + alpha * d
        g_new = g_exact + alpha * q
        f_new = f + alpha * s0 + 0.5 * alpha * alpha * curv
        res.history.append((it, f, alpha, w_new.copy()))
        res.iterations = it
        step = float(np.linalg.norm(alpha * d))
        w = w_new
        res.weights, res.final_loss, res.grad_norm = w, f_new, float(np.linalg.norm(g_new))
        if step < step_tol * max(float(np.linalg.norm(w)), 1.0):
            res.stop_reason = "step"
            break
        yv = g_new - g_exact
        denom = float(d @ yv)
        beta = float(g_new @ yv) / denom if denom != 0 else float("nan")
        if _finite(beta):
            d = beta * d - g_new
        else:
            d = -g_new
            res.restarts += 1
        if kept is not None:
            kept.save(it, _saved(res, it=it, w=w, d=d, g0=g0))
    res.weights = w

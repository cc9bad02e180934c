"""Full-batch gradient descent.

Iteration i: one fused pass gives mean loss and gradient at ``w``; then
``w <- w - step/sqrt(i) * g``.  Stop when ``||w_old - w|| < tol * max(||w||, 1)``
or at ``max_iter``.  ``check_from=1`` tests from the first step on (the plain
optimizer); ``check_from=2`` skips the first test, as the stock MLlib
``GradientDescent`` does (it has no previous weights until iteration 2).

With ``batch_fraction`` below 1 an iteration uses the rows that a seeded hash of their key
and its number picks, each with that probability, so any engine and any partitioning draws
the same batches.  A row is hashed once, to two 32-bit numbers a and b; iteration i mixes them
with k = i * 2654435769 mod 2^32 as ``u = ((a ^ k) * BATCH_MIX[0] mod p ^ b) * BATCH_MIX[1] mod p``,
p being 2^31 - 1, and takes the row when u is below ``batch_fraction * p``.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Sequence
from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from ridgeline.functions.losses import get_loss
from ridgeline.operators.passes import EmptyDesign, evaluator
from ridgeline.plans.result import FitResult
from ridgeline.sources.design import Design, materialized


BATCH_PRIME = (1 << 31) - 1
BATCH_MIX = (1_540_483_477, 2_000_000_011)  # odd, below 2^31


def batch_columns(key: str, seed: int) -> dict:
    """The two hash numbers of a row; ``key`` is a SQL expression (a null key is the empty text)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.expr(key).cast("string"), F.lit(""))).cast("binary"))
    return {f"_batch_{c}": F.conv(F.substring(digest, at, 8), 16, 10).cast("long") for c, at in (("a", 1), ("b", 9))}


def in_batch(iteration: int, fraction: float):
    first = F.pmod(F.col("_batch_a").bitwiseXOR(F.lit(iteration * 2654435769 % (1 << 32))) * BATCH_MIX[0], F.lit(BATCH_PRIME))
    return F.pmod(first.bitwiseXOR(F.col("_batch_b")) * BATCH_MIX[1], F.lit(BATCH_PRIME)) < int(fraction * BATCH_PRIME)


def fit_gd(
    design: Design,
    loss="squared",
    step_size: float = 1.0,
    max_iter: int = 100,
    tol: float = 1e-3,
    init: Sequence[float] | None = None,
    reg_param: float = 0.0,
    check_from: int = 1,
    solver: str = "passes",
    storage: str = "memory_and_disk",
    method: str = "gd",
    form: str | None = None,
    batch_fraction: float = 1.0,
    batch_key: str | None = None,
    seed: int = 11,
) -> FitResult:
    """Fit by gradient descent.

    ``batch_fraction`` below 1 needs ``batch_key``, a SQL expression over the design's columns
    (pass key columns through with ``keep``).  An iteration without rows changes nothing; the
    final loss is that of all rows.
    """
    t0 = time.perf_counter()
    w = np.zeros(design.dim) if init is None else np.array(init, dtype=float)  # copy: input untouched
    passes: Counter = Counter()
    res = FitResult(method, get_loss(loss).name, design.features, w, reg_param=reg_param, passes=passes)
    ev = None
    res.design = design
    sampled, also = batch_fraction < 1.0, ()
    if sampled:
        if batch_key is None or solver != "passes":
            raise ValueError("batches need a batch_key and one pass per iteration (solver='passes')")
        drawn = batch_columns(batch_key, seed)
        design, also = replace(design, df=design.df.withColumns(drawn)), tuple(drawn)
    with materialized(design, storage, also) as ds:
        try:
            ev = whole = evaluator(ds, loss, reg_param, solver, passes, res.evaluations, form)
            for i in range(1, max_iter + 1):
                if sampled:
                    ev = evaluator(replace(ds, df=ds.df.where(in_batch(i, batch_fraction))), loss, reg_param, solver, passes, res.evaluations, form)
                try:
                    f, g = ev.value_and_gradient(w)
                except EmptyDesign:
                    if sampled:
                        continue
                    raise
                step = step_size / np.sqrt(i)
                w_new = w - step * g
                res.history.append((i, f, step, w_new.copy()))
                res.iterations, res.final_loss, res.grad_norm = i, f, float(np.linalg.norm(g))
                diff = float(np.linalg.norm(w - w_new))
                w = w_new
                if not np.all(np.isfinite(w)):
                    res.stop_reason = "non_finite"
                    break
                if i >= check_from and diff < tol * max(float(np.linalg.norm(w)), 1.0):
                    res.stop_reason = "step"
                    break
            ev = whole
            if res.stop_reason != "non_finite":
                res.final_loss = ev.value(w)
        except EmptyDesign:
            res.stop_reason = "empty"
        res.n_rows = (ev.n if ev is not None else None) or 0
        res.observed(ds)
    res.weights = w
    res.elapsed_ms = int((time.perf_counter() - t0) * 1000)
    return res

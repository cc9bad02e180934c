"""Stock Spark solvers run on the same design, for comparison (F8 and the F7 check).

``pyspark.ml`` fits the intercept itself, so the virtual bias column is left
out of the assembled vector and the fitted intercept is reported as the bias
weight (a constant 1.0 column with ``fitIntercept=False`` is not fitted
correctly by the stock solver).  The solvers block and cache their input themselves, so
the design is not cached before them.  ``reg_param`` is the plain ridge on the weights
(no standardization); the stock solvers never penalize the intercept, unlike the bias
weight of :func:`ridgeline.plans.presets.fit_logistic`.
"""

from __future__ import annotations

import time

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from ridgeline.plans.result import FitResult
from ridgeline.sources.design import Design, materialized


def _vector_frame(design: Design):
    if design.sparse:
        raise ValueError("the stock solvers take column and array designs; use ridgeline.fit_lbfgs for sparse rows")
    xs = [design.x(j) for j in range(design.stored_dim)]
    return design.df.select(design.y().alias("label"), array_to_vector(F.array(*xs)).alias("vec"))


def _result(method: str, loss: str, design: Design, coef, intercept, iterations: int, t0: float) -> FitResult:
    w = list(np.asarray(coef, dtype=float))
    if design.bias:
        w.append(float(intercept))
    res = FitResult(method, loss, design.features, np.array(w), iterations=iterations, stop_reason="solver")
    res.elapsed_ms = int((time.perf_counter() - t0) * 1000)
    return res


def fit_lbfgs_logistic(
    design: Design, reg_param: float = 0.0, max_iter: int = 100, tol: float = 1e-10, storage: str = "none"
) -> FitResult:
    """Two-class logistic regression by the stock L-BFGS solver (``pyspark.ml``)."""
    t0 = time.perf_counter()
    with materialized(design, storage) as ds:
        lr = LogisticRegression(
            featuresCol="vec",
            labelCol="label",
            family="binomial",
            fitIntercept=ds.bias,
            regParam=reg_param,
            elasticNetParam=0.0,
            standardization=False,
            maxIter=max_iter,
            tol=tol,
        )
        m = lr.fit(_vector_frame(ds))
        it = m.summary.totalIterations if m.hasSummary else 0
        return _result("lbfgs", "logistic", ds, m.coefficients.toArray(), m.intercept, it, t0)


def fit_ml_linear(
    design: Design, solver: str = "normal", reg_param: float = 0.0, max_iter: int = 100, tol: float = 1e-10,
    storage: str = "none",
) -> FitResult:
    """Least squares by the stock ``pyspark.ml`` solver (``normal`` or ``l-bfgs``)."""
    t0 = time.perf_counter()
    with materialized(design, storage) as ds:
        lr = LinearRegression(
            featuresCol="vec",
            labelCol="label",
            fitIntercept=ds.bias,
            regParam=reg_param,
            elasticNetParam=0.0,
            solver=solver,
            standardization=False,
            maxIter=max_iter,
            tol=tol,
        )
        m = lr.fit(_vector_frame(ds))
        it = m.summary.totalIterations if m.hasSummary else 0
        return _result(f"ml_{solver}", "squared", ds, m.coefficients.toArray(), m.intercept, it, t0)

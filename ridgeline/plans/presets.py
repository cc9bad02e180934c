"""Model presets and train/evaluate pipelines (F4, F5, F6, F7 and the two demo pipelines)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ridgeline.operators.metrics import accuracy, mse, predict
from ridgeline.plans.cg import fit_cg
from ridgeline.plans.gd import fit_gd
from ridgeline.plans.result import FitResult
from ridgeline.sources.design import Design


def fit_linear(design: Design, max_iter: int = 10, **kw) -> FitResult:
    """Linear regression by CG: least squares, zero start, no intercept beyond a bias feature."""
    return fit_cg(design, loss="squared", max_iter=max_iter, method="cg_linear", **kw)


def fit_logistic(design: Design, reg_param: float = 0.0, max_iter: int = 100, **kw) -> FitResult:
    """Logistic regression (labels 0/1) by CG with an optional true ridge term."""
    return fit_cg(design, loss="logistic", reg_param=reg_param, max_iter=max_iter, method="cg_logistic", **kw)


def fit_gd_stock(design: Design, step_size: float = 1e-5, max_iter: int = 100, tol: float = 0.01, **kw) -> FitResult:
    """The stock full-batch gradient descent settings (first stop test at iteration 2)."""
    return fit_gd(design, step_size=step_size, max_iter=max_iter, tol=tol, check_from=2, method="gd_stock", **kw)


def fit_linear_gd(design: Design, max_iter: int = 100, step_size: float = 1.0, tol: float = 1e-3, **kw) -> FitResult:
    """Stock linear regression by full-batch 'SGD' (fraction 1.0): GD with the stock stop test."""
    return fit_gd(design, step_size=step_size, max_iter=max_iter, tol=tol, check_from=2, method="gd_linear", **kw)


def linear_train_mse(design: Design, fit=fit_linear, **kw) -> tuple[FitResult, DataFrame]:
    """Fit a linear model, then its MSE on the training rows (one more pass)."""
    res = fit(design, **kw)
    return res, mse(predict(design, res.model()))


def logistic_train_accuracy(train: Design, test: Design, fit=fit_logistic, **kw) -> tuple[FitResult, DataFrame]:
    """Fit on the training rows, then accuracy on the held-out rows (one more pass)."""
    res = fit(train, **kw)
    return res, accuracy(predict(test, res.model()))

"""ridgeline: full-batch fitting of linear and logistic models on Spark DataFrames.

Every step of every fit is one Spark aggregate over the whole prepared table;
only the d weights and a few scalars travel to the driver between steps.
"""

from ridgeline.functions.losses import Loss, SqlLoss, hinge_loss, huber_loss
from ridgeline.functions.updaters import bounds, l1, ridge
from ridgeline.operators.metrics import accuracy, mse, predict
from ridgeline.operators.passes import (
    Evaluator,
    directional_derivative_table,
    gradient_table,
    line_search_profile,
    loss_table,
)
from ridgeline.plans.baselines import fit_lbfgs_logistic, fit_ml_linear
from ridgeline.plans.cg import fit_cg, strong_wolfe
from ridgeline.plans.gd import fit_gd
from ridgeline.plans.lbfgs import fit_lbfgs
from ridgeline.plans.presets import fit_gd_stock, fit_linear, fit_linear_gd, fit_logistic
from ridgeline.plans.result import FitResult, LinearModel
from ridgeline.plans.wide import fit_wide, fit_wide_gd, wide_design, wide_gradient, wide_scores
from ridgeline.sources.design import Design, array_points, labeled_points, materialized, sparse_points
from ridgeline.sources.libsvm import libsvm_design, read_libsvm, scan_libsvm, write_libsvm
from ridgeline.sources.prepare import append_bias, binarize_label, key_split, random_split

__all__ = [
    "Design",
    "Evaluator",
    "FitResult",
    "LinearModel",
    "Loss",
    "SqlLoss",
    "accuracy",
    "append_bias",
    "array_points",
    "binarize_label",
    "bounds",
    "directional_derivative_table",
    "fit_cg",
    "fit_gd",
    "fit_gd_stock",
    "fit_lbfgs",
    "fit_lbfgs_logistic",
    "fit_linear",
    "fit_linear_gd",
    "fit_logistic",
    "fit_ml_linear",
    "fit_wide",
    "fit_wide_gd",
    "gradient_table",
    "hinge_loss",
    "huber_loss",
    "key_split",
    "l1",
    "labeled_points",
    "libsvm_design",
    "line_search_profile",
    "loss_table",
    "materialized",
    "mse",
    "predict",
    "random_split",
    "read_libsvm",
    "ridge",
    "scan_libsvm",
    "sparse_points",
    "strong_wolfe",
    "wide_design",
    "wide_gradient",
    "wide_scores",
    "write_libsvm",
]

"""Prediction and evaluation (E4-E7, A5, A6): per-row expressions and one-pass aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.losses import sigmoid
from ridgeline.plans.result import LinearModel
from ridgeline.sources.design import Design, sql_name


def predict(design: Design, model: LinearModel, keep: Sequence[str] = ()) -> DataFrame:
    """Add ``prediction`` (and ``probability`` for logistic models) to the design rows.

    Linear: ``prediction = w.x``.  Logistic: ``probability = sigmoid(w.x)`` and
    ``prediction = 1.0`` only when the probability is strictly above the
    threshold (a tie is class 0).  ``keep`` names pass-through columns of the
    design table (keys) to carry along.
    """
    if tuple(model.features) != tuple(design.features):
        raise ValueError(f"model features {model.features} do not match design features {design.features}")
    rows = design.margins([*map(sql_name, keep), f"{design.y_sql()} AS label"], _z=model.weights)
    if model.kind == "linear":
        return rows.withColumnRenamed("_z", "prediction")
    prob = sigmoid(F.col("_z"))
    return rows.select(
        *keep,
        "label",
        prob.alias("probability"),
        F.when(prob > F.lit(float(model.threshold)), F.lit(1.0)).otherwise(F.lit(0.0)).alias("prediction"),
    )


def squared_error(prediction: str = "prediction", label: str = "label"):
    """``(prediction - label)^2`` (no 1/2)."""
    return F.pow(F.col(prediction) - F.col(label), F.lit(2.0))


def correct_flag(prediction: str = "prediction", label: str = "label"):
    """1.0 when the prediction equals the label, else 0.0."""
    return (F.col(prediction) == F.col(label)).cast("double")


def mse(predictions: DataFrame, prediction: str = "prediction", label: str = "label") -> DataFrame:
    """One row ``(n, mse)``: mean squared error over the predicted rows (A5)."""
    e = squared_error(prediction, label)
    return predictions.agg(F.count(e).alias("n"), F.avg(e).alias("mse"))


def accuracy(predictions: DataFrame, prediction: str = "prediction", label: str = "label") -> DataFrame:
    """One row ``(n, accuracy)``: share of correct predictions (A6); NULL accuracy on no rows."""
    c = correct_flag(prediction, label)
    return predictions.agg(F.count(c).alias("n"), F.avg(c).alias("accuracy"))

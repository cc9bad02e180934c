"""What a fit returns: weights, run statistics and history, each also as a DataFrame.

Only O(d) numbers per iteration live on the driver; they are handed back as
small DataFrames (weights, fit report, per-iteration history).
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

WEIGHTS_SCHEMA = T.StructType(
    [
        T.StructField("feature_index", T.IntegerType(), False),
        T.StructField("feature", T.StringType(), False),
        T.StructField("weight", T.DoubleType(), True),
    ]
)

HISTORY_SCHEMA = T.StructType(
    [
        T.StructField("iteration", T.IntegerType(), False),
        T.StructField("loss", T.DoubleType(), True),
        T.StructField("alpha", T.DoubleType(), True),
        T.StructField("feature_index", T.IntegerType(), False),
        T.StructField("feature", T.StringType(), False),
        T.StructField("weight", T.DoubleType(), True),
    ]
)

REPORT_SCHEMA = T.StructType(
    [
        T.StructField("method", T.StringType(), False),
        T.StructField("loss", T.StringType(), False),
        T.StructField("reg_param", T.DoubleType(), False),
        T.StructField("n_rows", T.LongType(), True),
        T.StructField("dim", T.IntegerType(), False),
        T.StructField("iterations", T.IntegerType(), False),
        T.StructField("stop_reason", T.StringType(), False),
        T.StructField("final_loss", T.DoubleType(), True),
        T.StructField("grad_norm", T.DoubleType(), True),
        T.StructField("passes", T.IntegerType(), False),
        T.StructField("gradient_passes", T.IntegerType(), False),
        T.StructField("bracket_passes", T.IntegerType(), False),
        T.StructField("zoom_passes", T.IntegerType(), False),
        T.StructField("newton_passes", T.IntegerType(), False),
        T.StructField("exact_passes", T.IntegerType(), False),
        T.StructField("gram_passes", T.IntegerType(), False),
        T.StructField("final_passes", T.IntegerType(), False),
        T.StructField("bracket_losses", T.IntegerType(), False),
        T.StructField("bracket_gradients", T.IntegerType(), False),
        T.StructField("zoom_losses", T.IntegerType(), False),
        T.StructField("zoom_gradients", T.IntegerType(), False),
        T.StructField("newton_losses", T.IntegerType(), False),
        T.StructField("newton_gradients", T.IntegerType(), False),
        T.StructField("dropped_rows", T.LongType(), True),
        T.StructField("restarts", T.IntegerType(), False),
        T.StructField("elapsed_ms", T.LongType(), False),
    ]
)


def _opt(v: float | None) -> float | None:
    return None if v is None else float(v)


@dataclass(frozen=True)
class LinearModel:
    """Fitted linear model; the bias (if any) is the last weight, on a constant 1.0 feature."""

    kind: str  # "linear" or "logistic"
    features: tuple[str, ...]
    weights: tuple[float, ...]
    threshold: float = 0.5


@dataclass
class FitResult:
    method: str
    loss: str
    features: tuple[str, ...]
    weights: np.ndarray
    iterations: int = 0
    stop_reason: str = "max_iter"
    final_loss: float | None = None
    grad_norm: float | None = None
    n_rows: int | None = None
    reg_param: float = 0.0
    passes: Counter = field(default_factory=Counter)
    evaluations: Counter = field(default_factory=Counter)  # losses and gradients by kind of pass
    design: object = None  # to count the rows that the row rule left out, where no pass did
    dropped: int | None = None
    restarts: int = 0
    elapsed_ms: int = 0
    history: list = field(default_factory=list)  # (iteration, loss at start, alpha, weights after)

    @property
    def total_passes(self) -> int:
        return int(sum(self.passes.values()))

    def model(self, threshold: float = 0.5) -> LinearModel:
        kind = "logistic" if self.loss == "logistic" else "linear"
        return LinearModel(kind, tuple(self.features), tuple(float(v) for v in self.weights), threshold)

    # ---------------------------------------------------------- DataFrames
    def weights_df(self, spark: SparkSession) -> DataFrame:
        rows = [(j, name, float(v)) for j, (name, v) in enumerate(zip(self.features, self.weights))]
        return spark.createDataFrame(rows, WEIGHTS_SCHEMA)

    def history_df(self, spark: SparkSession) -> DataFrame:
        rows = [
            (int(it), _opt(loss), _opt(alpha), j, name, float(v))
            for it, loss, alpha, w in self.history
            for j, (name, v) in enumerate(zip(self.features, w))
        ]
        return spark.createDataFrame(rows, HISTORY_SCHEMA)

    def report_row(self) -> tuple:
        p = self.passes
        return (
            self.method,
            self.loss,
            float(self.reg_param),
            None if self.n_rows is None else int(self.n_rows),
            len(self.features),
            int(self.iterations),
            self.stop_reason,
            _opt(self.final_loss),
            _opt(self.grad_norm),
            self.total_passes,
            int(p["gradient"]),
            int(p["bracket"]),
            int(p["zoom"]),
            int(p["newton"]),
            int(p["exact"]),
            int(p["gram"]),
            int(p["final"]),
            *[int(self.evaluations[f"{kind}_{what}"]) for kind in ("bracket", "zoom", "newton") for what in ("loss", "gradient")],
            self.dropped_rows(),
            int(self.restarts),
            int(self.elapsed_ms),
        )

    def observed(self, design) -> None:
        """Take the rows that the kept design's source had from its first pass (Spark reports none for empty plans)."""
        if design.reads is not None and self.n_rows:
            self.dropped = int(design.reads.get["rows"]) - int(self.n_rows)

    def dropped_rows(self) -> int | None:
        """Rows that the row rule left out; two counts where the fit kept no table of its own."""
        if self.dropped is None and self.design is not None:
            self.dropped = int(self.design.dropped_rows())
        return self.dropped

    def report_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([self.report_row()], REPORT_SCHEMA)

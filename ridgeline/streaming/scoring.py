"""Apply a fitted linear / logistic model to a streaming DataFrame (E4/E5 on a stream).

Prediction is a stateless projection, so the streaming plan is a plain
per-micro-batch ``Project``: no state store, no watermark, no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from ridgeline.operators.metrics import predict
from ridgeline.plans.result import LinearModel
from ridgeline.sources.design import Design


def score_stream(
    stream: DataFrame, prepare: Callable[[DataFrame], Design], model: LinearModel, keep: Sequence[str] = ()
) -> DataFrame:
    """``prepare`` builds the design from the stream (same code as for the training table)."""
    if not stream.isStreaming:
        raise ValueError("score_stream expects a streaming DataFrame (spark.readStream ...)")
    return predict(prepare(stream), model, keep=keep)

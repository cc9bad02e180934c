"""Streams: scoring a stream with a fitted model.

The fitting methods are full-batch (every step reads the whole table), so
there is no streaming fit.  A fitted model is a set of column expressions,
so the same ``predict`` works unchanged on a streaming DataFrame.
"""

from ridgeline.streaming.scoring import score_stream

__all__ = ["score_stream"]

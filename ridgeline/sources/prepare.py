"""Row preparation (P1, P2, P4, P5): label remap, bias, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def binarize_label(label: Column | str, negative: float = 2.0) -> Column:
    """``label == negative -> 0.0``, any other value -> ``1.0``; NULL stays NULL."""
    y = F.col(label) if isinstance(label, str) else label
    return F.when(y.isNull(), F.lit(None).cast("double")).when(y == F.lit(negative), F.lit(0.0)).otherwise(F.lit(1.0))


def append_bias(features: Column | str) -> Column:
    """P2 for array features: append a constant 1.0 as the last entry."""
    arr = F.col(features) if isinstance(features, str) else features
    return F.concat(arr.cast("array<double>"), F.array(F.lit(1.0)))


def key_part(key: Column, parts: int = 5, test_part: int = 0) -> Column:
    """P5 as a column: ``'test'`` when ``pmod(key, parts) == test_part``, else ``'train'`` (a NULL key too)."""
    return F.when(F.pmod(key, F.lit(parts)) == F.lit(test_part), F.lit("test")).otherwise(F.lit("train"))


def key_split(df: DataFrame, key: Column, parts: int = 5, test_part: int = 0) -> tuple[DataFrame, DataFrame]:
    """P5: reproducible split on an integer key: ``pmod(key, parts) == test_part`` is the test set.

    A pure row function, so the split does not depend on partitioning, order or
    retries, and any engine computes the same split.  Both sides are filters
    behind the same scan.
    """
    part = key_part(key, parts, test_part)
    return df.where(part == F.lit("train")), df.where(part == F.lit("test"))


def random_part(key: Column | list[Column], weights=(0.8, 0.2), seed: int = 11) -> Column:
    """P4 as a column: the number of the part a row falls into, by a seeded hash of its key.

    One scan, no sort, and the same part for a key in any run or partitioning.
    """
    keys = key if isinstance(key, (list, tuple)) else [key]
    u = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 30)) / float(1 << 30)
    total, at, part = float(sum(weights)), 0.0, F.lit(len(weights) - 1)
    bounds = []
    for w in weights[:-1]:
        at += w / total
        bounds.append(at)
    for k in range(len(bounds) - 1, -1, -1):
        part = F.when(u < bounds[k], F.lit(k)).otherwise(part)
    return part


def random_split(df: DataFrame, weights=(0.8, 0.2), seed: int = 11, key: list[Column] | None = None) -> list[DataFrame]:
    """Seeded random parts of a table, by ``key`` (default: all columns; equal rows stay together)."""
    part = random_part(key or [F.col(f"`{c}`") for c in df.columns], weights, seed)
    return [df.where(part == k) for k in range(len(weights))]

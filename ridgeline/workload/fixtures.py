"""Labelled tables derived from the shared test tables (see FIXTURES.md).

Each fixture is written once as SQL expression text over a source table; the
same text is used by the Spark queries (through ``F.expr``) and by the DuckDB
oracle SQL, so both sides prepare identical rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.sources.design import Design, array_points, labeled_points


@dataclass(frozen=True)
class Fixture:
    table: str
    label: str
    features: tuple[tuple[str, str], ...]  # (name, SQL expression), in weight order
    bias: bool = True

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(n for n, _ in self.features) + (("bias",) if self.bias else ())

    def design(self, source: DataFrame, keep=()) -> Design:
        return labeled_points(
            source, F.expr(self.label), {n: F.expr(e) for n, e in self.features}, bias=self.bias, keep=keep
        )

    def sql_points(self, where: str | None = None, keep: str = "") -> str:
        """DuckDB: ``SELECT y, x1..xk[, 1.0 AS x(k+1)] FROM table`` for the oracle."""
        cols = [f"({self.label}) AS y"] + [f"({e}) AS x{j + 1}" for j, (_, e) in enumerate(self.features)]
        if self.bias:
            cols.append(f"1.0 AS x{len(self.features) + 1}")
        if keep:
            cols = [keep] + cols
        sql = f"SELECT {', '.join(cols)} FROM {self.table}"
        return sql + (f" WHERE {where}" if where else "")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# --- fixed fixture definitions (FIXTURES.md, "Derived fixtures") -------------
LIN3 = Fixture(
    "lineitem",
    "l_extendedprice / 100000",
    (("qty", "l_quantity / 50"), ("disc", "l_discount * 10")),
)
LIN_NET = Fixture(
    "lineitem",
    "l_extendedprice * (1 - l_discount) * (1 + l_tax) / 100000",
    (("price", "l_extendedprice / 100000"), ("disc", "l_discount * 10")),
)
LIN_RAW = Fixture(
    "lineitem",
    "l_extendedprice",
    (("qty", "l_quantity"), ("disc", "l_discount")),
)
LOG2 = Fixture(
    "lineitem",
    "CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END",
    (("qty", "l_quantity / 50"),),
)
LOG_SIG = Fixture(
    "lineitem",
    "CASE WHEN l_extendedprice / 100000 + l_quantity / 50 > 1 THEN 1.0 ELSE 0.0 END",
    (("qty", "l_quantity / 50"),),
)
# Reproducible 80/20 split: rows whose key is 0 modulo 5 are the test set.
SPLIT_KEY = "l_orderkey * 7 + l_linenumber"
SPLIT_PARTS = 5
# Two-class embedding label: class 2 is negative, every other class positive.
EMB_NEGATIVE = 2
EMB_DIM = 64
EMB_NARROW = 4


def lineitem_design(spark: SparkSession, sf_dir: str, fx: Fixture, keep=()) -> Design:
    return fx.design(read_table(spark, sf_dir, fx.table), keep=keep)


def split_designs(spark: SparkSession, sf_dir: str, fx: Fixture) -> tuple[Design, Design]:
    """Train / test designs of a lineitem fixture under the key split."""
    from ridgeline.sources.prepare import key_split

    src = read_table(spark, sf_dir, fx.table)
    train, test = key_split(src, F.expr(SPLIT_KEY), SPLIT_PARTS, 0)
    return fx.design(train), fx.design(test)


def embedding_design(spark: SparkSession, sf_dir: str, width: int = EMB_DIM, keep=()) -> Design:
    """Form B: ``label = (class != 2)``, the first ``width`` embedding entries, virtual bias last."""
    from ridgeline.sources.prepare import binarize_label

    emb = read_table(spark, sf_dir, "embeddings")
    arr = F.col("embedding") if width == EMB_DIM else F.slice("embedding", 1, width)
    return array_points(
        emb, binarize_label("label", EMB_NEGATIVE), arr, width, bias=True, keep=keep
    )

"""LibSVM text source and sink (S1): ``label idx:val ...`` lines, one-based ascending indexes.

The lines are read and parsed by DataFrame expressions, so rows are sparse from the start and
damaged lines can be told from good ones.  A line is good when its label and values are
numbers and its indexes are ascending integers from 1 (up to ``num_features`` where that is
given); blank lines and lines of a ``#`` comment are no rows, and a ``#`` ends a line.
:func:`scan_libsvm` finds the dimension and the damage in one pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.sources.design import Design, array_points, sparse_points, sql_name

ON_DAMAGE = ("fail", "drop")
#: Lines that arrays of numbers are made of at once: numbers without suffix, special value or large exponent, indexes of up to nine digits.
_NUMBER = r"[0-9]{1,17}(\.[0-9]{1,20})?([eE]-?[0-9]{1,2})?"
PLAIN = rf"^[+-]?{_NUMBER}( [1-9][0-9]{{0,8}}:-?{_NUMBER})*$"
PLAIN_ROWS = "line string, label double, indices array<int>, values array<double>, plain boolean"


def read_libsvm(spark: SparkSession, path: str, num_features: int) -> DataFrame:
    """Raw LibSVM rows by Spark's own source: ``label double, features vector``."""
    return spark.read.format("libsvm").option("numFeatures", int(num_features)).load(path)


def _plain_lines(batches):
    """Rows of :data:`PLAIN_ROWS`: lines of plain numbers and ascending indexes parsed by the batch, all others left to expressions."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        line = pc.ascii_rtrim(batch.column(0), " ")
        plain = pc.match_substring_regex(line, PLAIN)
        numbers = pc.replace_substring(pc.ascii_ltrim(pc.if_else(plain, line, "0"), "+"), ":", " ")
        cells = pc.split_pattern(numbers, " ")
        first = cells.offsets.to_numpy().astype(np.int64)
        number = cells.flatten().cast(pa.float64()).to_numpy()
        of_row = np.ones(len(number), dtype=bool)
        of_row[first[:-1]] = False
        index, value = number[of_row].reshape(-1, 2).T
        at = (first - np.arange(len(first))) // 2  # where a row's entries begin
        falls = np.zeros(len(index) + 1, dtype=np.int64)
        falls[1:-1] = np.diff(index) <= 0
        falls[at] = 0
        falls = np.concatenate([[0], np.cumsum(falls)])
        ok = plain.to_numpy(zero_copy_only=False) & (falls[at[1:]] == falls[at[:-1]])
        offsets = pa.array(at, pa.int32())
        entries = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in ((index - 1).astype(np.int32), value)]
        yield pa.RecordBatch.from_arrays([line, pa.array(number[first[:-1]]), *entries, pa.array(ok)], names=["line", "label", "indices", "values", "plain"])


def parse_libsvm(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``(line, label, indices, values, good)`` of every line that is a row; indices from 0, null where damaged.

    Expressions state what a line means; they parse the lines that :func:`_plain_lines` leaves.
    """
    lines = spark.read.text(path if isinstance(path, str) else list(path)).select("value").mapInArrow(_plain_lines, PLAIN_ROWS)
    plain = F.col("plain")
    text = F.trim(F.regexp_replace(F.split_part("line", F.lit("#"), F.lit(1)), r"\s+", " "))
    lines = lines.withColumn("line", F.when(plain, F.col("line")).otherwise(text)).filter("line <> ''")
    parts = F.split("line", " ")
    pairs = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda t: F.struct(
        F.when(t.rlike(r"^[0-9]+:[^:]+$"), F.substring_index(t, ":", 1)).try_cast("int").alias("i"), F.substring_index(t, ":", -1).try_cast("double").alias("v")))
    label = F.get(parts, F.lit(0)).try_cast("double")

    def row(entries):
        ascending = F.forall(F.transform(entries, lambda e, k: (e["i"] >= 1) & e["v"].isNotNull() & ((k == 0) | (F.get(entries, k - 1)["i"] < e["i"]))), lambda ok: F.coalesce(ok, F.lit(False)))
        indices, values = F.transform(entries, lambda e: e["i"] - 1), F.transform(entries, lambda e: e["v"])
        return F.struct(label.alias("label"), indices.alias("indices"), values.alias("values"), (label.isNotNull() & ascending).alias("good"))

    own = F.array(F.struct("label", "indices", "values", F.lit(True).alias("good")))
    # a one-row generator: filters on its result are not pushed below it, which would parse again for every use
    return lines.select("line", F.inline(F.when(plain, own).otherwise(F.transform(F.array(pairs), row))))


@dataclass(frozen=True)
class LibsvmScan:
    rows: int  # good ones
    damaged: int
    num_features: int  # largest index of a good line
    entries: int


def scan_libsvm(spark: SparkSession, path: str | Sequence[str]) -> LibsvmScan:
    """Dimension and damage of LibSVM file(s), in one pass."""
    good = F.col("good")
    r = parse_libsvm(spark, path).agg(
        F.count_if(good), F.count_if(~good), F.coalesce(F.max(F.when(good, F.array_max("indices"))) + 1, F.lit(0)), F.coalesce(F.sum(F.when(good, F.size("indices"))), F.lit(0)),
    ).first()
    return LibsvmScan(*map(int, r))


def libsvm_design(
    spark: SparkSession,
    path: str | Sequence[str],
    num_features: int | None = None,
    bias: bool = False,
    names: Sequence[str] | None = None,
    sparse: bool = True,
    damaged: str = "fail",
) -> Design:
    """LibSVM file(s) as a sparse design (default) or with dense arrays; optional virtual bias.

    Without ``num_features`` one pass over the files finds the largest index.  ``damaged``: a bad
    line is an error when it is read (``"fail"``) or left out and counted as dropped (``"drop"``).
    """
    if damaged not in ON_DAMAGE:
        raise ValueError(f"unknown rule for damaged lines {damaged!r}")
    if num_features is None:
        num_features = scan_libsvm(spark, path).num_features
    rows = parse_libsvm(spark, path)
    good = F.col("good") & F.forall("indices", lambda i: i < num_features)
    if damaged == "fail":
        bad = F.raise_error(F.concat(F.lit("damaged LibSVM line: "), F.substring("line", 1, 200)))
        rows = rows.withColumn("label", F.when(good, F.col("label")).otherwise(bad))
    else:  # a null label is left out by the row rule
        rows = rows.withColumns({"label": F.when(good, F.col("label")), "indices": F.when(good, F.col("indices")), "values": F.when(good, F.col("values"))})
    design = sparse_points(rows, "label", "indices", "values", num_features, bias=bias, names=names)
    return design if sparse else densified(design)


def densified(design: Design) -> Design:
    """A sparse design as arrays of all its features."""
    dim, col = design.stored_dim, sql_name(design.array_col)
    found = f"get({col}.values, CAST(array_position({col}.indices, j) AS INT) - 1)"
    dense = F.expr(f"transform(sequence(0, {dim - 1}), j -> coalesce({found}, 0.0D))") if dim else F.array().cast("array<double>")
    rows = design.df.select(*design.keep, design.label, dense.alias(design.array_col))
    names = design.features[: design.stored_dim]
    return array_points(rows, design.label, design.array_col, dim, bias=design.bias, names=names, keep=design.keep)


def write_libsvm(design: Design, path: str, mode: str = "error") -> None:
    """Write the stored features of a design as LibSVM text (the virtual bias is not written), zeros left out."""
    if design.sparse:
        col = sql_name(design.array_col)
        pairs = F.array_sort(F.filter(F.arrays_zip(F.expr(f"{col}.indices").alias("i"), F.expr(f"{col}.values").alias("v")), lambda e: e["v"] != 0))
        pairs = F.transform(pairs, lambda e: F.concat_ws(":", (e["i"] + 1).cast("string"), e["v"].cast("string")))
    else:
        values = F.col(design.array_col) if design.array_col else F.array(*[design.x(j) for j in range(design.stored_dim)])
        pairs = F.transform(values, lambda v, i: F.when(v != 0, F.concat_ws(":", (i + 1).cast("string"), v.cast("string"))))
    line = F.concat_ws(" ", design.y().cast("string"), F.array_compact(pairs))
    design.df.select(line.alias("value")).write.mode(mode).text(path)

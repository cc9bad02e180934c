"""The prepared training table ("design"): a label column plus an ordered feature list.

Two physical forms hold the same thing:

* form A (``array_col is None``): one double column per feature.  Every pass is
  one ``agg`` whose expressions are ordinary arithmetic, so the whole pass sits
  in one whole-stage-codegen span next to a column-pruned Parquet scan.
* form B (``array_col`` set): ``features array<double>`` of fixed length, or, with
  ``sparse``, ``features struct<indices array<int>, values array<double>>``.

One row rule for all of them: a row with a NULL or NaN label, feature or array element
is left out (``dropped_rows`` counts these), and an array of another length is an error.

A constant bias feature is *virtual*: it is the literal ``1.0`` placed last in the
feature order, so it costs no storage and folds away in ``w_bias * 1.0``.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

LABEL = "label"
FEATURES = "features"
BIAS = "bias"
#: A block of sparse rows: labels, entries of each row, and all entries, as the bytes of arrays; it begins no row after so many entries.
PACKED = "n int, label binary, lengths binary, indices binary, value binary"
PACKED_ENTRIES = 1 << 16
#: Sparse designs: up to so many weights are a literal in the plan, up to so many go to the tasks as an array.
LITERAL_WEIGHTS, SENT_WEIGHTS = 1 << 16, 1 << 24


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sql_name(name: str) -> str:
    """Quoted identifier for SQL text."""
    return "`" + name.replace("`", "``") + "`"


def sql_double(v: float) -> str:
    """Exact double literal for SQL text (shortest round-trip form)."""
    v = float(v)
    if v != v:
        return "CAST('NaN' AS DOUBLE)"
    if v in (float("inf"), float("-inf")):
        return "CAST('Infinity' AS DOUBLE)" if v > 0 else "CAST('-Infinity' AS DOUBLE)"
    return f"({v!r}D)".upper()


@dataclass(frozen=True)
class Design:
    df: DataFrame
    features: tuple[str, ...]
    label: str = LABEL
    array_col: str | None = None
    bias: bool = False
    keep: tuple[str, ...] = ()  # pass-through columns (keys), never features
    sparse: bool = False
    source: DataFrame | None = None  # the rows before the row rule
    rule: Column | None = None  # the row rule, and the table that it gave
    ruled: DataFrame | None = None
    reads: Observation | None = None  # rows of the source, counted by the first pass over the kept table
    packed: bool = False  # sparse rows kept as PACKED blocks of many rows

    def dropped_rows(self) -> int:
        """Rows that the row rule left out; runs two counts (a fit counts them on its way)."""
        return 0 if self.source is None else self.source.count() - self.df.count()

    # ----------------------------------------------------------------- shape
    @property
    def dim(self) -> int:
        return len(self.features)

    @property
    def stored_dim(self) -> int:
        """Number of features that are stored (everything but the virtual bias)."""
        return self.dim - (1 if self.bias else 0)

    # ----------------------------------------------------------- expressions
    def y(self) -> Column:
        return F.col(self.label)

    def x(self, j: int) -> Column:
        if self.bias and j == self.dim - 1:
            return F.lit(1.0)
        if self.sparse:
            return F.expr(self.x_sql(j))
        if self.array_col is not None:
            return F.col(self.array_col).getItem(j)
        return F.col(self.features[j])

    def x_sql(self, j: int) -> str:
        if self.bias and j == self.dim - 1:
            return "1.0D"
        if self.sparse:
            col = sql_name(self.array_col)
            return f"aggregate(zip_with({col}.indices, {col}.values, (i, v) -> IF(i = {j}, v, 0.0D)), 0.0D, (a, t) -> a + t)"
        if self.array_col is not None:
            return f"{sql_name(self.array_col)}[{j}]"
        return sql_name(self.features[j])

    def y_sql(self) -> str:
        return sql_name(self.label)

    def dot_sql(self, v: Sequence[float]) -> str:
        """SQL text of ``sum_j v_j * x_j`` (same arithmetic as :meth:`dot`)."""
        if len(v) != self.dim:
            raise ValueError(f"vector of length {len(v)} for a design of dimension {self.dim}")
        if not len(v):
            return "0.0D"
        if self.sparse:
            if len(v) > LITERAL_WEIGHTS:
                raise ValueError(f"{len(v)} weights are too many for an expression (at most {LITERAL_WEIGHTS}); use Design.margins")
            # one literal, folded when the plan is made; each row looks up the weights of its non-zeros
            col, weights = sql_name(self.array_col), ",".join(repr(float(t)) for t in v)
            bias = f" + {sql_double(v[-1])}" if self.bias else ""
            return f"(aggregate(zip_with({col}.indices, {col}.values, (i, x) -> x * CAST(split('{weights}', ',') AS ARRAY<DOUBLE>)[i]), 0.0D, (a, t) -> a + t){bias})"
        return "(" + " + ".join(f"{sql_double(vj)} * {self.x_sql(j)}" for j, vj in enumerate(v)) + ")"

    def dot(self, v: Sequence[float]) -> Column:
        """``sum_j v_j * x_j`` as one arithmetic expression (JVM side, codegen'd).

        Parsed from its SQL text in one call: building it term by term costs a
        driver-to-JVM round trip per term.
        """
        return F.expr(self.dot_sql(v))

    def margins(self, columns: Sequence[str], **vectors: Sequence[float]) -> DataFrame:
        """The columns (SQL) of every row and, by name, its margin under each vector of weights.

        JVM-side expressions; for sparse designs of more than LITERAL_WEIGHTS features the weights
        go to the tasks as arrays, and models beyond SENT_WEIGHTS are :mod:`ridgeline.plans.wide`'s.
        """
        if not self.sparse or self.dim <= LITERAL_WEIGHTS:
            return self.df.selectExpr(*columns, *[f"{self.dot_sql(v)} AS {sql_name(n)}" for n, v in vectors.items()])
        if self.dim > SENT_WEIGHTS:
            raise ValueError(f"{self.dim} weights are too many for one array (at most {SENT_WEIGHTS}); use ridgeline.plans.wide")
        import numpy as np

        rows = self.df.selectExpr(*columns, f"{sql_name(self.array_col)} AS _features")
        given = [f for f in rows.schema.fields if f.name != "_features"]
        weights, bias = {n: np.asarray(v, dtype=float) for n, v in vectors.items()}, self.bias
        schema = StructType([*given, *[StructField(n, DoubleType()) for n in weights]])

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                features, n = batch.column(batch.num_columns - 1), batch.num_rows
                cells = features.field(0)
                row = np.repeat(np.arange(n), np.diff(cells.offsets.to_numpy()))
                index, value = cells.flatten().to_numpy(), features.field(1).flatten().to_numpy()
                none = np.asarray(features.is_null().to_numpy(zero_copy_only=False), dtype=bool)
                out = [pa.array(np.bincount(row, w[index] * value, n).astype(float) + (w[-1] if bias else 0.0), mask=none) for w in weights.values()]
                yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(len(given))] + out, names=[f.name for f in given] + list(weights))

        return rows.mapInArrow(run, schema)

    def name_sql(self, index: str) -> Column:
        """The feature name at a column of indices."""
        own, i = self.features[: self.stored_dim], F.col(index)
        if all(n == f"x{j}" for j, n in enumerate(own)):
            name = F.concat(F.lit("x"), i.cast("string"))
        else:
            name = F.get(F.split(F.lit("\x01".join(own)), "\x01"), i)
        return F.when(i < self.stored_dim, name).otherwise(F.lit(BIAS))

    # -------------------------------------------------------------- storage
    def select_only(self, also: Sequence[str] = ()) -> Design:
        """Drop every column the fit does not read (so caching keeps only those)."""
        cols = [self.label] + ([self.array_col] if self.array_col else list(self.features[: self.stored_dim])) + list(also)
        return replace(self, df=self.df.select(*cols), keep=())

    def observed(self, also: Sequence[str] = ()) -> Design:
        """:meth:`select_only`, with the rows before the row rule counted as they go by (``reads``)."""
        if self.rule is None or self.df is not self.ruled or also:
            return self.select_only(also)
        stored = [self.array_col] if self.array_col else list(self.features[: self.stored_dim])
        seen = Observation()
        rows = self.source.select(self.label, *stored).observe(seen, F.count(F.lit(1)).alias("rows"))
        return replace(self, df=rows.where(self.rule), keep=(), reads=seen)


# ------------------------------------------------------------------ builders
def labeled_points(
    df: DataFrame,
    label: Column | str,
    features: Mapping[str, Column | str] | Sequence[str],
    bias: bool = False,
    drop_nulls: bool = True,
    keep: Sequence[str] = (),
) -> Design:
    """Form A design: ``label double`` and one double column per feature.

    ``features`` is either a list of existing column names or an ordered mapping
    ``name -> expression``.  Rows with a NULL (or NaN) label or feature are
    filtered out right after the scan (in the same codegen span); otherwise a
    NULL would silently drop the row from some averages and not from others.
    """
    if isinstance(features, Mapping):
        items = [(name, _col(e)) for name, e in features.items()]
    else:
        items = [(name, F.col(name)) for name in features]
    names = tuple(n for n, _ in items)
    if LABEL in names or (bias and BIAS in names):
        raise ValueError("feature names must differ from 'label' and 'bias'")
    out = df.select(
        *keep,
        _col(label).cast("double").alias(LABEL),
        *[e.cast("double").alias(n) for n, e in items],
    )
    source, rule = out, None
    if drop_nulls:
        rule = F.expr(" AND ".join(f"{sql_name(n)} IS NOT NULL AND NOT isnan({sql_name(n)})" for n in (LABEL, *names)))
        out = out.dropna(subset=[LABEL, *names])
    return Design(df=out, features=names + ((BIAS,) if bias else ()), bias=bias, keep=tuple(keep), source=source, rule=rule, ruled=out)


def array_points(
    df: DataFrame,
    label: Column | str,
    features: Column | str,
    dim: int,
    bias: bool = False,
    names: Sequence[str] | None = None,
    drop_nulls: bool = True,
    keep: Sequence[str] = (),
) -> Design:
    """Form B design: ``label double`` and ``features array<double>`` of length ``dim``.

    An array of another length raises when the row is read.
    """
    arr = _col(features).cast("array<double>")
    fits = F.when(F.size(arr) == dim, arr).when(arr.isNotNull(), F.raise_error(F.concat(F.lit(f"an array of {dim} features is expected, one has "), F.size(arr))))
    source = df.select(*keep, _col(label).cast("double").alias(LABEL), fits.alias(FEATURES))
    return _design(source, _whole(F.col(FEATURES)) if drop_nulls else None, dim, bias, names, keep, sparse=False)


def sparse_points(
    df: DataFrame, label: Column | str, indices: Column | str, values: Column | str, dim: int, bias: bool = False,
    names: Sequence[str] | None = None, drop_nulls: bool = True, keep: Sequence[str] = (),
) -> Design:
    """Sparse design: ``features struct<indices, values>``, zero-based, of width ``dim``; zeros are not stored."""
    source, rule = sparse_rows(df, label, indices, values, dim, keep)
    return _design(source, rule if drop_nulls else None, dim, bias, names, keep, sparse=True)


def sparse_rows(
    df: DataFrame, label: Column | str, indices: Column | str, values: Column | str, dim: int, keep: Sequence[str] = (), index_type: str = "int",
) -> tuple[DataFrame, Column]:
    """The table behind a sparse design before the row rule, and the rule."""
    both = F.struct(_col(indices).cast(f"array<{index_type}>").alias("indices"), _col(values).cast("array<double>").alias("values"))
    i, v = F.col(f"{FEATURES}.indices"), F.col(f"{FEATURES}.values")
    source = df.select(*keep, _col(label).cast("double").alias(LABEL), both.alias(FEATURES))
    fits = (F.size(i) == F.size(v)) & F.forall(i, lambda x: F.coalesce((x >= 0) & (x < dim), F.lit(False)))
    wrong = i.isNotNull() & v.isNotNull() & ~fits
    source = source.withColumn(FEATURES, F.when(wrong, F.raise_error(F.lit(f"a sparse row does not fit {dim} features"))).otherwise(F.col(FEATURES)))
    return source, _whole(v) & i.isNotNull()


def _whole(values: Column) -> Column:
    ok = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x))
    return F.col(LABEL).isNotNull() & ~F.isnan(LABEL) & F.coalesce(ok, F.lit(False))


def _design(source: DataFrame, rule: Column | None, dim: int, bias: bool, names, keep, sparse: bool) -> Design:
    names = tuple(names) if names is not None else tuple(f"x{j}" for j in range(dim))
    if len(names) != dim:
        raise ValueError("names must have one entry per array element")
    out = source if rule is None else source.filter(rule)
    return Design(
        df=out, features=names + ((BIAS,) if bias else ()), array_col=FEATURES, bias=bias, keep=tuple(keep), sparse=sparse,
        source=source, rule=rule, ruled=out,
    )


# ------------------------------------------------------------------ caching
_LEVELS = {
    "memory_and_disk": StorageLevel.MEMORY_AND_DISK,
    "disk": StorageLevel.DISK_ONLY,
    "memory": StorageLevel.MEMORY_ONLY,
}


def _packed(batches):
    """Batches of (label, sparse features) as rows of :data:`PACKED`."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        if not batch.num_rows:
            continue
        label, cells = batch.column(0).to_numpy(), batch.column(1)
        starts = cells.field(0).offsets.to_numpy().astype(np.int64)
        starts = starts - starts[0]
        index, value = cells.field(0).flatten().to_numpy(), cells.field(1).flatten().to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(starts[:-1] // PACKED_ENTRIES)) + 1).tolist(), batch.num_rows]
        blocks = list(zip(cuts, cuts[1:]))
        lengths = np.diff(starts).astype(np.int32)
        cut_rows = [[a[i:j].tobytes() for i, j in blocks] for a in (label, lengths)]
        cut_entries = [[a[starts[i] : starts[j]].tobytes() for i, j in blocks] for a in (index, value)]
        columns = [pa.array([j - i for i, j in blocks], pa.int32()), *[pa.array(c, pa.binary()) for c in cut_rows + cut_entries]]
        yield pa.RecordBatch.from_arrays(columns, names=["n", "label", "lengths", "indices", "value"])


@contextmanager
def materialized(design: Design, storage: str = "memory_and_disk", also: Sequence[str] = (), pack: bool = False) -> Iterator[Design]:
    """Keep the prepared table for the many passes of a fit.

    * ``memory_and_disk`` / ``memory`` / ``disk``: ``persist`` before the first
      pass, ``unpersist`` in ``finally``.  A lost executor's blocks are rebuilt
      from the short lineage (scan + projection).
    * ``checkpoint``: reliable checkpoint into the session's
      ``spark.checkpoint.dir`` (a shared folder on a cluster), cutting lineage.
    * ``none``: re-read the (column-pruned) source on every pass.

    A table the caller already persisted is used as it is.  ``also`` names columns to keep beside label and features.
    ``pack``: the sparse rows that Spark persists are kept as blocks, for passes that take them by the batch.
    """
    if design.df.storageLevel != StorageLevel.NONE:
        yield design
        return
    if storage == "none":
        yield design.select_only(also)
        return
    d = design.select_only(also)
    if storage == "checkpoint":
        from ridgeline.session import shared_dir

        shared_dir(d.df.sparkSession)
        yield replace(d, df=d.df.checkpoint(eager=True))
        return
    try:
        level = _LEVELS[storage]
    except KeyError:
        raise ValueError(f"unknown storage {storage!r}") from None
    d = design.observed(also)
    pack = pack and d.sparse and not also
    df = (d.df.select(d.label, d.array_col).mapInArrow(_packed, PACKED) if pack else d.df).persist(level)
    try:
        yield replace(d, df=df, packed=pack)
    finally:
        df.unpersist()

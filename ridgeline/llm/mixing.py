"""Mixing sources to target weights, with DataFrame operations only.

Every document gets a hash-random key.  Within a source, documents are ranged by
that key into cells of about ``rows_per_cell`` rows; the cells' sums give each
cell its offset, and a window inside the cell gives each document the words
before it.  A source is then cut at its exact budget: ``floor(target / size)``
whole epochs, and the documents before the cut once more, the one at the cut in
part.  No task holds more than a cell, so a source of any size is spread.

Targets share ``share`` times all words by the sources' weights; a target stops at
``most`` times its source's words and the excess goes to the others by weight,
until none is above.  In closed form: sort by ``most * size / weight``; the level
(target per unit of weight) is the largest of (total - what the sources before
take whole) / (weight of the rest).

Null texts have size 0, a null source is a source of its own (the last one), null
and repeated doc_ids are told apart by their texts, and rows that are wholly equal
are interchangeable.  An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import WORD, materialize

#: Of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, n_rows, target) from rows of (source, size)."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    kind = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(ordered) - 1) % len(weights) + 1).cast("int"))
    by = by.withColumn("weight", kind).withColumn("rn", F.row_number().over(ordered))
    rising = Window.orderBy(most * F.col("source_size") / F.col("weight"), "rn")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    onward = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0))) / F.sum("weight").over(onward)
    return by.withColumn("level", level).withColumn("level", F.max("level").over(everything)).select(
        "source", "source_size", "n_rows", F.least((most * F.col("source_size")).cast("double"), F.col("level") * F.col("weight")).alias("target")
    )


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 7, rows_per_cell: int = 2000, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, source, key, size, source_size, target, epochs and taken (words) of every row.

    ``docs`` needs doc_id, source and text.  ``key`` orders the rows within a source.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).cast("binary"))
    named = [*keep, *[c for c in ("source",) if c not in keep]]
    slim = ["source", "key", "size"] if "text" in keep else [*named, "key", "size"]
    rows = docs.select(*named, key.alias("key"), n_words(F.col("text")).alias("size"))
    small = materialize(rows.select(*slim), "mix-sizes")
    by = targets(small, weights, share, most)
    # 60 bits of the key as a share of the key space; monotonic, so cells are ranges of the key
    place = F.conv(F.substring("key", 1, 15), 16, 10).cast("double") / float(2**60)

    def celled(df: DataFrame) -> DataFrame:
        cell = F.floor(place * F.ceil(F.col("n_rows") / rows_per_cell)).cast("long")
        return df.join(by, df["source"].eqNullSafe(by["source"])).drop(by["source"]).withColumn("cell", cell)

    cells = celled(rows if "text" in keep else small)
    sums = celled(small).groupBy("source", "cell").agg(F.sum("size").alias("cell_size"))
    earlier = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("source").alias("o_source"), F.col("cell").alias("o_cell"), F.coalesce(F.sum("cell_size").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "cell").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.floor("target") - F.col("epochs") * F.col("source_size")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("offset") - F.col("before")))
    return (
        cells.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("cell") == F.col("o_cell")))
        .withColumn("epochs", epochs)
        .select(*named, "key", "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: docs' columns, a document once per epoch, the last one of a source cut to its words.

    Documents without words are not part of a mix measured in words and stay once.
    """
    own = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in own if c not in ("doc_id", "text", "source")], F.lit(0).alias("__"))
    taken = mix(docs.withColumn("__row", row), keep=("doc_id", "text", "source", "__row"), **options)
    full = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(1).cast("int")
    words = (F.col("taken") - F.col("epochs") * F.col("size")).cast("int")
    # split before white space that follows a word: piece k holds the k-th word
    cut = F.array_join(F.slice(F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), 1, words), "")
    copies = F.when(full > 0, F.array_repeat(F.col("text"), full)).otherwise(F.array().cast("array<string>"))
    extra = F.when((words > 0) & (words < F.col("size")), F.array(cut)).otherwise(F.array().cast("array<string>"))
    out = taken.select("doc_id", "source", "__row", F.explode(F.concat(copies, extra)).alias("text"))
    return out.select(*[F.col(c) if c in ("doc_id", "text", "source") else F.col(f"__row.`{c}`").alias(c) for c in own])

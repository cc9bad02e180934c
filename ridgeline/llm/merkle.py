"""Merkle manifest of a dataset: a tree of digests per source, and one over the sources.

Every document is a leaf; the texts are read once, and from then on only digests move.
Leaves are numbered within their source by a range shuffle on (source, doc_id, leaf): a
task's place in that order and a small table of counts by (source, task) give the number,
so a source of any size is spread over tasks.

A level's nodes are joined with themselves by sibling: with ``arity`` 2 a node's sibling is
its number XOR 1, otherwise the slots of its run at offsets 1 .. arity - 1.  Nodes in slot
zero then emit their run's parent.  Sources that are down to one node leave with their
subroot.  Proofs are put together downwards, every node taking its parent's and putting
its own siblings before it, so each level moves its own nodes only.

Order and nulls: leaves ascend by doc_id, null first, then by leaf digest, so repeated ids
have one order; rows that are wholly equal are interchangeable and all stay.  A null source
is a source of its own, the first; a null text or other value is ``-`` in the leaf.  An empty
table gives an empty manifest.  Extra columns take no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import materialize

ARITY = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def written(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value (integers in decimal)."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: dict[str, Column]) -> Column:
    return digest(*[written(values[c]) for c in FIELDS])


@dataclass
class Tree:
    """Levels from the leaves up: tables of (tree, place, n, digest, left, right, payload); roots: (tree, level, digest, payload)."""

    levels: list[DataFrame]
    roots: DataFrame
    arity: int


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str, label: bool = False) -> tuple[DataFrame, DataFrame]:
    """rows with ``place`` (from 0 within the group, by order) and ``n`` (the group's rows); and the groups.

    With ``label`` the groups are numbered as well (``tree``, in their own order).
    """
    keys = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    dealt = materialize(dealt, name).withColumn("task", F.shiftright("at", 33))
    runs = dealt.groupBy(*group, "task").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("own"))
    earlier = Window.partitionBy(*(group or [F.lit(0)])).orderBy("task")
    everything = earlier.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = runs.withColumn("before", F.coalesce(F.sum("own").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.sum("own").over(everything))
    groups = runs.filter("before = 0").select(*group, "n")
    if label:
        counted = numbered(groups.withColumnRenamed("n", "rows"), [], group, f"{name}-groups")[0]
        groups = counted.select(*group, F.col("place").alias("tree"), F.col("rows").alias("n"))
        named = groups.drop("n").toDF(*[f"g_{c}" for c in group], "tree")
        runs = runs.join(named, _same(group, "g_")).drop(*[f"g_{c}" for c in group])
    right = runs.drop("own").toDF(*[f"r_{c}" if c in (*group, "task") else c for c in runs.drop("own").columns])
    out = dealt.join(right, _same([*group, "task"], "r_")).withColumn("place", F.col("before") + F.col("at") - F.col("first"))
    return out.drop("at", "task", "first", "before", *[f"r_{c}" for c in (*group, "task")]), groups


def _same(columns: list[str], prefix: str) -> Column:
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(prefix + c))
    return same


def sibling(place: Column, shift: int, arity: int) -> Column:
    """The place of the sibling ``shift`` slots on, within the run."""
    if arity == 2:
        return place.bitwiseXOR(F.lit(1))
    slot = place % arity
    return place - slot + (slot + shift) % arity


def grow(nodes: DataFrame, most: int, payload: tuple[str, ...] = (), arity: int = ARITY, name: str = "merkle") -> Tree:
    """The levels above nodes (tree, place, n, digest, payload); most: the largest n there is."""
    levels, roots, level = [], [], 0
    while True:
        done = nodes.filter("n = 1").select("tree", F.lit(level).alias("level"), "digest", *(payload if level == 0 else ()))
        roots.append(done if level == 0 else done.withColumns({c: F.lit(None) for c in payload}))
        if most <= 1:
            break
        going = nodes.filter("n > 1")
        own = going.withColumns({f"sibling_{s}": sibling(F.col("place"), s, arity) for s in range(1, arity)})
        others = []
        for s in range(1, arity):
            there = going.select(F.col("tree").alias(f"tree_{s}"), F.col("place").alias(f"place_{s}"), F.col("digest").alias(f"digest_{s}"))
            own = own.join(there, (F.col("tree") == F.col(f"tree_{s}")) & (F.col(f"sibling_{s}") == F.col(f"place_{s}")), "left")
            others.append((F.col(f"sibling_{s}"), F.coalesce(F.col(f"digest_{s}"), F.lit(""))))
        # a node's siblings to its left (they follow by shift, after the wrap) and to its right
        left = F.concat(*[F.when(p < F.col("place"), d).otherwise("") for p, d in others])
        right = F.concat(*[F.when(p > F.col("place"), d).otherwise("") for p, d in others])
        table = materialize(own.select("tree", "place", "n", "digest", left.alias("left"), right.alias("right"), *(payload if level == 0 else ())), f"{name}-level")
        levels.append(table)
        nodes = table.filter(F.col("place") % arity == 0).select("tree", F.expr(f"place div {arity}").alias("place"), F.ceil(F.col("n") / arity).alias("n"), digest(F.col("digest"), F.col("right")).alias("digest"))
        most, level = -(-most // arity), level + 1
    out = roots[0]
    for part in roots[1:]:
        out = out.unionByName(part)
    return Tree(levels, materialize(out, f"{name}-roots"), arity)


def proofs(tree: Tree, above: DataFrame, payload: tuple[str, ...] = ()) -> DataFrame:
    """(tree, place, digest, subroot, path, payload) of every leaf.

    above: (tree, path), the path of each tree's root further up.  A path is an array of
    (left, right): the digests to hash before and after a node's own to get its parent.
    """
    tops = tree.roots.join(above.withColumnRenamed("tree", "a_tree"), F.col("tree") == F.col("a_tree")).drop("a_tree").withColumnRenamed("digest", "subroot")

    def tops_at(level: int) -> DataFrame:
        return tops.filter(F.col("level") == level).select("tree", F.lit(0).cast("long").alias("place"), "subroot", "path")

    paths = None
    for level in range(len(tree.levels), 0, -1):
        parents = tops_at(level) if paths is None else paths.select("tree", "place", "subroot", "path").unionByName(tops_at(level))
        parents = parents.toDF("p_tree", "p_place", "subroot", "p_path")
        keep = payload if level == 1 else ()
        step = F.array(F.struct("left", "right"))
        paths = tree.levels[level - 1].join(parents, (F.col("tree") == F.col("p_tree")) & (F.expr(f"place div {tree.arity}") == F.col("p_place")))
        paths = paths.select("tree", "place", "digest", "subroot", F.concat(step, F.col("p_path")).alias("path"), *keep)
    lone = tops.filter("level = 0").select("tree", F.lit(0).cast("long").alias("place"), F.col("subroot").alias("digest"), "subroot", "path", *payload)
    return lone if paths is None else paths.unionByName(lone)


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf digest and a path lead to."""
    return F.aggregate(path, start, lambda h, p: F.sha2(F.concat(p["left"], h, p["right"]), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""), 256)


def manifest(docs: DataFrame, other: dict[str, Column] | None = None, arity: int = ARITY) -> DataFrame:
    """(doc_id, leaf, other_leaf, subroot, root, path) of every document.

    ``other_leaf`` is the leaf with the columns in ``other`` in place of the document's own,
    to be tried against the manifest.
    """
    own = {c: F.col(c) for c in FIELDS}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", leaf(own).alias("digest"), leaf(own | (other or {})).alias("other_leaf"))
    nodes, trees = numbered(rows, ["source"], ["doc_id", "digest"], "merkle-leaves", label=True)
    trees = materialize(trees, "merkle-trees")
    most, n_trees = trees.agg(F.max("n"), F.count(F.lit(1))).first()
    payload = ("doc_id", "other_leaf")
    lower = grow(nodes.select("tree", "place", "n", "digest", *payload), most or 0, payload, arity, "merkle-source")
    sources = lower.roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(n_trees).cast("long").alias("n"), "digest")
    upper = grow(sources, n_trees, (), arity, "merkle-top")
    root = upper.roots.select("digest").first()
    if root is None:
        return rows.select("doc_id", F.col("digest").alias("leaf"), "other_leaf", F.col("digest").alias("subroot"), F.col("digest").alias("root"), _no_path().alias("path"))
    top = upper.roots.sparkSession.range(1).select(F.col("id").alias("tree"), _no_path().alias("path"))
    above = proofs(upper, top).select(F.col("place").alias("tree"), "path")
    out = proofs(lower, above, payload)
    return out.select("doc_id", F.col("digest").alias("leaf"), "other_leaf", "subroot", F.lit(root[0]).alias("root"), "path")


def _no_path() -> Column:
    return F.array().cast("array<struct<left:string,right:string>>")

"""Centroid clustering with ns-bounds, in integers.

Lloyd's rounds on integer vectors: every vector goes to the nearest centroid (squared
Euclidean distance, ties to the smaller number), then every centroid that has vectors
becomes the floor of their mean, component by component.

A vector's row keeps the exact distance to its centroid and, for each group of centroids, a
lower bound on the distance to all of the group but its own, each with the round it was
evaluated in.  The history of all centroids is retained, so a bound is loosened by how far
a centroid lies from where it was at that time (the norm of its total displacement, which is
at most the sum of the steps in between).  Where the loosened bounds do not separate a
vector's centroid from a group, the own distance is taken exactly; where they still do not,
the group is scanned exactly.  Bounds only ever decide what need not be looked at: they have
a margin above any rounding, distances are exact integers, so the result is Lloyd's.

What travels to the tasks and the driver is rounds x centroids x dimensions numbers.  A round
reads and writes each row once, without a shuffle; the new centroids come from the sums of
the vectors that moved.

Only vectors of exactly ``dim`` components take part, none null or non-finite; each component
x becomes floor(scale * x).  Results of 2**27 and more are an error (distances would not fit
64 bits).  Null and repeated vec_ids are rows of their own, repeated vectors too; ties among
start hashes go by the components.  Fewer vectors than centroids: as many centroids.  No
vectors: an empty result.  Extra columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import materialize

DIM, CENTROIDS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
#: Centroids that share a lower bound.
GROUP = 8
LIMIT = 1 << 27
STATE = "vec_id long, x array<int>, cluster int, was int, distance long, seen int, lower array<double>, lower_seen array<int>"


def integer_vectors(embeddings: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, x array<int>) of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter((F.size("v") == dim) & F.coalesce(whole, F.lit(False)))
    x = F.transform("v", lambda c: F.when(F.abs(c) < LIMIT / scale, F.floor(c * scale)).otherwise(F.raise_error(F.lit("a component is too large for exact distances"))).cast("int"))
    return kept.select("vec_id", x.alias("x"))


def start(vectors: DataFrame, k: int = CENTROIDS, seed: int = SEED):
    """The k vectors of the smallest hashes of ``seed:vec_id``, as rows of an integer matrix."""
    import numpy as np

    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(key.alias("key"), "x").orderBy("key", "x").limit(k).collect()
    return np.array([r["x"] for r in rows], np.int64)


def squared(x, c):
    """Exact squared distances of all rows of x to all of c (int64)."""
    import numpy as np

    top = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if x.shape[1] * (2 * top) ** 2 < 1 << 52:  # doubles hold every term and sum exactly
        a, b = x.astype(float), c.astype(float)
        return (np.einsum("ij,ij->i", a, a)[:, None] - 2 * (a @ b.T) + np.einsum("ij,ij->i", b, b)[None, :]).astype(np.int64)
    out = np.empty((len(x), len(c)), np.int64)
    for j in range(len(c)):
        d = x.astype(np.int64) - c[j]
        out[:, j] = np.einsum("ij,ij->i", d, d)
    return out


def displacement(history, now: int):
    """(rounds, k): how far each centroid of round ``now`` is from where it was in each round so far."""
    import numpy as np

    return np.sqrt(((history[: now + 1] - history[now]).astype(float) ** 2).sum(axis=2))


def reassign(x, state, history, now: int, group: int = GROUP, exact: bool = False) -> tuple:
    """New (cluster, was, distance, seen, lower, lower_seen) of rows, and the number of distances taken.

    state: the former ones, None in the first round.  exact: take every row's own distance.
    """
    import numpy as np

    c, n = history[now], len(x)
    k = len(c)
    groups = [slice(g, min(g + group, k)) for g in range(0, k, group)]
    if state is None:
        d = squared(x, c)
        cluster = d.argmin(axis=1)  # the first of equal ones
        distance = d[np.arange(n), cluster]
        rest = np.sqrt(d.astype(float))
        rest[np.arange(n), cluster] = np.inf
        lower = np.stack([rest[:, g].min(axis=1) for g in groups], axis=1)
        return cluster, np.full(n, -1), distance, np.full(n, now), lower, np.full((n, len(groups)), now), n * k
    cluster, _, distance, seen, lower, lower_seen = (a.copy() for a in state)
    was, taken = cluster.copy(), 0
    moved = displacement(history, now)
    upper = np.sqrt(distance.astype(float)) + moved[seen, cluster]
    drift = np.stack([moved[:, g].max(axis=1) for g in groups], axis=1)
    loose = lower - drift[lower_seen, np.arange(len(groups))]
    margin = 1e-9 * (1 + upper + moved.max(initial=0))
    # a bound of a group without other centroids is infinite
    near = loose <= (upper + margin)[:, None] + 1e-9 * np.where(np.isfinite(lower), lower, 0)
    ask = near.any(axis=1) | exact
    rows = np.flatnonzero(ask)
    if len(rows):
        own = x[rows].astype(np.int64) - c[cluster[rows]]
        distance[rows], seen[rows] = np.einsum("ij,ij->i", own, own), now
        upper[rows] = np.sqrt(distance[rows].astype(float))
        taken += len(rows)
        near[rows] = loose[rows] <= (upper[rows] + margin[rows])[:, None] + 1e-9 * np.where(np.isfinite(lower[rows]), lower[rows], 0)
    near &= ask[:, None]
    scanned: list = []
    best, best_d = cluster.copy(), distance.copy()
    for g, part in enumerate(groups):
        rows = np.flatnonzero(near[:, g])
        if not len(rows):
            scanned.append((rows, None))
            continue
        d = squared(x[rows], c[part])
        taken += d.size
        at = d.argmin(axis=1)
        least = d[np.arange(len(rows)), at]
        at = at + part.start
        better = (least < best_d[rows]) | ((least == best_d[rows]) & (at < best[rows]))
        best[rows[better]], best_d[rows[better]] = at[better], least[better]
        scanned.append((rows, d))
    for g, part in enumerate(groups):
        rows, d = scanned[g]
        if len(rows):
            rest = np.sqrt(d.astype(float))
            inside = (best[rows] >= part.start) & (best[rows] < part.stop)
            rest[inside, best[rows[inside]] - part.start] = np.inf
            lower[rows, g], lower_seen[rows, g] = rest.min(axis=1), now
        # a group that a row's former centroid returns to, without having been scanned
        back = np.flatnonzero((best != was) & (was >= part.start) & (was < part.stop) & ~near[:, g])
        if len(back):
            lower[back, g] = np.minimum(loose[back, g], np.sqrt(distance[back].astype(float)))
            lower_seen[back, g] = now
    changed = best != was
    seen[changed] = now
    return best, was, best_d, seen, lower, lower_seen, taken


def _matrix(column, width: int, kind):
    import numpy as np

    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), width)


def _lists(values, kind):
    import numpy as np

    width = values.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, width), pa.int32()), pa.array(values.ravel(), kind))


def _round(shared, now: int, dim: int, group: int, exact: bool):
    """Rows of STATE after the assignment of round ``now``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        history = shared.value
        n_groups = -(-history.shape[1] // group)
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                x = _matrix(part.column(1), dim, np.int32)
                state = None
                if now:
                    state = tuple(part.column(j).to_numpy().astype(np.int64) for j in range(2, 6)) + (_matrix(part.column(6), n_groups, float), _matrix(part.column(7), n_groups, np.int64))
                cluster, was, distance, seen, lower, lower_seen, _ = reassign(x, state, history, now, group, exact)
                ints = [pa.array(v, t) for v, t in ((cluster, pa.int32()), (was, pa.int32()), (distance, pa.int64()), (seen, pa.int32()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *ints, _lists(lower, pa.float64()), _lists(lower_seen.astype(np.int32), pa.int32())], names=[f.split()[0] for f in STATE.split(", ")])

    return run


def _moves(k: int, dim: int):
    """Partial sums of the rows that moved: place = centroid * (dim + 1) + component, the last being the count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        total = np.zeros((k, dim + 1), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([_matrix(batch.column(0), dim, np.int64), np.ones(batch.num_rows, np.int64)])
            to, was = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            np.add.at(total, to, x)
            np.subtract.at(total, was[was >= 0], x[was >= 0])
        place = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(total.ravel()[place])], names=["place", "v"])

    return run


def assigned(embeddings: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED, group: int = GROUP):
    """(state table after the last assignment, history of the centroids (rounds + 1, k, dim)); (None, None) without vectors."""
    import numpy as np

    vectors = integer_vectors(embeddings, dim, scale)
    c = start(vectors, k, seed)
    if not len(c):
        return None, None
    k, context = len(c), embeddings.sparkSession.sparkContext
    history, state = c[None], vectors
    totals = np.zeros((k, dim + 1), np.int64)
    for now in range(rounds + 1):
        state = materialize(state.mapInArrow(_round(context.broadcast(history), now, dim, group, now == rounds), STATE), f"clusters-{now}")
        if now == rounds:
            return state, history
        moved = state.filter("cluster <> was").select("x", "cluster", "was").mapInArrow(_moves(k, dim), "place long, v long")
        sums = moved.groupBy("place").agg(F.sum("v").alias("v")).toArrow()  # at most k * (dim + 1) numbers
        totals.ravel()[sums.column(0).to_numpy()] += sums.column(1).to_numpy()
        n = totals[:, -1:]
        c = np.where(n > 0, totals[:, :-1] // np.maximum(n, 1), history[-1])
        history = np.concatenate([history, c[None]])


def centroid_sha256(c) -> str:
    return sha256(",".join(str(int(v)) for v in c).encode()).hexdigest()


OUT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def clusters(embeddings: DataFrame, **options) -> DataFrame:
    """Rows of OUT: every vector that takes part with its cluster, and the sums over its cluster and over all."""
    spark = embeddings.sparkSession
    state, history = assigned(embeddings, **options)
    if state is None:
        return spark.createDataFrame([], OUT)
    sums = dict(state.groupBy("cluster").agg(F.sum("distance")).collect())  # one row per centroid
    total = sum(sums.values())
    rows = [(j, v, total, centroid_sha256(history[-1][j])) for j, v in sorted(sums.items())]
    by = spark.createDataFrame(rows, "c int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(by), F.col("cluster") == F.col("c")).drop("c")

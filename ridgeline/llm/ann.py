"""Approximate nearest neighbours by inner product: one navigable small-world graph per shard.

Equal vectors are one node.  Nodes are dealt to shards of about ``shard_rows`` by a
hash.  A shard's graph is hierarchical: a node reaches layer l with probability
``DEGREE**-l``; in every layer its candidates are its nearest nodes of that layer,
of which it keeps the diverse ones (a candidate nearer to a kept neighbour than to
the node is passed over), and links go both ways up to the layer's degree.  To
make inner products a metric, vectors get one more component that lifts them all to
the same length.  A graph is stored as flat arrays: vectors, node ids and, per layer,
the nodes and their neighbours.

A query block walks every shard's graph from the top layer down, with a beam of
``ef`` in the bottom layer; scores are then taken in double precision from the
original vectors, and the shards' results are merged.  Copies come back with the
node: the k + 1 smallest ids of a node are enough for any k.

Vectors that are null, empty or zero, or hold null or non-finite components, take no
part; vectors of different length are not compared.  Ties go to the smaller id;
repeated rows count once.  An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import materialize

SHARD_ROWS = 16_384
QUERY_BLOCK = 1_024
DEGREE, CANDIDATES, EF = 24, 64, 100
GRAPH = "dim int, shard int, ids binary, vectors binary, layers array<struct<nodes:binary, links:binary>>"


def usable(v: Column) -> Column:
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) > 0) & ok & F.exists(v, lambda x: x != 0), F.lit(False))


def lifted(x):
    """x with one more component, so that all rows have the length of the longest."""
    import numpy as np

    square = (x.astype(np.float64) ** 2).sum(axis=1)
    return np.column_stack([x, np.sqrt(np.maximum(square.max() - square, 0))]).astype(np.float32)


def diverse(x, near, keep: int):
    """Of each row's candidates (nearest first, -1: none), up to keep diverse ones, filled up with the nearest of the rest."""
    import numpy as np

    n, c = near.shape
    out = np.full((n, keep), -1, np.int32)
    for a in range(0, n, 1024):
        cand = near[a : a + 1024]
        v = x[cand]
        between = v @ v.transpose(0, 2, 1)
        to_node = np.einsum("ncd,nd->nc", v, x[a : a + 1024])
        chosen = np.zeros(cand.shape, bool)
        for k in range(c):
            nearer = ((between[:, k] > to_node[:, k, None]) & chosen).any(axis=1)
            chosen[:, k] = (cand[:, k] >= 0) & ~nearer & (chosen.sum(axis=1) < keep)
        order = np.argsort(np.where(cand < 0, 2, ~chosen), axis=1, kind="stable")[:, :keep]
        out[a : a + 1024, : order.shape[1]] = np.take_along_axis(cand, order, axis=1)
    return out


def layer_links(x, degree: int):
    """Neighbours (n, degree), -1 filled, of the nodes x of one layer."""
    import numpy as np

    n = len(x)
    c = min(CANDIDATES, n - 1)
    if c < 1:
        return np.full((n, degree), -1, np.int32)
    near = np.empty((n, c), np.int32)
    for a in range(0, n, 512):
        sims = x[a : a + 512] @ x.T
        sims[np.arange(len(sims)), np.arange(a, a + len(sims))] = -np.inf
        top = np.argpartition(-sims, c - 1, axis=1)[:, :c]
        near[a : a + 512] = np.take_along_axis(top, np.argsort(-np.take_along_axis(sims, top, axis=1), axis=1, kind="stable"), axis=1)
    links = diverse(x, near, degree // 2)
    # links back, as far as the degree goes, nearest first
    src, dst = np.repeat(np.arange(n), links.shape[1]), links.ravel()
    src, dst = np.concatenate([src[dst >= 0], dst[dst >= 0]]), np.concatenate([dst[dst >= 0], src[dst >= 0]])
    pairs = np.unique(src.astype(np.int64) * n + dst)
    src, dst = pairs // n, pairs % n
    sims = np.concatenate([np.einsum("nd,nd->n", x[src[a : a + 65536]], x[dst[a : a + 65536]]) for a in range(0, len(src), 65536)])
    own = np.isin(pairs, (np.repeat(np.arange(n), links.shape[1]).astype(np.int64) * n + links.ravel())[links.ravel() >= 0])
    order = np.lexsort((-sims, ~own, src))
    src, dst = src[order], dst[order]
    place = np.arange(len(src)) - np.searchsorted(src, src)
    out = np.full((n, degree), -1, np.int32)
    fits = place < degree
    out[src[fits], place[fits]] = dst[fits]
    return out


def build_graph(ids, x):
    """(ids, x float32, [(nodes, links)] from the bottom layer up), ordered by a hash of the id."""
    import numpy as np

    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    up = lifted(x)
    chance = np.random.default_rng(len(ids)).random(len(ids))
    height = np.floor(-np.log(np.maximum(chance, 1e-12)) / np.log(DEGREE)).astype(int)
    layers = []
    for level in range(int(height.max()) + 1):
        nodes = np.flatnonzero(height >= level).astype(np.int32)
        layers.append((nodes, layer_links(up[nodes], 2 * DEGREE if level == 0 else DEGREE)))
    return ids, x, layers


def beam(x, links, queries, start, ef: int):
    """(node, score) of the ef best that a beam search of links reaches from start (one node a query)."""
    import numpy as np

    n, q = len(x), len(queries)
    ef = min(ef, n)
    rows = np.arange(q)
    seen = np.zeros((q, n + 1), bool)
    ids = np.full((q, ef), -1, np.int32)
    score = np.full((q, ef), -np.inf, np.float32)
    fresh = np.zeros((q, ef), bool)
    ids[:, 0], fresh[:, 0], seen[rows, start] = start, True, True
    score[:, 0] = np.einsum("qd,qd->q", queries, x[start])
    while True:
        best = np.where(fresh, score, -np.inf)
        at = np.argmax(best, axis=1)
        go = np.flatnonzero(best[rows, at] > -np.inf)
        if not len(go):
            return ids, score
        fresh[go, at[go]] = False
        nb = links[ids[go, at[go]]]
        new = (nb >= 0) & ~seen[go[:, None], nb]
        seen[go[:, None], np.where(new, nb, n)] = True
        sims = np.where(new, np.einsum("qd,qmd->qm", queries[go], x[nb]), -np.inf)
        all_ids = np.concatenate([ids[go], nb], axis=1)
        all_score = np.concatenate([score[go], sims], axis=1)
        all_fresh = np.concatenate([fresh[go], new], axis=1)
        top = np.argpartition(-all_score, ef - 1, axis=1)[:, :ef] if all_score.shape[1] > ef else np.broadcast_to(np.arange(ef), (len(go), ef))
        ids[go], score[go], fresh[go] = (np.take_along_axis(a, top, axis=1) for a in (all_ids, all_score, all_fresh))
        fresh[go] &= score[go] > -np.inf


def search_graph(graph, queries, ef: int):
    """Nodes (q, ef), -1 filled, near each query."""
    import numpy as np

    _, x, layers = graph
    up = lifted(x)
    asked = np.column_stack([queries, np.zeros(len(queries))]).astype(np.float32)
    at = np.full(len(queries), layers[-1][0][0], np.int64)
    for nodes, links in reversed(layers[1:]):
        place = np.searchsorted(nodes, at)
        found, score = beam(up[nodes], links, asked, place, 8)
        at = nodes[found[np.arange(len(found)), np.argmax(score, axis=1)]]
    return beam(up, layers[0][1], asked, at, ef)[0]


def search(vectors: DataFrame, queries: Column, k: int = 20, shard_rows: int = SHARD_ROWS, ef: int = EF) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of (vec_id, embedding) that ``queries`` holds for, its k best others."""
    import numpy as np

    rows = vectors.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    # k + 1 smallest ids of each distinct vector; Spark limits the groups before the shuffle
    same = Window.partitionBy("embedding").orderBy("vec_id")
    members = rows.distinct().withColumn("place", F.row_number().over(same)).filter(F.col("place") <= k + 1)
    members = members.withColumn("node", F.first("vec_id").over(same.rowsBetween(Window.unboundedPreceding, 0)))
    members = materialize(members.select("node", "vec_id", F.expr("CASE WHEN place = 1 THEN embedding END").alias("embedding")), "ann-members")
    nodes = members.filter("embedding IS NOT NULL")
    asking = rows.filter(queries).distinct()
    n_nodes, n_queries = nodes.count(), asking.count()
    n_shards, n_blocks = max(1, -(-n_nodes // shard_rows)), max(1, -(-n_queries // QUERY_BLOCK))

    def build(key, pdf):
        import pandas as pd

        ids, x, layers = build_graph(pdf["node"].to_numpy(), np.stack(pdf["embedding"].to_numpy()).astype(np.float32))
        flat = [{"nodes": a.astype("<i4").tobytes(), "links": b.astype("<i4").tobytes()} for a, b in layers]
        return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "ids": [ids.astype("<i8").tobytes()], "vectors": [x.astype("<f4").tobytes()], "layers": [flat]})

    dim = F.size("embedding").alias("dim")
    graphs = nodes.select(dim, F.pmod(F.xxhash64("node"), F.lit(n_shards)).cast("int").alias("shard"), "node", "embedding")
    graphs = materialize(graphs.groupBy("dim", "shard").applyInPandas(build, GRAPH), "ann-graphs")

    def walk(key, left, right):
        import pandas as pd

        empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "node": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if not len(left) or not len(right):
            return empty
        g = left.iloc[0]
        ids = np.frombuffer(g["ids"], "<i8")
        x = np.frombuffer(g["vectors"], "<f4").reshape(len(ids), -1)
        layers = []
        for layer in g["layers"]:
            own = np.frombuffer(layer["nodes"], "<i4")
            layers.append((own, np.frombuffer(layer["links"], "<i4").reshape(len(own), -1)))
        asked_ids, asked = right["query_id"].to_numpy(), np.stack(right["embedding"].to_numpy()).astype(np.float64)
        out = []
        for a in range(0, len(asked), 256):
            q = asked[a : a + 256]
            found = search_graph((ids, x, layers), q.astype(np.float32), ef)
            exact = np.where(found >= 0, np.einsum("qd,qmd->qm", q, x[found].astype(np.float64)), -np.inf)
            # one more than k: the query itself may be among them, as a node or in one
            top = np.lexsort((ids[found], -exact), axis=1)[:, : k + 1]
            q_ids = np.repeat(asked_ids[a : a + 256], top.shape[1])
            exact, found = np.take_along_axis(exact, top, axis=1).ravel(), np.take_along_axis(found, top, axis=1).ravel()
            ok = found >= 0
            out.append(pd.DataFrame({"query_id": q_ids[ok], "node": ids[found[ok]], "score": exact[ok]}))
        return pd.concat(out)

    block = F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int").alias("block")
    left = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    right = asking.select(dim, F.col("vec_id").alias("query_id"), "embedding", block).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    key = ("dim", "shard", "block")
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(walk, "query_id long, node long, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "node")
    found = found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).drop("r")
    copies = found.join(members.select("node", "vec_id"), "node").filter("vec_id <> query_id")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = copies.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

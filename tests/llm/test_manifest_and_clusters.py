"""Decontamination, Merkle manifest and centroid clustering against plain loops, their SQL and odd rows."""

import hashlib
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.llm import centroids, decontaminate, merkle, queries

SF001 = "/root/testdata/sf0.001"
NAMES = ("op3_jaccard_join", "op11_decontaminate", "op12_merkle_manifest", "op13_centroid_clusters")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF001, t + '.parquet')}')")
    df = queries.QUERIES[name](spark, SF001)
    cur = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(repr, cur.fetchall()))


# --- 11: decontamination ----------------------------------------------------------
def low_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(low)


def plain_hits(text, items, width=10):
    words, hit, found = low_words(text), set(), set()
    for item, t in items:
        w = low_words(t)
        n = min(width, len(w))
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1) if n else ():
            if tuple(words[i : i + n]) in grams:
                hit.update(range(i, i + n))
                found.add("" if item is None else str(item))
    return words, hit, sorted(found)


def items_and_docs(odd):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    long = next(t for i, t in docs if i == 50).split()
    items = [(1, " ".join(long[100:130])), (2, " ".join(long[125:160]).upper()), (10, " ".join(long[100:112])), (3, "two three"), (4, "one"), (5, None), (6, ""), (7, "--"), (None, "漢字🎉"), (8, " ".join(long[100:130])), (8, "one"), (9, "zz")]
    docs += [(90, "x " + "-".join(long[120:150]) + "! end."), (91, " ".join(long[100:130] * 40)), (91, " ".join(long[100:130] * 40)), (92, "One,two three... TWO three")]
    return items, docs


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_BYTES, 3000])
def test_contamination_equals_loops(spark, odd, limit):
    items, docs = items_and_docs(odd)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench, broadcast_bytes=limit).collect()
    want = []
    for doc, text in docs:
        words, hit, found = plain_hits(text, items)
        runs = [p for p in sorted(hit) if p - 1 not in hit]
        ends = [p for p in sorted(hit) if p + 1 not in hit]
        want.append((doc, len(words), len(hit), found, list(zip(runs, ends))))
    assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["n_words"], r["n_hit"], r["items"], [tuple(s) for s in r["spans"]])) for r in got)


def test_spans_and_documents_are_removed(spark, odd, clashing):
    items, docs = items_and_docs(odd)
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit(1)).withColumn("hit", F.lit(2))
    out = decontaminate.decontaminated(rows, bench)
    assert out.columns == rows.columns
    want = []
    for doc, text in docs:
        words, hit, _ = plain_hits(text, items)
        if hit:
            pieces = re.findall(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)
            text = "".join(p for i, p in enumerate(pieces) if i not in hit) + text[len("".join(pieces)) :]
        want.append((doc, text))
    assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["text"])) for r in out.collect())
    left = decontaminate.decontaminated(rows, bench, remove="documents")
    assert sorted(repr((r["doc_id"], r["text"])) for r in left.collect()) == sorted(repr((d, t)) for d, t in docs if not plain_hits(t, items)[1])
    assert decontaminate.decontaminated(clashing, bench).columns == clashing.columns


def test_empty_sides(spark, odd, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    rows = decontaminate.contamination(odd, none).collect()
    assert len(rows) == odd.count() and not any(r["n_hit"] or r["items"] for r in rows)
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.decontaminated(odd, none).count() == odd.count()


def test_main_path_has_no_python(spark, odd):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    plan = decontaminate.contamination(odd, bench)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan and "NestedLoop" not in plan


# --- 12: Merkle manifest ------------------------------------------------------------
def plain_manifest(rows, arity):
    """(leaf, subroot, root, path) by row number, with lists and loops."""
    w = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaves = [sha("".join(w(r[c]) for c in merkle.FIELDS)) for r in rows]

    def climb(digests):
        at, paths, level = list(range(len(digests))), [[] for _ in digests], digests
        while len(level) > 1:
            for k, p in enumerate(at):
                lo = p // arity * arity
                paths[k].append(("".join(level[lo:p]), "".join(level[p + 1 : lo + arity])))
            level = [sha("".join(level[i : i + arity])) for i in range(0, len(level), arity)]
            at = [p // arity for p in at]
        return (level[0] if level else None), paths

    order = lambda s: (s is not None, (s or "").encode())
    sources = sorted({r["source"] for r in rows}, key=order)
    members = {s: sorted((k for k, r in enumerate(rows) if r["source"] == s), key=lambda k: (rows[k]["doc_id"] is not None, rows[k]["doc_id"] or 0, leaves[k])) for s in sources}
    trees = {s: climb([leaves[k] for k in members[s]]) for s in sources}
    root, above = climb([trees[s][0] for s in sources])
    out = {}
    for s, up in zip(sources, above):
        for k, path in zip(members[s], trees[s][1]):
            out[k] = (rows[k]["doc_id"], leaves[k], trees[s][0], root, path + up)
    return [out[k] for k in range(len(rows))]


@pytest.mark.parametrize("arity", [2, 3, 4])
def test_manifest_equals_loops(odd, arity):
    rows = odd.collect()
    got = merkle.manifest(odd, arity=arity).withColumn("folded", merkle.fold(F.col("leaf"), F.col("path"))).withColumn("proof", merkle.proof_digest(F.col("path"))).collect()
    want = plain_manifest(rows, arity)
    assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["leaf"], r["subroot"], r["root"], [(p["left"], p["right"]) for p in r["path"]])) for r in got)
    assert all(r["folded"] == r["root"] and r["leaf"] == r["other_leaf"] for r in got)
    assert all(r["proof"] == sha("".join(a + b for a, b in map(tuple, r["path"]))) for r in got)


def test_tampering_shows(spark, documents):
    rows = queries.op12_merkle_manifest(spark, "/root/testdata/sf0.01").collect()
    text = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert len(rows) == len(text) and len({r["root"] for r in rows}) == 1
    for r in rows:
        tampered = zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and "\n" in (text[r["doc_id"]] or "")
        assert r["verified"] is (not tampered)


def test_manifest_of_small_and_odd_tables(spark, empty, clashing):
    assert merkle.manifest(empty).count() == 0
    one = spark.createDataFrame([(7, "s", "t")], "doc_id long, source string, text string").withColumns({"lang": F.lit(None).cast("string"), "n_chars": F.lit(3)})
    r = merkle.manifest(one).first()
    assert r["leaf"] == r["subroot"] == r["root"] == sha("1:71:s-1:31:t") and r["path"] == []
    assert merkle.manifest(clashing.withColumns({c: F.lit(0) for c in ("tree", "place", "n", "at", "task", "digest", "leaf")})).count() == clashing.count()


def test_numbers_within_a_hot_group(spark):
    rows = spark.range(0, 5000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("g"), ((F.col("id") * 7919) % 5000).alias("o"))
    out, groups = merkle.numbered(rows, ["g"], ["o"], "numbers", label=True)
    got = out.collect()
    by = Counter(r["g"] for r in got)
    assert {r["g"]: r["n"] for r in groups.collect()} == by and [r["g"] for r in groups.orderBy("tree").collect()] == sorted(by)
    for g in by:
        own = sorted((r["o"], r["place"], r["n"]) for r in got if r["g"] == g)
        assert [p for _, p, _ in own] == list(range(by[g])) and {n for *_, n in own} == {by[g]}


# --- 13: centroid clustering ----------------------------------------------------------
def lloyd(x, start, rounds):
    c = start.astype(object)
    x = x.astype(object)

    def nearest():
        d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2).astype(np.int64)
        return d.argmin(axis=1), d.min(axis=1)

    for _ in range(rounds):
        a, _d = nearest()
        for j in range(len(c)):
            if (a == j).any():
                n = int((a == j).sum())
                c[j] = [int(v) // n for v in x[a == j].sum(axis=0)]
    return (*nearest(), c)


def test_bounds_change_nothing(spark):
    rnd = np.random.default_rng(3)
    mid = rnd.integers(-400, 400, (12, 6))
    x = mid[rnd.integers(0, 12, 3000)] + rnd.integers(-40, 41, (3000, 6))
    x[:400] = x[0]  # copies
    history, state, c, taken = x[400:420].astype(np.int64)[None], None, None, 0
    for now in range(9):
        *state, n = centroids.reassign(x, None if state is None else tuple(state), history, now, group=4, exact=now == 8)
        taken += n
        a, d, c = lloyd(x, history[0], now)
        assert (c.astype(np.int64) == history[now]).all()
        assert (state[0] == a).all()
        sums = np.zeros_like(history[0])
        np.add.at(sums, state[0], x)
        count = np.bincount(state[0], minlength=20)[:, None]
        history = np.concatenate([history, np.where(count > 0, sums // np.maximum(count, 1), history[now])[None]])
    assert (state[2] == d).all()
    assert taken < 0.5 * 9 * 3000 * 20  # most distances are not taken


def test_huge_components_are_exact():
    rnd = np.random.default_rng(4)
    x, c = rnd.integers(-(1 << 26), 1 << 26, (50, 64)), rnd.integers(-(1 << 26), 1 << 26, (7, 64))
    assert (centroids.squared(x, c) == ((x[:, None, :] - c[None]) ** 2).sum(axis=2)).all()


def test_clusters_equal_lloyd_on_odd_rows(spark):
    rnd = np.random.default_rng(5)
    v = np.round(rnd.normal(size=(300, 64)), 2)
    rows = [(i, [float(t) for t in v[i]], 1) for i in range(300)]
    rows += [(5, rows[5][1], 1), (None, rows[6][1], 1), (None, [0.0] * 64, 1), (400, None, 1), (401, rows[0][1][:63], 1), (402, [None] + rows[0][1][1:], 1), (403, [float("nan")] + rows[0][1][1:], 1), (404, [float("inf")] + rows[0][1][1:], 1), (405, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster int")
    got = centroids.clusters(df)
    assert ", ".join(f"{f.name} {f.dataType.simpleString().replace('bigint', 'long')}" for f in got.schema) == centroids.OUT
    kept = [(i, np.floor(np.array(e) * 256).astype(np.int64)) for i, e, _ in rows if e and len(e) == 64 and all(t is not None and np.isfinite(t) for t in e)]
    x = np.array([k[1] for k in kept])
    order = sorted(range(len(kept)), key=lambda k: (sha(f"2:{'' if kept[k][0] is None else kept[k][0]}"), x[k].tolist()))
    a, d, c = lloyd(x, x[order[:40]], 5)
    want = [(kept[k][0], int(a[k]), int(d[k]), int(d[a == a[k]].sum()), int(d.sum()), centroids.centroid_sha256(c[a[k]])) for k in range(len(kept))]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.collect())
    few = spark.createDataFrame(rows[:7], "vec_id long, embedding array<double>, cluster int")
    assert sorted(r["cluster"] for r in centroids.clusters(few).collect()) == list(range(7))
    assert centroids.clusters(df.limit(0)).count() == 0
    assert centroids.clusters(df.filter("vec_id >= 400")).count() == 0


def test_too_large_components_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        centroids.clusters(df).collect()

"""Sources and preparation: LibSVM round trip, label remap, bias, splits."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import ridgeline as rl
from ridgeline.session import scratch_path
from ridgeline.workload.fixtures import LIN3, SPLIT_KEY


def test_libsvm_round_trip(spark, lineitem01):
    ds = LIN3.design(lineitem01)
    path = scratch_path(spark, "libsvm-test")
    rl.write_libsvm(ds, path)
    back = rl.libsvm_design(spark, path, num_features=2, bias=True, names=["qty", "disc"])
    assert back.features == ("qty", "disc", "bias")
    a = rl.Evaluator(ds, "squared").value_and_gradient([0.5, -0.25, 0.1])
    b = rl.Evaluator(back, "squared").value_and_gradient([0.5, -0.25, 0.1])
    assert a[0] == b[0] or abs(a[0] - b[0]) < 1e-15
    np.testing.assert_allclose(a[1], b[1], rtol=1e-13)


def test_binarize_label(spark):
    df = spark.createDataFrame([(2,), (0,), (7,), (None,)], "label int")
    got = [r.b for r in df.select(rl.binarize_label("label").alias("b")).collect()]
    assert got == [0.0, 1.0, 1.0, None]


def test_append_bias(spark):
    df = spark.createDataFrame([([1.5, 2.5],)], "f array<float>")
    assert df.select(rl.append_bias("f").alias("g")).first().g == [1.5, 2.5, 1.0]


def test_key_split_is_disjoint_and_complete(lineitem01):
    train, test = rl.key_split(lineitem01, F.expr(SPLIT_KEY), 5, 0)
    n, a, b = lineitem01.count(), train.count(), test.count()
    assert a + b == n and 0.15 < b / n < 0.25


def test_random_split_covers_table(lineitem01):
    train, test = rl.random_split(lineitem01, (0.8, 0.2), seed=11)
    assert train.count() + test.count() == lineitem01.count()
    assert train.intersect(test).count() == 0
    assert abs(train.count() / lineitem01.count() - 0.8) < 0.01


def test_design_filters_nulls_at_scan(lineitem01):
    ds = LIN3.design(lineitem01)
    plan = ds.df._jdf.queryExecution().executedPlan().toString()
    assert "isnotnull" in plan.lower() or "atleastnnonnulls" in plan.lower()


def test_wide_libsvm_round_trip_stays_sparse(spark):
    emb = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    wide = rl.array_points(emb, rl.binarize_label("label"), F.concat("embedding", "embedding"), 128, bias=True)
    path = scratch_path(spark, "libsvm-wide")
    rl.write_libsvm(wide, path)
    back = rl.libsvm_design(spark, path, num_features=128, bias=True)
    ev = rl.Evaluator(back, "logistic")
    assert ev.form == "arrow" and back.sparse
    w = np.linspace(-0.05, 0.05, 129)
    f1, g1 = ev.value_and_gradient(w)
    f2, g2 = rl.Evaluator(wide, "logistic").value_and_gradient(w)
    assert f1 == pytest.approx(f2, rel=1e-6)  # the float embedding is written and re-read as text
    np.testing.assert_allclose(g1, g2, rtol=1e-5, atol=1e-9)


def test_hashed_words_of_odd_documents(spark, tmp_path):
    """Rows of one document meet, null texts are no rows, and no row per word is shuffled."""
    from ridgeline.workload.queries import hashed_words

    rows = [(1, "a b a", "en"), (1, "b  c", "en"), (1, "a", "de"), (2, "", "en"), (3, None, "en"), (None, "a é", None), (None, "a", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    cells = hashed_words(spark, str(tmp_path), 5)
    at = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:5], 16)
    want = {}
    for doc, text, lang in rows:
        if text is not None:
            want.setdefault((doc, None if lang is None else float(lang == "en")), Counter()).update(map(at, text.split(" ")))
    got = {(r["doc_id"], r["label"]): (list(zip(r["x"]["i"], r["x"]["v"], strict=True)), r["total"]) for r in cells.collect()}
    assert got == {k: (sorted(c.items()), float(sum(c.values()))) for k, c in want.items()}
    assert "Generate" not in cells._jdf.queryExecution().optimizedPlan().toString()


def test_libsvm_plain_lines_are_parsed_by_the_batch_and_all_others_by_expressions(spark):
    import pyarrow as pa

    from ridgeline.sources.libsvm import _plain_lines, parse_libsvm

    plain = ["1", "0 1:2", "+1 1:2.5 7:-3 ", "-1.5E-4 3:1E5", "1 999999999:0.25"]
    other = {"1 1:2\t2:3": (1.0, [0, 1], [2.0, 3.0], True), " 1 1:2": (1.0, [0], [2.0], True), "1 1:1e400": (1.0, [0], [float("inf")], True), "1 1:2 # c": (1.0, [0], [2.0], True)}
    other |= {"1 2:1 2:1": (1.0, [1, 1], [1.0, 1.0], False), "1 3:1 2:1": (1.0, [2, 1], [1.0, 1.0], False), "x 1:2": (None, [0], [2.0], False), "1 0:2": (1.0, [-1], [2.0], False)}
    lines = plain + list(other) + ["", "  ", "# no row"]
    batch = pa.RecordBatch.from_arrays([pa.array(lines)], names=["value"])
    assert next(_plain_lines([batch])).column(4).to_pylist() == [line in plain for line in lines]
    path = scratch_path(spark, "libsvm-lines")
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.text(path)
    got = {r.line: tuple(r)[1:] for r in parse_libsvm(spark, path).collect()}
    want = {"1": (1.0, [], [], True), "0 1:2": (0.0, [0], [2.0], True), "+1 1:2.5 7:-3": (1.0, [0, 6], [2.5, -3.0], True)}
    want |= {"-1.5E-4 3:1E5": (-1.5e-4, [2], [1e5], True), "1 999999999:0.25": (1.0, [999999998], [0.25], True)}
    assert got == want | {" ".join(line.partition("#")[0].split()): row for line, row in other.items()}

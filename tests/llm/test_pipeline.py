"""run() against a version in plain Python, stage by stage, and the stages on odd rows."""

import base64
import math
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers as P

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline
from ridgeline.llm import quality, queries, toxicity

from .test_operators import SF, WORD, brute_components, brute_targets


def plain(spark, rows):
    """Rows (doc_id, text, lang, source, n_chars) through plain loops, with the models that the operators train."""
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema)
    weights, _ = quality.train(docs)
    good = []
    for r in rows:
        words = (r[1] or "").encode().split()
        if words and weights[quality.BIAS] + weights[quality.features(words)].sum() / len(words) >= 0:
            good.append(r)
    docs = spark.createDataFrame(good, docs.schema)
    table, neutral, (w, mean, scale, b) = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    evidence = toxicity.Evidence(table, neutral)
    clean = [r for r in good if not (found := np.array(evidence.of((r[1] or "").encode()))).any() or ((found - mean) / scale) @ w + b < 0]
    first = {}
    for (doc_id, _, component), _ in brute_components([(r[0], r[1]) for r in clean], 80, 5).items():
        first[component] = min(first.get(component, doc_id), doc_id)
    single = [r for r in clean if r[0] in first.values()]
    sizes = Counter()
    for r in single:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    return good, clean, single, brute_targets(sizes)


def test_run_equals_plain_loops(spark):
    import tiktoken

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    good, clean, single, targets = plain(spark, rows)
    docs, kept = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema), []
    for _, stage in corpus_pipeline.STAGES[:4]:
        columns = docs.columns
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == columns
        kept.append([tuple(r) for r in docs.collect()])
    assert Counter(kept[0]) == Counter(good) and Counter(kept[1]) == Counter(clean) and Counter(kept[2]) == Counter(single)
    assert len(rows) > len(good) > len(clean) > len(single) > 500
    words = Counter()
    texts = {r[0]: r[1] for r in single}
    for doc_id, text, _, source, _ in kept[3]:
        assert texts[doc_id].startswith(text)
        words[source] += len(WORD.findall(text))
    assert all(abs(words[s] - math.floor(t)) <= 1 for s, t in targets.items())
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(queries.RANKS), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter((r[0], np.array(own.encode_ordinary(r[1]), "<u4").tobytes()) for r in kept[3])
    out = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in out) == want and all(r["decodes"] for r in out)


def test_stages_on_odd_rows(spark, odd, clashing, empty):
    for df in (odd, clashing):
        docs = df
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        assert docs.count() > 10
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0

"""Operators against brute force, exact round trips or held-out accuracy, and on odd rows."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ridgeline.llm import ann, bpe, fingerprint, jaccard, language_model, mixing, quality, queries, sharding, token_counts, toxicity
from ridgeline.llm.common import learns

SF = "/root/testdata/sf0.01"
RANKS, JSON = P.path(queries.RANKS), P.path(queries.TOKENIZER)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def tik():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


# --- 1: BPE ---------------------------------------------------------------------
def bpe_wrong(df, tik):
    wrong = 0
    for r in bpe.round_trip(df, RANKS, P.PATTERN).collect():
        ids = tik.encode_ordinary(r["text"] or "")
        wrong += r["n_tokens"] != len(ids) or bytes(r["ids"]) != np.array(ids, "<u4").tobytes() or bytes(r["decoded"]) != (r["text"] or "").encode()
    return wrong


def test_bpe_equals_library(documents, odd, tik):
    assert bpe_wrong(documents, tik) == 0
    assert bpe_wrong(odd, tik) == 0


def test_bpe_long_words_and_unicode(spark, tik):
    rnd = np.random.default_rng(1)
    texts = ["a" * 5000, "ab" * 2000, "".join(map(chr, rnd.integers(97, 123, 4000))), "abc" * 900 + "é" * 700, "=" * 999, " " * 700 + "x", "\n" * 300]
    texts += ["".join(chr(c) for c in range(a, a + 400) if not 0xD800 <= c < 0xE000) for a in range(0, 0x30000, 3001)]
    assert bpe_wrong(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), tik) == 0


def test_bpe_splits_ascii_as_the_pattern():
    import regex

    rnd = np.random.default_rng(2)
    texts = ["".join(map(chr, rnd.choice([9, 10, 28, 31, 32, 32, 39, 45, 48, 65, 97, 115, 116, 127], 300))) for _ in range(50)] + ["".join(map(chr, range(128))), "it's we'll  x\n\n y "]
    assert [bpe.ascii_pattern(P.PATTERN).findall(t) for t in texts] == [regex.findall(P.PATTERN, t) for t in texts]
    assert bpe.ascii_pattern(r"\w+") is None and bpe.ascii_pattern("(?i:a)") is None


def test_bpe_decodes_in_bounded_runs(monkeypatch):
    """Decoding keeps no pieces, and no query or run holds more ids than it may."""
    own, asked = bpe.Codec(RANKS, P.PATTERN), []
    ask = own._ask
    monkeypatch.setattr(bpe, "RUN_TOKENS", 7)
    monkeypatch.setattr(bpe, "TOKENS_A_QUERY", 20)
    monkeypatch.setattr(own, "_ask", lambda sql, lengths, tokens: asked.append((sql, max(lengths), len(tokens))) or ask(sql, lengths, tokens))
    texts = ["ein Satz, é und 日本 " * 9, "", "a", "x y z " * 30]
    assert own.decode(own.encode(texts)) == [t.encode() for t in texts] and own.decode([None]) == [b""]
    assert all(longest <= 7 and n <= 20 for sql, longest, n in asked if sql == bpe.DECODE)


def test_bpe_parts_and_odd_rows(clashing, empty):
    whole = bpe.round_trip(clashing, RANKS, P.PATTERN)
    parts = bpe.decode(bpe.encode(clashing, RANKS, P.PATTERN), RANKS, P.PATTERN)
    pick = lambda df: sorted((r["doc_id"] or -1, bytes(r["ids"]), bytes(r["decoded"])) for r in df.collect())
    assert pick(whole) == pick(parts) and "day" in whole.columns
    assert bpe.round_trip(empty, RANKS, P.PATTERN).count() == 0


# --- 2: sharding ----------------------------------------------------------------
@pytest.mark.parametrize("bucket", [20_000, 32_000_000])
def test_shards(spark, documents, odd, bucket):
    for df in (documents, odd):
        rows = sharding.shard(df, 8, bucket_bytes=bucket).collect()
        assert Counter((r["doc_id"], r["text"], r["source"]) for r in rows) == Counter((r["doc_id"], r["text"], r["source"]) for r in df.collect())
        sizes = Counter(r["shard"] for r in rows)
        assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(8))
        for k, n in sizes.items():
            assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(n))


def test_shards_shuffle_and_repeat(documents, clashing, empty):
    place = lambda: [r["doc_id"] for r in sharding.shard(documents, 4, bucket_bytes=300_000).orderBy("shard", "slot").collect()]
    order = place()
    assert order == place()
    ids = np.array(order)
    assert abs(np.corrcoef(ids, np.arange(len(ids)))[0, 1]) < 0.2
    assert sharding.shard(clashing, 3).filter("slot >= 0").count() == clashing.count()
    assert sharding.shard(empty, 3).count() == 0


# --- 3: Jaccard join ------------------------------------------------------------
def brute_components(rows, percent=85, width=4):
    sets = []
    for _, text in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by[x].append(i)
    shared = Counter()
    for x in by.values():
        for a in range(len(x)):
            for b in range(a):
                shared[x[b], x[a]] += 1
    for (a, b), k in shared.items():
        if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
            root[find(a)] = find(b)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return Counter((doc_id, len(sets[i]), least.get(find(i)) if sets[i] else doc_id) for i, (doc_id, _) in enumerate(rows))


def joined(df):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join(df).select("doc_id", "n_shingles", "component_id").collect())


def test_jaccard_equals_brute_force(documents, odd):
    for df in (documents, odd):
        assert joined(df) == brute_components([(r["doc_id"], r["text"]) for r in df.collect()])


def near_group(seed, size, words, edits):
    rnd = np.random.default_rng(seed)
    base = [f"w{x}" for x in rnd.integers(0, 10**6, words)]
    out = []
    for _ in range(size):
        text = list(base)
        for at in rnd.integers(0, words, rnd.integers(0, edits + 1)):
            text[at] = f"n{rnd.integers(0, 10**6)}"
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("limits", [{}, {"SHORT_LIST": 8, "BLOCK": 7}, {"SHORT_LIST": 8, "BLOCK": 5, "LOCAL": 1, "OFTEN": 2, "HOT": 12}])
def test_jaccard_groups_blocks_and_small_sets(spark, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(jaccard, k, v)
    texts = near_group(1, 90, 120, 5) + near_group(2, 60, 60, 3) + near_group(3, 60, 20, 2)
    for n in range(4, 26):
        texts += near_group(100 + n, 6, n, 1)
    texts += [" ".join(texts[0].split()[:k]) for k in range(90, 120, 4)]
    df = spark.createDataFrame([(i * 3 + 1, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(7)
    want = brute_components([(r["doc_id"], r["text"]) for r in df.collect()])
    assert joined(df) == want
    assert len({c for _, _, c in want}) < len(texts) - 50


def test_jaccard_blocks_of_near_misses_give_no_square(spark, monkeypatch):
    import pandas as pd

    rnd = np.random.default_rng(8)
    core = rnd.integers(-(2**62), 2**62, 91)
    sets = [np.sort(np.concatenate([core, rnd.integers(-(2**62), 2**62, 9)])) for _ in range(60)]  # 91 of 109 in common: below 85 %
    sets += [np.append(sets[0][:-1], 2**62 + 1)]  # linked with the first one
    rows = {"node": np.arange(61), "n": np.full(61, 100, np.int32), "block": np.zeros(61, np.int32), "root": np.arange(61)}
    pdf = pd.DataFrame(rows | {"sketch": [jaccard.sketch_of(x).tobytes() for x in sets]})
    for lot, most in ((1_000_000, 61), (1_500, 61 * 5)):
        monkeypatch.setattr(jaccard, "LOT", lot)
        near = jaccard._compare_blocks(85, 20)((5, 0, 0), pdf)
        assert 0 < len(near) <= most and near["other"].isna().all()
        links = set()
        for lots, part in near.groupby("lots"):
            part = part.assign(elements=[sets[k].astype("<i8").tobytes() for k in part["node"]])
            links |= set(map(tuple, jaccard._link_blocks(85, 20)((5, 0, 0, lots), part).to_numpy().tolist()))
        assert links == {(0, 60)}
    few = jaccard._compare_blocks(85, 20)((5, 0, 0), pdf.iloc[[0, 60]])
    assert few[["node", "other"]].to_numpy().tolist() == [[0, 60]]
    assert not len(jaccard._compare_blocks(85, 20)((5, 0, 0), pdf.iloc[:1]))

    for k, v in {"SHORT_LIST": 8, "BLOCK": 16, "LOT": 400}.items():
        monkeypatch.setattr(jaccard, k, v)
    base, texts = [f"w{k}" for k in range(120)], []
    for i in range(57):  # edits of one place link, of different places nearly
        text, at = list(base), 6 * (i % 19) + 5
        text[at : at + 2] = f"x{i}", f"y{i}"
        texts.append(" ".join(text))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = brute_components(list(enumerate(texts)))
    assert joined(df) == want
    assert len({c for _, _, c in want}) == 19


@pytest.mark.parametrize("before", [0, 1])
def test_shingles_equal_plain_sets(monkeypatch, before):
    """Equal sets of word runs give equal hashes and others do not: odd white space, long words, cuts at any text, sliced columns."""
    monkeypatch.setattr(jaccard, "PIECE", 64)
    plain = [b"", b" ", b"a", b"A b", b"a B  ", b"a b c d", b"\ta b c D\x0b e", b"x" * 5000 + b" y", b"y " + b"X" * 5000, b"", b"x" * 4097, b"\xc2\xa0 a", b"w " * 300, b"w w w w", b"end"]
    found = list(jaccard.shingle_sets(pa.array([b"zz"] * before + plain, pa.binary()).slice(before), 4))
    want = []
    for text in plain:
        words = text.lower().split()
        want.append({tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set())
    assert [len(s) for s in found] == [len(s) for s in want]
    for i, j in combinations(range(len(plain)), 2):
        assert (found[i].tolist() == found[j].tolist()) == (want[i] == want[j]), (plain[i][:20], plain[j][:20])


def test_sketches_of_any_width_bound_the_difference():
    rnd = np.random.default_rng(5)
    sets = [np.unique(rnd.integers(-(2**62), 2**62, n)) for n in (1, 100, 128, 129, 300, 700, 20_000)]
    sets += [np.sort(s[: max(1, len(s) * 9 // 10)]) for s in sets]
    held = jaccard._Sketches([jaccard.sketch_of(s).tobytes() for s in sets])
    i, j = (np.array(x) for x in zip(*combinations(range(len(sets)), 2)))
    found = held.differences(i, held, j)
    for a, b, bits in zip(i.tolist(), j.tolist(), found.tolist()):
        assert bits <= len(np.setxor1d(sets[a], sets[b]))
    assert found[(i == 4) & (j == 5)] > 60


def test_subset_boundary_is_chosen_by_cost():
    assert jaccard.boundary_by_cost({}, 85) == 0
    assert jaccard.boundary_by_cost({7: 1000, 10: 1000}, 85) >= 10
    assert 0 < jaccard.boundary_by_cost({n: 100 for n in range(1, 41)}, 85) < 20


def test_one_of_each(odd, clashing, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    kept = jaccard.one_of_each(odd)
    groups = {c for _, n, c in brute_components(rows) if n}
    got = kept.collect()
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in got if WORD.search(r["text"] or "") and r["doc_id"] is not None) == sorted(groups - {None})
    assert jaccard.one_of_each(clashing).columns == clashing.columns
    assert jaccard.join(empty).count() == 0 and jaccard.one_of_each(empty).count() == 0


def test_one_of_each_keeps_all_rows_without_words(spark):
    blank = [(None, None), (None, ""), (None, None), (7, None), (7, ""), (7, ""), (8, " \t\n"), (8, " \t\n")]
    df = spark.createDataFrame([*blank, (1, "one two three"), (1, "one two three"), (2, "one two three")], "doc_id long, text string")
    got = Counter((r["doc_id"], r["text"]) for r in jaccard.one_of_each(df).collect())
    assert got == Counter([*blank, (1, "one two three")])


# --- 4: fingerprints ------------------------------------------------------------
def brute_fingerprints(rows):
    rows = [(i, t or "") for i, t in rows]
    out = {}
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        n = len(t) // 4
        out[i] = (len(t), hashlib.sha256((t[: len(t) - n] + following[:n]).encode()).hexdigest(), following)
    return out


def test_fingerprints_follow_ids(documents, monkeypatch):
    monkeypatch.setattr(fingerprint, "ROWS_A_RANGE", 40)
    want = brute_fingerprints([(r["doc_id"], r["text"]) for r in documents.orderBy("doc_id").collect()])
    rows = fingerprint.fingerprints(documents).collect()
    assert len(rows) == len(want) and all((r["n_chars"], r["edited_sha256"]) == want[r["doc_id"]][:2] for r in rows)
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    by = defaultdict(set)
    for r in rows:
        by[texts[r["doc_id"]]].add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert (r["near_edited"] == 1) == (r["fingerprint"] == r["edited_fingerprint"])
    assert all(len(x) == 1 for x in by.values()) and len({x for v in by.values() for x in v}) == len(by)
    long = [r for r in rows if r["n_chars"] > 1500]
    assert np.mean([r["near_edited"] > r["near_next"] for r in long]) > 0.95
    assert np.mean([r["near_edited"] for r in long]) > 0.5 > 0.2 > np.mean([r["near_next"] for r in long])


def test_fingerprint_is_homomorphic():
    a, b = "One line here.\nAnother line.", "A third.\nOne line here."
    va, vb = fingerprint.vector(a), fingerprint.vector(b)
    assert fingerprint.packed(fingerprint.add(va, vb)) == fingerprint.packed(fingerprint.vector(a + "\n" + b))
    assert fingerprint.packed(fingerprint.remove(fingerprint.add(va, vb), vb)) == fingerprint.packed(va)
    assert fingerprint.packed(fingerprint.vector("x\ny")) == fingerprint.packed(fingerprint.vector("y\nx")) != fingerprint.packed(fingerprint.vector("x\nx"))
    many = "\n".join(f"paragraph number {k}" for k in range(5000))
    some = fingerprint.likeness(fingerprint.vector(many), fingerprint.vector(many[: len(many) * 3 // 4]))
    assert 0.6 < some < 0.97


def test_fingerprints_of_unpunctuated_lines(spark):
    rnd = np.random.default_rng(3)
    letters = lambda n: "".join(map(chr, rnd.integers(97, 123, n)))
    words = lambda n: " ".join(letters(k) for k in rnd.integers(2, 9, n))
    cjk = lambda n: "".join(map(chr, rnd.integers(0x4E00, 0x9FA5, n)))
    texts = [make(n) for n in (300, 1000, 5000) for make in (words, cjk, letters) for _ in range(8)] + ["Lyly " * 210, words(3000)]
    rows = {r["doc_id"]: r for r in fingerprint.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    near = np.array([rows[k]["near_edited"] for k in range(len(texts))])
    print("near_edited", near.min(), near.mean())
    assert all(r["near_edited"] > r["near_next"] for r in rows.values()) and near.min() > 0.2 and near.mean() > 0.5
    shifted = [fingerprint.likeness(fingerprint.vector(t), fingerprint.vector("zz " + t)) for t in texts[:-2] if len(t) > 2000]
    assert min(shifted) > 0.5
    short = [words(15) for _ in range(200)]
    kept = [fingerprint.likeness(fingerprint.vector(a), fingerprint.vector(fingerprint.edited(a, b))) for a, b in zip(short, short[1:])]
    assert np.mean(kept) > 0.4
    for a, b in zip(texts, texts[1:]):
        assert fingerprint.packed(fingerprint.add(fingerprint.vector(a), fingerprint.vector(b))) == fingerprint.packed(fingerprint.vector(a + "\n" + b))
        assert "".join(fingerprint.paragraphs(a)) == a


def test_fingerprints_odd_rows(odd, clashing, empty, spark):
    rows = fingerprint.fingerprints(odd).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in odd.collect())
    assert fingerprint.fingerprints(clashing).count() == odd.count()
    assert fingerprint.fingerprints(empty).count() == 0
    one = fingerprint.fingerprints(odd.filter("doc_id = 3")).collect()
    text = odd.filter("doc_id = 3").first()["text"]
    assert [r["edited_sha256"] for r in one] == [brute_fingerprints([(3, text)])[3][1]]


# --- 5: toxicity ----------------------------------------------------------------
def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(y))
    rank[order] = np.arange(1, len(y) + 1)
    pos = y.sum()
    return (rank[y == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(y) - pos))


def test_toxicity_held_out(spark):
    big = "/root/testdata/sf0.1"
    rows = queries.op5_toxicity(spark, big).join(spark.read.parquet(f"{big}/labels.parquet").select("doc_id", "toxic"), "doc_id").filter("held_out").collect()
    y, s = np.array([r["toxic"] for r in rows]), np.array([r["score"] for r in rows])
    print("held-out AUC", auc(s, y), "accuracy", ((s >= 0.5) == y).mean(), "recall", (s[y == 1] >= 0.5).mean(), "false alarms", (s[y == 0] >= 0.5).mean())
    assert auc(s, y) > 0.93 and ((s >= 0.5) == y).mean() > 0.96 and (s[y == 0] >= 0.5).mean() < 0.02


def test_toxicity_of_joined_texts(spark):
    big = "/root/testdata/sf0.1"
    docs, marks = spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{big}/labels.parquet")
    held = docs.join(marks, "doc_id").filter(~learns("doc_id", 0)).orderBy("doc_id").collect()
    rnd, joined = np.random.default_rng(5), []
    for toxic, sizes in ((0, (20, 50, 100, 200)), (1, (5, 20, 50))):
        own = [r["text"] for r in held if r["toxic"] == toxic and r["text"]]
        joined += [(-1 - 10 * n - toxic, "\n".join(own[i] for i in rnd.integers(0, len(own), n))) for n in sizes for _ in range(20)]
    rows = toxicity.scored(docs.unionByName(spark.createDataFrame(joined, docs.schema)), marks).filter("doc_id < 0").collect()
    flagged = {toxic: [r["toxicity"] >= 0.5 for r in rows if -r["doc_id"] % 10 == 1 + toxic] for toxic in (0, 1)}
    print("flagged joins of clean texts", np.mean(flagged[0]), "of toxic texts", np.mean(flagged[1]))
    assert len(rows) == 140 and not any(flagged[0]) and np.mean(flagged[1]) > 0.9


def test_toxicity_odd_rows(odd, clashing, empty, labels, spark):
    marks = spark.createDataFrame([(k, k % 2) for k in range(24)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    for df in (odd, clashing):
        rows = toxicity.scored(df, marks)
        assert rows.filter("toxicity >= 0 AND toxicity <= 1").count() == df.count()
        assert rows.filter("coalesce(text, '') = '' AND toxicity >= 0.5").count() == 0
    assert toxicity.scored(empty, marks).count() == 0
    assert toxicity.scored(odd, marks.limit(0)).filter("toxicity = 0").count() == odd.count()


# --- 6: quality -----------------------------------------------------------------
def test_quality_against_labels(spark, documents, labels):
    scores = {r["doc_id"]: r["quality"] for r in quality.scored(documents).select("doc_id", "quality").collect()}
    kept = np.array([scores[r["doc_id"]] >= 0.5 for r in labels.collect()])
    good = np.array([r["quality"] == 1 for r in labels.collect()])
    print("kept of good", kept[good].mean(), "kept of bad", kept[~good].mean())
    assert kept[good].mean() > 0.98 and kept[~good].mean() < 0.2


def test_em_finds_accuracies():
    rnd = np.random.default_rng(0)
    good = rnd.random(20000) < 0.8
    rates = rnd.uniform(0.2, 0.7, len(quality.LABELLERS))
    votes = np.where(good[:, None], rnd.random((20000, len(rates))) < 0.002, rnd.random((20000, len(rates))) < rates)
    prior, rate, _ = quality.accuracies(Counter("".join("0" if v else "-" for v in row) for row in votes))
    assert abs(prior - 0.8) < 0.02 and np.abs(rate[0] - rates).max() < 0.03


def test_quality_odd_rows(odd, clashing, empty):
    for df in (odd, clashing):
        rows = quality.scored(df)
        assert rows.count() == df.count() and rows.filter("quality IS NULL OR quality < 0 OR quality > 1").count() == 0
        assert rows.filter("coalesce(text, '') = '' AND quality > 0").count() == 0
    assert quality.scored(empty).count() == 0


# --- 7: language model ----------------------------------------------------------
def lm_base(rows):
    learn = [(i, t) for i, t in rows if zlib.crc32(str("" if i is None else i).encode()) % 5 != 1]
    tokens = lambda t: [*WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")), None]
    c = Counter(w for _, t in learn for w in tokens(t))
    n, v = sum(c.values()), len(c)
    out = []
    for i, t in rows:
        w = tokens(t)
        base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        out.append((i, zlib.crc32(str("" if i is None else i).encode()) % 5 == 1, len(w), sum(c[x] > 0 for x in w), n, round(base, 6)))
    return Counter(out)


@pytest.mark.parametrize("sizes", [(16_382, 150_000), (50, 400)])
def test_language_model_counts(documents, odd, sizes):
    for df in (documents, odd):
        rows = language_model.scored(df, 1, *sizes).collect()
        got = Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows)
        want = lm_base([(r["doc_id"], r["text"]) for r in df.collect()])
        assert {x[:5] for x in got} == {x[:5] for x in want}
        assert sum(got.values()) == sum(want.values()) and abs(sum(x[5] * n for x, n in got.items()) - sum(x[5] * n for x, n in want.items())) < 1e-3
        held = [r for r in rows if r["held_out"]]
        assert all(r["score"] < 0 for r in rows)
        if df is documents and sizes[0] > 1000:
            print("held-out log10 per token: model", sum(r["score"] for r in held) / sum(r["n_tokens"] for r in held), "base", sum(r["base_score"] for r in held) / sum(r["n_tokens"] for r in held))
            assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_language_model_sums_to_one(documents):
    texts = documents.select(F.col("text").cast("binary").alias("text"))
    model, counts = language_model.train(texts, 300, 500)
    assert np.abs((10.0**model.table).sum(axis=1) - 1).max() < 1e-3
    top = {r["w"] for r in counts.orderBy(F.col("c").desc(), "w").limit(300).collect()}
    rare = [r["c"] for r in counts.collect() if r["w"] not in top]
    assert abs((10 ** model.class_log(np.array(rare))).sum() + 10 ** model.class_log(np.zeros(1))[0] - 1) < 0.02


def test_language_model_odd(empty, clashing):
    assert language_model.scored(empty).count() == 0
    assert language_model.scored(clashing.drop("score")).count() == clashing.count()


def test_language_model_every_context(spark):
    """Words far beyond the shared contexts and symbols keep what follows them, seen pairs in the broadcast or not."""
    rows = [(i, f"p{i % 600} q{i % 600}") for i in range(3000)]
    odd = [(10_000 + 40 * side + i, f"p{i % 600} q{(i + side) % 600}") for side in (0, 1) for i in range(40)]
    df, text_of = spark.createDataFrame(rows + odd, "doc_id long, text string"), dict(rows + odd)
    for pairs in (language_model.PAIRS, 0):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(language_model, "PAIRS", pairs)
            got = {(text_of[r["doc_id"]], r["held_out"]): r["score"] for r in language_model.scored(df, 1, 100, 150).collect()}
        seen = {t: v for (t, _), v in got.items()}
        other = {t: v for (t, held), v in got.items() if held and t.split()[0][1:] != t.split()[1][1:]}
        assert other and all(seen[f"{t.split()[0]} q{t.split()[0][1:]}"] > v + 0.5 for t, v in other.items())
        kept = got if pairs else {k: (v, kept[k]) for k, v in got.items()}
    assert all(abs(a - b) < 1e-4 for a, b in kept.values())


def test_language_model_tables_by_key():
    n, p = np.repeat([5.0, 400.0], 20_000), np.repeat([0.3, 0.2], 20_000)
    t = language_model._new_tables(n, p, np.arange(40_000) * 7, 3)
    assert (t >= 0).all() and (t <= n).all()
    assert abs(t[:20_000].mean() - 1.5) < 0.05 and abs(t[20_000:].mean() - 80) < 0.5 and abs(t[20_000:].std() - 8) < 0.3


# --- 8: nearest neighbours ------------------------------------------------------
def test_nearest_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(ann, "QUERY_BLOCK", 10)
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in df.collect()}
    got = ann.search(df, F.col("vec_id") % 20 == 0, 20, shard_rows=200).collect()
    ids = sorted(rows)
    x = np.stack([rows[i] for i in ids])
    hits = total = 0
    for q in [i for i in ids if i % 20 == 0]:
        s = x @ rows[q]
        best = [ids[k] for k in np.lexsort((ids, -s)) if ids[k] != q][:20]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r for r, _, _ in mine] == list(range(1, 21)) and all(abs(s[ids.index(v)] - c) < 1e-9 for _, v, c in mine)
        hits, total = hits + len({v for _, v, _ in mine} & set(best)), total + 20
    print("recall", hits / total)
    assert hits / total >= 0.95


def test_nearest_odd_vectors(spark):
    rnd = np.random.default_rng(2)
    rows = [(i, rnd.normal(size=8).tolist()) for i in range(100)]
    rows += [(200 + i, rows[0][1]) for i in range(60)]  # copies
    rows += [(300, None), (320, [0.0] * 8), (340, [float("nan")] + [1.0] * 7), (360, [None] + [1.0] * 7), (380, [float("inf")] * 8), (400, []), (None, rows[1][1]), (20, rows[20][1])]
    rows += [(500, [1.0, 2.0]), (520, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = defaultdict(list)
    for r in ann.search(df, F.col("vec_id") % 20 == 0, 20, shard_rows=40).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {0, 20, 40, 60, 80, 200, 220, 240, 500, 520}
    assert [v for _, v, _ in sorted(got[0])] == list(range(200, 220))
    assert [v for _, v, _ in sorted(got[220])] == [0, *range(200, 219)]
    assert [v for _, v, _ in got[500]] == [520]
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


# --- 9: token counts ------------------------------------------------------------
@pytest.mark.parametrize("chunk", [(32_768, 1_024), (700, 60)])
def test_token_counts(documents, odd, chunk):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(JSON)
    for df in (documents, odd):
        rows = df.collect()
        want = Counter((r["doc_id"], len((r["text"] or "").encode()), len(own.encode(r["text"] or "", add_special_tokens=False))) for r in rows)
        for pattern in (P.PATTERN, None):
            assert Counter(tuple(r) for r in token_counts.token_counts(df, JSON, pattern, *chunk).collect()) == want


def test_token_counts_specials_at_the_cut(spark, empty, clashing):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(JSON)
    rnd = np.random.default_rng(5)
    bits = ["<|endoftext|>", "<|endo", "ftext|>", " ", "  ", "\n", "a", "Word", "'s", "!!", "é", "12", "漢", "x" * 90]
    texts = ["".join(rnd.choice(bits, 300)) for _ in range(60)] + ["y" * 5000, " " * 3000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(df, JSON, P.PATTERN, 120, 50).collect()}
    assert got == {i: len(own.encode(t, add_special_tokens=False)) for i, t in enumerate(texts)}
    assert token_counts.token_counts(empty, JSON, P.PATTERN).count() == 0
    assert token_counts.token_counts(clashing, JSON, P.PATTERN).count() == clashing.count()


def test_words_split_as_in_the_library():
    """Each code point in several surroundings: counting by words equals encoding whole."""
    own = token_counts.tokenizer(JSON)
    count = token_counts.WordCounts(own, P.PATTERN)
    texts = []
    for a in range(0, 0x110000, 256):
        cs = [chr(c) for c in range(a, a + 256) if not 0xD800 <= c < 0xE000]
        texts += ["".join(f"a{c}1{c} {c}{c}! \n{c}b" for c in cs)] if cs else []
    assert count(texts) == [len(e) for e in own.encode_batch(texts, add_special_tokens=False)]


# --- 10: mixing -----------------------------------------------------------------
def brute_targets(sizes):
    """Round by round: share by weight, cap, share the excess."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, target, open_ = 1.5 * sum(sizes.values()), dict.fromkeys(order, 0.0), set(order)
    while left > 1e-9 and open_:
        w = sum(weight[s] for s in open_)
        for s in list(open_):
            target[s] += left * weight[s] / w
        left = 0.0
        for s in list(open_):
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return target


def test_mixing(documents, odd):
    for df in (documents, odd):
        rows = mixing.mix(df, rows_per_cell=7).collect()
        texts = [(r["doc_id"], r["source"], len(WORD.findall(r["text"] or ""))) for r in df.collect()]
        assert Counter((r["doc_id"], r["source"], r["size"]) for r in rows) == Counter(texts)
        sizes = Counter()
        for _, s, n in texts:
            sizes[s] += n
        want, taken = brute_targets(sizes), Counter()
        for r in rows:
            assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
            assert 0 <= r["taken"] <= 2 * r["size"]
            taken[r["source"]] += r["taken"]
        assert all(taken[s] == math.floor(want[s] + 1e-9) or abs(taken[s] - want[s]) <= 1 for s in sizes)
        again = mixing.mix(df.repartition(5), rows_per_cell=100).collect()
        pick = lambda rs: Counter((r["doc_id"], r["size"], r["taken"]) for r in rs)
        assert pick(rows) == pick(again)


def test_mixed_documents(odd, clashing, empty):
    out = mixing.mixed_documents(odd)
    assert out.columns == odd.columns
    taken = sum(r["taken"] for r in mixing.mix(odd).collect())
    assert sum(len(WORD.findall(r["text"] or "")) for r in out.collect()) == taken
    texts = {r["text"] for r in odd.collect()}
    cut = [r["text"] for r in out.collect() if r["text"] not in texts]
    assert all(any(t and t.startswith(c) for t in texts) for c in cut)
    assert mixing.mixed_documents(clashing).columns == clashing.columns
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0

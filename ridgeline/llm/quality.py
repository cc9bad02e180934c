"""Quality classifier from weak labels.

``LABELLERS`` are overlapping heuristics over whole texts; each knows one kind of fault
and votes bad or abstains.  Expectation-maximisation over the counts of all documents'
vote patterns (at most 2 ** labellers, counted by Spark) estimates how often each votes
in good and in bad documents, with the true quality latent; a prior holds that a vote
against a good document is rare, so faults that do not occur together still make one
class.  The posterior labels of a bounded sample
(``sample_rows`` documents, drawn by a hash) train a linear scorer of hashed features:
word shapes, pairs of neighbouring shapes, and repeats.  All documents are scored.

Null and empty texts hold no words: they score 0 and are rejected.  Rows are scored
one by one, so repeated rows score alike; null ids are kept.  If the corpus has no
document at all, nothing is trained and the result is empty.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import claim, texts_of

FEATURES = 1 << 14
SAMPLE_ROWS = 8_000
#: Fixed feature numbers: the bias, and a word that repeats the one before.
BIAS, REPEAT = 0, 1
BAD, ABSTAIN = "0", "-"
#: Prior share of a labeller's votes in good documents, and its weight as a share of all documents.
FALSE_ALARMS, PRIOR_WEIGHT = 0.002, 1.0
LABELLERS = (
    "capitals", "symbols", "marks", "separators", "repeats", "distinct_pairs", "digits",
    "sentences", "copied_lines", "broken_characters", "word_length", "letters",
)
_COLLAPSE = re.compile(rb"(.)\1+", re.DOTALL)
#: Byte classes of a word's shape: capitals, small letters, digits; other bytes stand for themselves.
_CLASSES = bytes(ord("X") if 65 <= b <= 90 else ord("x") if 97 <= b <= 122 or b >= 128 else ord("9") if 48 <= b <= 57 else b for b in range(256))


class Shapes(dict):
    """Feature number of a word's shape."""

    def __missing__(self, word: bytes) -> int:
        shape = _COLLAPSE.sub(rb"\1", word.translate(_CLASSES))[:12]
        value = 2 + zlib.crc32(shape) % (FEATURES - 2)
        if len(self) >= 150_000:
            self.clear()
        self[word] = value
        return value


SHAPES = Shapes()


def forget_shapes() -> None:
    SHAPES.clear()


def votes(text: bytes, words: list[bytes]) -> str:
    """One vote per labeller."""
    import numpy as np

    if not words:
        return ABSTAIN * len(LABELLERS)
    n = len(words)
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, lower, digits, high = seen[65:91].sum(), seen[97:123].sum(), seen[48:58].sum(), seen[128:].sum()
    solid = max(1, len(text) - seen[9:14].sum() - seen[32])
    symbols = sum(int(seen[ord(c)]) for c in "#$%&*+<=>@\\^_`{|}~")
    marks = seen[ord("!")] + seen[ord("?")]
    ends = seen[ord(".")] + marks
    pairs = list(zip(words, words[1:], strict=False))
    lines = [x for x in text.split(b"\n") if x.strip()]
    broken = text.count(b"\xef\xbf\xbd") + text.count(b"\xc3\x83") + text.count(b"\xc3\x82") + seen[:9].sum()
    bad = (
        upper > 0.4 * max(1, upper + lower),
        symbols > 0.08 * solid,
        marks > 0.3 * n,
        seen[ord("|")] > 0.15 * n,
        sum(a == b for a, b in pairs) > 0.3 * max(1, n - 1) and n >= 4,
        n >= 20 and len(set(pairs)) < 0.6 * len(pairs),
        digits > 0.25 * solid and n >= 20,
        n >= 30 and ends < 0.005 * n,
        len(lines) >= 4 and len(set(lines)) < 0.6 * len(lines),
        broken > 0.01 * solid,
        n >= 20 and not 1.5 <= solid / n <= 14,
        n >= 20 and upper + lower + high + digits < 0.75 * solid,
    )
    return "".join(BAD if b else ABSTAIN for b in bad)


def features(words: list[bytes]):
    """Feature numbers of a text's words, pairs and repeats; each counts 1 / words."""
    import numpy as np

    shapes = np.fromiter(map(SHAPES.__getitem__, words), np.int64, len(words))
    pairs = 2 + (shapes[:-1] * 40503 + shapes[1:] * 2654435) % (FEATURES - 2)
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return np.concatenate([shapes, pairs, np.full(repeats, REPEAT, np.int64)])


def accuracies(patterns: dict[str, int], rounds: int = 200):
    """EM of the two-class model with independent votes.

    Returns (share of good, P(bad vote | class) as [class, labeller] with class 1 good, P(good) by pattern).
    """
    import numpy as np

    names = sorted(patterns)
    v = np.array([[c == BAD for c in p] for p in names], float)
    n = np.array([patterns[p] for p in names], float)
    q = np.where(v.any(axis=1), 0.1, 0.95)
    extra = PRIOR_WEIGHT * n.sum()
    for _ in range(rounds):
        bad, good = n * (1 - q), n * q
        rate = np.stack([(bad @ v + 0.5) / (bad.sum() + 1), (good @ v + FALSE_ALARMS * extra) / (good.sum() + extra)])
        prior = (good.sum() + 1) / (n.sum() + 2)
        odds = np.log(prior / (1 - prior)) + v @ np.log(rate[1] / rate[0]) + (1 - v) @ np.log((1 - rate[1]) / (1 - rate[0]))
        q = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
    return prior, rate, dict(zip(names, q.tolist(), strict=True))


def fit_scorer(rows, posteriors, rounds: int = 300):
    """Weights of logistic regression on soft labels; rows: (numbers, shares) per document."""
    import numpy as np

    lengths = [len(a) for a, _ in rows]
    doc = np.repeat(np.arange(len(rows)), lengths)
    number, share = np.concatenate([a for a, _ in rows]), np.concatenate([b for _, b in rows])
    y = np.asarray(posteriors)
    w, m, s = np.zeros(FEATURES), np.zeros(FEATURES), np.zeros(FEATURES)
    for t in range(1, rounds + 1):
        z = w[BIAS] + np.bincount(doc, w[number] * share, len(rows))
        error = (1 / (1 + np.exp(-z)) - y) / len(rows)
        g = np.bincount(number, error[doc] * share, FEATURES) + 1e-5 * w
        g[BIAS] = error.sum()
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        w -= 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
    return w


def _texts(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from collections import Counter

    claim("quality", forget_shapes)
    seen: Counter = Counter()
    for batch in batches:
        seen.update(votes(t, t.split()) for t in texts_of(batch.column(0)))
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array(list(seen.values()), pa.int64())], names=["pattern", "n"])


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np

    claim("quality", forget_shapes)
    for batch in batches:
        out = []
        for text in texts_of(batch.column(0)):
            words = text.split()
            number, n = np.unique(features(words), return_counts=True)
            out.append((votes(text, words), number.tolist(), (n / max(1, len(words))).tolist()))
        if out:
            kinds = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["pattern", "number", "share"])


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS):
    """(scorer weights, posterior by pattern) from all of docs' texts; None without documents."""
    import numpy as np

    texts = _texts(docs).select("text").filter(F.length("text") > 0)
    found = texts.mapInArrow(_patterns, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    if not found:
        return None
    _, _, posterior = accuracies({r["pattern"]: r["n"] for r in found})
    share = min(1.0, sample_rows / sum(r["n"] for r in found))
    drawn = texts.filter((F.pmod(F.xxhash64(F.lit(5), "text"), F.lit(1_000_000_007)) / 1_000_000_007.0) < share).dropDuplicates(["text"]) if share < 1 else texts
    rows = drawn.mapInArrow(_examples, "pattern string, number array<long>, share array<double>").orderBy("pattern", "number").collect()
    rows = rows or texts.limit(1).mapInArrow(_examples, "pattern string, number array<long>, share array<double>").collect()
    pairs = [(np.array(r["number"], np.int64), np.array(r["share"], float)) for r in rows]
    return fit_scorer(pairs, [posterior.get(r["pattern"], 0.5) for r in rows]), posterior


def scored(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, weights=None) -> DataFrame:
    """docs with ``quality`` (0 to 1) appended, or in place of a column of that name."""
    own = [c for c in docs.columns if c.lower() != "quality"]
    docs = docs.select(*[F.col(f"`{c}`") for c in own])
    schema = docs.select("*", F.lit(0.0).alias("quality")).schema
    if weights is None:
        trained = train(docs, sample_rows)
        if trained is None:
            return docs.withColumn("quality", F.lit(0.0))
        weights = trained[0]
    weights = weights.astype("float32")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        claim("quality", forget_shapes)
        at = own.index("text")
        for batch in batches:
            out = []
            for text in texts_of(batch.column(at)):
                words = text.encode().split() if text else []
                z = weights[BIAS] + weights[features(words)].sum() / len(words) if words else -np.inf
                out.append(1 / (1 + np.exp(-float(z))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*own, "quality"])

    return docs.mapInArrow(run, schema)

"""Token counts by overlap resynchronisation.

Texts of up to ``chunk`` characters are counted in place: with a plain byte-level
tokenizer, words do not act on each other, so the library encodes each distinct
word once per worker (a bounded cache) and a text's count is the sum over its
words and special strings; any other tokenizer encodes them whole.  Longer texts are cut into
chunks that overlap; every chunk is encoded on its own, with offsets, wherever it
lands.  Two neighbouring chunks are spliced at the first word boundary that both
show in their overlap.

Why that is exact: the pre-tokenizer scans from left to right without looking
back, and merges never cross its words, so from a position that is a boundary of
the true scan, any scan that has a boundary there goes on alike.  A chunk's
boundaries are those of the true scan from its splice on, but near its end, where
a word, white space or special string may be cut short: the last
``longest special string + 1`` characters are not used.  Chunk 0 starts truly, and
each splice carries that on.  If the overlap of two chunks has no common boundary
(a word longer than the overlap), the text is cut again with chunks and overlaps
``WIDEN`` times as wide, in the end into one chunk.

Needs a tokenizer whose words are matched left to right without look-behind, such
as the byte-level one; a tokenizer with a normalizer encodes every text whole.

Null texts have 0 bytes and 0 tokens; equal long texts are encoded once; rows with
the same or no doc_id stay apart; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import claim, materialize

CHUNK = 32_768
OVERLAP = 1_024
WIDEN = 8
BATCH_CHARS = 2_000_000
CACHE_WORDS = 400_000


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordCounts:
    """Counts of a text's tokens from counts of its distinct words, for a plain byte-level tokenizer."""

    def __init__(self, own, pattern: str):
        import re

        import regex

        self.own, self.counts = own, {}
        self.find = regex.compile(pattern).findall
        special = sorted((t.content for t in own.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None

    def __call__(self, texts: list[str]) -> list[int]:
        split, extra = [], []
        for text in texts:
            parts = self.special.split(text) if self.special else [text]
            extra.append(len(parts) - 1)
            split.append([w for p in parts for w in self.find(p)] if len(parts) > 1 else self.find(text))
        new = set().union(*split).difference(self.counts)
        if len(self.counts) + len(new) > CACHE_WORDS:
            self.counts.clear()
            new = set().union(*split)
        new = list(new)
        for at in range(0, len(new), 10_000):
            part = new[at : at + 10_000]
            self.counts.update(zip(part, map(len, self.own.encode_batch_fast(part, add_special_tokens=False)), strict=True))
        get = self.counts.__getitem__
        return [n + sum(map(get, words)) for n, words in zip(extra, split, strict=True)]


@lru_cache(maxsize=2)
def counter(path: str, pattern: str | None):
    """texts -> counts; by words where the tokenizer's own settings show that words are independent."""
    import json

    own = tokenizer(path)
    with open(path, encoding="utf-8") as f:
        kept = json.load(f)
    pre = kept.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    loose = any(t[k] for t in kept.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if pattern and plain and not loose and kept.get("normalizer") is None:
        return WordCounts(own, pattern)
    return lambda texts: [len(e) for e in own.encode_batch_fast(texts, add_special_tokens=False)]


def _counted(path: str, pattern: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("token_counts", counter.cache_clear)
        count = counter(path, pattern)
        for batch in batches:
            texts = batch.column(batch.schema.names.index("text")).to_pylist()
            counts, part, size = [], [], 0
            for text in texts:
                part.append(text or "")
                size += len(part[-1])
                if size >= BATCH_CHARS:
                    counts += count(part)
                    part, size = [], 0
            counts += count(part)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.names.index("doc_id")), batch.column(batch.schema.names.index("n_bytes")), pa.array(counts, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    return run


def _cut(chunk: int, overlap: int):
    """Rows (digest, k, of, at, piece): chunk k starts at character k * chunk and reaches into the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                of = max(1, -(-(len(text) - overlap) // chunk))
                for k in range(of):
                    end = len(text) if k == of - 1 else (k + 1) * chunk + overlap
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([digest]), pa.array([k], pa.int64()), pa.array([of], pa.int64()), pa.array([text[k * chunk : end]])],
                        names=["digest", "k", "of", "piece"],
                    )

    return run


BOUNDARIES = "digest string, k long, of long, n_tokens long, joint long, pos long, n long"


def _encoded(path: str, chunk: int, overlap: int):
    """A row (joint null) with each chunk's count, and one for each boundary in an overlap.

    joint j lies between chunks j - 1 and j; n: tokens of the chunk before pos.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("token_counts", counter.cache_clear)
        own = tokenizer(path)
        margin = max((len(t.content) for t in own.get_added_tokens_decoder().values()), default=0) + 1
        for batch in batches:
            for digest, k, of, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                coded = own.encode(piece, add_special_tokens=False)
                rows = [(digest, k, of, len(coded), None, None, None)]
                last, words = None, coded.word_ids
                for i, (start, _) in enumerate(coded.offsets):
                    if i and words[i] == last:
                        continue
                    last, pos = words[i], k * chunk + start
                    if k and start <= overlap:
                        rows.append((digest, k, of, None, k, pos, i))
                    if k < of - 1 and chunk <= start <= chunk + overlap - margin:
                        rows.append((digest, k, of, None, k + 1, pos, i))
                kinds = [pa.string()] + [pa.int64()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["digest", "k", "of", "n_tokens", "joint", "pos", "n"])

    return run


def _long_counts(long: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(digest, n_tokens) of distinct texts (digest, text); null where a joint has no common boundary."""
    pieces = long.mapInArrow(_cut(chunk, overlap), "digest string, k long, of long, piece string")
    pieces = pieces.groupBy("digest", "k", "of").agg(F.first("piece").alias("piece"))  # equal texts once, chunks spread
    rows = materialize(pieces.select("digest", "k", "of", "piece").mapInArrow(_encoded(path, chunk, overlap), BOUNDARIES), "chunk-tokens")
    marks = rows.filter("joint IS NOT NULL")
    left = marks.filter("joint = k + 1").select("digest", "joint", "pos", F.col("n").alias("ahead"))
    right = marks.filter("joint = k").select("digest", "joint", "pos", F.col("n").alias("again"))
    splices = left.join(right, ["digest", "joint", "pos"]).groupBy("digest", "joint").agg(F.min_by(F.col("ahead") - F.col("again"), "pos").alias("n_tokens"))
    whole = rows.filter("joint IS NULL AND k = of - 1").select("digest", "n_tokens", F.col("of").alias("parts"), F.lit(1).alias("found"))
    parts = whole.unionByName(splices.select("digest", "n_tokens", F.lit(0).cast("long").alias("parts"), F.lit(1).alias("found")))
    total = parts.groupBy("digest").agg(F.sum("n_tokens").alias("n_tokens"), F.max("parts").alias("parts"), F.sum("found").alias("found"))
    return total.select("digest", F.when(F.col("parts") == F.col("found"), F.col("n_tokens")).alias("n_tokens"))


def token_counts(docs: DataFrame, path: str, pattern: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every document by the tokenizers file at path.

    pattern: the words' pattern of a byte-level tokenizer; without it, texts are encoded whole.
    """
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    fits = F.coalesce(F.length("text") <= chunk, F.lit(True))
    schema = rows.select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_tokens")).schema
    if tokenizer(path).normalizer is not None:
        return rows.mapInArrow(_counted(path, pattern), schema)
    short = rows.filter(fits).mapInArrow(_counted(path, pattern), schema)
    long = rows.filter(~fits).withColumn("digest", F.md5(F.col("text").cast("binary")))
    left, done = long.select("digest", "text"), []
    while True:
        counts = materialize(_long_counts(left, path, chunk, overlap), "long-tokens")
        done.append(counts.filter("n_tokens IS NOT NULL"))
        failed = counts.filter("n_tokens IS NULL").select("digest")
        if failed.isEmpty():
            break
        chunk, overlap = chunk * WIDEN, overlap * WIDEN
        left = long.select("digest", "text").join(failed, "digest", "left_semi")
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return short.unionByName(long.select("digest", "doc_id", "n_bytes").join(found, "digest").select("doc_id", "n_bytes", "n_tokens"))

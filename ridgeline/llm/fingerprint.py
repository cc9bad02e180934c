"""Document fingerprints by a homomorphic multiset hash.

A text is a multiset of paragraphs: its lines, a line of more than ``PARAGRAPH``
characters cut behind sentence ends.  What is still long for its line is cut on behind
words (characters, in scripts and runs without spaces) that a hash of the last ``NEAR``
characters picks, so that an edit changes only the paragraphs around it; a shorter line
is cut finer, to have several paragraphs.  Each paragraph is hashed to a wide vector,
and the fingerprint is the sum of the vectors, modulo powers of two per lane:

- 8 lanes modulo 2**64 that every paragraph fills (equality),
- 6 levels of 64 lanes modulo 2**16, of which a paragraph fills one lane; level l
  takes a paragraph with probability 2**-(l + 1), the last level the rest (likeness),
- the number of paragraphs modulo 2**64.

Sums do not depend on order, and paragraphs can be added or removed from a
fingerprint without the rest of the text (``add`` and ``remove``).  The lanes of
two fingerprints differ where paragraphs differ; from the share of equal lanes of
the levels that are not saturated follows the number of differing paragraphs d, and
the likeness is 1 - d / (paragraphs of both), 1 exactly for equal fingerprints.

Null and empty texts have no paragraph and the fingerprint of nothing.  Rows with
the same doc_id follow each other by their texts, a null doc_id comes first.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PARAGRAPH = 200
#: Characters that pick a cut; about so many paragraphs of a short line; least and most characters of one, on average.
NEAR, PARTS, FINEST, COARSEST = 8, 8, 16, 128
DENSE, LEVELS, LANES = 8, 6, 64
#: Ranges of doc_id: at most so many, so that the table of their first rows can be broadcast.
MOST_RANGES = 50_000
ROWS_A_RANGE = 4_000
_SENTENCE = re.compile(r"(?<=[.!?;|]) ")
_SOLID = r"[^\s\u2e80-\ud7ff\uf900-\ufaff\U00020000-\U0003ffff]"
#: A word of up to 32 characters with the space behind it, or else one character.
_UNIT = re.compile(rf"(?<!{_SOLID}){_SOLID}{{1,32}}(?!{_SOLID})\s*|.", re.DOTALL)


def cut(piece: str, size: int) -> list[str]:
    """piece in parts of about size characters (a power of two), at most about twice as many; picks of a larger size are picks of a smaller one."""
    out, at = [], 0
    for unit in _UNIT.finditer(piece):
        end = unit.end()
        if end - at < size // 4:
            continue
        every = size // 8 if end - unit.start() > 1 else size
        if zlib.crc32(piece[max(0, end - NEAR) : end].encode()) % every == 0 or end - at >= 2 * size:
            out.append(piece[at:end])
            at = end
    return [*out, piece[at:]]


def paragraphs(text: str) -> list[str]:
    out = []
    for line in text.split("\n"):
        size = min(COARSEST, max(FINEST, 1 << (len(line) // PARTS).bit_length() >> 1))
        for piece in [line] if len(line) <= PARAGRAPH else _SENTENCE.split(line):
            out += [piece] if len(piece) <= min(2 * size, PARAGRAPH) else cut(piece, size)
    return [p for p in out if p]


def vector(text: str | None):
    """(dense uint64, sparse uint16, count) sums of a text's paragraphs."""
    import numpy as np

    parts = paragraphs(text) if text else []
    dense, sparse = np.zeros(DENSE, np.uint64), np.zeros(LEVELS * LANES, np.uint16)
    if parts:
        raw = np.frombuffer(b"".join(blake2b(p.encode(), digest_size=64).digest() for p in parts), np.uint64).reshape(-1, 8)
        dense = raw.sum(axis=0, dtype=np.uint64)
        word = raw[:, 7]
        coin = (word & np.uint64(0xFFFF)).astype(np.int64)
        level = np.minimum(np.log2((coin & -coin) | 0x10000 * (coin == 0)).astype(np.int64), LEVELS - 1)
        lane = (word >> np.uint64(16)).astype(np.int64) % LANES
        np.add.at(sparse, level * LANES + lane, ((word >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.uint16))
    return dense, sparse, len(parts)


def add(a, b):
    return a[0] + b[0], a[1] + b[1], a[2] + b[2]


def remove(a, b):
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def packed(v) -> str:
    return base64.b64encode(v[0].tobytes() + v[1].tobytes() + int(v[2]).to_bytes(8, "little")).decode()


def likeness(a, b) -> float:
    import numpy as np

    if (a[0] == b[0]).all() and a[2] == b[2]:
        return 1.0
    least, total = abs(a[2] - b[2]), a[2] + b[2]
    same = (a[1] == b[1]).reshape(LEVELS, LANES).sum(axis=1)
    first = next((k for k in range(LEVELS) if same[k] >= LANES // 8), LEVELS - 1)
    differ = sum(np.log(max(same[k], 0.5) / LANES) / np.log1p(-1 / LANES) for k in range(first, LEVELS))
    return float(min(1.0, max(0.0, 1 - max(differ * 2.0**first, least, 1) / max(total, 1))))


def edited(text: str, following: str) -> str:
    """text, its last quarter replaced by as many first characters of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (range, ahead, doc_id, text) in order: ahead 1 marks the first row of the next range."""
    from hashlib import sha256

    held, done, rows = None, True, []

    def digest(one, text, v) -> tuple:
        doc_id, own, own_v = one
        new = edited(own, text)
        new_v = vector(new)
        return (doc_id, len(own), sha256(new.encode()).hexdigest(), packed(own_v), packed(new_v), likeness(own_v, new_v), likeness(own_v, v))

    def batch_of(rows) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        for ahead, doc_id, text in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
            if done and ahead:
                continue  # another copy of the row after this range
            v = vector(text)
            if not done:
                rows.append(digest(held, text, v))
            held, done = (doc_id, text, v), bool(ahead)
            if len(rows) >= 500:
                yield batch_of(rows)
                rows = []
    if rows:
        yield batch_of(rows)


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document; see SCHEMA.  The next document is that of the next doc_id, the first one after the last.

    Documents are dealt by ranges of doc_id; the first document of each range is also sent to the
    range before it, so that every document meets its successor with one shuffle of the texts.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    low, high, n = docs.agg(F.min(F.col("doc_id").cast("long")), F.max(F.col("doc_id").cast("long")), F.count(F.lit(1))).first()
    n_ranges = max(1, min(MOST_RANGES, n // ROWS_A_RANGE))
    width = max(1, -(-((high or 0) - (low or 0) + 1) // n_ranges))
    # rows without an id come first, in 64 ranges of their tie
    place = F.when(F.col("doc_id").isNull(), F.shiftright("tie", 58) - 100).otherwise(F.floor((F.col("doc_id") - F.lit(low or 0)) / F.lit(width)))
    rows = rows.withColumn("range", place.cast("long"))
    firsts = rows.groupBy("range").agg(F.min(F.struct(F.col("doc_id"), F.col("tie"))).alias("first"))
    along = Window.orderBy("range")
    everything = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sent = firsts.select("range", F.col("first.doc_id").alias("f_id"), F.col("first.tie").alias("f_tie"), F.coalesce(F.lag("range").over(along), F.last("range").over(everything)).alias("to"))
    both = rows.join(F.broadcast(sent), "range")
    is_first = F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("tie") == F.col("f_tie"))
    there = F.array(F.struct(F.col("range").alias("r"), F.lit(0).alias("ahead")))
    copied = F.when(is_first, F.concat(there, F.array(F.struct(F.col("to").alias("r"), F.lit(1).alias("ahead"))))).otherwise(there)
    dealt = both.select(F.explode(copied).alias("x"), "doc_id", "tie", "text").select(F.col("x.r").alias("range"), F.col("x.ahead").alias("ahead"), "doc_id", "tie", "text")
    ordered = dealt.repartition("range").sortWithinPartitions("range", "ahead", F.col("doc_id").asc_nulls_first(), "tie", "text")
    return ordered.select("range", "ahead", "doc_id", "text").mapInArrow(_in_order, SCHEMA)

"""Helpers that the operators share: scratch tables, table reading, hashed words."""

from __future__ import annotations

import contextlib
from collections.abc import Callable
from hashlib import blake2b

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.session import scratch_path

#: Distinct words that a worker remembers the hash of.
CACHE_WORDS = 200_000
#: White space of the word contracts, as a Java and RE2 class.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet to the shared folder and read again: cuts the lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Jobs started inside hand tasks' Python Arrow batches of at most so many rows; the session's setting comes back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def texts_of(column):
    """Values of an Arrow column, a few hundred at a time."""
    for at in range(0, len(column), 256):
        yield from column.slice(at, 256).to_pylist()


def learns(doc_id: Column | str, fold: int) -> Column:
    """True unless crc32(doc_id as text) mod 5 is the fold (a null id counts as the empty text)."""
    name = (F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string")
    return F.crc32(F.coalesce(name, F.lit("")).cast("binary")) % 5 != fold


_HELD: dict[str, Callable[[], None]] = {}


def claim(name: str, clear: Callable[[], None] = lambda: None) -> None:
    """Say at the start of a task whose caches its worker may hold; those of other operators are let go.

    Spark keeps Python workers between tasks, and so their module-level caches.
    """
    import ctypes
    import gc

    others = [k for k in _HELD if k != name]
    for k in others:
        _HELD.pop(k)()
    _HELD[name] = clear
    if others:
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)


class WordHashes(dict):
    """Signed 64-bit hash of a word's bytes; remembers a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        value = int.from_bytes(blake2b(word, digest_size=8).digest(), "little", signed=True)
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = value
        return value


WORD_HASHES = WordHashes()


# Functions travel to the tasks by name, objects by value: tasks reach the worker's own table through these.
def hash_of(word: bytes) -> int:
    return WORD_HASHES[word]


def forget_words() -> None:
    WORD_HASHES.clear()


def word_hashes(text: bytes | None):
    """Hashes of the text's words in order, A-Z lower-cased; split at ASCII white space."""
    import numpy as np

    words = text.lower().split() if text else []
    return np.fromiter(map(WORD_HASHES.__getitem__, words), np.int64, len(words))

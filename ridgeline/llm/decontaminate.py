"""Benchmark decontamination, with DataFrame operations only.

Texts become words: A-Z lower-cased, runs of ``WORD``.  A window is ``width``
consecutive words of a benchmark item; an item of fewer words, but not none, is one
window.  The distinct windows, hashed, are broadcast; one scan of the documents hashes
all their windows of these lengths and probes, and each hit is verified word by word
inside the join.  Only hits and one short row per document are shuffled.

The broadcast table is measured first.  Beyond ``BROADCAST_BYTES`` it is dealt by hash
into blocks below that size and the documents are scanned once per block, with the same
result.  A document's hits meet in one group: at most one per word and window length of
that one text, and item sets that the broadcast block holds anyway.

Null and empty texts have no words; benchmark items without words have no window.  Items
with the same id are one item, a null item id is the id ``''``.  Rows with equal doc_id and
text share their hits, counted once, and stay rows of their own.  Empty tables on either
side are fine.  Extra columns of documents take no part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import materialize

WIDTH = 10
#: Runs of these are words, in lower-cased text and in text as it is.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Most that is broadcast at once, as Spark holds it.
BROADCAST_BYTES = 128 << 20


def words_of(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def text_key() -> Column:
    return F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))


def _hash(words: Column) -> Column:
    return F.xxhash64(F.transform(words, lambda w: F.xxhash64(w)))


def benchmark_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(window, length, hash, items): every distinct window and the sorted ids of the items it occurs in."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(width))
    windows = F.transform(F.sequence(F.lit(1), F.size("words") - length + 1), lambda i: F.slice("words", i, length))
    found = items.select("item", F.explode(windows).alias("window")).distinct()
    return found.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items")).select("window", F.size("window").alias("length"), _hash(F.col("window")).alias("hash"), "items")


def _tokenized(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), words_of(F.col("text")).alias("words"))
    return rows.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))


def _probed(rows: DataFrame, windows: DataFrame, lengths: list[int], heads: bool) -> DataFrame:
    """A row for each verified hit and, with heads, one (at null) for each document."""
    n = F.size("words")

    def keys(k: int) -> Column:
        return F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.xxhash64(F.slice("hashes", i, k))))

    own = [F.struct(F.lit(0).alias("length"), F.array(F.lit(0).cast("long")).alias("keys"))] if heads else []
    own += [F.struct(F.lit(k).alias("length"), keys(k).alias("keys")) for k in lengths]
    if not own:
        own = [F.struct(F.lit(0).alias("length"), F.array().cast("array<long>").alias("keys"))]
    each = rows.select("doc_id", "text_key", "words", F.inline(F.array(*own))).select("doc_id", "text_key", "words", "length", F.posexplode("keys").alias("at", "key"))
    probe = F.broadcast(windows.select(F.col("length").alias("w_length"), "hash", "window", "items"))
    hits = each.join(probe, (F.col("key") == F.col("hash")) & (F.col("length") == F.col("w_length")), "left" if heads else "inner")
    hit = F.col("window").isNotNull()
    hits = hits.filter(~hit & (F.col("length") == 0) | hit & (F.slice("words", F.col("at") + 1, F.col("length")) == F.col("window")))
    return hits.select("doc_id", "text_key", F.when(~hit, F.size("words")).alias("n_words"), F.when(hit, F.struct("at", "length")).alias("span"), "items")


def hits_by_text(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, text_key, copies, n_words, hit, items) of each distinct (doc_id, text).

    ``hit`` holds the places of the hit words (from 0, rising), ``items`` the sorted ids of
    the benchmark items with windows in the text, ``copies`` the number of such rows.
    """
    windows = materialize(benchmark_windows(benchmark, width), "benchmark-windows")
    size = F.octet_length(F.array_join("window", " ")) + F.octet_length(F.array_join("items", " ")) + 16 * (F.size("window") + F.size("items")) + 64
    total = windows.agg(F.sum(size)).first()[0] or 0
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())  # at most ``width`` values
    blocks = max(1, -(-total // broadcast_bytes))
    rows = _tokenized(docs)
    parts = [_probed(rows, windows.filter(F.pmod("hash", F.lit(blocks)) == b), lengths, b == 0) for b in range(blocks)]
    by = reduce(DataFrame.unionByName, parts).groupBy("doc_id", "text_key").agg(
        F.count("n_words").cast("int").alias("copies"), F.max("n_words").alias("n_words"),
        F.array_sort(F.collect_set("span")).alias("spans"), F.collect_set("items").alias("items"),
    )
    # a span gives the words that the one before it does not: spans rise by place, so little is repeated
    def places(s, k):
        before, last = F.get("spans", k - 1), s["at"] + s["length"] - 1
        return F.sequence(F.when(k == 0, s["at"]).otherwise(F.greatest(s["at"], F.least(last, before["at"] + before["length"]))), last)

    places = F.flatten(F.transform("spans", places))
    return by.select("doc_id", "text_key", "copies", "n_words", F.array_sort(F.array_distinct(places)).alias("hit"), F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"))


def _spans(places: str) -> Column:
    """Maximal runs (first, last) of rising places."""
    firsts = F.filter(places, lambda x, k: (k == 0) | (F.get(places, k - 1) < x - 1))
    lasts = F.filter(places, lambda x, k: F.coalesce(F.get(places, k + 1) > x + 1, F.lit(True)))
    return F.zip_with(firsts, lasts, lambda a, b: F.struct(a.alias("first"), b.alias("last")))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, **options) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans) of every document; spans are runs of hit words, numbered from 0."""
    by = hits_by_text(docs, benchmark, width, **options)
    rows = by.select("doc_id", "n_words", F.size("hit").cast("long").alias("n_hit"), "items", _spans("hit").alias("spans"), F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    return rows.select("doc_id", F.col("n_words").cast("long").alias("n_words"), "n_hit", "items", "spans")


def decontaminated(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", width: int = WIDTH, **options) -> DataFrame:
    """docs without the hit words (``remove="spans"``) or without documents that have any (``"documents"``).

    A removed word goes with the characters between it and the word before it; texts without
    hits stay as they are.
    """
    if remove not in ("spans", "documents"):
        raise ValueError(f"unknown remove {remove!r}")
    found = hits_by_text(docs, benchmark, width, **options).filter(F.size("hit") > 0)
    found = found.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("hit").alias("__hit"))
    rows = docs.withColumn("__text_key", text_key())
    same = (F.col("__text_key") == F.col("__key")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__id"))
    own = [F.col(f"`{c}`") for c in docs.columns]
    if remove == "documents":
        return rows.join(found, same, "left_anti").select(*own)
    gap = RAW_WORD.replace("[^", "[").replace("]+", "]*")
    rows = rows.join(found, same, "left").withColumn("__pieces", F.when(F.col("__hit").isNotNull(), F.regexp_extract_all("text", F.lit(gap + RAW_WORD), F.lit(0))))
    kept = F.array_except(F.sequence(F.lit(0), F.size("__pieces") - 1), F.col("__hit"))
    rest = F.length("text") - F.length(F.array_join("__pieces", ""))
    cut = F.concat(F.array_join(F.transform(kept, lambda i: F.get("__pieces", i)), ""), F.when(rest > 0, F.right(F.col("text"), rest)).otherwise(""))
    text = F.when(F.col("__hit").isNull(), F.col("text")).otherwise(cut)
    return rows.withColumn("__cut", text).select(*[F.col("__cut").alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])

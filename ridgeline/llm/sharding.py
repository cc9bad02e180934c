"""Sharding by a two-pass external shuffle.

Pass 1 scatters the records into buckets of about ``bucket_bytes`` by a seeded
hash of doc_id and text, which is Spark's shuffle.  Pass 2 reads one bucket at a
time, permutes it by a seeded Fisher-Yates shuffle and writes it.  The buckets'
row counts give every bucket its place in the whole order; shard k of n takes the
places from ceil(k * rows / n) on, so row counts are at most one apart (law
``rows``) and slots have no gaps.

Copies with different ids scatter; rows that are wholly equal share a bucket and
are interchangeable: a bucket that outgrows ``4 * bucket_bytes`` by them is
permuted in blocks of that size, so memory stays bounded and no row is lost.
Null texts have size 1 and the crc32 of nothing, null ids are hashed as such; an
empty table gives an empty table.  Input columns named shard or slot are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.session import scratch_path

BUCKET_BYTES = 32_000_000
#: Offsets of up to so many buckets (16 bytes each) are broadcast, of more joined.
BROADCAST_BUCKETS = 100_000


def shard(docs: DataFrame, n_shards: int = 8, seed: int = 11, bucket_bytes: int = BUCKET_BYTES, path: str | None = None) -> DataFrame:
    """Write docs as ``shard=k`` folders below path (by default in the shared folder) and read them.

    Returns docs' columns, shard (int) and slot (long, from 0 in each shard).
    """
    spark = docs.sparkSession
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("shard", "slot")])
    path = path or scratch_path(spark, "shards")
    n_rows, n_bytes = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).first()
    n_buckets = max(1, -(-n_bytes // bucket_bytes))
    hashed = F.xxhash64(F.lit(seed), "doc_id", "text")
    bucket = F.pmod(hashed, F.lit(n_buckets)).alias("__bucket")
    counts = docs.groupBy(bucket).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__offset"))
    if n_buckets <= BROADCAST_BUCKETS:
        offsets = F.broadcast(offsets)
    scattered = (
        docs.withColumn("__bucket", bucket).join(offsets, "__bucket")
        .repartition(n_buckets, "__bucket").withColumn("__order", F.xxhash64(F.lit(seed + 1), "doc_id", "text"))
        .sortWithinPartitions("__bucket", "__order", "doc_id", "text")
    )
    schema = T.StructType([*docs.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])

    def permute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held: list[pa.RecordBatch] = []
        now, done, offset, size = None, 0, 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, done, size
            if not held:
                return
            rows = pa.Table.from_batches(held)
            order = np.random.default_rng([seed, now, done]).permutation(rows.num_rows)
            place = offset + done + np.arange(rows.num_rows)
            to = place * n_shards // n_rows
            done, held, size = done + rows.num_rows, [], 0
            rows = rows.drop_columns(["__bucket", "__offset", "__order"]).take(pa.array(order))
            rows = rows.append_column("shard", pa.array(to, pa.int32())).append_column("slot", pa.array(place - -(-to * n_rows // n_shards)))
            yield from rows.to_batches(max_chunksize=2000)

        for batch in batches:
            buckets = batch.column(batch.schema.names.index("__bucket")).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(buckets)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if now != (k := int(buckets[a])):
                    yield from flush()
                    now, done = k, 0
                    offset = batch.column(batch.schema.names.index("__offset"))[a].as_py()
                held.append(part := batch.slice(a, b - a))
                if (size := size + part.get_total_buffer_size() * (b - a) // len(buckets)) > 4 * bucket_bytes:
                    yield from flush()
        yield from flush()

    scattered.mapInArrow(permute, schema).write.partitionBy("shard").parquet(path)
    fields = [f for f in schema.fields if f.name != "shard"] + [T.StructField("shard", T.IntegerType())]
    return spark.read.schema(T.StructType(fields)).parquet(path)

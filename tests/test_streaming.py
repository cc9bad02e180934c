"""A fitted model scores a stream with the same expressions as a batch table."""

import ridgeline as rl
from ridgeline.plans.result import LinearModel
from ridgeline.streaming import score_stream
from ridgeline.workload.fixtures import LOG_SIG

from conftest import SF001


def test_score_stream_matches_batch(spark, tmp_path):
    batch = spark.read.parquet(f"{SF001}/lineitem.parquet")
    model = LinearModel("logistic", ("qty", "bias"), (4.9, -2.3))
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "lineitem.parquet").parquet(SF001)
    scored = score_stream(stream, lambda df: LOG_SIG.design(df, keep=("l_orderkey",)), model, keep=("l_orderkey",))
    q = (
        scored.writeStream.format("memory").queryName("scored_lineitem").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "ckpt")).start()
    )
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = spark.table("scored_lineitem").groupBy().sum("prediction").first()[0]
    want = rl.predict(LOG_SIG.design(batch), model).groupBy().sum("prediction").first()[0]
    assert got == want

from datetime import datetime, timedelta

from seqspark.operators import replay
from seqspark.plans.queries import ADAPTIVE
from seqspark.streaming.allocator import allocate_stream
from tests.conftest import rows

KIND = "sequence_key string, ts timestamp, tie long"


def test_a_restart_goes_on_behind_the_state(spark, tmp_path):
    start = datetime(2024, 1, 1)
    data = [(k, start + timedelta(hours=5 * i), i) for i in range(30) for k in ("a", "b")]
    source, out, state = (f"file://{tmp_path}/{x}" for x in ("in", "out", "state"))
    for lo in (0, 20, 40):
        spark.createDataFrame(data[lo : lo + 20], KIND).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(KIND).parquet(source)
        run = allocate_stream(stream, ADAPTIVE).writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
        run.awaitTermination()
    got = rows(spark.read.parquet(out).select("sequence_key", "tie", "id", "watermark"))
    want = rows(replay.replay(spark.createDataFrame(data, KIND), ADAPTIVE).select("sequence_key", "tie", "id", "watermark"))
    assert got == want

import random

from pyspark.sql import functions as F

from siftstream.operators import clustering as K
from siftstream.streaming import clusters as SC
from siftstream.streaming import streams as T


def test_cluster_stream_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, rng.choice(["x", "y"]), (i + 1) * 600_000, rng.sample("abcdef", 3)) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, category string, ms long, keywords array<string>")
    for k in range(3):
        df.where((F.col("id") >= 40 * k) & (F.col("id") < 40 * k + 40)).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    T.written_stream(SC.cluster_stream(src), f"{tmp_path}/out", f"{tmp_path}/cp")
    got = {r.id: r.leader for r in spark.read.schema(SC.OUT).parquet(f"{tmp_path}/out").collect()}
    assert got == {r.id: r.leader for r in K.greedy_clusters(df).collect()}


def test_batches_sessions_and_late(spark, tmp_path):
    df = spark.sql("SELECT id, timestamp'2024-05-02 00:00:00' + make_dt_interval(0, 0, CAST(id * 10 AS INT)) t, CAST(id % 2 AS STRING) k FROM range(30)")
    df.write.parquet(f"{tmp_path}/in")
    src = T.file_stream(spark, f"{tmp_path}/in", df.schema)
    seen = []
    T.run_batches(src, f"{tmp_path}/cp", lambda b, n: seen.append(b.count())).awaitTermination()
    assert sum(seen) == 30
    T.written_stream(T.sessions(src, "t", ["k"], late="1 minute"), f"{tmp_path}/s", f"{tmp_path}/cp2")
    fresh, late = T.on_time_and_late(df, "t", F.lit("2024-05-02 05:00:00").cast("timestamp"))
    assert fresh.count() + late.count() == 30 and late.count() == 7
    sent = df.where("id < 10").select("id")
    assert T.deliver_unsent(df, sent, "id").count() == 20

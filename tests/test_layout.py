"""Tables laid out so that work is not moved: buckets, days, files of a size."""

from pyspark.sql import functions as F

from siftstream.operators import dedup as D
from siftstream.operators import state as Z


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        state = spark.range(1000).select("id", F.col("id").cast("double").alias("v"), F.lit("old").alias("t"))
        batch = spark.range(500, 1500).select("id", (F.col("id") * 2.0).alias("v"), F.lit("new").alias("t"))
        a = Z.saved_in_buckets(state, "layout_state", f"{tmp_path}/a", "id", 4)
        b = Z.saved_in_buckets(batch, "layout_batch", f"{tmp_path}/b", "id", 4)
        for out in (Z.upsert(a, b, "id", ["v"]), Z.patched(a, b, "id"), Z.insert_absent(a, b, "id"), D.unseen(b, a, "id")):
            assert "Exchange" not in plan(out)
        assert "Exchange" in plan(Z.upsert(state, batch, "id", ["v"]))
        want = sorted(map(tuple, Z.upsert(state, batch, "id", ["v"]).collect()))
        assert sorted(map(tuple, Z.upsert(a, b, "id", ["v"]).collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE IF EXISTS layout_state")
        spark.sql("DROP TABLE IF EXISTS layout_batch")


def test_retention_reads_only_its_days(spark, tmp_path):
    df = spark.range(240).select("id", (F.lit("2024-05-01 00:00:00").cast("timestamp") + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("at"))
    kept = Z.saved_by_day(df, f"{tmp_path}/days", "at")
    since = F.lit("2024-05-08 12:00:00").cast("timestamp")
    out = Z.retained(kept, "at", since, F.col("id") % 2 == 0, F.lit("2024-05-09 00:00:00").cast("timestamp"))
    assert sorted(r.id for r in out.collect()) == [i for i in range(180, 240) if i % 2 or i >= 192]
    assert "PartitionFilters: [isnotnull(day" in plan(out) and out.select("id", "at").rdd.getNumPartitions() <= 3


def test_compaction_by_size(spark, tmp_path):
    spark.range(20_000).repartition(40).write.parquet(f"{tmp_path}/many")
    many = spark.read.parquet(f"{tmp_path}/many")
    assert Z.compacted(many, f"{tmp_path}/few") == 1 and len(list((tmp_path / "few").glob("part-*"))) == 1
    n = Z.compacted(many, f"{tmp_path}/some", 50_000)
    assert 1 < n < 40 and len(list((tmp_path / "some").glob("part-*"))) == n
    assert spark.read.parquet(f"{tmp_path}/some").count() == 20_000

"""Tables that change, as functions from state and batch to new state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def upsert(state: DataFrame, batch: DataFrame, key: str, refreshed: list[str]) -> DataFrame:
    """Rows of both; where a key is in both, the refreshed columns are the batch's and the others the state's."""
    cols = state.columns
    b = batch.select(*[F.col(c).alias(f"_b_{c}") for c in cols])
    both = state.join(b, state[key] == b[f"_b_{key}"], "full")
    there = F.col(key).isNotNull()
    value = lambda c: F.coalesce(F.col(f"_b_{c}"), F.col(c)) if c in refreshed else F.when(there, F.col(c)).otherwise(F.col(f"_b_{c}"))
    return both.select(*[value(c).alias(c) for c in cols])


def patched(state: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """State with the patch's columns where they are set; the key and other columns stay."""
    p = patch.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_p_{c}") for c in patch.columns if c != key])
    both = state.join(p, state[key] == F.col("_k"), "left")
    return both.select(*[F.coalesce(F.col(f"_p_{c}"), F.col(c)).alias(c) if f"_p_{c}" in p.columns else F.col(c) for c in state.columns])


def insert_absent(state: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """State and those rows whose key it does not hold."""
    return state.unionByName(rows.join(state.select(key), key, "left_anti").select(*state.columns))


def pruned(state: DataFrame, *gone: Column) -> DataFrame:
    """State without rows that meet a condition; a condition that is null keeps the row."""
    return state.where(~F.coalesce(reduce(lambda a, b: a | b, gone), F.lit(False)))


def append_audit(log: DataFrame, events: DataFrame) -> DataFrame:
    """An append-only log; missing columns are null."""
    return log.unionByName(events, allowMissingColumns=True)


#: Bytes of a file that compaction aims at.
FILE_BYTES = 128 << 20


def compacted(df: DataFrame, path: str, file_bytes: int = FILE_BYTES, day: str | None = None) -> int:
    """Rewrites a table of files under a new path in files of about file_bytes, and returns how many it asked for: as many as
    the bytes that the table's files have. day: a column that the table is partitioned by."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    files = max(1, -(-size // file_bytes))
    out = df.repartition(files, day) if day and files > 1 else df.repartition(files)
    writer = out.write.mode("overwrite")
    (writer.partitionBy(day) if day else writer).parquet(path)
    return files


def saved_in_buckets(df: DataFrame, name: str, path: str, key: str, buckets: int) -> DataFrame:
    """df as a table of files bucketed and sorted by a key. Two such tables with as many buckets join on the key, and the rows
    of one upsert, patch or insert into the other, without a shuffle of either."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def saved_by_day(df: DataFrame, path: str, time: str) -> DataFrame:
    """df as files in a folder for each day of a time column, with the day as a column; rows of a day are written together."""
    spark = df.sparkSession
    df.withColumn("day", F.to_date(time)).repartition("day").sortWithinPartitions(time).write.mode("overwrite").partitionBy("day").parquet(path)
    return spark.read.parquet(path)


def retained(by_day: DataFrame, time: str, since: Column, done: Column | None = None, done_since: Column | None = None) -> DataFrame:
    """Rows of a table kept by day (see ``saved_by_day``) that retention leaves: none before since, none before done_since that
    are done. Folders of days before the first cut are not read."""
    out = by_day.where((F.col("day") >= F.to_date(since)) & (F.col(time) >= since))
    return out if done is None else pruned(out, done & (F.col(time) < done_since))

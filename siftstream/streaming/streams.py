"""Incremental forms: file streams with watermarks, whose checkpoint is the cursor."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 16) -> DataFrame:
    """New Parquet files under a path; a time without zone becomes one that watermarks accept."""
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    for f in df.schema.fields:
        if f.dataType.simpleString() == "timestamp_ntz":
            df = df.withColumn(f.name, F.col(f.name).cast("timestamp"))
    return df


def counts_per_window(df: DataFrame, time: str, keys: list[str], width: str = "1 hour", late: str = "4 hours", slide: str | None = None) -> DataFrame:
    """Rows of each window and key; a window closes when the watermark passes it."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return df.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


def sessions(df: DataFrame, time: str, keys: list[str], gap: str = "30 minutes", late: str = "4 hours") -> DataFrame:
    """Rows of each session of a key."""
    return df.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "n")


def first_within(df: DataFrame, time: str, keys: list[str], window: str = "24 hours") -> DataFrame:
    """The first row of each key; the key is forgotten once the watermark is a window past that row. So a key may be held
    somewhat longer than the batch fold holds it, never shorter."""
    return df.withWatermark(time, window).dropDuplicatesWithinWatermark(keys)


def notable(df: DataFrame, score: str, least: float = 5.0) -> DataFrame:
    """Rows worth pushing."""
    return df.where(F.coalesce(F.col(score), F.lit(0.0)) >= least)


def on_time_and_late(df: DataFrame, time: str, as_of: Column, hours: int = 4) -> tuple[DataFrame, DataFrame]:
    """Rows that are still clustered, and those that come too late for it."""
    fresh = F.col(time) > as_of - F.make_dt_interval(hours=F.lit(hours))
    return df.where(fresh), df.where(~F.coalesce(fresh, F.lit(False)))


def run_batches(df: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append", every: str | None = None) -> StreamingQuery:
    """Starts a query that hands each batch to a function: all that is there now, or at intervals."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def deliver_unsent(posts: DataFrame, sent: DataFrame, key: str = "post_id") -> DataFrame:
    """Posts that no delivery record names yet: an idempotent sink writes their records after sending."""
    return posts.join(sent.select(key), key, "left_anti")


def delivered(posts: DataFrame, receipts: DataFrame, as_of: Column) -> DataFrame:
    """Posts after a delivery: those not sent before whose cluster's receipt names a message are stamped with it and the
    time; without one they stay unsent and are tried again. receipts: cluster_id (unique), message_id."""
    r = receipts.where("coalesce(message_id, '') <> ''").select(F.col("cluster_id").alias("_c"), F.col("message_id").alias("_m"))
    both = posts.join(r, posts["cluster_id"] == F.col("_c"), "left")
    now_sent = F.col("sent_at").isNull() & F.col("_m").isNotNull()
    new = {"message_id": F.when(now_sent, F.col("_m")).otherwise(F.col("message_id")), "sent_at": F.when(now_sent, as_of).otherwise(F.col("sent_at"))}
    return both.select(*[new[c].alias(c) if c in new else F.col(c) for c in posts.columns])


def message(df: DataFrame, key: str, headline: str, score: str, least: float = 5.0) -> DataFrame:
    """One row: the server-sent message that tells of new rows (their number and the three best), or a heartbeat if none is
    worth telling. Three rows are gathered, whatever the batch holds."""
    new = notable(df, score, least).select(F.col(key).alias("id"), F.col(headline).alias("headline"), F.col(score).alias("score"))
    three = new.select(F.struct((-F.col("score")).alias("by"), "id", "headline", "score").alias("x")).orderBy("x").limit(3).agg(F.array_sort(F.collect_list("x")).alias("best"))
    best = F.transform("best", lambda x: F.struct(x["id"].alias("id"), x["headline"].alias("headline"), x["score"].alias("score")))
    top = lambda field: F.try_element_at(F.col("best"), F.lit(1))[field]
    body = F.to_json(F.struct(F.lit("new_clusters").alias("type"), F.col("n").alias("count"), top("score").alias("topScore"), top("headline").alias("topHeadline"), best.alias("clusters")))
    return new.agg(F.count(F.lit(1)).alias("n")).crossJoin(three).select(F.when(F.col("n") > 0, F.concat(F.lit("data: "), body, F.lit("\n\n"))).otherwise(": ping\n\n").alias("message"))


def push(df: DataFrame, checkpoint: str, send: Callable[[str], None], key: str, headline: str, score: str, least: float = 5.0, every: str | None = "15 seconds") -> StreamingQuery:
    """Sends a message for each batch of new rows. A failing batch is told as an error and ends the query before its checkpoint
    moves, so a later start sends its rows. Batches without rows send nothing by themselves: ``heartbeat`` is for those."""

    def each(batch: DataFrame, n: int) -> None:
        try:
            text = message(batch, key, headline, score, least).first()["message"]
        except Exception:
            send(": error\n\n")
            raise
        send(text)

    return run_batches(df, checkpoint, each, every=every)


def heartbeat(send: Callable[[str], None]):
    """A listener that sends a ping whenever a trigger found no data; add it by ``spark.streams.addListener``."""
    from pyspark.sql.streaming import StreamingQueryListener

    class Heartbeat(StreamingQueryListener):
        def onQueryStarted(self, event):
            send(": heartbeat\n\n")

        def onQueryProgress(self, event):
            if event.progress.numInputRows == 0:
                send(": ping\n\n")

        def onQueryIdle(self, event):
            send(": ping\n\n")

        def onQueryTerminated(self, event):
            pass

    return Heartbeat()


def stop_all(spark: SparkSession, within_s: float = 30) -> list[str]:
    """Ends all queries: each may finish the batch it is in, within the time in all; the names of those that were stopped.
    Their checkpoints say where a later start goes on."""
    import time

    end, names = time.monotonic() + within_s, []
    for query in spark.streams.active:
        while query.isActive and query.status.get("isTriggerActive") and time.monotonic() < end:
            time.sleep(0.05)
        query.stop()
        names.append(query.name or str(query.id))
    return names


def written_stream(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a query over all that is there now and appends its rows to a Parquet table."""
    df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).option("path", path).format("parquet").trigger(availableNow=True).start().awaitTermination()

"""Queries that run a stream over the tables to its end and return what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..shared import folder
from ..streaming import kept as K
from ..streaming import outbox as O
from ..streaming import streams as T
from .table_queries import EVENTS_SQL, _fold_sql

def _events(spark, d):
    # a pattern, as a stream's plain path has to be a folder and the table may be one file
    return T.file_stream(spark, f"{d}/events.parque[t]", spark.read.parquet(f"{d}/events.parquet").schema)


def _finished(spark, df, mode="append"):
    at = folder(spark, "stream")
    schema = df.schema
    T.written_stream(df, f"{at}/out", f"{at}/checkpoint", mode)
    return spark.read.schema(schema).parquet(f"{at}/out")


def _notable(spark, d):
    return _finished(spark, T.notable(_events(spark, d), "value", 95).select("event_id", "event_type", "value"))


def _first(spark, d):
    """A bounded table is one arrival: the first of each key in it. Expiry needs batches in time, see the tests."""
    return _finished(spark, T.first_within(_events(spark, d), "ts", ["user_id", "event_type"], "24 hours").select("user_id", "event_type"))


def _hourly(spark, d):
    """Windows that the watermark has closed: all that end four hours before the last event or earlier."""
    out = _finished(spark, T.counts_per_window(_events(spark, d), "ts", ["event_type"]))
    return out.select(F.unix_millis("window_start").alias("hour_ms"), "event_type", "n")


def _kept(spark, d):
    """Events that stay when a user's kind of event is forgotten a day after it was kept, by state with timers."""
    e = _events(spark, d).select(F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("k"), F.unix_millis("ts").alias("ms"), F.col("event_id").alias("id"))
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    try:
        out = _finished(spark, K.kept_stream(e, 86_400_000))
    finally:
        # other streams of the session keep the store that they had
        spark.conf.set(store, before)
    part = F.split("k", "[|]")
    return out.select(part[0].cast("long").alias("user_id"), part[1].alias("event_type"), "ms", F.col("id").alias("event_id"))


def _outbox(spark, d):
    """High events through the sink that delivers once; the cursor is that of the last commit."""
    spark.dataSource.register(O.Outbox)
    box = folder(spark, "outbox")
    rows = T.notable(_events(spark, d), "value", 95).select("event_id", "event_type", F.unix_millis("ts").alias("ms"))
    rows.writeStream.format("outbox").option("cursor", "ms").option("checkpointLocation", f"{box}/checkpoint").option("path", box).trigger(availableNow=True).start().awaitTermination()
    return O.delivered_rows(spark, box, rows.schema).withColumn("cursor", F.lit(O.cursor(box)).cast("long"))


QUERIES = {
    "stream_kept_24h": (_kept, _fold_sql(f"{EVENTS_SQL}, src AS (SELECT user_id, event_type, event_id AS i, ms FROM e)", "user_id, event_type", 86_400_000, "user_id, event_type, ms, i AS event_id")),
    "stream_outbox": (_outbox, f"WITH {EVENTS_SQL} SELECT event_id, event_type, ms, (SELECT max(ms) FROM e WHERE value >= 95) AS cursor FROM e WHERE value >= 95"),
    "stream_notable": (_notable, "SELECT event_id, event_type, value FROM events WHERE value >= 95"),
    "stream_first_within": (_first, "SELECT user_id, event_type FROM events GROUP BY user_id, event_type"),
    "stream_hourly_closed": (_hourly, """SELECT epoch_ms(date_trunc('hour', ts)) AS hour_ms, event_type, count(*) AS n FROM events
        GROUP BY 1, 2 HAVING epoch_ms(date_trunc('hour', ts)) + 3600000 <= (SELECT epoch_us(max(ts)) // 1000 - 4 * 3600000 FROM events)"""),
}

"""State that forgets a key some time after its last kept row: titles for a day, nonces for six minutes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor


def with_state(spark: SparkSession) -> SparkSession:
    """The state store that timers and state variables need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


class Kept(StatefulProcessor):
    """A key's last kept time, and a timer that clears it once the watermark is gap_ms past it."""

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        pdf = pd.concat(list(rows)).sort_values(["ms", "id"], kind="stable")
        last = (self.last.get() or (None,))[0]
        kept, before = [], last
        for n, ms in enumerate(pdf["ms"].tolist()):
            if last is None or ms >= last + self.gap_ms:
                last = ms
                kept.append(n)
        if last != before:
            if before is not None:
                self.handle.deleteTimer(before + self.gap_ms)
            self.handle.registerTimer(last + self.gap_ms)
            self.last.update((last,))
        if kept:
            yield pdf.iloc[kept][["k", "ms", "id"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.last.clear()
        # a generator without frames: each one would cost a batch of its own
        yield from ()

    def close(self) -> None:
        pass


def kept_stream(rows: DataFrame, gap_ms: int, late: str = "1 hour") -> DataFrame:
    """(k, ms, id) of the rows that stay when each key k forgets a row gap_ms after it was kept: ``dedup.window_dedup`` as a
    stream, equal to it if batches come in time order. rows: k (a string), ms, id. Rows later than the watermark are dropped;
    a key's state is one time, which a timer clears when the watermark has passed it, so silent keys cost nothing."""
    with_state(rows.sparkSession)
    timed = rows.select("k", "ms", "id", F.timestamp_millis("ms").alias("_ts")).withWatermark("_ts", late)
    return timed.groupBy("k").transformWithStateInPandas(Kept(gap_ms), "k string, ms long, id long", "append", "eventTime")

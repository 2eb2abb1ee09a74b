"""What a loop over ordered rows keeps, if a kept row shuts out later ones: found in rounds instead of one by one."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..shared import written

#: A width that shuts out for ever.
EVER = 1 << 61


def first_independent(rows: DataFrame) -> DataFrame:
    """(id, k, ms, w, slot) of the kept rows. rows: id, ms and, a row for each, the keys k of an item with their width w.

    Items are taken by (ms, id); one is kept unless it shares a key with a kept item at most that key's w before it. That is
    the lexicographically first maximal independent set of the graph of such pairs, which is never built: a key's time is cut
    in slots of w, so that what may shut an item out is its own slot's first open item or the slot before's last one. In each
    round an item with no open item before it within reach is kept, and what it shuts out is closed; rounds end when no item
    is open. Each round is aggregates by key and slot (combined before their shuffle) and joins with one row a slot, over what
    is still open. There are as many rounds as the longest chain of items that wait for each other: a few for the items of a
    window, and about one for each width of time along an unbroken stretch of one key.
    """
    rows = rows.withColumn("slot", F.floor(F.col("ms") / F.col("w")))
    open_ = written(rows.where("id IS NOT NULL AND ms IS NOT NULL AND k IS NOT NULL"), "open")
    kept = []
    while not open_.isEmpty():
        ends = open_.groupBy("k", "w", "slot").agg(F.min(F.struct("ms", "id")).alias("lo"), F.max("ms").alias("hi"))
        before = ends.select("k", "w", (F.col("slot") + 1).alias("slot"), F.col("hi").alias("last"))
        waits = (F.struct("ms", "id") > F.col("lo")) | F.coalesce(F.col("last") >= F.col("ms") - F.col("w"), F.lit(False))
        free = open_.join(ends.drop("hi"), ["k", "w", "slot"]).join(before, ["k", "w", "slot"], "left").groupBy("id").agg(F.bool_or(waits).alias("waits")).where("NOT waits").select("id")
        kept.append(written(open_.join(free, "id", "left_semi"), "kept"))
        gone = shut_out(open_, kept[-1]).select("id").unionByName(kept[-1].select("id")).distinct()
        open_ = written(open_.join(gone, "id", "left_anti"), "open")
    out = open_
    for k in kept:
        out = out.unionByName(k.select(*out.columns))
    return out


def shut_out(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows (id, k, w, slot, ms) beside the kept items before them that share a key within reach (by, by_ms). A key has at
    most two kept items a slot, as kept ones do not share it within reach."""
    reach = kept.select("k", "w", F.explode(F.array("slot", F.col("slot") + 1)).alias("slot"), F.col("id").alias("by"), F.col("ms").alias("by_ms"))
    earlier = F.struct(F.col("by_ms").alias("ms"), F.col("by").alias("id")) < F.struct("ms", "id")
    return rows.join(reach, ["k", "w", "slot"]).where(earlier & (F.col("ms") - F.col("by_ms") <= F.col("w")))

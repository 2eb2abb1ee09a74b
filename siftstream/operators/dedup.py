"""Duplicates by URL and by title within a window."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..shared import written
from .independent import EVER, first_independent


def first_of_each(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def unseen(df: DataFrame, history: DataFrame, key: str) -> DataFrame:
    """Rows whose key history does not hold."""
    return df.join(history.select(key).distinct(), key, "left_anti")


#: Rows of a key that are folded in one row of an aggregate; keys with more are followed by doubling.
FOLD_ROWS = 1000


def window_dedup(df: DataFrame, keys: list[str], time_ms: str, row_id: str, gap_ms: int, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """(keys, time_ms, row_id) of the rows that stay when each key forgets a row gap_ms after it was kept.

    Rows are taken by (time, id); a row stays if no row of its key was kept less than gap_ms before. Rows without a time stay.
    Keys of up to fold_rows rows are folded in the JVM, over arrays of that size at most; the others by ``_chains``. Both give
    the same rows; which keys have many is a narrow aggregate.
    """
    rows = written(df.select(*keys, F.col(time_ms).alias("_t"), F.col(row_id).alias("_i")), "rows")
    dense = written(rows.where("_t IS NOT NULL").groupBy(*keys).count().where(F.col("count") > fold_rows).select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)]), "dense")
    out = rows
    if not dense.isEmpty():
        on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(keys)]) & F.col("_t").isNotNull()
        out = rows.join(dense, on, "left_anti")
    out = _folded(out, keys, gap_ms)
    if not dense.isEmpty():
        out = out.unionByName(_chains(rows.join(dense, on, "left_semi"), keys, gap_ms))
    return out.select(*keys, F.col("_t").alias(time_ms), F.col("_i").alias(row_id))


def _folded(rows: DataFrame, keys: list[str], gap_ms: int) -> DataFrame:
    """The rows that stay, by a fold over each key's rows. A row that follows nothing of its key for gap_ms stays in any case,
    so a key is cut there."""
    order = Window.partitionBy(*keys).orderBy("_t", "_i")
    begins = F.coalesce((F.col("_t") - F.lag("_t").over(order) >= gap_ms).cast("long"), F.lit(1))
    cut = rows.withColumn("_b", begins).withColumn("_s", F.sum("_b").over(order))
    fold = F.aggregate(
        F.slice(F.col("r"), F.lit(2), F.greatest(F.size("r") - 1, F.lit(0))), F.slice(F.col("r"), 1, 1),
        lambda kept, x: F.when(x["_t"] >= F.element_at(kept, -1)["_t"] + F.lit(gap_ms), F.concat(kept, F.array(x))).otherwise(kept))
    lists = cut.groupBy(*keys, "_s").agg(F.array_sort(F.collect_list(F.struct("_t", "_i"))).alias("r"))
    return lists.select(*keys, F.explode(fold).alias("x")).select(*keys, "x._t", "x._i")


def _chains(rows: DataFrame, keys: list[str], gap_ms: int) -> DataFrame:
    """The rows that stay, by pointer doubling: each time of a key points to its first time at least gap_ms later; the times
    that a key's first one leads to stay, with their smallest id. Pointers are found among the rows of one key and slot of
    gap_ms, so no task needs more of a key together; after n rounds the first 2**n rows that stay are found."""
    key = F.struct(*keys).alias("k")
    nodes = written(rows.groupBy(key, "_t").agg(F.min("_i").alias("_i")), "times")
    slot = lambda c: F.floor(c / gap_ms).alias("s")
    asked = F.col("_t") + gap_ms
    marks = nodes.select("k", slot(F.col("_t")), F.col("_t").alias("at"), F.col("_t").alias("node"), F.lit(None).cast("long").alias("of"))
    marks = written(marks.unionByName(nodes.select("k", slot(asked), asked.alias("at"), F.lit(None).cast("long").alias("node"), F.col("_t").alias("of"))), "marks")
    # backwards in time, the last node that was passed is the next one; nodes come before what asks at the same time
    back = Window.partitionBy("k", "s").orderBy(F.desc("at"), F.col("node").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    inside = marks.withColumn("next", F.last("node", ignorenulls=True).over(back)).where("of IS NOT NULL")
    # a row for each slot of a key: the first node of the slots behind it
    later = Window.partitionBy("k").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, -1)
    behind = marks.groupBy("k", "s").agg(F.min("node").alias("first")).withColumn("behind", F.last("first", ignorenulls=True).over(later)).select("k", "s", "behind")
    pointers = inside.join(behind, ["k", "s"]).select("k", F.col("of").alias("t"), F.coalesce("next", "behind").alias("next")).where("next IS NOT NULL")
    pointers, reached = written(pointers, "pointers"), written(nodes.groupBy("k").agg(F.min("_t").alias("t")), "reached")
    while not pointers.isEmpty():
        reached = written(reached.unionByName(reached.join(pointers, ["k", "t"]).select("k", F.col("next").alias("t"))), "reached")
        ahead = pointers.select("k", F.col("t").alias("next"), F.col("next").alias("far"))
        pointers = written(pointers.join(ahead, ["k", "next"]).select("k", "t", F.col("far").alias("next")), "pointers")
    stay = nodes.join(reached.withColumnRenamed("t", "_t"), ["k", "_t"])
    return stay.select(*[F.col("k")[c].alias(c) for c in keys], "_t", "_i")


def admitted(items: DataFrame, history: DataFrame | None = None, window_ms: int = 86_400_000) -> DataFrame:
    """The items that a run inserts: by (ms, id), one whose URL no stored or inserted item has, and whose title none has that
    was stored less than window_ms before. An item that is refused claims neither its URL nor its title.

    items: id (unique), ms (when it comes in), url_hash, title_hash; history: url_hash, title_hash, ms. An item without a hash
    is not refused by it.
    """
    fresh = items
    if history is not None:
        seen = history.groupBy(F.col("title_hash").alias("_h")).agg(F.max("ms").alias("_ms"))
        recent = (F.col("title_hash") == F.col("_h")) & (F.col("ms") - F.col("_ms") < window_ms)
        fresh = unseen(items.where("url_hash IS NOT NULL"), history, "url_hash").unionByName(items.where("url_hash IS NULL").select("url_hash", *[c for c in items.columns if c != "url_hash"])).select(*items.columns)
        fresh = fresh.join(seen, recent, "left_anti")
    claim = lambda kind, col, w: F.struct(F.concat(F.lit(kind), F.col(col).cast("string")).alias("k"), F.lit(w).cast("long").alias("w"))
    rows = fresh.select("id", "ms", F.explode(F.array(claim("u", "url_hash", EVER), claim("t", "title_hash", window_ms - 1))).alias("c")).select("id", "ms", "c.*")
    # without a hash of either kind nothing can refuse an item
    kept = first_independent(rows).select("id").unionByName(fresh.where("url_hash IS NULL AND title_hash IS NULL").select("id")).distinct()
    return items.join(kept, "id", "left_semi")

"""Events out of items: greedy leaders in each category, then a merge into recent events."""

from __future__ import annotations

import math
from collections import defaultdict
from heapq import heappop, heappush
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans import lexicons as L
from ..shared import written
from .scoring import topics

WINDOW_MS, MERGE_MS, OVERLAP = 4 * 3_600_000, 3_600_000, 2


def pair_overlap(items: DataFrame, window_ms: int = WINDOW_MS, least: int = OVERLAP) -> DataFrame:
    """(a, b, shared): items of one category at most window_ms apart that share at least two keywords; a < b.

    items: id, category, ms, keywords. An equi-join on category, keyword and time slot: each item looks into its own slot
    and the next, so that hot keywords only meet within a window.
    """
    k = items.select("id", "category", "ms", F.floor(F.col("ms") / window_ms).alias("slot"), F.explode(F.array_distinct("keywords")).alias("kw"))
    other = k.select(F.col("id").alias("b"), F.col("category").alias("c2"), F.col("ms").alias("ms2"), F.col("kw").alias("kw2"), F.explode(F.sequence(F.col("slot") - 1, F.col("slot") + 1)).alias("s2"))
    pairs = k.join(other, (k["category"] == other["c2"]) & (k["kw"] == other["kw2"]) & (k["slot"] == other["s2"]) & (k["id"] < other["b"]) & (F.abs(k["ms"] - other["ms2"]) <= window_ms))
    return pairs.groupBy(F.col("id").alias("a"), "b").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least)


def _combinations(words, n: int):
    """All n members of a set of words together, in one order."""
    return combinations(sorted(words, key=lambda w: (w is None, w or "")), n)


def _led(items, before, window_ms: int, least: int) -> tuple[list[tuple], list[tuple]]:
    """(id, category, leader) of a piece's items, one by one, and the leaders (ms, id, keywords) that are open behind it;
    before: those that the pieces before it left open.

    Items that share ``least`` keywords share a combination of so many. Of the leaders with a combination only the last can
    be open: it became one because no open leader had it. So an item is a few lookups, whatever is open.
    """
    last: dict[tuple, tuple] = {}
    for leader in sorted(before, key=lambda x: x[:2]):
        last.update(dict.fromkeys(_combinations(set(leader[2]), least), leader))
    out, ms = [], None
    for ms, id_, words, category in sorted(zip(*[items[c].to_pylist() for c in ("ms", "id", "keywords", "category")]), key=lambda r: r[:2]):
        keys = list(_combinations(set(words), least))
        found = min((x for x in map(last.get, keys) if x is not None and ms - x[0] <= window_ms), key=lambda x: x[:2], default=None)
        if found is None:
            found = (ms, id_, words)
            last.update(dict.fromkeys(keys, found))
        out.append((id_, category, found[1]))
    return out, sorted({x[:2]: x for x in last.values() if ms - x[0] <= window_ms}.values(), key=lambda x: x[:2])


OPEN = "array<struct<ms:long,id:long,keywords:array<string>>>"


def _before(carried) -> list[tuple]:
    return [(x["ms"], x["id"], x["keywords"]) for row in carried["open"].to_pylist() for x in row or ()]


def _leaders_by_pieces(rows: DataFrame, window_ms: int, least: int, pieces: int) -> DataFrame:
    """Leaders of each category's items, which are cut in pieces along (category, time, id).

    A piece needs the leaders that the pieces before it left open. In the first round each is folded as if there were none; in
    each further round those whose predecessor ended otherwise than they took it to are folded again, so that what is left is
    what one fold over the category gives. The first n pieces are right after n rounds at the latest; in general what is open
    soon no longer depends on what was open long before, and the second round changes nothing.
    """
    import pyarrow as pa

    def ends(key, items, carried):
        open_ = [dict(zip(("ms", "id", "keywords"), x)) for x in _led(items, _before(carried), window_ms, least)[1]]
        kind = pa.list_(pa.struct([("ms", pa.int64()), ("id", pa.int64()), ("keywords", pa.list_(pa.string()))]))
        return pa.table({"g": pa.array([key[0].as_py()], pa.string()), "piece": pa.array([key[1].as_py()], pa.int32()), "open": pa.array([open_], kind)})

    def led(key, items, carried):
        out = _led(items, _before(carried), window_ms, least)[0]
        return pa.table({n: pa.array([r[i] for r in out], t) for i, (n, t) in enumerate([("id", pa.int64()), ("category", pa.string()), ("leader", pa.int64())])})

    def folded(items, carried, how, schema):
        return items.groupBy("g", "piece").cogroup(carried.groupBy("g", "piece")).applyInArrow(how, schema)

    g = F.coalesce(F.concat(F.lit("="), "category"), F.lit("")).alias("g")
    rows = rows.select(g, "category", "ms", "id", "keywords").repartitionByRange(pieces, "g", "ms", "id")
    rows = written(rows.withColumn("piece", F.spark_partition_id()), "pieces")
    # a row for each piece
    after = F.lead("piece").over(Window.partitionBy("g").orderBy("piece"))
    following = written(rows.select("g", "piece").distinct().withColumn("next", after).where("next IS NOT NULL"), "following")
    none = rows.sparkSession.createDataFrame([], f"g string, piece int, open {OPEN}")
    carried, at, todo = none, none, rows
    while True:
        new = written(folded(todo, carried.join(todo.select("g", "piece").distinct(), ["g", "piece"], "left_semi"), ends, none.schema), "ends")
        at = written(new.unionByName(at.join(new, ["g", "piece"], "left_anti")), "ends")
        took, carried = carried, written(at.join(following, ["g", "piece"]).select("g", F.col("next").alias("piece"), "open"), "carried")
        said = lambda df, name: df.select("g", "piece", F.to_json("open").alias(name))
        other = said(carried, "_new").join(said(took, "_old"), ["g", "piece"], "left").where("_new <> coalesce(_old, '[]')").select("g", "piece")
        if other.isEmpty():
            return folded(rows, carried, led, "id long, category string, leader long")
        todo = rows.join(F.broadcast(other), ["g", "piece"], "left_semi")


def unprocessed_recent(items: DataFrame, as_of: Column, hours: int = 4) -> DataFrame:
    """Items that a run clusters: not processed yet, published in the last hours."""
    return items.where(~F.coalesce(F.col("is_processed").cast("boolean"), F.lit(False)) & (F.col("published_at") > as_of - F.make_dt_interval(hours=F.lit(hours))))


#: Items of a piece, which a task folds one by one.
FOLD_ITEMS = 50_000


def greedy_clusters(items: DataFrame, window_ms: int = WINDOW_MS, least: int = OVERLAP, fold_items: int = FOLD_ITEMS) -> DataFrame:
    """(id, category, leader). By (time, id), an item joins the first leader of its category at most window_ms before that
    shares at least two keywords, or becomes one. Items with fewer keywords or without a time are alone.

    Items are folded in pieces of about fold_items, side by side, in rounds until each piece began with what the one before
    it left open; 0 takes eight pieces at least, however few items there are. The leaders are the same whatever the pieces.
    items: id (unique), category, ms, keywords.
    """
    able = F.coalesce(F.size("keywords") >= least, F.lit(False)) & F.col("ms").isNotNull()
    items = written(items.select("id", "category", "ms", F.array_distinct("keywords").alias("keywords")).withColumn("_able", able), "items")
    out, able = items.where("NOT _able").select("id", "category", F.col("id").alias("leader")), items.where("_able")
    pieces = max(math.ceil(able.count() / (fold_items or FOLD_ITEMS)), 1 if fold_items else 8)
    return out.unionByName(_leaders_by_pieces(able, window_ms, least, pieces))


def summaries(items: DataFrame, geo: dict = L.GEO_TAGS, tags: dict = L.TOPIC_TAGS) -> DataFrame:
    """A row per cluster (leader): the headline of the best item, largest score and risk, reasons, ids, summaries, keywords,
    topics. What is gathered in a row is one cluster's items.

    items: leader, id, ms, category, title, summary, score, level, reasons, keywords.
    """
    rank = F.when(F.col("level") == "high", 3).when(F.col("level") == "medium", 2).otherwise(1)
    row = F.struct("ms", "id", "summary", "reasons", "keywords")
    out = items.groupBy("leader", "category").agg(
        F.max_by("title", F.struct(F.col("score"), -F.col("ms"), -F.col("id"))).alias("headline"), F.max("score").alias("score"), F.max(rank).alias("r"),
        F.array_sort(F.collect_list(row)).alias("rows"), F.count(F.lit(1)).alias("source_count"), F.min("ms").alias("first_ms"))
    out = out.select(
        F.col("leader").alias("cluster_id"), "category", "headline", "score", F.when(F.col("r") == 3, "high").when(F.col("r") == 2, "medium").otherwise("low").alias("risk_level"),
        F.array_distinct(F.flatten("rows.reasons")).alias("risk_reasons"), "source_count", F.col("rows.id").alias("item_ids"),
        F.filter("rows.summary", lambda s: s != "").alias("summaries"), F.array_distinct(F.flatten("rows.keywords")).alias("keywords"), "first_ms")
    return out.withColumn("topics", topics(F.col("headline"), F.array_join("summaries", " "), geo, tags))


def _merge(rows, least: int):
    """Where a category's rows go: new clusters in order, each to the first event that shares keywords, or to itself."""
    import pyarrow as pa

    names = ("existing", "first_ms", "cluster_id", "score", "keywords", "headline_keywords", "summary_keywords")
    events: list[dict] = []
    having: dict[tuple, list[int]] = defaultdict(list)
    out = []

    def first(words):
        """The first event with a combination of words: heaps hold all that had it once, those that lost it are dropped."""
        best = None
        for c in _combinations(words, least):
            heap = having.get(c)
            while heap and not events[heap[0]]["words"].issuperset(c):
                heappop(heap)
            if heap and (best is None or heap[0] < best):
                best = heap[0]
        return best

    def has(n, words, before=frozenset()):
        events[n]["words"] = words
        if not words <= before:
            for c in _combinations(words, least):
                if not before.issuperset(c):
                    heappush(having[c], n)

    for old, _, id_, score, words, headline, summary in sorted(zip(*[rows[c].to_pylist() for c in names]), key=lambda r: (not r[0], r[1], r[2])):
        # an event is recognised by the keywords of its present headline and of all its summaries
        n = None if old else first(set(words))
        if n is None:
            events.append({"id": id_, "old": old, "score": score, "headline": frozenset(headline), "summary": frozenset(summary), "n": 0})
            has(len(events) - 1, frozenset(headline) | frozenset(summary))
            out.append((id_, old, id_, old, 0))
            continue
        hit = events[n]
        if score > hit["score"]:
            hit["score"], hit["headline"] = score, frozenset(headline)
        hit["summary"] |= frozenset(summary)
        hit["n"] += 1
        has(n, hit["headline"] | hit["summary"], hit["words"])
        out.append((id_, old, hit["id"], hit["old"], hit["n"]))
    kinds = [("cluster_id", pa.int64()), ("existing", pa.bool_()), ("into", pa.int64()), ("into_existing", pa.bool_()), ("nth", pa.int64())]
    return pa.table({n: pa.array([r[i] for r in out], t) for i, (n, t) in enumerate(kinds)})


EVENT = ["cluster_id", "category", "headline", "score", "risk_level", "risk_reasons", "topics", "first_ms", "last_ms", "item_ids", "summaries"]
PLACED = "cluster_id long, existing boolean, into long, into_existing boolean, nth long"


def merge_recent(events: DataFrame, new: DataFrame, as_of_ms: int, merge_ms: int = MERGE_MS, least: int = OVERLAP, recompute_risk: bool = False) -> DataFrame:
    """Events after new clusters have been merged or added; changed marks rows to write, whose last_ms is now.

    Both have the columns of EVENT (new ones without the times, as theirs is now) and keywords, headline_keywords and
    summary_keywords. A new cluster joins the first event of its category that was first seen less than merge_ms before now
    and shares at least two keywords; events of the same run come after those that were there. Ids and summaries are
    appended; a headline changes only for a larger score; risk, reasons, topics and first time stay as they are
    (recompute_risk raises the risk). cluster_id is unique among events and among new clusters.

    One after the other, a category's clusters are told only where they go, by their words and scores: a row of some words
    for each that comes in merge_ms and in one run and has enough of them. What an event holds is put together by a join.
    """
    recent = F.col("first_ms") > as_of_ms - merge_ms
    words = ["keywords", "headline_keywords", "summary_keywords"]
    now = new.withColumn("first_ms", F.lit(as_of_ms).cast("long")).withColumn("last_ms", F.lit(as_of_ms).cast("long"))
    both = events.where(recent).select(*EVENT, *words, F.lit(True).alias("existing")).unionByName(now.select(*EVENT, *words, F.lit(False).alias("existing")))
    both = written(both, "both")
    # neither taken by an event nor an event that takes: no words of it can be enough
    few = F.lit(least) > F.greatest(F.when(F.col("existing"), 0).otherwise(F.size(F.array_distinct("keywords"))), F.size(F.array_union("headline_keywords", "summary_keywords")))
    narrow = both.select("category", "existing", "first_ms", "cluster_id", "score", *words, F.coalesce(few, F.lit(False)).alias("few"))
    alone = narrow.where("few").select("cluster_id", "existing", F.col("cluster_id").alias("into"), F.col("existing").alias("into_existing"), F.lit(0).cast("long").alias("nth"))
    placed = narrow.where("NOT few").drop("few").groupBy("category").applyInArrow(lambda t: _merge(t, least), PLACED).unionByName(alone)
    rank = F.when(F.col("risk_level") == "high", 3).when(F.col("risk_level") == "medium", 2).otherwise(1)
    of = lambda c: F.min_by(c, "nth").alias(c)
    risk = F.max_by("risk_level", F.struct(rank, -F.col("nth"))).alias("risk_level") if recompute_risk else of("risk_level")
    parts = F.array_sort(F.collect_list(F.struct("nth", "item_ids", "summaries")))
    merged = both.join(placed, ["cluster_id", "existing"]).groupBy(F.col("into").alias("_into"), "into_existing").agg(
        *[of(c) for c in ("cluster_id", "category", "risk_reasons", "topics", "first_ms", "last_ms")], risk, F.max_by("headline", F.struct(F.col("score"), -F.col("nth"))).alias("headline"), F.max("score").alias("score"),
        parts.alias("p"), (~F.col("into_existing") | (F.count(F.lit(1)) > 1)).alias("changed"))
    merged = merged.withColumn("item_ids", F.flatten("p.item_ids")).withColumn("summaries", F.flatten("p.summaries"))
    merged = merged.select(*EVENT, "changed", F.size("item_ids").cast("long").alias("source_count"))
    merged = merged.withColumn("last_ms", F.when(F.col("changed"), F.lit(as_of_ms).cast("long")).otherwise(F.col("last_ms")))
    rest = events.where(~F.coalesce(recent, F.lit(False))).select(*EVENT, F.lit(False).alias("changed"), F.size("item_ids").cast("long").alias("source_count"))
    return merged.unionByName(rest)


def processed(items: DataFrame, merged: DataFrame) -> DataFrame:
    """Items with the event that they now belong to, marked as processed: the event whose ids name them."""
    of = merged.select(F.explode("item_ids").alias("_i"), F.col("cluster_id").alias("_c"))
    out = items.join(of, items["id"] == F.col("_i"), "left")
    return out.withColumn("cluster_id", F.col("_c")).withColumn("is_processed", F.col("_c").isNotNull()).drop("_i", "_c")

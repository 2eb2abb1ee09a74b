"""Markets: what is open, upsert by source and id, volumes of entities, and the boost they give."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..shared import written
from .scoring import log_boost
from .state import pruned, upsert
from .topics import with_topics


def open_markets(df: DataFrame, as_of: Column) -> DataFrame:
    """Markets with a question and volume that are neither closed, inactive nor expired."""
    return df.where((F.coalesce("question", F.lit("")) != "") & ~F.coalesce("closed", F.lit(False)) & F.coalesce("active", F.lit(True)) & (F.coalesce("ends_at", as_of) >= as_of) & ~F.isnan("volume") & (F.col("volume") > 0))


def open_events(df: DataFrame, as_of: Column) -> DataFrame:
    """Events with a title (else a subtitle) that are open and not expired; volume falls back to open interest, then 0."""
    title = F.coalesce("title", "sub_title")
    out = df.where((F.coalesce("status", F.lit("open")) == "open") & (F.coalesce(title, F.lit("")) != "") & (F.coalesce("ends_at", as_of) >= as_of))
    return out.select("market_id", title.alias("question"), F.coalesce("volume_24h", "open_interest", F.lit(0.0)).alias("volume"))


def top_by_volume(df: DataFrame, n: int, *ties: str) -> DataFrame:
    return df.orderBy(F.desc_nulls_last("volume"), *ties).limit(n)


def refreshed(topics: DataFrame, batch: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Topics after an upsert that refreshes volume, question and last_seen, without those unseen for so many days."""
    return pruned(upsert(topics, batch, "id", ["volume", "question", "last_seen"]), F.col("last_seen") < as_of - F.make_dt_interval(F.lit(days)))


def landed(exchanges: dict[str, DataFrame], n: int = 50) -> DataFrame:
    """id, source, market_id, question, volume: the n markets of each exchange with the largest volume (ties by market_id).
    Markets that an exchange names twice are taken once, with the larger volume; null market_ids are left out."""
    out = []
    for source, m in exchanges.items():
        once = m.where("market_id IS NOT NULL").groupBy("market_id").agg(F.max(F.struct("volume", "question")).alias("m")).select("market_id", "m.*")
        out.append(top_by_volume(once, n, "market_id").select(F.concat(F.lit(f"{source}:"), "market_id").alias("id"), F.lit(source).alias("source"), "market_id", "question", "volume"))
    return reduce(DataFrame.unionByName, out)


def refresh(topics: DataFrame, batch: DataFrame, known: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Topics (id, source, market_id, question, volume, topic, entities, category, extracted_at, last_seen) after a run that
    saw the markets of ``landed``: those that are there keep their topic and get the run's volume, question and time; new ones
    get a topic, from known (id, answer of an extractor) or their words; those unseen for so many days go.

    Topics are read off new markets only, of which a run has at most n an exchange.
    """
    new = with_topics(batch.join(topics.select("id"), "id", "left_anti").select("id", "question"), known, key="id").select("id", "topic", "entities", "category")
    rows = batch.join(new, "id", "left").withColumn("extracted_at", as_of).withColumn("last_seen", as_of)
    return refreshed(topics, rows, as_of, days)


def run_report(before: DataFrame, batch: DataFrame, after: DataFrame, sources: list[str]) -> DataFrame:
    """One row: a column for each source with how many of its markets a run saw, and new_topics, by how many topics are more
    than before (0 if they are fewer)."""
    seen = batch.agg(*[F.count_if(F.col("source") == s).alias(s) for s in sources])
    grown = before.select(F.lit(-1).alias("n")).unionByName(after.select(F.lit(1).alias("n"))).agg(F.greatest(F.coalesce(F.sum("n"), F.lit(0)), F.lit(0)).alias("new_topics"))
    return seen.crossJoin(grown)


def entity_volumes(topics: DataFrame) -> DataFrame:
    """entity, volume: the largest volume of each entity of three letters or more."""
    e = topics.select(F.explode("entities").alias("e"), "volume").select(F.lower(F.trim("e")).alias("entity"), "volume")
    return e.where((F.length("entity") >= 3) & (F.col("volume") > 0)).groupBy("entity").agg(F.max("volume").alias("volume"))


GRAM = 3


def _grams(c: str) -> Column:
    """The different runs of three characters of a text, found in one pass."""
    return F.array_distinct(F.regexp_extract_all(F.col(c), F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))


def boosted(items: DataFrame, entities: DataFrame, text: Column) -> DataFrame:
    """Adds boost: that of the largest volume among the entities that a lower-case text contains anywhere, 0 if none.

    entities: entity (of three characters or more), volume, any number of them. A text that contains an entity has its
    rarest three characters, rarest among the texts: an inverted index on those brings text and entity together, and
    containment decides. Rows have keys of their own, so their ids need be neither set nor unique; equal texts are looked up
    once, null texts contain nothing.
    """
    named = entities.where(F.length("entity") >= GRAM).groupBy("entity").agg(F.max("volume").alias("volume"))
    texts = written(items.select(text.alias("t")).where("t IS NOT NULL").distinct().withColumn("r", F.monotonically_increasing_id()), "texts")
    parts = named.select("entity", "volume", F.explode(_grams("entity")).alias("g"))
    held = written(texts.select("r", F.explode(_grams("t")).alias("g")).join(parts.select("g").distinct(), "g", "left_semi"), "grams")
    # an entity with characters that no text has is in none
    found = parts.join(held.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "g", "left")
    rarest = found.groupBy("entity", "volume").agg(F.min_by("g", F.struct("n", "g")).alias("g"), F.min(F.col("n").isNotNull()).alias("all")).where("all").drop("all")
    hits = held.join(rarest, "g").join(texts, "r").where(F.contains("t", "entity"))
    best = hits.groupBy(F.col("t").alias("_s")).agg(F.max("volume").alias("_v"))
    return items.withColumn("_t", text).join(best, F.col("_t") == F.col("_s"), "left").withColumn("boost", F.coalesce(log_boost(F.col("_v")), F.lit(0.0))).drop("_t", "_s", "_v")

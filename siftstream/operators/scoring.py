"""Scores and risk of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X
from ..functions.text import _col
from ..functions.times import age_hours
from ..plans.lexicons import NEWS, Lexicon

PENALTY = 3.0


def base_score(text: Column, weight: Column, published: Column, as_of: Column, lexicon: Lexicon = NEWS, boost: Column | None = None) -> Column:
    """0 to 10 (8 without a word of the top list): words of three lists, the source's weight, recency, boosts, a penalty.

    text is lower case. A missing weight counts as 5; future items count as new.
    """
    w, age = F.coalesce(weight, F.lit(5)), age_hours(published, as_of)
    known = X.found(text, (*lexicon.top, *lexicon.middle, *lexicon.light, *lexicon.priority, *lexicon.penalised))

    def words(known: Column) -> Column:
        top = X.hit_count(text, lexicon.top, known)
        sum_ = 4.0 * top + 2.0 * X.hit_count(text, lexicon.middle, known) + 1.0 * X.hit_count(text, lexicon.light, known)
        return F.struct((top > 0).alias("top"), sum_.alias("sum"), X.any_hit(text, lexicon.priority, known).alias("priority"), X.any_hit(text, lexicon.penalised, known).alias("penalised"))

    rest = F.when(w >= 9, 1.0).when(w >= 7, 0.5).otherwise(0.0) + F.when(age < 1, 1.0).when(age < 3, 0.5).otherwise(0.0) + (F.lit(0.0) if boost is None else F.coalesce(boost, F.lit(0.0)))

    def total(x: Column) -> Column:
        raw = x["sum"] + F.when(x["priority"], 1.5).otherwise(0.0) - F.when(x["penalised"], PENALTY).otherwise(0.0) + x["rest"]
        return F.least(F.when(x["top"], 10.0).otherwise(8.0), F.greatest(F.lit(0.0), raw))

    return X.bound(F.struct(X.bound(known, words).alias("w"), rest.alias("rest")), lambda x: total({**{k: x["w"][k] for k in ("top", "sum", "priority", "penalised")}, "rest": x["rest"]}))


def item_text(title: str = "title", summary: str = "summary") -> Column:
    return F.lower(F.concat(F.coalesce(F.col(title), F.lit("")), F.lit(" "), F.coalesce(F.col(summary), F.lit(""))))


def score(items: DataFrame, as_of: Column, lexicon: Lexicon = NEWS, boost: Column | None = None) -> DataFrame:
    """Adds score to items (title, summary, weight, published_at)."""
    items = items.withColumn("_t", item_text())
    return items.withColumn("score", base_score(F.col("_t"), F.col("weight"), F.col("published_at"), as_of, lexicon, boost)).drop("_t")


def risk(text: str | Column, lexicon: Lexicon = NEWS) -> Column:
    """struct<level, reasons>: high with the grave words, else medium with the serious ones, else low."""
    t = F.lower(_col(text))

    def judged(known: Column) -> Column:
        grave, serious = X.hits(t, lexicon.grave, known), X.hits(t, lexicon.serious, known)
        level = F.when(F.size(grave) > 0, "high").when(F.size(serious) > 0, "medium").otherwise("low")
        return F.struct(level.alias("level"), F.when(F.size(grave) > 0, grave).otherwise(serious).alias("reasons"))

    return X.bound(X.found(t, (*lexicon.grave, *lexicon.serious)), judged)


def keywords(text: Column, lexicon: Lexicon = NEWS) -> Column:
    """Words of the two upper lists that a lower-case text holds."""
    return X.hits(text, (*lexicon.top, *lexicon.middle))


def log_boost(volume: Column) -> Column:
    """Half the decimal logarithm of a volume, from 0 to 3."""
    return F.when(volume > 0, F.least(F.lit(3.0), F.greatest(F.lit(0.0), 0.5 * F.log10(volume)))).otherwise(F.lit(0.0))


def topics(title: Column, summary: Column, geo: dict[str, list[str]], tags: dict[str, list[str]], most_geo: int = 2, most: int = 4) -> Column:
    """The first two places and then the topics whose words a text holds, four in all. Spaces of a word count."""
    t = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(summary, F.lit(""))))
    known = X.found(t, [w for d in (geo, tags) for words in d.values() for w in words])
    return X.bound(known, lambda k: F.slice(F.array_distinct(F.concat(F.slice(_tagged(k, geo), 1, most_geo), _tagged(k, tags))), 1, most))


def _tagged(known: Column, tags: dict[str, list[str]]) -> Column:
    """The tags, in their order, that have one of the words."""
    of: dict[str, list[str]] = {}
    for tag, words in tags.items():
        for w in words:
            of.setdefault(w, []).append(tag)
    if not of:
        return F.array().cast("array<string>")
    strings = lambda xs: F.array(*[F.lit(x) for x in xs])
    lists = F.map_from_arrays(strings(of), F.array(*[strings(x) for x in of.values()]))
    hit = F.flatten(F.transform(known, lambda w: F.coalesce(F.try_element_at(lists, w), F.array().cast("array<string>"))))
    return X.bound(hit, lambda h: F.filter(strings(tags), lambda tag: F.array_contains(h, tag)))


def mergeable(candidate: Column, text: Column, lexicon: Lexicon = NEWS, least: int = 2) -> Column:
    """Whether a candidate's keywords and a text's share at least two."""
    return F.size(F.array_intersect(candidate, keywords(F.lower(text), lexicon))) >= least

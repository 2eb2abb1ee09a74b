"""Topics of market questions: what an extractor answered, checked, or words of the question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X
from ..functions.text import _col
from .guards import entities_clean, topic_valid

TOPIC = "struct<topic:string,entities:array<string>,category:string>"
#: Words that name nothing.
COMMON = "a an and are at be before by do does for from happen hit how if in is it lose more no not of on or over than the their there this to under what when which who will win with".split()
#: A category's words; the first category with one of them in the question is the question's, else "other".
CATEGORIES = {
    "economics": "fed ecb rate rates inflation recession gdp tariff tariffs unemployment economy".split(),
    "politics": "president election senate congress minister ceasefire war treaty parliament impeachment indictment".split(),
    "crypto": "bitcoin btc ethereum eth crypto solana token stablecoin".split(),
    "sports": "league cup championship finals season olympics match tournament".split(),
    "culture": "movie film album oscar grammy song series celebrity".split(),
    "science": "space launch vaccine climate temperature earthquake hurricane fusion".split(),
}


def words_of(question: str | Column) -> Column:
    """A question's distinct words in order, in lower case, without common ones and single signs."""
    found = F.regexp_extract_all(F.lower(F.coalesce(_col(question), F.lit(""))), F.lit("[$]?[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) > 1) & ~w.isin(*COMMON)))


def topic_of_words(question: str | Column) -> Column:
    """A topic that needs no service: up to six words as its name, up to eight as its entities. Null without words."""
    words = words_of(question)
    category = F.lit("other")
    for name, listed in reversed(CATEGORIES.items()):
        category = F.when(F.arrays_overlap(words, F.array(*map(F.lit, listed))), name).otherwise(category)
    topic = F.struct(F.array_join(F.slice(words, 1, 6), " ").alias("topic"), F.slice(words, 1, 8).alias("entities"), category.alias("category"))
    return F.when(F.size(words) > 0, topic)


def topic_of_answer(answer: str | Column) -> Column:
    """The topic that an extractor's JSON answer gives, fenced or not; null if it lacks a part."""
    t = F.from_json(X.without_fences(_col(answer)), TOPIC)
    entities = t["entities"]
    return F.when(topic_valid(t["topic"], entities, t["category"]), F.struct(t["topic"].alias("topic"), entities_clean(entities).alias("entities"), t["category"].alias("category")))


def with_topics(markets: DataFrame, known: DataFrame, question: str = "question", key: str = "market_id") -> DataFrame:
    """Markets (key, question) with topic, entities and category. known: key, answer of markets whose topic is cached; it goes
    before the words of the question."""
    both = markets.join(known.select(key, F.col("answer").alias("_answer")), key, "left")
    t = F.coalesce(topic_of_answer("_answer"), topic_of_words(question))
    return both.withColumn("_t", t).select(*markets.columns, "_t.topic", "_t.entities", "_t.category")

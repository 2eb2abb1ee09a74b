"""Checks of generated text, edits and callbacks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions.text import _col, stripped
from ..plans import lexicons as L

MODES = ("pure_news", "news_odds", "engagement")
RESPONSE = "content_mode string, has_market boolean, include_link boolean, content string, char_count double, estimated_score double, score_explanation string"


# Percentages, tickers behind a dollar sign and bare ones, in the regular expressions of Java and RE2 alike.
PERCENT, TICKER, BARE = r"\b(\d{1,3}(?:\.\d+)?)\s*%", r"\$([A-Z]{1,5}(?:\.[A-Z])?)\b", r"\b([A-Z]{2,5})\b"


def percents(c: str | Column) -> Column:
    return F.transform(F.regexp_extract_all(_col(c), F.lit(PERCENT), F.lit(1)), lambda x: x.cast("double"))


def percents_supported(content: str | Column, context: str | Column) -> Column:
    """Whether each percentage of a text is within 1 of one in its context."""
    known = percents(context)
    return F.forall(percents(content), lambda o: F.exists(known, lambda c: F.abs(c - o) <= 1))


def tickers(c: str | Column) -> Column:
    """Base symbols after dollar signs."""
    return F.array_distinct(F.transform(F.regexp_extract_all(_col(c), F.lit(TICKER), F.lit(1)), lambda x: F.substring_index(x, ".", 1)))


def tickers_supported(content: str | Column, context: str | Column) -> Column:
    """Whether each ticker of a text stands in its context, with or without a dollar sign."""
    bare = F.regexp_extract_all(_col(context), F.lit(BARE), F.lit(1))
    return F.size(F.array_except(tickers(content), F.concat(tickers(context), bare))) == 0


def banned(c: str | Column) -> Column:
    return F.lower(_col(c)).rlike("|".join(L.BANNED))


def refusal(content: str | Column, context: str | Column, mode: Column | None = None) -> Column:
    """Why a text is refused, null if it is not: mode, length, banned phrase, percentage or ticker, the first that holds."""
    content = _col(content)
    mode_bad = F.lit(False) if mode is None else ~F.coalesce(mode.isin(*MODES), F.lit(False))
    n = F.length(content)
    return (
        F.when(mode_bad, "mode").when(content.isNull() | (n < 20) | (n > 400), "length").when(banned(content), "banned phrase")
        .when(~percents_supported(content, context), "fabricated percentage").when(~tickers_supported(content, context), "fabricated ticker")
    )


def response(raw: str | Column) -> Column:
    """A JSON answer as struct, with defaults for what may be missing."""
    r = F.from_json(_col(raw), RESPONSE)
    return F.struct(
        r["content_mode"].alias("content_mode"), F.coalesce(r["has_market"], F.lit(False)).alias("has_market"), F.coalesce(r["include_link"], F.lit(False)).alias("include_link"),
        r["content"].alias("content"), F.coalesce(r["char_count"], F.length(r["content"])).alias("char_count"), F.coalesce(r["estimated_score"], F.lit(5.0)).alias("estimated_score"),
        F.coalesce(r["score_explanation"], F.lit("")).alias("score_explanation"))


def edit_refusal(new: str | Column, old: str | Column, most: int = 280) -> Column:
    """Why an edit is refused, null if it is not: white space at its ends does not count."""
    new = stripped(new)
    return F.when(F.coalesce(new, F.lit("")) == "", "empty").when(F.length(new) > most, "too long").when(new == _col(old), "unchanged")


def publishable(c: str | Column, most: int = 280) -> Column:
    return F.length(_col(c)) <= most


def reason_given(c: str | Column, least: int = 5) -> Column:
    return F.length(F.trim(F.coalesce(_col(c), F.lit("")))) >= least


def topic_valid(topic: Column, entities: Column, category: Column) -> Column:
    return topic.isNotNull() & entities.isNotNull() & ~F.exists(entities, lambda e: e.isNull()) & category.isNotNull()


def entities_clean(c: Column) -> Column:
    return F.filter(F.transform(c, lambda e: F.lower(F.trim(e))), lambda e: F.length(e) > 1)


def signature_ok(ts: Column, nonce: Column, secret: Column, body: Column, signature: Column) -> Column:
    """SHA-256 of time, nonce, secret and body; false without a secret."""
    return F.coalesce((secret != "") & (F.sha2(F.concat(ts, nonce, secret, body), 256) == F.lower(signature)), F.lit(False))


def fresh(ts: Column, as_of_s: Column, within_s: int = 300) -> Column:
    """Whether a clock in seconds or microseconds is within the time of now."""
    v = ts.cast("double")
    seconds = F.when(v > 1e14, v / 1e6).otherwise(v)
    return F.coalesce(F.abs(as_of_s - seconds) <= within_s, F.lit(False))


def decrypted(envelope: Column, key: str) -> Column:
    """The body of an envelope: base64 of a 16-byte vector and AES-256-CBC under the key's SHA-256."""
    return F.try_aes_decrypt(F.unbase64(envelope), F.unhex(F.sha2(F.lit(key), 256)), F.lit("CBC")).cast("string")

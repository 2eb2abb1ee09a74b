"""Text as column expressions. All stay in the JVM; patterns are literals, so they are compiled once."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from ..plans import lexicons as L

SPACES = "[ \\t\\n\\x0B\\f\\r]+"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def escaped(word: str) -> str:
    """A word as a pattern for Java and RE2."""
    return re.sub(r"([.^$*+?()\[\]{}|\\&/-])", r"\\\1", word)


def boundary(word: str) -> str:
    """A word between signs that are no ASCII word characters, or at an end."""
    return f"(?:^|\\W){escaped(word)}(?:$|\\W)"


def collapse(c: str | Column) -> Column:
    """White space as one space, none at the ends."""
    return F.trim(F.regexp_replace(_col(c), SPACES, " "))


def stripped(c: str | Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(_col(c), r"^\s+|\s+$", "")


def word_hit(text: Column, word: str) -> Column:
    """Whether a lower-case text holds a word. The plain containment test spares most texts the pattern."""
    return text.contains(word) & text.rlike(boundary(word))


def _literals(words) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def found(text: Column, words) -> Column:
    """Which of the words a lower-case text holds, in the words' order.

    A text is taken apart once: a word of letters and digits is in it if it is one of its words. Only phrases and words with
    signs are looked for one by one, by ``word_hit``.
    """
    words = tuple(dict.fromkeys(words))
    single = [w for w in words if re.fullmatch(r"\w+", w, re.ASCII)]
    rest = [w for w in words if w not in single]

    def of(t: Column) -> Column:
        parts = [F.array_intersect(_literals(single), F.regexp_extract_all(t, F.lit("[0-9A-Za-z_]+"), F.lit(0)))] if single else []
        if rest:
            parts.append(F.array_compact(F.array(*[F.when(word_hit(t, w), F.lit(w)) for w in rest])))
        return parts[0] if len(parts) == 1 else F.array_intersect(_literals(words), F.concat(*parts))

    return bound(F.coalesce(text, F.lit("")), of) if words else _literals(())


def bound(value: Column, body) -> Column:
    """body of a value that is worked out once a row, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hits(text: Column, words, known: Column | None = None) -> Column:
    """The words that a lower-case text holds, in the words' order. known: what ``found`` says of a larger list."""
    return found(text, words) if known is None else F.array_intersect(_literals(words), known)


def hit_count(text: Column, words, known: Column | None = None) -> Column:
    return F.size(hits(text, words, known))


def any_hit(text: Column, words, known: Column | None = None) -> Column:
    """Whether a lower-case text holds any of the words."""
    return F.size(hits(text, words, known)) > 0


def clean_markup(c: str | Column) -> Column:
    """Text of a piece of markup: line breaks, three references, tags, white space."""
    c = F.coalesce(_col(c), F.lit(""))
    for pattern, to in ((r"(?i)<br ?/?>", " "), ("(?i)&nbsp;", " "), ("(?i)&amp;", "&"), ("<[^>]*>", " ")):
        c = F.regexp_replace(c, pattern, to)
    return collapse(c)


def truncated(c: str | Column, most: int) -> Column:
    """At most so many characters, the last an ellipsis if any are cut."""
    c = _col(c)
    return F.when(F.length(c) > most, F.concat(F.rtrim(F.substring(c, 1, most - 1)), F.lit("…"))).otherwise(c)


def title_key(c: str | Column) -> Column:
    """Lower case, without a newsy prefix and signs, the first twelve words."""
    c = F.regexp_replace(F.lower(_col(c)), "^(" + "|".join(L.TITLE_PREFIXES) + ")[ \\t\\n\\f\\r]*:", "")
    return F.array_join(F.slice(F.split(collapse(F.regexp_replace(c, r"[^\w\s]", " ")), " "), 1, 12), " ")


def hashed(c: str | Column) -> Column:
    return F.sha2(_col(c), 256)


def publisher(c: str | Column) -> Column:
    """struct<title, publisher> of a title that may end in " - publisher"."""
    c = F.coalesce(_col(c), F.lit(""))
    last = F.substring_index(c, " - ", -1)
    has = c.contains(" - ")
    head = F.substring(c, F.lit(1), F.length(c) - F.length(last) - 3)
    return F.struct(F.trim(F.when(has, head).otherwise(c)).alias("title"), F.when(has, F.lower(F.trim(last))).otherwise(F.lit("")).alias("publisher"))


def trusted(c: str | Column, publishers=L.PUBLISHERS) -> Column:
    return F.coalesce(F.lower(F.trim(_col(c))).isin(*publishers), F.lit(False))


def url_component(c: str | Column) -> Column:
    """Percent-encoding that leaves letters, digits and -_.!~*'() alone."""
    out = F.replace(F.url_encode(_col(c)), F.lit("+"), F.lit("%20"))
    for code, sign in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~"), ("%2A", "*")):
        out = F.replace(out, F.lit(code), F.lit(sign))
    return out


def redacted(c: str | Column, most: int = 500, patterns=L.INJECTIONS) -> Column:
    """A text without what could steer a prompt, in one line of at most so many characters."""
    c = F.coalesce(_col(c), F.lit(""))
    for p in patterns:
        c = F.regexp_replace(c, p, "[redacted]")
    return F.substring(collapse(c), 1, most)


def prompt_summary(summaries: str | Column) -> Column:
    """Summaries, each redacted to 200 characters, joined and cut at 600."""
    return F.substring(F.array_join(F.transform(_col(summaries), lambda s: redacted(s, 200)), " "), 1, 600)


def without_urls(c: str | Column) -> Column:
    return F.regexp_replace(F.regexp_replace(_col(c), r"https?://\S+", ""), "^[ \\t\\n\\f\\r]+|[ \\t\\n\\f\\r]+$", "")


def without_fences(c: str | Column) -> Column:
    return F.regexp_replace(F.regexp_replace(_col(c), r"^\s*```(?:json)?\s*", ""), r"\s*```\s*$", "")


def filing_items(c: str | Column) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(r"(?i)Item\s+(\d+\.\d+)\b"), F.lit(1))


def high_signal_filing(kind: str | Column, summary: str | Column) -> Column:
    """Whether a filing matters: an 8-K only with an item of the list, any other always."""
    return F.when(F.upper(_col(kind)) == "8-K", F.arrays_overlap(filing_items(summary), F.array(*map(F.lit, L.FILING_ITEMS)))).otherwise(F.lit(True))


def joined(*parts: Column, sep: str = " ") -> Column:
    """Parts that are neither null nor empty, joined."""
    return F.concat_ws(sep, *[F.when(p != "", p) for p in parts])


def quoted(c: str | Column) -> Column:
    """Each line behind a mark, empty ones too."""
    return F.concat(F.lit("> "), F.replace(_col(c), F.lit("\n"), F.lit("\n> ")))


def label(c: str | Column, labels: dict[str, str]) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, _col(c)), _col(c))


def json_list(c: str | Column) -> Column:
    """A JSON list of strings; none for what is malformed."""
    return F.coalesce(F.from_json(_col(c), "array<string>"), F.array().cast("array<string>"))


def one_decimal(c: str | Column) -> Column:
    """A number of at least 0 with one decimal, the nearest of the double's exact value, ties up; null as 0.

    Ten times a double is not always a double, so the rounded tenths are compared with it in parts that are: 8x, 2x, and the
    difference of 8x and a number within half and twice of it.
    """
    x = F.coalesce(_col(c).cast("double"), F.lit(0.0))
    n = F.floor(x * 10 + 0.5)
    n = F.when(n - 0.5 - 8 * x <= 2 * x, n).otherwise(n - 1)
    return F.concat(F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"))


def header_colour(risk: str | Column) -> Column:
    return F.when(_col(risk) == "high", "red").when(_col(risk) == "medium", "orange").otherwise("green")


def worthy(c: str | Column, patterns=L.LOW_SIGNAL) -> Column:
    """Whether a headline looks like news."""
    c = F.regexp_replace(_col(c), "^[ \\t\\n\\f\\r]+|[ \\t\\n\\f\\r]+$", "")
    return F.coalesce((F.length(c) >= 10) & ~F.lower(c).rlike("|".join(patterns)), F.lit(False))

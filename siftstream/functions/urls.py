"""URLs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..plans.lexicons import TRACKING
from .text import _col, stripped

PARTS = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


#: Any reference: scheme, authority, path, query, fragment.
REFERENCE = r"^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"


def authority(scheme: Column, c: Column) -> Column:
    """User info as it is, the host in lower case, no port that is the scheme's own. scheme is lower case."""
    user = F.regexp_extract(c, "^(.*@)?", 0)
    host_ = F.lower(F.substring(c, F.length(user) + 1, F.length(c)))
    return F.concat(user, F.regexp_replace(host_, F.when(scheme == "http", ":80$").when(scheme == "https", ":443$").otherwise(":$"), ""))


def without_dots(path: Column) -> Column:
    """A path whose segments . and .. (percent-encoded or not) are resolved, by a fold with a stack of segments."""
    segments = F.split(path, "/")
    # what stands before the first slash is no segment
    names = F.slice(segments, F.lit(2), F.greatest(F.size(segments) - 1, F.lit(0)))
    plain = lambda x: F.replace(F.lower(x), F.lit("%2e"), F.lit("."))
    popped = lambda acc: F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
    kept = F.aggregate(names, F.array().cast("array<string>"), lambda acc, x: F.when(plain(x) == "..", popped(acc)).when(plain(x) == ".", acc).otherwise(F.concat(acc, F.array(x))))
    folder = plain(F.element_at(segments, -1)).isin(".", "..")
    # most paths have none, and are what the fold would put together again
    none = path.startswith("/") & ~path.rlike(r"(?i)/(?:\.|%2e){1,2}(?:/|\z)")
    return F.when(none, path).otherwise(F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(folder & (F.size(kept) > 0), "/").otherwise("")))


def _form(c: Column) -> Column:
    return F.url_encode(F.coalesce(F.try_url_decode(c), c))


def normalised(c: str | Column) -> Column:
    """One form for an article's URL: no fragment, lower-case scheme and host, no default port, no dot segments, no tracking
    parameters (by prefix of their names), no slashes or AMP suffix at the path's end; parameters are encoded as forms are.
    What is not an absolute URL stays."""
    c = _col(c)
    part = lambda k: F.regexp_extract(c, PARTS, k)
    name = lambda p: F.substring_index(p, "=", 1)
    pairs = F.filter(F.split(part(4), "&"), lambda p: (p != "") & ~F.lower(F.coalesce(F.try_url_decode(name(p)), name(p))).rlike("^(?:" + "|".join(TRACKING) + ")"))
    query = F.array_join(F.transform(pairs, lambda p: F.concat(_form(name(p)), F.lit("="), _form(F.substring(p, F.length(name(p)) + 2, F.length(p))))), "&")
    path = F.regexp_replace(F.regexp_replace(without_dots(part(3)), "/+$", ""), r"(?i)/(?:amp|amp\.html|amp\.htm)$", "")
    scheme = F.lower(part(1))
    out = F.concat(scheme, F.lit("://"), authority(scheme, part(2)), F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(c.rlike(PARTS), out).otherwise(c)


def host(c: str | Column) -> Column:
    return F.lower(F.regexp_extract(_col(c), PARTS, 2))


def absolute(c: str | Column, base: str | Column) -> Column:
    """A reference resolved against a base URL (a literal or a column): with a scheme of its own, //host, /path, relative,
    ?query, #fragment or empty. Dot segments and default ports go, hosts are lower case; schemes without an authority
    (mail, data) stay as they are, as does anything beside a base that is no URL."""
    c = stripped(c)
    base = F.lit(base) if isinstance(base, str) else base
    of = lambda k: F.regexp_extract(base, PARTS, k)
    own = lambda k: F.regexp_extract(c, REFERENCE, k)
    has = c.rlike("^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//")
    scheme = F.when(own(1) != "", F.lower(own(1))).otherwise(F.lower(of(1)))
    path, same = own(3), ~has & (own(3) == "")
    folder = F.regexp_replace(F.when(of(3) == "", "/").otherwise(of(3)), "[^/]*$", "")
    joined = F.when(has, path).when(same, of(3)).when(path.startswith("/"), path).otherwise(F.concat(folder, path))
    asked = F.when(base.contains("?") & (of(4) != ""), F.concat(F.lit("?"), of(4))).otherwise("")
    query = F.when(same & (own(4) == ""), asked).otherwise(own(4))
    out = F.concat(scheme, F.lit("://"), authority(scheme, F.when(has, own(2)).otherwise(of(2))), without_dots(joined), query, own(5))
    return F.when((own(1) != "") & ~has, c).when((own(1) == "") & ~base.rlike(PARTS), c).otherwise(out)

"""Connectors over landed payloads: JSON, XML and HTML files become rows of one shape.

Each takes a frame with a column ``body`` (one payload a row) and "now", and gives title, summary, url, published_at.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as X
from ..functions import times as T
from ..functions import urls as U
from ..operators.markets import open_events, open_markets, top_by_volume
from ..plans import lexicons as L

RECENT_DAYS = 30
# The fields of public services' answers and of feeds.
KEV = "vulnerabilities array<struct<cveID:string,vendorProject:string,product:string,vulnerabilityName:string,dateAdded:string,shortDescription:string,requiredAction:string,knownRansomwareCampaignUse:string>>"
QUAKES = "features array<struct<id:string,properties:struct<title:string,place:string,mag:string,time:bigint,url:string>>>"
ALERTS = "features array<struct<id:string,properties:struct<id:string,uri:string,event:string,headline:string,areaDesc:string,severity:string,description:string,instruction:string,sent:string,effective:string>>>"
RECALLS = "results array<struct<event_id:string,report_date:string,recall_initiation_date:string,classification:string,product_description:string,recalling_firm:string,reason_for_recall:string,distribution_pattern:string>>"
ENTRY = "title string, link string, guid string, contentSnippet string, summary string, content string, pubDate string, isoDate string, updated string"
ENTRIES = f"array<struct<{ENTRY.replace(' string', ':string')}>>"
KEV_PAGE = "https://www.cisa.gov/known-exploited-vulnerabilities-catalog?search_api_fulltext="


#: Columns of payloads that their items keep: where they came from.
CARRIED = ("source_id", "source_url")


def _carried(df: DataFrame) -> list[str]:
    return [c for c in CARRIED if c in df.columns]


def valid(items: DataFrame) -> DataFrame:
    """Cleaned items with a title and a URL; summaries cut at 500 characters."""
    out = items.select(X.clean_markup("title").alias("title"), F.substring(X.clean_markup("summary"), 1, 500).alias("summary"), F.trim(F.coalesce("url", F.lit(""))).alias("url"), "published_at", *_carried(items))
    return out.where((F.col("title") != "") & (F.col("url") != "")).withColumn("url_hash", X.hashed(U.normalised("url"))).withColumn("title_hash", X.hashed(X.title_key("title")))


def _rows(payloads: DataFrame, schema: str, field: str) -> DataFrame:
    return payloads.select(F.explode(F.from_json("body", schema)[field]).alias("r"), *_carried(payloads)).select("r.*", *_carried(payloads))


def _recent(as_of: Column) -> Column:
    return F.col("published_at") >= as_of - F.make_dt_interval(F.lit(RECENT_DAYS))


def exploited_vulnerabilities(payloads: DataFrame, as_of: Column) -> DataFrame:
    r = _rows(payloads, KEV, "vulnerabilities").withColumn("published_at", T.parsed("dateAdded", as_of)).where((F.coalesce("cveID", F.lit("")) != "") & _recent(as_of))
    product = X.joined(F.col("vendorProject"), F.col("product"))
    name = F.when(product == "", F.col("cveID")).otherwise(product)
    prefixed = lambda p, c: F.when(F.col(c) != "", F.concat(F.lit(p), F.col(c)))
    summary = X.joined(F.col("vulnerabilityName"), F.col("shortDescription"), prefixed("Required action: ", "requiredAction"), prefixed("Ransomware use: ", "knownRansomwareCampaignUse"))
    return valid(r.select(F.concat(F.lit("CISA adds "), name, F.lit(" vulnerability to KEV catalog")).alias("title"), summary.alias("summary"), F.concat(F.lit(KEV_PAGE), X.url_component("cveID")).alias("url"), "published_at", *_carried(r)))


def exploited_vulnerabilities_page(payloads: DataFrame, as_of: Column) -> DataFrame:
    """The same from the catalogue's page, for when the JSON fails: blocks of text from one CVE number to the next."""
    block = r"CVE-\d{4}-\d{4,}"
    r = payloads.select(F.explode(F.regexp_extract_all(X.clean_markup("body"), F.lit(rf"(?s){block}.*?(?={block}|$)"), F.lit(0))).alias("b"), *_carried(payloads))
    r = r.select("b", *_carried(r), F.regexp_extract("b", block, 0).alias("cve"), F.regexp_extract("b", r"Date Added:\s*(\d{4}-\d{2}-\d{2})", 1).alias("day")).where("day <> ''")
    r = r.withColumn("published_at", T.parsed("day", as_of)).where(_recent(as_of))
    rest = F.regexp_replace(F.regexp_replace(F.replace("b", "cve", F.lit("")), r"(?is)Related CWEs?:.*$", ""), r"(?i)Known To Be Used in Ransomware Campaigns\?.*$", "")
    return valid(r.select(F.concat(F.lit("CISA adds "), "cve", F.lit(" vulnerability to KEV catalog")).alias("title"), X.truncated(F.trim(rest), 450).alias("summary"), F.concat(F.lit(KEV_PAGE), X.url_component("cve")).alias("url"), "published_at", *_carried(r)))


def earthquakes(payloads: DataFrame, as_of: Column) -> DataFrame:
    r = _rows(payloads, QUAKES, "features").select("properties.*", *_carried(payloads)).where((F.coalesce("title", F.lit("")) != "") & (F.coalesce("url", F.lit("")) != ""))
    summary = F.concat(F.lit("Magnitude "), F.coalesce("mag", F.lit("unknown")), F.lit(" earthquake near "), F.coalesce("place", F.lit("unknown location")), F.lit("."))
    return valid(r.select("title", summary.alias("summary"), "url", F.coalesce(F.timestamp_millis("time"), as_of).alias("published_at"), *_carried(r)))


def weather_alerts(payloads: DataFrame, as_of: Column) -> DataFrame:
    r = _rows(payloads, ALERTS, "features").select(F.col("id").alias("feature_id"), "properties.*", *_carried(payloads)).where(F.col("severity").isin(*L.SEVERITIES))
    title = F.coalesce("headline", X.joined(F.col("event"), F.col("areaDesc"), sep=" - "))
    return valid(r.select(title.alias("title"), X.joined(F.col("description"), F.col("instruction")).alias("summary"), F.coalesce("uri", "id", "feature_id").alias("url"), T.parsed(F.coalesce("sent", "effective"), as_of).alias("published_at"), *_carried(r)))


def recalls(payloads: DataFrame, as_of: Column, kind: str = "drug") -> DataFrame:
    if kind not in L.KINDS:
        raise ValueError(f"unsupported kind: {kind}")
    word = "medical device" if kind == "device" else kind
    r = _rows(payloads, RECALLS, "results").withColumn("published_at", T.report_date(F.coalesce("report_date", "recall_initiation_date"), as_of))
    r = r.where((F.coalesce("event_id", F.lit("")) != "") & _recent(as_of) & F.col("classification").isin(*L.CLASSES))
    product = X.truncated(X.clean_markup(F.coalesce("product_description", F.lit(f"{word} product"))), 130)
    prefixed = lambda p, c: F.when(F.col(c) != "", F.concat(F.lit(p), F.col(c)))
    summary = X.joined(F.col("classification"), prefixed("Firm: ", "recalling_firm"), prefixed("Reason: ", "reason_for_recall"), prefixed("Distribution: ", "distribution_pattern"))
    url = F.concat(F.lit(f"https://api.fda.gov/{kind}/enforcement.json?search=event_id:"), X.url_component("event_id"), F.lit("&limit=1"))
    return valid(r.select(F.concat(F.lit(f"FDA {word} recall: "), product).alias("title"), summary.alias("summary"), url.alias("url"), "published_at", *_carried(r)))


def feed_entries(entries: DataFrame, as_of: Column, base: str | Column) -> DataFrame:
    """Rows of a feed (ENTRY) as items."""
    return valid(entries.select("title", F.coalesce("contentSnippet", "summary", "content", F.lit("")).alias("summary"), U.absolute(F.coalesce("link", "guid"), base).alias("url"), T.parsed(F.coalesce("isoDate", "pubDate", "updated"), as_of).alias("published_at"), *_carried(entries)))


def filings(entries: DataFrame, as_of: Column, kind: str = "8-K") -> DataFrame:
    """Filings: of 8-Ks those with an item that matters."""
    summary = F.coalesce("contentSnippet", "summary", "content", F.lit(""))
    kept = entries.where(F.coalesce(X.high_signal_filing(F.lit(kind), summary), F.lit(False))).withColumn("title", F.coalesce("title", F.lit(f"{kind} filing")))
    return feed_entries(kept, as_of, "https://www.sec.gov/")


def market_news(entries: DataFrame, as_of: Column, base: str) -> DataFrame:
    """Entries of searches for market topics: of each URL (link, else guid) the first, if it is from a trusted publisher,
    without the publisher in the title. What comes first is told by ``topic_rank`` and ``position`` where entries have them,
    else by title and time."""
    order = [c for c in ("topic_rank", "position", "title", "pubDate", "isoDate") if c in entries.columns]
    url = F.coalesce("link", "guid")
    first = entries.where(F.coalesce(url, F.lit("")) != "").withColumn("_n", F.row_number().over(Window.partitionBy(url, *_carried(entries)).orderBy(*order))).where("_n = 1")
    named = first.withColumn("_p", X.publisher("title"))
    kept = named.where(X.trusted(F.col("_p.publisher"))).withColumn("title", F.col("_p.title")).drop("_p", "_n")
    return feed_entries(kept, as_of, base)


def topic_searches(topics: DataFrame, n: int = 8) -> DataFrame:
    """topic_rank, topic, url of a news search for each of the n topics with the largest volume."""
    top = topics.where(F.col("topic").isNotNull()).orderBy(F.desc_nulls_last("volume"), "topic").limit(n)
    ranked = top.withColumn("topic_rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("volume"), "topic")))
    url = F.concat(F.lit("https://news.google.com/rss/search?q="), X.url_component(F.concat("topic", F.lit(" when:2d"))), F.lit("&hl=en-US&gl=US&ceid=US:en"))
    return ranked.where(F.col("topic") != "").select("topic_rank", "topic", url.alias("url"))


def filings_url(uri: str) -> str:
    """Where the filings are that an adapter's URI names by type and count."""
    from urllib.parse import parse_qs, urlencode, urlsplit

    asked = parse_qs(urlsplit(uri).query)
    first = lambda name, default: asked.get(name, [default])[0]
    return "https://www.sec.gov/cgi-bin/browse-edgar?" + urlencode({"action": "getcurrent", "type": first("type", "8-K"), "owner": "include", "count": first("count", "100"), "output": "atom"})


# The fields of two exchanges' answers.
MARKETS = "array<struct<id:string,question:string,closed:boolean,active:boolean,end_date_iso:string,volume24hr:string>>"
EVENTS = "events array<struct<event_ticker:string,title:string,sub_title:string,status:string,expected_expiration_time:string,volume_24h:double,open_interest:double>>"


def market_answers(payloads: DataFrame, as_of: Column) -> DataFrame:
    """market_id, question, volume, ends_at of the open markets of landed answers (a JSON list each)."""
    r = payloads.select(F.explode(F.from_json("body", MARKETS)).alias("r")).select("r.*")
    r = r.select(F.col("id").alias("market_id"), "question", "closed", "active", F.try_to_timestamp("end_date_iso").alias("ends_at"), F.coalesce(F.expr("try_cast(volume24hr AS double)"), F.lit(0.0)).alias("volume"))
    return open_markets(r, as_of).select("market_id", "question", "volume", "ends_at")


def event_answers(payloads: DataFrame, as_of: Column, n: int = 50) -> DataFrame:
    """The n open events with the largest volume of landed answers ({"events": [...]} each)."""
    r = _rows(payloads, EVENTS, "events").select(F.col("event_ticker").alias("market_id"), F.trim("title").alias("title"), F.trim("sub_title").alias("sub_title"), "status", F.try_to_timestamp("expected_expiration_time").alias("ends_at"), "volume_24h", "open_interest")
    return top_by_volume(open_events(r, as_of), n, "market_id")


def vulnerabilities_or_page(payloads: DataFrame, pages: DataFrame, as_of: Column) -> DataFrame:
    """The catalogue's JSON, or where no payload of it can be read, its page."""
    readable = payloads.where(F.from_json("body", KEV)["vulnerabilities"].isNotNull()).limit(1).select(F.lit(1).alias("_ok"))
    return exploited_vulnerabilities(payloads, as_of).unionByName(exploited_vulnerabilities_page(pages.join(readable, F.lit(True), "left_anti"), as_of))


#: Connectors by the name of their scheme's host and path.
ADAPTERS: dict[str, Callable[..., DataFrame]] = {
    "cisa/kev": exploited_vulnerabilities, "cisa/kev-page": exploited_vulnerabilities_page, "usgs/significant-quakes": earthquakes, "nws/severe-alerts": weather_alerts, "openfda/enforcement": recalls,
    "sec/current": filings, "markets/google-news": market_news,
}
#: Connectors that read entries of feeds; the others read payloads.
OF_ENTRIES = ("sec/current", "markets/google-news")


def adapter(uri: str) -> Callable[..., DataFrame]:
    """The connector of adapter://host/path; unknown ones are an error."""
    name = route(uri)
    if name not in ADAPTERS:
        raise ValueError(f"unknown adapter: {uri}")
    return ADAPTERS[name]


def route(uri: str) -> str:
    """Host and path of a URI."""
    return uri.split("://", 1)[-1].split("?", 1)[0].strip("/")


def active(sources: DataFrame) -> DataFrame:
    return sources.where(F.coalesce(F.col("is_active").cast("int") == 1, F.lit(False)))


def with_source(items: DataFrame, sources: DataFrame) -> DataFrame:
    """Items (source_id) with the name, category and weight of their source."""
    s = sources.select(F.col("source_id").alias("_s"), F.col("name").alias("source_name"), "category", "weight")
    return items.join(s, items["source_id"] == F.col("_s")).drop("_s")


def routed(sources: DataFrame) -> DataFrame:
    """source_id, source_url and connector ('feed' for feeds, else host and path of the adapter) of active sources."""
    path = F.trim(F.regexp_extract("url", r"^(?:[^?]*?://)?([^?]*)", 1))
    name = F.when(F.col("url").rlike("^(?:https?://|file:)"), "feed").otherwise(F.regexp_replace(path, "^/+|/+$", ""))
    return active(sources).select("source_id", F.col("url").alias("source_url"), name.alias("connector"))


def ingest(sources: DataFrame, payloads: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Items of all active sources, and a row for each source that gave an error.

    sources: source_id, url, is_active, name, category, weight. payloads: source_id, body (a feed's entries as a JSON list of
    ENTRY, or an adapter's answer), error. A source that failed, or whose adapter is unknown, costs nothing but its own
    items. Payloads meet their sources in one join; there is a branch of the plan for each connector that is used, however
    many sources there are.
    """
    on = routed(sources)
    known = ["feed", *ADAPTERS]
    mine = payloads.drop(*[c for c in ("source_url", "connector") if c in payloads.columns]).join(on, "source_id")
    errors = mine.where("error IS NOT NULL").select("source_id", "error")
    errors = errors.unionByName(on.where(~F.col("connector").isin(known)).select("source_id", F.concat(F.lit("unknown adapter: "), "source_url").alias("error")))
    # as many rows as there are connectors at most
    used = sorted(r.connector for r in on.where(F.col("connector").isin(known)).select("connector").distinct().collect())
    parts = []
    for name in used:
        of = mine.where("error IS NULL").where(F.col("connector") == name)
        entries = of.select(F.explode(F.from_json("body", ENTRIES)).alias("e"), *_carried(of)).select("e.*", *_carried(of))
        if name == "feed":
            found = feed_entries(entries, as_of, F.col("source_url"))
        elif name == "markets/google-news":
            found = market_news(entries, as_of, "https://news.google.com/")
        else:
            found = ADAPTERS[name](entries if name in OF_ENTRIES else of, as_of)
        parts.append(found.drop("source_url"))
    if not parts:
        parts = [valid(payloads.limit(0).select(F.lit("").alias("title"), F.lit("").alias("summary"), F.lit("").alias("url"), as_of.alias("published_at"), "source_id"))]
    return with_source(reduce(DataFrame.unionByName, parts), sources), errors

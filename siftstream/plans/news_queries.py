"""Queries over the domain's own word lists and over landed payloads, both built from the tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import times as T
from ..functions import urls as U
from ..operators import candidates as C
from ..operators import guards as G
from ..operators import review as R
from ..operators import scoring as S
from ..operators import serving as V
from ..operators import state as Z
from ..sources import payloads as P
from ..sources.tables import AS_OF_MS, table
from . import lexicons as L
from .text_queries import now, sql_any, sql_hits, sql_score, sql_text, sql_topics, sql_url

DAY = 86_400_000
#: Every word of the lists, so that each is met in some row.
WORDS = [*L.NEWS.top, *L.NEWS.middle, *L.NEWS.light, *L.NEWS.priority, *L.NEWS.penalised, *L.NEWS.grave, *L.NEWS.serious]
PLACES = [w.strip() for words in L.GEO_TAGS.values() for w in words]
THEMES = [w.strip() for words in L.TOPIC_TAGS.values() for w in words]


def _pick(words, n):
    return F.element_at(F.array(*map(F.lit, words)), (n % len(words) + 1).cast("int"))


def _sql_pick(words, n: str) -> str:
    return f"[{', '.join(map(sql_text, words))}][({n}) % {len(words)} + 1]"


def news(spark, d):
    """Events as headlines that hold words of the lists."""
    e, i = table(spark, d, "events"), F.col("event_id")
    title = F.concat(F.lit("Report: "), F.initcap(_pick(WORDS, i)), F.lit(" and "), _pick(WORDS, F.floor(i / 7) + i * 3), F.lit(" in "), _pick(PLACES, i), F.lit(" today"))
    return e.select(i.alias("id"), title.alias("title"), F.concat(F.lit("More on "), _pick(THEMES, i), F.lit(", "), _pick(PLACES, i * 5), F.lit(" too.")).alias("summary"), (i % 6 + 5).cast("int").alias("weight"), F.timestamp_millis(F.lit(AS_OF_MS) - (i % 300) * 60000).alias("published_at"))


def _sql_cap(words) -> list[str]:
    """Words with each word's first letter in upper case and the rest in lower case, as initcap gives."""
    return [" ".join(x[:1].upper() + x[1:].lower() for x in w.split(" ")) for w in words]


NEWS_SQL = f"""news AS (SELECT event_id AS id, 'Report: ' || {_sql_pick(_sql_cap(WORDS), 'event_id')} || ' and ' || {_sql_pick(WORDS, 'event_id // 7 + event_id * 3')} || ' in ' || {_sql_pick(PLACES, 'event_id')} || ' today' AS title,
 'More on ' || {_sql_pick(THEMES, 'event_id')} || ', ' || {_sql_pick(PLACES, 'event_id * 5')} || ' too.' AS summary, CAST(event_id % 6 + 5 AS INTEGER) AS weight, {AS_OF_MS} - (event_id % 300) * 60000 AS ms FROM events),
 nt AS (SELECT *, lower(title || ' ' || summary) AS t FROM news)"""


def _news_score(spark, d):
    return S.score(news(spark, d), now(), L.NEWS).select("id", "score")


def _news_risk(spark, d):
    r = news(spark, d).withColumn("r", S.risk(F.concat("title", F.lit(" "), "summary"), L.NEWS))
    return r.select("id", F.col("r.level").alias("level"), F.array_join("r.reasons", "|").alias("reasons"))


def _news_words(spark, d):
    return news(spark, d).select("id", F.array_join(S.keywords(S.item_text(), L.NEWS), "|").alias("keywords"), F.array_join(S.topics(F.col("title"), F.col("summary"), L.GEO_TAGS, L.TOPIC_TAGS), "|").alias("topics"))


def _payloads(df, group, field, row):
    """Landed answers: a JSON object a group, with the group's rows under a field."""
    return df.groupBy(group).agg(F.to_json(F.struct(F.collect_list(F.struct(*row)).alias(field))).alias("body"))


def _shown(items):
    return items.select("title", "summary", "url", F.unix_millis("published_at").alias("ms"), "url_hash", "title_hash")


def _sql_shown(source: str, title: str, summary: str, url: str, ms: str, where: str = "true") -> str:
    from .text_queries import sql_title_key

    return f"WITH {source}, o AS (SELECT {title} AS title, substr({summary}, 1, 500) AS summary, {url} AS url, {ms} AS ms FROM s WHERE {where}) SELECT *, sha256({sql_url('url')}) AS url_hash, sha256({sql_title_key('title')}) AS title_hash FROM o"


def _day(n):
    return F.date_format(F.timestamp_millis(F.lit(AS_OF_MS) - n * DAY), "yyyy-MM-dd")


_SQL_DAY = "strftime(make_timestamp(({ms} - ({n}) * 86400000) * 1000), '{f}')"


def _sql_midnight(n: str) -> str:
    return f"(({AS_OF_MS} - ({n}) * {DAY}) // {DAY}) * {DAY}"


def _kev(spark, d):
    k = F.col("p_partkey")
    row = [F.concat(F.lit("CVE-2024-"), (k + 10000).cast("string")).alias("cveID"), F.col("p_type").alias("vendorProject"), F.col("p_brand").alias("product"), F.col("p_name").alias("shortDescription"), F.when(k % 2 == 0, "patch now").alias("requiredAction"), _day(k % 60).alias("dateAdded")]
    good = _payloads(table(spark, d, "part"), "p_size", "vulnerabilities", row).select("body")
    page = good.limit(1).select(F.lit("CVE-2024-99999 from the page Date Added: 2024-01-01").alias("body"))
    return _shown(P.vulnerabilities_or_page(good, page, now()))


def _kev_page(spark, d):
    """The page stands in when the JSON cannot be read."""
    k = F.col("p_partkey")
    page = table(spark, d, "part").select(F.concat(F.lit("<p>CVE-2024-"), (k + 10000).cast("string"), F.lit(" <b>"), "p_name", F.lit("</b> Date Added: "), _day(k % 60), F.lit(" Related CWE: CWE-79</p>")).alias("body"))
    return _shown(P.vulnerabilities_or_page(page.select(F.lit("<html>").alias("body")), page, now()))


def _quakes(spark, d):
    k = F.col("s_suppkey")
    p = F.struct(F.concat(F.lit("M "), (k % 7).cast("string"), F.lit(" quake")).alias("title"), F.when(k % 3 > 0, F.col("s_name")).alias("place"), (k % 7).cast("string").alias("mag"), (F.lit(AS_OF_MS) - k * 1000).alias("time"), F.when(k % 5 > 0, F.concat(F.lit("https://q.test/"), k.cast("string"))).alias("url"))
    return _shown(P.earthquakes(_payloads(table(spark, d, "supplier"), "s_nationkey", "features", [k.cast("string").alias("id"), p.alias("properties")]), now()))


def _alerts(spark, d):
    k = F.col("s_suppkey")
    p = F.struct(F.lit("Flood").alias("event"), F.when(k % 2 == 0, F.col("s_name")).alias("headline"), F.col("s_name").alias("areaDesc"), _pick(["Extreme", "Severe", "Minor"], k).alias("severity"), F.lit("Water rises.").alias("description"), F.when(k % 4 == 0, "Leave.").alias("instruction"), F.concat(_day(k % 9), F.lit("T00:00:00Z")).alias("sent"))
    return _shown(P.weather_alerts(_payloads(table(spark, d, "supplier"), "s_nationkey", "features", [F.concat(F.lit("https://w.test/"), k.cast("string")).alias("id"), p.alias("properties")]), now()))


def _recalls(spark, d):
    k = F.col("p_partkey")
    row = [k.cast("string").alias("event_id"), F.date_format(F.timestamp_millis(F.lit(AS_OF_MS) - (k % 60) * DAY), "yyyyMMdd").alias("report_date"), _pick(["Class I", "Class II", "Class III"], k).alias("classification"), F.repeat("p_name", 8).alias("product_description"), F.col("p_type").alias("recalling_firm"), F.when(k % 2 == 0, "glass").alias("reason_for_recall")]
    return _shown(P.recalls(_payloads(table(spark, d, "part"), "p_size", "results", row), now(), "food"))


def _entries(spark, d):
    e, i = table(spark, d, "events"), F.col("event_id")
    link = F.when(i % 4 > 0, F.concat(F.lit("/n/"), (i % 500).cast("string"), F.lit("?utm_source=x&id="), (i % 3).cast("string")))
    return e.select(
        F.concat(F.lit("Event "), (i % 50).cast("string"), F.lit(" of "), "event_type", F.lit(" - "), _pick(["Reuters", "Some Blog", "BBC News"], i)).alias("title"), link.alias("link"), F.concat(F.lit("https://g.test/"), i.cast("string")).alias("guid"),
        F.lit(None).cast("string").alias("contentSnippet"), F.concat(F.lit("Filed Item "), (i % 9).cast("string"), F.lit(".01: x")).alias("summary"), F.lit(None).cast("string").alias("content"), F.lit(None).cast("string").alias("pubDate"), F.concat(_day(i % 40), F.lit("T00:00:00Z")).alias("isoDate"), F.lit(None).cast("string").alias("updated"), i.alias("position"))


_ENTRIES_SQL = f"""s AS (SELECT event_id AS i, 'Event ' || (event_id % 50) || ' of ' || event_type AS t, ['Reuters', 'Some Blog', 'BBC News'][event_id % 3 + 1] AS p, 'Filed Item ' || (event_id % 9) || '.01: x' AS f,
 CASE WHEN event_id % 4 > 0 THEN '/n/' || (event_id % 500) || '?utm_source=x&id=' || (event_id % 3) END AS link, 'https://g.test/' || event_id AS guid, {_sql_midnight('event_id % 40')} AS ms FROM events)"""
_ENTRY_URL = "CASE WHEN link IS NULL THEN guid ELSE 'https://b.test' || link END"


def _feed_items(spark, d):
    return _shown(P.feed_entries(_entries(spark, d), now(), "https://b.test/feed/x.xml"))


def _filed(spark, d):
    return _shown(P.filings(_entries(spark, d), now()))


def _market_news(spark, d):
    return _shown(P.market_news(_entries(spark, d), now(), "https://b.test/"))


def _searches(spark, d):
    t = table(spark, d, "part").select(F.when(F.col("p_partkey") % 5 > 0, F.col("p_name")).alias("topic"), F.when(F.col("p_partkey") % 7 > 0, F.col("p_retailprice")).alias("volume"))
    return P.topic_searches(t)


def landed_answers(spark, d, n):
    """Markets of one exchange, and the n best events of another."""
    p, k, s, j = table(spark, d, "part"), F.col("p_partkey"), table(spark, d, "supplier"), F.col("s_suppkey")
    row = F.struct(k.cast("string").alias("id"), F.when(k % 9 > 0, F.col("p_name")).alias("question"), (k % 7 == 0).alias("closed"), (k % 5 != 0).alias("active"), F.concat(_day(k % 20 - 10), F.lit("T00:00:00Z")).alias("end_date_iso"), F.when(k % 4 > 0, F.col("p_size").cast("string")).otherwise("many").alias("volume24hr"))
    m = P.market_answers(p.groupBy("p_brand").agg(F.to_json(F.collect_list(row)).alias("body")), now())
    ev = [F.concat(F.lit("E"), j.cast("string")).alias("event_ticker"), F.when(j % 2 == 0, F.col("s_name")).alias("title"), F.concat(F.lit(" sub "), "s_name").alias("sub_title"), F.when(j % 3 == 0, "closed").otherwise("open").alias("status"), F.when(j % 4 == 0, (j * 1.5)).alias("volume_24h"), F.lit(10.0).alias("open_interest")]
    return m, P.event_answers(_payloads(s, "s_nationkey", "events", ev), now(), n)


def _answers(spark, d):
    m, e = landed_answers(spark, d, 5)
    return m.select("market_id", "question", "volume").unionByName(e)


def _sources(spark, d):
    n = table(spark, d, "nation")
    k = F.col("n_nationkey")
    url = F.when(k % 5 == 0, "adapter://usgs/significant-quakes").when(k % 5 == 1, "adapter://no/such").otherwise(F.concat(F.lit("https://b.test/"), k.cast("string")))
    return n.select(k.cast("long").alias("source_id"), url.alias("url"), (k % 4 != 3).cast("int").alias("is_active"), F.col("n_name").alias("name"), F.lit("world").alias("category"), (k % 6 + 5).cast("int").alias("weight"))


def _ingest(spark, d):
    src = _sources(spark, d)
    quake = F.to_json(F.struct(F.array(F.struct(F.struct(F.concat(F.lit("M "), "name").alias("title"), F.concat(F.lit("https://q.test/"), F.col("source_id").cast("string")).alias("url")).alias("properties"))).alias("features")))
    entry = F.to_json(F.array(F.struct(F.concat(F.lit("Story of "), "name").alias("title"), F.concat(F.lit("https://s.test/"), F.col("source_id").cast("string")).alias("link"))))
    landed = src.select("source_id", F.when(F.col("source_id") % 5 == 0, quake).otherwise(entry).alias("body"), F.when(F.col("source_id") % 7 == 6, "timed out").alias("error"))
    items, errors = P.ingest(src, landed, now())
    return items.select("source_id", "title", "source_name", "weight", F.lit(None).cast("string").alias("error")).unionByName(errors.select("source_id", F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("source_name"), F.lit(0).alias("weight"), "error"))


def _actions(spark, d):
    e, i = table(spark, d, "events"), F.col("event_id")
    value = F.struct(_pick(["approve", "reject", "save_edit"], i).alias("action"), i.cast("string").alias("post_id"))
    form = F.create_map(F.concat(F.lit("edited_content_"), i.cast("string")), F.concat(F.lit("text "), i.cast("string")))
    new = F.to_json(F.struct(F.struct(F.concat(F.lit("ev"), i.cast("string")).alias("event_id")).alias("header"), F.struct(F.struct(F.col("user_id").cast("string").alias("open_id"), F.lit("N").alias("user_name")).alias("operator"), F.struct(value.alias("value"), form.alias("form_value")).alias("action"), F.struct(F.lit("m1").alias("open_message_id")).alias("context")).alias("event")))
    old = F.to_json(F.struct(F.concat(F.lit("ev"), i.cast("string")).alias("uuid"), F.col("user_id").cast("string").alias("open_id"), F.lit("m2").alias("open_message_id"), F.struct(F.to_json(value).alias("value"), form.alias("form_value")).alias("action")))
    a = e.withColumn("a", R.action_of(F.when(i % 2 == 0, new).otherwise(old))).select("a.*")
    return a.select("action", "post_id", "open_id", "user_name", "message_id", "event_id", "edited_content")


def _checks(spark, d):
    c = table(spark, d, "conversations")
    entities = F.array(F.lower("role"), F.lit(" X "), F.when(F.col("turn") % 3 > 0, F.lit("Ab")))
    return c.select("conv_id", "turn", "role", G.publishable("text").alias("publishable"), G.reason_given(F.substring("text", 1, 6)).alias("reason"), G.topic_valid(F.col("role"), entities, F.when(F.col("turn") % 2 == 0, "x")).alias("topic"), F.array_join(G.entities_clean(F.array_compact(entities)), "|").alias("entities"))


def _times(spark, d):
    e, i = table(spark, d, "events"), F.col("event_id")
    raw = F.when(i % 3 == 0, F.concat(_day(i % 50), F.lit(" 10:00:00"))).when(i % 3 == 1, F.date_format(F.timestamp_millis(F.lit(AS_OF_MS) - (i % 50) * DAY), "yyyyMMdd")).otherwise("never")
    return e.select("event_id", F.unix_millis(T.parsed(F.when(i % 3 == 1, "never").otherwise(raw), now())).alias("parsed"), F.unix_millis(T.report_date(raw, now())).alias("reported"), T.absolute(F.timestamp_millis(F.lit(AS_OF_MS) - i * 60000)).alias("shown"))


def _texts(spark, d):
    e, i = table(spark, d, "events"), F.col("event_id")
    fenced = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    sums = F.array(F.concat(F.lit("one "), "event_type"), F.repeat("event_type", 60), F.lit("system: three"))
    href = _pick(["https://o.test/x", "//o.test/y", "/z", "rel", "#f", "?q=1"], i)
    return e.select("event_id", X.without_fences(fenced).alias("bare"), X.quoted(F.concat("event_type", F.lit("\nx"))).alias("quoted"), X.prompt_summary(sums).alias("prompt"), U.absolute(href, "https://b.test/a/c.html").alias("href"), V.stable_id("event_id", "event_type").alias("stable"))


def _published(spark, d):
    posts = table(spark, d, "conversations").where("turn = 0").select(F.col("conv_id").alias("post_id"), F.lit("approved").alias("status"), F.col("role").alias("content"))
    out = R.published(posts, posts.where("post_id % 2 = 0"), now())
    log = Z.append_audit(out.select("post_id", F.lit("publish").alias("action")), out.select("post_id", F.lit("click").alias("action"), F.lit("u").alias("user")))
    return out.join(log.groupBy("post_id").agg(F.count(F.lit(1)).alias("logged"), F.max("user").alias("user")), "post_id").select("post_id", "status", F.unix_millis("posted_at").alias("posted_ms"), "intent_url", "logged", "user")


def _generated(spark, d):
    c = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit(" Order of "), "o_orderstatus", F.lit(" ")).alias("headline"))
    return C.generate(c, C.template_post)


def _preview(spark, d):
    o = table(spark, d, "orders")
    clusters = o.select(F.col("o_orderkey").alias("cluster_id"), F.col("o_orderdate").alias("last_updated_at"), F.lit(1).alias("post_count"))
    posts = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("cluster_id"), F.col("l_linenumber").alias("post_id"), F.when(F.col("l_returnflag") == "R", "pending").otherwise("approved").alias("status"), F.col("l_shipdate").alias("created_at"))
    return V.preview(clusters, posts).select("cluster_id", "post_id", "status")


def _joins(spark, d):
    """Items with their source, posts with their cluster, an optional status, and the union of batches."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    items = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("source_id"), F.col("o_orderstatus").alias("status"))
    sources = c.select(F.col("c_custkey").alias("source_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("category"), (F.col("c_custkey") % 6 + 5).alias("weight"))
    all_, some = V.with_status(items, None), V.with_status(items, "F")
    return P.with_source(all_.unionByName(some), sources).select("id", "status", "source_name", "category", "weight")


def _refresh(spark, d):
    """Topics before and after a refresh."""
    from .table_queries import _upsert, market_state

    return market_state(spark, d).agg(F.count(F.lit(1)).alias("before")).crossJoin(_upsert(spark, d).agg(F.count(F.lit(1)).alias("after")))


def _response(spark, d):
    """The feed's 50 best orders: a response holds as many rows as the feed shows."""
    best = V.best(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), 50, F.desc("o_totalprice"), F.col("o_orderkey"))
    return V.as_response(best.select("o_orderkey", "o_orderstatus"), "orders", F.col("o_orderkey"))


MARKETS_SQL = f"""SELECT CAST(p_partkey AS VARCHAR) AS market_id, p_name AS question, CAST(p_size AS DOUBLE) AS volume FROM part WHERE p_partkey % 9 > 0 AND p_partkey % 7 <> 0 AND p_partkey % 5 <> 0 AND p_partkey % 4 > 0 AND p_size > 0 AND {_sql_midnight('p_partkey % 20 - 10')} >= {AS_OF_MS}"""
SALES_SQL = "SELECT 'E' || s_suppkey AS market_id, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'sub ' || s_name END AS question, CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey * 1.5 ELSE 10.0 END AS volume FROM supplier WHERE s_suppkey % 3 <> 0"
_R, _K = "'CISA adds '", P.KEV_PAGE
QUERIES = {
    "news_score": (_news_score, f"WITH {NEWS_SQL} SELECT id, {sql_score('t', 'ms', L.NEWS)} AS score FROM nt"),
    "news_risk": (_news_risk, f"""WITH {NEWS_SQL}, r AS (SELECT id, {sql_hits('t', L.NEWS.grave)} AS g, {sql_hits('t', L.NEWS.serious)} AS s FROM nt)
        SELECT id, CASE WHEN len(g) > 0 THEN 'high' WHEN len(s) > 0 THEN 'medium' ELSE 'low' END AS level, array_to_string(CASE WHEN len(g) > 0 THEN g ELSE s END, '|') AS reasons FROM r"""),
    "news_words": (_news_words, f"WITH {NEWS_SQL} SELECT id, array_to_string({sql_hits('t', (*L.NEWS.top, *L.NEWS.middle))}, '|') AS keywords, array_to_string({sql_topics('t', L.GEO_TAGS, L.TOPIC_TAGS)}, '|') AS topics FROM nt"),
    "kev_items": (_kev, _sql_shown(f"s AS (SELECT *, 'CVE-2024-' || (p_partkey + 10000) AS cve, {_sql_midnight('p_partkey % 60')} AS ms FROM part)", f"{_R} || p_type || ' ' || p_brand || ' vulnerability to KEV catalog'", "p_name || CASE WHEN p_partkey % 2 = 0 THEN ' Required action: patch now' ELSE '' END", f"'{_K}' || cve", "ms", f"ms >= {AS_OF_MS - 30 * DAY}")),
    "kev_page_items": (_kev_page, _sql_shown(f"s AS (SELECT *, 'CVE-2024-' || (p_partkey + 10000) AS cve, {_sql_midnight('p_partkey % 60')} AS ms FROM part)", f"{_R} || cve || ' vulnerability to KEV catalog'", "p_name || ' Date Added: ' || strftime(make_timestamp(ms * 1000), '%Y-%m-%d')", f"'{_K}' || cve", "ms", f"ms >= {AS_OF_MS - 30 * DAY}")),
    "quake_items": (_quakes, _sql_shown("s AS (SELECT *, s_suppkey AS k FROM supplier)", "'M ' || (k % 7) || ' quake'", "'Magnitude ' || (k % 7) || ' earthquake near ' || CASE WHEN k % 3 > 0 THEN s_name ELSE 'unknown location' END || '.'", "'https://q.test/' || k", f"{AS_OF_MS} - k * 1000", "k % 5 > 0")),
    "alert_items": (_alerts, _sql_shown("s AS (SELECT *, s_suppkey AS k FROM supplier)", "CASE WHEN k % 2 = 0 THEN s_name ELSE 'Flood - ' || s_name END", "'Water rises.' || CASE WHEN k % 4 = 0 THEN ' Leave.' ELSE '' END", "'https://w.test/' || k", _sql_midnight("k % 9"), "k % 3 < 2")),
    "recall_items": (_recalls, _sql_shown(f"s AS (SELECT *, p_partkey AS k, repeat(p_name, 8) AS n, {_sql_midnight('p_partkey % 60')} AS ms FROM part)", "'FDA food recall: ' || CASE WHEN length(n) > 130 THEN rtrim(substr(n, 1, 129)) || '…' ELSE n END", "['Class I', 'Class II', 'Class III'][k % 3 + 1] || ' Firm: ' || p_type || CASE WHEN k % 2 = 0 THEN ' Reason: glass' ELSE '' END", "'https://api.fda.gov/food/enforcement.json?search=event_id:' || k || '&limit=1'", "ms", f"k % 3 < 2 AND ms >= {AS_OF_MS - 30 * DAY}")),
    "feed_items": (_feed_items, _sql_shown(_ENTRIES_SQL, "t || ' - ' || p", "f", _ENTRY_URL, "ms")),
    "filing_feed": (_filed, _sql_shown(_ENTRIES_SQL, "t || ' - ' || p", "f", _ENTRY_URL.replace("https://b.test", "https://www.sec.gov"), "ms", f"(i % 9) || '.01' IN ({', '.join(map(sql_text, L.FILING_ITEMS))})")),
    "market_news": (_market_news, _sql_shown(_ENTRIES_SQL.replace("s AS (", "r AS (", 1) + ", s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(link, guid) ORDER BY i) AS rn FROM r) WHERE rn = 1)", "t", "f", _ENTRY_URL, "ms", "p <> 'Some Blog'")),
    "topic_searches": (_searches, """SELECT CAST(row_number() OVER (ORDER BY volume DESC NULLS LAST, topic) AS INTEGER) AS topic_rank, topic, 'https://news.google.com/rss/search?q=' || url_encode(topic || ' when:2d') || '&hl=en-US&gl=US&ceid=US:en' AS url
        FROM (SELECT p_name AS topic, CASE WHEN p_partkey % 7 > 0 THEN p_retailprice END AS volume FROM part WHERE p_partkey % 5 > 0 ORDER BY volume DESC NULLS LAST, topic LIMIT 8)"""),
    "market_answers": (_answers, f"{MARKETS_SQL} UNION ALL SELECT * FROM ({SALES_SQL} ORDER BY volume DESC, market_id LIMIT 5)"),
    "ingest_sources": (_ingest, """WITH s AS (SELECT n_nationkey AS k, n_name AS n, n_nationkey % 7 = 6 AS bad FROM nation WHERE n_nationkey % 4 <> 3)
        SELECT CAST(k AS BIGINT) AS source_id, CASE WHEN k % 5 = 0 THEN 'M ' || n ELSE 'Story of ' || n END AS title, n AS source_name, CAST(k % 6 + 5 AS INTEGER) AS weight, CAST(NULL AS VARCHAR) AS error FROM s WHERE NOT bad AND k % 5 <> 1
        UNION ALL SELECT k, NULL, NULL, 0, 'timed out' FROM s WHERE bad UNION ALL SELECT k, NULL, NULL, 0, 'unknown adapter: adapter://no/such' FROM s WHERE k % 5 = 1"""),
    "review_payloads": (_actions, """SELECT ['approve', 'reject', 'save_edit'][event_id % 3 + 1] AS action, CAST(event_id AS VARCHAR) AS post_id, CAST(user_id AS VARCHAR) AS open_id, CASE WHEN event_id % 2 = 0 THEN 'N' END AS user_name,
        CASE WHEN event_id % 2 = 0 THEN 'm1' ELSE 'm2' END AS message_id, 'ev' || event_id AS event_id, 'text ' || event_id AS edited_content FROM events"""),
    "text_checks": (_checks, """SELECT conv_id, turn, role, length(text) <= 280 AS publishable, length(trim(substr(text, 1, 6))) >= 5 AS reason, turn % 3 > 0 AND turn % 2 = 0 AS topic, lower(role) || CASE WHEN turn % 3 > 0 THEN '|ab' ELSE '' END AS entities FROM conversations"""),
    "parse_times": (_times, f"""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN {_sql_midnight('event_id % 50')} + 36000000 ELSE {AS_OF_MS} END AS parsed, CASE event_id % 3 WHEN 0 THEN {_sql_midnight('event_id % 50')} + 36000000 WHEN 1 THEN {_sql_midnight('event_id % 50')} ELSE {AS_OF_MS} END AS reported,
        strftime(make_timestamp(({AS_OF_MS} - event_id * 60000) * 1000), '%b %-d %H:%M') AS shown FROM events"""),
    "text_forms": (_texts, """SELECT event_id, props AS bare, '> ' || event_type || chr(10) || '> x' AS quoted, substr('one ' || event_type || ' ' || substr(repeat(event_type, 60), 1, 200) || ' [redacted] three', 1, 600) AS prompt,
        ['https://o.test/x', 'https://o.test/y', 'https://b.test/z', 'https://b.test/a/rel', 'https://b.test/a/c.html#f', 'https://b.test/a/c.html?q=1'][event_id % 6 + 1] AS href, sha256(event_id || '|' || event_type) AS stable FROM events"""),
    "publish_posts": (_published, f"SELECT conv_id AS post_id, 'posted' AS status, {AS_OF_MS} AS posted_ms, 'https://twitter.com/intent/tweet?text=' || role AS intent_url, CAST(2 AS BIGINT) AS logged, 'u' AS user FROM conversations WHERE turn = 0 AND conv_id % 2 = 0"),
    "generated_posts": (_generated, "SELECT o_orderkey AS cluster_id, 'pure_news' AS content_mode, 'Breaking: Order of ' || o_orderstatus AS content FROM orders"),
    "preview_posts": (_preview, """WITH c AS (SELECT o_orderkey AS k FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 1), p AS (SELECT l_orderkey AS cluster_id, l_linenumber AS post_id, CASE WHEN l_returnflag = 'R' THEN 'pending' ELSE 'approved' END AS status, l_shipdate FROM lineitem JOIN c ON l_orderkey = k),
        q AS (SELECT * FROM p WHERE status = 'pending' OR NOT EXISTS (SELECT 1 FROM p WHERE status = 'pending')) SELECT cluster_id, post_id, status FROM q ORDER BY l_shipdate DESC, post_id LIMIT 3"""),
    "items_with_source": (_joins, "SELECT o_orderkey AS id, o_orderstatus AS status, c_name AS source_name, c_mktsegment AS category, c_custkey % 6 + 5 AS weight FROM (SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderstatus = 'F') JOIN customer ON o_custkey = c_custkey"),
    "refresh_counts": (_refresh, f"""SELECT (SELECT count(*) FROM part WHERE p_size <= 30) AS before, (SELECT count(*) FROM part WHERE p_size >= 20 OR {AS_OF_MS} - CAST(p_size AS BIGINT) * {DAY} >= {AS_OF_MS - 30 * DAY}) AS after"""),
    "json_response": (_response, """SELECT '{"orders":[' || string_agg('{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}', ',' ORDER BY o_orderkey) || ']}' AS body FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50)"""),
}

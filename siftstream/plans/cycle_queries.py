"""Queries of the chains: admission of items with scores, the generation cycle, review histories, boosts and URLs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls as U
from ..operators import candidates as C
from ..operators import clustering as K
from ..operators import dedup as D
from ..operators import generation as N
from ..operators import markets as M
from ..operators import review as R
from ..operators import scoring as S
from ..operators import state as Z
from ..shared import folder
from ..sources.tables import AS_OF_MS, ITEMS_SQL, items, table
from . import lexicons as L
from .news_queries import MARKETS_SQL, SALES_SQL, landed_answers
from .service_queries import sql_topic_category, sql_topic_words
from .table_queries import CLUSTERS_SQL, DAY, ELIGIBLE_SQL, EVENTS_SQL, GREEDY_SQL, HOUR, WORTHY_SQL, clusters, events, kw_items, market_state
from .table_queries import QUERIES as TABLES
from .text_queries import B, now, sql_score, sql_text, sql_url


def part_entities(spark, d):
    topics = table(spark, d, "part").select(F.split("p_name", " ").alias("entities"), F.col("p_retailprice").alias("volume"))
    return M.entity_volumes(topics)


ENTITIES_SQL = "ent AS (SELECT entity, max(volume) AS volume FROM (SELECT lower(trim(unnest(string_split(p_name, ' ')))) AS entity, p_retailprice AS volume FROM part) WHERE length(entity) >= 3 AND volume > 0 GROUP BY entity)"


def told(spark, d):
    """Items whose summary names a part, in the middle of a word for some."""
    i = items(spark, d)
    p = table(spark, d, "part").select((F.col("p_partkey") * 7).alias("_k"), F.concat(F.lit(" re"), "p_name", F.lit("s ")).alias("_p"))
    i = i.join(p, i["id"] == F.col("_k"), "left")
    return i.withColumn("summary", F.concat("summary", F.coalesce("_p", F.lit("")))).drop("_k", "_p")


TOLD_SQL = f"{ITEMS_SQL}, told AS (SELECT items.*, lower(title || ' ' || summary || coalesce(' re' || p_name || 's ', '')) AS t FROM items LEFT JOIN part ON id = p_partkey * 7)"
_BOOST = "CASE WHEN v > 0 THEN least(3.0, greatest(0.0, 0.5 * log10(v))) ELSE 0.0 END"
BOOST_SQL = f"{TOLD_SQL}, {ENTITIES_SQL}, bo AS (SELECT *, {_BOOST} AS boost FROM (SELECT told.*, (SELECT max(volume) FROM ent WHERE contains(t, entity)) AS v FROM told))"


def _boost(spark, d):
    return M.boosted(told(spark, d), part_entities(spark, d), S.item_text()).select("id", F.round("boost", 9).alias("boost"))


def _boosted_scores(spark, d):
    i = M.boosted(told(spark, d), part_entities(spark, d), S.item_text())
    return S.score(i, now(), B, F.col("boost")).select("id", F.round("score", 9).alias("score"))


def _boosted_sql(score: str) -> str:
    # the boost belongs inside the bounds of the score
    return score.replace("greatest(0.0, ", "greatest(0.0, boost + ", 1)


def _arrivals(spark, d):
    """Pages as items that come in a minute apart, many under URLs and titles that others have."""
    p, k = table(spark, d, "pages"), F.col("page_id")
    url = F.when(k % 4 == 3, F.concat(F.lit("https://b.test/"), (k % 61).cast("string"))).otherwise(U.normalised("url"))
    title = F.when(k % 3 == 1, F.concat(F.lit("Story "), (k % 37).cast("string"))).otherwise(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    return p.select(k.alias("id"), (F.lit(AS_OF_MS) + k * 11 * 60_000).alias("ms"), title.alias("title"), X.hashed(url).alias("url_hash"), X.hashed(X.title_key(title)).alias("title_hash"))


def _admitted(spark, d):
    a = _arrivals(spark, d)
    stored = a.where("id % 10 = 0").withColumn("ms", F.col("ms") - 20 * HOUR)
    new = D.admitted(a.where("id % 10 > 0"), stored.select("url_hash", "title_hash", "ms"))
    scored = S.score(new.select("id", "title", F.lit("").alias("summary"), F.lit(7).alias("weight"), F.timestamp_millis("ms").alias("published_at")), now(), B)
    return scored.withColumn("r", S.risk("title", B)).select("id", "score", F.col("r.level").alias("risk_level"))


def _sql_key(e: str) -> str:
    from .text_queries import sql_title_key

    return sql_title_key(e)


_ARRIVALS_SQL = f"""a AS (SELECT page_id AS id, {AS_OF_MS} + page_id * 660000 AS ms, CASE WHEN page_id % 3 = 1 THEN 'Story ' || (page_id % 37) ELSE regexp_extract(html, '<title>([^<]*)</title>', 1) END AS title,
 CASE WHEN page_id % 4 = 3 THEN 'https://b.test/' || (page_id % 61) ELSE {sql_url('url')} END AS u FROM pages), b AS (SELECT *, {_sql_key('title')} AS k FROM a),
 h AS (SELECT u, k, ms - {20 * HOUR} AS ms FROM b WHERE id % 10 = 0), n AS (SELECT *, row_number() OVER (ORDER BY ms, id) AS rn FROM b WHERE id % 10 > 0 AND u NOT IN (SELECT u FROM h)
  AND NOT EXISTS (SELECT 1 FROM h WHERE h.k = b.k AND b.ms - h.ms < {DAY}))"""
#: One item after another, with the URLs and titles that were admitted so far.
_ADMITTED_SQL = f"""WITH RECURSIVE {_ARRIVALS_SQL}, f AS (SELECT CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS id, CAST([] AS VARCHAR[]) AS us, CAST([] AS STRUCT(k VARCHAR, ms BIGINT)[]) AS ks, false AS ok
  UNION ALL SELECT rn, id, CASE WHEN ok THEN list_append(us, u) ELSE us END, CASE WHEN ok THEN list_append(near, {{'k': k, 'ms': ms}}) ELSE near END, ok FROM (
   SELECT n.rn, n.id, n.u, n.k, n.ms, f.us, list_filter(f.ks, lambda x: n.ms - x.ms < {DAY}) AS near, NOT list_contains(f.us, n.u) AND len(list_filter(f.ks, lambda x: x.k = n.k AND n.ms - x.ms < {DAY})) = 0 AS ok FROM f JOIN n ON n.rn = f.rn + 1)),
 t AS (SELECT n.id, 7 AS weight, ms, lower(title || ' ') AS t, lower(title) AS r FROM n JOIN f ON f.id = n.id WHERE ok)"""


def _sql_level(t: str) -> str:
    from .text_queries import sql_any

    return f"CASE WHEN {sql_any(t, B.grave)} THEN 'high' WHEN {sql_any(t, B.serious)} THEN 'medium' ELSE 'low' END"


LIMIT = 3


def _capped(spark, d):
    return N.rolling_cap(events(spark, d), ["user_id"], "ms", "event_id", LIMIT).select("user_id", "event_id")


_CAPPED_SQL = f"""WITH RECURSIVE {EVENTS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS rn FROM e),
 f AS (SELECT user_id, event_id, rn, [ms] AS ts, true AS ok FROM n WHERE rn = 1 UNION ALL
  SELECT user_id, event_id, rn, CASE WHEN ok THEN list_append(near, ms) ELSE near END, ok FROM (SELECT n.user_id, n.event_id, n.rn, n.ms, list_filter(f.ts, lambda x: n.ms - x < {DAY}) AS near, len(list_filter(f.ts, lambda x: n.ms - x < {DAY})) < {LIMIT} AS ok FROM f JOIN n ON n.user_id = f.user_id AND n.rn = f.rn + 1))
 SELECT user_id, event_id FROM f WHERE ok"""
RUN, ROOM = 50, 12


def _cycle(spark, d):
    from pyspark.sql import Window

    best = C.next_candidates(clusters(spark, d), now(), F.lit(1.5), RUN)
    nth = F.row_number().over(Window.orderBy(F.desc("score"), F.desc("ms"), "id"))
    text = F.when(F.col("id") % 4 == 1, F.concat("headline", F.lit(" rose 12%"))).otherwise(F.col("headline"))
    cand = best.select("id", nth.alias("nth"), F.substring(text, -200, 200).alias("headline"), F.col("headline").alias("context"), "risk_level", "status")
    posts = table(spark, d, "events").where("event_type = 'error' AND value > 95").select(F.col("ts").cast("timestamp").alias("created_at"))
    limit = posts.where(F.col("created_at") > now() - F.make_dt_interval(days=F.lit(1))).count() + ROOM
    return N.cycle(cand, posts, now(), limit).select("id", "outcome", "status", "post_count", "content", "reason")


_CYCLE_SQL = f"""WITH {CLUSTERS_SQL}, c AS (SELECT id, row_number() OVER (ORDER BY score DESC, ms DESC, id) AS nth, headline, risk_level FROM clusters WHERE {ELIGIBLE_SQL} AND {WORTHY_SQL} ORDER BY score DESC, ms DESC, id LIMIT {RUN}),
 w AS (SELECT *, 'BREAKING: ' || trim(CASE WHEN length(CASE WHEN id % 4 = 1 THEN headline || ' rose 12%' ELSE headline END) > 200 THEN right(CASE WHEN id % 4 = 1 THEN headline || ' rose 12%' ELSE headline END, 200) ELSE CASE WHEN id % 4 = 1 THEN headline || ' rose 12%' ELSE headline END END) AS content FROM c),
 v AS (SELECT *, CASE WHEN length(content) < 20 OR length(content) > 400 THEN 'length' WHEN id % 4 = 1 THEN 'fabricated percentage' END AS why FROM w),
 o AS (SELECT *, coalesce(sum(CASE WHEN risk_level <> 'high' AND why IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM v),
 p AS (SELECT *, CASE WHEN done >= {ROOM} THEN 'daily_limit_reached' WHEN risk_level = 'high' THEN 'high_risk_skipped' WHEN why IS NULL THEN 'done' ELSE 'generation_failed' END AS outcome FROM o)
 SELECT id, outcome, CASE WHEN outcome = 'daily_limit_reached' THEN 'new' ELSE outcome END AS status, CAST(CASE WHEN outcome = 'done' THEN 1 ELSE 0 END AS INTEGER) AS post_count, CASE WHEN outcome = 'done' THEN content END AS content,
  CASE outcome WHEN 'high_risk_skipped' THEN 'high_risk_auto_skip' WHEN 'generation_failed' THEN why WHEN 'daily_limit_reached' THEN outcome END AS reason FROM p"""


def review_posts(spark, d):
    c = table(spark, d, "conversations")
    posts = c.groupBy(F.col("conv_id").alias("post_id")).agg(F.lit("pending").alias("status"), F.lit("").alias("reviewed_by"), F.max(F.substring("text", 1, 40)).alias("content"))
    return posts.withColumn("char_count", F.length("content"))


def review_actions(spark, d):
    """Turns as actions; edits repeat what stands there, come in white space, are empty or too long for some."""
    c = table(spark, d, "conversations")
    act = F.element_at(F.array(*map(F.lit, ("save_edit", "approve", "show_edit", "save_edit", "reject"))), ((F.col("turn") + F.col("conv_id")) % 5 + 1).cast("int"))
    edit = F.when(F.col("turn") % 4 == 0, F.concat(F.lit(" same "), (F.col("conv_id") % 3).cast("string"), F.lit("\n"))).when(F.col("turn") % 4 == 1, F.lit(" \t")).otherwise(F.col("text"))
    return c.select(F.col("conv_id").alias("post_id"), act.alias("action"), F.concat("role", F.col("turn").cast("string")).alias("open_id"), edit.alias("edited_content"), "turn")


def _review(spark, d):
    return R.applied(review_posts(spark, d), review_actions(spark, d), "turn")


def _history(spark, d):
    h = R.history(review_posts(spark, d), review_actions(spark, d), "turn")
    return h.select("post_id", "status", "reviewed_by", "char_count", F.sha2("content", 256).alias("content_sha256"), F.coalesce("valid_from.turn", F.lit(-1)).cast("long").alias("valid_from"), F.coalesce("valid_to.turn", F.lit(-1)).cast("long").alias("valid_to"))


#: One action after another, on the post as it is by then.
REVIEW_SQL = """a AS (SELECT conv_id, turn, ['save_edit', 'approve', 'show_edit', 'save_edit', 'reject'][(turn + conv_id) % 5 + 1] AS act, role || turn AS who,
  regexp_replace(CASE turn % 4 WHEN 0 THEN ' same ' || (conv_id % 3) || chr(10) WHEN 1 THEN ' ' || chr(9) ELSE text END, '^\\s+|\\s+$', '', 'g') AS ed, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
 p AS (SELECT conv_id, max(substr(text, 1, 40)) AS content FROM conversations GROUP BY 1),
 f AS (SELECT conv_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS turn, 'pending' AS status, '' AS who, content, CAST(length(content) AS BIGINT) AS n, true AS changed FROM p
  UNION ALL SELECT conv_id, rn, turn, CASE act WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' ELSE status END, CASE WHEN changed THEN new_who ELSE who END, CASE WHEN edits THEN ed ELSE content END, CASE WHEN edits THEN length(ed) ELSE n END, changed FROM (
   SELECT x.*, act IN ('approve', 'reject') OR edits AS changed FROM (SELECT f.conv_id, a.rn, CAST(a.turn AS BIGINT) AS turn, f.status, f.who, a.who AS new_who, f.content, f.n, a.ed, a.act, a.act = 'save_edit' AND a.ed <> '' AND length(a.ed) <= 280 AND a.ed <> f.content AS edits FROM f JOIN a ON a.conv_id = f.conv_id AND a.rn = f.rn + 1) x))"""

REFERENCES = ["../x", "./y", "../../z?q=1", "/abs/../k", "//Other.TEST:443/a", "p.html#f", "?q=2", "#top", "https://h.test:443/a/./b/../c", "..", "", "mailto:a@b.test", "a/%2E%2e/b/"]


def _resolved(spark, d):
    p = table(spark, d, "pages")
    ref = F.element_at(F.array(*map(F.lit, REFERENCES)), (F.col("page_id") % len(REFERENCES) + 1).cast("int"))
    base = F.when(F.col("page_id") % 2 == 0, F.replace("url", F.lit("/en/"), F.lit(":443/en/deep/"))).otherwise(F.col("url"))
    return p.select("page_id", U.absolute(ref, base).alias("href"), U.normalised(U.absolute(ref, base)).alias("normal"))


_PARTS = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
_DOTS = "list_reduce(list_prepend('', string_split({p}, '/')[2:]), lambda acc, x: CASE WHEN replace(lower(x), '%2e', '.') = '..' THEN regexp_replace(acc, '/[^/]*$', '') WHEN x = '.' THEN acc ELSE acc || '/' || x END)"


def _sql_resolved() -> str:
    g = lambda n: f"regexp_extract(base, '{_PARTS}', {n})"
    refs = ", ".join(map(sql_text, REFERENCES))
    raw = "CASE WHEN r LIKE 'https:%' THEN regexp_extract(r, 'https://[^/]*([^?#]*)', 1) WHEN r LIKE '//%' THEN '/a' WHEN rp = '' THEN bp WHEN rp LIKE '/%' THEN rp ELSE regexp_replace(CASE WHEN bp = '' THEN '/' ELSE bp END, '[^/]*$', '') || rp END"
    fixed = _DOTS.format(p="rawp")
    path = f"CASE WHEN {fixed} = '' THEN '/' WHEN regexp_matches(rawp, '/[.][.]?$') THEN {fixed} || '/' ELSE {fixed} END"
    host = "CASE WHEN r LIKE 'https:%' THEN 'h.test' WHEN r LIKE '//%' THEN CASE WHEN sch = 'https' THEN 'other.test' ELSE 'other.test:443' END ELSE CASE WHEN sch = 'https' THEN regexp_replace(lower(bh), ':443$', '') ELSE lower(bh) END END"
    query = "CASE WHEN rp = '' AND r NOT LIKE '//%' AND r NOT LIKE 'https:%' AND rq = '' THEN CASE WHEN bq = '' THEN '' ELSE '?' || bq END ELSE rq END"
    return f"""WITH b AS (SELECT page_id, [{refs}][page_id % {len(REFERENCES)} + 1] AS r, CASE WHEN page_id % 2 = 0 THEN replace(url, '/en/', ':443/en/deep/') ELSE url END AS base FROM pages),
 c AS (SELECT page_id, r, lower({g(1)}) AS sch, {g(2)} AS bh, {g(3)} AS bp, {g(4)} AS bq, regexp_extract(r, '^([^?#]*)', 1) AS rp, regexp_extract(r, '([?][^#]*)', 1) AS rq, regexp_extract(r, '(#.*)$', 1) AS rf FROM b), d AS (SELECT *, {raw} AS rawp FROM c),
 e AS (SELECT page_id, CASE WHEN r LIKE 'mailto:%' THEN r ELSE CASE WHEN r LIKE 'https:%' THEN 'https' ELSE sch END || '://' || {host} || {path} || {query} || rf END AS href FROM d)
 SELECT page_id, href, {sql_url('href')} AS normal FROM e"""


def _in_rounds(spark, d):
    """Leaders by rounds alone, as categories too large for a task have them."""
    return K.greedy_clusters(kw_items(spark, d), fold_items=0)


def _bucketed(spark, d):
    """The market upsert between two tables in buckets of their key."""
    batch = table(spark, d, "part").where("p_size >= 20").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit("?")).alias("question"), (F.col("p_retailprice") * 2).alias("volume"), F.lit("new").alias("topic"), now().alias("last_seen"))
    at = folder(spark, "buckets")
    name = "siftstream_" + at.rsplit("-", 1)[-1]
    state = Z.saved_in_buckets(market_state(spark, d), f"{name}_state", f"{at}/state", "id", 8)
    new = Z.saved_in_buckets(batch, f"{name}_batch", f"{at}/batch", "id", 8)
    return M.refreshed(state, new, now()).select("id", "question", "volume", "topic", F.unix_millis("last_seen").alias("seen_ms"))


def _retained(spark, d):
    e = events(spark, d).withColumn("at", F.timestamp_millis("ms"))
    kept = Z.saved_by_day(e.select("event_id", "at"), folder(spark, "days"), "at")
    since = F.timestamp_millis(F.lit(AS_OF_MS + 3 * DAY))
    return Z.retained(kept, "at", since, F.col("event_id") % 2 == 0, F.timestamp_millis(F.lit(AS_OF_MS + 9 * DAY))).select("event_id")


def _unprocessed(spark, d):
    i = items(spark, d).withColumn("is_processed", F.when(F.col("id") % 3 > 0, F.col("id") % 3 == 1))
    return K.unprocessed_recent(i, now()).select("id", "category")


CATEGORIES = [*L.CATEGORY_LABELS, "unlisted"]
TAGS = [*list(L.TAG_LABELS)[:3], "#own"]
_LINKED = " see https://x.test/a?b=1"


def _at(values, k):
    return F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))


def _cards(spark, d):
    """Conversations as clusters whose turns are posts; every third headline has quotes, some texts a link."""
    c = table(spark, d, "conversations")
    mode = _at([*L.MODE_BADGES, "own"], F.col("turn") + F.col("conv_id"))
    text = F.concat("text", F.when(F.col("conv_id") % 5 == 0, _LINKED + "\n").otherwise(""))
    post = F.struct("turn", F.concat_ws("-", "conv_id", "turn").alias("post_id"), mode.alias("content_mode"), text.alias("content"), "role")
    g = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(post)).alias("posts"))
    k = F.col("conv_id")
    g = g.select(
        k, F.concat(F.lit("Conversation "), F.when(k % 3 == 0, '"').otherwise(""), k.cast("string")).alias("headline"), _at(CATEGORIES, k).alias("category"), _at(["low", "medium", "high"], k).alias("risk_level"),
        F.array(F.lit("one"), F.lit("two")).alias("risk_reasons"), F.array(_at(TAGS, k), F.lit("#all")).alias("topics"), (k % 200 / 20).alias("score"), F.col("posts.role").alias("source_names"),
        F.timestamp_millis(AS_OF_MS - k % 4000 * 60_000).alias("earliest"), "posts")
    return g.select("conv_id", R.card(now()).alias("card"))


def _sql_of(values, k: str) -> str:
    return f"[{', '.join(map(sql_text, values))}][{k} % {len(values)} + 1]"


#: One decimal: halves of twentieths go up, others are as printf has them.
_TENTHS = "CASE WHEN k % 200 % 5 = 0 THEN ((k % 200 + 1) // 2 // 10) || '.' || ((k % 200 + 1) // 2 % 10) ELSE printf('%.1f', (k % 200) / 20.0) END"
_CARDS_SQL = f"""WITH p AS (SELECT conv_id AS k, turn, role, (turn + conv_id) % 4 AS m, text || CASE WHEN conv_id % 5 = 0 THEN {sql_text(_LINKED)} || chr(10) ELSE '' END AS t FROM conversations),
 q AS (SELECT k, turn, role, m, CASE WHEN m = 0 THEN trim(regexp_replace(t, 'https?://[^ \t\n\x0B\f\r]+', '', 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) ELSE t END AS s FROM p),
 g AS (SELECT k, string_agg('{{"post_id":"' || k || '-' || turn || '","badge":' || to_json({_sql_of([*L.MODE_BADGES.values(), "own"], "m")}) || ',"chars":' || length(s) || ',"text":' || to_json('> ' || replace(s, chr(10), chr(10) || '> ')) || '}}', ',' ORDER BY turn, role, s) AS posts,
  array_to_string(list_filter(list(role ORDER BY turn, s), lambda r, i: list_position(list(role ORDER BY turn, s), r) = i)[1:3], ', ') AS sources FROM q GROUP BY k)
 SELECT k AS conv_id, '{{"template":"' || ['green', 'orange', 'red'][k % 3 + 1] || '","title":' || to_json('Conversation ' || CASE WHEN k % 3 = 0 THEN '"' ELSE '' END || k) || ',"category":' || to_json({_sql_of([*L.CATEGORY_LABELS.values(), "unlisted"], "k")})
  || ',"score":"' || {_TENTHS} || '","sources":' || to_json(sources) || ',"ago":"' || CASE WHEN k % 4000 < 1 THEN 'just now' WHEN k % 4000 < 60 THEN (k % 4000) || 'min ago' WHEN k % 4000 < 1440 THEN (k % 4000 // 60) || 'h ago' ELSE (k % 4000 // 1440) || 'd ago' END
  || '","at":"' || strftime(make_timestamp(({AS_OF_MS} - k % 4000 * 60000) * 1000), '%b %-d %H:%M') || '","tags":' || to_json({_sql_of([*list(L.TAG_LABELS.values())[:3], "#own"], "k")} || '  #all')
  || CASE WHEN k % 3 > 0 THEN ',"risk":"one, two"' ELSE '' END || ',"posts":[' || posts || ']}}' AS card FROM g"""


def _bot_status(spark, d):
    """Turns as the bot's actions, each role a chat of its own."""
    c = table(spark, d, "conversations")
    acts = c.select("role", _at(["pause", "note", "resume"], F.col("conv_id") + F.col("turn")).alias("action"), "conv_id", "turn")
    of = lambda r: R.paused(acts.where(F.col("role") == r), F.col("conv_id"), F.col("turn")).select(F.lit(r).alias("role"), R.status_card(F.col("paused")).alias("card"))
    return of("user").unionByName(of("assistant")).unionByName(of("nobody"))


_BOT_SQL = """WITH l AS (SELECT role, max_by((conv_id + turn) % 3 = 0, struct_pack(c := conv_id, t := turn)) AS p FROM conversations WHERE (conv_id + turn) % 3 <> 1 GROUP BY role), r AS (SELECT role, coalesce(p, false) AS p FROM (VALUES ('user'), ('assistant'), ('nobody')) v(role) LEFT JOIN l USING (role))
 SELECT role, CASE WHEN p THEN '{"template":"grey","title":"⏸ Bot Paused","text":"The bot is now **paused**. No new posts will be sent until you resume.","button":{"text":"▶️ Resume Bot","type":"primary","action":"resume_bot"}}'
  ELSE '{"template":"green","title":"▶️ Bot Resumed","text":"The bot is now **active**. New high-scoring posts will be sent.","button":{"text":"⏸ Pause Bot","type":"default","action":"pause_bot"}}' END AS card FROM r"""


def _market_run(spark, d):
    """Topics before a run, the run's markets, and the topics after it."""
    p, k = table(spark, d, "part"), F.col("p_partkey").cast("string")
    seen = F.timestamp_millis(AS_OF_MS - F.col("p_size").cast("long") * DAY)
    before = p.where("p_partkey % 3 = 0").select(
        F.concat(F.lit("polymarket:"), k).alias("id"), F.lit("polymarket").alias("source"), k.alias("market_id"), F.concat("p_name", F.lit("?")).alias("question"), F.lit(1.0).alias("volume"),
        F.col("p_brand").alias("topic"), F.array("p_type").alias("entities"), F.lit("other").alias("category"), seen.alias("extracted_at"), seen.alias("last_seen"))
    m, e = landed_answers(spark, d, 50)
    batch = M.landed({"polymarket": m, "kalshi": e})
    known = p.where("p_partkey % 2 = 0").select(F.concat(F.lit("polymarket:"), k).alias("id"), F.concat(F.lit('{"topic":"T'), k, F.lit('","entities":["ab","cd"],"category":"other"}')).alias("answer"))
    return before, batch, M.refresh(before, batch, known, now())


def _market_refresh(spark, d):
    after = _market_run(spark, d)[2]
    return after.select("id", "source", "question", "volume", "topic", F.array_join("entities", "|").alias("entities"), "category", F.unix_millis("extracted_at").alias("extracted_ms"), F.unix_millis("last_seen").alias("seen_ms"))


def _market_report(spark, d):
    before, batch, after = _market_run(spark, d)
    return M.run_report(before, batch, after, ["polymarket", "kalshi"])


_RUN_SQL = f"""WITH m AS (SELECT * FROM ({MARKETS_SQL}) ORDER BY volume DESC, market_id LIMIT 50), e AS (SELECT * FROM ({SALES_SQL}) ORDER BY volume DESC, market_id LIMIT 50),
 b AS (SELECT 'polymarket' AS source, * FROM m UNION ALL SELECT 'kalshi', * FROM e), s AS (SELECT 'polymarket:' || p_partkey AS id, p_name || '?' AS question, p_brand, p_type, {AS_OF_MS} - CAST(p_size AS BIGINT) * {DAY} AS ms FROM part WHERE p_partkey % 3 = 0),
 j AS (SELECT coalesce(s.id, b.source || ':' || market_id) AS id, coalesce(b.source, 'polymarket') AS source, coalesce(b.question, s.question) AS question, coalesce(volume, 1.0) AS volume, s.id IS NOT NULL AS old, b.source = 'polymarket' AND TRY_CAST(market_id AS BIGINT) % 2 = 0 AS known, market_id,
  p_brand, p_type, ms, {sql_topic_words('b.question')} AS w, b.source IS NOT NULL AS seen FROM s FULL JOIN b ON s.id = b.source || ':' || market_id),
 a AS (SELECT id, source, question, volume, CASE WHEN old THEN p_brand WHEN known THEN 'T' || market_id ELSE array_to_string(w[1:6], ' ') END AS topic, CASE WHEN old THEN p_type WHEN known THEN 'ab|cd' ELSE array_to_string(w[1:8], '|') END AS entities,
  CASE WHEN old OR known THEN 'other' ELSE {sql_topic_category('w')} END AS category, CASE WHEN old THEN ms ELSE {AS_OF_MS} END AS extracted_ms, CASE WHEN seen THEN {AS_OF_MS} ELSE ms END AS seen_ms FROM j WHERE seen OR ms >= {AS_OF_MS - 30 * DAY})"""


def _deferred(spark, d):
    return C.taken_and_deferred(clusters(spark, d), now(), F.lit(1.5))


_DEFERRED_SQL = f"WITH {CLUSTERS_SQL} SELECT count(*) AS candidates, least(count(*), 2) AS taken, greatest(count(*) - 2, 0) AS deferred FROM clusters WHERE {ELIGIBLE_SQL} AND {WORTHY_SQL}"

QUERIES = {
    "review_cards": (_cards, _CARDS_SQL),
    "bot_status": (_bot_status, _BOT_SQL),
    "market_refresh": (_market_refresh, f"{_RUN_SQL} SELECT * FROM a"),
    "market_report": (_market_report, f"{_RUN_SQL} SELECT (SELECT count(*) FROM m) AS polymarket, (SELECT count(*) FROM e) AS kalshi, greatest((SELECT count(*) FROM a) - (SELECT count(*) FROM s), 0) AS new_topics"),
    "candidates_run": (_deferred, _DEFERRED_SQL),
    "bucketed_upsert": (_bucketed, TABLES["market_upsert"][1]),
    "retained_by_day": (_retained, f"WITH {EVENTS_SQL} SELECT event_id FROM e WHERE ms >= {AS_OF_MS + 3 * DAY} AND NOT (event_id % 2 = 0 AND ms < {AS_OF_MS + 9 * DAY})"),
    "unprocessed_recent": (_unprocessed, f"WITH {ITEMS_SQL} SELECT id, category FROM items WHERE id % 3 <> 1 AND ms > {AS_OF_MS - 4 * HOUR}"),
    "clusters_in_rounds": (_in_rounds, f"WITH RECURSIVE {ITEMS_SQL}, {GREEDY_SQL} SELECT id, category, leader FROM g"),
    "entity_boost": (_boost, f"WITH {BOOST_SQL} SELECT id, round(boost, 9) AS boost FROM bo"),
    "boosted_scores": (_boosted_scores, f"WITH {BOOST_SQL} SELECT id, round({_boosted_sql(sql_score())}, 9) AS score FROM bo"),
    "ingest_admitted": (_admitted, f"{_ADMITTED_SQL} SELECT id, {sql_score()} AS score, {_sql_level('r')} AS risk_level FROM t"),
    "admitted_posts": (_capped, _CAPPED_SQL),
    "generation_cycle": (_cycle, _CYCLE_SQL),
    "review_transitions": (_review, f"WITH RECURSIVE {REVIEW_SQL} SELECT conv_id AS post_id, status, who AS reviewed_by, content, CAST(n AS INTEGER) AS char_count FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY rn DESC) AS k FROM f) WHERE k = 1"),
    "review_history": (_history, f"""WITH RECURSIVE {REVIEW_SQL} SELECT conv_id AS post_id, status, who AS reviewed_by, CAST(n AS INTEGER) AS char_count, sha256(content) AS content_sha256, coalesce(turn, -1) AS valid_from, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY rn), -1) AS valid_to FROM f WHERE changed"""),
    "url_resolve": (_resolved, _sql_resolved()),
}

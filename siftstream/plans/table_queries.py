"""Queries of the serving, state, market, dedup and clustering operators, with SQL for DuckDB where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import candidates as C
from ..operators import clustering as K
from ..operators import dedup as D
from ..operators import guards as G
from ..operators import markets as M
from ..operators import scoring as S
from ..operators import serving as V
from ..operators import state as Z
from ..shared import written
from ..sources.tables import AS_OF_MS, ITEMS_SQL, items, table
from . import lexicons as L
from .text_queries import B, SCORED_SQL, now, scored, sql_any, sql_hits, sql_title_key, sql_topics, sql_url

DAY, HOUR = 86_400_000, 3_600_000


def events(spark, d):
    e = table(spark, d, "events")
    return e.withColumn("ms", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000))


EVENTS_SQL = "e AS (SELECT *, epoch_us(ts) // 1000 AS ms FROM events)"


def clusters(spark, d):
    """Scored items as clusters."""
    r = scored(spark, d).withColumn("r", S.risk(F.concat("title", F.lit(" "), "summary"), B))
    return r.select("id", F.col("title").alias("headline"), "score", F.col("r.level").alias("risk_level"), F.when(F.col("id") % 5 == 0, "done").otherwise("new").alias("status"), (F.col("id") % 3).alias("post_count"), F.col("published_at").alias("first_seen_at"), "ms")


CLUSTERS_SQL = f"""{SCORED_SQL}, clusters AS (SELECT id, title AS headline, score, CASE WHEN {sql_any('t', B.grave)} THEN 'high' WHEN {sql_any('t', B.serious)} THEN 'medium' ELSE 'low' END AS risk_level,
 CASE WHEN id % 5 = 0 THEN 'done' ELSE 'new' END AS status, id % 3 AS post_count, ms FROM scored)"""
ELIGIBLE_SQL = f"status = 'new' AND post_count = 0 AND ms > {AS_OF_MS - 6 * HOUR} AND score >= 1.5"
_H = "regexp_replace(headline, '^[ \\t\\n\\f\\r]+|[ \\t\\n\\f\\r]+$', '', 'g')"
WORTHY_SQL = f"(length({_H}) >= 10 AND NOT regexp_matches(lower({_H}), '{'|'.join(L.LOW_SIGNAL)}'))"


def _title_dedup(spark, d):
    i = items(spark, d).withColumn("h", X.hashed(X.title_key("title")))
    return D.window_dedup(i, ["h"], "ms", "id", DAY).select("id", F.col("h").alias("title_hash"))


def _fold_sql(source: str, keys: str, gap: int, out: str) -> str:
    names = [k.strip() for k in keys.split(",")]
    on = " AND ".join(f"a.{k} = b.{k}" for k in names)
    return f"""WITH RECURSIVE {source}, n AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ms, i) AS rn FROM src),
        f AS (SELECT {keys}, i, ms, rn, ms AS last, true AS kept FROM n WHERE rn = 1 UNION ALL
          SELECT {', '.join('b.' + k for k in names)}, b.i, b.ms, b.rn, CASE WHEN b.ms >= a.last + {gap} THEN b.ms ELSE a.last END, b.ms >= a.last + {gap} FROM f a JOIN n b ON {on} AND b.rn = a.rn + 1)
        SELECT {out} FROM f WHERE kept"""


def _event_fold(spark, d):
    return D.window_dedup(events(spark, d), ["user_id", "event_type"], "ms", "event_id", DAY)


def _unseen(spark, d):
    docs, seen = table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels")
    return D.unseen(docs, seen, "doc_id")


def _insert_absent(spark, d):
    base = table(spark, d, "labels").where("quality IS NOT NULL").select("doc_id", "quality")
    return Z.insert_absent(base, table(spark, d, "documents").select("doc_id", F.lit(-1).alias("quality")), "doc_id")


def kw_items(spark, d):
    return items(spark, d).withColumn("keywords", S.keywords(S.item_text(), B))


def _pairs(spark, d):
    return K.pair_overlap(kw_items(spark, d))


def _clusters(spark, d):
    return K.greedy_clusters(kw_items(spark, d))


def _cluster_rows(spark, d):
    i = kw_items(spark, d).join(scored(spark, d).select("id", "score"), "id").withColumn("r", S.risk(F.concat("title", F.lit(" "), "summary"), B))
    return i.select("id", "ms", "category", "title", "summary", "score", F.col("r.level").alias("level"), F.col("r.reasons").alias("reasons"), "keywords")


def _summaries(spark, d):
    leaders = _clusters(spark, d).select("id", "leader")
    return K.summaries(_cluster_rows(spark, d).join(leaders, "id"), L.BENCH_GEO, L.BENCH_TOPICS)


def _joined(c):
    return F.array_join(c, "|")


def _summary(spark, d):
    s = _summaries(spark, d)
    return s.select("cluster_id", "category", "headline", "score", "risk_level", "source_count", "first_ms", _joined(F.transform("item_ids", lambda x: x.cast("string"))).alias("item_ids"), F.sha2(_joined("summaries"), 256).alias("summaries_sha256"))


def _summary_sets(spark, d):
    return _summaries(spark, d).select("cluster_id", _joined("risk_reasons").alias("risk_reasons"), _joined("keywords").alias("keywords"), _joined("topics").alias("topics"))


def _merge(spark, d):
    kw = lambda c: S.keywords(F.lower(c), B)
    s = _summaries(spark, d).withColumn("headline_keywords", kw(F.col("headline"))).withColumn("summary_keywords", kw(F.array_join("summaries", " ")))
    s = written(s, "summaries")
    old = F.pmod("cluster_id", F.lit(4)) == 0
    seen = (F.lit(AS_OF_MS) - F.pmod("cluster_id", F.lit(90)) * 60000).alias("first_ms")
    events = s.where(old).drop("first_ms").select("*", seen, F.lit(0).cast("long").alias("last_ms"))
    out = K.merge_recent(events, s.where(~old), AS_OF_MS)
    ids = _joined(F.transform("item_ids", lambda x: x.cast("string")))
    return out.select("cluster_id", "category", "headline", "score", "risk_level", "first_ms", "last_ms", "source_count", "changed", ids.alias("item_ids"), F.sha2(_joined("summaries"), 256).alias("summaries_sha256"), _joined("risk_reasons").alias("risk_reasons"))


_KW = sql_hits("lower(title || ' ' || summary)", (*B.top, *B.middle))
#: Greedy leaders: a step for each item of a category, with the leaders that are still in the window.
GREEDY_SQL = f"""kw AS (SELECT id, category, ms, {_KW} AS kw FROM items), n AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY ms, id) AS rn FROM kw),
 g AS (SELECT category, id, rn, id AS leader, [{{'id': id, 'ms': ms, 'kw': kw}}] AS open FROM n WHERE rn = 1
  UNION ALL SELECT category, id, rn, coalesce(hit, id), CASE WHEN hit IS NULL THEN list_append(near, {{'id': id, 'ms': ms, 'kw': kw}}) ELSE near END FROM (
   SELECT *, (list_filter(near, lambda x: len(list_intersect(x.kw, kw)) >= 2)[1]).id AS hit FROM (SELECT n.category, n.id, n.rn, n.ms, n.kw, list_filter(g.open, lambda x: n.ms - x.ms <= {K.WINDOW_MS}) AS near FROM g JOIN n ON n.category = g.category AND n.rn = g.rn + 1)))"""
SUMMARY_SQL = f"""{SCORED_SQL}, {GREEDY_SQL}, x AS (SELECT scored.*, leader, {sql_hits('t', B.grave)} AS gr, {sql_hits('t', B.serious)} AS se, {sql_hits('t', (*B.top, *B.middle))} AS kw FROM scored JOIN g USING (id)),
 y AS (SELECT *, CASE WHEN len(gr) > 0 THEN gr ELSE se END AS reasons, CASE WHEN len(gr) > 0 THEN 3 WHEN len(se) > 0 THEN 2 ELSE 1 END AS rank FROM x),
 z AS (SELECT leader AS cluster_id, x.category, arg_max(title, (score, -ms, -id)) AS headline, max(score) AS score, CASE max(rank) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS risk_level,
  flatten(list(reasons ORDER BY ms, id)) AS reasons, count(*) AS source_count, list(id ORDER BY ms, id) AS ids, list(summary ORDER BY ms, id) FILTER (summary <> '') AS sums, flatten(list(kw ORDER BY ms, id)) AS kws, min(ms) AS first_ms FROM y x GROUP BY leader, x.category)"""


def sql_distinct(c: str) -> str:
    """A list's distinct members in the order of their first places."""
    return f"list_filter({c}, lambda v, i: list_position({c}, v) = i)"


MERGE_SQL = f"""{SUMMARY_SQL}, c AS (SELECT *, coalesce(sums, []) AS ss, {sql_distinct('reasons')} AS rr, {sql_hits('lower(headline)', (*B.top, *B.middle))} AS hk, {sql_hits("lower(array_to_string(coalesce(sums, []), ' '))", (*B.top, *B.middle))} AS sk, cluster_id % 4 = 0 AS old, {AS_OF_MS} - (cluster_id % 90) * 60000 AS seen FROM z),
 ev AS (SELECT category, struct_pack(id := cluster_id, headline := headline, score := score, risk := risk_level, rr := rr, hk := hk, sk := sk, ids := ids, ss := ss, seen := CASE WHEN old THEN seen ELSE {AS_OF_MS} END, ch := NOT old) AS e, kws, old, seen, cluster_id, score FROM c),
 nw AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY cluster_id) AS rn FROM ev WHERE NOT old),
 m AS (SELECT k.category, CAST(0 AS BIGINT) AS rn, coalesce((SELECT list(e ORDER BY seen, cluster_id) FROM ev WHERE ev.category = k.category AND old AND seen > {AS_OF_MS - K.MERGE_MS}), []) AS es FROM (SELECT DISTINCT category FROM ev) k
  UNION ALL SELECT category, rn, CASE WHEN coalesce(hit, 0) = 0 THEN list_append(es, e) ELSE list_transform(es, lambda x, i: CASE WHEN i = hit THEN struct_pack(id := x.id, headline := CASE WHEN score > x.score THEN e.headline ELSE x.headline END, score := greatest(score, x.score), risk := x.risk, rr := x.rr,
    hk := CASE WHEN score > x.score THEN e.hk ELSE x.hk END, sk := list_concat(x.sk, e.sk), ids := list_concat(x.ids, e.ids), ss := list_concat(x.ss, e.ss), seen := x.seen, ch := true) ELSE x END) END FROM (
   SELECT nw.category, nw.rn, nw.e, nw.score, m.es, list_position(list_transform(m.es, lambda x: len(list_intersect(list_distinct(list_concat(x.hk, x.sk)), list_distinct(nw.kws))) >= 2), true) AS hit FROM m JOIN nw ON nw.category = m.category AND nw.rn = m.rn + 1)),
 l AS (SELECT category, unnest(arg_max(es, rn)) AS e FROM m GROUP BY category UNION ALL SELECT category, e FROM ev WHERE old AND seen <= {AS_OF_MS - K.MERGE_MS})"""


def _markets(spark, d):
    p = table(spark, d, "part").select(F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("market_id"), F.col("p_name").alias("question"), (F.col("p_partkey") % 7 == 0).alias("closed"), (F.col("p_partkey") % 5 != 0).alias("active"), F.lit(None).cast("timestamp").alias("ends_at"), F.col("p_retailprice").alias("volume"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("k:"), F.col("s_suppkey").cast("string")).alias("market_id"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("title"), F.col("s_name").alias("sub_title"), F.when(F.col("s_suppkey") % 3 == 0, "closed").alias("status"), F.lit(None).cast("timestamp").alias("ends_at"), F.when(F.col("s_suppkey") % 4 == 0, F.col("s_acctbal")).alias("volume_24h"), F.lit(10.0).alias("open_interest"))
    both = M.open_markets(p, now()).select("market_id", "question", "volume").unionByName(M.open_events(s, now()))
    return M.top_by_volume(both, 50, "market_id")


def market_state(spark, d):
    p = table(spark, d, "part").where("p_size <= 30")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("question"), F.col("p_retailprice").alias("volume"), F.col("p_brand").alias("topic"), F.timestamp_millis(AS_OF_MS - F.col("p_size").cast("long") * DAY).alias("last_seen"))


def _upsert(spark, d):
    batch = table(spark, d, "part").where("p_size >= 20").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit("?")).alias("question"), (F.col("p_retailprice") * 2).alias("volume"), F.lit("new").alias("topic"), now().alias("last_seen"))
    return M.refreshed(market_state(spark, d), batch, now()).select("id", "question", "volume", "topic", F.unix_millis("last_seen").alias("seen_ms"))


def _entities(spark, d):
    topics = table(spark, d, "part").select(F.split("p_name", " ").alias("entities"), F.col("p_retailprice").alias("volume"))
    return M.entity_volumes(topics)


def _latest(spark, d):
    c = table(spark, d, "conversations").where(F.col("role").isin("user", "assistant"))
    return V.latest_of_each(c.select("conv_id", "role", "turn", F.length("text").cast("long").alias("n")), ["conv_id", "role"], F.desc("turn"), F.desc("n"))


def _feed(spark, d):
    top = V.best(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 50, F.desc("o_totalprice"), F.col("o_orderkey"))
    out = V.with_children(top, table(spark, d, "lineitem"), "o_orderkey", "l_orderkey", F.col("l_linenumber"), "lines")
    return out.select("o_orderkey", "o_totalprice", F.coalesce(F.array_join("lines", ","), F.lit("")).alias("lines"))


def _semi(spark, d):
    o = V.having(table(spark, d, "orders"), table(spark, d, "lineitem").where("l_returnflag = 'R' AND l_quantity >= 45"), "o_orderkey", "l_orderkey")
    return o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(5).select("o_orderkey", "o_totalprice")


def _members(spark, d):
    li = table(spark, d, "lineitem")
    arrays = li.groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_set("l_partkey")).alias("ids"))
    j = V.members(arrays, table(spark, d, "part").select("p_partkey", "p_brand", "p_size"), "ids", "p_partkey", 3)
    return j.groupBy("k").agg(F.array_join(F.slice(F.array_sort(F.collect_set("p_brand")), 1, 3), ",").alias("brands"), F.least(F.min("p_size"), F.lit(40)).alias("least"))


def _candidates(spark, d):
    return C.next_candidates(clusters(spark, d), now(), F.lit(1.5)).select("id", "headline", "score")


def _outcomes(spark, d):
    return C.outcomes(clusters(spark, d), now(), F.lit(1.5)).select("id", "outcome")


def _daily(spark, d):
    e = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("created_at"))
    return C.room_today(e, F.lit("2024-01-30 23:00:00").cast("timestamp"), F.lit(400).cast("long"))


def _expire(spark, d):
    o = table(spark, d, "orders")
    posts = o.select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "pending").otherwise("approved").alias("status"), F.col("o_orderdate").cast("timestamp").alias("created_at"))
    return C.expired(posts, F.lit("1996-01-01 12:00:00").cast("timestamp")).select("o_orderkey", "status")


def _prune(spark, d):
    e = events(spark, d).withColumn("done", F.col("event_id") % 2 == 0)
    return Z.pruned(e, (F.col("ms") < AS_OF_MS + 5 * DAY) & F.col("done"), F.col("ms") < AS_OF_MS).select("event_id")


def _health(spark, d):
    e, o = events(spark, d), table(spark, d, "orders")
    end = 1706572800000
    return V.counters({"last_hour": (e, F.col("ms") > end - HOUR), "last_day": (e, F.col("ms") > end - DAY), "errors": (e, F.col("event_type") == "error"), "open_orders": (o, F.col("o_orderstatus") == "O"), "alert": (o, F.col("o_totalprice") > 1e9)})


def _paged(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_orderdate")
    return V.page(o, 20, 40, F.desc("o_orderdate"), F.col("o_orderkey")).select("o_orderkey", "total")


def _patch(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    p = c.where("c_custkey % 3 = 0").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal") + 1).alias("c_acctbal"), F.lit("X").alias("c_mktsegment"))
    return Z.patched(c, p, "c_custkey")


def _outcome_counts(spark, d):
    from ..functions import urls as U
    from pyspark.sql import Window

    p = table(spark, d, "pages").select("page_id", U.normalised("url").alias("u"), F.length("html").alias("n"))
    nth = F.row_number().over(Window.partitionBy("u").orderBy("page_id"))
    kind = F.when(F.col("n") < 800, "too short").when(nth > 1, "duplicate").otherwise("ingested")
    return p.select(kind.alias("outcome")).groupBy("outcome").agg(F.count(F.lit(1)).alias("pages"))


def _stream(spark, d):
    e = events(spark, d).where((F.col("ms") > AS_OF_MS) & (F.coalesce("value", F.lit(0.0)) >= 95))
    s = V.digest(e.withColumn("h", F.concat("event_type", F.lit("#"), F.col("event_id").cast("string"))), "value", "ms", "h", "event_id")
    return s.select("n", "top_score", "top_headline", "cursor", F.array_join("best", ",").alias("best"))


def _replay(spark, d):
    e = events(spark, d).withColumn("nonce", F.concat(F.col("user_id").cast("string"), F.lit(":"), "event_type"))
    body = F.concat(F.lit("b"), F.col("event_id").cast("string"))
    ts = F.col("ms").cast("string")
    sig = F.when(F.col("event_id") % 10 == 0, F.lit("bad")).otherwise(F.sha2(F.concat(ts, F.col("nonce"), F.lit("secret"), body), 256))
    ok = e.where(G.signature_ok(ts, F.col("nonce"), F.lit("secret"), body, sig) & G.fresh(F.col("ms") / 1000, F.col("ms") / 1000 + F.col("event_id") % 400))
    return D.window_dedup(ok, ["nonce"], "ms", "event_id", 6 * HOUR).select("event_id")


def _late(spark, d):
    i = items(spark, d)
    return i.where(F.col("ms") <= AS_OF_MS - K.WINDOW_MS).select("id", "category")


def _hourly(spark, d):
    e = table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("t", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.unix_millis("w.start").alias("hour_ms"), "event_type", "n")


def _flag(spark, d):
    return clusters(spark, d).agg(F.bool_or((F.col("risk_level") == "high") & (F.col("post_count") == 0)).alias("alert"), F.count_if(F.col("status") == "new").alias("fresh"))


def _detail(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"))
    return o.join(table(spark, d, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey")).join(li, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", "c_name", F.coalesce("lines", F.lit(0)).cast("long").alias("lines"))


QUERIES = {
    "title_dedup_24h": (_title_dedup, _fold_sql(f"{ITEMS_SQL}, src AS (SELECT sha256({sql_title_key('title')}) AS h, id AS i, ms FROM items)", "h", DAY, "i AS id, h AS title_hash")),
    "event_dedup_fold_24h": (_event_fold, _fold_sql(f"{EVENTS_SQL}, src AS (SELECT user_id, event_type, event_id AS i, ms FROM e)", "user_id, event_type", DAY, "user_id, event_type, ms, i AS event_id")),
    "unseen_anti_join": (_unseen, "SELECT doc_id, lang FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id)"),
    "insert_if_absent": (_insert_absent, "SELECT doc_id, quality FROM labels WHERE quality IS NOT NULL UNION ALL SELECT doc_id, -1 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL)"),
    "pair_overlap": (_pairs, f"""WITH {ITEMS_SQL}, k AS (SELECT id, category, ms, {sql_hits("lower(title || ' ' || summary)", (*B.top, *B.middle))} AS kw FROM items)
        SELECT a.id AS a, b.id AS b, CAST(len(list_intersect(a.kw, b.kw)) AS BIGINT) AS shared FROM k a JOIN k b ON a.category = b.category AND a.id < b.id AND abs(a.ms - b.ms) <= {K.WINDOW_MS} AND len(list_intersect(a.kw, b.kw)) >= 2"""),
    "greedy_clusters": (_clusters, f"WITH RECURSIVE {ITEMS_SQL}, {GREEDY_SQL} SELECT id, category, leader FROM g"),
    "cluster_summary": (_summary, f"WITH RECURSIVE {SUMMARY_SQL} SELECT cluster_id, category, headline, score, risk_level, source_count, first_ms, array_to_string(ids, '|') AS item_ids, sha256(array_to_string(coalesce(sums, []), '|')) AS summaries_sha256 FROM z"),
    "cluster_summary_sets": (_summary_sets, f"""WITH RECURSIVE {SUMMARY_SQL}, w AS (SELECT *, lower(headline || ' ' || array_to_string(coalesce(sums, []), ' ')) AS t FROM z)
        SELECT cluster_id, array_to_string({sql_distinct('reasons')}, '|') AS risk_reasons, array_to_string({sql_distinct('kws')}, '|') AS keywords, array_to_string({sql_topics('t', L.BENCH_GEO, L.BENCH_TOPICS)}, '|') AS topics FROM w"""),
    "cluster_merge": (_merge, f"""WITH RECURSIVE {MERGE_SQL} SELECT e.id AS cluster_id, category, e.headline AS headline, e.score AS score, e.risk AS risk_level, e.seen AS first_ms, CASE WHEN e.ch THEN {AS_OF_MS} ELSE 0 END AS last_ms, CAST(len(e.ids) AS BIGINT) AS source_count, e.ch AS changed,
        array_to_string(e.ids, '|') AS item_ids, sha256(array_to_string(e.ss, '|')) AS summaries_sha256, array_to_string(e.rr, '|') AS risk_reasons FROM l"""),
    "market_union_topk": (_markets, """SELECT * FROM (SELECT 'p:' || p_partkey AS market_id, p_name AS question, p_retailprice AS volume FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 5 <> 0 AND p_retailprice > 0
        UNION ALL SELECT 'k:' || s_suppkey, s_name, CASE WHEN s_suppkey % 4 = 0 THEN s_acctbal ELSE 10.0 END FROM supplier WHERE s_suppkey % 3 <> 0) ORDER BY volume DESC NULLS LAST, market_id LIMIT 50"""),
    "market_upsert": (_upsert, f"""WITH s AS (SELECT p_partkey AS id, p_name AS question, p_retailprice AS volume, p_brand AS topic, {AS_OF_MS} - CAST(p_size AS BIGINT) * {DAY} AS seen_ms FROM part WHERE p_size <= 30),
        b AS (SELECT p_partkey AS id, p_name || '?' AS question, p_retailprice * 2 AS volume, 'new' AS topic, {AS_OF_MS} AS seen_ms FROM part WHERE p_size >= 20)
        SELECT * FROM (SELECT coalesce(s.id, b.id) AS id, coalesce(b.question, s.question) AS question, coalesce(b.volume, s.volume) AS volume, CASE WHEN s.id IS NOT NULL THEN s.topic ELSE b.topic END AS topic, coalesce(b.seen_ms, s.seen_ms) AS seen_ms FROM s FULL JOIN b ON s.id = b.id) WHERE seen_ms >= {AS_OF_MS - 30 * DAY}"""),
    "entity_max_volume": (_entities, "SELECT entity, max(volume) AS volume FROM (SELECT lower(trim(unnest(string_split(p_name, ' ')))) AS entity, p_retailprice AS volume FROM part) WHERE length(entity) >= 3 AND volume > 0 GROUP BY entity"),
    "latest_per_mode": (_latest, "SELECT conv_id, role, turn, n FROM (SELECT conv_id, role, turn, CAST(length(text) AS BIGINT) AS n, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC, length(text) DESC) AS rn FROM conversations WHERE role IN ('user', 'assistant')) WHERE rn = 1"),
    "feed_top50_with_posts": (_feed, "WITH o AS (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50) SELECT o_orderkey, o_totalprice, coalesce((SELECT string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) FROM lineitem WHERE l_orderkey = o_orderkey), '') AS lines FROM o"),
    "unsent_semi_join": (_semi, "SELECT o_orderkey, o_totalprice FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_quantity >= 45) ORDER BY o_totalprice DESC, o_orderkey LIMIT 5"),
    "array_membership_join": (_members, """WITH a AS (SELECT l_orderkey AS k, list_slice(list_sort(list(DISTINCT l_partkey)), 1, 3) AS ids FROM lineitem GROUP BY 1), u AS (SELECT k, unnest(ids) AS id FROM a)
        SELECT k, array_to_string(list_slice(list_sort(list(DISTINCT p_brand)), 1, 3), ',') AS brands, least(min(p_size), 40) AS least FROM u JOIN part ON id = p_partkey GROUP BY k"""),
    "candidates_top2": (_candidates, f"WITH {CLUSTERS_SQL} SELECT id, headline, score FROM clusters WHERE {ELIGIBLE_SQL} AND {WORTHY_SQL} ORDER BY score DESC, ms DESC, id LIMIT 2"),
    "candidate_outcomes": (_outcomes, f"WITH {CLUSTERS_SQL} SELECT id, CASE WHEN NOT {WORTHY_SQL} THEN 'low_signal_skipped' WHEN risk_level = 'high' THEN 'high_risk_skipped' ELSE 'candidate' END AS outcome FROM clusters WHERE {ELIGIBLE_SQL}"),
    "daily_cap": (_daily, "SELECT n AS posts_24h, CAST(400 AS BIGINT) AS daily_limit, greatest(400 - n, 0) AS room FROM (SELECT count(*) FILTER (ts > TIMESTAMP '2024-01-29 23:00:00') AS n FROM events)"),
    "expire_pending": (_expire, "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1996-01-01 04:00:00' THEN 'expired' WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'approved' END AS status FROM orders"),
    "retention_prune": (_prune, f"WITH {EVENTS_SQL} SELECT event_id FROM e WHERE NOT ((ms < {AS_OF_MS + 5 * DAY} AND event_id % 2 = 0) OR ms < {AS_OF_MS})"),
    "health_counts": (_health, f"""WITH {EVENTS_SQL} SELECT (SELECT count(*) FROM e WHERE ms > {1706572800000 - HOUR}) AS last_hour, (SELECT count(*) FROM e WHERE ms > {1706572800000 - DAY}) AS last_day, (SELECT count(*) FROM events WHERE event_type = 'error') AS errors,
        (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS open_orders, (SELECT count(*) FROM orders WHERE o_totalprice > 1e9) AS alert"""),
    "paged_posts": (_paged, "SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40"),
    "patch_update": (_patch, "SELECT c_custkey, c_name, CASE WHEN c_custkey % 6 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 3 = 0 THEN 'X' ELSE c_mktsegment END AS c_mktsegment FROM customer"),
    "ingest_outcomes": (_outcome_counts, f"""WITH p AS (SELECT page_id, {sql_url('url')} AS u, length(html) AS n FROM pages), w AS (SELECT n, row_number() OVER (PARTITION BY u ORDER BY page_id) AS nth FROM p)
        SELECT CASE WHEN n < 800 THEN 'too short' WHEN nth > 1 THEN 'duplicate' ELSE 'ingested' END AS outcome, count(*) AS pages FROM w GROUP BY 1"""),
    "sse_batch": (_stream, f"""WITH {EVENTS_SQL}, q AS (SELECT *, event_type || '#' || event_id AS h FROM e WHERE ms > {AS_OF_MS} AND value >= 95), r AS (SELECT list(h ORDER BY value DESC, event_id) AS hs, count(*) AS n, max(value) AS top_score, max(ms) AS cursor FROM q)
        SELECT n, top_score, hs[1] AS top_headline, cursor, array_to_string(list_slice(hs, 1, 3), ',') AS best FROM r"""),
    "replay_guard": (_replay, _fold_sql(f"{EVENTS_SQL}, src AS (SELECT event_id AS i, ms, user_id || ':' || event_type AS nonce FROM e WHERE event_id % 10 <> 0 AND event_id % 400 <= 300)", "nonce", 6 * HOUR, "i AS event_id")),
    "late_items": (_late, f"WITH {ITEMS_SQL} SELECT id, category FROM items WHERE ms <= {AS_OF_MS - 4 * HOUR}"),
    "events_hourly": (_hourly, "SELECT epoch_ms(date_trunc('hour', ts)) AS hour_ms, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
    "high_risk_alert": (_flag, f"WITH {CLUSTERS_SQL} SELECT bool_or(risk_level = 'high' AND post_count = 0) AS alert, count(*) FILTER (status = 'new') AS fresh FROM clusters"),
    "cluster_detail": (_detail, "SELECT o_orderkey, c_name, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS lines FROM orders JOIN customer ON o_custkey = c_custkey"),
}

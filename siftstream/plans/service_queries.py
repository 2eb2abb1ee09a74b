"""Queries of the webhook, topics, user functions and delivery, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import registry
from ..operators import topics as Q
from ..sources import webhooks as W
from ..sources.tables import AS_OF_MS, table
from ..streaming import streams as T
from .table_queries import EVENTS_SQL, _fold_sql, events
from .text_queries import now, sql_text

TOKEN, SECRET, KEY = "tok", "secret", "envelope"


def _requests(spark, d, sealed=False):
    """Events as requests of eight kinds: no JSON, a challenge, three with a token, three with a signature; sealed: bodies in
    envelopes, some under another key."""
    e, i = events(spark, d), F.col("event_id")
    s = lambda c: c.cast("string")
    value = F.struct(F.lit("approve").alias("action"), s(i).alias("post_id"))
    operator = F.struct(F.when(i % 13 > 0, F.concat(F.lit("o"), s(F.col("user_id")))).alias("open_id"))
    head = F.struct(F.when(i % 5 == 0, "other").otherwise(TOKEN).alias("token"), F.concat(F.lit("e"), s(F.col("user_id") % 7)).alias("event_id"), s(F.col("ms") * 1000 + (i % 3) * 200_000_000).alias("create_time"))
    new = F.to_json(F.struct(F.lit("2.0").alias("schema"), head.alias("header"), F.struct(operator.alias("operator"), F.struct(value.alias("value")).alias("action")).alias("event")))
    old = F.to_json(F.struct(F.lit("card").alias("type"), operator.alias("operator"), F.struct(F.to_json(value).alias("value")).alias("action")))
    body = F.when(i % 8 == 0, '{"a"').when(i % 8 == 1, F.to_json(F.struct(F.lit("url_verification").alias("type"), F.concat(F.lit("c"), s(i)).alias("challenge")))).when(i % 8 < 5, new).otherwise(old)
    if sealed:
        key = F.unhex(F.sha2(F.when(i % 10 == 7, "other").otherwise(KEY), 256))
        body = F.to_json(F.struct(F.base64(F.aes_encrypt(body, key, F.lit("CBC"), F.lit("PKCS"), F.unhex(F.md5(s(i))))).alias("encrypt")))
    r = e.select(i.alias("request_id"), F.col("ms").alias("received_ms"), body.alias("body"), s(F.floor(F.col("ms") / 1000) + i % 400).alias("timestamp"), F.concat(F.lit("n"), s(F.col("user_id") % 7)).alias("nonce"))
    return r.withColumn("signature", F.when(F.col("request_id") % 11 == 0, None).when(F.col("request_id") % 9 == 0, "bad").otherwise(F.sha2(F.concat("timestamp", "nonce", F.lit(SECRET), "body"), 256)))


def _webhook(spark, d):
    return W.received(_requests(spark, d), TOKEN, SECRET)


def _sealed(spark, d):
    return W.received(_requests(spark, d, True), TOKEN, SECRET, KEY)


_V = f"""{EVENTS_SQL}, v AS (SELECT event_id AS id, ms, user_id, event_id % 13 > 0 AS named, CASE WHEN event_id % 8 < 5 THEN 'evt:e' ELSE 'n' END || (user_id % 7) AS nonce,
 CASE event_id % 8 WHEN 0 THEN 'invalid json' WHEN 1 THEN 'challenge' ELSE CASE WHEN event_id % 8 < 5 THEN CASE WHEN event_id % 5 = 0 THEN 'invalid token' WHEN event_id % 3 = 2 THEN 'stale' END
  ELSE CASE WHEN event_id % 11 = 0 THEN 'missing headers' WHEN event_id % 400 > 300 THEN 'stale' WHEN event_id % 9 = 0 THEN 'invalid signature' END END END AS why FROM e)"""
_SEALED_V = _V.replace("CASE event_id % 8 WHEN 0 THEN 'invalid json' WHEN 1", "CASE CASE WHEN event_id % 10 = 7 THEN 0 ELSE event_id % 8 END WHEN 0 THEN 'decryption failed' WHEN 1")


def _webhook_sql(v: str) -> str:
    return f"""WITH {v}, k AS ({_fold_sql(v + ", src AS (SELECT nonce, id AS i, ms FROM v WHERE why IS NULL)", "nonce", W.REMEMBERED_MS + 1, "i")}),
 o AS (SELECT v.*, coalesce(why, CASE WHEN k.i IS NULL THEN 'replay' WHEN NOT named THEN 'ignored' ELSE 'action' END) AS outcome FROM v LEFT JOIN k ON k.i = v.id)
 SELECT id AS request_id, CAST(CASE WHEN outcome IN ('challenge', 'ignored', 'action') THEN 200 WHEN outcome = 'invalid json' THEN 400 ELSE 401 END AS INTEGER) AS status, outcome, CASE WHEN outcome = 'challenge' THEN 'c' || id END AS challenge,
  CASE WHEN outcome = 'action' THEN 'approve' END AS action, CASE WHEN outcome = 'action' THEN CAST(id AS VARCHAR) END AS post_id, CASE WHEN outcome = 'action' THEN 'o' || user_id END AS open_id, CAST(NULL AS VARCHAR) AS user_name, CAST(NULL AS VARCHAR) AS message_id, CAST(NULL AS VARCHAR) AS edited_content FROM o"""


def _topics(spark, d):
    p, k = table(spark, d, "part"), F.col("p_partkey")
    word = F.element_at(F.array(*[F.lit(v[0]) for v in Q.CATEGORIES.values()], F.lit("nothing")), (k % (len(Q.CATEGORIES) + 1) + 1).cast("int"))
    markets = p.select(k.alias("market_id"), F.concat(F.lit("Will the "), "p_name", F.lit(", "), word, F.lit(" and "), "p_brand", F.lit(" be?")).alias("question"))
    answer = F.concat(F.lit('```json\n{"topic":"T'), k.cast("string"), F.lit('","entities":[" Ab ","c","d e"]'), F.when(k % 2 == 0, ',"category":"other"').otherwise(""), F.lit("}\n```"))
    known = p.where("p_size <= 25").select(k.alias("market_id"), answer.alias("answer"))
    return Q.with_topics(markets, known).select("market_id", "topic", F.array_join("entities", "|").alias("entities"), "category")


_NAMES = [*Q.CATEGORIES, "other"]
_COMMON = ", ".join(map(sql_text, Q.COMMON))
_WORDS = "[" + ", ".join(sql_text(v[0]) for v in Q.CATEGORIES.values()) + ", 'nothing']"
_IN = " ".join(f"WHEN list_has_any(w, [{', '.join(map(sql_text, v))}]) THEN {sql_text(n)}" for n, v in Q.CATEGORIES.items())
_TOPICS_SQL = f"""WITH q AS (SELECT p_partkey AS k, p_size, regexp_extract_all(lower('Will the ' || p_name || ', ' || {_WORDS}[p_partkey % {len(_NAMES)} + 1] || ' and ' || p_brand || ' be?'), '[$]?[a-z0-9]+') AS ws FROM part),
 f AS (SELECT k, p_size, list_filter(ws, lambda v, i: length(v) > 1 AND v NOT IN ({_COMMON}) AND list_position(ws, v) = i) AS w FROM q), c AS (SELECT *, p_size <= 25 AND k % 2 = 0 AS known FROM f)
 SELECT k AS market_id, CASE WHEN known THEN 'T' || k ELSE array_to_string(w[1:6], ' ') END AS topic, CASE WHEN known THEN 'ab|d e' ELSE array_to_string(w[1:8], '|') END AS entities, CASE WHEN known THEN 'other' {_IN} ELSE 'other' END AS category FROM c"""


def sql_topic_words(question: str) -> str:
    """A question's words, as ``topics.words_of``."""
    ws = f"regexp_extract_all(lower({question}), '[$]?[a-z0-9]+')"
    return f"list_filter({ws}, lambda v, i: length(v) > 1 AND v NOT IN ({_COMMON}) AND list_position({ws}, v) = i)"


def sql_topic_category(w: str) -> str:
    return f"CASE {_IN.replace('(w,', f'({w},')} ELSE 'other' END"


def _user_functions(spark, d):
    registry.register_own(spark)
    registry.register(spark, "halved_up", "CAST(ceil(x / 2) AS BIGINT)", "BIGINT", "x BIGINT")
    e = table(spark, d, "events")
    return e.select("event_id", F.expr("signal_cut(concat(' ', event_type, ' of many'), 9)").alias("cut"), F.expr("signal_trim(concat(' ', event_type, ' '))").alias("trimmed"), F.expr("halved_up(event_id)").alias("half"))


def _delivered(spark, d):
    o = table(spark, d, "orders")
    old = F.col("o_orderstatus") == "F"
    posts = o.select(F.col("o_orderkey").alias("post_id"), F.col("o_custkey").alias("cluster_id"), F.when(old, "m-old").alias("message_id"), F.when(old, F.timestamp_millis(F.lit(0))).alias("sent_at"))
    receipts = table(spark, d, "customer").select(F.col("c_custkey").alias("cluster_id"), F.when(F.col("c_mktsegment") != "BUILDING", F.concat(F.lit("m"), F.col("c_custkey").cast("string"))).alias("message_id"))
    return T.delivered(posts, receipts, now()).select("post_id", "message_id", F.coalesce(F.unix_millis("sent_at"), F.lit(-1)).alias("sent_ms"))


def _messages(spark, d):
    e = events(spark, d).withColumn("h", F.concat("event_type", F.lit("#"), F.col("event_id").cast("string")))
    of = lambda name, least: T.message(e, "event_id", "h", "value", least).select(F.lit(name).alias("stream"), "message")
    return of("some", 95.0).unionByName(of("none", 1e12))


QUERIES = {
    "webhook_requests": (_webhook, _webhook_sql(_V)),
    "sealed_requests": (_sealed, _webhook_sql(_SEALED_V)),
    "market_topics": (_topics, _TOPICS_SQL),
    "user_functions": (_user_functions, """SELECT event_id, CASE WHEN length(t) <= 9 THEN t ELSE rtrim(substr(t, 1, 8)) || '…' END AS cut, event_type AS trimmed, (event_id + 1) // 2 AS half FROM (SELECT *, ' ' || event_type || ' of many' AS t FROM events)"""),
    "delivered_posts": (_delivered, f"""SELECT o_orderkey AS post_id, CASE WHEN o_orderstatus = 'F' THEN 'm-old' WHEN c_mktsegment <> 'BUILDING' THEN 'm' || c_custkey END AS message_id,
        CASE WHEN o_orderstatus = 'F' THEN 0 WHEN c_mktsegment <> 'BUILDING' THEN {AS_OF_MS} ELSE -1 END AS sent_ms FROM orders LEFT JOIN customer ON o_custkey = c_custkey"""),
    "push_messages": (_messages, """WITH q AS (SELECT event_id, event_type || '#' || event_id AS h, value FROM events WHERE value >= 95), b AS (SELECT list('{"id":' || event_id || ',"headline":"' || h || '","score":' || value || '}' ORDER BY value DESC, event_id) AS c, list(h ORDER BY value DESC, event_id) AS hs, count(*) AS n, max(value) AS top FROM q)
        SELECT 'some' AS stream, CASE WHEN n > 0 THEN 'data: {"type":"new_clusters","count":' || n || ',"topScore":' || top || ',"topHeadline":"' || hs[1] || '","clusters":[' || array_to_string(c[1:3], ',') || ']}' ELSE ': ping' END || chr(10) || chr(10) AS message FROM b UNION ALL SELECT 'none', ': ping' || chr(10) || chr(10)"""),
}

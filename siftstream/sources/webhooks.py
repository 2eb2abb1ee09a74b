"""Requests of a chat's webhook: decrypted, authenticated, checked for replays, and read as review actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import guards as G
from ..operators.dedup import window_dedup
from ..operators.review import action_of
from ..shared import written

#: A nonce is remembered for so long after the request that was accepted with it.
REMEMBERED_MS = 360_000
ACTION = ("action", "post_id", "open_id", "user_name", "message_id", "edited_content")


def received(requests: DataFrame, token: str = "", secret: str = "", key: str = "") -> DataFrame:
    """request_id, status (200, 400, 401, 500), outcome, challenge and the fields of the action, which are set only where
    the outcome is 'action'.

    requests: request_id (unique), received_ms, body, and the headers timestamp, nonce and signature. A body with a schema of
    2.0 or a token in its header is known by that token and its event's id; others by the signature of their headers. What is
    not configured (empty) refuses all that needs it. Requests are taken by time, then id: a nonce that an accepted request
    had less than six minutes before is a replay, and a refused request does not prolong that. Null bodies are no JSON, nor is
    a value with something behind it, which decryption under a wrong key may leave.
    """
    at = lambda path: F.get_json_object("_b", path)
    sealed = F.get_json_object("body", "$.encrypt")
    # a value that stands alone: the parser stops behind it, but what follows it cannot go on both as a member and as a field
    wrapped = lambda a, c, b: F.try_parse_json(F.concat(F.lit(a), c, F.lit(b))).isNotNull()
    json = lambda c: wrapped("[", c, "]") & wrapped('{"v":', c, "}") & (F.trim(c) != "null")
    r = requests.withColumn("_b", F.when(sealed.isNull(), F.col("body")).when(F.lit(key != ""), G.decrypted(sealed, key)))
    marked = F.coalesce(at("$.schema") == "2.0", F.lit(False)) | at("$.header.token").isNotNull()
    now_s = F.floor(F.col("received_ms") / 1000)
    no = lambda c: ~F.coalesce(c, F.lit(False))
    absent = lambda *cols: _any(F.coalesce(F.col(c), F.lit("")) == "" for c in cols)
    created = at("$.header.create_time").try_cast("double") / 1000
    by_token = (
        F.when(F.lit(token == ""), "no token configured").when(no(at("$.header.token") == token), "invalid token")
        .when(no(F.abs(F.col("received_ms") - created) <= 300_000), "stale"))
    by_signature = (
        F.when(F.lit(secret == ""), "no secret configured").when(absent("timestamp", "nonce", "signature"), "missing headers")
        .when(no(F.abs(now_s - F.col("timestamp").try_cast("long")) <= 300), "stale")
        .when(~G.signature_ok(F.col("timestamp"), F.col("nonce"), F.lit(secret), F.col("body"), F.col("signature")), "invalid signature"))
    first = (
        F.when(no(json(F.col("body"))), "invalid json").when(sealed.isNotNull() & F.lit(key == ""), "no key configured").when(sealed.isNotNull() & no(json(F.col("_b"))), "decryption failed")
        .when(F.coalesce((at("$.type") == "url_verification") & at("$.challenge").isNotNull(), F.lit(False)), "challenge"))
    nonce = F.when(marked, F.concat(F.lit("evt:"), F.nullif(at("$.header.event_id"), F.lit("")))).otherwise(F.col("nonce"))
    # written, as both what is kept and what is answered read it: bodies are parsed once
    r = written(r.select("request_id", "received_ms", "_b", F.coalesce(first, F.when(marked, by_token).otherwise(by_signature)).alias("_why"), nonce.alias("_nonce")), "requests")
    kept = window_dedup(r.where("_why IS NULL AND _nonce IS NOT NULL"), ["_nonce"], "received_ms", "request_id", REMEMBERED_MS + 1).select("request_id", F.lit(True).alias("_kept"))
    # of rows that are refused before, nothing is read
    a = F.when(F.col("_why").isNull() & (F.col("_nonce").isNull() | F.col("_kept").isNotNull()), action_of("_b"))
    kind = F.coalesce(at("$.header.event_type"), at("$.type"))
    ignored = F.coalesce(kind == "im.message.receive_v1", F.lit(False)) | (F.coalesce(F.col("_a.action"), F.lit("")) == "") | (F.coalesce(F.col("_a.open_id"), F.lit("")) == "")
    why = F.coalesce("_why", F.when(F.col("_nonce").isNotNull() & F.col("_kept").isNull(), "replay"), F.when(ignored, "ignored"), F.lit("action"))
    out = r.join(kept, "request_id", "left").withColumn("_a", a).withColumn("outcome", why)
    status = F.when(F.col("outcome").isin("challenge", "ignored", "action"), 200).when(F.col("outcome") == "invalid json", 400).when(F.col("outcome").endswith("configured"), 500).otherwise(401)
    return out.select("request_id", status.alias("status"), "outcome", F.when(F.col("outcome") == "challenge", at("$.challenge")).alias("challenge"), *[F.when(F.col("outcome") == "action", F.col(f"_a.{c}")).alias(c) for c in ACTION])


def _any(conditions) -> Column:
    from functools import reduce

    return reduce(lambda a, b: a | b, conditions)

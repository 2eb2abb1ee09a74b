"""Webhook outcomes, topics, user functions, retries, pushes and stops."""

import base64
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from siftstream.functions import registry
from siftstream.functions.retries import Refused, with_retries
from siftstream.operators import topics as Q
from siftstream.sources import webhooks as W
from siftstream.streaming import streams as T

NOW = 1_700_000_000_000


def request(i, body, at=NOW, stamp=None, nonce=None, secret="s"):
    text = body if isinstance(body, str) else json.dumps(body)
    signed = None if stamp is None else hashlib.sha256(f"{stamp}{nonce}{secret}{text}".encode()).hexdigest()
    return i, at, text, stamp, nonce, signed


def event(name="e1", token="t", create=NOW * 1000, **more):
    return {"schema": "2.0", "header": {"token": token, "event_id": name, "create_time": str(create)}, "event": {"operator": {"open_id": "o"}, "action": {"value": {"action": "approve", "postId": "p"}}}, **more}


def outcomes(spark, rows, **given):
    df = spark.createDataFrame(rows, "request_id long, received_ms long, body string, timestamp string, nonce string, signature string")
    return {r.request_id: (r.status, r.outcome) for r in W.received(df, **({"token": "t", "secret": "s"} | given)).collect()}


def test_requests_are_refused_or_read(spark):
    s = str(NOW // 1000)
    old = {"operator": {"open_id": "o"}, "action": {"value": '{"action":"reject","post_id":"9"}'}}
    got = outcomes(spark, [
        request(1, "{"), (2, NOW, None, None, None, None), request(3, {"type": "url_verification", "challenge": "c"}), request(4, event()), request(5, event(token="no")), request(6, event("e2", create=NOW)),
        request(7, event(), NOW + 1000), request(8, old, stamp=s, nonce="n"), request(9, old), request(10, old, stamp="1", nonce="m"), request(11, old, stamp=s, nonce="x", secret="other"),
        request(12, {"a": 1}, stamp=s, nonce="y"), request(13, {"encrypt": "AAAA"}), request(14, "null")])
    assert got == {
        1: (400, "invalid json"), 2: (400, "invalid json"), 3: (200, "challenge"), 4: (200, "action"), 5: (401, "invalid token"), 6: (401, "stale"), 7: (401, "replay"), 8: (200, "action"), 9: (401, "missing headers"),
        10: (401, "stale"), 11: (401, "invalid signature"), 12: (200, "ignored"), 13: (500, "no key configured"), 14: (400, "invalid json")}


def test_a_replay_does_not_prolong_the_memory_and_absent_settings_refuse(spark):
    at = lambda m: request(m, event(create=(NOW + m * 60_000) * 1000), NOW + m * 60_000)
    assert [outcomes(spark, [at(0), at(4), at(6), at(7)])[m][1] for m in (0, 4, 6, 7)] == ["action", "replay", "replay", "action"]
    got = outcomes(spark, [request(1, event()), request(2, {"a": 1})], token="", secret="")
    assert got == {1: (500, "no token configured"), 2: (500, "no secret configured")}


def test_encrypted_bodies(spark):
    row = spark.range(1).select(F.base64(F.aes_encrypt(F.lit(json.dumps(event())), F.unhex(F.sha2(F.lit("k"), 256)), F.lit("CBC"))).alias("x")).first().x
    assert outcomes(spark, [request(1, {"encrypt": row})], key="k") == {1: (200, "action")}
    broken = base64.b64encode(b"0" * 40).decode()
    assert outcomes(spark, [request(1, {"encrypt": broken}), request(2, {"encrypt": row})], key="k")[1] == (401, "decryption failed")


def test_json_with_something_behind_it_is_none(spark):
    """The parser stops behind the first value; a wrong key may leave a digit or an empty string before its noise."""
    seal = lambda t: spark.range(1).select(F.base64(F.aes_encrypt(F.lit(t), F.unhex(F.sha2(F.lit("k"), 256)), F.lit("CBC"))).alias("x")).first().x
    noise = ["5 \ufffd", '"" x', '{"a":1} {}', '"a"] x', '"a"} x', '"k","v":1']
    got = outcomes(spark, [request(n, {"encrypt": seal(t)}) for n, t in enumerate(noise)] + [request(n + 10, t) for n, t in enumerate(noise)], key="k")
    assert got == {n: (401, "decryption failed") for n in range(6)} | {n + 10: (400, "invalid json") for n in range(6)}


def test_topics(spark):
    one = lambda q: spark.range(1).select(Q.topic_of_words(F.lit(q)).alias("t")).first().t
    t = one("Will Bitcoin hit $150k by June 30, 2026?")
    assert (t.topic, t.entities, t.category) == ("bitcoin $150k june 30 2026", ["bitcoin", "$150k", "june", "30", "2026"], "crypto")
    assert one("Will it?") is None and one(None) is None
    answer = lambda a: spark.range(1).select(Q.topic_of_answer(F.lit(a)).alias("t")).first().t
    assert answer('```json\n{"topic":"A","entities":[" Fed ","x"],"category":"economics"}\n```').entities == ["fed"]
    assert answer('{"topic":"A","entities":["a"]}') is None and answer("no") is None


def test_user_functions(spark):
    registry.register_own(spark)
    registry.register(spark, "plus_two", lambda s: s + 2, "long")

    class Letters:
        def eval(self, text: str):
            for c in text:
                yield (c,)

    registry.register(spark, "letters_of", Letters, "letter string")
    assert spark.sql("SELECT signal_cut('abcdef', 4) a, signal_trim(' b ') b, plus_two(id) c FROM range(1)").first() == ("abc…", "b", 2)
    assert [r.letter for r in spark.sql("SELECT * FROM letters_of('ab')").collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        registry.register(spark, "no name", "1")


def test_retries():
    waits, answers = [], [429, 503, 0]

    def call():
        status = answers.pop(0)
        if status:
            raise Refused(status)
        return "done"

    assert with_retries(call, sleep=waits.append) == "done" and waits == [2, 4]
    answers[:] = [400]
    with pytest.raises(Refused):
        with_retries(call, sleep=waits.append)
    answers[:] = [500] * 4
    with pytest.raises(Refused):
        with_retries(call, sleep=waits.append)
    assert waits == [2, 4, 2, 4, 8]


def test_push_heartbeat_and_stop(spark, tmp_path):
    df = spark.createDataFrame([(i, f"h{i}", float(i)) for i in range(8)], "id long, headline string, score double")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    sent, beats = [], []
    listener = T.heartbeat(beats.append)
    spark.streams.addListener(listener)
    T.push(T.file_stream(spark, f"{tmp_path}/in", df.schema), f"{tmp_path}/cp", sent.append, "id", "headline", "score", every=None).awaitTermination()
    got = json.loads(sent[0].removeprefix("data: "))
    assert got["count"] == 3 and got["topHeadline"] == "h7" and [c["id"] for c in got["clusters"]] == [7, 6, 5]
    assert T.message(df.where("id < 5"), "id", "headline", "score").first().message == ": ping\n\n"
    T.push(T.file_stream(spark, f"{tmp_path}/in", df.schema), f"{tmp_path}/cp2", sent.append, "id", "headline", "score", every="1 second")
    assert len(T.stop_all(spark)) == 1 and not spark.streams.active
    spark.streams.removeListener(listener)
    assert beats and beats[0] == ": heartbeat\n\n"


def test_bodies_are_parsed_once(spark):
    """What is kept and what is answered both read a written table, so the answer's plan has no more checks of JSON."""
    df = spark.createDataFrame([request(1, event(), stamp="1", nonce="n")], "request_id long, received_ms long, body string, timestamp string, nonce string, signature string")
    out = W.received(df, token="t", secret="s")
    plan = out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "parsejson" not in plan and "parse_json" not in plan
    assert [r.request_id for r in out.collect()] == [1]

import random

from pyspark.sql import functions as F

from siftstream.operators import candidates as C
from siftstream.operators import clustering as K
from siftstream.operators import dedup as D
from siftstream.operators import guards as G
from siftstream.operators import markets as M
from siftstream.operators import review as R
from siftstream.operators import state as Z

lit = F.lit
NOW = lit("2024-05-02 12:00:00").cast("timestamp")


def test_window_dedup_resets_from_the_last_kept(spark):
    h = 3_600_000
    df = spark.createDataFrame([("a", 0, 1), ("a", 20 * h, 2), ("a", 25 * h, 3), ("a", 48 * h, 4), ("b", 5, 5)], "k string, ms long, id long")
    assert sorted(r.id for r in D.window_dedup(df, ["k"], "ms", "id", 24 * h).collect()) == [1, 3, 5]


def test_first_and_unseen(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "id long, k string")
    assert sorted(r.id for r in D.first_of_each(df, "k", F.col("id")).collect()) == [1, 3]
    assert [r.id for r in D.unseen(df, df.where("k = 'x'"), "k").collect()] == [3]


def plain_leaders(rows, window, least):
    rows, taken, out = sorted(rows, key=lambda r: (r[1], r[0])), set(), {}
    for i, a in enumerate(rows):
        if a[0] in taken:
            continue
        taken.add(a[0])
        out[a[0]] = a[0]
        for b in rows[i + 1 :]:
            if b[0] not in taken and abs(a[1] - b[1]) <= window and len(a[2] & b[2]) >= least:
                taken.add(b[0])
                out[b[0]] = a[0]
    return out


def test_greedy_clusters_equal_a_plain_loop(spark):
    rng = random.Random(3)
    rows = [(i, c, rng.randrange(10 * 3_600_000), rng.sample("abcdefg", rng.randrange(0, 5))) for i in range(300) for c in [rng.choice(["x", "y"])]]
    rows.append((900, "x", rows[0][2] + K.WINDOW_MS, list(rows[0][3])))
    df = spark.createDataFrame(rows, "id long, category string, ms long, keywords array<string>")
    got = {r.id: r.leader for r in K.greedy_clusters(df).collect()}
    want = {}
    for c in "xy":
        want |= plain_leaders([(i, ms, frozenset(k)) for i, cat, ms, k in rows if cat == c], K.WINDOW_MS, K.OVERLAP)
    assert got == want


def test_merge_recent(spark):
    cols = "cluster_id long, category string, headline string, score double, risk_level string, risk_reasons array<string>, topics array<string>, first_ms long, last_ms long, item_ids array<long>, summaries array<string>, keywords array<string>, headline_keywords array<string>, summary_keywords array<string>"
    now, kw = 10 * K.MERGE_MS, ["a", "b"]
    event = lambda i, cat, head, score, risk, first, words, head_words=None, sums=(): (i, cat, head, score, risk, [f"r{i}"], [f"t{i}"], first, 0, [i], [f"s{i}"], words, words if head_words is None else head_words, list(sums))
    old = spark.createDataFrame([event(1, "x", "old", 5.0, "low", now - 10, kw), event(8, "x", "at the hour", 5.0, "low", now - K.MERGE_MS, ["c", "d"]), event(9, "x", "recent", 1.0, "low", now - K.MERGE_MS + 1, ["e", "f"])], cols)
    new = spark.createDataFrame([
        event(2, "x", "same score", 5.0, "high", 0, kw), event(3, "x", "better", 6.0, "low", 0, ["a", "b", "x", "y"]), event(4, "x", "too late for 8", 9.0, "low", 0, ["c", "d"]),
        event(5, "y", "elsewhere", 9.0, "low", 0, kw), event(6, "x", "same run", 1.0, "low", 0, ["c", "d"]), event(7, "x", "one word", 1.0, "low", 0, ["a"]),
        event(10, "x", "by the new headline", 1.0, "low", 0, ["x", "y"]), event(11, "x", "joins 9", 1.0, "low", 0, ["e", "f"], [], ["g", "h"]), event(12, "x", "by a summary", 0.0, "low", 0, ["g", "h"]),
    ], cols)
    got = {r.cluster_id: r for r in K.merge_recent(old, new, now).collect()}
    assert sorted(got) == [1, 4, 5, 7, 8, 9]
    assert got[1].headline == "better" and got[1].risk_level == "low" and got[1].item_ids == [1, 2, 3, 10] and got[1].source_count == 4 and got[1].summaries == ["s1", "s2", "s3", "s10"]
    assert got[1].risk_reasons == ["r1"] and got[1].topics == ["t1"] and got[1].first_ms == now - 10 and got[1].last_ms == now
    assert got[4].item_ids == [4, 6] and got[4].first_ms == now and got[9].item_ids == [9, 11, 12]
    assert (got[8].changed, got[8].last_ms, got[8].item_ids) == (False, 0, [8]) and got[7].changed
    assert {r.cluster_id: r.risk_level for r in K.merge_recent(old, new, now, recompute_risk=True).collect()}[1] == "high"
    items = spark.createDataFrame([(10, None, False), (99, None, False)], "id long, cluster_id long, is_processed boolean")
    assert sorted(map(tuple, K.processed(items, K.merge_recent(old, new, now)).collect())) == [(10, 1, True), (99, None, False)]


def test_guards(value):
    ok = lambda c, x: value(G.refusal(lit(c), lit(x)))
    assert ok("Shares of $ABC rose today by a lot", "ABC beats estimates") is None
    assert ok("Shares of $FRMM rose today by a lot", "ABC beats") == "fabricated ticker"
    assert ok("Class shares $BRK.A rose today nicely", "BRK up") is None
    assert ok("Odds moved to 42% this morning, wow", "41.5 % yesterday") is None
    assert ok("Odds moved to 60% this morning, wow", "41% yesterday") == "fabricated percentage"
    assert ok("too short", "") == "length" and ok("x" * 401, "") == "length"
    assert ok("They face a criminal  probe in the state", "") == "banned phrase"
    assert value(G.refusal(lit("x" * 30), lit(""), lit("poem"))) == "mode"
    r = value(G.response(lit('{"content_mode":"pure_news","content":"hello"}')))
    assert (r.content, r.char_count, r.estimated_score, r.has_market, r.score_explanation) == ("hello", 5.0, 5.0, False, "")
    assert [value(G.edit_refusal(lit(a), lit("old"))) for a in (" \n", "x" * 281, " old\t", "new")] == ["empty", "too long", "unchanged", None]


def test_callback_guards(value, spark):
    import hashlib

    sig = hashlib.sha256(b"1nsecretbody").hexdigest()
    check = lambda secret, s: value(G.signature_ok(lit("1"), lit("n"), lit(secret), lit("body"), lit(s)))
    assert check("secret", sig) and not check("", sig) and not check("secret", "00")
    assert value(G.fresh(lit(1000), lit(1300))) and not value(G.fresh(lit(1000), lit(1301))) and value(G.fresh(lit(1714651200000000), lit(1714651200)))
    # a refused request does not prolong what an accepted one is remembered for
    df = spark.createDataFrame([("a", 0, 1), ("a", 300_000, 2), ("a", 600_000, 3)], "n string, ms long, id long")
    assert sorted(r.id for r in D.window_dedup(df, ["n"], "ms", "id", 360_001).collect()) == [1, 3]


def test_decrypted(spark, value):
    body = '{"challenge":"x"}'
    sealed = value(F.base64(F.expr(f"aes_encrypt('{body}', unhex(sha2('k', 256)), 'CBC', 'PKCS', unhex('000102030405060708090a0b0c0d0e0f'))")))
    assert value(G.decrypted(lit(sealed), "k")) == body
    assert value(G.decrypted(lit("AAAA"), "k")) is None


def test_action_payloads(value):
    old = '{"action":{"value":"{\\"action\\":\\"approve\\",\\"post_id\\":\\"p\\"}"},"open_id":"u","open_message_id":"m"}'
    new = '{"schema":"2.0","header":{"event_id":"e"},"event":{"action":{"value":{"action":"save_edit","post_id":"p"},"form_value":{"edited_content_p":"mine","edited_content":"old"}},"operator":{"user_id":{"open_id":"u"},"user_name":"n"},"context":{"open_message_id":"m"}}}'
    a, b = value(R.action_of(lit(old))), value(R.action_of(lit(new)))
    assert (a.action, a.post_id, a.open_id, a.message_id) == ("approve", "p", "u", "m")
    assert (b.action, b.post_id, b.open_id, b.user_name, b.event_id, b.edited_content) == ("save_edit", "p", "u", "n", "e", "mine")


def test_review_and_pause(spark):
    posts = spark.createDataFrame([("p", "pending", "", "text", 4, 1), ("q", "pending", "", "text", 4, 2), ("r", "pending", "", "text", 4, 3)], "post_id string, status string, reviewed_by string, content string, char_count int, extra int")
    acts = spark.createDataFrame([
        ("p", "save_edit", "u", " better\n", 1), ("p", "approve", "v", None, 2), ("p", "save_edit", "w", "better", 3), ("p", "show_edit", "x", None, 4),
        ("q", "approve", "u", None, 1), ("q", "save_edit", "v", "text", 2), ("q", "reject", "w", None, 3), ("q", "save_edit", "x", "more", 4), ("q", "save_edit", "y", "x" * 281, 5), ("gone", "approve", "u", None, 1),
    ], "post_id string, action string, open_id string, edited_content string, at int")
    got = {r.post_id: tuple(r)[1:] for r in R.applied(posts, acts, "at").collect()}
    # an edit, then an approval: both stay; an edit of what is there already leaves the reviewer
    assert got == {"p": ("approved", "v", "better", 6, 1), "q": ("rejected", "x", "more", 4, 2), "r": ("pending", "", "text", 4, 3)}
    past = [(r.status, r.content, r.valid_from and r.valid_from.at, r.valid_to and r.valid_to.at) for r in R.history(posts, acts, "at").where("post_id = 'q'").orderBy(F.asc_nulls_first("valid_from")).collect()]
    assert past == [("pending", "text", None, 1), ("approved", "text", 1, 3), ("rejected", "text", 3, 4), ("rejected", "more", 4, None)]
    log = spark.createDataFrame([("pause", 1), ("resume", 2), ("approve", 3)], "action string, at int")
    assert R.paused(log, F.col("at")).first().paused is False
    assert "text=text" in R.published(posts, acts.where("action = 'approve'"), NOW).first().intent_url


def test_card(spark):
    df = spark.sql("SELECT 'h' headline, 'crypto' category, 'high' risk_level, array('killed') risk_reasons, array('🪙 加密') topics, 7.25D score, array('a','a','b') source_names, timestamp'2024-05-02 11:00:00' earliest, array(named_struct('post_id','1','content_mode','pure_news','content','x https://a')) posts")
    card = df.select(R.card(NOW).alias("c")).first().c
    assert '"template":"red"' in card and "₿ Crypto" in card and '"sources":"a, b"' in card and "1h ago" in card and "🪙 Crypto" in card


def test_card_of_modes(spark):
    post = "named_struct('post_id', '{0}', 'content_mode', '{1}', 'content', 'a https://x.test\\n\\nb\\n')"
    df = spark.sql(f"SELECT 'h' headline, 'own' category, 'low' risk_level, array('x') risk_reasons, array('t') topics, CAST(NULL AS double) score, array('s') source_names, timestamp'2024-05-02 11:00:00' earliest, array({post.format(1, 'pure_news')}, {post.format(2, 'engagement')}) posts")
    import json

    card = json.loads(df.select(R.card(NOW).alias("c")).first().c)
    # links leave pure news only; every line is quoted, the empty last one too
    assert [p["text"] for p in card["posts"]] == ["> a \n> \n> b", "> a https://x.test\n> \n> b\n> "]
    assert [p["chars"] for p in card["posts"]] == [5, 20] and card["score"] == "0.0" and "risk" not in card and card["category"] == "own"


def test_status_card(spark, value):
    assert '"action":"resume_bot"' in value(R.status_card(lit(True))) and '"action":"pause_bot"' in value(R.status_card(lit(False), "B"))


def test_market_refresh(spark):
    topics = "id string, source string, market_id string, question string, volume double, topic string, entities array<string>, category string, extracted_at timestamp, last_seen timestamp"
    from datetime import timedelta

    at = spark.range(1).select(NOW.alias("t")).first().t
    old = spark.createDataFrame([("p:1", "p", "1", "q?", 1.0, "kept", ["e"], "other", at, at - timedelta(days=40)), ("p:2", "p", "2", "q", 1.0, "gone", ["e"], "other", at, at - timedelta(days=31)), ("p:3", "p", "3", "q", 1.0, "stays", ["e"], "other", at, at - timedelta(days=29))], topics)
    markets = "market_id string, question string, volume double"
    p = spark.createDataFrame([("1", "new words", 5.0), ("1", "twice", 4.0), ("9", "Will bitcoin rise?", 3.0), (None, "x", 9.0), ("8", "last", 1.0)], markets)
    batch = M.landed({"p": p, "k": spark.createDataFrame([], markets)}, 2)
    known = spark.createDataFrame([], "id string, answer string")
    after = M.refresh(old, batch, known, NOW)
    got = {r.id: r for r in after.collect()}
    assert sorted(got) == ["p:1", "p:3", "p:9"]
    assert (got["p:1"].topic, got["p:1"].question, got["p:1"].volume, got["p:1"].last_seen) == ("kept", "new words", 5.0, at)
    assert got["p:9"].category == "crypto" and got["p:9"].entities == ["bitcoin", "rise"]
    assert M.run_report(old, batch, after, ["p", "k"]).first().asDict() == {"p": 2, "k": 0, "new_topics": 0}
    nothing = M.refresh(old.limit(0), batch.limit(0), known, NOW)
    assert M.run_report(old.limit(0), batch.limit(0), nothing, ["p"]).first().asDict() == {"p": 0, "new_topics": 0}


def test_state(spark):
    state = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id long, t string, v double")
    batch = spark.createDataFrame([(2, "z", 9.0), (3, "c", 3.0)], "id long, t string, v double")
    assert sorted(map(tuple, Z.upsert(state, batch, "id", ["v"]).collect())) == [(1, "a", 1.0), (2, "b", 9.0), (3, "c", 3.0)]
    patch = spark.createDataFrame([(1, None, 5.0)], "id long, t string, v double")
    assert sorted(map(tuple, Z.patched(state, patch, "id").collect())) == [(1, "a", 5.0), (2, "b", 2.0)]
    assert sorted(r.id for r in Z.insert_absent(state, batch, "id").collect()) == [1, 2, 3]
    assert [r.id for r in Z.pruned(state, F.col("v") > 1).collect()] == [1]
    assert Z.append_audit(state, batch.drop("t")).count() == 4


def test_markets(spark):
    df = spark.createDataFrame([("Q", False, True, None, 5.0), ("", False, True, None, 5.0), ("C", True, True, None, 5.0), ("N", None, None, None, float("nan")), ("Z", None, None, None, 0.0)], "question string, closed boolean, active boolean, ends_at timestamp, volume double")
    assert [r.question for r in M.open_markets(df, NOW).collect()] == ["Q"]
    topics = spark.createDataFrame([([" Fed ", "ai"], 10.0), (["fed"], 1000.0)], "entities array<string>, volume double")
    ents = M.entity_volumes(topics)
    assert [tuple(r) for r in ents.collect()] == [("fed", 1000.0)]
    # ids neither set nor unique, texts repeated or missing; of several entities the largest volume counts
    rows = [(1, "Federal"), (1, "nothing"), (None, "a fed b"), (2, None), (2, ""), (2, "abcd coin"), (2, "abcd coin"), (3, "xcoinx feD")]
    many = ents.unionByName(spark.createDataFrame([("coin", 1e4), ("zzzz", 1e6), ("abcd coin", 1e5), ("coin", 10.0)] + [(f"w{k}ord", 5.0) for k in range(2000)], "entity string, volume double"))
    items = spark.createDataFrame(rows, "id long, t string")
    got = sorted((r.t or "", round(r.boost, 6)) for r in M.boosted(items, many, F.lower("t")).collect())
    assert got == sorted([("Federal", 1.5), ("nothing", 0.0), ("a fed b", 1.5), ("", 0.0), ("", 0.0), ("abcd coin", 2.5), ("abcd coin", 2.5), ("xcoinx feD", 2.0)])
    assert {r.boost for r in M.boosted(items, many.limit(0), F.lower("t")).collect()} == {0.0}


def test_candidates(spark):
    df = spark.sql("SELECT id, 'A headline of some length' headline, 7.0D score, 'new' status, 0 post_count, IF(id = 1, 'high', 'low') risk_level, timestamp'2024-05-02 11:00:00' - make_dt_interval(0, id) first_seen_at FROM range(8)")
    assert [r.id for r in C.next_candidates(df, NOW, lit(6.5)).collect()] == [0, 1]
    assert df.count() == 8 and C.eligible(df, NOW, lit(6.5)).count() == 5
    assert {r.id: r.outcome for r in C.outcomes(df, NOW, lit(6.5)).collect()}[1] == "high_risk_skipped"
    out = C.generate(df.where("id = 0"), C.template_post).first()
    assert out.content == "Breaking: A headline of some length"


def test_rolling_cap_equals_a_plain_loop(spark):
    from siftstream.operators import generation as N

    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "b", None]), rng.randrange(300) * 3_600_000, i) for i in range(300)] + [("a", None, 900)]
    df = spark.createDataFrame(rows, "k string, ms long, id long")
    for limit in (1, 3):
        kept, times = set(), {}
        for k, ms, i in sorted((r for r in rows if r[1] is not None), key=lambda r: (str(r[0]), r[1], r[2])):
            last = [t for t in times.get(k, []) if ms - t < Z_DAY]
            if len(last) < limit:
                times[k] = [*last, ms]
                kept.add(i)
        assert {r.id for r in N.rolling_cap(df, ["k"], "ms", "id", limit).collect()} == kept
    assert N.rolling_cap(df, ["k"], "ms", "id", 0).count() == 0


Z_DAY = 86_400_000


def test_cycle(spark):
    """The cap counts what this run writes, the gate comes after it, refused answers free their place and say why."""
    from siftstream.operators import generation as N

    cand = spark.createDataFrame([
        (1, 1, "A headline of some length", "A headline of some length", "low", "new"), (2, 2, "Odds are at 60% after this", "no odds", "low", "new"), (3, 3, "Dead after a shooting today", "x", "high", "new"),
        (4, 4, "Another one https://u.test/x of them", "x", "medium", "new"), (5, 5, "Late and left for tomorrow", "x", "low", "new"), (6, 6, "High and late by now", "x", "high", "new")],
        "id long, nth int, headline string, context string, risk_level string, status string")
    posts = spark.sql("SELECT timestamp'2024-05-02 11:00:00' created_at UNION ALL SELECT timestamp'2024-05-01 11:00:00'")
    got = {r.id: (r.outcome, r.status, r.post_count, r.content, r.reason) for r in N.cycle(cand, posts, NOW, 3).collect()}
    assert got[1] == ("done", "done", 1, "BREAKING: A headline of some length", None)
    assert got[2] == ("generation_failed", "generation_failed", 0, None, "fabricated percentage")
    assert got[3][0] == got[3][1] == "high_risk_skipped" and got[3][4] == "high_risk_auto_skip"
    assert got[4][3] == "BREAKING: Another one  of them"
    assert got[5] == ("daily_limit_reached", "new", 0, None, "daily_limit_reached") and got[6][0] == "daily_limit_reached"
    assert {r.outcome for r in N.cycle(cand, posts, NOW, 1).collect()} == {"daily_limit_reached"}

    def broken(batches):
        for pdf in batches:
            yield pdf.assign(raw="no json")[["id", "raw"]]

    assert N.cycle(cand, posts, NOW, 9, broken).where("id = 1").first().reason == "invalid json"

"""Kept rows, leaders and admitted items, found in rounds, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from siftstream.operators import clustering as K
from siftstream.operators import dedup as D
from siftstream.operators.independent import EVER, first_independent
from test_operators import plain_leaders

HOUR = 3_600_000


def plain_kept(rows, gap):
    last, out = {}, set()
    for k, t, i in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        if k not in last or t >= last[k] + gap:
            last[k] = t
            out.add((k, t, i))
    return out


@pytest.mark.parametrize("fold", [0, 30, 10_000])
def test_window_dedup(spark, fold):
    """Keys of many and few rows, null keys, repeated rows, rows at one time, silent stretches."""
    rng = random.Random(fold)
    rows = [(rng.choice(["a", "a", "a", "b", None, "c"]), rng.randrange(60) * HOUR // 2 + rng.choice([0, 400 * HOUR]), i) for i in range(400)]
    rows += rows[:20] + [("z", -5 * HOUR, 900), ("z", 0, 901), ("z", 24 * HOUR, 902)]
    df = spark.createDataFrame(rows, "k string, t long, i long")
    got = D.window_dedup(df, ["k"], "t", "i", 24 * HOUR, fold_rows=fold).collect()
    assert {tuple(r) for r in got} == plain_kept(rows, 24 * HOUR) and len(got) == len(plain_kept(rows, 24 * HOUR))
    assert D.window_dedup(df.limit(0), ["k"], "t", "i", 24 * HOUR, fold_rows=fold).count() == 0


def test_window_dedup_of_a_dense_key(spark):
    """A key with a row a minute: what is kept is a day apart, found in a few rounds."""
    df = spark.range(100_000).select(F.lit("k").alias("k"), (F.col("id") * 60_000).alias("t"), "id")
    got = sorted(r.id for r in D.window_dedup(df, ["k"], "t", "id", 24 * HOUR).collect())
    assert got == list(range(0, 100_000, 1440))


def test_clusters_in_rounds_equal_a_plain_loop(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["x", "y", None]), rng.randrange(9 * HOUR), rng.sample("abcdefg", rng.randrange(0, 5))) for i in range(300)]
    rows.append((900, "x", rows[0][2] + K.WINDOW_MS, list(rows[0][3])))
    df = spark.createDataFrame(rows, "id long, category string, ms long, keywords array<string>")
    want = {}
    for c in ("x", "y", None):
        want |= plain_leaders([(i, ms, frozenset(k)) for i, cat, ms, k in rows if cat == c], K.WINDOW_MS, K.OVERLAP)
    for fold in (0, 90):
        got = {r.id: r.leader for r in K.greedy_clusters(df, fold_items=fold).collect()}
        assert got == want
    assert K.greedy_clusters(df.limit(0), fold_items=0).count() == 0


def test_clusters_of_one_hot_pair(spark):
    """All items of a category share two keywords: no pair of items is built, the slot's first leads the others."""
    df = spark.range(30_000).select("id", F.lit("x").alias("category"), (F.col("id") * 300).alias("ms"), F.array(F.lit("a"), F.lit("b"), (F.col("id") % 50).cast("string")).alias("keywords"))
    got = K.greedy_clusters(df, fold_items=0).groupBy("leader").count().collect()
    assert sorted((r.leader, r["count"]) for r in got) == [(0, 30_000)]


def plain_admitted(items, history, window):
    urls, titles, out = {u for u, _, _ in history}, {}, []
    for _, t, ms in history:
        titles[t] = max(ms, titles.get(t, ms))
    for i, ms, u, t in sorted(items, key=lambda r: (r[1], r[0])):
        if (u is not None and u in urls) or (t is not None and t in titles and ms - titles[t] < window):
            continue
        out.append(i)
        if u is not None:
            urls.add(u)
        if t is not None:
            titles[t] = ms
    return sorted(out)


def test_admission_equals_a_plain_loop(spark):
    """An item that its title refuses does not claim its URL, and the other way round."""
    rng = random.Random(9)
    items = [(i, rng.randrange(80) * HOUR, rng.choice([None, *"abcdefghijkl"]), rng.choice([None, *"qrstuvwxyz"])) for i in range(200)]
    history = [("a", "q", -30 * HOUR), ("b", "r", -1 * HOUR), ("b", "r", -50 * HOUR)]
    df = spark.createDataFrame(items, "id long, ms long, url_hash string, title_hash string")
    past = spark.createDataFrame(history, "url_hash string, title_hash string, ms long")
    assert sorted(r.id for r in D.admitted(df, past).collect()) == plain_admitted(items, history, 24 * HOUR)
    assert sorted(r.id for r in D.admitted(df).collect()) == plain_admitted(items, [], 24 * HOUR)


def test_first_independent_takes_widths_by_key(spark):
    rows = [(1, 0, "a", 10), (2, 10, "a", 10), (3, 11, "a", 10), (1, 0, "u", EVER), (4, 999, "u", EVER), (5, 999, "v", EVER)]
    got = first_independent(spark.createDataFrame(rows, "id long, ms long, k string, w long")).select("id").distinct().collect()
    assert sorted(r.id for r in got) == [1, 3, 5]


def test_pieces_that_never_agree_are_folded_along(spark):
    """Every second item leads, so a piece that begins at the wrong one is wrong to its end."""
    rows = [(i, "x", i * 3 * HOUR, ["a", "b"]) for i in range(63)]
    df = spark.createDataFrame(rows, "id long, category string, ms long, keywords array<string>")
    want = plain_leaders([(i, ms, frozenset(k)) for i, _, ms, k in rows], K.WINDOW_MS, K.OVERLAP)
    assert {r.id: r.leader for r in K.greedy_clusters(df, fold_items=7).collect()} == want
    assert want[62] == 62 and want[61] == 60


def test_a_long_stretch_takes_few_rounds(spark):
    """Rounds are bounded by the pieces, not by the windows of an unbroken stretch: 125 of them here."""
    df = spark.range(30_000).select("id", F.lit("x").alias("category"), (F.col("id") * 60_000).alias("ms"), F.array(F.lit("a"), F.lit("b")).alias("keywords"))
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    assert K.greedy_clusters(df, fold_items=0).select("leader").distinct().count() == 125
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before < 200


def plain_merged(old, new, least):
    """Id, headline, score, items and risk of events; rows: id, headline, score, risk, keywords, its headline's, its summaries'."""
    events = [[i, h, s, [i], r, set(hk), set(sk)] for i, h, s, r, _, hk, sk in old]
    for i, h, s, r, k, hk, sk in new:
        e = next((e for e in events if len((e[5] | e[6]) & set(k)) >= least), None)
        if e is None:
            events.append([i, h, s, [i], r, set(hk), set(sk)])
            continue
        if s > e[2]:
            e[1], e[2], e[5] = h, s, set(hk)
        e[3].append(i)
        e[6] |= set(sk)
        e[4] = max(e[4], r, key=["low", "medium", "high"].index)
    return {e[0]: (e[1], e[2], e[3], e[4]) for e in events}


def test_merge_equals_a_plain_loop(spark):
    """Words come and go with headlines, many events share them, some clusters have too few."""
    rng = random.Random(11)
    words = lambda most: rng.sample("abcdefghijkl", rng.randrange(0, most))
    rows = [(i, f"h{i}", float(rng.randrange(9)), rng.choice(["low", "medium", "high"]), words(5), words(5), words(3)) for i in range(240)]
    of = lambda part, ms: spark.createDataFrame([(i, "c", h, s, r, ["x"], ["y"], ms, ms, [i], [h], k, hk, sk) for i, h, s, r, k, hk, sk in part], "cluster_id long, category string, headline string, score double, risk_level string, risk_reasons array<string>, topics array<string>, first_ms long, last_ms long, item_ids array<long>, summaries array<string>, keywords array<string>, headline_keywords array<string>, summary_keywords array<string>")
    for least in (1, 2, 3):
        got = K.merge_recent(of(rows[:60], HOUR), of(rows[60:], 0), HOUR + 1, least=least, recompute_risk=True).collect()
        assert {r.cluster_id: (r.headline, r.score, r.item_ids, r.risk_level) for r in got} == plain_merged(rows[:60], rows[60:], least)
        assert all(r.changed == (r.cluster_id >= 60 or len(r.item_ids) > 1) and r.source_count == len(r.item_ids) == len(r.summaries) and r.last_ms == (HOUR + 1 if r.changed else HOUR) for r in got)

"""From candidate clusters to posts: a rolling cap, the risk gate, a writer's answers, their checks, status and audit."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as X
from . import guards as G


def _admit(batches, keys: int, limit: int, window_ms: int):
    """Rows in the order of their keys and times; what is kept of a key are the times of its last admitted rows."""
    import pyarrow as pa

    of, times = None, deque()
    for batch in batches:
        cols = [c.to_pylist() for c in batch.columns]
        take = []
        for n, row in enumerate(zip(*cols[:keys], cols[keys])):
            if row[:-1] != of:
                of, times = row[:-1], deque(maxlen=limit)
            ms = row[-1]
            if ms is not None and (len(times) < limit or ms - times[0] >= window_ms):
                times.append(ms)
                take.append(n)
        yield batch.take(pa.array(take, pa.int64()))


def rolling_cap(rows: DataFrame, keys: list[str], time_ms: str, row_id: str, limit: int, window_ms: int = 86_400_000) -> DataFrame:
    """(keys, time_ms, row_id) of the rows that a cap admits: by (time, id), one is admitted if fewer than limit rows of its
    key were admitted less than window_ms before. Rows that are refused do not count, so each decision needs those before it.

    A key's rows pass one task in order, as a stream: what it holds is limit times. Rows without a time are refused.
    """
    if limit < 1:
        return rows.select(*keys, time_ms, row_id).limit(0)
    cols = rows.select(*keys, time_ms, row_id)
    ordered = cols.repartition(*keys).sortWithinPartitions(*keys, time_ms, row_id)
    return ordered.mapInArrow(lambda b: _admit(b, len(keys), limit, window_ms), cols.schema)


def template_answers(batches):
    """Deterministic answers to clusters (id, headline), as a text model would give them: JSON in a fence."""
    import json

    for pdf in batches:
        raw = ["```json\n" + json.dumps({"content_mode": "pure_news", "content": f"BREAKING: {(h or '').strip()}", "estimated_score": 5}) + "\n```" for h in pdf["headline"]]
        yield pdf.assign(raw=raw)[["id", "raw"]]


def checked(answers: DataFrame, raw: str = "raw", context: str = "context") -> DataFrame:
    """Adds content (URLs taken out), content_mode, char_count, estimated_score and refusal to raw answers: 'invalid json', or
    why ``guards.refusal`` refuses them against the context that they were written from; null if they may be posted."""
    r = G.response(X.without_fences(raw))
    out = answers.withColumn("_r", r)
    readable = F.try_parse_json(X.without_fences(raw)).isNotNull()
    why = F.when(~F.coalesce(readable, F.lit(False)), "invalid json").otherwise(G.refusal(F.col("_r.content"), context, F.col("_r.content_mode")))
    content = X.without_urls(F.col("_r.content"))
    return out.select("*", why.alias("refusal"), content.alias("content"), F.col("_r.content_mode").alias("content_mode"), F.col("_r.char_count").alias("char_count"), F.col("_r.estimated_score").alias("estimated_score")).drop("_r")


def cycle(candidates: DataFrame, posts: DataFrame, as_of: Column, daily_limit: int, write=template_answers) -> DataFrame:
    """What becomes of a run's candidates, in their order: id, outcome ('daily_limit_reached', 'high_risk_skipped', 'done',
    'generation_failed'), status and post_count of the cluster afterwards, the post (content, content_mode, char_count,
    estimated_score; null without one) and reason (of the audit entry).

    candidates: id, nth (1, 2, 3 ...), headline, context, risk_level, status - the few best of a run, ``next_candidates``.
    posts: created_at of the posts there are. A cluster is skipped once the posts of 24 hours, with those of this run, are as
    many as the limit; its status stays, so that it comes again. High risk is never written without a human. Posts that were
    refused count for nothing.
    """
    before = posts.where(F.col("created_at") > as_of - F.make_dt_interval(days=F.lit(1))).agg(F.count(F.lit(1)).alias("_n"))
    # nothing is written if there is no room at all
    ask = candidates.crossJoin(before).where((F.col("_n") < daily_limit) & (F.col("risk_level") != "high")).select("id", "headline")
    answers = ask.mapInPandas(write, "id long, raw string")
    rows = candidates.join(answers, "id", "left").crossJoin(before)
    rows = checked(rows).withColumn("_ok", (F.col("risk_level") != "high") & F.col("raw").isNotNull() & F.col("refusal").isNull())
    # a run's candidates are few, so their order is one window
    earlier = F.coalesce(F.sum(F.col("_ok").cast("long")).over(Window.orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    outcome = F.when(F.col("_n") + earlier >= daily_limit, "daily_limit_reached").when(F.col("risk_level") == "high", "high_risk_skipped").when(F.col("_ok"), "done").otherwise("generation_failed")
    rows = rows.withColumn("outcome", outcome)
    posted = lambda c: F.when(F.col("outcome") == "done", F.col(c)).alias(c)
    status = F.when(F.col("outcome") == "daily_limit_reached", F.col("status")).otherwise(F.col("outcome")).alias("status")
    reason = F.when(F.col("outcome") == "high_risk_skipped", "high_risk_auto_skip").when(F.col("outcome") == "generation_failed", F.col("refusal")).when(F.col("outcome") == "daily_limit_reached", "daily_limit_reached")
    return rows.select("id", "outcome", status, F.when(F.col("outcome") == "done", 1).otherwise(0).alias("post_count"), posted("content"), posted("content_mode"), posted("char_count"), posted("estimated_score"), reason.alias("reason"))

"""What is generated next, and what has expired."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import worthy


def eligible(clusters: DataFrame, as_of: Column, threshold: Column, hours: int = 6) -> DataFrame:
    """New clusters without posts, first seen in the last hours, with a score of at least the threshold."""
    return clusters.where((F.col("status") == "new") & (F.col("post_count") == 0) & (F.col("first_seen_at") > as_of - F.make_dt_interval(hours=F.lit(hours))) & (F.coalesce("score", F.lit(0.0)) >= threshold))


def outcomes(clusters: DataFrame, as_of: Column, threshold: Column, headline: str = "headline") -> DataFrame:
    """Eligible clusters with what becomes of them: candidate, low_signal_skipped or high_risk_skipped."""
    out = F.when(~worthy(headline), "low_signal_skipped").when(F.col("risk_level") == "high", "high_risk_skipped").otherwise("candidate")
    return eligible(clusters, as_of, threshold).withColumn("outcome", out)


def next_candidates(clusters: DataFrame, as_of: Column, threshold: Column, n: int = 2, headline: str = "headline") -> DataFrame:
    """The n best worthy clusters by score, then the newest, then id. The risk gate comes later, so it does not free places."""
    return eligible(clusters, as_of, threshold).where(worthy(headline)).orderBy(F.desc("score"), F.desc("first_seen_at"), "id").limit(n)


def taken_and_deferred(clusters: DataFrame, as_of: Column, threshold: Column, n: int = 2, headline: str = "headline") -> DataFrame:
    """One row: how many worthy clusters a run has, how many of them it takes, and how many wait for a later one."""
    found = eligible(clusters, as_of, threshold).where(worthy(headline)).agg(F.count(F.lit(1)).alias("candidates"))
    return found.select("candidates", F.least("candidates", F.lit(n)).alias("taken"), F.greatest(F.col("candidates") - n, F.lit(0)).alias("deferred"))


def room_today(posts: DataFrame, as_of: Column, limit: Column) -> DataFrame:
    """One row: posts of the last 24 hours, the limit, and how many more may follow."""
    n = F.count_if(F.col("created_at") > as_of - F.make_dt_interval(days=F.lit(1)))
    return posts.agg(n.alias("posts_24h")).withColumn("daily_limit", limit).withColumn("room", F.greatest(F.col("daily_limit") - F.col("posts_24h"), F.lit(0)))


def expired(posts: DataFrame, as_of: Column, hours: int = 8) -> DataFrame:
    """Posts whose status becomes expired: pending for longer than the hours."""
    gone = (F.col("status") == "pending") & (F.col("created_at") < as_of - F.make_dt_interval(hours=F.lit(hours)))
    return posts.withColumn("status", F.when(gone, "expired").otherwise(F.col("status")))


def generate(clusters: DataFrame, write, schema: str = "cluster_id long, content_mode string, content string") -> DataFrame:
    """Posts by a pluggable writer of pandas batches; ``template_post`` needs no service."""
    return clusters.mapInPandas(write, schema)


def template_post(batches):
    """Deterministic posts: the whole headline as breaking news. ``guards.refusal`` says which are too long."""
    for pdf in batches:
        text = pdf["headline"].fillna("").str.strip()
        yield pdf.assign(cluster_id=pdf["id"], content_mode="pure_news", content="Breaking: " + text)[["cluster_id", "content_mode", "content"]]

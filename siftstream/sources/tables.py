"""Views of the tables that the queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: "Now" of all queries.
AS_OF = "2024-01-01 16:40:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as items of a feed."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.trim(F.regexp_extract("text", r"^[^.\n]+", 0)).alias("title"), F.substring("text", 1, 500).alias("summary"), F.col("source").alias("source_name"),
        F.col("lang").alias("category"), (F.col("doc_id") % 6 + 5).cast("int").alias("weight"), (F.lit(1704067200000) + F.col("doc_id") * 60000).alias("ms"),
        F.timestamp_millis(F.lit(1704067200000) + F.col("doc_id") * 60000).alias("published_at"))


ITEMS_SQL = r"""items AS (SELECT doc_id AS id, trim(regexp_extract(text, '^[^.\n]+')) AS title, substr(text, 1, 500) AS summary, source AS source_name, lang AS category,
 CAST(5 + doc_id % 6 AS INTEGER) AS weight, 1704067200000 + doc_id * 60000 AS ms FROM documents)"""
#: "Now" in milliseconds.
AS_OF_MS = 1704127200000

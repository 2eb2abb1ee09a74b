"""What is served: ranked feeds, the newest of each kind, counters, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def latest_of_each(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each group in an order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def best(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def page(df: DataFrame, limit: int, offset: int, *order: Column) -> DataFrame:
    """One page, each row with the total before paging."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).crossJoin(total)


def with_children(parents: DataFrame, children: DataFrame, key: str, child_key: str, row: Column, name: str) -> DataFrame:
    """Parents with a sorted list of their children, empty if none. Only the children of these parents are gathered."""
    wanted = parents.select(F.col(key).alias(child_key)).distinct()
    lists = children.join(wanted, child_key, "left_semi").groupBy(F.col(child_key).alias("_k")).agg(F.array_sort(F.collect_list(row)).alias(name))
    return parents.join(lists, parents[key] == F.col("_k"), "left").drop("_k")


def having(parents: DataFrame, children: DataFrame, key: str, child_key: str) -> DataFrame:
    """Parents with a child."""
    return parents.join(children.select(F.col(child_key).alias(key)), key, "left_semi")


def members(parents: DataFrame, items: DataFrame, ids: str, item_key: str, most: int = 10) -> DataFrame:
    """Parents joined with the items among their first ids."""
    one = parents.withColumn("_id", F.explode(F.slice(ids, 1, most)))
    return one.join(items, one["_id"] == items[item_key]).drop("_id")


def counters(tables: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """One row with the number of rows that meet each table's condition."""
    out = None
    for name, (df, cond) in tables.items():
        one = df.agg(F.count_if(cond).alias(name))
        out = one if out is None else out.crossJoin(one)
    return out


def digest(df: DataFrame, score: str, seen: str, headline: str, *ties: str) -> DataFrame:
    """One row for a stream of new rows: count, best score and headline, newest time, the three best headlines."""
    best = df.select(F.struct(-F.col(score), *ties, headline).alias("b")).orderBy("b").limit(3).agg(F.array_sort(F.collect_list("b")).alias("r"))
    return df.agg(F.count(F.lit(1)).alias("n"), F.max(score).alias("top_score"), F.max(seen).alias("cursor")).crossJoin(best).select(
        "n", "top_score", F.try_element_at(F.col("r"), F.lit(1))[headline].alias("top_headline"), "cursor", F.slice(F.col(f"r.{headline}"), 1, 3).alias("best"))


def with_status(df: DataFrame, status: str | None) -> DataFrame:
    """Rows of a status, or all if none is asked for."""
    return df if status is None else df.where(F.col("status") == status)


def preview(clusters: DataFrame, posts: DataFrame, n: int = 3) -> DataFrame:
    """The newest n posts of the cluster that was updated last among those with posts: pending ones, or if it has none, any."""
    last = clusters.where("post_count > 0").orderBy(F.desc("last_updated_at"), "cluster_id").limit(1).select("cluster_id")
    mine = posts.join(last, "cluster_id", "left_semi")
    pending = F.col("status") == "pending"
    ranked = mine.withColumn("_n", F.row_number().over(Window.orderBy(pending.desc(), F.desc("created_at"), "post_id"))).withColumn("_p", F.max(pending).over(Window.partitionBy()))
    by_time = mine.withColumn("_n", F.row_number().over(Window.orderBy(F.desc("created_at"), "post_id")))
    some = ranked.where(pending & (F.col("_n") <= n)).select(*posts.columns)
    none = by_time.join(ranked.where("_p").limit(1).select(F.lit(1).alias("_x")), F.lit(True), "left_anti").where(F.col("_n") <= n).select(*posts.columns)
    return some.unionByName(none)


def as_response(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """One row: a bounded result as a JSON answer {name: rows}, in an order."""
    rows = df.withColumn("_n", F.row_number().over(Window.orderBy(*order)))
    body = F.transform(F.array_sort(F.collect_list(F.struct("_n", F.struct(*df.columns).alias("row")))), lambda x: x["row"])
    return rows.agg(F.to_json(F.struct(body.alias(name))).alias("body"))


def stable_id(*parts: str | Column) -> Column:
    """A repeatable id of a row, where the original has a random one."""
    return F.sha2(F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]), 256)

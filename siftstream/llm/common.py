"""What the corpus operators share: shared folders, size checks and key ranges."""

from __future__ import annotations

import atexit
import math
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A table of at most so many rows and bytes (estimated by the optimizer, of a written table the size of its files) may be
#: broadcast or go to the driver.
BROADCAST_ROWS, BROADCAST_BYTES = 400_000, 16 << 20

_own: list[str] = []


def session(spark: SparkSession) -> SparkSession:
    """Lets the workers of a local session import this package; a cluster has it installed."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if spark.sparkContext.master.startswith("local") and root not in env.get("PYTHONPATH", ""):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))]))
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == f"{64 << 20}b":
        # the default; workers hold several forms of a batch
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{8 << 20}b")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one of our own where that is unset and all
    run on this machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="siftstream-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/siftstream/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def size_of(df: DataFrame) -> int:
    """Bytes that the optimizer expects of df."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def fits(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a written table is small enough to broadcast, by bytes and rows."""
    return size_of(df) <= size and df.limit(rows + 1).count() <= rows


def small(df: DataFrame) -> DataFrame:
    """A written table with a broadcast hint if it fits; else joins shuffle it."""
    return F.broadcast(df) if fits(df) else df


#: A key is hot if it has more than one in so many rows, so there are fewer hot keys than this.
HOT_KEYS = 2000


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Inner join of rows with a table of one row for each of the keys, whose column count says how many rows a key has of
    total. A hot key is dealt over as many parts as hold total / HOT_KEYS rows each, by a hash of the row and where it is
    read; the parts of all hot keys together are fewer than twice HOT_KEYS, which bounds what is broadcast and copied."""
    part = max(1.0, total / HOT_KEYS)
    hot = table.where(F.col(count) > part).select(*keys, F.ceil(F.col(count) / part).cast("int").alias("_parts"))
    at = F.pmod(F.xxhash64(*rows.columns, F.spark_partition_id()), F.coalesce("_parts", F.lit(1))).cast("int")
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("_part", at).drop("_parts")
    parts = F.when(F.col(count) > part, F.sequence(F.lit(0), F.ceil(F.col(count) / part).cast("int") - 1)).otherwise(F.array(F.lit(0)))
    return dealt.join(table.withColumn("_part", F.explode(parts)), [*keys, "_part"]).drop("_part")


def text_of(col: str | Column = "text") -> Column:
    """A text column with null taken as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


#: Ranges that are cut from all rows at once; more are cut within each of these.
RANGES_AT_ONCE = 1024


def _bounds(key: str, n: int) -> Column:
    return F.percentile_approx(key, [i / n for i in range(1, n)], max(10_000, 20 * n))


def with_range(docs: DataFrame, key: str, weight: Column, per_range: int, name: str = "_r") -> DataFrame:
    """Adds the number of the range that each row's integer key lies in, ascending by key, in ranges of about per_range total
    weight. Null keys lie in the first, equal keys in one range.

    The bounds come from all rows (Greenwald-Khanna summaries, narrow scans). Up to RANGES_AT_ONCE are a tree of comparisons;
    a larger number is cut in two steps, as the ranges of each range, of which a row has a bounded list; the table of these
    lists is broadcast only if it is small.
    """
    rows, total = docs.agg(F.count(F.lit(1)), F.sum(weight.cast("long"))).first()
    n = min(math.ceil((total or 0) / per_range), rows)
    if n <= 1:
        return docs.withColumn(name, F.lit(0).cast("long"))
    outer = n if n <= RANGES_AT_ONCE else math.ceil(math.sqrt(n))
    bounds = sorted(set(docs.agg(_bounds(key, outer)).first()[0] or []))
    docs = docs.withColumn(name, _binary(key, bounds))
    if outer == n:
        return docs
    inner = math.ceil(n / outer)
    fine = written(docs.groupBy(name).agg(F.array_distinct(_bounds(key, inner)).alias("_bounds")), "ranges")
    docs = docs.join(small(fine), name)
    within = F.coalesce(F.size(F.filter("_bounds", lambda b: b < F.col(key))), F.lit(0))
    return docs.withColumn(name, F.col(name) * inner + F.when(F.col(key).isNull(), 0).otherwise(within)).drop("_bounds")


def _binary(key: str, bounds: list[int]) -> Column:
    """A balanced tree of comparisons: log2(n) steps for each row."""

    def tree(lo: int, hi: int) -> str:
        if lo == hi:
            return f"{lo}L"
        mid = (lo + hi) // 2
        return f"IF(`{key}` <= {bounds[mid]}L, {tree(lo, mid)}, {tree(mid + 1, hi)})"

    return F.expr(f"IF(`{key}` IS NULL, 0L, {tree(0, len(bounds))})")

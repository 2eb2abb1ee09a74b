"""Winnowing fingerprints in DataFrame functions only.

A text's words are hashed, every run of K words gets a rolling polynomial hash, and of every window of W such hashes the
smallest is kept, the rightmost of equals, with its position. Two texts that share W + K - 1 words in a row share a kept
hash; what is shorter than K words never matches unless the whole texts are equal.

All passes over a text are array functions: the polynomial of K words and the minimum of W hashes are built by doubling, so
each costs about log2 passes. A hash below 2**31 and the position from the end share a long, so that ``least`` also settles
ties, and so that array_distinct of the window minima is the fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import session, small, text_of, with_range, written

K, W = 5, 8
PRIME, BASE = (1 << 31) - 1, 1_000_003


def _shifted(a: Column, by: int, f) -> Column:
    """f(a[i], a[i + by]) for all i that have both."""
    n = F.greatest(F.size(a) - F.lit(by), F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(by + 1), n), f)


def _join(n: int):
    """The polynomial of some words followed by n others, from both polynomials."""
    by = pow(BASE, n, PRIME)
    return lambda x, y: F.pmod(x * F.lit(by) + y, F.lit(PRIME))


def fingerprints(df: DataFrame, text: str, out: str, k: int = K, w: int = W) -> DataFrame:
    """Adds out: array<long> of hash << 32 | (2**32 - 1 - position), by ascending position of the word that begins a run.

    A text of fewer than k words (empty and null included) has one run, of all its words; fewer than w runs make one
    window. Words are what stands between white space, case kept. Equal texts have equal fingerprints.
    """
    h, cols = f"_{out}", df.columns
    # pmod keeps word hashes below the prime, so no product reaches 2**62
    df = df.withColumn(h, F.transform(F.split(F.trim(F.regexp_replace(text_of(text), r"\s+", " ")), " "), lambda x: F.pmod(F.xxhash64(x), F.lit(PRIME))))
    short = F.transform(F.array(F.col(h)), lambda a: F.aggregate(a, F.lit(7).cast("long"), lambda s, x: F.pmod(s * F.lit(BASE) + x, F.lit(PRIME))))
    df = df.withColumn(f"{h}_s", F.when(F.size(h) < k, short))
    # the polynomial of the first 2**i words, and of those that make up k
    have, name, power, acc = 0, None, 1, h
    while True:
        if k & power:
            if name is None:
                have, name = power, acc
            else:
                n = F.greatest(F.size(acc) - F.lit(have), F.lit(0))
                df = df.withColumn(f"{name}_{power}", F.zip_with(F.slice(F.col(name), F.lit(1), n), F.slice(F.col(acc), F.lit(have + 1), n), _join(power)))
                have, name = have + power, f"{name}_{power}"
        if 2 * power > k:
            break
        df = df.withColumn(f"{acc}d", _shifted(F.col(acc), power, _join(power)))
        acc, power = f"{acc}d", 2 * power
    grams = F.when(F.size(h) < k, F.col(f"{h}_s")).otherwise(F.col(name))
    last = (1 << 32) - 1
    df = df.withColumn(f"{h}_v", F.transform(grams, lambda x, i: F.shiftleft(x, 32) + (F.lit(last) - i.cast("long"))))
    # minima over windows of 1, 2, 4 ... runs, then over w of them by two that overlap
    have, name = 1, f"{h}_v"
    while have < w:
        by = min(have, w - have)
        df = df.withColumn(f"{name}m", _shifted(F.col(name), by, lambda x, y: F.least(x, y)))
        have, name = have + by, f"{name}m"
    df = df.withColumn(out, F.when(F.size(f"{h}_v") < w, F.array(F.array_min(f"{h}_v"))).otherwise(F.array_distinct(name)))
    return df.select(*cols, out)


def hashes(fingerprint: str | Column) -> Column:
    """The distinct hashes of a fingerprint, without positions."""
    return F.array_distinct(F.transform(fingerprint, lambda v: F.shiftright(v, 32).cast("int")))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard coefficient of two arrays of distinct hashes."""
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both)).cast("double")


def shown(fingerprint: str) -> Column:
    """A fingerprint as text: 16 hexadecimal digits for each kept hash, 8 of the hash and 8 of 2**32 - 1 - position."""
    return F.array_join(F.transform(fingerprint, lambda v: F.lpad(F.hex(v), 16, "0")), " ")


def with_next(docs: DataFrame, derive=lambda df: df, key: str = "doc_id", chars_per_range: int = 4_000_000) -> DataFrame:
    """Adds next: a struct of all columns of the row that follows by (key, text), after the last the first.

    derive adds columns to the rows before they are shuffled.

    One shuffle by ranges of the key, whose bounds come from all rows. Each range also gets a copy of the row that begins
    the range behind it, so that its last row sees its follower; those copies number as many as the ranges.
    """
    docs = with_range(docs, key, F.length("text") + 1, chars_per_range).withColumn("_t", F.xxhash64("text"))
    firsts = written(docs.groupBy("_r").agg(F.min(F.struct(F.col(key).alias("k"), F.col("_t").alias("t"))).alias("f")), "firsts")
    # a row per range, in one task: the range before it, and for the first the last
    order = Window.orderBy("_r")
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marks = written(firsts.select(F.coalesce(F.lag("_r").over(order), F.last("_r").over(everything)).alias("_to"), F.col("f.k").alias("_k"), F.col("f.t").alias("_tt")), "marks")
    copies = docs.join(small(marks), F.col(key).eqNullSafe(F.col("_k")) & (F.col("_t") == F.col("_tt"))).withColumn("_r", F.col("_to")).drop("_to", "_k", "_tt").withColumn("_copy", F.lit(1))
    both = derive(docs.withColumn("_copy", F.lit(0)).unionByName(copies))
    cols = [c for c in both.columns if c not in ("_r", "_t", "_copy")]
    order = Window.partitionBy("_r").orderBy("_copy", F.col(key).asc_nulls_first(), "_t")
    return both.withColumn("next", F.lead(F.struct(*cols)).over(order)).where("_copy = 0").select(*cols, "next")


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each whole text, of its edited text, and their likeness to each other and to the next document's.

    The edited text has the last floor(n/4) of n code points replaced by as many from the start of the next document by
    ascending id (after the last: the first; of a single document: its own). Rows with equal ids are ordered by a hash of
    their texts and each kept; null ids come first; null texts are empty; other columns are ignored; an empty table gives
    none.
    """
    session(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    marked = with_next(docs, lambda df: fingerprints(df, "text", "fp"))
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next.text"), F.lit(1), cut))
    marked = marked.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fp", hashes("next.fp").alias("next_h"))
    out = fingerprints(marked, "edited", "efp").withColumn("h", hashes("fp"))
    return out.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), shown("fp").alias("fingerprint"), shown("efp").alias("edited_fingerprint"),
        likeness(F.col("h"), hashes("efp")).alias("near_edited"), likeness(F.col("h"), F.col("next_h")).alias("near_next"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Target-distribution importance resampling over hashed word n-grams.

Documents are drawn so that their n-grams are spread like the target's. N-grams fall into buckets by crc32; a bucket's gain is
the logarithm of how much likelier the target is to use it. To hash little, a block of documents maps its distinct words to
integers, n-grams are tuples of those, and each distinct tuple's bytes are hashed once; buckets are joined back to the n-grams
of each document by position. Dictionaries live in their block, so no word or n-gram is ever shuffled: what leaves a block is
two bytes for each n-gram.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import session, small, text_of, written
from .files import release
from .tokens import chunks

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 25, 7
#: Bytes of UTF-8 whose n-grams are made at once.
BLOCK = 2_000_000

#: Digits, a-z and every byte of a code point from 0x80 on are parts of words, A-Z are lower-cased, the rest are spaces.
_WORDS = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else c + 32 if 65 <= c < 91 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split()


def block_buckets(texts: list[str], buckets: int = BUCKETS) -> tuple[list[int], list[np.ndarray]]:
    """For each text how many words it has, and the buckets of its features: its words, then its pairs of words."""
    lists = [words_of(t) for t in texts]
    sizes = [len(x) for x in lists]
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for x in lists for w in x), np.int64, sum(sizes))
    words = list(known)
    one = (np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets)[ids]
    # a pair's bytes are its first word, a space and its second word: the checksum goes on from that of the first two
    begun = [zlib.crc32(w + b" ") for w in words]
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    inside = np.ones(max(0, len(ids) - 1), bool)
    cuts = starts[1:-1]
    inside[cuts[(cuts > 0) & (cuts < len(ids))] - 1] = False
    pairs, which = np.unique(((ids[:-1] << 32) | ids[1:])[inside], return_inverse=True)
    two = (np.fromiter((zlib.crc32(words[b], begun[a]) for a, b in zip((pairs >> 32).tolist(), (pairs & 0xFFFFFFFF).tolist())), np.int64, len(pairs)) % buckets)[which]
    out, at = [], 0
    for k, n in enumerate(sizes):
        more = max(0, n - 1)
        out.append(np.concatenate([one[starts[k] : starts[k] + n], two[at : at + more]]))
        at += more
    return sizes, out


def _kind(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


FEATURES = "doc_id long, n_words long, n_features long, features binary"


def _features(batches, buckets: int):
    import pyarrow as pa

    release()
    kind = _kind(buckets)
    for batch in batches:
        keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lo, hi in chunks(texts, BLOCK):
            sizes, found = block_buckets(texts[lo:hi], buckets)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[lo:hi], pa.int64()), pa.array(sizes, pa.int64()), pa.array([len(x) for x in found], pa.int64()), pa.array([np.sort(x).astype(kind).tobytes() for x in found], pa.binary())],
                names=["doc_id", "n_words", "n_features", "features"])


def features(docs: DataFrame, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features and features (the sorted buckets of all words and pairs of neighbouring words) of each
    row. Null texts have none."""
    session(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(lambda b: _features(b, buckets), FEATURES)


def _totals(batches, buckets: int):
    import pyarrow as pa

    total, kind = np.zeros(buckets, np.int64), _kind(buckets)
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            total += np.bincount(np.frombuffer(raw, kind), minlength=buckets)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])


def totals(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features lie in each bucket: one row per bucket and task, and as many numbers as buckets to the driver."""
    rows = found.select("features").mapInArrow(lambda b: _totals(b, buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain in thousandths: the log of its smoothed share in the target by that in the raw documents."""
    n = float(len(raw))
    s, t = float(raw.sum()) + n, float(target.sum()) + n
    return np.array([math.floor(1000 * math.log((b + 1.0) * s / ((a + 1.0) * t))) for a, b in zip(raw.tolist(), target.tolist())], np.int64)


def _weights(batches, gain: np.ndarray, seed: int):
    import hashlib

    import pyarrow as pa

    kind = _kind(len(gain))
    for batch in batches:
        keys, sizes = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        weights = [int(gain[np.frombuffer(raw, kind)].sum()) // n if n else 0 for raw, n in zip(batch.column(3).to_pylist(), sizes)]
        noise = []
        for k in keys:
            h = int(hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
            noise.append(math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(weights, pa.int64()), pa.array([a + b for a, b in zip(weights, noise)], pa.int64())], names=["doc_id", "n_words", "n_features", "weight", "score"])


#: Rows that a task orders.
PER_RANGE = 500_000


def ranked(rows: DataFrame, n: int, *order) -> DataFrame:
    """The n rows with rank 1, 2, 3 ... in the given order: ranges of the order are sorted apart, and what stands before each
    range is a running sum over the ranges, of which there is one for PER_RANGE rows."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / PER_RANGE))
    spread = written(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("_at", 33)
    sizes = spread.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = written(sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before")), "before")
    return spread.withColumn("_part", part).join(small(before), "_part").withColumn("rank", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_part", "_at", "_before")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank for every row of docs.

    weight: the floored mean of the gains of a document's features (0 without any). score: weight plus Gumbel noise in
    thousandths from a hash of seed and id, so that the largest scores are a draw without replacement in proportion to
    exp(weight / 1000). rank: 1, 2, 3 ... for the percent of the documents with at least least_words words that have the
    largest scores, ties to the smaller id (null ids last); null for the others.

    Null texts have no features; null ids are empty in the hash. Repeated rows are documents each, in any order among
    themselves. Other columns are ignored; an empty table gives none, an empty target leaves all gains to the documents.

    Plan: documents are read once; their buckets are a written table, which two narrow scans read. Only (id, score) of
    documents that can be drawn is shuffled, by ranges of the order.
    """
    spark = session(docs.sparkSession)
    found = written(features(docs, buckets, id_col, text_col), "features")
    gain = gains(totals(found, buckets), totals(features(target.select(F.lit(None).cast("long").alias("doc_id"), F.col(target_col).alias("text")), buckets), buckets))
    scored = written(found.mapInArrow(lambda b: _weights(b, gain, seed), "doc_id long, n_words long, n_features long, weight long, score long"), "scored")
    able = F.col("n_words") >= least_words
    n = scored.where(able).count()
    most = percent * n // 100
    # the last column makes the order of equal rows the same in each attempt
    rows = scored.where(able).withColumn("_row", F.monotonically_increasing_id())
    drawn = ranked(rows, n, F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_row")).withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    rest = scored.where(~able).withColumn("rank", F.lit(None).cast("long"))
    cols = ("doc_id", "n_features", "weight", "score", "rank")
    return drawn.select(*cols).unionByName(rest.select(*cols))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

"""N-gram Jaccard join with Bayesian pruning of candidates.

Texts are sets of five-word shingles. Equal texts are one class and are compared once. MinHash bands bring candidates
together; within a bucket, pairs compare their MinHash values a few at a time, and a pair is dropped as soon as the
posterior probability that its Jaccard coefficient reaches the threshold falls below a tolerance. The rest are verified on
their whole shingle sets. Pairs never leave the task that finds them: it returns link counts and a spanning forest.

Texts are known by the first half of their SHA-256, so repeated and missing ids do no harm.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import session, small, spread_join, text_of, written
from .files import release
from .hashes import BASE, mixed, powers
from .tokens import chunks

SHINGLE, THRESHOLD = 5, 0.8
#: Bands of values each: a pair at the threshold shares a band but for one case in 20,000; values compared at a time.
BANDS, ROWS, STEP = 25, 5, 16
VALUES = 128
#: A pair is dropped when its posterior falls below this.
TOLERANCE = 1e-4
#: Members and shingles of a block: larger buckets are compared block by block.
BLOCK, BLOCK_SHINGLES = 512, 1_000_000
#: Characters whose shingles are made at once, and bytes of a batch of members.
CHARS, BATCH_BYTES = 400_000, 4 << 20
#: Bytes of members in a shuffle partition.
PARTITION_BYTES = 64 << 20
#: Signs of ASCII that are no part of words.
SIGNS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

_rng = np.random.Generator(np.random.PCG64(20240229))
_A = (_rng.integers(0, 1 << 32, VALUES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, VALUES, dtype=np.uint64).astype(np.uint32)


def words_of(text: str) -> bytes:
    """Words in lower case without signs, one space between: what shingles are made of."""
    return b" ".join(" ".join(text.lower().split()).encode("utf-8", "surrogatepass").translate(None, SIGNS).split())


def shingle_sets(texts: list[str], k: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's runs of k words (``words_of``); a shorter text has one, of all its
    words, and a text without words none."""
    lines = [words_of(t) for t in texts]
    counts = np.fromiter((x.count(b" ") + 1 if x else 0 for x in lines), np.int64, len(lines))
    if not counts.sum():
        return [np.empty(0, np.uint64) for _ in texts]
    raw = np.frombuffer(b" ".join(x for x in lines if x) + b" ", np.uint8)
    # the hash of a word: its letters' polynomial, shifted to the front
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(raw)), dtype=np.uint64, out=total[1:])
    ends = np.flatnonzero(raw == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    back = powers(pow(BASE, -1, 1 << 64), len(raw))
    words = mixed((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    del total, back
    run = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for j in range(k):
        run = run * np.uint64(0x100000001B3) + words[j : j + len(run)]
    run = mixed(run)
    out, at = [], 0
    for c in counts.tolist():
        if c >= k:
            out.append(np.unique(run[at : at + c - k + 1]))
        elif c:
            h = np.array([c], np.uint64)
            for x in range(at, at + c):
                h = (h * np.uint64(31)) ^ words[x : x + 1]
            out.append(mixed(h))
        else:
            out.append(np.empty(0, np.uint64))
        at += c
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """The smallest of the shingles' values under each of VALUES hash functions."""
    h = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    best = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), 512):
        np.minimum(best, (h[at : at + 512, None] * _A + _B).min(axis=0), out=best)
    return best


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """n x BANDS hashes of the bands of signatures."""
    s = signatures[:, : BANDS * ROWS].astype(np.uint64).reshape(len(signatures), BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :].repeat(len(s), 0)
    for j in range(ROWS):
        key = key * np.uint64(0x9E3779B97F4A7C15) + s[:, :, j]
    return mixed(key)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For each number of compared values, the fewest that must agree for a posterior (uniform prior) of tolerance."""
    out = {}
    for n in range(STEP, VALUES + 1, STEP):
        # P(J >= t | m of n) is the chance of at most m successes of n + 1 at t
        tail, m = 0.0, 0
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                break
        out[n] = m
    return out


def _pairs_of(n: int, m: int | None):
    """All pairs within n members, or between n and m others, in slices of bounded size."""
    if m is None:
        i, j = np.triu_indices(n, 1)
    else:
        i, j = np.divmod(np.arange(n * m), m)
        j = j + n
    for at in range(0, len(i), 1 << 16):
        yield i[at : at + (1 << 16)], j[at : at + (1 << 16)]


class _Sets:
    """Sizes of intersections of shingle sets. Small sets are compared as Python's sets, which are kept while they number a
    bounded count of shingles; large ones as sorted arrays."""

    def __init__(self, sets: list[np.ndarray], most: int = 500_000):
        self.sets, self.most, self.known, self.held = sets, most, {}, 0

    def _set(self, k: int) -> frozenset:
        got = self.known.get(k)
        if got is None:
            got = frozenset(self.sets[k].tolist())
            if self.held > self.most:
                self.known, self.held = {}, 0
            self.known[k] = got
            self.held += len(got)
        return got

    def both(self, a: int, b: int) -> int:
        if max(len(self.sets[a]), len(self.sets[b])) > 4000:
            return len(np.intersect1d(self.sets[a], self.sets[b], assume_unique=True))
        return len(self._set(a) & self._set(b))


def links_in_block(band: int, sigs: np.ndarray, sets: list[np.ndarray], split: int | None, least: dict[int, int], threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs of a block's members that meet in this band first. split: only pairs across that position."""
    n = len(sigs)
    keys = band_keys(sigs)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    found_i, found_j = [], []
    members = _Sets(sets)
    for i, j in _pairs_of(n if split is None else split, None if split is None else n - split):
        # a pair belongs to the first band in which it meets; sizes alone may rule it out
        ok = (np.minimum(sizes[i], sizes[j]) >= threshold * np.maximum(sizes[i], sizes[j])) & (keys[i, band] == keys[j, band])
        i, j = i[ok], j[ok]
        if band and len(i):
            ok = ~(keys[i, :band] == keys[j, :band]).any(axis=1)
            i, j = i[ok], j[ok]
        same = np.zeros(len(i), np.int64)
        for at in range(0, VALUES, STEP):
            if not len(i):
                break
            same += (sigs[i, at : at + STEP] == sigs[j, at : at + STEP]).sum(axis=1)
            ok = same >= least[at + STEP]
            i, j, same = i[ok], j[ok], same[ok]
        if len(i):
            both = np.fromiter((members.both(a, b) for a, b in zip(i.tolist(), j.tolist())), np.int64, len(i))
            ok = both >= threshold * (sizes[i] + sizes[j] - both) - 1e-9
            found_i.append(i[ok])
            found_j.append(j[ok])
    none = np.empty(0, np.int64)
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (none, none)


def _forest(ids: list, i: np.ndarray, j: np.ndarray) -> list[tuple]:
    """(member, smallest member) for each component of a block's links."""
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(i.tolist(), j.tolist()):
        a, b = root(a), root(b)
        if a != b:
            if ids[a] > ids[b]:
                a, b = b, a
            parent[b] = a
    return [(ids[x], ids[root(x)]) for x in set(i.tolist()) | set(j.tolist()) if root(x) != x]


BAND = "rep binary, band int, key long, size int"
MEMBER = "band int, key long, left int, right int, mine int, rep binary, sig binary, shingles binary"
LINK = "rep binary, links long, root binary"


def _bands(batches):
    import pyarrow as pa

    release()
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lo, hi in chunks(texts, CHARS):
            sets = shingle_sets(texts[lo:hi])
            use = [k for k, s in enumerate(sets) if len(s)]
            if use:
                keys = band_keys(np.stack([signature(sets[k]) for k in use])).astype(np.int64)
                reps = pa.array([ids[lo + k] for k in use], pa.binary()).take(pa.array(np.repeat(np.arange(len(use)), BANDS)))
                size = np.repeat(np.array([len(sets[k]) for k in use], np.int32), BANDS)
                yield pa.RecordBatch.from_arrays([reps, pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(use))), pa.array(keys.ravel()), pa.array(size)], names=["rep", "band", "key", "size"])


def _members(batches):
    """The signature and shingles of texts that share a bucket, once for each block that they are compared in."""
    release()
    rows, size = [], 0
    for batch in batches:
        ids, texts, todo = (batch.column(k).to_pylist() for k in range(3))
        for lo, hi in chunks(texts, CHARS):
            for rep, s, blocks in zip(ids[lo:hi], shingle_sets(texts[lo:hi]), todo[lo:hi]):
                sig, raw = signature(s).tobytes(), s.tobytes()
                for b in blocks:
                    mine = b["block"]
                    for other in range(b["blocks"]):
                        rows.append((b["band"], b["key"], min(mine, other), max(mine, other), mine, rep, sig, raw))
                        size += len(sig) + len(raw)
                        if size >= BATCH_BYTES:
                            yield _member_batch(rows)
                            rows, size = [], 0
    if rows:
        yield _member_batch(rows)


def _member_batch(rows):
    import pyarrow as pa

    types = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=["band", "key", "left", "right", "mine", "rep", "sig", "shingles"])


def _compare(batches, threshold: float):
    """Links of each block pair, whose members come one after another."""
    release()
    least = least_matches(threshold)
    held, key, out = [], None, []

    def finish():
        if len(held) < 2:
            return
        band, left, right = key[0], key[2], key[3]
        split = None if left == right else sum(h[0] == left for h in held)
        sigs = np.frombuffer(b"".join(h[2] for h in held), np.uint32).reshape(len(held), VALUES)
        i, j = links_in_block(band, sigs, [np.frombuffer(h[3], np.uint64) for h in held], split, least, threshold)
        if len(i):
            ids = [h[1] for h in held]
            times = np.bincount(np.concatenate([i, j]), minlength=len(ids))
            roots = dict(_forest(ids, i, j))
            out.extend((ids[k], int(times[k]), roots.get(ids[k], ids[k])) for k in np.flatnonzero(times))

    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if row[:4] != key:
                finish()
                held, key = [], row[:4]
                if len(out) >= 4096:
                    yield _link_batch(out)
                    out.clear()
            held.append(row[4:])
    finish()
    if out:
        yield _link_batch(out)


def _link_batch(rows):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.binary(), pa.int64(), pa.binary()))], names=["rep", "links", "root"])


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, root): the smallest id of each id's component, for edges (a, b). Each round every id takes the smallest label
    among its neighbours' and itself, then its label's own; rounds end when nothing changes. A written table each round."""
    edges = written(edges.where("a <> b").select("a", "b").distinct(), "edges")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("id").alias("b"), F.col("root")), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        step = labels.join(near, "id").select("id", "root", F.least("root", "near").alias("low"))
        jump = step.join(labels.select(F.col("id").alias("low"), F.col("root").alias("up")), "low", "left")
        new = written(jump.select("id", F.least("low", F.coalesce("up", "low")).alias("root"), (F.least("low", F.coalesce("up", "low")) != F.col("root")).alias("moved")), "labels")
        labels = new.select("id", "root")
        if new.where("moved").limit(1).count() == 0:
            return labels
    raise RuntimeError("components did not settle")


def _digest(text: str = "text"):
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, copy_id, class_id, n_copies, n_links for every row of docs, then digest and class_digest.

    copy_id: the smallest doc_id with an equal text. n_copies: how many rows have that text. n_links: with how many other
    texts its Jaccard coefficient on five-word shingles is at least the threshold. class_id: the smallest copy_id that
    chains of links reach; so copies and linked texts share it, and class_digest is that text's digest. Texts without words
    (null ones included) are copies of each other if equal and have no links. Ids only name rows: each text is compared once
    whichever rows have it, so null ids (which come after all others) and ids with several texts lose nothing. Repeated
    rows are copies. Other columns are ignored; an empty table gives none.

    Plan: one narrow aggregate finds copies. The texts' band keys (25 narrow rows a text) are grouped; buckets with the same
    members in several bands are kept once. Only texts in buckets are read again; their signatures and shingles are shuffled
    by block pair, and a bucket of any size is split into blocks of about BLOCK members and BLOCK_SHINGLES shingles, so no
    task holds more than two blocks. Links are then narrow. Joins by text, bucket and class deal the rows of hot keys over
    many tasks (``spread_join``).
    """
    spark = session(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    hashed = docs.select("doc_id", _digest().alias("digest"))
    rows = hashed.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    # first_rows: rows that have the text's own id too
    copies = written(rows.groupBy("digest").agg(F.min("doc_id").alias("copy_id"), F.sum("n").alias("n_copies"), F.min_by("n", F.struct(F.col("doc_id").isNull(), "doc_id")).alias("first_rows")), "copies")
    several = copies.where("n_copies > 1")
    total = copies.agg(F.sum("n_copies")).first()[0] or 0
    other = written(spread_join(hashed, several, ["digest"], "n_copies", total).where("NOT (doc_id <=> copy_id)").select("doc_id", "digest").distinct(), "copied")
    repeated = not several.where("first_rows > 1").isEmpty()

    texts = docs.withColumn("rep", _digest())
    copied = small(other)
    reps = texts.join(copied, (texts["rep"] == copied["digest"]) & texts["doc_id"].eqNullSafe(copied["doc_id"]), "left_anti").select("rep", "text")
    found = reps.mapInArrow(_bands, BAND)
    bands = written(found.distinct() if repeated else found, "bands")
    # equal member sets have equal sums of hashed members
    h = F.xxhash64("rep")
    buckets = bands.groupBy("band", "key").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("size").cast("long")).alias("shingles"), F.sum(h.cast("decimal(20,0)")).alias("s1"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("s2"), F.min("rep").alias("low")).where("n > 1")
    blocks = F.ceil(F.greatest(F.col("n") / F.lit(float(BLOCK)), F.col("shingles") / F.lit(float(BLOCK_SHINGLES)))).cast("int").alias("blocks")
    first = written(buckets.groupBy("n", "s1", "s2", "low").agg(F.min(F.struct("band", "key", blocks)).alias("b")).select("n", "b.*"), "buckets")
    inside = spread_join(bands, first, ["band", "key"], "n", bands.count()).select("rep", "size", F.struct("band", "key", F.pmod(F.xxhash64("rep", F.lit(2)), "blocks").cast("int").alias("block"), "blocks").alias("b"))
    wanted = written(inside.groupBy("rep", "size").agg(F.collect_list("b").alias("todo")), "wanted")
    again = reps.join(small(wanted), "rep").select("rep", "text", "todo")
    if repeated:
        again = again.dropDuplicates(["rep"])
    size = F.col("size").cast("double") * 8 + VALUES * 4 + 64
    sent = wanted.agg(F.sum(size * F.aggregate("todo", F.lit(0).cast("long"), lambda n, b: n + b["blocks"]))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(sent / PARTITION_BYTES))
    members = again.mapInArrow(_members, MEMBER).repartition(parts, "band", "key", "left", "right").sortWithinPartitions("band", "key", "left", "right", "mine", "rep")
    links = written(members.mapInArrow(lambda b: _compare(b, threshold), LINK), "links")
    counts = links.groupBy("rep").agg(F.sum("links").alias("n_links"))
    labels = components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    linked = counts.join(labels, counts["rep"] == labels["id"], "left").select(F.col("rep").alias("digest"), "n_links", F.coalesce("root", "rep").alias("root"))
    linked = written(linked.join(copies.select("digest", "copy_id"), "digest"), "linked")
    order = F.struct(F.col("copy_id").isNull(), "copy_id", "digest")
    heads = linked.groupBy("root").agg(F.min("copy_id").alias("class_id"), F.min_by("digest", order).alias("class_digest"), F.count(F.lit(1)).alias("texts"))
    classes = written(spread_join(linked, written(heads, "heads"), ["root"], "texts", linked.count()).select("digest", "n_links", "class_id", "class_digest"), "classes")
    narrow = copies.join(small(classes), "digest", "left").select(
        "digest", "copy_id", F.when(F.col("class_digest").isNull(), F.col("copy_id")).otherwise(F.col("class_id")).alias("class_id"), "n_copies",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("class_digest", "digest").alias("class_digest"), "first_rows")
    return spread_join(hashed, narrow, ["digest"], "n_copies", total).select("doc_id", "copy_id", "class_id", "n_copies", "n_links", "digest", "class_digest", "first_rows")


def one_of_each(docs: DataFrame, joined: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class: of the text that names the class, the row with the smallest id (null ids last), any one of
    such rows if it is repeated. Rows are known by id and text, so ids need be neither set nor unique."""
    joined = written(joined, "joined")
    head = F.col("digest") == F.col("class_digest")
    own = F.col("doc_id").eqNullSafe(F.col("copy_id"))
    gone = written(joined.where(~(head & own)).select(F.col("doc_id").alias("_id"), F.col("digest").alias("_d")).distinct(), "gone")
    doubled = written(joined.where(head & own & (F.col("first_rows") > 1)).select("digest").distinct(), "doubled")
    rows = docs.withColumn("_digest", _digest(text_of(text_col)))
    gone = small(gone)
    kept = rows.join(gone, (F.col("_digest") == F.col("_d")) & F.col(id_col).eqNullSafe(F.col("_id")), "left_anti")
    if doubled.isEmpty():
        return kept.select(*docs.columns)
    doubled = small(doubled.withColumnRenamed("digest", "_d"))
    once = kept.join(doubled, F.col("_digest") == F.col("_d"), "left_semi").dropDuplicates(["_digest"])
    return kept.join(doubled, F.col("_digest") == F.col("_d"), "left_anti").unionByName(once).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "copy_id", "class_id", "n_copies", "n_links")

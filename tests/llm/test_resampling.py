"""Importance resampling against a plain version."""

import hashlib
import math
import re
import zlib

import numpy as np
from siftstream.llm import resampling as R

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def _lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def _features(t, buckets):
    w = WORDS.findall(_lower(t or ""))
    return len(w), [zlib.crc32(x.encode()) % buckets for x in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


def brute(docs, target, percent=25, least=20, seed=7, buckets=10_000):
    s, t = [0] * buckets, [0] * buckets
    known = [(k, *_features(x, buckets)) for k, x in docs]
    for _, _, f in known:
        for b in f:
            s[b] += 1
    for x in target:
        for b in _features(x, buckets)[1]:
            t[b] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    out = []
    for k, n, f in known:
        w = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        out.append([k, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def _rows(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in df.collect()), key=str)


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert _rows(R.query(spark, sf_dir)) == brute(docs, target)


def test_words():
    assert R.words_of("Äpfel, ÄB-x9_y\x7fz\x00Q @A[") == ["Äpfel".encode(), "Äb".encode(), b"x9", b"y", b"z", b"q", b"a"]


def test_block_is_the_sum_of_its_texts():
    texts = ["", "a", "a b a b", "  ", "b", "c a b", ""]
    sizes, found = R.block_buckets(texts, 97)
    for t, n, f in zip(texts, sizes, found):
        assert (n, sorted(f.tolist())) == (_features(t, 97)[0], sorted(_features(t, 97)[1]))


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    words = ["alpha", "beta", "Gamma", "délta", "9", "x"]
    docs = [(k, " ".join(rng.choice(words, rng.integers(0, 60)))) for k in range(120)] + [(None, "alpha " * 30), (7, "alpha beta " * 20), (7, "alpha beta " * 20), (500, None), (501, ""), (502, "x " * 300_000)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, rank int")
    target = spark.createDataFrame([("alpha beta " * 40,), (None,)], "text string")
    got, want = _rows(R.resample(df, target, buckets=64)), brute(docs, ["alpha beta " * 40, None], buckets=64)
    assert got == want
    assert _rows(R.resample(df, target.limit(0), buckets=70_000)) == brute(docs, [], buckets=70_000)
    assert R.resample(df.limit(0), target).count() == 0
    # rank in ranges of the order
    every = R.ranked(df.select("doc_id", R.F.monotonically_increasing_id().alias("m")), 5000, R.F.desc_nulls_last("doc_id"), R.F.asc("m")).collect()
    assert [r.doc_id for r in sorted(every, key=lambda r: r.rank)] == sorted((d[0] for d in docs if d[0] is not None), reverse=True) + [None]
    assert sorted(r.rank for r in every) == list(range(1, len(docs) + 1))

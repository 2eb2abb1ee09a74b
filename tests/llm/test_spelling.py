"""Spelling variants against all pairs of words."""

import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from siftstream.llm import spelling as S


def _near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(docs, least=7, times=2, every=31, ratio=10):
    count = Counter()
    for k, t in docs:
        for m in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m)
            h = zlib.crc32(f"{'' if k is None else k}:{w}".encode())
            if every and h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    n = {w: c for w, c in count.items() if len(w) >= least and c >= times}
    near = {w: [] for w in n}
    for a, b in itertools.combinations(n, 2):
        if abs(len(a) - len(b)) < 2 and _near(a, b):
            near[a].append(b)
            near[b].append(a)
    best = {w: min(near[w], key=lambda y: (-n[y], y), default=None) for w in n}
    form = {w: b if b and n[b] >= ratio * n[w] else None for w, b in best.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def _got(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_query_on_a_slice_of_words(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang <> 'en'").select("doc_id", "text")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], ratio=2)
    assert len(want) > 500 and _got(S.variants(docs, ratio=2)) == want


@pytest.mark.parametrize("alphabet", ["ab", "abà", "abcdefgh"])
def test_all_pairs(spark, alphabet):
    """Words of few letters repeat their bigrams, so order, places and ties all matter."""
    rng = random.Random(alphabet)
    words = {"".join(rng.choice(alphabet) for _ in range(rng.randint(4, 8))) for _ in range(400)}
    words |= {w[:i] + rng.choice(alphabet) + w[i + rng.randint(0, 1) :] for w in list(words) for i in (0, 2, len(w) - 1)}
    docs = [(k, " ".join([w] * rng.choice([2, 3, 3, 40, 40, 900]))) for k, w in enumerate(sorted(w for w in words if len(w) >= 4))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert _got(S.variants(df, least=4, every=5)) == brute(docs, least=4, every=5)


def test_chain_of_forms(spark):
    docs = [(1, " ".join(["spellin"] * 2 + ["spelling"] * 20 + ["spellings"] * 200 + ["spellingsx"] * 2000))]
    got = _got(S.variants(spark.createDataFrame(docs, "doc_id long, text string"), every=0))
    assert {w: v[:2] for w, v in got.items()} == {"spellin": ("spelling", "spellingsx"), "spelling": ("spellings", "spellingsx"), "spellings": ("spellingsx", "spellingsx"), "spellingsx": (None, "spellingsx")}


def test_odd_rows(spark):
    long = "ab" * 20_000
    docs = [(None, "Colour COLOURS colour"), (1, None), (2, ""), (3, "Übergröße übergröße ÜBERGRÖßE ÜBERGRÖßE x7colours7"), (3, "Übergröße"), (3, "Übergröße"), (4, f"{long} {long} {long}c {long}c"), (5, "short a b ××××××× ××××××× 1234567")]
    df = spark.createDataFrame([(*d, "w") for d in docs], "doc_id long, text string, word string")
    for every in (0, 31):
        assert _got(S.variants(df, every=every)) == brute(docs, every=every)
    assert S.variants(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        S.variants(df, least=3)


def test_nothing_of_the_vocabulary_is_broadcast(spark):
    docs = spark.createDataFrame([(1, "abcdefgh abcdefgh " * 20 + "abcdefgi abcdefgi")], "doc_id long, text string")
    found = S.variants(docs, every=0)
    assert [r.root for r in found.collect()] == ["abcdefgh"] * 2
    assert "Broadcast" not in found._jdf.queryExecution().toString()

"""Noisy-or toxicity: accuracy on documents kept from training, and odd rows."""

import math
import zlib

import numpy as np
import pytest
from siftstream.llm import toxicity as T

RUDE = ("zorgle", "blarf", "snivver")


@pytest.fixture(scope="module")
def corpus(spark):
    """Documents of invented words, a fifth with one rude sentence among clean ones."""
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(300)]
    docs, labels = [], []
    for k in range(600):
        lines = [" ".join(rng.choice(words, rng.integers(3, 12))) for _ in range(rng.integers(1, 25))]
        bad = k % 5 == 0
        if bad:
            lines.insert(int(rng.integers(0, len(lines) + 1)), f"you {RUDE[k % 3]} {words[k % 300]}")
        docs.append((k, ". ".join(lines)))
        labels.append((k, int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(docs), dict(labels)


def test_held_out_accuracy_and_sentences(corpus):
    docs, labels, texts, toxic = corpus
    rows = T.classify(docs, labels).collect()
    assert len(rows) == 600
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {k for k in toxic if zlib.crc32(str(k).encode()) % 5 == 0}
    assert sum(r.predicted == toxic[r.doc_id] for r in held) / len(held) > 0.97
    found = [texts[r.doc_id][x.start : x.start + x.length] for r in held if toxic[r.doc_id] for x in r.offending]
    assert found and all(any(w in s for w in RUDE) for s in found)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_labels_of_held_out_rows_are_not_read(corpus):
    docs, labels, _, _ = corpus
    turned = labels.withColumn("toxic", T.F.when(T.held_out("doc_id"), 1 - T.F.col("toxic")).otherwise(T.F.col("toxic")))
    a, b = T.fit(docs, labels), T.fit(docs, turned)
    assert a[0].keys() == b[0].keys() and abs(a[1] - b[1]) < 1e-9


def test_loss_and_gradient():
    """The gradient against differences, on bags with and without sentences."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    texts = ["a b. c", "a a c. b", "", "c. c. b a", "d"]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 0, 1, 0, 1], pa.int32()), pa.array([1.0, 0.5, 1.0, 2.0, 1.0]), pa.array(texts)], names=["toxic", "weight", "text"])
    bags = list(T._bags([batch], {"a": 0, "b": 1, "c": 2}))
    w = rng.normal(size=4)

    def f(w):
        out = next(T._loss(bags, w))
        return out.column(0)[0].as_py(), np.frombuffer(out.column(1)[0].as_py())

    value, grad = f(w)
    known = dict(zip("abc", w))
    want = 0.0
    for y, c, t in zip([1, 0, 1, 0, 1], [1.0, 0.5, 1.0, 2.0, 1.0], texts):
        p = T.score_text(t, known, w[-1])[0]
        want -= c * math.log(p if y else 1 - p)
    assert abs(value - want) < 1e-9
    for k in range(4):
        d = np.zeros(4)
        d[k] = 1e-6
        assert abs((f(w + d)[0] - f(w - d)[0]) / 2e-6 - grad[k]) < 1e-5


def test_sentences_keep_their_places():
    text = "Einen Moment!  Was?\nİstanbul is far. ... x"
    got = T.sentences(text)
    assert [text[a : a + n].strip() for a, n, _ in got] == ["Einen Moment", "Was", "İstanbul is far", "x"]
    assert got[0][2] == {"einen", "moment"}
    assert T.sentences(" .?! \n") == []
    assert len(T.sentences("word " * 200_000)) == 1


def test_odd_rows(spark, corpus):
    docs, labels, _, _ = corpus
    odd = spark.createDataFrame([(None, "you blarf", "x"), (9001, None, "x"), (9002, "", "x"), (9003, "you blarf", None), (9003, "you blarf", None)], "doc_id long, text string, score string")
    more = spark.createDataFrame([(None, 1), (3, None), (9003, 0), (9003, 1)], "doc_id long, toxic int")
    got = T.classify(docs.withColumn("score", T.F.lit("x")).unionByName(odd), labels.unionByName(more)).where("doc_id IS NULL OR doc_id > 9000").collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.score, r.predicted))
    assert len(by[9003]) == 2 and len(set(by[9003])) == 1 and by[None][0] == by[9003][0] and by[None][0][1] == 1
    assert by[9001] == by[9002] and by[9001][0][1] == 0
    none = T.classify(docs.limit(0), labels)
    assert none.count() == 0
    assert {r.predicted for r in T.classify(docs.limit(5), labels.where("toxic = 0")).collect()} == {0}
    assert T.classify(docs.limit(5), labels.limit(0)).count() == 5

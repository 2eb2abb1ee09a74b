"""Toxicity by multiple-instance learning: sentences are scored, documents are the noisy-or of their sentences.

A document is toxic if a sentence is. Only documents have labels, so the model of sentences (logistic, on the words that a
sentence holds) is trained through the noisy-or: 1 - prod(1 - p). Copies of a document would count its label many times; a
training document weighs the mean over its sentences of one by the number of training documents that have the sentence.
A word's weight is held to 0 the more, the less the documents that have it differ in label from the others.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import deque

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import session, small, text_of, written
from .files import release

#: Labelled documents that the model is fitted on at most, and the words that it knows: those whose training documents weigh
#: LEAST together, the most frequent ones first.
MOST_BAGS, MOST_WORDS, LEAST = 20_000, 65_536, 4.0
#: Weight of the squares of the words' weights, each by its log odds; log odds from which a word begins with them as its weight;
#: steps of the fit, and the share of the loss that ends it.
RIDGE, TELLING, STEPS, ENOUGH = 1.0, 3.0, 40, 1e-4
#: Documents of a task of the fit.
BAGS_PER_TASK = 2500

_SENTENCE, _WORD = re.compile(r"[^.!?\n]+"), re.compile(r"\w+")


def sentences(text: str) -> list[tuple[int, int, set[str]]]:
    """(start, length, words) of each piece between sentence ends that has words; places in code points of text."""
    out = []
    low = text.lower()
    # a few letters change their length in lower case; then sentences are lowered one by one
    same = len(low) == len(text)
    for m in _SENTENCE.finditer(low if same else text):
        words = set(_WORD.findall(m.group() if same else m.group().lower()))
        if words:
            out.append((m.start(), m.end() - m.start(), words))
    return out


def held_out(key: str | Column, folds: int = 5) -> Column:
    """Whether a document is kept from training: folds divides crc32 of its id as text. A null id is the empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds == 0


def _sentence_rows(batches):
    import pyarrow as pa

    release()
    for batch in batches:
        bag, key = [], []
        for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for _, _, words in sentences(text):
                bag.append(k)
                key.append(int.from_bytes(hashlib.blake2b(" ".join(sorted(words)).encode(), digest_size=8).digest(), "little", signed=True))
        yield pa.RecordBatch.from_arrays([pa.array(bag, pa.int64()), pa.array(key, pa.int64())], names=["bag", "key"])


def _word_weights(batches):
    """The different words of each document, with the document's label and weight."""
    import pyarrow as pa

    for batch in batches:
        for toxic, weight, text in zip(*[c.to_pylist() for c in batch.columns]):
            words = set().union(*[w for _, _, w in sentences(text)])
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([toxic] * len(words), pa.int32()), pa.array([weight] * len(words), pa.float64())], names=["w", "toxic", "weight"])


def _bags(batches, known: dict[str, int]):
    """Documents as numbers: the known words of all sentences, and how many each sentence has."""
    import pyarrow as pa

    for batch in batches:
        feats, sizes = [], []
        for text in batch.column(2).to_pylist():
            f, n = [], []
            for _, _, words in sentences(text):
                here = [k for k in map(known.get, words) if k is not None]
                f += sorted(here)
                n.append(len(here))
            feats.append(np.array(f, "<i4").tobytes())
            sizes.append(np.array(n or [0], "<i4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(feats, pa.binary()), pa.array(sizes, pa.binary())], names=["toxic", "weight", "feats", "sizes"])


def _loss(batches, w: np.ndarray):
    """The weighted loss of a task's bags and its gradient; the last weight is the bias."""
    import pyarrow as pa

    loss, grad = 0.0, np.zeros(len(w))
    for batch in batches:
        toxic, weight = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        feats = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<i4")
        raw = batch.column(3).to_pylist()
        sizes = np.frombuffer(b"".join(raw), "<i4")
        owner = np.repeat(np.arange(len(raw)), [len(x) // 4 for x in raw])
        inside = np.repeat(np.arange(len(sizes)), sizes)
        z = w[-1] + np.bincount(inside, weights=w[feats], minlength=len(sizes))
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        # log of the chance that no sentence offends
        none = -np.bincount(owner, weights=np.logaddexp(0, z), minlength=len(raw))
        some = -np.expm1(np.minimum(none, -1e-12))
        loss += float((weight * np.where(toxic == 1, -np.log(some), -none)).sum())
        pull = weight * np.where(toxic == 1, -np.exp(none) / some, 1.0)
        g = pull[owner] * p
        grad[:-1] += np.bincount(feats, weights=g[inside], minlength=len(w) - 1)
        grad[-1] += g.sum()
    yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([grad.tobytes()], pa.binary())], names=["loss", "grad"])


def minimised(f, w: np.ndarray, steps: int, enough: float = ENOUGH, memory: int = 10) -> np.ndarray:
    """Limited-memory BFGS with halved steps. f gives value and gradient; it is called about once a step."""
    value, grad = f(w)
    past: deque = deque(maxlen=memory)
    for _ in range(steps):
        d, alphas = -grad, []
        for s, y, rho in reversed(past):
            a = rho * (s @ d)
            alphas.append(a)
            d = d - a * y
        d = d * ((past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, float(np.abs(grad).sum())))
        for (s, y, rho), a in zip(past, reversed(alphas)):
            d = d + (a - rho * (y @ d)) * s
        slope, t = float(grad @ d), 1.0
        while True:
            new, new_grad = f(w + t * d)
            if new <= value + 1e-4 * t * slope or t < 1e-4:
                break
            t /= 2
        s, y = t * d, new_grad - grad
        if new > value or abs(value - new) <= enough * abs(value):
            return w if new > value else w + s
        if s @ y > 1e-12:
            past.append((s, y, 1 / (s @ y)))
        w, value, grad = w + s, new, new_grad
    return w


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_BAGS, most_words: int = MOST_WORDS, least: float = LEAST, ridge: float = RIDGE, folds: int = 5) -> tuple[dict[str, float], float]:
    """Weights of words and a bias, from the documents (doc_id, text) that labels (doc_id, toxic) call toxic or not and that
    are not held out. At most ``most`` labelled documents, those of the smallest hash of their id, are used; documents with
    labels that differ, null labels and null ids are not. Without both kinds of documents there are no weights.

    Each step of the fit is a job that sums the gradient over the training documents; the driver holds the weights, at most
    most_words of them.
    """
    known_labels = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_most")).where((F.col("toxic") == F.col("_most")) & ~held_out("doc_id", folds))
    sample = written(known_labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", F.col("toxic").cast("int").alias("toxic")), "labelled")
    kinds = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not kinds.get(0) or not kinds.get(1):
        return {}, -30.0 if not kinds.get(1) else 0.0
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text")).join(small(sample), "doc_id")
    texts = written(texts.withColumn("bag", F.monotonically_increasing_id()).select("bag", "text", "toxic"), "training")
    rows = written(texts.select("bag", "text").mapInArrow(_sentence_rows, "bag long, key long"), "sentences")
    # sentences of several documents, as a table, so that a very common one is joined in split partitions
    common = small(written(rows.distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "common"))
    weights = rows.join(common, "key", "left").groupBy("bag").agg(F.avg(1 / F.coalesce("n", F.lit(1))).alias("weight"))
    tasks = max(1, math.ceil(sum(kinds.values()) / BAGS_PER_TASK))
    weighed = written(texts.join(weights, "bag", "left").select("toxic", F.coalesce("weight", F.lit(1.0)).alias("weight"), "text").repartition(tasks), "weighed")
    of = {r.toxic: r.weight for r in weighed.groupBy("toxic").agg(F.sum("weight").alias("weight")).collect()}
    each = weighed.mapInArrow(_word_weights, "w string, toxic int, weight double").groupBy("w").agg(F.sum("weight").alias("all"), F.sum(F.col("weight") * F.col("toxic")).alias("bad")).where(F.col("all") >= least)
    # bounded by most_words
    vocabulary = each.orderBy(F.desc("all"), "w").limit(most_words).collect()
    known = {r.w: k for k, r in enumerate(vocabulary)}
    odds = np.array([math.log((r.bad + 1) / (of[1] + 2)) - math.log((r["all"] - r.bad + 1) / (of[0] + 2)) for r in vocabulary])
    scale = np.append(np.maximum(np.abs(odds), 0.1), 1.0)
    bags = written(weighed.mapInArrow(lambda b: _bags(b, known), "toxic int, weight double, feats binary, sizes binary"), "bags")

    def f(v: np.ndarray) -> tuple[float, np.ndarray]:
        w = v * scale
        # a row for each task of the fit, of which there are about most / BAGS_PER_TASK
        parts = bags.mapInArrow(lambda b: _loss(b, w), "loss double, grad binary").collect()
        grad = sum((np.frombuffer(r.grad) for r in parts), np.zeros(len(w))) * scale
        grad[:-1] += ridge * v[:-1]
        return sum(r.loss for r in parts) + 0.5 * ridge * float(v[:-1] @ v[:-1]), grad

    # the loss is not convex: telling words begin alike, so that none stays idle behind the others of its sentence
    start = np.append(np.where(odds > TELLING, 1.0, 0.0), -6.0)
    w = minimised(f, start, STEPS) * scale
    return {n: float(x) for n, x in zip(known, w) if x}, float(w[-1])


OFFENDING = "array<struct<start:long,length:long,score:double>>"
SCORED = f"doc_id long, score double, n_sentences long, offending {OFFENDING}"


def score_text(text: str, weights: dict[str, float], bias: float, least: float = 0.5) -> tuple[float, int, list[tuple[int, int, float]]]:
    """The score of a text, its number of sentences and those that offend: (start, length, score). A text without words is
    one sentence without words."""
    none, found, at_least, get = 0.0, [], math.log(least / (1 - least)), weights.get
    all_ = sentences(text)
    for start, length, words in all_:
        z = bias + math.fsum(sorted(v for v in map(get, words) if v is not None))
        none -= math.log1p(math.exp(z)) if z < 30 else z
        if z >= at_least:
            found.append((start, length, 1 / (1 + math.exp(-z))))
    if not all_:
        none = -math.log1p(math.exp(bias))
    return -math.expm1(none), len(all_), found


def _score(batches, weights: dict[str, float], bias: float, least: float):
    import pyarrow as pa

    release()
    for batch in batches:
        got = [score_text(t, weights, bias, least) for t in batch.column(1).to_pylist()]
        off = pa.array([[{"start": a, "length": b, "score": c} for a, b, c in x[2]] for x in got], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("score", pa.float64())])))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in got], pa.float64()), pa.array([x[1] for x in got], pa.int64()), off], names=["doc_id", "score", "n_sentences", "offending"])


def score(docs: DataFrame, weights: dict[str, float], bias: float, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, n_sentences and offending (start, length, score of the sentences of at least ``least``, places in code
    points) of every row of docs, by nothing but its text. Null texts are empty. Where they are read: no shuffle."""
    session(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(lambda b: _score(b, weights, bias, least), SCORED)


def classify(docs: DataFrame, labels: DataFrame, most: int = MOST_BAGS, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (score of 0.5 or more), n_sentences and offending for every row of docs
    (doc_id, text); labels (doc_id, toxic) teach.

    Equal texts have equal scores. Null and empty texts have the score of a sentence without words. Null ids are kept and
    never teach. Repeated rows are scored each; in training they share one weight, as copies do. Other columns are ignored.
    Without labels of both kinds all scores are alike. An empty table gives none. Sentences of any length are taken whole.
    """
    session(docs.sparkSession)
    weights, bias = fit(docs, labels, most, folds=folds)
    out = score(docs, weights, bias)
    return out.select("doc_id", held_out("doc_id", folds).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_sentences", "offending")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    first = F.try_element_at("offending", F.lit(1))
    return got.select("doc_id", "held_out", "score", "predicted", "n_sentences", F.size("offending").cast("long").alias("n_offending"), first["start"].alias("first_start"), first["length"].alias("first_length"))

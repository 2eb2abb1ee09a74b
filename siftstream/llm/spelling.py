"""Spelling variants of words: a join on each word's three rarest bigrams, then verification.

One edit spoils at most two of a word's bigrams, and those stand side by side. So if bigrams are taken in one global order,
rarest first, two words that differ by one edit share one of their three first, at places that differ by one at most, and
that bigram lies wholly before or wholly behind the edit. A word is therefore joined under each of its three rarest bigrams,
with the bigram's place and what the word is without one code point elsewhere: words that meet are neighbours but for
collisions of hashes, which the verification finds. Buckets hold at most as many words as the alphabet allows, however
many words there are, so pairs grow with the words and not with their square.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import session, text_of, written
from .files import release

#: Word characters after A-Z are lower case: 90 code points, so there are at most 8100 bigrams.
LETTERS = "a-zÀ-ÿ"
#: Bigrams of a word that are joined: two that one edit may spoil, and one more.
RAREST = 3
#: Words and code points that a task counts before it hands the counts on; entries of a batch.
MOST_WORDS, MOST_POINTS, ROWS = 200_000, 8_000_000, 100_000

_MOD, _BASE, _PLACE = (1 << 61) - 1, 1_000_003_739, 0x1F3D5B79A2C4E685 % ((1 << 61) - 1)


def lowered(text: str) -> str:
    """A text with A-Z, and nothing else, in lower case."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def _word_batch(total: dict):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(total, pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])


def _count(batches, least: int, every: int):
    """Words of texts and how often a task met them."""
    release()
    runs = re.compile(f"[{LETTERS}]{{{least},}}")
    total, points = {}, 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            seed = zlib.crc32(("" if key is None else f"{key}").encode() + b":")
            for word, n in Counter(runs.findall(lowered(text))).items():
                h = zlib.crc32(word.encode(), seed) if every else 1
                if every and h % every == 0:
                    at = h % len(word)
                    word = word[:at] + word[at + 1 :]
                    if len(word) < least:
                        continue
                had = total.get(word)
                if had is None:
                    had, points = 0, points + len(word)
                total[word] = had + n
            if len(total) > MOST_WORDS or points > MOST_POINTS:
                yield _word_batch(total)
                total, points = {}, 0
    if total:
        yield _word_batch(total)


def _grams(batches):
    import pyarrow as pa

    total: Counter = Counter()
    for batch in batches:
        for w in batch.column(0).to_pylist():
            total.update(map(str.__add__, w, w[1:]))
    yield pa.RecordBatch.from_arrays([pa.array(total, pa.string()), pa.array(total.values(), pa.int64())], names=["gram", "n"])


def rarest(word: str, rank: dict[str, int], n: int = RAREST) -> list[int]:
    """Places of a word's n first bigrams in the global order; equal ones by place."""
    return [i for _, i in heapq.nsmallest(n, ((rank[word[i : i + 2]], i) for i in range(len(word) - 1)))]


def entries(word: str, rank: dict[str, int]):
    """(key, left out) of a word: for each of its rarest bigrams, the word itself (-1) and the word without each code point
    that is not the bigram's, under a hash of what remains and of the bigram's place there. The hashes of all that remains
    come from one polynomial of the word, so a long word costs its length."""
    size, head, heads = len(word), 0, [0]
    for c in map(ord, word):
        head = (head * _BASE + c) % _MOD
        heads.append(head)
    without, power = [0] * size, 1
    for i in range(size - 1, -1, -1):
        without[i] = ((heads[i] - heads[i + 1]) * power + head) % _MOD
        power = power * _BASE % _MOD
    for at in rarest(word, rank):
        yield (head + at * _PLACE) % _MOD, -1
        before, here = (at - 1) * _PLACE, at * _PLACE
        for i in range(at):
            yield (without[i] + before) % _MOD, i
        for i in range(at + 2, size):
            yield (without[i] + here) % _MOD, i


ENTRY = "key long, id long, out int, size int"


def _entries(batches, rank: dict[str, int]):
    import pyarrow as pa

    def rows():
        a, b, c, d = zip(*held)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int32()), pa.array(d, pa.int32())], names=["key", "id", "out", "size"])

    held = []
    for batch in batches:
        for k, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            size = len(word)
            for key, out in entries(word, rank):
                held.append((key, k, out, size))
                if len(held) >= ROWS:
                    yield rows()
                    held = []
    if held:
        yield rows()


def word_counts(docs: DataFrame, least: int = 7, times: int = 2, every: int = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): maximal runs of letters of at least ``least`` code points that texts hold ``times`` times or more.

    Only A-Z is lower-cased. Where ``every`` divides crc32 of ``<id>:<run>``, one code point of the run is left out (the
    hash modulo its length), which plants misspellings; 0 leaves all runs as they are. Null ids are empty in that hash, null
    texts have no words.
    """
    session(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return docs.mapInArrow(lambda b: _count(b, least, every), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b, word_a, n_a, word_b, n_b): every pair of words that differ by one inserted, deleted or replaced code point.

    words: a written table of id, word (distinct, of LETTERS, three code points or more), n.
    """
    # at most 8100 rows by the size of the alphabet
    found = words.select("word").mapInArrow(_grams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    rank = {r.gram: k for k, r in enumerate(sorted(found, key=lambda r: (r.n, r.gram)))}
    e = words.select("id", "word").mapInArrow(lambda b: _entries(b, rank), ENTRY).hint("merge")
    x, y = e.alias("x"), e.alias("y")
    replaced = (F.col("x.size") == F.col("y.size")) & (F.col("x.out") == F.col("y.out"))
    longer = lambda l, s: (F.col(f"{l}.size") == F.col(f"{s}.size") + 1) & (F.col(f"{s}.out") == -1)
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")) & (replaced | longer("x", "y") | longer("y", "x"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    side = lambda c: words.select(F.col("id").alias(c), F.col("word").alias(f"word_{c}"), F.col("n").alias(f"n_{c}")).hint("merge")
    return pairs.join(side("a"), "a").join(side("b"), "b").where(F.levenshtein("word_a", "word_b", 1) == 1)


def followed(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): the last that forms lead to. Each round doubles the reach; forms lead to ever more
    frequent words, tenfold at least, so five rounds reach the end of any chain of 64-bit counts."""
    roots = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(roots.join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        roots = step.select("word", "root")
        if step.where("moved").isEmpty():
            return roots


def variants(docs: DataFrame, least: int = 7, times: int = 2, every: int = 31, ratio: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of ``word_counts``.

    n_near: how many words differ from it by exactly one inserted, deleted or replaced code point. form: the most frequent of
    these (ties: the smallest in code-point order) if it occurs ratio times as often or more, else null. root: where forms
    lead from word; the word itself without one. Null, empty and repeated rows count as word_counts says; other columns are
    ignored; an empty table gives no word. least is at least 4, as a word needs three bigrams.

    Plan: words are counted in each task before the one shuffle by word. From there on tables grow with the vocabulary: about
    three rows for each code point of a word are joined by a 64-bit key, and what meets is verified on the words. All of
    these are joined by sorting: none is broadcast, so the driver holds the bigrams and nothing that grows.
    """
    if least < 4:
        raise ValueError("words of fewer than four code points have no three bigrams")
    counted = word_counts(docs, least, times, every, id_col, text_col)
    words = written(counted.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")
    near = near_pairs(words)
    ways = F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("word_b").alias("w"), F.col("n_b").alias("m")), F.struct(F.col("b").alias("id"), F.col("word_a").alias("w"), F.col("n_a").alias("m"))))
    best = near.select(ways.alias("x")).select("x.*").groupBy("id").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "w")).alias("best"))
    named = words.join(best.hint("merge"), "id", "left").withColumn("_n", -F.col("best.m"))
    has = F.col("_n") >= F.col("n") * ratio
    named = written(named.select("word", F.when(has, F.col("best.w")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("_n")).alias("form_n")), "named")
    roots = followed(named.where("form IS NOT NULL").select("word", "form"))
    return named.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))

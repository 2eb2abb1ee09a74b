"""Quality by perplexity under an interpolated modified Kneser-Ney model of characters.

The model is trained on every trusted text. Its n-grams have up to five characters (code points, exactly) of one language; a
word that repeats the word before it is one sign, by how often it has, so that repetition is an n-gram too. Counts,
continuation counts, discounts, context totals and interpolation are aggregates and joins in Spark, spread by the n-gram. The
finished model is written as shards of bounded size, by language and hash; a scoring task looks the distinct n-grams of a
large piece of its texts up in one shard of their languages after another, so its memory does not grow with the model.
Documents whose perplexity passes their language's threshold, a quantile of trusted texts times a slack, are rejected. For
the threshold each trusted text is scored by a model of the half of the trusted texts that it is not in.
"""

from __future__ import annotations

import math
import operator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import session, small, text_of, work_path, written
from .files import held as kept_between_tasks, new_name, opened, release
from .hashes import BASE, mixed

ORDER = 5
#: An n-gram is two longs of signs of 21 bits: three in lo, and in hi two below the model's number (language and half).
SIGN = 21
MODEL_AT, TAG_AT = 2 * SIGN, 59
MOST_LANGUAGES = (1 << (TAG_AT - MODEL_AT - 2)) - 2
#: Rows of a shard of the model (20 bytes each).
SHARD_ROWS = 2_000_000
#: Rows of the shards that a worker holds at once.
HELD_ROWS = 4 * SHARD_ROWS
#: Characters whose distinct n-grams are looked up at once.
CHARS = 1_000_000
#: The threshold: this quantile of the trusted texts' scores, times SLACK (as a share of nats a character).
QUANTILE, SLACK = 0.98, 1.25
#: Characters of average trusted text that a score is smoothed with, so that few characters decide little.
PRIOR = 30
#: Signs that no text can hold, as they are halves of code points: before a text, after it, and words that equal the word
#: before them, by their place in the run: second, third, up to fifth, later. A sign's number is one more, as 0 is none.
BEGIN, END, AGAIN = "\ud800", "\ud801", "\ud802\ud803\ud804\ud805\ud805\ud806"
#: Signs that a model without any text thinks equally likely.
SIGNS = 0x110000
SCORES = "doc_id long, digest binary, lang string, n_chars long, n_signs long, nats double, half int"


def signs(text: str) -> str:
    """The signs that are modelled: words with one space between, repeated words as AGAIN has it."""
    words = text.split()
    if any(map(operator.eq, words, words[1:])):
        out, run, before = [], 0, None
        for w in words:
            run = run + 1 if w == before else 0
            before = w
            out.append(AGAIN[min(run - 1, len(AGAIN) - 1)] if run else w)
        words = out
    return " ".join(words)


def grams(texts: list[str], models: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """hi and lo of the n-grams of the highest order that end at each sign and END of each text, their number for each text,
    and the numbers' offsets. models: the number of each text's model."""
    rows = [signs(t) for t in texts]
    pad = BEGIN * (ORDER - 1)
    code = np.frombuffer("".join([f"{pad}{r}{END}" for r in rows]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64) + 1
    size = np.fromiter(map(len, rows), np.int64, len(rows)) + 1
    offset = np.cumsum(size) - size
    # windows that end in a text's padding belong to no text
    inside = np.ones(len(code) - ORDER + 1, bool)
    ends = np.cumsum(size + ORDER - 1)[:-1]
    for k in range(1, ORDER):
        inside[ends - k] = False
    hi, lo = (code[: len(inside)] << SIGN) | code[1 : len(inside) + 1], (code[2 : len(inside) + 2] << 2 * SIGN) | (code[3 : len(inside) + 3] << SIGN) | code[4:]
    return hi[inside] | np.repeat(np.asarray(models, np.int64) << MODEL_AT, size), lo[inside], size, offset


def suffix(hi, lo, k: int):
    """The last k signs of n-grams, for numpy and columns alike by &."""
    mask_hi = ~((1 << MODEL_AT) - 1) | ((1 << (SIGN * max(k - 3, 0))) - 1)
    return hi & mask_hi, lo & ((1 << (SIGN * min(k, 3))) - 1)


def without_last(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n-grams without their last sign."""
    signs_hi = hi & np.int64((1 << MODEL_AT) - 1)
    return (hi - signs_hi) | (signs_hi >> SIGN), (lo >> SIGN) | ((hi & np.int64((1 << SIGN) - 1)) << 2 * SIGN)


def distinct(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams, and which of them each is."""
    hashed = _mixed(hi, lo)
    for order in (np.argsort(hashed), None):
        if order is None:
            order = np.lexsort((lo, hi))
        a, b, h = hi[order], lo[order], hashed[order]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        if not (new[1:] & (h[1:] == h[:-1])).any():
            break  # no two n-grams share a hash, so equal ones stand together
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return a[new], b[new], which


def _pieces(n_chars: list[int], most: int):
    at = total = 0
    for n, size in enumerate(n_chars):
        total += size
        if total >= most:
            yield at, n + 1
            at, total = n + 1, 0
    if at < len(n_chars):
        yield at, len(n_chars)


def _count(batches):
    """Counts of n-grams, combined within the task as far as memory allows."""
    import pyarrow as pa

    release()
    held: list = []

    def merged():
        hi, lo, times = (np.concatenate(x) for x in zip(*held))
        a, b, which = distinct(hi, lo)
        return a, b, np.bincount(which, times).astype(np.int64)

    for batch in batches:
        texts, models = batch.column(0).to_pylist(), batch.column(1).to_numpy()
        for lo, hi in _pieces([len(t) for t in texts], 200_000):
            a, b, which = distinct(*grams(texts[lo:hi], models[lo:hi])[:2])
            held.append((a, b, np.bincount(which)))
            if sum(len(h[0]) for h in held) > 1_500_000:
                held = [merged()]
                if len(held[0][0]) > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["hi", "lo", "c"])
                    held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], names=["hi", "lo", "c"])


def _suffix(k: int) -> list[Column]:
    mask_hi, mask_lo = (~((1 << MODEL_AT) - 1) | ((1 << (SIGN * max(k - 3, 0))) - 1)), (1 << (SIGN * min(k, 3))) - 1
    return [F.col("hi").bitwiseAND(F.lit(mask_hi)).alias("hi"), F.col("lo").bitwiseAND(F.lit(mask_lo)).alias("lo")]


def _context() -> list[Column]:
    signs_hi = F.col("hi").bitwiseAND(F.lit((1 << MODEL_AT) - 1))
    hi = (F.col("hi") - signs_hi).bitwiseOR(F.shiftright(signs_hi, SIGN))
    lo = F.shiftright("lo", SIGN).bitwiseOR(F.shiftleft(F.col("hi").bitwiseAND(F.lit((1 << SIGN) - 1)), 2 * SIGN))
    return [hi.alias("hhi"), lo.alias("hlo")]


def train(trusted: DataFrame, halves: bool = False) -> DataFrame:
    """The model of (text, model) as rows (tag, hi, lo, value): for tag 1 to ORDER the log probability of n-grams of that
    order; for tag 8 + k the log weight that contexts of order k give to the order below. All rows of trusted count; model
    is the number of the model (a language, or a half of its texts) that a text belongs to. halves: there is also the model
    of each four numbers' texts together, which is the first of these numbers."""
    counts = written(trusted.select(text_of("text").alias("text"), F.col("model").cast("long").alias("model")).mapInArrow(_count, "hi long, lo long, c long").groupBy("hi", "lo").agg(F.sum("c").alias("c")), "ngrams")
    if halves:
        whole = counts.select(F.col("hi").bitwiseAND(F.lit(~(3 << MODEL_AT))).alias("hi"), "lo", "c").groupBy("hi", "lo").agg(F.sum("c").alias("c"))
        counts = written(counts.unionByName(whole), "ngrams")
    orders = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        # how many different signs precede the n-gram
        orders[k] = written(orders[k + 1].select(*_suffix(k)).groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("c")), f"continuations-{k}")
    below, parts = None, []
    for k in range(1, ORDER + 1):
        grams_k = orders[k].withColumn("model", F.shiftright("hi", MODEL_AT)).select("*", *_context())
        n = [F.sum((F.col("c") == i).cast("long")).alias(f"n{i}") for i in (1, 2, 3, 4)]
        # a row per model
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        d = [F.coalesce(F.when((F.col("n1") > 0) & (F.col(f"n{i}") > 0), F.lit(float(i)) - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")), F.lit(0.7)) for i in (1, 2, 3)]
        rates = grams_k.groupBy("model").agg(*n).select("model", *[F.least(F.greatest(x, F.lit(0.05)), F.lit(i - 0.05)).alias(f"d{i}") for i, x in enumerate(d, 1)])
        cut = grams_k.join(rates, "model").withColumn("d", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")))
        contexts = cut.groupBy("hhi", "hlo").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("weight"))
        own = cut.join(contexts, ["hhi", "hlo"]).select("hi", "lo", ((F.col("c") - F.col("d")) / F.col("total")).alias("own"), "weight")
        if below is None:
            p = own.select("hi", "lo", (F.col("own") + F.col("weight") / F.lit(float(SIGNS))).alias("p"))
        else:
            shi, slo = _suffix(k - 1)
            p = own.withColumn("shi", shi).withColumn("slo", slo).join(below.select(F.col("hi").alias("shi"), F.col("lo").alias("slo"), F.col("p").alias("q")), ["shi", "slo"])
            p = p.select("hi", "lo", (F.col("own") + F.col("weight") * F.col("q")).alias("p"))
        below = written(p, f"order-{k}")
        parts.append(below.select(F.lit(k).alias("tag"), "hi", "lo", F.log("p").alias("value")))
        parts.append(contexts.select(F.lit(8 + k).alias("tag"), F.col("hhi").alias("hi"), F.col("hlo").alias("lo"), F.log("weight").alias("value")))
    model = parts[0]
    for part in parts[1:]:
        model = model.unionByName(part)
    return written(model, "model")


def _mixed(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """A hash of model keys."""
    return mixed(hi.astype(np.uint64) * np.uint64(BASE) ^ lo.astype(np.uint64))


def _keyed(tag: int, hi: np.ndarray) -> np.ndarray:
    """One key for all orders; never negative, as a tag takes the four bits below the sign."""
    return hi | np.int64(tag << TAG_AT)


class Shard:
    """An open-addressing table of part of the model."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray, values: np.ndarray):
        size = 1 << max(4, math.ceil(math.log2(max(1, len(hi)) * 1.5)))
        self.mask, self.slot, self.hi, self.lo, self.values = np.uint64(size - 1), np.full(size, -1, np.int32), hi, lo, values
        todo, slot = np.arange(len(hi), dtype=np.int32), _mixed(hi, lo) & self.mask
        while len(todo):
            free = self.slot[slot] == -1
            # of keys that want one slot, whichever is written last has it
            self.slot[slot[free]] = todo[free]
            lost = self.slot[slot] != todo
            todo, slot = todo[lost], (slot[lost] + np.uint64(1)) & self.mask

    def find(self, hi: np.ndarray, lo: np.ndarray, hashed: np.ndarray, out: np.ndarray, at: np.ndarray) -> None:
        """Writes the values of keys to out[at]; keys that are absent leave it as it is."""
        slot = hashed & self.mask
        while len(hi):
            there = self.slot[slot]
            hit = (there >= 0) & (self.hi[there] == hi) & (self.lo[there] == lo)
            out[at[hit]] = self.values[there[hit]]
            on = ~hit & (there != -1)
            hi, lo, at, slot = hi[on], lo[on], at[on], (slot[on] + np.uint64(1)) & self.mask


class Model:
    """The shards of a written model, {model: paths}; those used last stay in memory, up to ``most`` rows together."""

    def __init__(self, paths: dict[int, list[str]], most: int = HELD_ROWS):
        self.paths, self.most, self.shards = paths, most, {}

    def shard(self, path: str) -> Shard:
        shard = self.shards.pop(path, None)
        if shard is None:
            with opened(path) as f:
                raw = f.read()
            n = len(raw) // 20
            while self.shards and sum(len(x.hi) for x in self.shards.values()) + n > self.most:
                self.shards.pop(next(iter(self.shards)))
            shard = Shard(np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "<i8", n, 8 * n), np.frombuffer(raw, "<f4", n, 16 * n))
        self.shards[path] = shard
        return shard

    def log_probabilities(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Natural logarithms for n-grams of the highest order: the order that is known, times weights of those above. Models
        come one after another, and each of their shards is read at most once."""
        out, model = np.empty(len(hi), np.float32), hi >> MODEL_AT
        for m in np.unique(model).tolist():
            at = np.flatnonzero(model == m)
            paths = self.paths.get(m, [])
            out[at] = self._of_one(paths[0], hi[at], lo[at]) if len(paths) == 1 and paths[0] else self._of_many(paths, hi[at], lo[at])
        return out

    def _of_one(self, path: str, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """A model of one shard: only n-grams that an order does not know are looked up in the next."""
        out, todo, shard = np.zeros(len(hi), np.float32), np.arange(len(hi)), self.shard(path)

        def found(tag, a, b, default):
            values, a = np.full(len(a), default, np.float32), _keyed(tag, a)
            shard.find(a, b, _mixed(a, b), values, np.arange(len(a)))
            return values

        for k in range(ORDER, 0, -1):
            a, b = suffix(hi[todo], lo[todo], k)
            p = found(k, a, b, np.nan)
            known = ~np.isnan(p)
            out[todo[known]] += p[known]
            todo = todo[~known]
            if not len(todo):
                return out
            out[todo] += found(8 + k, *without_last(a[~known], b[~known]), 0.0)
        out[todo] += np.float32(-math.log(SIGNS))
        return out

    def _of_many(self, paths: list[str], hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """A model of several shards: the distinct keys of all orders are looked up shard by shard, then put together."""
        asked = []
        for k in range(ORDER, 0, -1):
            a, b = suffix(hi, lo, k)
            for tag, x, y, default in ((k, a, b, np.nan), (8 + k, *without_last(a, b), 0.0)):
                x, y, which = distinct(x, y)
                x = _keyed(tag, x)
                hashed = _mixed(x, y)
                asked.append((x, y, hashed, (hashed >> np.uint64(40)) % np.uint64(max(1, len(paths))), which, np.full(len(x), default, np.float32)))
        for s, path in enumerate(paths):
            for x, y, hashed, shard, _, values in asked:
                at = np.flatnonzero(shard == s)
                if len(at) and path:
                    self.shard(path).find(x[at], y[at], hashed[at], values, at)
        out, unknown = np.zeros(len(hi), np.float32), np.ones(len(hi), bool)
        for own, weight in zip(asked[::2], asked[1::2]):
            p = own[5][own[4]]
            known = unknown & ~np.isnan(p)
            out[known] += p[known]
            unknown &= ~known
            out[unknown] += weight[5][weight[4]][unknown]
        out[unknown] += np.float32(-math.log(SIGNS))
        return out


def _sharded(batches, shards: dict[int, int]):
    import pyarrow as pa

    of = np.zeros(max(shards, default=0) + 1, np.int64)
    of[list(shards)] = list(shards.values())
    for batch in batches:
        tag, hi, lo, value = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        model = hi >> MODEL_AT
        full = hi | (tag.astype(np.int64) << TAG_AT)
        where = ((_mixed(full, lo) >> np.uint64(40)) % of[model].astype(np.uint64)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array((model << 24) | where), pa.array(full), pa.array(lo), pa.array(value)], names=["shard", "hi", "lo", "value"])


def _write_shards(batches, folder: str):
    """A file for each shard of the task, whose rows come one after another."""
    import pyarrow as pa

    key, parts = None, []

    def finish():
        name = new_name(folder, f"shard-{key}", ".bin")
        hi, lo, values = (np.concatenate(x) for x in zip(*parts))
        with opened(name, "wb") as f:
            f.write(hi.astype("<i8").tobytes() + lo.astype("<i8").tobytes() + values.astype("<f4").tobytes())
        return pa.RecordBatch.from_pydict({"shard": pa.array([key], pa.int64()), "path": [name]})

    for batch in batches:
        shard, hi, lo, value = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
        for a, b in zip(cuts, cuts[1:]):
            if parts and shard[a] != key:
                yield finish()
                parts = []
            if b > a:
                key = int(shard[a])
                parts.append((hi[a:b], lo[a:b], value[a:b]))
    if parts:
        yield finish()


def write_model(model: DataFrame) -> dict[int, list[str]]:
    """Writes a model's shards; their paths by model, in order ("" for an empty one). A model has rows / SHARD_ROWS shards."""
    folder = work_path(model.sparkSession, "shards")
    # a row per model, of which there are two or three a language
    sizes = {r.model: r["count"] for r in model.groupBy(F.shiftright("hi", MODEL_AT).alias("model")).count().collect()}
    shards = {m: math.ceil(n / SHARD_ROWS) for m, n in sizes.items()}
    spread = model.select("tag", "hi", "lo", "value").mapInArrow(lambda b: _sharded(b, shards), "shard long, hi long, lo long, value double")
    paths = written(spread.repartition(max(1, sum(shards.values())), "shard").sortWithinPartitions("shard").mapInArrow(lambda b: _write_shards(b, folder), "shard long, path string"), "shard-paths")
    found = {r.shard: r.path for r in paths.collect()}
    return {m: [found.get((m << 24) | s, "") for s in range(n)] for m, n in shards.items()}


def _score(batches, paths: dict[int, list[str]]):
    import pyarrow as pa

    model = kept_between_tasks(("model", min((p for ps in paths.values() for p in ps), default="")), lambda: Model(paths))
    for batch in batches:
        texts, models = batch.column(2).to_pylist(), batch.column(5).to_numpy()
        for lo, hi in _pieces([len(t) for t in texts], CHARS):
            a, b, size, offset = grams(texts[lo:hi], models[lo:hi])
            a, b, which = distinct(a, b)
            nats = -np.add.reduceat(model.log_probabilities(a, b).astype(np.float64)[which], offset)
            n, part = [len(t) for t in texts[lo:hi]], batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), pa.array(n, pa.int64()), pa.array(size), pa.array(nats), part.column(4)], names=["doc_id", "digest", "lang", "n_chars", "n_signs", "nats", "half"])


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of documents with labels, all of which say good quality and not toxic."""
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    return labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.coalesce(good, F.lit(False)).cast("int")).alias("good")).where("good = 1").select("doc_id")


def _model(numbers: DataFrame, rows: DataFrame) -> DataFrame:
    """Adds the number of each row's model: that of its language, and its half. Rows of other languages have none."""
    return rows.join(F.broadcast(numbers), rows["lang"].eqNullSafe(numbers["_lang"]), "left").withColumn("model", F.col("_number") * 4 + F.col("half")).drop("_lang", "_number")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, slack: float = SLACK, prior: float = PRIOR) -> DataFrame:
    """doc_id, lang, n_chars, perplexity, threshold, keep and digest (of the text) for every row of docs (doc_id, text, lang).

    perplexity is that of a sign (see ``signs``) and END, in nats smoothed by ``prior`` signs of the language's mean trusted
    text, so that very short texts stay near it. threshold: the language's quantile of trusted texts, in nats times slack,
    where a trusted text is scored by the half of the language's trusted texts that it (by its content) is not in, or by all
    if only one half has text. keep is perplexity <= threshold; a language without trusted text has no perplexity or
    threshold and is kept, as models of other languages tell nothing of it. n_chars is the text's number of code points.
    Null texts are empty and kept, null languages are a language of their own, null ids are not trusted. Rows of equal text
    and language have equal verdicts, so repeated rows do. Other columns are ignored; an empty table gives none. There may
    be up to MOST_LANGUAGES languages with trusted text.

    Plan: two scans of the texts and two of the trusted ones, no shuffle of them unless there are too many labels to broadcast
    (checked); n-gram counts are combined in each task before their shuffle.
    """
    spark = session(docs.sparkSession)
    text = text_of("text")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("digest"), text.alias("text"), F.col("lang").cast("string").alias("lang"), F.lit(0).alias("half"))
    trusted = small(written(trusted_ids(labels), "trusted"))
    known = docs.join(trusted, "doc_id", "left_semi").select(*docs.columns)
    # a row per language with trusted text
    langs = sorted((r.lang for r in known.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect()), key=lambda x: (x is not None, x))
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    numbers = spark.createDataFrame([(x, n) for n, x in enumerate(langs)], "_lang string, _number long")
    halves = known.withColumn("half", (F.pmod(F.xxhash64("text"), F.lit(2)) + 1).cast("int"))
    other = halves.withColumn("half", F.lit(3) - F.col("half"))

    # one training for the languages and their halves, and one scoring
    paths = write_model(train(_model(numbers, halves), halves=True))
    rows = _model(numbers, docs.unionByName(other)).where("model IS NOT NULL").select("doc_id", "digest", "text", "lang", "half", "model")
    lang = F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("_l")
    found = written(rows.mapInArrow(lambda b: _score(b, paths), SCORES), "scores").select("*", lang)
    scores, held_out = found.where("half = 0"), found.where("half > 0")
    # tables of a row per language
    both = small(written(held_out.groupBy("_l").agg(F.count_distinct("half").alias("n")).where("n = 2").select("_l"), "halved"))
    tested = held_out.join(both, "_l", "left_semi").unionByName(scores.join(trusted, "doc_id", "left_semi").join(both, "_l", "left_anti").select(*held_out.columns))
    means = small(written(tested.groupBy("_l").agg((F.sum("nats") / F.sum("n_signs")).alias("mean")), "means"))
    smoothed = lambda rows: rows.join(means, "_l", "left").withColumn("score", (F.col("nats") + F.lit(prior) * F.coalesce("mean", F.lit(0.0))) / (F.col("n_signs") + F.lit(prior)))
    at = F.percentile_approx("score", F.lit(quantile), F.lit(10_000))
    limits = written(smoothed(tested).groupBy("_l").agg(at.alias("limit")), "limits")
    out = smoothed(scores).join(small(limits), "_l", "left")
    limit = F.col("limit") * F.lit(slack)
    keep = F.coalesce(F.col("score") <= limit, F.lit(True)) | (F.col("n_signs") <= 1)
    out = out.select("doc_id", "lang", "n_chars", F.exp("score").alias("perplexity"), F.exp(limit).alias("threshold"), keep.alias("keep"), "digest")
    rest = _model(numbers, docs).where("model IS NULL").select("doc_id", "lang", F.length("text").cast("long").alias("n_chars"), F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("threshold"), F.lit(True).alias("keep"), "digest")
    return out.unionByName(rest)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that ``classify`` keeps, with all columns. Verdicts hold for a text and its language, so ids need be
    neither set nor unique."""
    bad = small(written(classify(docs, labels).where("NOT keep").select(F.col("digest").alias("_d"), F.col("lang").alias("_l")).distinct(), "rejected"))
    rows = docs.withColumn("_digest", F.unhex(F.substring(F.sha2(text_of("text"), 256), 1, 32)))
    return rows.join(bad, (F.col("_digest") == F.col("_d")) & F.col("lang").cast("string").eqNullSafe(F.col("_l")), "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("digest")

import hashlib
import math
import random
import string
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from siftstream.llm import common, linededup, neardup, quality, winnowing

SCHEMA = "doc_id long, text string, lang string, source string, h string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", "clash") for i, t in rows], SCHEMA)


# winnowing


def plain_fingerprint(text, k=winnowing.K, w=winnowing.W, hash_of=None):
    """Positions chosen by the definition, given each run's hash."""
    n = len(hash_of)
    out = []
    for a in range(max(1, n - w + 1)):
        window = hash_of[a : a + w]
        p = max(i for i, h in enumerate(window) if h == min(window)) + a
        if p not in out:
            out.append(p)
    return sorted(out)


def test_winnowing_by_definition(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choices(["a", "b", "c", "dd"], k=n)) for n in (0, 1, 4, 5, 6, 11, 12, 13, 40, 300)] + ["z " * 50, " x\n y  z\t"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: r.fp for r in winnowing.fingerprints(df, "text", "fp").collect()}
    every = {r.id: r.fp for r in winnowing.fingerprints(df, "text", "fp", w=1).collect()}
    for i, text in enumerate(texts):
        runs = sorted(((1 << 32) - 1 - (v & 0xFFFFFFFF), v >> 32) for v in every[i])
        words = text.split()
        assert [p for p, _ in runs] == list(range(max(1, len(words) - winnowing.K + 1)))
        for a in range(len(runs)):
            for b in range(a):
                assert (runs[a][1] == runs[b][1]) == (words[a : a + 5] == words[b : b + 5])
        want = plain_fingerprint(text, hash_of=[h for _, h in runs])
        assert sorted((1 << 32) - 1 - (v & 0xFFFFFFFF) for v in got[i]) == want, text


def test_winnowing_guarantee(spark):
    rng = random.Random(2)
    shared = " ".join(f"s{rng.random()}" for _ in range(winnowing.K + winnowing.W - 1))
    rows = [(i, " ".join(f"w{rng.random()}" for _ in range(rng.randrange(30))) + " " + shared + " " + " ".join(f"v{rng.random()}" for _ in range(rng.randrange(30)))) for i in range(12)]
    got = [set(r.h) for r in winnowing.fingerprints(spark.createDataFrame(rows, "id int, text string"), "text", "fp").select(winnowing.hashes("fp").alias("h")).collect()]
    assert all(a & b for a in got for b in got)


def test_edits(spark):
    rows = [(5, "abcdefgh"), (1, None), (9, "ééééé 日本"), (2, "12345678"), (2, "12345678"), (None, "nul lll l"), (7, "x" * 40)]
    got = winnowing.compare_with_edits(frame(spark, rows)).collect()
    order = ["nul lll l", "", "12345678", "12345678", "abcdefgh", "x" * 40, "ééééé 日本"]
    want = Counter()
    for k, t in enumerate(order):
        cut, nxt = len(t) // 4, order[(k + 1) % len(order)]
        want[hashlib.sha256((t[: len(t) - cut] + nxt[:cut]).encode()).hexdigest(), len(t)] += 1
    assert Counter((r.edited_sha256, r.n_chars) for r in got) == want
    assert len({r.fingerprint for r in got if r.doc_id == 2}) == 1 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    one = winnowing.compare_with_edits(frame(spark, [(1, "abcdabcd")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdabab").hexdigest() and one.near_next == 1
    assert winnowing.compare_with_edits(frame(spark, rows).limit(0)).count() == 0


def test_next_across_ranges(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in random.Random(4).sample(range(1000), 200)], "doc_id long, text string")
    ids = sorted(r.doc_id for r in df.collect())
    got = {r.doc_id: r.n for r in winnowing.with_next(df, chars_per_range=60).select("doc_id", F.col("next.doc_id").alias("n")).collect()}
    assert got == dict(zip(ids, ids[1:] + ids[:1]))


@pytest.mark.parametrize("most", [1024, 16])
def test_ranges(spark, monkeypatch, most):
    monkeypatch.setattr(common, "RANGES_AT_ONCE", most)
    df = spark.range(1000).select(F.when(F.col("id") > 2, F.col("id") * F.col("id")).alias("k"))
    got = [r._r for r in common.with_range(df, "k", F.lit(1), 5).orderBy("k").collect()]
    assert got == sorted(got) and got[:4] == [0] * 4 and max(Counter(got).values()) <= 12 and 150 < len(set(got)) < 250
    assert {r._r for r in common.with_range(df, "k", F.lit(1), 5000).collect()} == {0} and common.with_range(df.limit(0), "k", F.lit(1), 5).count() == 0


# near duplicates


def shingles(text):
    w = [x for x in ("".join(c for c in x if c not in string.punctuation) for x in text.lower().split()) if x]
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    rep, sets = {}, {}
    for i, t in sorted(rows):
        rep.setdefault(t or "", i)
    reps = sorted(set(rep.values()))
    text = {i: t for t, i in rep.items()}
    sets = {i: shingles(text[i]) for i in reps}
    links, root = Counter(), {i: i for i in reps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in reps:
        for b in reps:
            both = len(sets[a] & sets[b])
            if a < b and both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (rep[t or ""], find(rep[t or ""]), links[rep[t or ""]]) for i, t in rows}


def near_rows(n=150, seed=7):
    rng = random.Random(seed)
    rows, base = [], [f"w{k}" for k in range(400)]
    for i in range(n):
        if rows and rng.random() < 0.5:
            words = rng.choice(rows)[1].split()
            for _ in range(rng.randrange(4)):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(base)
        else:
            words = rng.choices(base, k=rng.choice([0, 2, 4, 30, 60, 200]))
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize(("block", "shingles"), [(512, 10**6), (16, 10**6), (512, 900)])
def test_jaccard_join_equals_brute_force(spark, monkeypatch, block, shingles):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", shingles)
    rows = near_rows() + [(500, None), (501, ""), (502, "A b C"), (503, "a B c")]
    # a group of many near copies in one bucket
    words = [f"g{k}" for k in range(120)]
    rows += [(600 + k, " ".join([*words[:k], f"x{k}", *words[k + 1 :]])) for k in range(60)]
    got = {r.doc_id: (r.copy_id, r.class_id, r.n_links) for r in neardup.jaccard_join(frame(spark, rows)).collect()}
    assert got == brute(rows)


def test_join_edge_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, "only null")]
    got = neardup.jaccard_join(frame(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.copy_id or 0, r.n_copies) for r in got) == [(0, 0, 1), (0, 1, 4), (1, 1, 4), (1, 1, 4), (2, 1, 4)]
    assert neardup.jaccard_join(frame(spark, rows).limit(0)).count() == 0
    docs = frame(spark, [(1, "x"), (2, "x"), (3, "y"), (None, "x")])
    kept = neardup.one_of_each(docs, neardup.jaccard_join(docs)).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [1, 3] and docs.columns == kept[0].__fields__


def test_one_of_each_by_row(spark):
    """No text is lost and none stays twice, whatever the ids."""
    near = " ".join(f"w{k}" for k in range(60))
    rows = [(3, "x"), (5, "x"), (5, "only here"), (9, "y"), (9, "y"), (None, "x"), (None, "z"), (None, "z"), (7, near), (None, near + " end"), (7, near + " end"), (8, None), (None, "")]
    docs = frame(spark, rows)
    for fits in (True, False):
        with pytest.MonkeyPatch.context() as m:
            if not fits:
                m.setattr(common, "fits", lambda *a: False)
            kept = sorted((r.doc_id or 0, r.text or "") for r in neardup.one_of_each(docs, neardup.jaccard_join(docs)).collect())
        assert kept == [(0, "z"), (3, "x"), (5, "only here"), (7, near), (8, ""), (9, "y")] or kept == [(0, "z"), (3, "x"), (5, "only here"), (7, near + " end"), (8, ""), (9, "y")]
    assert neardup.one_of_each(docs.limit(0), neardup.jaccard_join(docs.limit(0))).count() == 0


def test_join_of_long_texts_and_signs(spark):
    long = " ".join(f"w{k}" for k in range(120_000))
    rows = [(1, long), (2, long + " end"), (3, "One, two; three (four) FIVE six?"), (4, "one two three four five six"), (5, "... --- !")]
    got = {r.doc_id: (r.class_id, r.n_links) for r in neardup.jaccard_join(frame(spark, rows)).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 1), 4: (3, 1), 5: (5, 0)}


def test_join_equals_all_pairs_on_documents(spark, sf_dir):
    """Recall against all pairs of whole texts."""
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet").collect()]
    got = {r.doc_id: (r.copy_id, r.class_id, r.n_links) for r in neardup.jaccard_join(frame(spark, rows)).collect()}
    assert got == brute(rows) and sum(g[2] for g in got.values()) >= 10


def test_pruning_keeps_pairs_at_the_threshold():
    least = neardup.least_matches()
    assert all(0 < least[n] < 0.8 * n for n in least)
    rng = np.random.default_rng(1)
    lost = sum(any((m := rng.binomial(1, 0.8, neardup.VALUES)[:n].sum()) < least[n] for n in least) for _ in range(2000))
    assert lost <= 6 and m >= 0


def test_components(spark):
    rng = random.Random(9)
    edges = [(k, k + 1) for k in range(0, 40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(5, 5)]
    got = {r.id: r.root for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert all(got[x] == root[x] for x in got) and got[40] == 0


# line dedup


def plain_recurring(rows, least=linededup.LEAST_DOCS, similarity=linededup.SIMILARITY):
    """drop_recurring by its definition, with tuples of tokens as templates."""
    docs = []
    for i, t in rows:
        lines = []
        for line in (t or "").split("\n"):
            tokens = tuple("<*>" if any(c in "0123456789" for c in x) else x for x in line.split())
            lines.append((line, tokens))
        docs.append((i, lines))
    leaf = lambda x: (len(x), x[: linededup.DEPTH])
    kinds, size = defaultdict(set), Counter()
    for _, lines in docs:
        for x in {x for _, x in lines if x}:
            kinds[leaf(x)].add(x)
            size[leaf(x)] += 1
    need = lambda x: min(least, linededup.LONG_LEAST_DOCS) if len(x) >= linededup.LONG else least
    wide = {k for k, v in kinds.items() if len(v) > 1 and size[k] >= need(next(iter(v)))}
    times = Counter()
    for _, lines in docs:
        times.update({(leaf(x), p, x[p]) for _, x in lines if x and leaf(x) in wide for p in range(linededup.DEPTH, len(x))})

    def templates(x):
        out, n = {x}, len(x)
        free = int(n * (1 - similarity) + 1e-9)
        if leaf(x) in wide and free:
            out |= {x[:p] + ("<*>",) * free + x[p + free :] for p in range(linededup.DEPTH, n - free + 1)}
            rare = [p for p in range(linededup.DEPTH, n) if x[p] != "<*>" and times[leaf(x), p, x[p]] < least]
            if 0 < len(rare) <= free:
                out.add(tuple("<*>" if p in rare else w for p, w in enumerate(x)))
        return out

    where = defaultdict(list)
    for d, (i, lines) in enumerate(docs):
        for t in set().union(*(templates(x) for _, x in lines if x)):
            where[t].append((i is None, i or 0, d))
    gone = lambda d, x: bool(x) and any(len(where[t]) >= need(t) and min(where[t])[2] != d for t in templates(x))
    return {i: "\n".join(line for line, x in lines if not gone(d, x)) for d, (i, lines) in enumerate(docs)}


@pytest.fixture(params=["held", "joined"])
def tables(request, monkeypatch):
    """Tables that fit the workers, and such that do not."""
    if request.param == "joined":
        monkeypatch.setattr(linededup, "fits", lambda *a: False)


def test_line_templates(spark, tables):
    rows = [(i, f"Story {'abcdefghijklmnop'[i]} is its own\n\nPosted by user{i} at 12:{i:02d} today\nRead our terms of use before you go {'now' if i % 2 else 'home'}") for i in range(12)]
    rows += [(50, None), (51, ""), (None, "Posted by user7 at 12:07 today"), (60, "Posted by nobody"), (61, "x " * 3000)]
    got = {r.doc_id: r for r in linededup.drop_recurring(frame(spark, rows), keep=("lang",)).collect()}
    assert got[0].text == rows[0][1] and got[0].n_dropped == 0
    assert got[3].text == "Story d is its own\n" and got[3].n_dropped == 2 and got[3].n_lines == 4
    assert got[None].n_dropped == 1 and got[50].text == "" and got[60].n_dropped == 0 and got[61].text == "x " * 3000 and got[3].lang == "en"
    assert {i: r.text for i, r in got.items()} == plain_recurring(rows)
    clash = frame(spark, rows).withColumnRenamed("lang", "template").withColumn("key", F.lit(1)).withColumn("first", F.lit(2)).withColumn("th", F.lit(3)).withColumn("n_lines", F.lit(4))
    assert linededup.drop_recurring(clash).count() == len(rows) and linededup.drop_recurring(clash.limit(0)).count() == 0


def test_templates_equal_brute_force(spark, tables):
    rng = random.Random(3)
    pool = [" ".join(rng.choices("abcdefghij", k=9)) for _ in range(30)]
    rows = []
    for i in range(150):
        lines = rng.choices(pool, k=2) + [f"own {'q' * i}"]
        lines.append(f"read more about {'xyz'[i % 3] * (i + 1)} on our site today")
        lines.append(f"the next user {'k' * (i % 60 + 1)} has come in from {'m' * (i % 70 + 1)} to our page")
        lines.append("all of it " + " ".join(rng.choices(["aa", "bb", "cc", "7", f"d{'d' * i}"], k=rng.choice([3, 5, 9]))))
        lines.append("one two three " + " ".join(["same", *[rng.choice("uv") for _ in range(2)], *["word"] * 46, rng.choice("rs")]))
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    got = {r.doc_id: r.text for r in linededup.drop_recurring(frame(spark, rows)).collect()}
    assert got == plain_recurring(rows) and sum("read more" in t for t in got.values()) == 1 and sum("next user" in t for t in got.values()) == 1


def test_exact_lines_equal_brute_force(spark):
    rng = random.Random(3)
    pool = [" ".join(rng.choices("abcdefghij", k=9)) for _ in range(30)]
    rows = [(i, "\n".join(rng.choices(pool, k=6) + [f"own {'q' * i}"])) for i in range(40)]
    # only equal lines share a template at full similarity
    got = {r.doc_id: r.text for r in linededup.drop_recurring(frame(spark, rows), similarity=1.0).collect()}
    assert got == plain_recurring(rows, similarity=1.0)


@pytest.mark.parametrize("n", [1000, 1200])
def test_crowded_leaves_are_as_others(spark, n):
    words = ["".join(chr(97 + int(d)) for d in f"{i:04d}") for i in range(n)]
    got = linededup.drop_recurring(frame(spark, [(i, f"Share this article with {w} on your page") for i, w in enumerate(words)])).collect()
    assert len(got) == n and [r.doc_id for r in got if not r.n_dropped] == [0]


def test_rows_by_id_and_text(spark):
    rows = [(None, "same old line\nx"), (4, "same old line\ny"), (4, "same old line\nz"), (4, "same old line\nz"), (9, "same old line")]
    got = Counter((r.doc_id, r.text) for r in linededup.drop_recurring(frame(spark, rows), least_docs=2).collect())
    kept = [t for (i, t), n in got.items() if "same" in t]
    assert len(kept) == 1 and got[None, "x"] == 1 and got[9, ""] == 1 and sum(got.values()) == 5


def test_passages_recur_in_two_documents(spark):
    passage = [f"w{'xy'[i % 2] * (i // 2 + 1)}" for i in range(linededup.LONG)]
    long, short, other = " ".join(passage), " ".join(passage[1:]), " ".join([*passage[:-1], "end"])
    rows = [(1, f"one\n{long}\n{short}"), (2, f"two\n{short}\n{long}"), (3, f"three\n{other}"), (4, f"four\n{short}")]
    got = {r.doc_id: r.text for r in linededup.drop_recurring(frame(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: f"two\n{short}", 3: "three", 4: rows[3][1]}


# quality


def plain_signs(text):
    out, run, before = "", 0, None
    for k, w in enumerate(text.split()):
        run = run + 1 if w == before else 0
        before = w
        out += " " * (k > 0) + (quality.AGAIN[min(run - 1, 5)] if run else w)
    return out


def plain_text(text):
    return quality.BEGIN * (quality.ORDER - 1) + plain_signs(text) + quality.END


def plain_model(texts):
    """Interpolated modified Kneser-Ney by its formulas, over one language."""
    n, top = quality.ORDER, Counter()
    for t in texts:
        s = plain_text(t)
        for k in range(n - 1, len(s)):
            top[s[k - n + 1 : k + 1]] += 1
    tables = {n: top}
    for k in range(n - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    rates, contexts = {}, {}
    for k, c in tables.items():
        m = [sum(v == j for v in c.values()) for j in range(1, 5)]
        y = m[0] / (m[0] + 2 * m[1]) if m[0] + m[1] else 0
        rates[k] = [min(max((j - (j + 1) * y * m[j] / m[j - 1]) if m[0] and m[j - 1] else 0.7, 0.05), j - 0.05) for j in (1, 2, 3)]
        contexts[k] = defaultdict(list)
        for g, v in c.items():
            contexts[k][g[:-1]].append(v)

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / quality.SIGNS
        seen = contexts[k].get(g[:-1])
        if not seen:
            return p(g[1:])
        weight = sum(rates[k][min(v, 3) - 1] for v in seen) / sum(seen)
        v = tables[k].get(g, 0)
        own = (v - rates[k][min(v, 3) - 1]) / sum(seen) if v else 0
        return own + weight * p(g[1:])

    return lambda t: [math.log(p(s[k - quality.ORDER + 1 : k + 1])) for s in [plain_text(t)] for k in range(quality.ORDER - 1, len(s))]


def test_model_equals_its_formulas(spark):
    rng = random.Random(6)
    make = lambda letters: [" ".join("".join(rng.choices(letters, k=rng.randrange(1, 4))) for _ in range(rng.randrange(0, 30))) for _ in range(60)]
    # the second and third language differ in signs 128 apart, the first has those that marks might be taken for
    pools = [make("abé\x02\x04") + ["the the the the the the the"], make("日本語"), make("旦朮誮😀")]
    model = quality.train(spark.createDataFrame([(t, n) for n, pool in enumerate(pools) for t in pool], "text string, model long"))
    for rows in (10**9, 500):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(quality, "SHARD_ROWS", rows)
            paths = quality.write_model(model)
        assert sorted(paths) == [0, 1, 2] and all((len(p) > 1) == (rows == 500) for p in paths.values())
        known = quality.Model(paths)
        for n, pool in enumerate(pools):
            plain = plain_model(pool)
            for t in [*pool[:15], "zzz abé", "", "ab ab ab ab 日 旦", "x" * 40]:
                hi, lo, size, _ = quality.grams([t], np.array([n]))
                a, b, which = quality.distinct(hi, lo)
                assert size[0] == len(hi) == len(plain_signs(t)) + 1 and len({*zip(a.tolist(), b.tolist())}) == len(a)
                assert np.allclose(known.log_probabilities(a, b)[which], plain(t), atol=1e-4)


def test_threshold_by_plain_arithmetic(spark):
    """Perplexities and thresholds of classify, from plain models of the halves."""
    rng = random.Random(8)
    rows = [(i, " ".join("".join(rng.choices("abcd", k=rng.randrange(1, 5))) for _ in range(rng.randrange(5, 20)))) for i in range(60)]
    docs = frame(spark, rows)
    half = {r.text: r.h for r in docs.select("text", (F.pmod(F.xxhash64("text"), F.lit(2)) + 1).alias("h")).collect()}
    got = {r.doc_id: r for r in quality.classify(docs, spark.createDataFrame([(i, 1, 0) for i in range(50)], "doc_id long, quality int, toxic int")).collect()}
    trusted = [t for i, t in rows if i < 50]
    full, parts = plain_model(trusted), {h: plain_model([t for t in trusted if half[t] == h]) for h in (1, 2)}
    held = [(-sum(x), len(x)) for t in trusted for x in [parts[3 - half[t]](t)]]
    mean = sum(a for a, _ in held) / sum(n for _, n in held)
    score = lambda a, n: (a + quality.PRIOR * mean) / (n + quality.PRIOR)
    limit = sorted(score(a, n) for a, n in held)[math.ceil(quality.QUANTILE * len(held)) - 1] * quality.SLACK
    for i, t in rows:
        x = full(t)
        s = score(-sum(x), len(x))
        assert math.isclose(got[i].perplexity, math.exp(s), rel_tol=1e-4) and math.isclose(got[i].threshold, math.exp(limit), rel_tol=1e-4) and got[i].keep == (s <= limit) and got[i].n_chars == len(t)


def test_classifier_on_labelled_rows(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels).join(labels, "doc_id").collect()
    clean = [r.keep for r in got if r.quality == 1 and r.toxic == 0]
    junk = [r.keep for r in got if r.quality == 0]
    assert sum(clean) / len(clean) >= 0.99 and sum(junk) / len(junk) <= 0.1


def test_classifier_edge_rows(spark):
    docs = spark.createDataFrame([(1, "a b c", "en", "s"), (1, "a b c", "en", "s"), (2, None, None, "s"), (None, "zzzz", "xx", "s"), (4, "x" * 5000, "en", "s")], "doc_id long, text string, lang string, nats string").withColumn("model", F.lit(1)).withColumn("digest", F.lit("d")).withColumn("half", F.lit(7))
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, None), (2, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == 5 and all(r.keep for r in got if r.doc_id in (1, 2)) and not next(r for r in got if r.doc_id == 4).keep
    assert quality.classify(docs.limit(0), labels).count() == 0
    assert all(r.keep for r in quality.classify(docs, labels.limit(0)).collect())


def test_languages_with_little_or_no_trusted_text(spark):
    rng = random.Random(4)
    pools = {lang: ["".join(rng.choices(letters, k=rng.randrange(2, 9))) for _ in range(400)] for lang, letters in (("en", "etaoinshr"), ("xx", "bcdfgjklm"), ("yy", "pquvwxyzé"))}
    clean = lambda lang: " ".join(rng.choices(pools[lang], k=60))
    rows = [(i, clean("en"), "en") for i in range(60)] + [(100 + i, clean("xx"), "xx") for i in range(40)] + [(200 + i, clean("yy"), "yy" if i % 2 else None) for i in range(10)]
    rows += [(300 + i, "".join(rng.choices("bcdfgjklmé0123456789#", k=300)), "en") for i in range(10)]
    labels = [(i, 1, 0) for i in [*range(50), *range(100, 104)]]
    got = {r.doc_id: r.keep for r in quality.classify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert all(got[i] for i in got if i < 300) and not any(got[i] for i in got if i >= 300)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n", max_size=30), min_size=1, max_size=6))
def test_grams_of_random_texts(texts):
    hi, lo, size, offset = quality.grams(texts, np.arange(len(texts)))
    assert size.tolist() == [len(plain_signs(t)) + 1 for t in texts] and offset[0] == 0
    unpack = lambda a, b: "".join(chr(x - 1) for x in ((a >> 21) & 0x1FFFFF, a & 0x1FFFFF, (b >> 42) & 0x1FFFFF, (b >> 21) & 0x1FFFFF, b & 0x1FFFFF))
    want = [(n, s[k - 4 : k + 1]) for n, t in enumerate(texts) for s in [plain_text(t)] for k in range(4, len(s))]
    assert [(a >> quality.MODEL_AT, unpack(a, b)) for a, b in zip(hi.tolist(), lo.tolist())] == want


def test_models_of_one_and_of_many_shards_score_alike(spark, monkeypatch):
    import numpy as np

    rng = random.Random(11)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) for _ in range(30)) for _ in range(40)]
    model = quality.train(spark.createDataFrame([(t, 4 * (k % 2)) for k, t in enumerate(texts)], "text string, model long"))
    hi, lo = quality.grams([*texts, "unseen words, zzz", ""], np.array([4 * (k % 2) for k in range(42)]))[:2]
    one = quality.Model(quality.write_model(model)).log_probabilities(hi, lo)
    monkeypatch.setattr(quality, "SHARD_ROWS", 100)
    paths = quality.write_model(model)
    assert min(map(len, paths.values())) > 2
    for most in (1, 150, 10**6):
        many = quality.Model(paths, most)
        reads, read = [], quality.Shard.__init__
        monkeypatch.setattr(quality.Shard, "__init__", lambda self, *a, read=read: (reads.append(1), read(self, *a))[1])
        assert np.allclose(many.log_probabilities(hi, lo), one, atol=1e-5)
        monkeypatch.setattr(quality.Shard, "__init__", read)
        assert len(reads) <= sum(map(len, paths.values()))


@pytest.mark.parametrize("keys", [10, 2000])
def test_spread_join(spark, monkeypatch, keys):
    """Rows of hot keys, repeated ones too, meet their row of the table once, in several tasks; other keys are as ever."""
    monkeypatch.setattr(common, "HOT_KEYS", keys)
    rows = [(1, k) for k in range(600)] + [(2, 7)] * 300 + [(k, k) for k in range(3, 103)] + [(999, 1)]
    left = spark.createDataFrame(rows, "key int, v int").repartition(8)
    table = spark.createDataFrame([(k, n) for k, n in Counter(k for k, _ in rows).items() if k != 999] + [(5000, 1)], "key int, n int")
    for broadcast in ("-1", "10m"):
        old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
        try:
            got = common.spread_join(left, table, ["key"], "n", len(rows))
            found = got.withColumn("task", F.spark_partition_id()).collect()
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        assert got.columns == ["key", "v", "n"]
        assert Counter((r.key, r.v) for r in found) == Counter(r for r in rows if r[0] != 999)
        assert {r.key: r.n for r in found}[1] == 600
    assert common.spread_join(left, table.limit(0), ["key"], "n", 0).count() == 0


def test_hot_rows_are_dealt(spark):
    left = spark.range(20_000).select(F.lit(1).alias("key"), "id")
    table = spark.createDataFrame([(1, 20_000)], "key int, n int")
    confs = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    old = {k: spark.conf.get(k) for k in confs}
    for k, v in confs.items():
        spark.conf.set(k, v)
    try:
        tasks = common.spread_join(left, table, ["key"], "n", 20_000).groupBy(F.spark_partition_id().alias("t")).count().collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(tasks) == 8 and max(r["count"] for r in tasks) < 2 * 20_000 / 8

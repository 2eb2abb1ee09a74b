import hashlib
import io
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from siftstream.llm import bpe, packing, rans, token_files, tokens

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
ODD = [
    "", "a", "  a", " a", "a ", "a\n\nb", "a \n b", "a\n b", "x  y   z", "\n", "\n\n ", "don't can't it's 12 34", "é́ x", "<|endoftext|> a b", "a<|endoftext|>b", "tab\tb c", "a\r\nb c", "Σ ΟΔΟΣ İ", "x\x1c y",
    "a\x85 b", "日本語 テキスト", "😀😀 a", "</w> a</w>", "a.b.c...", "ŉ ǆ ﬁ ①", "the***, and!! (x).", "a" * 5000, "word " * 3000,
]
SCHEMA = "doc_id long, text string, ids string, start string"


@pytest.fixture(scope="module")
def lib():
    return {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return ODD + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


@pytest.mark.parametrize("path, kept", [(BYTE, True), (WORD, False)])
def test_pieces_equal_whole_texts(lib, texts, path, kept):
    enc = tokens.PieceEncoder(path, kept, most=50)
    want = [lib[path].encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == want


def test_words_that_are_merged_together(lib, texts):
    """Many words a string; each has the ids that it has alone, also where a string of words ends."""
    enc = tokens.PieceEncoder(BYTE, True)
    words = sorted({w for t in texts for w in t.split() if w.isalpha() and max(w) < "\u0250"} | {"a", "é", "ɏ", "Über", "x" * 3000})
    asked = []
    model = enc.words

    class Counting:
        def encode_batch_fast(self, lines, **more):
            asked.extend(lines)
            return model.encode_batch_fast(lines, **more)

    enc.words = Counting()
    want = [np.asarray(lib[BYTE].encode(" " + w, add_special_tokens=False).ids, "<u4").tobytes() for w in words]
    assert enc.word_ids(words) == want and len(asked) == -(-len(words) // enc.TOGETHER)
    for n in (1, enc.TOGETHER, enc.TOGETHER + 1):
        assert enc.word_ids(words[:n]) == want[:n]
    enc.words, enc.between = model, None
    assert enc.word_ids(words) == want
    assert tokens.PieceEncoder(WORD, False).between is None


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab Zé'.!\n\t1Σ́ 日<|>"), max_size=40))
def test_random_texts(text):
    for path, kept in ((BYTE, True), (WORD, False)):
        enc = tokens.encoder(path, kept)
        assert np.frombuffer(enc.encode([text])[0], "<u4").tolist() == enc.lib.encode(text, add_special_tokens=False).ids
    assert bpe.coder(WORD).encode(text).tolist() == tokens.encoder(WORD, False).lib.encode(text, add_special_tokens=False).ids


def test_forced_boundaries_equal_the_library(lib, texts):
    coder = bpe.ForcedBoundaryBpe(WORD, most=50)
    for text, got in zip(texts, coder.digests(texts)):
        ids = lib[WORD].encode(text, add_special_tokens=False).ids
        decoded = lib[WORD].decode(ids, skip_special_tokens=False)
        assert got == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
        assert coder.encode(text).tolist() == ids and coder.decode(ids) == decoded


def test_cuts_lie_between_symbols_that_no_token_joins():
    coder = bpe.coder(WORD)
    for token in list(coder.vocab)[5000:6000]:
        assert all(p in coder.joined for p in coder._pairs(token))
    assert [f for f in coder.cut(["q", "q", "z</w>"])] and sum(len(f) for f in coder.cut(list("qxjkz"))) == 5


def test_long_words(lib):
    """A run without certain cuts is merged by a heap, as the library merges it."""
    import time

    coder, rng = bpe.ForcedBoundaryBpe(WORD), np.random.default_rng(5)
    for word in ("a" * 3001, "ab" * 900, "".join(rng.choice(list("aeinrst"), 4000)), "é" * 500, "x" * 49, "-" * 777):
        assert coder.encode(word).tolist() == lib[WORD].encode(word, add_special_tokens=False).ids
    began = time.time()
    assert len(coder.encode("a" * 1_000_000)) > 1000 and time.time() - began < 60
    assert all(len(k) <= 64 for k in coder.fragments.young)


def test_bpe_query(spark, lib, sf_dir):
    rows = bpe.query(spark, sf_dir).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r.doc_id: r.n_tokens for r in rows} == {i: len(lib[WORD].encode(t, add_special_tokens=False).ids) for i, t in docs.items()}


def test_bpe_edge_rows(spark):
    df = spark.createDataFrame([(1, None, "c", "c"), (1, "", "c", "c"), (None, "a b", "c", "c"), (2, "a b", "c", "c"), (2, "a b", "c", "c")], SCHEMA)
    empty = hashlib.sha256(b"").hexdigest()
    got = bpe.digest_documents(df, WORD).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256 == empty) for r in got) == [(0, 2, False), (1, 0, True), (1, 0, True), (2, 2, False), (2, 2, False)]
    assert bpe.digest_documents(df.limit(0), WORD).count() == 0
    assert {r.decoded for r in bpe.encode_documents(df, WORD).collect()} == {"", "a</w> b</w>"}


@pytest.mark.parametrize("n", [0, 1, 5, 63, 64, 1000, 70_000, (1 << 20) + 7])
def test_rans_round_trip(n):
    rng = np.random.default_rng(n)
    symbols = (rng.zipf(1.3, n) % 50_257).astype(np.uint32)
    table = rans.Table.from_bytes(rans.Table(rans.scaled(np.bincount(symbols, minlength=10))).to_bytes())
    out = io.BytesIO()
    writer = rans.Writer(out, table, 11)
    parts = np.split(symbols, np.sort(rng.integers(0, n + 1, 5)))
    for k, p in enumerate(parts):
        writer.add(k - 2 if k != 1 else None, p)
    got = list(rans.read_documents(out, writer.close(), table))
    assert [g[0] for g in got] == [-2, None, 0, 1, 2, 3] and got[0][1] == 11
    assert all(np.array_equal(g[2], p) for g, p in zip(got, parts))


def test_rans_segments_and_damage():
    symbols = np.arange(200_000, dtype=np.uint32) % 700
    table = rans.Table(rans.scaled(np.bincount(symbols)))
    block = rans.encode_block(symbols, table)
    n = rans.LANES if len(symbols) // 64 >= rans.LANES else len(symbols) // 64
    assert np.array_equal(rans.decode_segment(block, 0, table), symbols[: min(len(symbols), n * rans.STEPS)])
    bad = bytearray(block)
    bad[len(bad) // 2] ^= 1
    with pytest.raises(ValueError):
        rans.decode_block(bytes(bad), table)
    assert int(rans.scaled(np.array([0, 1, 10**9])).sum()) == 1 << rans.SCALE


def test_token_files(spark, lib, monkeypatch):
    rows = [(5, "the cat", "c", "c"), (2, None, "c", "c"), (9, "a b c " * 4000, "c", "c"), (2, "x", "c", "c"), (None, "n", "c", "c"), (9, "a b c " * 4000, "c", "c"), (-(1 << 63), "m", "c", "c")]
    monkeypatch.setattr(token_files, "FILES_PER_GROUP", 2)
    got = token_files.read_ids(*token_files.write_ids(spark.createDataFrame(rows, SCHEMA), BYTE, chars_per_file=20_000), with_ids=True).collect()
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, -(1 << 63), 2, 2, 5, 9, 9]
    texts = ["n", "m", "", "x", "the cat", "a b c " * 4000, "a b c " * 4000]
    start = 0
    for r, t in zip(got, texts):
        ids = np.asarray([*lib[BYTE].encode(t, add_special_tokens=False).ids, 0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (start, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        start += len(ids)
    empty = spark.createDataFrame(rows, SCHEMA).limit(0)
    assert token_files.read_ids(*token_files.write_ids(empty, BYTE)).count() == 0


def plain_ffd(lengths, capacity):
    bins, out = [], {}
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        b = next((b for b, room in enumerate(bins) if room >= lengths[k]), None)
        if b is None:
            bins.append(capacity)
            b = len(bins) - 1
        out[k] = (b, capacity - bins[b])
        bins[b] -= lengths[k]
    return [out[k] for k in range(len(lengths))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_tournament_tree_is_first_fit_decreasing(lengths):
    bins, offsets = packing.first_fit_decreasing(np.asarray(lengths, np.int64), 64)
    assert list(zip(bins.tolist(), offsets.tolist())) == plain_ffd(lengths, 64)


def test_packing(spark, lib):
    rows = [(i, ("the cat sat " * (i * 37 % 900)), "c", "c") for i in range(60)] + [(70, None, "c", "c"), (None, "z", "c", "c"), (3, "twice", "c", "c"), (3, "twice", "c", "c"), (80, "word " * 9000, "c", "c")]
    got = packing.pack_documents(spark.createDataFrame(rows, SCHEMA), WORD, chars_per_group=100_000).collect()
    want = sorted((i if i is not None else -1, len(lib[WORD].encode(t or "", add_special_tokens=False).ids) + 1) for i, t, _, _ in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.doc_tokens) for r in got if r.start == 0) == want
    used: dict = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used.get(r.sequence_id, 0)
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= 4096 and len({s >> 32 for s in used}) > 1
    ids = np.asarray([*lib[WORD].encode("word " * 9000, add_special_tokens=False).ids, 2], "<u4")
    for r in (r for r in got if r.doc_id == 80):
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert sum(r.length for r in got if r.doc_id == 80) == len(ids)
    assert packing.pack_documents(spark.createDataFrame(rows, SCHEMA).limit(0), WORD).count() == 0


def test_packing_keeps_ids_beside_nulls(spark):
    ids = [9007199254740993, 9007199254740995, None, -(1 << 63), (1 << 63) - 1]
    got = packing.pack_documents(spark.createDataFrame([(k, f"text {k}") for k in ids], "doc_id long, text string"), WORD).collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted(ids, key=str)


def test_packing_spreads_null_ids(spark):
    """Ten thousand texts without ids lie in as many groups as others do, and every piece in a sequence of its own place."""
    df = spark.range(10_000).select(packing.F.lit(None).cast("long").alias("doc_id"), packing.F.concat(packing.F.lit("some words of text "), "id").alias("text"))
    got = packing.pack_documents(df, WORD, chars_per_group=25_000).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.sequence_id >> 32, []).append(r)
    assert len(got) == 10_000 and len(groups) >= 9 and max(map(len, groups.values())) < 3000
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0) and r.offset + r.length <= 4096
        ends[r.sequence_id] = r.offset + r.length


def test_token_files_of_null_ids(spark, lib):
    """Rows of one null id are dealt to several files and all come back."""
    texts = [f"number {k} of many" for k in range(3000)]
    manifest, table = token_files.write_ids(spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string"), BYTE, chars_per_file=10_000)
    assert manifest.count() > 3
    got = token_files.read_ids(manifest, table).collect()
    want = sorted(zlib.crc32(np.asarray(lib[BYTE].encode(t, add_special_tokens=False).ids + [0], "<u4").tobytes()) for t in texts)
    assert sorted(r.ids_crc32 for r in got) == want
    starts = sorted((r.start, r.n_tokens) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_token_files_of_large_vocabularies(tmp_path, monkeypatch):
    """Ids beyond 16 bits come up in the middle of a spool."""
    import pyarrow as pa
    import pyspark

    lists = [[5, 6, 7], [65_535], [70_000, 1], [3], [200_000] * 5]

    class Encoder:
        def encode(self, texts):
            return [np.asarray(lists[int(t)], "<u4").tobytes() for t in texts]

    monkeypatch.setattr(tokens, "encoder", lambda *a: Encoder())
    monkeypatch.setattr(pyspark.TaskContext, "get", classmethod(lambda cls: type("Part", (), {"partitionId": lambda self: 0})()))
    batches = [pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([str(k)])], names=["doc_id", "text"]) for k in range(len(lists))]
    spool = next(token_files._spool(batches, str(tmp_path), "", 0)).to_pylist()[0]
    flat = [x for ids in lists for x in [*ids, 0]]
    table = rans.Table(rans.scaled(np.bincount(flat)))
    todo = pa.RecordBatch.from_pylist([{k: spool[k] for k in ("part", "spool", "docs", "ids")} | {"before": 0}])
    done = next(token_files._encode([todo], str(tmp_path), table.to_bytes())).to_pylist()[0]
    with open(done["path"], "rb") as f:
        assert [ids.tolist() for _, _, ids in rans.read_documents(f, done["size"], table)] == [[*ids, 0] for ids in lists]

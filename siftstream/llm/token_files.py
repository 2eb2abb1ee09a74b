"""Token ids of documents in rANS files (see ``rans``), in ascending order of the documents' keys."""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import rans
from .common import session, text_of, work_path, written
from .files import new_name, opened

#: Files whose numbers of ids are summed in one task, and the most characters that a file is meant to have.
FILES_PER_GROUP, MOST_CHARS = 4096, 256_000_000
SPOOL = "part int, spool string, docs long, ids long, hist binary"
MANIFEST = "part int, path string, size long, before long, docs long, ids long"
DOCUMENT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _spool(batches, folder: str, tokenizer: str, end_id: int):
    """Tokenises one range of documents in order and keeps the ids in a compressed file of its own."""
    import pyarrow as pa
    from pyspark import TaskContext

    from .tokens import chunks, encoder

    part = TaskContext.get().partitionId()
    enc, end = encoder(tokenizer, True), np.asarray([end_id], "<u4").tobytes()
    name, sink, docs, n, hist = new_name(folder, f"spool-{part:06d}", ".arrow"), None, 0, 0, np.zeros(1 << 16, np.int64)
    schema = pa.schema([("doc_id", pa.int64()), ("wide", pa.bool_()), ("ids", pa.large_binary())])
    for batch in batches:
        keys, texts = batch.column(0), batch.column(1).to_pylist()
        for lo, hi in chunks(texts):
            ids = [x + end for x in enc.encode(texts[lo:hi])]
            flat = np.frombuffer(b"".join(ids), "<u4")
            if flat.max() >= len(hist):
                hist = np.concatenate([hist, np.zeros(int(flat.max()) + 1 - len(hist), np.int64)])
            hist += np.bincount(flat, minlength=len(hist))
            if sink is None:
                out = opened(name, "wb")
                sink = pa.ipc.new_stream(out, schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
            # each row says how wide its ids are: what this task has met so far decides that
            wide = len(hist) > 1 << 16
            rows = ids if wide else [np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in ids]
            sink.write_batch(pa.record_batch([keys.slice(lo, hi - lo), pa.array([wide] * len(ids)), pa.array(rows, pa.large_binary())], schema=schema))
            docs, n = docs + hi - lo, n + len(flat)
    if sink is not None:
        sink.close()
        out.close()
        seen = np.flatnonzero(hist)
        packed = zlib.compress(seen.astype("<u4").tobytes() + hist[seen].astype("<u8").tobytes(), 1)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "spool": [name], "docs": [docs], "ids": [n], "hist": [packed]})


def _histogram(batches):
    import pyarrow as pa

    for batch in batches:
        for packed in batch.column(0).to_pylist():
            raw = zlib.decompress(packed)
            n = len(raw) // 12
            yield pa.RecordBatch.from_pydict({"symbol": np.frombuffer(raw, "<u4", n).astype(np.int64), "times": np.frombuffer(raw, "<u8", n, 4 * n).astype(np.int64)})


def _encode(batches, folder: str, table_bytes: bytes):
    import pyarrow as pa

    table = rans.Table.from_bytes(table_bytes)
    for batch in batches:
        for row in batch.to_pylist():
            name = new_name(folder, f"ids-{row['part']:06d}", ".rans")
            with opened(row["spool"]) as source, opened(name, "wb") as out:
                writer = rans.Writer(out, table, row["before"])
                for b in pa.ipc.open_stream(source):
                    for key, wide, ids in zip(*[c.to_pylist() for c in b.columns]):
                        writer.add(key, np.frombuffer(ids, "<u4") if wide else np.frombuffer(ids, "<u2").astype(np.uint32))
                size = writer.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([row["part"]], pa.int32()), "path": [name], "size": [size], "before": [row["before"]], "docs": [row["docs"]], "ids": [row["ids"]]})


def _decode(batches, table_path: str, with_ids: bool):
    import pyarrow as pa

    with opened(table_path) as f:
        table = rans.Table.from_bytes(f.read())
    for batch in batches:
        for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held = []
            with opened(path) as source:
                for key, start, ids in rans.read_documents(source, size, table):
                    raw = ids.astype("<u4").tobytes()
                    held.append((key, start, len(ids), zlib.crc32(raw), raw if with_ids else None))
                    if len(held) >= (256 if with_ids else 8192):
                        yield _rows(held, with_ids)
                        held = []
            if held:
                yield _rows(held, with_ids)


def _rows(held: list, with_ids: bool):
    import pyarrow as pa

    a, b, c, d, e = zip(*held)
    cols = {"doc_id": pa.array(a, pa.int64()), "start": pa.array(b, pa.int64()), "n_tokens": pa.array(c, pa.int64()), "ids_crc32": pa.array(d, pa.int64())}
    return pa.RecordBatch.from_pydict(cols | ({"ids": pa.array(e, pa.binary())} if with_ids else {}))


def write_ids(docs: DataFrame, tokenizer: str, end_id: int = 0, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", chars_per_file: int = 8_000_000) -> tuple[DataFrame, str]:
    """Writes the ids of every whole text, each followed by end_id, in ascending order of id_col.

    Returns the manifest (a row per file) and the path of the frequency table. Null texts are empty, so give end_id alone.
    Null keys come first. Rows with equal keys are ordered by a hash of their text and all kept; they may lie in several files. Other columns are ignored. An empty table
    gives an empty manifest. Files have chars_per_file characters, or more of them where there would be over 10,000 files.

    Plan: one range shuffle of the texts; each task tokenises its range into a compressed spool, whose histogram goes to
    one small aggregate (as many rows as the vocabulary has ids). Then each spool becomes one file. Files are named anew
    by each attempt, and only those in the written manifest count, so lost executors cost a repeated task.
    """
    spark = session(docs.sparkSession)
    folder = folder or work_path(spark, "ids")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    total = docs.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    n = max(1, math.ceil(total / min(max(chars_per_file, total // 10_000), max(chars_per_file, MOST_CHARS))))
    # the sizes of batches are bounded in rows; long texts are taken a few at a time
    text_hash = F.xxhash64("text")
    spread = docs.repartitionByRange(n, "doc_id", text_hash).sortWithinPartitions("doc_id", text_hash, "text")
    spools = written(spread.mapInArrow(lambda b: _spool(b, folder, tokenizer, end_id), SPOOL), "spools")
    counts = spools.select("hist").mapInArrow(_histogram, "symbol long, times long").groupBy("symbol").agg(F.sum("times").alias("times")).collect()
    hist = np.zeros(max((r.symbol for r in counts), default=0) + 1, np.int64)
    for r in counts:
        hist[r.symbol] = r.times
    table = rans.Table(rans.scaled(hist))
    table_path = new_name(folder, "frequencies", ".bin")
    with opened(table_path, "wb") as f:
        f.write(table.to_bytes())
    # what stands before each file: sums within groups of files, and sums of the groups before
    files = spools.select("part", "spool", "docs", "ids").withColumn("_g", F.floor(F.col("part") / FILES_PER_GROUP))
    groups = files.groupBy("_g").agg(F.sum("ids").alias("_n"))
    earlier = groups.select("_g", F.coalesce(F.sum("_n").over(Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    inside = F.coalesce(F.sum("ids").over(Window.partitionBy("_g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    todo = files.withColumn("_i", inside).join(earlier, "_g").select("part", "spool", (F.col("_b") + F.col("_i")).alias("before"), "docs", "ids").repartition(n, "part")
    data = table.to_bytes()
    return written(todo.mapInArrow(lambda b: _encode(b, folder, data), MANIFEST), "ids-manifest"), table_path


def read_ids(manifest: DataFrame, table_path: str, with_ids: bool = False) -> DataFrame:
    """A row per document, read back from the files: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (bytes)."""
    files = manifest.select("path", "size")
    return files.repartition(max(1, manifest.count()), "path").mapInArrow(lambda b: _decode(b, table_path, with_ids), DOCUMENT + (", ids binary" if with_ids else ""))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_ids(*write_ids(docs, public_tokenizers.path("byte_bpe_50k.json")))



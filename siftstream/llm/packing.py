"""First-fit decreasing in randomised groups, with a tournament tree over the bins' free room."""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import session, text_of

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, grp long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Tournament:
    """Free room of bins in the leaves of a complete tree whose inner nodes hold the larger room of their children."""

    def __init__(self, size: int, capacity: int):
        self.leaves = 1
        while self.leaves < max(1, size):
            self.leaves *= 2
        self.best = [capacity] * (2 * self.leaves)

    def first(self, need: int) -> int:
        """The leftmost bin with that much room. There is always one if there are as many bins as items."""
        best, node = self.best, 1
        while node < self.leaves:
            node *= 2
            if best[node] < need:
                node += 1
        return node - self.leaves

    def take(self, bin_: int, need: int) -> None:
        best, node = self.best, bin_ + self.leaves
        best[node] -= need
        while node > 1:
            node //= 2
            best[node] = max(best[2 * node], best[2 * node + 1])


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each length its bin and its offset there. Equal lengths keep their order; lengths are 1 to capacity."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    # items that fill a bin need no search
    full = int((lengths == capacity).sum())
    bins[order[:full]] = np.arange(full)
    tree = Tournament(len(lengths) - full, capacity)
    for k in order[full:].tolist():
        need = int(lengths[k])
        b = tree.first(need)
        offsets[k] = capacity - tree.best[b + tree.leaves]
        tree.take(b, need)
        bins[k] = full + b
    return bins, offsets


def _pieces(batches, tokenizer: str, end_id: int, capacity: int, groups: int, seed: int):
    import pyarrow as pa

    from .tokens import chunks, encoder

    enc, end = encoder(tokenizer, False), np.asarray([end_id], "<u4").tobytes()
    for batch in batches:
        keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lo, hi in chunks(texts):
            out = []
            for key, ids in zip(keys[lo:hi], enc.encode(texts[lo:hi])):
                ids += end
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    part = ids[4 * start : 4 * (start + capacity)]
                    crc = zlib.crc32(part)
                    out.append((key, start, len(part) // 4, crc, n, zlib.crc32(b"%d %r %d %d" % (seed, key, start, crc)) % groups))
            a = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in a], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "grp"])


def _pack_group(key, pieces, capacity: int):
    """Packs one group. Arrow keeps 64-bit ids exact beside nulls."""
    import pyarrow as pa
    import pyarrow.compute as pc

    order = pc.sort_indices(pieces, sort_keys=[(c, "ascending") for c in ("doc_id", "start", "ids_crc32", "doc_tokens")], null_placement="at_start")
    pieces = pieces.take(order).drop_columns(["grp"])
    bins, offsets = first_fit_decreasing(pieces["length"].to_numpy(), capacity)
    return pieces.append_column("sequence_id", pa.array((key[0].as_py() << 32) + bins)).append_column("offset", pa.array(offsets))


def pack_pieces(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Packs pieces (PIECE, lengths of 1 to capacity) group by group into sequences."""
    return pieces.groupBy("grp").applyInArrow(lambda key, pieces: _pack_group(key, pieces, capacity), PACKED)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", chars_per_group: int = 12_000_000, seed: int = 1) -> DataFrame:
    """Packs the ids of every whole text, each followed by end_id, into sequences of at most capacity ids.

    A document is cut at multiples of capacity only, and each id lies in exactly one piece. A sequence is meant to be
    padded to capacity unless its length is a power of two.

    Pieces go to groups by a seeded hash of id, start and content, so groups are of about one size whatever the sources,
    lengths or ids (null ones included; only pieces alike in all of these share a group for certain); the number of groups follows from the total length, so a group's size (some thousand pieces) is bounded in
    the mean. Null texts are empty and give end_id alone; null keys are kept. Repeated rows are packed each. Other columns
    are ignored; an empty table gives no piece. sequence_id: group << 32 | bin of the group.

    Plan: texts are tokenised where they are read; only narrow piece rows are shuffled, once, by group.
    """
    session(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    total = docs.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    groups = max(1, math.ceil(total / chars_per_group))
    return pack_pieces(docs.mapInArrow(lambda b: _pieces(b, tokenizer, end_id, capacity, groups, seed), PIECE), capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))

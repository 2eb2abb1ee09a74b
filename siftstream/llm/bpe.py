"""BPE encoding by forced boundaries.

Two neighbouring symbols that stand side by side inside no token of the vocabulary can never end up in one token, so a cut
between them is certain. The symbols of a word are cut at all such pairs, the fragments are encoded apart from each other
(and remembered), and their ids are concatenated. Symbols are the vocabulary's byte characters; the last one of a word
carries the end-of-word suffix.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import session, text_of
from .files import held
from .tokens import BYTE_SIGNS, Memo, chunks

ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class ForcedBoundaryBpe:
    """Encodes and decodes as the tokenizers library does with a file whose model is BPE and whose pre-tokenizer drops
    white space; normalisation and word splitting are the file's own."""

    SIGNS = ".,!?;:*%#$&|"

    def __init__(self, path: str, most: int = 250_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.lib = Tokenizer.from_file(path)
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab = dict(model["vocab"])
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.specials.items()}
        self.rank = {}
        for k, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.rank.setdefault((a, b), k)
        self.joined = {p for t in self.vocab if t not in self.specials for p in self._pairs(t)}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.fragments, self.words = Memo(most), Memo(most)

    def _symbols(self, word: str) -> list[str]:
        """The byte characters of a word that has been mapped; the last with the suffix."""
        s = list(word)
        if s:
            s[-1] += self.suffix
        return s

    def _pairs(self, token: str):
        whole = token.endswith(self.suffix) if self.suffix else True
        body = token[: len(token) - len(self.suffix)] if whole and self.suffix else token
        s = list(body)
        if whole and s:
            s[-1] += self.suffix
        return zip(s, s[1:])

    def cut(self, symbols: list[str]) -> list[tuple[str, ...]]:
        """Fragments between the certain cuts."""
        out, at, joined = [], 0, self.joined
        for k in range(1, len(symbols)):
            if (symbols[k - 1], symbols[k]) not in joined:
                out.append(tuple(symbols[at:k]))
                at = k
        out.append(tuple(symbols[at:]))
        return out

    def merge(self, fragment: tuple[str, ...]) -> tuple[int, ...]:
        """Ids of a fragment: the pair of lowest rank first, the leftmost of equals."""
        if len(fragment) > 48:
            return self._merge_long(fragment)
        parts, rank = list(fragment), self.rank
        ranks = [rank.get(p) for p in zip(parts, parts[1:])]
        while True:
            best, at = None, -1
            for k, r in enumerate(ranks):
                if r is not None and (best is None or r < best):
                    best, at = r, k
            if best is None:
                return tuple(self.vocab[p] for p in parts)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank.get((parts[at - 1], parts[at]))
            if at < len(ranks):
                ranks[at] = rank.get((parts[at], parts[at + 1]))

    def _merge_long(self, fragment: tuple[str, ...]) -> tuple[int, ...]:
        """The same by a heap over linked symbols: n log n steps for n symbols."""
        rank, parts, n = self.rank, list(fragment), len(fragment)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(r, k, a, b) for k, (a, b) in enumerate(zip(parts, parts[1:])) if (r := rank.get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            m = after[k]
            # an entry is stale if either of its symbols has changed or gone
            if parts[k] != a or m < 0 or parts[m] != b:
                continue
            parts[k], parts[m] = a + b, ""
            after[k] = right = after[m]
            if right >= 0:
                before[right] = k
            for x, y in ((before[k], k), (k, right)):
                if x >= 0 and y >= 0 and (r := rank.get((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return tuple(self.vocab[p] for p in parts if p)

    def _word(self, mapped: str) -> tuple[int, ...]:
        ids: list[int] = []
        known = self.fragments
        for f in self.cut(self._symbols(mapped)):
            got = known.young.get(f)
            if got is None:
                got = known.old.get(f)
                if got is None:
                    got = self.merge(f)
                if len(known.young) > known.most:
                    known.missing(set())
                if len(f) <= Memo.LONG:
                    known.young[f] = got
            ids += got
        return tuple(ids)

    def _piece(self, piece: str) -> tuple[int, ...]:
        """Ids of a text without white space that cuts it, special tokens apart."""
        if piece.isalpha() and max(piece) < "\u0250" and "\u0130" not in piece:
            # a word of Latin letters is one unit; what the file's normaliser does to it is done here
            return self._word(unicodedata.normalize("NFC", piece).lower().encode().decode("latin-1").translate(BYTE_SIGNS))
        ids: tuple[int, ...] = ()
        for part in self.special.split(piece) if self.special else [piece]:
            if part in self.specials:
                ids += (self.specials[part],)
            elif part:
                for mapped, _ in self.lib.pre_tokenizer.pre_tokenize_str(self.lib.normalizer.normalize_str(part)):
                    ids += self._word(mapped)
        return ids

    def decode(self, ids) -> str:
        """As decode(ids, skip_special_tokens=False) of a file without a decoder: tokens joined by spaces."""
        return " ".join(self.token[i] for i in ids)

    def _known(self, texts: list[str]) -> list[list[str]]:
        """The pieces of each text; the memo then holds each piece's ids (in decimal), their number and decoded form."""
        split = [t.replace("\n", " ").split(" ") for t in texts]
        need: set = set()
        for p in split:
            need.update(p)
        memo = self.words
        miss = memo.missing(need)
        ends: dict[str, tuple] = {}
        for m in miss:
            word = m.rstrip(self.SIGNS)
            if word and len(word) < len(m) and word[-1].isalpha() and "<" not in word:
                end = m[len(word) :]
                if end not in ends:
                    ends[end] = self._piece(end)
                ids = self._piece(word) + ends[end]
            else:
                ids = self._piece(m)
            memo.young[m] = (" ".join(map(str, ids)).encode(), self.decode(ids).encode(), len(ids))
        return split

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """For each text the number of ids and the SHA-256 of decimal ids and of the decoded text."""
        out, get = [], None
        split = self._known(texts)
        get = self.words.young.__getitem__
        for p in split:
            rows = [r for r in map(get, p) if r[2]]
            out.append((sum(r[2] for r in rows), hashlib.sha256(b" ".join([r[0] for r in rows])).hexdigest(), hashlib.sha256(b" ".join([r[1] for r in rows])).hexdigest()))
        return out

    def encode(self, text: str) -> np.ndarray:
        """Ids of one whole text."""
        (pieces,) = self._known([text])
        return np.asarray([int(i) for p in pieces for i in self.words.young[p][0].split()], dtype=np.uint32)


def coder(path: str) -> ForcedBoundaryBpe:
    """This process's coder for a vocabulary file."""
    return held(("forced boundaries", path), lambda: ForcedBoundaryBpe(path))


def _digest(batches, tokenizer: str):
    import pyarrow as pa

    bpe = coder(tokenizer)
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for lo, hi in chunks(texts):
            n, a, b = zip(*bpe.digests(texts[lo:hi]))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(lo, hi - lo), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a), "decoded_sha256": pa.array(b)})


def _encode(batches, tokenizer: str):
    import pyarrow as pa

    bpe = coder(tokenizer)
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for lo, hi in chunks(texts):
            ids = [bpe.encode(t) for t in texts[lo:hi]]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(lo, hi - lo), "ids": pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), "decoded": pa.array([bpe.decode(x.tolist()) for x in ids])})


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    session(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit) and decoded text of every whole text; no shuffle."""
    return _narrow(docs, id_col, text_col).mapInArrow(lambda b: _encode(b, tokenizer), "doc_id long, ids binary, decoded string")


def digest_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text.

    Null and empty texts have no ids and the digests of nothing. Rows are independent of each other, so repeated rows, ties
    and null keys are kept as they are; other columns are ignored; an empty table gives none. No shuffle.
    """
    return _narrow(docs, id_col, text_col).mapInArrow(lambda b: _digest(b, tokenizer), ENCODED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digest_documents(docs, public_tokenizers.path("word_bpe_49k.json"))

"""Token ids in files coded by a static range asymmetric numeral system (rANS).

One table of symbol frequencies, counted over all files and scaled to a power of two, serves every block. A block holds up
to ``BLOCK`` symbols, dealt over up to ``LANES`` interleaved coders that share one stream of 32-bit words. Each block is
cut into segments; a segment's checkpoint holds the states of all lanes, its first word and the crc32 of its symbols, so
segments can be decoded apart from each other. All lanes take a step at once in numpy.

File: ``RANSIDS1``, blocks, footer, u64 length of the footer, ``RANSIDS1``. Footer: u64 ids before the file, u32 number of
blocks and documents, for each block u64 offset and u64 number of symbols, then i64 document keys, u64 numbers of ids and
u8 flags (1: the document has no key).
Everything is little-endian.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"RANSIDS1"
SCALE = 20
LOW = np.uint64(1 << 31)
LANES, STEPS, BLOCK = 4096, 128, 1 << 20


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**SCALE, at least 1 for each symbol that occurs."""
    total = int(counts.sum())
    if not total:
        return np.zeros(len(counts), np.uint32)
    seen = counts > 0
    assert int(seen.sum()) <= 1 << SCALE, "more symbols than slots"
    spare = (1 << SCALE) - int(seen.sum())
    share = counts.astype(np.float64) * spare / total
    out = np.floor(share).astype(np.int64) + seen
    left = (1 << SCALE) - int(out.sum())
    order = np.lexsort((np.arange(len(counts)), np.floor(share) - share))
    order = order[seen[order]]
    while left > 0:
        take = order[:left]
        out[take] += 1
        left -= len(take)
    return out.astype(np.uint32)


class Table:
    """Shared by all blocks."""

    def __init__(self, freq: np.ndarray):
        self.freq32 = freq.astype("<u4")
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(self.freq) - self.freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.limit = (np.uint64(1 << (63 - SCALE)) * self.freq).astype(np.uint64)

    def to_bytes(self) -> bytes:
        body = self.freq32.tobytes()
        return struct.pack("<II", len(self.freq32), zlib.crc32(body)) + body

    @classmethod
    def from_bytes(cls, data: bytes) -> Table:
        n, crc = struct.unpack_from("<II", data)
        body = data[8 : 8 + 4 * n]
        if zlib.crc32(body) != crc:
            raise ValueError("frequency table is damaged")
        return cls(np.frombuffer(body, "<u4"))


def encode_block(symbols: np.ndarray, table: Table) -> bytes:
    n = len(symbols)
    lanes = max(1, min(LANES, n // 64))
    steps = -(-n // lanes)
    padded = np.full(steps * lanes, symbols[0], dtype=np.int64)
    padded[:n] = symbols
    grid = padded.reshape(steps, lanes)
    x = np.full(lanes, LOW, dtype=np.uint64)
    words, marks, n_words = [], [], 0
    low32, up = np.uint64(0xFFFFFFFF), np.uint64(32)
    for t in range(steps - 1, -1, -1):
        s = grid[t]
        f = table.freq[s]
        over = x >= table.limit[s]
        if over.any():
            # the decoder reads forward, so within a step the lanes are written backward
            words.append((x[over] & low32).astype("<u4")[::-1])
            n_words += len(words[-1])
            x[over] >>= up
        q = x // f
        x = (q << np.uint64(SCALE)) + (x - q * f) + table.start[s]
        if t % STEPS == 0:
            marks.append((n_words, x.astype("<u8").tobytes()))
    stream = (np.concatenate(words)[::-1] if words else np.empty(0, "<u4")).astype("<u4").tobytes()
    flat = symbols.astype("<u4")
    head = [struct.pack("<IIIII", n, lanes, steps, len(marks), n_words)]
    for k, (at, states) in enumerate(reversed(marks)):
        part = flat[k * STEPS * lanes : (k + 1) * STEPS * lanes]
        head.append(struct.pack("<II", n_words - at, zlib.crc32(part.tobytes())) + states)
    body = b"".join(head) + stream
    return body + struct.pack("<I", zlib.crc32(body))


def decode_segment(block: bytes, k: int, table: Table) -> np.ndarray:
    """Symbols of the k-th segment, from its checkpoint alone."""
    n, lanes, steps, marks, n_words = struct.unpack_from("<IIIII", block)
    each = 8 + 8 * lanes
    at, crc = struct.unpack_from("<II", block, 20 + k * each)
    x = np.frombuffer(block, "<u8", lanes, 20 + k * each + 8).astype(np.uint64)
    stream = np.frombuffer(block, "<u4", n_words, 20 + marks * each)
    here = min(STEPS, steps - k * STEPS)
    out = np.empty((here, lanes), dtype=np.uint32)
    mask, scale, up = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(32)
    for t in range(here):
        slot = x & mask
        s = table.symbol[slot.astype(np.int64)]
        out[t] = s
        x = table.freq[s] * (x >> scale) + slot - table.start[s]
        under = np.flatnonzero(x < LOW)
        if len(under):
            x[under] = (x[under] << up) | stream[at : at + len(under)].astype(np.uint64)
            at += len(under)
    flat = out.reshape(-1)[: max(0, n - k * STEPS * lanes)]
    if zlib.crc32(flat.astype("<u4").tobytes()) != crc:
        raise ValueError("segment is damaged")
    return flat


def decode_block(block: bytes, table: Table) -> np.ndarray:
    if zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
        raise ValueError("block is damaged")
    return np.concatenate([decode_segment(block, k, table) for k in range(struct.unpack_from("<I", block, 12)[0])])


class Writer:
    """Writes one file; ``add`` takes documents in order."""

    def __init__(self, out, table: Table, before: int):
        self.out, self.table, self.before = out, table, before
        self.held, self.n_held, self.at = [], 0, len(MAGIC)
        self.blocks, self.keys, self.counts = [], [], []
        out.write(MAGIC)

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.keys.append(key)
        self.counts.append(len(ids))
        while len(ids):
            part, ids = ids[: BLOCK - self.n_held], ids[BLOCK - self.n_held :]
            self.held.append(part)
            self.n_held += len(part)
            if self.n_held == BLOCK:
                self._flush()

    def _flush(self) -> None:
        if self.n_held:
            block = encode_block(np.concatenate(self.held), self.table)
            self.out.write(block)
            self.blocks.append((self.at, self.n_held))
            self.at += len(block)
            self.held, self.n_held = [], 0

    def close(self) -> int:
        self._flush()
        foot = struct.pack("<QII", self.before, len(self.blocks), len(self.keys)) + b"".join(struct.pack("<QQ", *b) for b in self.blocks)
        foot += np.asarray([k or 0 for k in self.keys], "<i8").tobytes() + np.asarray(self.counts, "<u8").tobytes() + bytes(k is None for k in self.keys)
        self.out.write(foot + struct.pack("<Q", len(foot)) + MAGIC)
        return self.at + len(foot) + 8 + len(MAGIC)


def read_documents(source, size: int, table: Table):
    """Yields (key, start, ids) for each document of a file. source: seekable, binary."""
    source.seek(size - 8 - len(MAGIC))
    tail = source.read(8 + len(MAGIC))
    if tail[8:] != MAGIC:
        raise ValueError("not a file of ids")
    n_foot = struct.unpack("<Q", tail[:8])[0]
    end = size - 8 - len(MAGIC) - n_foot
    source.seek(end)
    foot = source.read(n_foot)
    before, n_blocks, n_docs = struct.unpack_from("<QII", foot)
    blocks = [struct.unpack_from("<QQ", foot, 16 + 16 * k) for k in range(n_blocks)]
    at = 16 + 16 * n_blocks
    keys = np.frombuffer(foot, "<i8", n_docs, at)
    counts = np.frombuffer(foot, "<u8", n_docs, at + 8 * n_docs)
    missing = foot[at + 16 * n_docs : at + 17 * n_docs]
    ends = [b[0] for b in blocks[1:]] + [end]
    have, nxt = np.empty(0, np.uint32), 0
    start = before
    for key, count, none in zip(keys.tolist(), counts.tolist(), missing):
        parts, left = [], count
        while left:
            if not len(have):
                source.seek(blocks[nxt][0])
                have = decode_block(source.read(ends[nxt] - blocks[nxt][0]), table)
                nxt += 1
            parts.append(have[:left])
            left -= len(parts[-1])
            have = have[len(parts[-1]) :]
        yield None if none else key, start, parts[0] if len(parts) == 1 else np.concatenate([np.empty(0, np.uint32), *parts])
        start += count

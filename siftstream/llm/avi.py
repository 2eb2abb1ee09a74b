"""AVI motion-JPEG columns: frames of lossless JPEG, RIFF parsing by index, and shots by histogram differences.

Frames are ITU-T T.81 lossless images (SOF3) of 8-bit samples: predictor 1, one restart interval for each line, so that
lines are independent and all lines of many frames are coded and decoded at once in numpy. The nine difference categories
of 8-bit samples have Huffman codes of four bits.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import session, text_of

UNIT = 64
WIDTH, HEIGHT, RATE = 64, 64, 25
#: Payload bytes that are coded in one go.
SLICE = 1 << 20
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
CLIPS = "doc_id long, clip int, first_frame int, last_frame int, start_s double, end_s double, mean_level double"

#: Category (number of extra bits) of each difference from -255 to 255.
_CATEGORY = np.array([abs(d).bit_length() for d in range(-255, 256)], dtype=np.uint8)
#: The code word of each difference: four bits of category, then the extra bits.
_CODE = np.array([(abs(d).bit_length() << abs(d).bit_length()) | (d if d >= 0 else d + (1 << abs(d).bit_length()) - 1) for d in range(-255, 256)], dtype=np.uint16)


def encode_lines(lines: np.ndarray) -> list[bytes]:
    """Entropy-coded bytes of each line (uint8, n x WIDTH), with stuffed zeros, padded by ones."""
    n = len(lines)
    diff = np.empty(lines.shape, np.int16)
    diff[:, 0] = lines[:, 0].astype(np.int16) - 128
    diff[:, 1:] = lines[:, 1:].astype(np.int16) - lines[:, :-1]
    at = diff.astype(np.intp) + 255
    code, bits = _CODE[at], _CATEGORY[at] + np.uint8(4)
    ends = np.cumsum(bits, axis=1, dtype=np.int32)
    size = (ends[:, -1] + 7) // 8
    first = np.zeros(n, np.int64)
    np.cumsum(size[:-1], out=first[1:])
    total = int(first[-1] + size[-1])
    pos = (first[:, None] * 8 + ends - bits).ravel()
    # a word has at most 12 bits, so it lies in the three bytes from its first; words share bytes but no bits
    value = code.ravel().astype(np.int64) << (24 - (pos & 7) - bits.ravel())
    byte = pos >> 3
    raw = np.zeros(total + 2, np.int64)
    for k, shift in enumerate((16, 8, 0)):
        raw += np.bincount(byte + k, weights=(value >> shift) & 255, minlength=total + 2).astype(np.int64)[: total + 2]
    out = raw[:total].astype(np.uint8)
    out[first + size - 1] |= ((1 << (size * 8 - ends[:, -1])) - 1).astype(np.uint8)
    stuffed = np.flatnonzero(out == 0xFF)
    if len(stuffed):
        out = np.insert(out, stuffed + 1, 0)
        first = first + np.searchsorted(stuffed, first)
    data = out.tobytes()
    cuts = [*first.tolist(), len(data)]
    return [data[a:b] for a, b in zip(cuts, cuts[1:])]


def decode_lines(coded: list[bytes], width: int) -> np.ndarray:
    """Samples of lines, each a restart interval of its own."""
    n = len(coded)
    size = np.fromiter(map(len, coded), np.int64, n)
    data = np.frombuffer(b"".join(coded) + b"\0\0\0", np.uint8)
    first = np.cumsum(size) - size
    zeros = np.flatnonzero((data[:-1] == 0xFF) & (data[1:] == 0)) + 1
    if len(zeros):
        first = first - np.searchsorted(zeros, first)
        data = np.delete(data, zeros)
    words = (data[:-2].astype(np.uint32) << 16) | (data[1:-1].astype(np.uint32) << 8) | data[2:]
    pos, last = first * 8, np.full(n, 128, np.int32)
    out = np.empty((n, width), np.uint8)
    for k in range(width):
        window = (words[pos >> 3] >> (12 - (pos & 7)).astype(np.uint32)).astype(np.int32) & 0xFFF
        cat = window >> 8
        if cat.max(initial=0) > 8:
            raise ValueError("unknown category")
        extra = (window & 0xFF) >> (8 - cat)
        half = (1 << cat) >> 1
        last = last + np.where(extra < half, extra - (1 << cat) + 1, extra)
        out[:, k] = last & 0xFF
        pos = pos + 4 + cat
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def jpeg(lines: list[bytes], width: int = WIDTH) -> bytes:
    """A lossless JPEG image from coded lines."""
    head = b"\xff\xd8" + _segment(0xC3, struct.pack(">BHHB3B", 8, len(lines), width, 1, 1, 0x11, 0))
    head += _segment(0xC4, bytes([0, 0, 0, 0, 9, *[0] * 12]) + bytes(range(9)))
    head += _segment(0xDD, struct.pack(">H", width)) + _segment(0xDA, bytes([1, 1, 0, 1, 0, 0]))
    body = [lines[0]]
    for k, x in enumerate(lines[1:]):
        body.append(bytes([0xFF, 0xD0 + k % 8]))
        body.append(x)
    return head + b"".join(body) + b"\xff\xd9"


def jpeg_lines(image: bytes) -> tuple[int, list[bytes]]:
    """Width and coded lines of a lossless JPEG image with a restart interval for each line."""
    if image[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG image")
    at, width, height, interval = 2, 0, 0, 0
    while True:
        mark, marker, size = struct.unpack_from(">BBH", image, at)
        if mark != 0xFF:
            raise ValueError("marker expected")
        body = image[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC3:
            _, height, width = struct.unpack_from(">BHH", body)
        elif marker == 0xC4 and body[1:17] != bytes([0, 0, 0, 9, *[0] * 12]):
            raise ValueError("another code table")
        elif marker == 0xDD:
            (interval,) = struct.unpack(">H", body)
        elif marker == 0xDA:
            break
        elif 0xC0 <= marker <= 0xCF and marker != 0xC4:
            raise ValueError("not a lossless image")
    if interval != width:
        raise ValueError("lines are not restart intervals")
    end = image.rindex(b"\xff\xd9")
    data = np.frombuffer(image, np.uint8, end - at, at)
    marks = np.flatnonzero((data[:-1] == 0xFF) & (data[1:] >= 0xD0) & (data[1:] <= 0xD7)) if len(data) > 1 else []
    lines, start = [], at
    for m in marks:
        lines.append(image[start : at + int(m)])
        start = at + int(m) + 2
    lines.append(image[start:end])
    if len(lines) != height:
        raise ValueError("lines are missing")
    return width, lines


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def _list(kind: bytes, body: bytes) -> bytes:
    return _chunk(b"LIST", kind + body)


def avi(frames: list[bytes], width: int = WIDTH, height: int = HEIGHT, rate: int = RATE) -> bytes:
    """An AVI file of motion-JPEG frames with an index. A frame may be lower than the stream's height."""
    most = max(map(len, frames), default=0)
    main = struct.pack("<14I", 1_000_000 // rate, most * rate, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, rate, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width, height)
    form = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 256, 0)
    head = _list(b"hdrl", _chunk(b"avih", main) + _list(b"strl", _chunk(b"strh", stream) + _chunk(b"strf", form)))
    body, index, at = [], [], 4
    for f in frames:
        body.append(_chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(body[-1])
    rest = b"AVI " + head + _list(b"movi", b"".join(body)) + _chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(rest)) + rest


def parse_avi(data: bytes) -> tuple[float, list[bytes]]:
    """Frames a second, and the frames that the index names, in order."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    end, at = 8 + struct.unpack_from("<I", data, 4)[0], 12
    movi = index = None
    rate = 0.0
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"LIST" and data[at + 8 : at + 12] == b"hdrl":
            micros = struct.unpack_from("<I", data, at + 20)[0]
            rate = 1e6 / micros if micros else 0.0
        elif name == b"LIST" and data[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif name == b"idx1":
            index = [struct.unpack_from("<4sIII", data, p) for p in range(at + 8, at + 8 + size, 16)]
        at += 8 + size + size % 2
    if movi is None or index is None:
        raise ValueError("no index")
    frames = []
    for name, _, off, size in index:
        p = movi + off
        if data[p : p + 4] != name or struct.unpack_from("<I", data, p + 4)[0] != size:
            raise ValueError("index and chunks disagree")
        if name[2:] == b"dc":
            frames.append(data[p + 8 : p + 8 + size])
    return rate, frames


def padded(text: str) -> tuple[int, bytes]:
    """Length in UTF-8, and those bytes with zeros up to a positive multiple of UNIT."""
    raw = text.encode()
    return len(raw), raw + b"\0" * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def encode_media(payloads: list[bytes]) -> list[bytes]:
    """An AVI file for each payload, whose lines of 64 samples are the payload's units."""
    lines = encode_lines(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, WIDTH))
    out, at = [], 0
    for p in payloads:
        n = len(p) // WIDTH
        out.append(avi([jpeg(lines[k : min(k + HEIGHT, at + n)]) for k in range(at, at + n, HEIGHT)]))
        at += n
    return out


def decode_media(media: list[bytes]) -> list[tuple[float, list[np.ndarray]]]:
    """Rate and decoded frames (height x width samples) of each AVI file."""
    parsed, lines = [], []
    for m in media:
        rate, frames = parse_avi(m)
        counts = []
        for f in frames:
            width, got = jpeg_lines(f)
            if width != WIDTH:
                raise ValueError("another width")
            counts.append(len(got))
            lines += got
        parsed.append((rate, counts))
    samples, at, out = decode_lines(lines, WIDTH), 0, []
    for rate, counts in parsed:
        frames = []
        for n in counts:
            frames.append(samples[at : at + n])
            at += n
        out.append((rate, frames))
    return out


def shots(frames: list[np.ndarray], bins: int = 16, times: float = 2.5, least: float = 0.15, around: int = 6) -> list[tuple[int, int]]:
    """First and last frame of each shot.

    A cut lies where the difference of two successive frames' histograms (half the sum of absolute differences of shares) is
    at least ``least`` and ``times`` the mean of up to ``around`` differences on either side.
    """
    if len(frames) < 2:
        return [(0, len(frames) - 1)] if frames else []
    hist = np.stack([np.bincount(f.ravel() // (256 // bins), minlength=bins) / f.size for f in frames])
    diff = np.abs(np.diff(hist, axis=0)).sum(axis=1) / 2
    cuts = []
    for k, d in enumerate(diff):
        near = np.concatenate([diff[max(0, k - around) : k], diff[k + 1 : k + 1 + around]])
        if d >= least and (not len(near) or d >= times * near.mean()):
            cuts.append(k + 1)
    return [(a, b - 1) for a, b in zip([0, *cuts], [*cuts, len(frames)])]


def _slices(texts: list[str]):
    at, size = 0, 0
    for n, t in enumerate(texts):
        size += len(t) + UNIT
        if size >= SLICE:
            yield at, n + 1
            at, size = n + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _store(batches):
    import pyarrow as pa

    for batch in batches:
        texts = batch.column(1).to_pylist()
        for lo, hi in _slices(texts):
            sizes, payloads = zip(*map(padded, texts[lo:hi]))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(lo, hi - lo), "n_bytes": pa.array(sizes, pa.int64()), "media": pa.array(encode_media(list(payloads)), pa.binary())})


def _parts(batches, media: int):
    """Batches cut so that their media have about SLICE bytes, one file at least."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.binary_length(batch.column(media)).to_pylist()
        at = total = 0
        for n, size in enumerate(sizes):
            total += size
            if total >= SLICE:
                yield batch.slice(at, n + 1 - at)
                at, total = n + 1, 0
        if at < len(sizes):
            yield batch.slice(at)


def _features(batches):
    import pyarrow as pa

    for batch in _parts(batches, 2):
        media, rows = batch.column(2).to_pylist(), []
        for n, m, (rate, frames) in zip(batch.column(1).to_pylist(), media, decode_media(media)):
            payload = b"".join(f.tobytes() for f in frames)
            cut = shots(frames)
            levels = np.concatenate([f.ravel() for f in frames])
            feature = f"frames={len(frames)};rate={rate:g};shots={','.join(f'{a}-{b}' for a, b in cut)};mean={levels.mean():.4f};std={levels.std():.4f}"
            rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(m), hashlib.sha256(m).hexdigest(), feature))
        a = list(zip(*rows)) if rows else [[]] * 7
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, t) for x, t in zip(a, types)]], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def _clips(batches):
    import pyarrow as pa

    for batch in _parts(batches, 1):
        rows = []
        for key, (rate, frames) in zip(batch.column(0).to_pylist(), decode_media(batch.column(1).to_pylist())):
            for k, (a, b) in enumerate(shots(frames)):
                level = float(np.concatenate([f.ravel() for f in frames[a : b + 1]]).mean())
                rows.append((key, k, a, b, a / rate, (b + 1) / rate, level))
        if rows:
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=["doc_id", "clip", "first_frame", "last_frame", "start_s", "end_s", "mean_level"])


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media: an AVI column that holds each whole text losslessly. Null texts are empty, which gives one
    line of zeros. Rows are independent: null and repeated ids are kept; other columns are ignored. No shuffle."""
    session(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return docs.mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """A row per AVI file with digests of the payload read back and a feature of its shots."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_features, FEATURES)


def clips(media: DataFrame) -> DataFrame:
    """A row per shot of each AVI file, with its times in seconds."""
    return media.select("doc_id", "media").mapInArrow(_clips, CLIPS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet")))

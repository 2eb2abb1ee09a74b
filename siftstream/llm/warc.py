"""WARC archives as seekable Zstandard bundles.

A bundle is a series of independent Zstandard frames, each of some records, and a skippable frame with the seek table at its
end (the public seekable format: sizes of each frame, their number, magic 0x8F92EAB1). The index maps each record to its
bundle, frame and offset within the frame's content, so one record is read by decompressing one frame.
"""

from __future__ import annotations

import hashlib
import struct

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import session, text_of, work_path, written
from .files import new_name, opened

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
LEAST_REVISIT = 100
FRAME_BYTES = 1 << 20
INDEX = "page_id long, record_id string, record_type string, refers_to long, bundle string, frame int, at long, length long"
RECORD = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def record_id(page_id, digest: str, nth: int = 1) -> str:
    """Unique for each row: its page, payload, and which of the rows with both it is."""
    return f"urn:page:{'none' if page_id is None else page_id}:{digest[:16]}:{nth}"


def page_of(record: str) -> int | None:
    page = record.split(":")[2]
    return None if page == "none" else int(page)


def _safe(value: str) -> str:
    """A header value cannot hold line ends; all else is kept as it is."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record_bytes(page_id, url, kind: str, digest: str, refers_to, payload: bytes, nth: int = 1) -> bytes:
    """One WARC/1.1 record; a revisit has headers only."""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id(page_id, digest, nth)}>", f"WARC-Target-URI: {_safe(url or '')}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}"]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <{record_id(refers_to, digest)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + payload + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers (lower-case names), content and end of the record that begins at ``at``."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a record")
    head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    start = end + 4
    stop = start + int(head["content-length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("record is cut off")
    return head, data[start:stop], stop + 4


class BundleWriter:
    """Groups records into frames; knows where each began."""

    def __init__(self, out, level: int = 3):
        import zstandard

        self.out, self.zip = out, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.held, self.size, self.frames = [], 0, []

    def add(self, record: bytes) -> tuple[int, int]:
        """Frame and offset of the record."""
        where = len(self.frames), self.size
        self.held.append(record)
        self.size += len(record)
        if self.size >= FRAME_BYTES:
            self._flush()
        return where

    def _flush(self) -> None:
        if self.held:
            packed = self.zip.compress(b"".join(self.held))
            self.out.write(packed)
            self.frames.append((len(packed), self.size))
            self.held, self.size = [], 0

    def close(self) -> None:
        self._flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


class BundleReader:
    """Random access to the frames of a bundle by its seek table."""

    def __init__(self, source):
        import zstandard

        self.source, self.zip = source, zstandard.ZstdDecompressor()
        source.seek(0, 2)
        size = source.tell()
        source.seek(size - 9)
        n, _, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        source.seek(size - 9 - 8 * n)
        raw = source.read(8 * n)
        self.sizes = [struct.unpack_from("<II", raw, 8 * k) for k in range(n)]
        self.starts = [0]
        for packed, _ in self.sizes:
            self.starts.append(self.starts[-1] + packed)

    def frame(self, k: int) -> bytes:
        self.source.seek(self.starts[k])
        return self.zip.decompress(self.source.read(self.sizes[k][0]), max_output_size=self.sizes[k][1] or 1)

    def record(self, frame: int, at: int) -> tuple[dict[str, str], bytes]:
        return parse_record(self.frame(frame), at)[:2]


def _write(batches, folder: str, bytes_per_bundle: int):
    import pyarrow as pa
    from pyspark import TaskContext

    out, writer, size = None, None, 0
    for batch in batches:
        rows = []
        for page, url, html, digest, first, nth in zip(*[c.to_pylist() for c in batch.columns]):
            if writer is None:
                name, size = new_name(folder, f"bundle-{TaskContext.get().partitionId():06d}", ".warc.zst"), 0
                out = opened(name, "wb")
                writer = BundleWriter(out)
            kind = "response" if first is None else "revisit"
            data = record_bytes(page, url, kind, digest, first, html.encode(), nth)
            frame, at = writer.add(data)
            rows.append((page, record_id(page, digest, nth), kind, first, name, frame, at, len(data)))
            size += len(data)
            if size >= bytes_per_bundle:
                writer.close()
                out.close()
                writer = None
        if rows:
            types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=["page_id", "record_id", "record_type", "refers_to", "bundle", "frame", "at", "length"])
    if writer is not None:
        writer.close()
        out.close()


def _referring(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest of each row, the page that it refers to (null for responses), and which of the rows with its
    id and payload it is."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_of("html").alias("html"))
    pages = pages.withColumn("digest", F.sha2("html", 256))
    known = written(pages.select("page_id", "digest", F.octet_length("html").alias("n")), "payloads")
    firsts = known.where(f"n >= {LEAST_REVISIT}").groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1 AND first IS NOT NULL")
    # an id that may be null in two columns that are not, by which join and window divide the rows alike: one shuffle serves both
    keys = ["_id", "_none", "digest"]
    keyed = lambda df: df.withColumn("_id", F.coalesce("page_id", F.lit(0))).withColumn("_none", F.col("page_id").isNull())
    copies = keyed(known.join(firsts, "digest")).select(*keys, "first").distinct()
    # of rows with one id and one payload, a single one may be the response
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("url"))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")) | (nth > 1), F.col("first"))
    return keyed(pages).join(copies, keys, "left").select("page_id", "url", "html", "digest", refers.alias("refers_to"), nth.alias("nth"))


def write_archive(pages: DataFrame, folder: str | None = None, bytes_per_bundle: int = 32_000_000) -> DataFrame:
    """Writes a record per page and returns the index (INDEX), a written table. Line ends in a URL are stored as %0D and %0A.

    Of pages with equal payloads of at least 100 bytes, the one with the smallest page_id is the response and the others are
    revisits of it; of rows that share page_id and payload too, one is the response. Smaller payloads are all responses.
    Null html is an empty payload, a null url empty. Rows without an id are revisits if a row with one has their payload, and
    else all responses. Other columns are ignored.

    Plan: a narrow aggregate (digest: smallest id and count, combined before its shuffle) names what repeats; the payloads
    are shuffled once, by page and digest, so copies spread evenly; join and window share that shuffle. Bundles are named anew by each attempt; only
    those in the written index count.
    """
    spark = session(pages.sparkSession)
    folder = folder or work_path(spark, "warc")
    rows = _referring(pages)
    rows = rows.sortWithinPartitions(F.col("page_id").asc_nulls_last())
    return written(rows.mapInArrow(lambda b: _write(b, folder, bytes_per_bundle), INDEX), "warc-index")


def _read(batches, with_payload: bool):
    import pyarrow as pa

    reader = source = name = None
    frame_no, frame = -1, b""
    for batch in batches:
        rows = []
        for bundle, k, at in zip(*[c.to_pylist() for c in batch.columns]):
            if bundle != name:
                if source is not None:
                    source.close()
                source, name, frame_no = opened(bundle), bundle, -1
                reader = BundleReader(source)
            if k != frame_no:
                frame, frame_no = reader.frame(k), k
            head, payload, _ = parse_record(frame, at)
            page, kind = page_of(head["warc-record-id"].strip("<>")), head["warc-type"]
            digest = head["warc-payload-digest"].removeprefix("sha256:")
            if kind == "response":
                if hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"{bundle}: payload of {page} is damaged")
                rows.append((page, kind, None, len(payload), digest, payload if with_payload else None))
            else:
                rows.append((page, kind, page_of(head["warc-refers-to"].strip("<>")), None, digest, None))
            if with_payload and len(rows) >= 256:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)
    if source is not None:
        source.close()


def _batch(rows: list):
    import pyarrow as pa

    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])


def read_archive(index: DataFrame, with_payload: bool = False) -> DataFrame:
    """Reads the records that an index names; any subset of an index will do. payload is null unless asked for, and for
    revisits; payload_bytes is null for revisits, whose records hold headers only."""
    where = index.select("bundle", "frame", "at")
    n = max(1, index.select("bundle").distinct().count())
    spread = where.repartition(n, "bundle", "frame").sortWithinPartitions("bundle", "frame", "at")
    return spread.mapInArrow(lambda b: _read(b, with_payload), RECORD)


def resolved(records: DataFrame) -> DataFrame:
    """A row per record with the size of its full payload: revisits take it from the responses that they refer to."""
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    records = written(records.select(*cols), "warc-records")
    revisits, responses = records.where("record_type = 'revisit'"), records.where("record_type = 'response'")
    # by digest: ids need not be unique; at most one response of each digest is referred to
    sizes = responses.where(f"payload_bytes >= {LEAST_REVISIT}").groupBy("payload_digest").agg(F.max("payload_bytes").alias("size"))
    found = revisits.join(sizes, "payload_digest", "left").select("page_id", F.col("size").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    return responses.select(*cols).unionByName(found.select(*cols))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved(read_archive(write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))))


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""

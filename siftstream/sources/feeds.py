"""A Spark data source for RSS and Atom feeds: one partition a source, failures as rows.

    spark.dataSource.register(FeedSource)
    spark.read.format("feeds").option("urls", "file:///a.xml\nhttps://b/rss").load()
    spark.readStream.format("feeds").option("urls", ...).load()
"""

from __future__ import annotations

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions.retries import Refused, with_retries

ENTRY = "source string, title string, link string, guid string, contentSnippet string, summary string, content string, pubDate string, isoDate string, updated string, error string"


class FeedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feeds"

    def schema(self) -> str:
        return ENTRY

    def reader(self, schema):
        return FeedReader(self.options)

    def streamReader(self, schema):
        return FeedStreamReader(self.options)


class _Feeds:
    def __init__(self, options):
        self.urls = [u.strip() for u in options.get("urls", "").split("\n") if u.strip()]
        self.timeout = float(options.get("timeout", "10"))
        self.delays = tuple(float(x) for x in options.get("delays", "2,4,8").split(",") if x)

    def read(self, partition):
        if partition is None or partition.value is None:
            return
        url = partition.value
        try:
            yield from ((url, *row, None) for row in parse_feed(with_retries(lambda: fetch(url, self.timeout), self.delays)))
        except Exception as e:  # noqa: BLE001 - any failure of a source is a row of its own
            yield (url, *[None] * 9, f"{type(e).__name__}: {e}"[:500])


class FeedReader(_Feeds, DataSourceReader):
    def partitions(self):
        return [InputPartition(u) for u in self.urls]


class FeedStreamReader(_Feeds, DataSourceStreamReader):
    """Feeds as they change: the offset is what each source last said of its version, and a batch reads the sources whose
    version is another by now, each in a task of its own. A source that cannot be asked is read, so that its failure is a row,
    once until it can be asked again. Entries that a feed repeats are for ``dedup.admitted`` to refuse."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {u: version(u, self.timeout) for u in self.urls}

    def partitions(self, start: dict, end: dict):
        return [InputPartition(u) for u in sorted(end) if end[u] != start.get(u)]


def fetch(url: str, timeout: float = 10) -> bytes:
    """The bytes at a URL. Statuses other than success are ``Refused``, which ``with_retries`` knows."""
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    try:
        with urlopen(Request(url, headers={"User-Agent": "siftstream"}), timeout=timeout) as answer:
            return answer.read()
    except HTTPError as e:
        raise Refused(e.code, e.reason) from e


def version(url: str, timeout: float = 10) -> str:
    """What a source says of its version without sending it: its tag, or time and size; 'unknown' if it cannot be asked, and
    the time of asking if it says nothing."""
    import time
    from urllib.request import Request, urlopen

    try:
        with urlopen(Request(url, headers={"User-Agent": "siftstream"}, method="HEAD"), timeout=timeout) as answer:
            said = [answer.headers.get(h) or "" for h in ("ETag", "Last-Modified", "Content-Length")]
    except Exception:  # noqa: BLE001 - the read that follows tells why
        return "unknown"
    return "|".join(said) if said[0] or said[1] else str(time.time_ns())


def parse_feed(data: bytes) -> list[tuple]:
    """Entries of an RSS or Atom document, in the order of ENTRY's middle columns."""
    import re
    import xml.etree.ElementTree as ET
    from email.utils import parsedate_to_datetime

    root, out = ET.fromstring(data), []
    plain = lambda tag: tag.rsplit("}", 1)[-1].lower()
    for entry in root.iter():
        if plain(entry.tag) not in ("item", "entry"):
            continue
        got: dict[str, str] = {}
        for child in entry:
            name, text = plain(child.tag), ("".join(child.itertext()) or "").strip()
            if name == "link" and not text and child.get("rel", "alternate") == "alternate":
                text = child.get("href", "")
            got.setdefault(name, text)
        content = got.get("encoded") or got.get("content") or got.get("description")
        day = got.get("pubdate") or got.get("published")
        try:
            iso = parsedate_to_datetime(day).isoformat() if day else None
        except (TypeError, ValueError):
            iso = day
        snippet = re.sub(r"<[^>]*>", " ", content).strip() if content else None
        out.append((got.get("title"), got.get("link") or None, got.get("guid") or got.get("id"), snippet, got.get("summary"), content, day, iso, got.get("updated")))
    return out

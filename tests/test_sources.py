import json

import pytest
from pyspark.sql import functions as F

from siftstream.sources import payloads as P
from siftstream.sources.feeds import FeedSource, parse_feed

NOW = F.lit("2024-05-02 12:00:00").cast("timestamp")


def body(spark, obj):
    return spark.createDataFrame([(obj if isinstance(obj, str) else json.dumps(obj),)], "body string")


def test_vulnerabilities(spark):
    rows = [{"cveID": "CVE-2024-1", "vendorProject": "V", "product": "P", "dateAdded": "2024-05-01", "shortDescription": "bad", "requiredAction": "patch"}, {"cveID": "CVE-2024-2", "dateAdded": "2024-01-01"}, {"cveID": "", "dateAdded": "2024-05-01"}]
    got = P.exploited_vulnerabilities(body(spark, {"vulnerabilities": rows}), NOW).collect()
    assert [(r.title, r.summary) for r in got] == [("CISA adds V P vulnerability to KEV catalog", "bad Required action: patch")]
    assert got[0].url.endswith("=CVE-2024-1")


def test_vulnerabilities_page(spark):
    page = "<p>CVE-2024-11111 Some <b>bug</b> Date Added: 2024-05-01 Related CWE: CWE-1</p><p>CVE-2024-22222 No date</p>"
    got = P.exploited_vulnerabilities_page(body(spark, page), NOW).collect()
    assert [(r.title, r.summary) for r in got] == [("CISA adds CVE-2024-11111 vulnerability to KEV catalog", "Some bug Date Added: 2024-05-01")]


def test_earthquakes(spark):
    f = [{"properties": {"title": "M 6", "mag": 6.1, "place": "X", "url": "https://u/1", "time": 1714600000000}}, {"properties": {"title": "no url"}}]
    got = P.earthquakes(body(spark, {"features": f}), NOW).collect()
    assert [(r.title, r.summary, r.url) for r in got] == [("M 6", "Magnitude 6.1 earthquake near X.", "https://u/1")]


def test_alerts(spark):
    f = [{"id": "f1", "properties": {"event": "Flood", "areaDesc": "County", "severity": "Severe", "description": "water"}}, {"id": "f2", "properties": {"headline": "h", "severity": "Minor"}}]
    assert [(r.title, r.url) for r in P.weather_alerts(body(spark, {"features": f}), NOW).collect()] == [("Flood - County", "f1")]


def test_recalls(spark):
    rows = [{"event_id": "1", "report_date": "20240430", "classification": "Class I", "product_description": "x" * 200, "recalling_firm": "F"}, {"event_id": "2", "report_date": "20240430", "classification": "Class III"}]
    got = P.recalls(body(spark, {"results": rows}), NOW, "device").collect()
    assert len(got) == 1 and got[0].title.startswith("FDA medical device recall: xxx") and got[0].title.endswith("…") and got[0].summary == "Class I Firm: F"
    with pytest.raises(ValueError):
        P.recalls(body(spark, {}), NOW, "toy")


def test_malformed_payloads_give_no_rows(spark):
    assert P.earthquakes(body(spark, "<html>"), NOW).count() == 0
    with pytest.raises(ValueError):
        P.adapter("adapter://nobody/knows")
    assert P.adapter("adapter://usgs/significant-quakes?x=1") is P.earthquakes


def entries(spark, *rows):
    return spark.createDataFrame([{"title": t, "link": u, "summary": s} for t, u, s in rows], P.ENTRY)


def test_entries(spark):
    e = entries(spark, ("A filing", "/a", "Item 1.01 x"), ("Another", "/b", "Item 2.02"), ("", "/c", "Item 8.01"))
    assert [r.url for r in P.filings(e, NOW).collect()] == ["https://www.sec.gov/a"]
    m = entries(spark, ("Fed cuts - Reuters", "https://x/1", ""), ("Fed cuts - Reuters", "https://x/1", ""), ("Rumour - Blog", "https://x/2", ""))
    assert [(r.title, r.url) for r in P.market_news(m, NOW, "https://x/").collect()] == [("Fed cuts", "https://x/1")]


RSS = """<rss><channel><item><title>T &amp; U</title><link>https://x/1</link><description>&lt;b&gt;s&lt;/b&gt;</description><pubDate>Wed, 01 May 2024 10:00:00 GMT</pubDate></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A</title><link rel="alternate" href="https://x/2"/><id>i</id><updated>2024-05-01T00:00:00Z</updated><summary>s</summary></entry></feed>"""


def test_feed_source(spark, tmp_path):
    (tmp_path / "a.xml").write_text(RSS)
    (tmp_path / "b.xml").write_text(ATOM)
    spark.dataSource.register(FeedSource)
    urls = "\n".join(f"file://{tmp_path}/{n}" for n in ("a.xml", "b.xml", "missing.xml"))
    got = {r.source.rsplit("/", 1)[-1]: r for r in spark.read.format("feeds").option("urls", urls).load().collect()}
    assert got["a.xml"].title == "T & U" and got["a.xml"].link == "https://x/1" and got["a.xml"].isoDate == "2024-05-01T10:00:00+00:00"
    assert got["b.xml"].link == "https://x/2" and got["b.xml"].guid == "i" and got["b.xml"].error is None
    assert "Error" in got["missing.xml"].error
    assert len(parse_feed(RSS.encode())) == 1


def test_ingest_joins_sources_once(spark):
    """A branch of the plan for each connector in use, however many sources; relative links resolve against their own source."""
    import json

    from siftstream.sources import payloads as P

    n = 60
    sources = spark.createDataFrame([(i, f"https://s{i}.test/a/feed" if i % 3 else "adapter://usgs/significant-quakes/", int(i % 10 > 0), f"n{i}", "c", 5) for i in range(n)] + [(n, "adapter://no/such?x", 1, "odd", "c", 5)], "source_id long, url string, is_active int, name string, category string, weight int")
    quake = json.dumps({"features": [{"properties": {"title": "M 5", "url": "https://q.test/1", "time": 5}}]})
    feed = json.dumps([{"title": "Story", "link": "../x"}])
    landed = spark.createDataFrame([(i, feed if i % 3 else quake, "timed out" if i == 7 else None) for i in range(n)] + [(n, "[]", None), (999, feed, None)], "source_id long, body string, error string")
    items, errors = P.ingest(sources, landed, F.lit("2024-05-02 12:00:00").cast("timestamp"))
    got = {(r.source_id, r.url, r.source_name) for r in items.collect()}
    assert got == {(i, f"https://s{i}.test/x" if i % 3 else "https://q.test/1", f"n{i}") for i in range(n) if i % 10 and i != 7}
    assert sorted(map(tuple, errors.collect())) == [(7, "timed out"), (n, "unknown adapter: adapter://no/such?x")]
    assert items._jdf.queryExecution().optimizedPlan().toString().count("Union") == 1 and items._jdf.queryExecution().optimizedPlan().toString().count("Generate") <= 3
    none, _ = P.ingest(sources.limit(0), landed, F.lit(None).cast("timestamp"))
    assert none.count() == 0

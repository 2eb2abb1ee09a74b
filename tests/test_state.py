"""Streams over several batches: state that expires, feeds that change, a sink that delivers once."""

import random

import pytest
from pyspark.sql import functions as F

from siftstream.operators import clustering as K
from siftstream.operators import dedup as D
from siftstream.sources.feeds import FeedSource
from siftstream.streaming import clusters as SC
from siftstream.streaming import kept as KS
from siftstream.streaming import outbox as O
from siftstream.streaming import streams as T

HOUR = 3_600_000


def batches(spark, df, where, parts):
    """df as a stream of so many files in time order."""
    rows = sorted(df.collect(), key=lambda r: (r.ms, r.id))
    size = -(-len(rows) // parts)
    for n in range(parts):
        spark.createDataFrame(rows[n * size : (n + 1) * size], df.schema).coalesce(1).write.parquet(f"{where}/{n}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(where))


def test_kept_stream_equals_batch_over_restarts(spark, tmp_path):
    rng = random.Random(8)
    rows = [(rng.choice("abcd"), rng.randrange(1, 200) * HOUR, i) for i in range(150)] + [("silent", HOUR, 900), ("silent", 190 * HOUR, 901)]
    df = spark.createDataFrame(rows, "k string, ms long, id long")
    want = {tuple(r) for r in D.window_dedup(df, ["k"], "ms", "id", 24 * HOUR).collect()}
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        src = batches(spark, df, tmp_path / "in", 4)
        first = src.where(F.col("ms") >= 0)
        T.written_stream(KS.kept_stream(first, 24 * HOUR), f"{tmp_path}/out", f"{tmp_path}/cp")
        # a later start goes on from the state in the checkpoint
        more = spark.createDataFrame([("a", 201 * HOUR, 1000), ("a", 202 * HOUR, 1001), ("new", 203 * HOUR, 1002)], df.schema)
        more.coalesce(1).write.parquet(f"{tmp_path}/in/9")
        T.written_stream(KS.kept_stream(first, 24 * HOUR), f"{tmp_path}/out", f"{tmp_path}/cp")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)
    want = {tuple(r) for r in D.window_dedup(df.unionByName(more), ["k"], "ms", "id", 24 * HOUR).collect()}
    got = [tuple(r) for r in spark.read.schema("k string, ms long, id long").parquet(f"{tmp_path}/out").collect()]
    assert set(got) == want and len(got) == len(want)


def test_cluster_stream_forgets_silent_categories(spark, tmp_path):
    rows = [(1, "x", 1000, ["a", "b"]), (2, "x", HOUR, ["a", "b"]), (3, "y", 9 * HOUR, ["a", "b"]), (4, "y", 10 * HOUR, ["a", "b"]), (5, "y", 30 * HOUR, ["a", "b"]), (6, "z", 31 * HOUR, ["a", "b"])]
    df = spark.createDataFrame(rows, "id long, category string, ms long, keywords array<string>")
    src = batches(spark, df, tmp_path / "in", 3)
    q = SC.cluster_stream(src).writeStream.format("memory").queryName("leaders").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.id: r.leader for r in spark.table("leaders").collect()} == {r.id: r.leader for r in K.greedy_clusters(df).collect()}
    assert sum(p["stateOperators"][0]["numRowsRemoved"] for p in q.recentProgress if p["stateOperators"]) >= 1


FEED = "<rss><channel>{}</channel></rss>"
ITEM = "<item><title>{0}</title><link>https://a.test/{0}</link></item>"


def test_feeds_as_a_stream(spark, tmp_path):
    """Only sources that changed are read again; a missing one is a row with its error."""
    spark.dataSource.register(FeedSource)
    a, b, gone = tmp_path / "a.xml", tmp_path / "b.xml", tmp_path / "gone.xml"
    a.write_text(FEED.format(ITEM.format("one")))
    b.write_text(FEED.format(ITEM.format("two") + ITEM.format("three")))
    urls = "\n".join(f"file://{x}" for x in (a, b, gone))
    src = spark.readStream.format("feeds").option("urls", urls).option("delays", "").load()

    def run():
        T.written_stream(src.select("source", "title", "error"), f"{tmp_path}/out", f"{tmp_path}/cp")
        rows = spark.read.schema("source string, title string, error string").parquet(f"{tmp_path}/out").collect()
        return sorted(r.title for r in rows if r.title), sum(r.error is not None for r in rows)

    assert run() == (["one", "three", "two"], 1)
    assert run() == (["one", "three", "two"], 1)
    a.write_text(FEED.format(ITEM.format("one") + ITEM.format("four, which is longer")))
    assert run() == (["four, which is longer", "one", "one", "three", "two"], 1)


def test_refusals_are_told_and_retried(tmp_path):
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from threading import Thread

    from pyspark.sql.datasource import InputPartition

    from siftstream.sources.feeds import FeedReader, version

    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_HEAD(self):
            self.send_response(200)
            self.send_header("ETag", '"v1"')
            self.end_headers()

        def do_GET(self):
            seen.append(self.path)
            fail = self.path == "/busy" and seen.count("/busy") < 3 or self.path == "/no"
            self.send_response((503 if self.path == "/busy" else 404) if fail else 200)
            self.end_headers()
            self.wfile.write(b"" if fail else FEED.format(ITEM.format("late")).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    reader = FeedReader({"urls": f"{base}/busy\n{base}/no", "delays": "0,0,0"})
    busy, no = [list(reader.read(InputPartition(u))) for u in reader.urls]
    assert busy[0][1] == "late" and seen.count("/busy") == 3
    assert no[0][1] is None and "404" in no[0][-1] and seen.count("/no") == 1
    assert version(f"{base}/busy") == '"v1"||'
    server.shutdown()


def test_outbox_delivers_once(spark, tmp_path):
    spark.dataSource.register(O.Outbox)
    schema = "id long, ms long, text string"
    df = spark.createDataFrame([(i, i * 10, f"t{i}") for i in range(30)], schema)
    src = batches(spark, df, tmp_path / "in", 3)
    marker = tmp_path / "mended"

    @F.udf("string")
    def fragile(text):
        import os

        if text == "t17" and not os.path.exists(str(marker)):
            raise ValueError("half way")
        return text

    def start():
        out = src.select("id", "ms", fragile("text").alias("text"))
        return out.writeStream.format("outbox").option("cursor", "ms").option("checkpointLocation", f"{tmp_path}/cp").option("path", f"{tmp_path}/box").trigger(availableNow=True).start()

    with pytest.raises(Exception, match="half way"):
        start().awaitTermination()
    box = f"{tmp_path}/box"
    assert sorted(r.id for r in O.delivered_rows(spark, box, schema).collect()) == list(range(10)) and O.cursor(box) == 90
    marker.touch()
    start().awaitTermination()
    assert sorted(r.id for r in O.delivered_rows(spark, box, schema).collect()) == list(range(30)) and O.cursor(box) == 290
    start().awaitTermination()
    assert [c["rows"] for c in O.commits(box)] == [10, 10, 10] and O.delivered_rows(spark, box, schema, after=1).count() == 10
    # a commit that comes again changes nothing
    writer = O.OutboxWriter({"path": box, "cursor": "ms"}, df.schema)
    writer.commit([O.Staged("staged/other.json", 5, 999)], 2)
    assert O.cursor(box) == 290 and O.delivered_rows(spark, f"{tmp_path}/none", schema).count() == 0


def test_an_expired_key_sends_no_frame():
    """Each frame is a batch of its own between the worker and the JVM."""
    cleared = []
    kept = KS.Kept(1)
    kept.last = type("Last", (), {"clear": lambda self: cleared.append(1)})()
    assert list(kept.handleExpiredTimer(("k",), None, None)) == [] and cleared == [1]

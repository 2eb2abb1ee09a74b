import hashlib
import io

import pytest
from pyspark.sql import functions as F

from siftstream.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, n int"
LONG = "x" * 120


def pages(spark, *rows):
    return spark.createDataFrame([(i, u, h, "clash", 1) for i, u, h in rows], SCHEMA)


def archive(df):
    return {(r.page_id, r.payload_digest): r for r in warc.resolved(warc.read_archive(warc.write_archive(df))).collect()}


def test_revisits_and_edge_cases(spark):
    df = pages(spark, (3, "u", LONG), (1, "u", LONG), (2, None, LONG), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (None, "u", LONG), (8, "a\r\nb", "é" * 60))
    got = {r.page_id: r for r in warc.resolved(warc.read_archive(warc.write_archive(df))).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {
        1: ("response", None), 2: ("revisit", 1), 3: ("revisit", 1), None: ("revisit", 1), 4: ("response", None), 5: ("response", None), 6: ("response", None), 7: ("response", None), 8: ("response", None)}
    assert got[2].payload_bytes == 120 and got[6].payload_bytes == 0 and got[8].payload_bytes == 120
    assert got[3].payload_digest == hashlib.sha256(LONG.encode()).hexdigest()


def test_repeated_rows_have_one_response(spark):
    rows = warc.resolved(warc.read_archive(warc.write_archive(pages(spark, (1, "u", LONG), (1, "u", LONG), (1, "u", "y" * 200))))).collect()
    assert sorted(r.record_type for r in rows) == ["response", "response", "revisit"]


def test_urls_and_record_ids(spark):
    urls = ["https://x.test/a%20b?c=%25&d=1+2", "https://x.test/é", "u", "u", "u", ""]
    index = warc.write_archive(pages(spark, *[(i % 3 if i else None, u, LONG if i % 2 else "s") for i, u in enumerate(urls)], (-(1 << 63), "least", LONG)))
    seen, ids = [], []
    for r in index.collect():
        with warc.opened(r.bundle) as source:
            head, _ = warc.BundleReader(source).record(r.frame, r.at)
        seen.append(head["warc-target-uri"])
        ids.append(head["warc-record-id"])
        assert head["warc-record-id"] == f"<{r.record_id}>"
    assert sorted(seen) == sorted([*urls, "least"]) and len(set(ids)) == len(ids)
    assert {r.refers_to for r in index.collect()} == {None, -(1 << 63)}


def test_empty_table(spark):
    assert archive(pages(spark).limit(0)) == {}


def test_bundle_random_access():
    out = io.BytesIO()
    w = warc.BundleWriter(out)
    big = b"z" * (warc.FRAME_BYTES // 3)
    where = [w.add(warc.record_bytes(i, "u", "response", "d", None, big + str(i).encode())) for i in range(10)]
    w.close()
    reader = warc.BundleReader(out)
    assert len(reader.sizes) > 2
    for i in (9, 0, 4):
        head, payload = reader.record(*where[i])
        assert payload == big + str(i).encode() and warc.page_of(head["warc-record-id"].strip("<>")) == i
    with pytest.raises(ValueError):
        warc.BundleReader(io.BytesIO(b"0123456789abcdef"))


def test_bundles_roll_over_and_index_subset(spark):
    df = pages(spark, *[(i, "u", f"{i}" * 300) for i in range(20)])
    index = warc.write_archive(df, bytes_per_bundle=2000)
    assert index.select("bundle").distinct().count() > 4
    got = warc.read_archive(index.where("page_id in (3, 17)"), with_payload=True).collect()
    assert {r.page_id: bytes(r.payload).decode() for r in got} == {3: "3" * 300, 17: "17" * 300}


def test_query_equals_sql(spark, duck, sf_dir):
    a = warc.query(spark, sf_dir).orderBy("page_id").toPandas()
    b = duck.sql(warc.ORACLE + " ORDER BY page_id").df()[list(a.columns)]
    assert a.astype(str).replace({"None": "nan", "<NA>": "nan"}).equals(b.astype(str).replace({"None": "nan", "<NA>": "nan"}))


def exchanges(plan, column: str) -> int:
    """Shuffles of a plan that carry a column."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        return exchanges(plan.executedPlan(), column)
    names = [plan.output().apply(k).name() for k in range(plan.output().size())]
    below = sum(exchanges(plan.children().apply(k), column) for k in range(plan.children().size()))
    return below + (plan.nodeName() == "Exchange" and column in names)


def test_payloads_are_shuffled_once(spark):
    """Also where what repeats is too much to broadcast."""
    least = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(least)
    spark.conf.set(least, "-1")
    try:
        rows = warc._referring(pages(spark, (1, "u", LONG), (2, "u", LONG), (None, "u", LONG)))
        assert exchanges(rows._jdf.queryExecution().executedPlan(), "html") == 1
        assert {r.page_id: r.refers_to for r in rows.collect()} == {1: None, 2: 1, None: 1}
    finally:
        spark.conf.set(least, before)


def test_names():
    assert F is not None and warc.page_of(warc.record_id(None, "d")) is None and warc.page_of(warc.record_id(-5, "d")) == -5

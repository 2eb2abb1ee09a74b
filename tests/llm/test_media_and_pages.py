import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from siftstream.llm import avi, pages

SCHEMA = "doc_id long, text string, media string"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=300), min_size=1, max_size=5))
def test_media_round_trip(raw):
    payloads = [r + b"\0" * (max(1, -(-len(r) // 64)) * 64 - len(r)) for r in raw]
    media = avi.encode_media(payloads)
    for p, (rate, frames) in zip(payloads, avi.decode_media(media)):
        assert rate == 25 and b"".join(f.tobytes() for f in frames) == p


def test_extreme_samples_and_long_payloads():
    p = bytes([0, 255] * 32 + [255] * 64) * 500
    (media,) = avi.encode_media([p])
    ((_, frames),) = avi.decode_media([media])
    assert len(frames) == -(-len(p) // 4096) and b"".join(f.tobytes() for f in frames) == p
    assert media[:4] == b"RIFF" and b"MJPG" in media[:300] and b"idx1" in media


def test_damaged_media():
    (media,) = avi.encode_media([b"\0" * 64])
    with pytest.raises(ValueError):
        avi.parse_avi(b"JUNK" + media[4:])
    with pytest.raises(ValueError):
        avi.parse_avi(media.replace(b"00dc", b"01wb", 1))


def test_shots():
    dark, light = np.zeros((8, 64), np.uint8), np.full((8, 64), 200, np.uint8)
    assert avi.shots([dark] * 5 + [light] * 4 + [dark] * 3) == [(0, 4), (5, 8), (9, 11)]
    assert avi.shots([dark]) == [(0, 0)] and avi.shots([]) == [] and avi.shots([dark] * 4) == [(0, 3)]


def test_media_columns(spark):
    df = spark.createDataFrame([(1, None, "c"), (2, "", "c"), (3, "é" * 40, "c"), (3, "é" * 40, "c"), (None, "x" * 9000, "c")], SCHEMA)
    media = avi.store_texts(df)
    got = {(r.doc_id, r.n_bytes): r for r in avi.features(media).collect()}
    raw = ("é" * 40).encode() + b"\0" * 48
    r = got[3, 80]
    assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (128, hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))
    assert got[1, 0].media_sha256 == got[2, 0].media_sha256 and got[1, 0].payload_bytes == 64 and got[None, 9000].payload_bytes == 9024
    assert avi.clips(media).where("doc_id = 3").count() == 2
    assert avi.features(avi.store_texts(df.limit(0))).count() == 0


ARTICLE = "<article><h1>T &amp; U</h1><p><b>One\n two<br>three<p>Four<script>x()</script></p><div class='ad-box'>buy</div><div class='comments'>me</div></article>"


@pytest.mark.parametrize("page, want", [
    ("", ""), (ARTICLE, "T & U\nOne two three\nFour"), (f"<nav>menu</nav>{ARTICLE}<footer>f</footer>", "T & U\nOne two three\nFour"),
    ("<body><header>h</header><p>plain</p><aside>side</aside><form>in</form></body>", "plain"), ("<main><p>a</main><p>b", "a"), ("just text &lt;3", "just text <3"),
    ("<p>a<!-- <p>no</p> -->b</p>", "ab"), ("<p title='>'>x</p><p hidden>y</p><div role='navigation'>z</div>", "x"), ("<p>cut off &am", "cut off &am"), ("<div id=cookie-notice>c</div><p>ok", "ok"), ("</p></div><p>x", "x"),
    ("<ul><li>a<li>b</ul>", "a\nb"), ("<style>p{}</style><p>é&nbsp;é", "é é"), ("<p>a<b>b</b>c", "abc"), ("<" * 50 + "p>x", "<" * 49 + "\nx"),
    ("<body class='has-sidebar cookie-on'><main class='no-ads'><div class='post-header'><h1>T</h1></div><p>x</p><div class='share-box'>s</div></main></body>", "T\nx"),
    ("<div class='site-header'>h</div><article><header><h1>T</h1></header><p class='adagio information'>x</p></article>", "T\nx"),
    ("<div class='content has-sidebar'><h1>T</h1><p>Article text here.</p></div>", "T\nArticle text here."), ("<div class='long-form'><p>Article text.</p></div>", "Article text."),
    ("<article><p>a</p><section class='notice-period'><p>b</p></section></article>", "a\nb"), ("<div class='story'><p>Main story.</p></div><article><p>teaser</p></article>", "Main story.\nteaser"),
    ("<p title=it's>x</p><p>y</p>", "x\ny"), ("<div class=comments><p>all of the text</p></div><p>x", "all of the text\nx"), ("<p a = 'b>c' d=\"e>f\" g>x<p =h>y<p \"i>z", "x\ny\nz"),
])
def test_extract(page, want):
    assert pages.extract(page) == want


def test_deep_pages_do_not_recurse():
    assert pages.extract("<div>" * 20_000 + "x") == "x"


def test_large_pages_take_time_in_proportion():
    import time

    began = time.time()
    assert pages.extract("<div><b>" * 30_000 + "</p>" * 30_000 + "x").startswith("x")
    assert pages.extract("<p>a</i></div>" * 60_000).count("a") == 60_000 and pages.extract("<p " + "a" * 500_000) == "" and time.time() - began < 30


def plain_templates(rows):
    """host -> hashes, counted naively."""
    hosts = {}
    for url, page in {(pages.host_of(u), h or "") for _, u, h, _ in rows}:
        hosts.setdefault(url, []).append({(~h if strict else h, strict) for _, h, strict in pages.candidates(pages.parse(page))})
    out = {}
    for host, found in hosts.items():
        times = {}
        for page in found:
            for x in page:
                times[x] = times.get(x, 0) + 1
        out[host] = {h for (h, strict), n in times.items() if n >= pages.LEAST_PAGES and n >= (pages.INSIDE_SHARE if strict else pages.LEAST_SHARE) * len(found)}
    return {k: v for k, v in out.items() if v}


def test_templates_equal_plain_counts(spark):
    menu = "<ul><li><a href=/a>A</a><li>B</ul>"
    rows = [(i, f"https://a.com/{i}", f"<div>{menu}</div><div><p>story {i}</p><p>shared {i % 3}</p><p>always</p><div>box {i % 9}</div></div><nav>n {i % 2}</nav>", "c") for i in range(100)]
    # copies of one page are one page; a share of exactly 5 % and of 50 % is enough
    rows += [(200 + i, "https://b.com/x", f"<div>copy</div><p>only</p>{menu}", "c") for i in range(50)] + [(None, "https://a.com/z", rows[0][2], "c")] * 2
    rows += [(400 + i, f"https://d.com/{i}", f"<div>{'half' if i < 10 else i}</div><p>{'half' if i % 2 else i}</p>own {i}", "c") for i in range(20)]
    rows += [(500 + i, f"https://e.com/{i}", f"<div>{'twentieth' if i < 10 else i}</div><p>{i}</p>", "c") for i in range(200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, hashes string")
    got = {r.host: set(r.hashes) for r in pages.templates(df.select("page_id", "url", "html")).collect()}
    assert got == plain_templates(rows) and set(got) == {"a.com", "d.com", "e.com"}
    text = {r.page_id: r.text for r in pages.extract_pages(df).collect()}
    assert text[7] == "story 7\nshared 1" and text[201] == "copy\nonly\nA\nB" and text[401] == "own 1" and text[503] == "3" and text[400] == "0\nown 0"


def test_articles_as_divs_keep_their_text(spark, sf_dir):
    """The article tag is a help only: other tags around the text give the same."""
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html").collect()
    plain = {r.page_id: pages.extract(r.html or "") for r in rows}
    assert all(pages.extract((r.html or "").replace("article>", "div>")) == plain[r.page_id] for r in rows)


def test_templates_per_host(spark):
    box = "<div><b>Follow us</b> everywhere</div>"
    page = lambda i, extra="": f"<body>{box}<p>story {i}</p>{extra}</body>"
    rows = [(i, f"https://A.com/{i}", page(i), "c") for i in range(30)] + [(100 + i, f"https://b.com/{i}", page(i), "c") for i in range(3)]
    rows += [(200, None, None, "c"), (201, "https://a.com/x", "<article><p>story</p></article>", "c")]
    # paragraphs that recur inside articles stay, boxes on most pages go
    rows += [(300 + i, f"https://c.com/{i}", f"<article><p>same</p><p>own {i}</p><div>share</div></article>", "c") for i in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, hashes string")
    got = {r.page_id: r.text for r in pages.extract_pages(df).collect()}
    assert got[3] == "story 3" and got[101] == "Follow us everywhere\nstory 1" and got[200] == "" and got[201] == "story" and got[302] == "same\nown 2"
    assert pages.extract_pages(df.limit(0)).count() == 0


def test_templates_joined_when_too_many_to_broadcast(spark, monkeypatch):
    rows = [(i, f"https://a.com/{i}", f"<body><div>box</div><p>story {i}</p></body>") for i in range(20)] + [(50, None, "<p>x</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {r.page_id: r.text for r in pages.extract_pages(df).collect()}
    monkeypatch.setattr(pages, "fits", lambda *a: False)
    assert {r.page_id: r.text for r in pages.extract_pages(df).collect()} == want and want[4] == "story 4" and want[50] == "x"

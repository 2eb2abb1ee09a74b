"""Main text of web pages: removal of site templates, helped by structure rules.

A page is parsed into a tree, and each element has a hash of its whole subtree, menus and footers included. Spark counts on
how many different pages of a host each hash occurs, and a subtree that recurs on many pages of its host is deleted as
template. Headings and paragraphs, and boxes (lists, tables, sections) inside an article, have to stand on most pages of the
host; headings and paragraphs inside an article always stay: articles that share a passage keep it. What differs from page
to page is told by structure: tags and roles that are never article text, and classes that say so, unless such an element
holds most of the page's text.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import fits, session, small, text_of, written

#: A subtree is template if it occurs on so many pages of its host, and on such a share of them.
LEAST_PAGES, LEAST_SHARE = 10, 0.05
#: For boxes inside an article.
INSIDE_SHARE = 0.5

# Names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp plaintext".split())
NEVER = frozenset("head nav footer aside form button select option dialog menu svg math object canvas audio video map".split()) | RAW
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
CLOSES_P = BLOCK - frozenset("td th tr tbody thead tfoot caption html body".split())
BOXES = frozenset("details dir div dl fieldset figure menu ol section table ul".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert alertdialog dialog toolbar".split())
# Words that mark what is not article text, if a class or id is made of them and of words for places alone.
MARKS = frozenset("""
ad ads advert adverts advertisement adsense adslot banner sponsor sponsored promo promotion promoted
nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc
header masthead topbar footer colophon sidebar rail widget related recommended
cookie cookies consent gdpr notice notices notification alert popup modal overlay paywall subscribe subscription newsletter signup login
comment comments reply replies disqus respond share sharing social
form search searchbox
""".split())

PLACES = frozenset("""
area bar block bottom box button center container content entry head inner item items left list main outer page panel post
right row section site slot text top unit widget wrap wrapper
""".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
#: How an element is dropped: by class (unless it has most of the text), by tag or role, or as no text at all.
BY_CLASS, BY_TAG, NO_TEXT = 1, 2, 3
#: Share of a page's text that its articles must have to be its content.
CONTENT_SHARE = 0.4
HEADS = frozenset(("header", "masthead"))
#: Elements whose classes speak of the page's layout.
FRAMES = frozenset("html body main article".split())

_token = re.compile(r"<!--.*?(?:-->|$)|<![^>]*(?:>|$)|<\?[^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?>\s+|/|[^\s>/=]+(?:\s*=\s*(?:\"[^\"]*(?:\"|$)|'[^']*(?:'|$)|[^\s>\"'][^\s>]*)?)?|=)*+)(?:>|$)", re.S)
_mark = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)))?""", re.I)
_words = re.compile(r"[a-z]+|\d+")
_space = re.compile(r"\s+")


class Node:
    __slots__ = ("attrs", "children", "drop", "name")

    def __init__(self, name: str, attrs: str = "", drop: int = 0):
        self.name, self.attrs, self.drop, self.children = name, attrs, drop, []


def _marked(attrs: str, inside: bool) -> int:
    """Whether and how attributes mark an element as something other than article text. inside: within an article, whose
    header holds its title."""
    for m in _mark.finditer(attrs):
        key = m[1].lower()
        value = (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value in ROLES:
            return BY_TAG
        if key in ("class", "id"):
            for part in value.split():
                words = frozenset(_words.findall(part))
                found = words & MARKS
                if found and words <= MARKS | PLACES and not (inside and found <= HEADS):
                    return BY_CLASS
    return 0


def parse(page: str) -> Node:
    """The tree of a page; ends that miss or cross are mended as browsers mostly do. Depth is unbounded, so no recursion."""
    root = Node("#root")
    stack, at, n = [root], 0, len(page)
    # how many elements of each name are open
    is_open: Counter = Counter()

    def close(k: int) -> None:
        for x in stack[k:]:
            is_open[x.name] -= 1
        del stack[k:]

    while at < n:
        m = _token.search(page, at)
        if m is None:
            stack[-1].children.append(page[at:])
            break
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if not is_open[name]:
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    close(k)
                    break
                if name not in BLOCK and stack[k].name in BLOCK:
                    break
            continue
        attrs = m[3] or ""
        if name in CLOSES_P and is_open["p"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == "p":
                    close(k)
                    break
                if stack[k].name in BLOCK:
                    break
        elif name in ("li", "dt", "dd", "option", "tr", "td", "th"):
            if stack[-1].name == name:
                close(len(stack) - 1)
        # an article's own header holds its title
        odd = NO_TEXT if name in RAW else BY_TAG if name in NEVER else 0
        if not odd and (name == "header" or attrs and name not in FRAMES):
            inside = is_open["article"] + is_open["main"] > 0
            odd = BY_TAG if name == "header" and not inside else _marked(attrs, inside) if attrs else 0
        node = Node(name, attrs, odd)
        stack[-1].children.append(node)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*/?>", re.I).search(page, at)
            at = end.end() if end else n
        elif name not in VOID and not attrs.endswith("/"):
            stack.append(node)
            is_open[name] += 1
    return root


def masses(root: Node) -> dict[int, int]:
    """Characters of text, white space apart, in each element, those that are dropped by tag left out."""
    out: dict[int, int] = {}
    todo = [(root, False)]
    while todo:
        node, ready = todo.pop()
        if node.drop >= BY_TAG:
            out[id(node)] = 0
        elif ready:
            out[id(node)] = sum(len("".join(c.split())) if isinstance(c, str) else out[id(c)] for c in node.children)
        else:
            todo.append((node, True))
            todo += [(c, False) for c in node.children if isinstance(c, Node)]
    return out


def spare_most(root: Node) -> None:
    """Elements that are dropped by class stay if they have most of the page's text, in paragraphs."""
    size, todo = masses(root), [root]

    def has_paragraph(node: Node) -> bool:
        inner = [node]
        while inner:
            x = inner.pop()
            if x.name in PARAGRAPHS:
                return True
            inner += [c for c in x.children if isinstance(c, Node)]
        return False

    while todo:
        node = todo.pop()
        if node.drop == BY_CLASS and 2 * size[id(node)] > size[id(root)] and has_paragraph(node):
            node.drop = 0
        if not node.drop:
            todo += [c for c in node.children if isinstance(c, Node)]


def content(root: Node, weigh: bool = True) -> list[Node]:
    """The topmost article elements, else main, else the whole page; weigh: only if they have enough of its text."""
    size = masses(root) if weigh else {}
    for wanted in ("article", "main"):
        found, todo = [], [root]
        while todo:
            node = todo.pop()
            if node.drop:
                continue
            if node.name == wanted:
                found.append(node)
                continue
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]
        if found and (not weigh or sum(size[id(f)] for f in found) >= CONTENT_SHARE * size[id(root)]):
            return found
    return [root]


def _hash(data: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data) - (1 << 63)


def subtrees(root: Node) -> list[tuple[Node, int]]:
    """Every element that could yield text with the hash of its subtree, children before parents."""
    out, todo, done = [], [(root, False)], {}
    while todo:
        node, ready = todo.pop()
        if node.drop == NO_TEXT:
            done[id(node)] = 0
            continue
        if not ready:
            todo.append((node, True))
            todo += [(c, False) for c in node.children if isinstance(c, Node)]
            continue
        parts = [node.name]
        for c in node.children:
            parts.append(_space.sub(" ", c).strip() if isinstance(c, str) else f"<{done[id(c)]}>")
        done[id(node)] = _hash("\0".join(parts))
        if node is not root:
            out.append((node, done[id(node)]))
    return out


def blocks(tops: list[Node]) -> list[str]:
    """Texts of blocks in page order: character references decoded, white space one space, trimmed, none empty."""
    out: list[str] = []
    line: list[str] = []

    def flush():
        text = _space.sub(" ", entities.unescape("".join(line))).strip()
        if text:
            out.append(text)
        line.clear()

    for top in tops:
        todo: list = [top]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                line.append(x)
            elif x is None:
                flush()
            elif x.drop:
                continue
            elif x.name == "br":
                line.append(" ")
            elif x.name in BLOCK:
                flush()
                todo.append(None)
                todo += reversed(x.children)
            else:
                todo += reversed(x.children)
        flush()
    return out


def candidates(root: Node) -> list[tuple[Node, int, bool]]:
    """Elements that may be template, with the hashes of their subtrees and whether they have to stand on most pages: those
    inside an article, and headings and paragraphs."""
    tops = content(root, weigh=False)
    if tops == [root]:
        return [(n, h, n.name in PARAGRAPHS) for n, h in subtrees(root)]
    inside, todo = set(), list(tops)
    while todo:
        kids = [c for c in todo.pop().children if isinstance(c, Node)]
        inside.update(map(id, kids))
        todo += kids
    names = {id(t) for t in tops}
    return [(n, h, id(n) in inside or n.name in PARAGRAPHS) for n, h in subtrees(root) if id(n) not in names and (n.name in BOXES or id(n) not in inside)]


def extract(page: str, template: frozenset | set = frozenset()) -> str:
    """The main text of a page; template: hashes of subtrees to drop, one's complement for those that most pages have."""
    root = parse(page)
    if template:
        for node, h, inside in candidates(root):
            if (~h if inside else h) in template and node.name not in ("html", "body"):
                node.drop = BY_TAG
    spare_most(root)
    return "\n".join(blocks(content(root)))


def host_of(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", url or "")
    return m[1].lower() if m else ""


def _hashes(batches):
    import pyarrow as pa

    for batch in batches:
        rows = []
        for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            host = host_of(url)
            rows.append((host, None, False))
            rows += [(host, ~h if inside else h, inside) for h, inside in {(h, inside) for _, h, inside in candidates(parse(page))}]
        hosts, found, inside = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_pydict({"host": pa.array(hosts, pa.string()), "hash": pa.array(found, pa.int64()), "inside": pa.array(inside, pa.bool_())})


def _host():
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def templates(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """host, hashes: the subtrees that recur on at least least_pages different pages and least_share of those of their host.

    Of pages with equal html one counts (the smallest page_id's). The share bounds the hashes of a host by (elements of a
    page) / least_share. A written table.
    """
    pages = pages.withColumn("_d", F.xxhash64("html")).withColumn("_h", _host())
    narrow = pages.select("page_id", "_h", "_d")
    several = narrow.groupBy("_h", "_d").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = written(narrow.join(several, ["_h", "_d"]).where("NOT (page_id <=> _first)").select(F.col("page_id").alias("_p"), F.col("_h").alias("_ch"), F.col("_d").alias("_cd")).distinct(), "page-copies")
    copies = small(copies)
    pages = pages.join(copies, pages["page_id"].eqNullSafe(F.col("_p")) & (F.col("_h") == F.col("_ch")) & (F.col("_d") == F.col("_cd")), "left_anti")
    pairs = pages.select("url", "html").mapInArrow(_hashes, "host string, hash long, inside boolean")
    counts = written(pairs.groupBy("host", "hash", "inside").agg(F.count(F.lit(1)).alias("pages")), "subtrees")
    sizes = counts.where("hash IS NULL").select("host", F.col("pages").alias("of"))
    often = counts.where(f"hash IS NOT NULL AND pages >= {int(least_pages)}").join(sizes, "host")
    often = often.where(F.col("pages") >= F.when(F.col("inside"), F.lit(INSIDE_SHARE)).otherwise(F.lit(least_share)) * F.col("of"))
    return written(often.groupBy("host").agg(F.collect_list("hash").alias("hashes")), "templates")


def _extract(batches, known: dict | None):
    import pyarrow as pa

    for batch in batches:
        cols = [c.to_pylist() for c in batch.columns]
        out = []
        for k, (url, page) in enumerate(zip(cols[1], cols[2])):
            template = known.get(host_of(url), ()) if known is not None else cols[3][k] or ()
            out.append(extract(page, frozenset(template)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """page_id, url, text (empty if none) and n_chars of the main text of every page.

    Null html is an empty page; a null or odd url belongs to the host ''. Repeated rows and ids are kept; other columns are
    ignored; an empty table gives none.

    Plan: pages are read twice and parsed where they are read. Between lies one aggregate of (host, subtree hash), combined
    before its shuffle, so a host with a third of all pages is no burden. The templates are broadcast if they are few
    (checked on the written table); else pages are joined with them by host.
    """
    session(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_of("html").alias("html"))
    found = templates(pages, least_pages, least_share)
    out = "page_id long, url string, text string, n_chars long"
    if fits(found.select(F.explode("hashes"))):
        known = {r.host: frozenset(r.hashes) for r in found.collect()}
        return pages.mapInArrow(lambda b: _extract(b, known), out)
    joined = pages.join(found.withColumnRenamed("host", "_host"), _host() == F.col("_host"), "left").select("page_id", "url", "html", "hashes")
    return joined.mapInArrow(lambda b: _extract(b, None), out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))

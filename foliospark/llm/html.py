"""Main text of web pages, with site template removal.

Subtrees of elements are hashed, whatever their names, their distinct pages are counted per host in
Spark, and subtrees that recur on so many pages of a host, however large it is, are deleted before the
text is taken. Only what contains no marked article and is no prose in one (paragraphs, headings, list
items: sites repeat lines in articles too) can be template. Copies of one page count as one page, also
if they differ only in parts that go in any case, so that a mirrored article is no template.

Counts cannot tell what is on few pages of its host: menus of small sites, adverts and notices that
change, forms, reader comments. Of what the counts leave, elements that are boilerplate by their name
or by a word of their class, id or role go too (prose in an article only if a whole class is such a
word), and where a page marks its article, only that is taken.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, small_batches, stage, table

#: A subtree is template if it is on so many distinct pages of its host.
LEAST_PAGES = 4
# Names from the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|textarea|title|noscript|iframe|noembed|noframes|xmp|template"
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
GONE = frozenset(
    "nav header footer aside form script style textarea title noscript iframe noembed noframes xmp template head button select dialog svg math canvas object audio video menu".split()
)
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th tr dd dt b i em strong a span code q cite figcaption".split())
#: Words of class, id and role names that mark boilerplate.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay"
    " nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead comment comments commentlist disqus reply replies respond share sharing social"
    " related recommended newsletter subscribe subscription signup login search pagination pager widget toolbar complementary contentinfo".split()
)
#: Elements that mark an article, the first of them first.
TOPS = ("article", "main")
CLOSES = {"p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()), "li": frozenset(["li"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"])}
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)", re.S | re.I
)
_MARK = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_HIDDEN = re.compile(r"""\bhidden(?:[\s=]|\Z)|\bdisplay\s*:\s*none|\baria-hidden\s*=\s*["']?true""", re.I)


class Node:
    __slots__ = ("kids", "out", "tag")

    def __init__(self, tag: str, out: bool):
        self.tag, self.out, self.kids = tag, out, []


def _boilerplate(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in GONE:
        return True
    if tag in ("html", "body", "article", "main") or not attributes.strip():
        return False
    if _HIDDEN.search(attributes):
        return True
    if in_article and tag in PROSE:  # a paragraph of class promotion-history may well be of the article
        return any(w in MARKS for m in _MARK.findall(attributes) for w in m.strip("\"'").lower().split())
    return any(w in MARKS for m in _MARK.findall(attributes) for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", m).lower()))


def parse(source: str) -> Node:
    """A tree of elements and strings, character references decoded within each; comments, scripts and
    other raw elements are left out."""
    root = Node("", False)
    stack, at = [root], 0
    opened: Counter[str] = Counter()  # by tag, so that an end tag without a start costs nothing at any depth
    for m in _TOKEN.finditer(source):
        if m.start() > at:
            stack[-1].kids.append(html.unescape(source[at : m.start()]))
        at = m.end()
        tag = m[3]
        if tag is None:
            if m[1]:
                stack[-1].kids.append(Node("hr", True))
            continue
        tag = tag.lower()
        if m[2]:
            if opened[tag]:
                while (last := stack.pop().tag) != tag:
                    opened[last] -= 1
                opened[tag] -= 1
            continue
        while len(stack) > 1 and tag in CLOSES.get(stack[-1].tag, ()):
            opened[stack.pop().tag] -= 1
        node = Node(tag, _boilerplate(tag, m[4], opened["article"] > 0 or opened["main"] > 0))
        stack[-1].kids.append(node)
        if tag not in VOID and not m[4].endswith("/"):
            stack.append(node)
            opened[tag] += 1
    if at < len(source):
        stack[-1].kids.append(html.unescape(source[at:]))
    return root


def _walk(root: Node) -> list[tuple[Node, bool, bool]]:
    """Nodes, parents first, each with whether it is in a marked article and whether it goes by its name or marks."""
    found, todo = [], [(root, False, False)]
    while todo:
        node, inside, out = todo.pop()
        inside, out = inside or node.tag in TOPS, out or node.out
        found.append((node, inside, out))
        todo += [(k, inside, out) for k in node.kids if isinstance(k, Node)]
    return found


def subtrees(root: Node) -> tuple[int, dict[int, list[int]]]:
    """The hash of what is kept of the page, and by hash of the subtree the ids of the nodes that may be template."""
    own: dict[int, int] = {}
    articles: set[int] = set()  # nodes that are or hold an article
    found: dict[int, list[int]] = {}
    page = xxhash.xxh3_64()
    for node, inside, out in reversed(_walk(root)):
        h, any_text = xxhash.xxh3_64(node.tag.encode()), False
        if not out:
            page.update(f"<{node.tag}".encode())
        if node.tag in TOPS and not out:
            articles.add(id(node))
        for k in node.kids:
            if isinstance(k, Node):
                if id(k) in own:
                    h.update(own[id(k)].to_bytes(8, "little"))
                    any_text = True
                if id(k) in articles:
                    articles.add(id(node))
            elif words := k.split():
                text = " ".join(words).encode(errors="replace")
                h.update(text)
                any_text = True
                if not out:
                    page.update(b">" + text)
        if any_text:
            own[id(node)] = h.intdigest()
            if node.tag not in ("", "html", "body") and id(node) not in articles and not (node.tag in PROSE and (inside or out)):
                found.setdefault(h.intdigest() - 2**63, []).append(id(node))
    return page.intdigest() - 2**63, found


def text_of(root: Node, template: frozenset[int] | set[int] = frozenset(), marks: bool = True) -> str:
    """Text of the page's article if it marks one, else of the page; without marks, of all that is no template."""
    dropped = {i for h, ids in subtrees(root)[1].items() if h in template for i in ids} if template else set()
    tops: list[Node] = []
    if marks:
        walked = _walk(root)
        for tag in TOPS:
            if tops := [n for n, _, out in walked if n.tag == tag and not out]:
                break
    parts: list[str] = []

    def take(start: Node) -> None:
        todo: list = [start]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                parts.append(x)
                continue
            if x.out and marks or id(x) in dropped or id(x) in seen:
                if x.tag in BLOCKS:
                    parts.append(" ")
                continue
            seen.add(id(x))
            block = x.tag in BLOCKS
            if block:
                parts.append(" ")
                todo.append(" ")
            todo += reversed(x.kids)

    seen: set[int] = set()
    for top in _in_order(root, set(map(id, tops))) if tops else [root]:
        take(top)
    return " ".join("".join(parts).split())


def _in_order(root: Node, wanted: set[int]) -> Iterator[Node]:
    """The wanted nodes in page order, none inside another or in a part that goes."""
    todo: list[Node] = [root]
    while todo:
        x = todo.pop()
        if x.out:
            continue
        if id(x) in wanted:
            yield x
            continue
        todo += [k for k in reversed(x.kids) if isinstance(k, Node)]


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def templates(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """(host, source, template): for each html of a host, by its hash, the hashes of its subtrees that
    recur. Pairs of host and subtree are joined to the pages as narrow rows, so no row grows with the
    number of templates of a host."""
    small_batches(spark)

    def hash_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [subtrees(parse(source or "")) for source in batch.column(2).to_pylist()]
            own, trees = pa.array([page for page, _ in found], pa.int64()), pa.array([list(by) for _, by in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), own, trees], ["host", "source", "page", "trees"])

    seen = pages.select(host_of(F.col("url")).alias("host"), F.xxhash64("html").alias("source"), "html").mapInArrow(hash_, "host string, source long, page long, trees array<long>")
    seen = stage(spark, seen, "subtrees").withColumn("tree", F.explode("trees"))
    counts = seen.select("host", "page", "tree").distinct().groupBy("host", "tree").agg(F.count("*").alias("n"))
    many = stage(spark, counts.where(F.col("n") >= LEAST_PAGES).select("host", "tree"), "recurring")
    found = seen.select("host", "source", "tree").join(broadcast_if_small(many, many.count()), ["host", "tree"])
    return stage(spark, found.groupBy("host", "source").agg(F.collect_set("tree").alias("template")), "templates")


def main_text(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row per row of pages(page_id, url, html).

    A null or empty html gives an empty text; a null url is a host by itself; ids and urls may repeat
    or be null; other columns are ignored; an empty table gives an empty one.
    """
    by_page = templates(spark, pages)
    size = by_page.agg(F.sum(F.size("template"))).first()[0] or 0
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"), F.xxhash64("html").alias("source"))
    rows = rows.join(broadcast_if_small(by_page, size), ["host", "source"], "left").select("page_id", "url", "html", "template")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text_of(parse(s or ""), set(t or ())) for s, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(extract, f"page_id {kind}, url string, text string, n_chars long")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark, table(spark, sf_dir, "pages"))

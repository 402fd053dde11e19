"""Main text of web pages by a site style tree.

The pages of one host are merged into one tree of element paths.  A node counts on how many distinct pages it stands, in which
presentations (the kinds of its children) and with which contents.  From the entropies of both comes its importance: a node that
looks and reads alike on all pages has none, one that differs from page to page has full importance.  A content that fills a
node on very many of the host's pages has little importance of its own.  Branches of low importance are removed from each page,
as are elements whose kind, role or class name says that they are no part of an article.  Inside an article or main element
repetition alone removes nothing: copies of an article on one host are still articles.  The text that is left is returned block by block.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timberflow.llm.common import materialize

# Element kinds and the words of class, id and role names.
BLOCKS = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style template noscript textarea title iframe noframes noembed xmp svg object".split()
DROPPED = set("nav aside footer form menu dialog select button head audio video canvas map applet label".split())
NOISE_WORDS = set("nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent notice notices alert newsletter subscribe subscription share sharing social related recommended recommendations comment comments disqus respond replies popup modal overlay pagination pager toolbar widget masthead login signup search".split())
NOISE_ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form note".split())
CONTAINERS = {"article", "main"}
SELF_CLOSING = {"svg", "math"}
ENDS_P = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "dd", "dt", "option", "optgroup", "summary"}
SAME_LEVEL = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BARRIERS = {"ul", "ol", "dl", "table", "select", "menu"}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?!svg\b[^>]*/>)(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])[^>]*+>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attributes>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>"
    r"|<[!?][^>]*+>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
WORDS = re.compile(r"[a-z0-9]+")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


@dataclass
class Node:
    tag: str
    label: str
    path: str
    noise: bool
    content: bool  # inside an article or main element
    children: list[Node | str] = field(default_factory=list)


def _noisy(tag: str, attributes: dict[str, str], in_content: bool) -> bool:
    if tag in DROPPED or (tag == "header" and not in_content) or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    if "display:none" in attributes.get("style", "").replace(" ", "").lower() or attributes.get("role", "").lower() in NOISE_ROLES:
        return True
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    if not names.strip() or tag in ("html", "body"):
        return False
    return not NOISE_WORDS.isdisjoint(WORDS.findall(CAMEL.sub(" ", names).lower()))


def parse(page: str) -> Node:
    """Element tree of a page, forgiving: unclosed elements end with their parent, stray end tags are passed over."""
    root = Node("#", "#", "", False, False)
    stack, at = [root], 0

    def close(upto: int) -> None:
        del stack[max(upto, 1) :]

    for token in TOKEN.finditer(page):
        if token.start() > at:
            stack[-1].children.append(page[at : token.start()])
        at, tag = token.end(), (token["tag"] or "").lower()
        if not tag:
            continue
        if token["end"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close(k)
                    break
            continue
        if tag == "br":
            stack[-1].children.append("\n")
        if tag in ENDS_P or tag in SAME_LEVEL:
            for k in range(len(stack) - 1, 0, -1):
                own = stack[k].tag
                if (own == "p" and tag in ENDS_P) or own in SAME_LEVEL.get(tag, ()):
                    close(k)
                    break
                if own in BARRIERS or (own in BLOCKS and own != "p" and tag not in SAME_LEVEL):
                    break
        attributes = {}
        if token["attributes"]:
            for name, value in ATTRIBUTE.findall(token["attributes"]):
                attributes.setdefault(name.lower(), value.strip("\"'"))
        parent = stack[-1]
        label = ".".join([tag, *sorted(attributes.get("class", "").split())[:4]])
        inside = parent.content or tag in CONTAINERS
        node = Node(tag, label, f"{parent.path}/{label}" if len(parent.path) < 2000 else parent.path, _noisy(tag, attributes, inside), inside)
        parent.children.append(node)
        if tag not in VOID and not (tag in SELF_CLOSING and token["attributes"].endswith("/")):
            stack.append(node)
    if at < len(page):
        stack[-1].children.append(page[at:])
    return root


def _mark(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def text_blocks(root: Node, removed: set[tuple[int, int]] = frozenset(), everything: bool = False) -> list[tuple[Node, str]]:
    """(block element, text) in page order, without noise and without the removed (path, content) marks; content 0 is any.

    Where the page has article or main elements, only what stands in one counts, unless ``everything`` is asked for.
    """
    out: list[tuple[Node, str]] = []
    buffer: list[str] = []

    def flush(owner: Node) -> None:
        text = " ".join(entities.unescape("".join(buffer)).split())
        buffer.clear()
        if text:
            out.append((owner, text))

    work: list[tuple[Node, Iterator, Node]] = [(root, iter(root.children), root)]
    while work:
        node, rest, owner = work[-1]
        child = next(rest, None)
        if child is None:
            work.pop()
            if node is owner:
                flush(owner)
        elif isinstance(child, str):
            buffer.append(child)
        elif not child.noise:
            if child.tag in BLOCKS:
                flush(owner)
                if child.content or not removed or (_mark(child.path), 0) not in removed:
                    work.append((child, iter(child.children), child))
            else:
                work.append((child, iter(child.children), owner))
        elif child.tag in BLOCKS:
            flush(owner)
    if not everything and any(owner.content for owner, _ in out):
        out = [(owner, text) for owner, text in out if owner.content]
    if removed:
        out = [(o, t) for o, t in out if o.content or (_mark(o.path), _mark(t)) not in removed]
    return out


def extract(page: str | None, removed: set[tuple[int, int]] = frozenset()) -> str:
    return "\n".join(text for _, text in text_blocks(parse(page), removed)) if page else ""


def _nodes(page: str | None) -> tuple[int, list[dict[str, int]]]:
    """The page's mark, and its block nodes outside noise and containers, containers included: path, presentation and content marks.

    A node's content is all text below it, so a branch counts as changing where anything in it does.
    """
    root = parse(page or "")
    blocks, own, work = text_blocks(root, everything=True), {}, [root]
    for owner, text in blocks:
        own[id(owner)] = own.get(id(owner), 0) * 31 + _mark(text)
    order: list[tuple[Node, Node | None]] = []
    while work:
        node = work.pop()
        for child in node.children:
            if isinstance(child, Node) and not child.noise:
                order.append((child, node))
                work.append(child)
    for child, parent in reversed(order):  # children before their parents
        if id(child) in own:
            own[id(parent)] = own.get(id(parent), 0) * 31 + own[id(child)] & 0xFFFFFFFFFFFFFFFF
    nodes = []
    for node, parent in order:
        if node.tag in BLOCKS and not parent.content:
            kinds = [c.label for c in node.children if isinstance(c, Node) and c.tag in BLOCKS]
            content = _mark(str(own[id(node)])) if id(node) in own else 0
            nodes.append({"path": _mark(node.path), "style": _mark(" ".join(dict.fromkeys(kinds))), "content": content})
    return _mark("\n".join(t for _, t in blocks)), nodes


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _merged(page: Column) -> Column:
    @F.pandas_udf("page long, nodes array<struct<path: long, style: long, content: long>>")
    def merged(pages: pd.Series) -> pd.DataFrame:
        found = [_nodes(p) for p in pages]
        return pd.DataFrame({"page": [m for m, _ in found], "nodes": [n for _, n in found]})

    return merged(page)


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, path, pages, importance) of every node of every host's merged tree; ``pages`` has url and html.

    Pages with the same text on one host count once.  Importance is the larger of the entropies of presentation and content,
    each relative to its most for that number of pages; a node of one page has importance 1.
    """
    return _importance(_counted(pages))


def _counted(pages: DataFrame) -> DataFrame:
    merged = pages.select(host_of(F.col("url")).alias("host"), _merged(F.col("html")).alias("m"))
    distinct = merged.groupBy("host", "m.page").agg(F.min("m.nodes").alias("nodes"))
    nodes = distinct.select("host", "page", F.explode(F.array_distinct("nodes")).alias("n")).select("host", "page", "n.*")
    return nodes.groupBy("host", "path", "style", "content").agg(F.count("*").alias("n"))


def _importance(counts: DataFrame) -> DataFrame:
    def entropy(of: str) -> DataFrame:
        each = counts.groupBy("host", "path", of).agg(F.sum("n").alias("n"))
        total = each.groupBy("host", "path").agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("s"))
        share = F.when(F.col("pages") > 1, 1 - F.col("s") / (F.col("pages") * F.log("pages"))).otherwise(F.lit(1.0))
        return total.select("host", "path", "pages", share.alias(of))

    both = entropy("style").join(entropy("content").drop("pages"), ["host", "path"])
    return both.select("host", "path", "pages", F.greatest("style", "content").alias("importance"))


def low_branches(pages: DataFrame, least_pages: int = 8, low: float = 0.3) -> DataFrame:
    """(host, removed): per host the (path, content) marks to take out; content 0 stands for the whole branch.

    A branch is low below ``low`` on at least ``least_pages`` distinct pages.  A content is low where it stands on more than the
    host's pages to the power 0.75, which leaves but a few per path: the list of a host is bounded by its template.
    """
    counts = materialize(_counted(pages))
    whole = counts.groupBy("host", "path").agg(F.sum("n").alias("m")).groupBy("host").agg(F.max("m").alias("m"))
    branches = _importance(counts).filter((F.col("pages") >= least_pages) & (F.col("importance") < low)).select("host", "path", F.lit(0).cast("long").alias("content"))
    said = counts.filter("content != 0").groupBy("host", "path", "content").agg(F.sum("n").alias("n")).join(whole, "host")
    contents = said.filter((F.col("m") >= least_pages) & (F.col("n") >= F.pow("m", F.lit(0.75)))).select("host", "path", "content")
    return branches.unionByName(contents).groupBy("host").agg(F.collect_set(F.struct("path", "content")).alias("removed"))


@F.pandas_udf(T.StringType())
def _extracted(pages: pd.Series, removed: pd.Series) -> pd.Series:
    return pd.Series(
        [extract(p, frozenset((r["path"], r["content"]) for r in (() if x is None else x))) for p, x in zip(pages, removed, strict=True)],
        dtype=object,
    )


def main_text(pages: DataFrame, broadcast_rows: int = 50_000) -> DataFrame:
    """(page_id, url, text) for every row of ``pages`` (page_id, url, html).

    Null and empty pages have the empty text; a page without url belongs to the host without name; repeated rows come out
    repeated, and count once in their host's tree.  Hosts with low branches are sent to every task where they are at most
    ``broadcast_rows``, else joined by host, where Spark splits a host with very many pages.
    """
    low = materialize(low_branches(pages))
    low = F.broadcast(low) if low.count() <= broadcast_rows else low
    own = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    return own.join(low, "host", "left").select("page_id", "url", _extracted("html", "removed").alias("text"))

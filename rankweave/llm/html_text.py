"""Operator 7: main text of web pages by tag-path ratios.

A page is read as a run of text blocks, each with its root-to-leaf tag path. Per path, the text length and the punctuation
are summed and divided by the number of blocks; both ratios are smoothed along the page with the neighbours' and fused
into one score, and paths above a share of the page's best are content. The page's text is every block of the lowest container
that holds all content blocks, or of the article or main around it, but boilerplate, which element names, roles and class words
give away.

Defined results: null or empty html, or a page without any text block outside boilerplate, gives an empty text; broken
markup is read as far as it goes; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of the page's best fused score from which a path is content, and weights of a block and its neighbours.
THRESHOLD, SMOOTH = 0.2, (0.25, 0.5, 0.25)

# Element names and class words of HTML.
RAW = set("script style noscript template iframe svg textarea select object canvas title".split())
BLOCKS = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY_BLOCK = {"p", "h1", "h2", "h3", "h4", "h5", "h6"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"ul", "ol", "dl", "table", "menu", "div", "section", "article", "main", "body", "blockquote", "nav", "aside", "header", "footer", "form"}
CONTAINERS = {"article", "main", "section", "div", "body", "td", "center", "html"}
BOILERPLATE = set("head nav footer aside form menu dialog button label fieldset legend".split())
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "form", "note", "status"}
WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense banner banners breadcrumb breadcrumbs byline-share comment comments commentlist consent cookie cookies copyright"
    " disqus donate footer gdpr header hidden login masthead menu menus modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup"
    " promo promoted promotion recommended related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar"
    " tracking widget widgets".split()
)

#: Paragraphs and headings of an article go only where a class names what is no part of it.
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote"}
NO_PART = set("ad ads adv advert adverts advertisement comment comments consent cookie hidden notice notices sponsored".split())
NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
STOP = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
PUNCTUATION = re.compile(r"[.,;:!?。，、；：！？…]")


class Node:
    """An open element: a number for its path, its nearest block element, and whether it or one around it is boilerplate."""

    __slots__ = ("name", "path", "off", "above", "inside", "block", "depth", "kept")

    def __init__(self, name: str, attrs: str, above: Node | None, paths: dict):
        found = {k.lower(): v.strip("\"'").lower() for k, v in ATTRIBUTE.findall(attrs)} if attrs.strip(" /\n\t") else {}
        kind = found.get("class", "").split()
        self.name, self.above, self.kept = name, above, None
        self.depth = above.depth + 1 if above else 0
        self.path = paths.setdefault((above.path if above else -1, name, kind[0] if kind else ""), len(paths))
        self.block = self if above is None or name in BLOCKS else above.block
        self.inside = (name in ("article", "main")) or bool(above and above.inside)
        words = set(re.split(r"[^a-z]+", f"{found.get('class', '')} {found.get('id', '')}")) if found else set()
        marked = bool(words & (NO_PART if name in PROSE and above.inside else WORDS)) and name not in ("html", "body", "main", "article") or found.get("role") in ROLES
        unseen = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
        named = name in BOILERPLATE or name == "header" and not self.inside
        commented = name == "article" and bool(words & {"comment", "comments", "reply", "related", "teaser", "ad", "ads", "promo", "sponsored"})
        self.off = bool(above and above.off) or marked or unseen or named or commented


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, content): "text", "start" with attributes, "end". Comments, declarations and raw elements are left out. Linear in the page.

    A tag ends at the first > outside quotes. Where none follows, this tag and all later ones end at their first >.
    """
    at, loose, last = 0, False, page.rfind(">")
    while True:
        tag = page.find("<", at)
        while tag >= 0 and not (page.startswith(("<!", "<?"), tag) or NAME.match(page, tag)):
            yield "text", "", page[at : tag + 1]
            at = tag + 1
            tag = page.find("<", at)
        if tag < 0 or tag > last and not page.startswith("<!--", tag):
            yield "text", "", page[at:]
            return
        if tag > at:
            yield "text", "", page[at:tag]
        if page.startswith("<!--", tag):
            at = page.find("-->", tag + 4)
            at = len(page) if at < 0 else at + 3
            continue
        if page.startswith(("<!", "<?"), tag):
            at = page.index(">", tag) + 1
            continue
        named = NAME.match(page, tag)
        end = -1 if loose else tag_end(page, named.end())
        if end < 0:
            loose, end = True, page.index(">", named.end())
        name, at = named[1].lower(), end + 1
        if page[tag + 1] == "/":
            yield "end", name, ""
        elif name in RAW:
            found = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = found.end() if found else len(page)
        else:
            yield "start", name, page[named.end() : end]


def tag_end(page: str, at: int) -> int:
    """Where the tag's > is, outside quotes; -1 if there is none."""
    while found := STOP.search(page, at):
        if found[0] == ">":
            return found.start()
        at = page.find(found[0], found.end()) + 1
        if not at:
            break
    return -1


def blocks_of(page: str) -> list[tuple[Node, str]]:
    """The page's text blocks in order, each with its innermost block element."""
    paths: dict[tuple[int, str, str], int] = {}
    out: list[tuple[Node, str]] = []
    open_nodes: list[Node] = [Node("#", "", None, paths)]
    count: dict[str, int] = defaultdict(int)
    held: list[str] = []

    def flush() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            inner = open_nodes[-1]
            out.append((inner if inner.off and not inner.block.off else inner.block, text))

    def close(k: int) -> None:
        flush()
        for node in open_nodes[k:]:
            count[node.name] -= 1
        del open_nodes[k:]

    for kind, name, content in tokens(page):
        if kind == "text":
            held.append(html.unescape(content))
        elif name == "br":
            held.append(" ")
        elif name in VOID:
            if name in BLOCKS:
                flush()
        elif kind == "end":
            if name in BLOCKS and count[name]:
                close(next(k for k in range(len(open_nodes) - 1, 0, -1) if open_nodes[k].name == name))
            elif name in BLOCKS:
                flush()
            elif open_nodes[-1].name == name:
                if open_nodes[-1].off and not open_nodes[-1].above.off:
                    flush()
                count[open_nodes.pop().name] -= 1
        else:
            if name in BLOCKS:
                ends = SIBLINGS.get(name, CLOSED_BY_BLOCK)
                for k in range(len(open_nodes) - 1, 0, -1) if any(count[x] for x in ends) else ():
                    if open_nodes[k].name in ends:
                        close(k)
                        break
                    if open_nodes[k].name in SCOPES:
                        break
                flush()
            node = Node(name, content, open_nodes[-1], paths)
            if name not in BLOCKS and node.off and not open_nodes[-1].off:
                flush()
            open_nodes.append(node)
            count[name] += 1
    flush()
    return out


def lowest_common(nodes: list[Node]) -> Node:
    """The deepest element around all of them; each element on the way is visited once."""
    seen, common = set(), nodes[0]
    at: Node | None = nodes[0]
    while at is not None:
        seen.add(at)
        at = at.above
    for node in nodes[1:]:
        while node not in seen:
            seen.add(node)
            node = node.above
        common = node if node.depth < common.depth else common
    return common


def main_text(page: str | None, threshold: float = THRESHOLD) -> str:
    blocks = [(node, text) for node, text in blocks_of(page or "") if not node.off]
    if not blocks:
        return ""
    size, marks, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for node, text in blocks:
        size[node.path] += len(text)
        marks[node.path] += len(PUNCTUATION.findall(text))
        count[node.path] += 1
    lengths = [size[n.path] / count[n.path] for n, _ in blocks]
    points = [1 + marks[n.path] / count[n.path] for n, _ in blocks]

    def smooth(x: list[float]) -> list[float]:
        padded = [x[0], *x, x[-1]]
        return [sum(w * v for w, v in zip(SMOOTH, padded[i : i + 3], strict=True)) for i in range(len(x))]

    fused: dict[int, float] = defaultdict(float)
    for (node, _), a, b in zip(blocks, smooth(lengths), smooth(points), strict=True):
        fused[node.path] += a * b / count[node.path]
    least = threshold * max(fused.values())
    around = lowest_common(list(dict.fromkeys(n for n, _ in blocks if fused[n.path] >= least)))
    chosen = None
    while around is not None:
        if around.name in ("article", "main"):
            chosen = around
            break
        if chosen is None and (around.name in CONTAINERS or around.name == "#"):
            chosen = around
        around = around.above
    chosen.kept = True

    def within(node: Node) -> bool:
        way = []
        while node.kept is None and node.above is not None:
            way.append(node)
            node = node.above
        for x in way:
            x.kept = bool(node.kept)
        return bool(node.kept)

    return "\n".join(text for node, text in blocks if within(node))


def extract(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """pages (page_id, url, html) to page_id, url, text, n_chars."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(x, threshold) for x in batch], dtype=object)

    text = F.pandas_udf(run, "string")
    return pages.select("page_id", "url", text(F.col("html")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op7_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))

"""Main text of web pages by composite text density.

Each element's density is its characters per tag, adjusted for links. The subtree whose children's densities sum to most is
the core of the article. On the way from there to body the least density met is the threshold: an ancestor is taken in as
long as what it adds beside the core is mostly headings and blocks that reach the threshold and a good part of the core's
own density.
"""

from __future__ import annotations

import html as _html
import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from turnflow.llm.common import table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title xmp iframe noembed noframes".split())
#: Elements that are never part of an article's text.
NEVER = frozenset("head script style noscript template nav header footer aside form button select option textarea input fieldset iframe object canvas svg math dialog menu noembed noframes".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr caption ul".split()
)
#: An open element of the key ends where one of these starts.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Containers inside which an unclosed paragraph or item is looked for.
SCOPE = frozenset("html body article section div main table ul ol dl td th blockquote aside nav header footer form figure".split())
#: A block beside the core counts as dense only from this share of the core's characters per tag on: the composite density of a
#: short line without links is no measure, as its logarithm's base comes near 1.
NEAR = 0.5
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that a class or id can mark as something beside the article; headings, paragraphs and inline elements can't be.
MARKED = frozenset("div section ul ol dl table tbody tr td details figure center".split())
#: Words in class, id or role that mark what mostly isn't the article: such an element goes unless it has half of the page's
#: text or the main heading.
HINT = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|header|login|menu|modal|nav|navbar|navigation|newsletter|notice|notices|pagination|pager|popup|promo|promoted|related|replies|responses|reader-comments|search|share|sharing|sidebar|signup|social|sponsor|sponsored|subscribe|toolbar|widget)(?:$|[\s_-])",
    re.I,
)
#: Those of them that have other meanings as one of several classes, as in "market share": there they say nothing of an element with a
#: paragraph of its own inside an article.
WEAK = frozenset("banner header menu notice notices promoted related responses search share sharing social".split())
#: Characters outside links that make a paragraph.
PARAGRAPH = 40
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
SPACES = re.compile(r"\s+")


class Node:
    """One element: parts holds texts and child nodes in page order."""

    __slots__ = ("tag", "up", "parts", "drop", "hint", "within", "main", "chars", "tags", "link_chars", "link_tags", "density")

    def __init__(self, tag: str, up: Node | None, drop: bool, hint: str = ""):
        self.tag, self.up, self.drop, self.hint, self.parts = tag, up, drop, hint, []
        self.within = "" if up is None else up.tag if up.tag == "article" or up.tag == "main" and not up.within else up.within
        self.main = tag == "h1"
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = 0.0


def _marks(tag: str, attributes: str) -> tuple[bool, str]:
    """Whether the attributes hide the element or give it another role, and whether its class or id says so: '' or how surely."""
    hint = ""
    for name, value in ATTRIBUTE.findall(attributes) if attributes and tag not in ("html", "body", "article", "main") else ():
        value = value.strip("\"'")
        name = name.lower()
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "role" and value.lower() in ROLES):
            return True, ""
        if name in ("class", "id") and tag in MARKED and HINT.search(value):
            classes = value.lower().split()
            said = {w for w in classes if HINT.search(w)}
            hint = "weak" if hint != "sure" and said <= WEAK and len(said) < len(set(classes)) else "sure"
    return False, hint


class Open:
    """The open elements, innermost last, with the places of each tag and of those that close nothing outside them."""

    def __init__(self, root: Node):
        self.nodes, self.places, self.scopes, self.wide = [root], {}, [0], [0]

    def push(self, node: Node) -> None:
        k = len(self.nodes)
        self.nodes.append(node)
        self.places.setdefault(node.tag, []).append(k)
        if node.tag in SCOPE:
            self.scopes.append(k)
            if node.tag not in ("td", "th"):
                self.wide.append(k)

    def last(self, tag: str) -> int:
        """The place of the innermost element of the tag; 0 if there is none."""
        at = self.places.get(tag)
        return at[-1] if at else 0

    def close(self, k: int) -> None:
        """Closes what is open from place k on."""
        for node in reversed(self.nodes[k:]):
            self.places[node.tag].pop()
        del self.nodes[k:]
        for places in (self.scopes, self.wide):
            while places[-1] >= k:
                places.pop()


def parse(page: str) -> list[Node]:
    """The elements of a page in page order, the root first. Unclosed and stray tags are mended as browsers do."""
    root = Node("html", None, False)
    nodes, stack, at, n = [root], Open(root), 0, len(page)

    def text(upto: int) -> None:
        if upto > at:
            stack.nodes[-1].parts.append(_html.unescape(page[at:upto]))

    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            text(n)
            break
        text(m.start())
        at = m.end()
        end, tag, attributes = m[1], m[2] or m[4], m[3] or m[5] or ""
        if m[0].startswith("<![CDATA["):
            stack.nodes[-1].parts.append(m[0][9:].removesuffix("]]>"))
        elif end:
            end = end.lower()
            k = stack.last(end)
            if k and (end in SCOPE or k > stack.scopes[-1]):
                stack.close(k)
        elif tag:
            tag = tag.lower()
            closes = CLOSES.get(tag, ()) if tag in CLOSES else ("p",) if tag in BLOCK else ()
            while closes:
                k = max(map(stack.last, closes))
                if k <= (stack.wide if tag in ("tr", "td", "th") else stack.scopes)[-1]:
                    break
                stack.close(k)
            if tag == "html":
                continue
            hidden, hint = _marks(tag, attributes)
            node = Node(tag, stack.nodes[-1], tag in NEVER or hidden, hint)
            stack.nodes[-1].parts.append(node)
            nodes.append(node)
            if tag in RAW:
                close = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = close.end() if close else n
            elif tag not in VOID and not attributes.rstrip().endswith("/") or tag in BLOCK - VOID:
                stack.push(node)
    return nodes


def _settle_marks(nodes: list[Node]) -> None:
    """Drops elements whose class speaks against them, but none with the main heading or half of the page's text, and, where the word is
    ambiguous, none inside an article that has a paragraph of its own; keeps the header of an article where it has the main heading."""
    linked: dict[int, int] = {}
    paragraph: set[int] = set()
    for x in reversed(nodes):
        x.chars = sum(len("".join(p.split())) if isinstance(p, str) else p.chars for p in x.parts) * (not x.drop or x.tag == "header")
        linked[id(x)] = x.chars if x.tag == "a" else sum(linked[id(p)] for p in x.parts if not isinstance(p, str))
        if any(p.tag == "p" and p.chars - linked[id(p)] >= PARAGRAPH for p in x.parts if not isinstance(p, str)):
            paragraph.add(id(x))
        x.main = x.main or any(p.main for p in x.parts if not isinstance(p, str))
    whole = nodes[0].chars
    for x in nodes:
        if x.tag == "header" and x.main and x.up is not None and x.up.tag in ("article", "main"):
            x.drop = False
        elif x.hint and not x.main and 2 * x.chars < whole and not (x.hint == "weak" and x.within and id(x) in paragraph):
            x.drop = True


def _measure(nodes: list[Node]) -> None:
    """Characters and tags of every node, dropped ones left out, and its composite text density."""
    for x in nodes:
        x.chars = x.tags = x.link_chars = x.link_tags = 0
    for x in reversed(nodes):
        if x.drop:
            x.chars = x.tags = x.link_chars = x.link_tags = 0
            continue
        x.chars += sum(len("".join(p.split())) for p in x.parts if isinstance(p, str))
        if x.tag == "a":
            x.link_chars, x.link_tags = x.chars, x.link_tags + 1
        if x.up:
            x.up.chars += x.chars
            x.up.tags += x.tags + 1
            x.up.link_chars += x.link_chars
            x.up.link_tags += x.link_tags
    body = next((x for x in nodes if x.tag == "body"), nodes[0])
    ratio = body.link_chars / max(body.chars, 1)
    for x in nodes:
        if x.chars:
            tags, links, plain = max(x.tags, 1), max(x.link_chars, 1), max(x.chars - x.link_chars, 1)
            base = math.log(max(x.chars / plain * x.link_chars + ratio * x.chars + math.e, math.e * (1 + 1e-9)))
            x.density = x.chars / tags * math.log(max(x.chars / links * tags / max(x.link_tags, 1), 1.0)) / math.log(base)


def _core(nodes: list[Node]) -> Node | None:
    """The subtree below body whose children's densities sum to most, the first of equal ones."""
    body = next((x for x in nodes if x.tag == "body"), nodes[0])
    dropped: set[int] = set()
    best, most = None, 0.0
    for x in nodes:
        if x.drop or x.up is not None and id(x.up) in dropped:
            dropped.add(id(x))
            continue
        total = sum(p.density for p in x.parts if not isinstance(p, str) and not p.drop and p.tag != "a")
        if total > most and x is not body and x.up is not None:
            best, most = x, total
    return best


def _densest(nodes: list[Node]) -> Node:
    """The core, as a part of its article or main element where it has one, and widened while an ancestor adds mostly
    headings and dense blocks."""
    body = next((x for x in nodes if x.tag == "body"), nodes[0])
    core = _core(nodes)
    # text that stands directly in body belongs to no subtree
    if core is None or any(isinstance(p, str) and len(p.split()) >= 20 for p in body.parts):
        return body
    path = [core]
    while path[-1] is not body and path[-1].up is not None:
        path.append(path[-1].up)
    enough, plain = min(x.density for x in path), NEAR * core.chars / max(core.tags, 1)
    top = next((k for tag in ("article", "main") for k, x in enumerate(path) if x.tag == tag), 0)
    for k in range(top + 1, len(path)):
        more, dense = 0, 0
        for p in path[k].parts:
            if p is path[k - 1] or not isinstance(p, str) and (p.drop or _is_link_list(p)):
                continue
            size = len("".join(p.split())) if isinstance(p, str) else p.chars
            more += size
            dense += size * (len(p.split()) >= 20 if isinstance(p, str) else p.tag in HEADINGS or p.density >= enough and p.chars >= plain * max(p.tags, 1))
        if more and 2 * dense < more:
            break
        if more:
            top = k
    return path[top]


def _is_link_list(x: Node) -> bool:
    return x.tag in ("ul", "ol", "div", "section", "table", "dl") and x.link_tags >= 2 and x.link_chars >= 0.8 * x.chars


def text_of(top: Node) -> str:
    """The blocks of a subtree, dropped elements left out, and lists of links but those of an article."""
    blocks: list[list[str]] = [[]]
    stack: list[tuple[Node, int]] = [(top, 0)]
    while stack:
        x, k = stack.pop()
        if k == 0 and x.tag in BLOCK:
            blocks.append([])
        while k < len(x.parts):
            p = x.parts[k]
            k += 1
            if isinstance(p, str):
                blocks[-1].append(p)
            elif p.tag == "br":
                blocks[-1].append(" ")
            elif not p.drop and (p.within == "article" or not _is_link_list(p)):
                stack.append((x, k))
                stack.append((p, 0))
                break
        else:
            if x.tag in BLOCK:
                blocks.append([])
            continue
    lines = (SPACES.sub(" ", "".join(b)).strip() for b in blocks)
    return "\n".join(x for x in lines if x)


def extract(page: str | None) -> str:
    """The main text of one page; empty for null, empty and textless pages."""
    if not page:
        return ""
    nodes = parse(page)
    _settle_marks(nodes)
    _measure(nodes)
    return text_of(_densest(nodes))


@pandas_udf(StringType())
def main_text(pages: pd.Series) -> pd.Series:
    return pages.map(extract, na_action=None)


def extract_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with `text` and `n_chars`, its code points; each page is worked on alone, without a shuffle.

    Null or empty html gives an empty text. Pages are read whole, however long and deep; of subtrees with equal sums the
    first is the core. Repeated rows give equal rows. Columns named text or n_chars are replaced, all others stay.
    """
    kept: list[Column | str] = [c for c in pages.columns if c not in ("text", "n_chars")]
    found = pages.select(*kept, main_text(F.col(html)).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract_pages(pages).select("page_id", "url", "text", "n_chars")

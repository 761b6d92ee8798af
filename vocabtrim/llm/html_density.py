"""Main-text extraction by composite text density.

Each page becomes a tree of nodes.  For every node: characters C, tags T, link
characters LC and link tags LT of its subtree give the link-adjusted density

    C/T * log_b((C/LC) * (T/LT)),   b = 1 + ln(C/(C-LC) * LC + LC_body/C_body * C + e)

(zero denominators count as one).  A node's density sum adds the densities of its
children; text between block elements counts as a child.  The node of the largest sum
is found, and the smallest density on its path to the body is the threshold.  From the
body down, every branch at or above the threshold keeps its subtree of the largest sum,
and the kept subtrees in page order are the article.  As the logarithm of a branch
without links grows with its size alone, a branch also passes with at least the fewest
characters a tag and at most the largest share of link characters on that path.  An
``article`` or ``main`` of which at least half is kept is taken whole.  Elements that
never hold article text (menus, footers, forms, notices, adverts, comments, scripts)
take no part.

Edge cases: a null or empty page, or one without text, gives the empty string and
n_chars 0; repeated rows come back repeated; equal sums go to the outer, earlier
node; unclosed and unmatched tags are accepted; extra columns are ignored.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import need

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
                   r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
TELLING = re.compile(r"class|id|role|aria-|hidden", re.I)
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog",
         "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5",
         "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option",
         "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
SKIP = {"head", "nav", "footer", "aside", "form", "button", "select", "input", "svg", "canvas", "object", "dialog",
        "menu", "template", "math", "audio", "video", "map"} | RAW
# tags that an opening tag of the key closes first, up to the given scope
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}),
          "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"})}
SCOPE = {"body", "html", "table", "td", "th", "button", "article", "section", "div", "li", "blockquote"}
# whole class or id tokens, or a whole label; a hint alone drops no large dense node (see _outweighs)
HINT = re.compile(r"(?:(?:main|site|page|top|bottom|left|right|primary|secondary|global|mobile|user|post|article)[\s_-])?"
                  r"(?:nav(?:bar|igation)?|menu|side-?bar|footer|masthead|breadcrumbs?|ads?|advert(?:s|ising|isements?)?|"
                  r"banner|sponsor(?:s|ed)?|promos?|promotions?|cookies?|consent|gdpr|notice|pop-?up|modal|overlay|"
                  r"comments?|disqus|replies|related|recommend(?:ed|ations?)|share|sharing|social|newsletter|subscribe|"
                  r"login|search|pagination|pager|toolbar|skip-?link)"
                  r"(?:[\s_-](?:nav|menu|bar|list|links?|box|container|wrap(?:per)?|section|area|block|widget|panel|form|"
                  r"banner|notice|consent|buttons?|icons?|media|posts?|articles?|stories|items?|slot|unit|thread|signup|"
                  r"left|right|top|bottom|\d+))*", re.I)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu",
         "menubar", "form", "toolbar"}
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "kids", "skip", "hint", "chars", "tags", "link_chars", "link_tags", "density", "sum", "parent",
                 "block", "top", "kept", "article")

    def __init__(self, tag, parent, skip, hint=False):
        self.tag, self.parent, self.skip, self.hint, self.kids = tag, parent, skip, hint, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0
        self.block = self.kept = False
        self.article = tag in ("article", "main") or parent is not None and parent.article
        self.top = self


def _noise(tag: str, attributes: str, inside_article: bool) -> tuple[bool, bool]:
    """Whether the element takes no part, and whether its names hint that it should not."""
    if tag in SKIP or tag == "header" and not inside_article:
        return True, False
    if tag in ("body", "html", "article", "main") or not TELLING.search(attributes):
        return False, False
    hint = False
    for name, *values in ATTRIBUTE.findall(attributes):
        value, name = next((v for v in values if v), "").strip(), name.lower()
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" \
                or name == "role" and value.lower() in ROLES:
            return True, False
        if name == "class" or name == "id" and tag not in HEADINGS:  # a heading's id names its subject
            hint = hint or any(HINT.fullmatch(x) for x in value.split())
        elif name == "aria-label":
            hint = hint or HINT.fullmatch(value) is not None
    return False, hint


def parse(page: str) -> Node:
    """The tree of a page; text is a str among ``kids``."""
    root = Node("body", None, False)
    stack, at = [root], 0
    open_ = Counter()  # tags on the stack above the root, so that a tag that is not open is not sought

    def close(i):
        open_.subtract(x.tag for x in stack[i:])
        del stack[i:]
    while True:
        m = TOKEN.match(page, at)
        if m is None:
            return root
        at, top, name = m.end(), stack[-1], m.group(2)
        if name is None:
            text = m.group()
            if not text.startswith("<") or text == "<":
                top.kids.append(_html.unescape(text))
            continue
        tag = name.lower()
        if m.group(1):
            if tag in ("body", "html") or not open_[tag]:
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
                if tag not in BLOCK and stack[i].tag in BLOCK:
                    break  # an inline end tag closes nothing beyond its block
            continue
        if tag in ("html", "body"):
            continue
        if tag in BLOCK and tag != "br" and open_["p"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in SCOPE:
                    break
        if tag in CLOSES:
            closed, scope = CLOSES[tag]
            for i in range(len(stack) - 1, 0, -1) if any(open_[x] for x in closed) else ():
                if stack[i].tag in scope:
                    break
                if stack[i].tag in closed:
                    close(i)
        top = stack[-1]
        attributes = m.group(3)
        node = Node(tag, top, *_noise(tag, attributes, top.article))
        top.kids.append(node)
        if tag in RAW:
            end = re.compile(f"</{tag}\\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not attributes.endswith("/"):
            stack.append(node)
            open_[tag] += 1


def _nodes(root: Node) -> list[Node]:
    """Nodes that can hold text, parents before children."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        if not n.skip:
            out.append(n)
            todo.extend(k for k in reversed(n.kids) if isinstance(k, Node))
    return out


def _count(nodes: list[Node]) -> None:
    """Counts and densities; ``nodes`` holds parents before children, the root first."""
    for n in reversed(nodes):
        own = sum(len(SPACE.sub("", k)) for k in n.kids if isinstance(k, str))
        kids = [k for k in n.kids if isinstance(k, Node) and not k.skip]
        n.chars = own + sum(k.chars for k in kids)
        n.tags = sum(k.tags + (k.tag != "") for k in kids)
        n.link_chars = n.chars if n.tag == "a" else sum(k.link_chars for k in kids)
        n.link_tags = (n.tag == "a") + sum(k.link_tags for k in kids)
        n.block = n.tag in BLOCK and n.tag not in VOID or n.tag == "" or any(k.block for k in kids)
    root = nodes[0]
    ratio = root.link_chars / max(1, root.chars)
    for n in nodes:
        n.density = 0.0
        if n.chars:
            c, t, lc, lt = n.chars, max(1, n.tags), max(1, n.link_chars), max(1, n.link_tags)
            base = math.log(c / max(1, c - n.link_chars) * n.link_chars + ratio * c + math.e)
            n.density = c / t * max(0.0, math.log(c / lc * (t / lt))) / math.log(1 + base)


def _outweighs(n: Node, root: Node) -> bool:
    """Whether a hinted node is large and at least as dense as the page, or nearly all of it."""
    own, page = n.chars - n.link_chars, root.chars - root.link_chars
    large = own >= 100 and 2 * own >= page or own >= 400 and 10 * own >= page
    return large and (n.density >= root.density or 10 * own >= 9 * page)


def _part_runs(nodes: list[Node]) -> bool:
    """Text and inline elements between block elements become nodes of their own, without a tag;
    whether there were any."""
    any_ = False
    for n in nodes:
        if not any(isinstance(k, Node) and not k.skip and k.block for k in n.kids):
            continue
        kids, run = [], []
        for k in [*n.kids, None]:
            if k is not None and not (isinstance(k, Node) and k.block):
                run.append(k)
                continue
            if any(x.strip() if isinstance(x, str) else x.chars and not x.skip for x in run):
                node = Node("", n, False)
                node.kids, run, any_ = run, [node], True
                for x in node.kids:
                    if isinstance(x, Node):
                        x.parent = node
            kids += run
            run = []
            if k is not None:
                kids.append(k)
        n.kids = kids
    return any_


def select(root: Node) -> list[Node]:
    """The subtrees that hold the article, in page order."""
    nodes = _nodes(root)
    _count(nodes)
    for n in nodes:
        n.skip = n.hint and not _outweighs(n, root)
    if any(n.skip for n in nodes):
        nodes = _nodes(root)
        _count(nodes)
    if _part_runs(nodes):
        nodes = _nodes(root)
        _count(nodes)
    for n in reversed(nodes):
        kids = [k for k in n.kids if isinstance(k, Node) and not k.skip]
        n.sum, n.top = sum(k.density for k in kids), n
        for k in kids:  # equal sums go to the outer, earlier node
            if k.block and k.top.sum > n.top.sum:
                n.top = k.top
    best = root.top
    if best.sum == 0.0:
        return [root]
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)
    rate, share = min(n.chars / max(1, n.tags) for n in path), max(n.link_chars / n.chars for n in path)

    def reaches(n):
        # without links the logarithm grows with size alone: as dense and no more linked will do
        return n.chars > 0 and (n.density >= threshold
                                or n.chars / max(1, n.tags) >= rate and n.link_chars / n.chars <= share)
    todo = [root]
    while todo:
        n = todo.pop()
        if reaches(n) and not n.kept:
            n.top.kept = True
            todo.extend(k for k in n.kids if isinstance(k, Node) and not k.skip and k.block)
    inside = {}  # characters under kept nodes
    for n in reversed(nodes):
        inside[n] = n.chars if n.kept else sum(inside[k] for k in n.kids if isinstance(k, Node) and not k.skip)
    for n in nodes:  # an article that is mostly kept is taken whole
        if n.tag in ("article", "main") and 2 * inside[n] >= n.chars > 0:
            n.kept = True
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        if n.kept:
            out.append(n)
        else:
            todo.extend(k for k in reversed(n.kids) if isinstance(k, Node) and not k.skip)
    return out


def text_of(nodes: list[Node]) -> str:
    """Blocks of the subtrees in page order, one a line."""
    blocks, line = [], []

    def flush():
        if line:
            if text := SPACE.sub(" ", "".join(line)).strip():
                blocks.append(text)
            line.clear()
    todo: list = [x for n in reversed(nodes) for x in (None, n)]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            line.append(x)
        elif not x.skip:
            if x.tag in BLOCK:
                flush()
                todo.append(None)
            todo.extend(reversed(x.kids))
    flush()
    return "\n".join(blocks)


def main_text(page: str | None) -> str:
    return text_of(select(parse(page))) if page else ""


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row, ``n_chars`` in code points."""
    def run(batches):
        for batch in batches:
            texts = [main_text(p) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])
    return need(pages, "page_id", "url", "html").mapInArrow(
        run, "page_id long, url string, text string, n_chars long")

"""Main text of web pages by composite text density."""

from __future__ import annotations

import re
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulgrid.llm.common import in_slices

# Fixed values of the HTML standard: elements without content, with raw content, that start a
# block, and what an opening tag closes without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre search section summary table tbody td tfoot "
    "th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("html body caption tbody td tfoot th thead tr option optgroup".split())
SIBLINGS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"},
}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}}
TABLE_SCOPE = frozenset(["table", "html", "body"])
P_SCOPE = frozenset("table td th caption button object marquee applet html body".split())

#: Elements whose text no reader sees as text, and those beside the main text; a header only outside an article.
UNSEEN = frozenset(
    "head script style noscript template button select textarea label legend iframe object embed svg canvas audio video title input map".split())
BESIDE = frozenset("nav footer aside form dialog menu".split())
#: What a class or id names that stands beside the main text.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsors sponsored promo promos promotion banner "
    "banners cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay sidebar sidenav menu menus "
    "nav navbar navigation breadcrumb breadcrumbs footer comment comments commentlist disqus respond reply replies share sharing social "
    "related recommended recommendations newsletter subscribe signup login toolbar widget widgets skip pagination pager hidden".split())
#: The same, outside an article only.
PAGE_NAMES = frozenset(["header", "masthead", "topbar"])
#: Names that say it as the first word of a longer one, words after which the one before counts,
#: and first words that speak of the page's state.
FIRST = frozenset("related recommended sponsored cookie cookies gdpr newsletter advert advertisement".split())
AFTER = frozenset(
    "wrapper wrap container box inner outer area section block list left right top bottom main primary secondary panel region holder group "
    "item items unit slot space zone text content links link buttons button icons icon widget widgets form x".split())
STATE = frozenset("has is no not with without js show hide enable disable".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
STAY = frozenset(["html", "body", "main", "article"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup header".split())

_TOKEN = re.compile(
    r"""<!--(?:>|->|.*?(?:-->|--!>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"'=]|=\s*"[^"]*"|=\s*'[^']*'|["'=])*)(>|\Z)|</[^a-zA-Z][^>]*(?:>|\Z)""",
    re.S)
_ATTRS = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_REPLY = frozenset(["comment", "reply"])
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    """``gone``: 0 for text, 1 for what seems to stand beside the main text, 2 for what is no text."""

    __slots__ = ("tag", "up", "kids", "gone", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, up: Node | None, gone: int = 0):
        self.tag, self.up, self.kids, self.gone = tag, up, [], gone
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _named(token: str, names: frozenset) -> bool:
    """Whether a class or id as a whole names one of ``names``: as its only or last word, but
    for words like box or list at the end. "share-price" is a price, "has-sidebar" a state."""
    if token.lower() in names:
        return True
    words = [w.lower() for w in _NAME.findall(token) if not w.isdigit()]
    if len(words) > 1 and words[0] in STATE:
        return False
    if names is NAMES and len(words) > 1 and words[0] in FIRST:
        return True
    while len(words) > 1 and words[-1] in AFTER and words[-1] not in names:
        words.pop()
    return bool(words) and words[-1] in names


def _beside(tag: str, attrs: str, in_article: bool) -> int:
    if tag in UNSEEN:
        return 2
    mark = int(tag in BESIDE or (tag == "header" and not in_article))
    if not attrs.strip():
        return mark
    got = {}
    for m in _ATTRS.finditer(attrs):
        got.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    if tag not in ("html", "body") and (
            "hidden" in got or got.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(got.get("style", ""))):
        return 2
    tokens = [t for k in ("class", "id") for t in unescape(got.get(k, "")).split()]
    if tag in STAY:
        return int(tag == "article" and any(_named(t, _REPLY) for t in tokens))
    if mark or got.get("role", "").lower() in ROLES or any(_named(t, NAMES) for t in tokens):
        return 1
    return int(not in_article and any(_named(t, PAGE_NAMES) for t in tokens))


def parse(html: str) -> Node:
    """A forgiving tree: implied end tags, unclosed and stray tags are all accepted."""
    root = Node("#root", None)
    stack, open_tags, articles, at = [root], {}, 0, 0

    def pop() -> None:
        nonlocal articles
        tag = stack.pop().tag
        open_tags[tag] -= 1
        articles -= tag in ("article", "main")

    def close(tags: set | frozenset, scope: set | frozenset) -> None:
        """Close up to the outermost open element of ``tags`` inside ``scope``."""
        last = 0
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in scope:
                break
            if stack[k].tag in tags:
                last = k
        while last and len(stack) > last:
            pop()

    def text(data: str) -> None:
        if data:
            stack[-1].kids.append(unescape(data) if "&" in data else data)

    find, end = _TOKEN.search, len(html)
    while at < end:
        m = find(html, at)
        if not m:
            text(html[at:])
            break
        text(html[at:m.start()])
        at = m.end()
        if not m[2] or not m[4]:
            continue  # a comment, a declaration, or a tag cut off by the end
        tag = m[2].lower()
        if m[1]:
            if open_tags.get(tag):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        while len(stack) > k:
                            pop()
                        break
                    if stack[k].tag in ("table", "td", "th", "article") and tag not in BLOCK:
                        break
            continue
        if tag in CLOSES_P and open_tags.get("p"):
            close({"p"}, P_SCOPE)
        if tag in SIBLINGS and any(open_tags.get(t) for t in SIBLINGS[tag]):
            close(SIBLINGS[tag], SCOPE.get(tag, TABLE_SCOPE))
        if tag == "body" and open_tags.get("head"):
            close({"head"}, frozenset())
        node = Node(tag, stack[-1], _beside(tag, m[3], articles > 0))
        stack[-1].kids.append(node)
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, at)
            if tag not in ("script", "style"):
                node.kids.append(unescape(html[at:stop.start() if stop else end]))
            at = stop.end() if stop else end
        elif tag not in VOID:
            stack.append(node)
            open_tags[tag] = open_tags.get(tag, 0) + 1
            articles += tag in ("article", "main")
    return root


def _inside(n: Node) -> list[Node]:
    """The elements in a node whose text counts."""
    return [k for k in n.kids if type(k) is Node and not k.gone]


def _ordered(root: Node, most: int = 0) -> list[Node]:
    """Nodes that aren't gone (or not by more than ``most``), parents first."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo += [k for k in reversed(n.kids) if type(k) is Node and k.gone <= most]
    return out


def _spare_the_page(root: Node) -> None:
    """Elements that seem to stand beside the text, but hold the page's text, are kept: all but a
    twentieth of it, or (forms and named elements) the only article, main element or first
    heading with paragraphs of the page. So is a header among the paragraphs that it heads."""
    nodes = _ordered(root, most=1)
    size, holds = {}, {}
    for n in reversed(nodes):
        size[id(n)] = sum(len("".join(k.split())) if type(k) is str else size.get(id(k), 0) for k in n.kids)
        holds[id(n)] = got = {n.tag} & {"article", "main", "h1", "p"} if not n.gone else set()
        for k in n.kids:
            if type(k) is Node:
                got |= holds.get(id(k), set())

    def text_in(n: Node) -> bool:
        return bool(holds[id(n)] & {"article", "main"} or {"h1", "p"} <= holds[id(n)])

    elsewhere = any(n.tag in ("article", "main", "h1") for n in _ordered(root))
    for n in nodes:
        if n.gone:
            if size[id(n)] > 0.95 * size[id(root)] or not elsewhere and n.tag not in ("header", "nav", "footer", "aside") and text_in(n):
                n.gone = 0
            elif n.tag == "header" and n.up.tag != "body" and any(type(k) is Node and k.tag == "p" for k in n.up.kids):
                n.gone = 0


def _density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Composite text density (Sun, Song, Liao 2011): characters per tag, lowered by links;
    ``share`` is that of link characters in the whole body."""
    if not chars:
        return 0.0
    tags, linked, link_tags = tags or 1, link_chars or 1, link_tags or 1
    base = log(chars / ((chars - link_chars) or 1) * link_chars + share * chars + e)
    inner = chars / linked * tags / link_tags
    return chars / tags * (log(inner) / log(base) if base > 1 and inner > 0 else log(max(inner, 1e-9)))


def _densities(nodes: list[Node], body: Node) -> None:
    """Density of each node, and the sum over the blocks in it, in place. Text that stands in
    a node without a block of its own counts as one block."""
    loose: dict[int, list[int]] = {}
    for n in reversed(nodes):
        n.chars = own = sum(len("".join(k.split())) for k in n.kids if type(k) is str)
        bare = [own, 0, 0, 0]
        for k in _inside(n):
            n.chars += k.chars
            n.tags += k.tags + 1
            n.link_chars += k.link_chars
            n.link_tags += k.link_tags + (k.tag == "a")
            if k.tag not in BLOCK:
                for i, v in enumerate((k.chars, k.tags + 1, k.link_chars, k.link_tags + (k.tag == "a"))):
                    bare[i] += v
        if n.tag == "a":
            n.link_chars = n.chars
        loose[id(n)] = bare
    share = body.link_chars / max(1, body.chars)
    for n in reversed(nodes):
        n.density = _density(n.chars, n.tags, n.link_chars, n.link_tags, share)
        blocks = [k.density for k in _inside(n) if k.tag in BLOCK]
        n.total = sum(blocks) + (_density(*loose[id(n)], share) if blocks else 0.0)


def _is_menu(n: Node, limit: float) -> bool:
    """A block mostly of links and thinner than the main text's path."""
    return n.link_tags >= 3 and 2 * n.link_chars > n.chars and n.density < limit


def main_nodes(root: Node) -> tuple[set[int], set[int]]:
    """ids of the nodes whose subtrees are the main text, and of those cut out of them.

    The subtree of the largest density sum is the core; so is every subtree beside the path from
    it to the body whose density reaches the smallest density on that path. Short pieces have few
    characters per tag whatever they are, so the article or main element around the core (or
    the only one in it, if it holds half of its text) then gives what density cannot tell:
    all in it stays but blocks of links. Without one, headings right before the core stay.
    """
    _spare_the_page(root)
    body = next((n for n in _ordered(root) if n.tag == "body"), root)
    nodes = _ordered(body)
    _densities(nodes, body)
    best = max(nodes, key=lambda n: n.total)
    if not best.total:
        return {id(body)}, set()
    for wanted in ("article", "main"):
        within = [n for n in _ordered(best) if n.tag == wanted]
        if len(within) == 1 and 2 * within[0].chars >= best.chars:
            best = within[0]
            break
    path = [best]
    while path[-1] is not body:
        path.append(path[-1].up)
    limit = min(n.density for n in path)
    cut = {id(n) for n in nodes if n.tag in BLOCK and n is not body and _is_menu(n, limit)} - {id(n) for n in path}
    on = {id(n) for n in path}
    chosen = {id(best)} | {id(k) for n in path[1:] for k in _inside(n) if id(k) not in on and k.density >= limit}
    around = [n for tag in ("article", "main") for n in path if n.tag == tag]
    if around:
        outer = max((n for n in around if n.tag == around[0].tag), key=path.index)
        return chosen | {id(outer)}, cut
    for n, up in zip(path, path[1:], strict=False):
        for k in reversed(_inside(up)[:[x is n for x in _inside(up)].index(True)]):
            if k.tag not in HEADINGS:
                break
            chosen.add(id(k))
    return chosen, cut


def main_text(html: str) -> str:
    """Blocks of the main text in page order, joined by a blank line."""
    root = parse(html)
    chosen, cut_out = main_nodes(root)
    blocks, run = [], []

    def cut() -> None:
        if run:
            if block := " ".join("".join(run).split()):
                blocks.append(block)
            run.clear()

    todo: list = [(root, id(root) in chosen)]
    while todo:
        n, inside = todo.pop()
        if n is None:
            cut()
        elif type(n) is str:
            if inside:
                run.append(n)
        elif not n.gone and id(n) not in cut_out:
            if n.tag == "br":
                run.append(" ")
            if block := n.tag in BLOCK:
                todo.append((None, False))
            inside = inside or id(n) in chosen
            todo += [(k, inside) for k in reversed(n.kids)]
            if block:
                cut()
    cut()
    return "\n\n".join(blocks)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page, from its whole html, row by row.

    Null or empty html: an empty text. Null ids and urls, ties and repeated rows pass row by
    row; broken markup is read as browsers do; empty table: empty result. Extra columns are
    not read.
    """

    def run(batches):
        for b in in_slices(batches):
            got = [main_text(h) for h in b.column("html").to_pylist()]
            cols = [b.column("page_id"), b.column("url"), pa.array(got, pa.string()), pa.array([len(t) for t in got], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["page_id", "url", "text", "n_chars"])

    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    return rows.mapInArrow(run, f"page_id {dict(rows.dtypes)['page_id']}, url string, text string, n_chars bigint")

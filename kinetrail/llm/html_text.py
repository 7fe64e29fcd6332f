"""Main text of web pages by tree scoring.

A lenient tokenizer builds a small tree of the page. Every paragraph-like block
gives points for its length and its commas to its parent and, halved per level,
to the ancestors above; a container's points are discounted by its share of link
text. The best container is kept with all of the article or main around it, or
else with its siblings, except for blocks that are mostly links; beside an
article, others and what scores well. Scripts, styles, forms, menus, page headers,
footers, sidebars, notices, adverts and reader comments take no part, by their
tag, role, class or id. A class or id drops containers and lists only, never a
paragraph, a heading, preformatted or inline text. Inside an article it must name
nothing else (related-posts, not related-work), and prose stays under a name that
a chapter may have as well (search, but not comments). It does not drop what holds
most of the page's unlinked text, unless the page names its content elsewhere, nor
the wrapper of a part that is named as content and holds most of it. A form around
all paragraphs of a page is a wrapper too.

Blocks are joined by "\n" in page order; inside a block white space (what Unicode
counts as such) becomes one space, a line break included. Character references are decoded once, as HTML5
does, in text only.

Defined results: null and empty html and pages without text give the empty
string; unclosed and stray tags and pages cut short are read as far as they go;
repeated rows are extracted each; other columns are not read.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = re.compile(r"\s+")
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|noscript|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^<>]*\Z",
    re.DOTALL | re.IGNORECASE,
)
#: What a tag, comment or the like at the cut end of a page begins with.
CUT_TAG = re.compile(r"<[a-zA-Z!?/]")
ATTRIBUTE = re.compile(r"([\w:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
HIDDEN = re.compile(r"\shidden(?=[\s=/>]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.IGNORECASE)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("nav footer aside button fieldset menu dialog head select svg object template".split())
#: Of these, the ones in which no block can stand: a block ends them.
NO_BLOCKS = ("select", "svg")
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
PARAGRAPHS = frozenset("p pre blockquote td li dd h1 h2 h3 h4 h5 h6 figcaption".split())
CONTAINERS = frozenset("article main section div body td blockquote html".split())
#: Opening one of these ends an open paragraph.
ENDS_P = BLOCKS
BAD_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adbox|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|alert|popup|modal|"
    r"overlay|newsletter|subscribe|signup|sidebar|side|widget|menu|nav|navbar|navigation|breadcrumbs?|header|masthead|"
    r"footer|foot|comments?|commentlist|disqus|respond|replies|reply|related|recommend\w*|share|sharing|social|toolbar|"
    r"pagination|pager|tags|login|search)(?:$|[\s_-])",
    re.IGNORECASE,
)
#: Elements that a class or id may drop.
NAMED_TAGS = frozenset("center dd details div dl figure form header iframe li main ol section table tbody td tr ul".split())
#: Names of what no chapter of an article is about.
SURE_NAME = re.compile(
    r"(?:ads?|advert\w*|adsense|adbox|sponsor\w*|promo\w*|cookies?|consent|gdpr|popup|modal|overlay|newsletter|subscribe|signup|"
    r"sidebar|breadcrumbs?|comments?|commentlist|disqus|respond|replies|pagination|pager)",
    re.IGNORECASE,
)
#: Parts of a name that say nothing on the content.
PLAIN_PARTS = frozenset(
    "area articles bar block body bottom box button buttons container content form group icons inline inner items label left link "
    "links list media module nav outer panel pages post posts right row section site slot stories text thread title top unit "
    "widget widgets wrap wrapper".split()
)
GOOD_NAME = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|post|story|text)(?:$|[\s_-])", re.IGNORECASE)
#: A class that tells what a page has or lacks does not name the element.
STATE = re.compile(r"(?<!\S)(?:has|no|not|with|without)[_-]\S+", re.IGNORECASE)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SIBLING_SHARE, FEW_LINKS, MOST, ALL = 0.2, 0.25, 0.5, 0.9


class Node:
    __slots__ = ("tag", "parent", "children", "bad", "named", "unsure", "good", "inside", "bonus", "score", "chars", "linked")

    def __init__(self, tag: str, parent: Node | None, bad: bool = False, bonus: float = 0.0, named: bool = False) -> None:
        self.tag, self.parent, self.children, self.bad, self.bonus = tag, parent, [], bad, bonus
        self.named, self.unsure, self.good = named, False, bonus > 0.0
        self.inside = tag in ("article", "main") or (parent is not None and parent.inside)
        self.score, self.chars, self.linked = 0.0, 0, 0


def _named_bad(tag: str, attributes: str, inside: bool) -> tuple[bool, float, bool]:
    """Is the element boilerplate by its tag, role or style; its bonus; is it
    boilerplate by its class or id."""
    if tag in DROPPED or (tag == "header" and not inside):
        return True, 0.0, False
    bonus, named = 25.0 if tag in ("article", "main") else 0.0, tag == "form"
    if not attributes or tag in ("html", "body"):
        return False, bonus, named
    if HIDDEN.search(attributes):
        return True, 0.0, False
    for name, *values in ATTRIBUTE.findall(attributes):
        value = next(filter(None, values), "")
        name = name.lower()
        if name == "role":
            if value.lower() in DROPPED_ROLES:
                return True, 0.0, False
            bonus += 25.0 if value.lower() in ("main", "article") else 0.0
        elif name in ("class", "id") and tag not in ("article", "main"):
            named = named or (tag in NAMED_TAGS and _names_boilerplate(STATE.sub("", value), inside))
            bonus += 10.0 if GOOD_NAME.search(value) else 0.0
    return False, 0.0 if named else bonus, named


def _names_boilerplate(value: str, inside: bool) -> bool:
    """Does a class or id name boilerplate? Inside an article a word of it must do
    so in all of its parts."""
    if not inside:
        return BAD_NAME.search(value) is not None
    for word in value.split():
        parts = [x for x in re.split("[-_]+", word.lower()) if x]
        bad = [x for x in parts if BAD_NAME.search(x)]
        if bad and all(x in bad or x in PLAIN_PARTS or x.isdigit() for x in parts):
            return True
    return False


def _unsure(attributes: str) -> bool:
    """Could a chapter have these names as well?"""
    words = [next(filter(None, values), "") for name, *values in ATTRIBUTE.findall(attributes) if name.lower() in ("class", "id")]
    return not any(SURE_NAME.fullmatch(x) for word in words for x in re.split(r"[-_\s]+", word))


def parse(page: str) -> Node:
    """The tree of a page; text is a string child."""
    root = Node("html", None)
    node, at = root, 0
    open_tags: Counter[str] = Counter()

    def close(node: Node, last: Node) -> Node:
        """Ends all from node up to last."""
        while node is not last:
            open_tags[node.tag] -= 1
            node = node.parent
        open_tags[last.tag] -= 1
        return last.parent

    end = page.rfind(">") + 1  # beyond it no tag is whole
    for match in TOKEN.finditer(page, 0, end):
        if match.start() > at and not node.bad:
            node.children.append(page[at : match.start()])
        at = match.end()
        tag = match.group(3)
        if tag is None:
            if at == end and _open_to_the_end(match):
                at = len(page)
            continue
        tag = tag.lower()
        if match.group(2):  # an end tag closes up to its start, if there is one
            if open_tags[tag] > 0:
                up = node
                while up.tag != tag:
                    up = up.parent
                node = close(node, up)
            continue
        if tag == "html" or (tag == "body" and node is root):
            continue
        if tag in VOID:
            if not node.bad:
                node.children.append("\n" if tag == "br" else "" if tag == "wbr" else Node(tag, node))
            continue
        if tag in BLOCKS and node.bad:
            for kind in NO_BLOCKS:
                if open_tags[kind] > 0:
                    up = node
                    while up.tag != kind:
                        up = up.parent
                    node = close(node, up)
        if tag in ENDS_P:
            # li, td and the like end their own kind; any block ends an open p
            ended = {"p", tag, *(("dt", "dd") if tag in ("dt", "dd") else ())}
            if any(open_tags[t] > 0 for t in ended):
                up = node
                while up.parent is not None and up.tag not in CONTAINERS and up.tag not in ("ul", "ol", "table", "tr", "dl"):
                    if up.tag in ended:
                        node = close(node, up)
                        break
                    up = up.parent
            if tag in ("td", "th") and node.tag in ("td", "th"):
                node = close(node, node)
        bad, bonus, named = (True, 0.0, False) if node.bad else _named_bad(tag, match.group(4), node.inside)
        child = Node(tag, node, bad, bonus, named)
        child.unsure = named and node.inside and tag != "form" and _unsure(match.group(4))
        open_tags[tag] += 1
        if not bad:
            node.children.append(child)
        node = child
    if at < len(page) and not node.bad:
        cut = CUT_TAG.search(page, max(at, end))
        node.children.append(page[at : cut.start() if cut else len(page)])
    return root


def _open_to_the_end(match: re.Match) -> bool:
    """A comment or a script and the like that nothing ends."""
    text = match.group().lower()
    if text.startswith("<!--"):
        return not text.endswith("-->")
    kind = match.group(1)
    return kind is not None and re.search(rf"</{kind}\s*>\Z", text, re.IGNORECASE) is None


def _drop_named(root: Node) -> None:
    """Takes boilerplate by class or id out of the tree, except for what holds
    most of the unlinked text while no other part is named as content."""
    order, stack = [], [(root, False)]
    while stack:
        node, link = stack.pop()
        link = link or node.tag == "a"
        order.append((node, link))
        stack.extend((c, link) for c in node.children if not isinstance(c, str))
    if not any(node.named for node, _ in order):
        return
    own: dict[int, int] = {}  # unlinked characters of a node and all below it
    prose: dict[int, int] = {}  # those of its paragraphs
    for node, link in reversed(order):
        parts = [c for c in node.children if not isinstance(c, str)]
        size = 0 if link else sum(len(c.strip()) for c in node.children if isinstance(c, str))
        own[id(node)] = size + sum(own[id(c)] for c in parts)
        prose[id(node)] = own[id(node)] if node.tag == "p" else sum(prose[id(c)] for c in parts)
    full: dict[int, int] = {}  # linked characters too
    for node, _ in reversed(order):
        full[id(node)] = sum(len(c.strip()) if isinstance(c, str) else full[id(c)] for c in node.children)
        if node.unsure and prose[id(node)] > MOST * full[id(node)]:
            node.named = False
    page = own[id(root)]
    wraps: dict[int, bool] = {}  # a part named as content with most of the page's text lies in it
    for node, _ in reversed(order):
        wraps[id(node)] = any(
            not isinstance(c, str) and (wraps[id(c)] or (c.good and own[id(c)] > MOST * page)) for c in node.children
        )

    def most(node: Node) -> bool:
        if node.tag == "form":
            return prose[id(node)] > 0 and own[id(node)] > ALL * page
        return own[id(node)] > MOST * page

    def keep(wanted: Callable[[Node], bool]) -> list[Node]:
        left, stack = [], [root]
        while stack:
            node = stack.pop()
            left.append(node)
            node.children = [c for c in node.children if isinstance(c, str) or not c.named or wanted(c)]
            stack.extend(c for c in node.children if not isinstance(c, str))
        return left

    left = keep(most)
    above, below = {}, {}  # parts named as content around a node, and in it
    for node in left:
        above[id(node)] = 0 if node is root else above[id(node.parent)] + _counts(node.parent, own)
    for node in reversed(left):
        below[id(node)] = _counts(node, own) + sum(below[id(c)] for c in node.children if not isinstance(c, str))
    keep(lambda c: wraps[id(c)] or below[id(root)] == below[id(c)] + above[id(c)])


def _counts(node: Node, own: dict[int, int]) -> int:
    """1 for a part named as content that has text."""
    return int(node.good and own[id(node)] > 0)


def _measure(root: Node) -> None:
    """Characters, linked characters and scores of all nodes. A page may be as
    deep as it is long: a stack takes the place of recursion."""
    order, stack, commas = [], [(root, False)], {}
    while stack:
        node, link = stack.pop()
        order.append(node)
        link = link or node.tag == "a"
        commas[id(node)] = 0
        for child in node.children:
            if isinstance(child, str):
                size = len(child.strip())
                node.chars += size
                node.linked += size if link else 0
                commas[id(node)] += child.count(",") + child.count("，") + child.count("、")
            else:
                stack.append((child, link))
    for node in reversed(order):  # children before their parents
        up = node.parent
        if node is root:
            continue
        up.chars += node.chars
        up.linked += node.linked
        if not _is_paragraph(node):  # its commas count for the paragraph around it
            commas[id(up)] += commas[id(node)]
            continue
        points = (1.0 + commas[id(node)] + min(node.chars / 100.0, 3.0)) * (1.0 - node.linked / max(node.chars, 1))
        while up is not None and points > 0.01:  # half as much for each level
            up.bonus += points if up.tag in CONTAINERS else 0.0
            up, points = up.parent, points / 2.0
    for node in order:
        node.score = node.bonus * (1.0 - node.linked / node.chars) if node.chars else 0.0


def _is_paragraph(node: Node) -> bool:
    """A paragraph by its tag, or a container with text of its own."""
    if node.tag in PARAGRAPHS:
        return True
    return node.tag in CONTAINERS and any(isinstance(c, str) and len(c.strip()) > 25 for c in node.children)


def _blocks(node: Node, out: list[str]) -> None:
    """Texts of the blocks below node, in page order."""
    run: list[str] = []

    def flush() -> None:
        if run:
            text = SPACE.sub(" ", html_lib.unescape("".join(run))).strip()
            run.clear()
            if text:
                out.append(text)

    stack: list = [node]
    while stack:
        at = stack.pop()
        if at is None:
            flush()
        elif isinstance(at, str):
            run.append(at)
        else:
            block = at.tag in BLOCKS
            if block:
                flush()
                stack.append(None)
            stack.extend(reversed(at.children))
    flush()


def main_text(page: str | None) -> str:
    """The article of a page as text."""
    if not page:
        return ""
    root = parse(page)
    _drop_named(root)
    _measure(root)
    best, stack = root, [root]
    while stack:
        at = stack.pop()
        if at.tag in CONTAINERS and at.score > best.score:
            best = at
        stack.extend(c for c in at.children if not isinstance(c, str))
    top = best
    while top is not None and top.tag not in ("article", "main"):
        top = top.parent
    path, at = {id(best)}, best
    last = top or best.parent or best  # all of its blocks stay
    while at is not last:
        at = at.parent
        path.add(id(at))
    kept: list[Node | str] = []
    for sibling in last.parent.children if top is not None and last.parent is not None else [last]:
        if sibling is last:
            stack = [last]
            while stack:
                at = stack.pop()
                if isinstance(at, str) or id(at) not in path or at is best:
                    if at is best or not _mostly_links(at):
                        kept.append(at)
                else:
                    stack.extend(reversed(at.children))
        elif not isinstance(sibling, str) and sibling.chars:
            good = sibling.tag in CONTAINERS and sibling.score >= SIBLING_SHARE * best.score and sibling.score > 0
            few = sibling.linked / sibling.chars < FEW_LINKS
            if good or (few and sibling.tag in ("p", "pre", "blockquote", "article", "main")):
                kept.append(sibling)
    # neighbours in a line of text stay in one block
    whole = Node("div", None)
    whole.children = kept
    out: list[str] = []
    _blocks(whole, out)
    return "\n".join(out)


def _mostly_links(node: Node | str) -> bool:
    return not isinstance(node, str) and node.tag in BLOCKS and node.tag not in HEADINGS and node.linked > MOST * node.chars


def extract(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, url, text, n_chars: one row per page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [main_text(x.as_py()) for x in batch.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(texts, type=pa.string()),
                     pa.array([len(x) for x in texts], type=pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    slim = pages.select(
        pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"),
        F.col(html_col).cast("string").alias("html"),
    )
    return slim.mapInArrow(run, "page_id long, url string, text string, n_chars long")

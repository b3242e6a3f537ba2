"""Main text of web pages by tree scoring.

Blocks of text give points for their length and commas to the elements above them (all to the parent, half to the
grandparent, a falling share further up); an element's points are discounted by the share of its text that is links.
From the element with most points the search climbs while its container adds more text than links: headings, lists and
short sections beside the main paragraphs belong to the article.  Its blocks are kept but for parts that are mostly
links; at the page's top level, siblings of the article are kept that score enough or read like prose, and a heading
right before it.

Elements that HTML defines as no article text are left out.  One that only its tag, class, id or role names as furniture
is left out too unless it wraps the article: it holds nearly all of the page's text, or most of it and the page's main
heading.  Some names are doubtful; what bears one counts as furniture only with less than half of the text or many links.
Class words count whole (``has-sidebar`` or ``comments-open`` say something about the page, not what the element is).  A
heading block inside an article is part of it, and so is all that is linked there.

Cases: null or empty html gives the empty text; so does a page without any text outside removed elements.  Broken
markup (unclosed paragraphs, stray end tags, quotes inside unquoted values, a missing end of the page) is closed the way
browsers do for the elements concerned, at any depth of nesting.  Very long pages are read whole, with work in
proportion to their length.  Repeated rows are handled one by one.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed values of HTML: elements without content, elements whose content is not markup, and block elements.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table "
    "tbody td tfoot th thead tr ul".split()
)
#: Elements that are no article text.
DROPPED = frozenset(
    "head nav script style noscript iframe button select option textarea input svg canvas template object embed audio "
    "video noembed noframes xmp title".split()
)
#: Elements that are none unless they wrap the article.
NAMED = frozenset("header footer aside form dialog menu".split())
#: Words of class and id values that name page furniture.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices pager pagination "
    "popup promo promoted related replies reply respond share sharing sidebar social sponsor sponsored subscribe "
    "toolbar widget".split()
)
#: Of these words, those that also name parts of articles.
DOUBTFUL = frozenset("banner header masthead menu modal notice notices popup promo promoted related share sharing social toolbar widget".split())
#: Beginnings and ends of class words that tell a state of the page.
STATE = re.compile(r"^(?:has|no|with|without|is|show|hide|js)[-_]|[-_](?:open|closed|free|enabled|disabled|on|off|none|count)$")
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())

ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[\s/=]++|[^\s=/>]++(?:\s*+=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s>]++)?)?)*+)(?:>|\Z)",
    re.S,
)
#: Elements that can be left out of an article if they are mostly links.
LISTS = frozenset("ul ol dl div section table".split())
HEADING_TAGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Headings of lists of links that belong to a text.
SOURCES = re.compile(r"^\W*(?:sources?|references?|bibliography|footnotes|notes|further reading|quellen|literatur|fuentes|referencias|références|bibliographie)\b", re.I)
SPACES = re.compile(r"\s+")
COMMAS = re.compile("[,،、，]")


#: How sure it is that an element is furniture: no, always, unless it wraps the article, or in doubt.
NO, ALWAYS, UNLESS_WRAPPER, IN_DOUBT = range(4)
HEADINGS = ("h1", "h2", "h3")


@dataclass(eq=False)
class Node:
    tag: str
    parent: Node | None = None
    furniture: int = NO
    head: bool = False
    dropped: bool = False
    in_article: bool = False
    children: list[Node | str] = field(default_factory=list)
    points: float = 0.0
    chars: int = 0
    link_chars: int = 0
    headings: int = 0
    titles: int = 0


def _furniture(tag: str, attributes: str) -> tuple[int, bool]:
    """How sure it is that an element is page furniture, and whether that is for being a header."""
    if tag in DROPPED:
        return ALWAYS, False
    sure, head = (UNLESS_WRAPPER if tag in NAMED else NO), tag == "header"
    if not attributes or tag in ("html", "body", "article", "main"):
        return sure, head
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name in ("class", "id"):
            words = {w for token in value.split() if not STATE.search(token) for w in re.split(r"[^a-z]+", token)}
            if named := FURNITURE & words:
                head |= "header" in named
                sure = UNLESS_WRAPPER if sure == UNLESS_WRAPPER or not named <= DOUBTFUL else IN_DOUBT
        if name == "role" and value in FURNITURE_ROLES:
            sure = UNLESS_WRAPPER
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return ALWAYS, False
    return sure, head


#: Start tags that close an open element, and where the search for it ends.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}


class _Open:
    """The open elements, and at which depths each tag and the blocks stand."""

    def __init__(self):
        self.path, self.at, self.blocks = [Node("#root")], {}, [0]

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.path))
        if node.tag in BLOCK:
            self.blocks.append(len(self.path))
        self.path.append(node)

    def pop_to(self, depth: int) -> None:
        """Closes all elements at ``depth`` and below."""
        while len(self.path) > depth:
            node = self.path.pop()
            self.at[node.tag].pop()
            if node.tag in BLOCK:
                self.blocks.pop()

    def close(self, tags: set[str], until: set[str]) -> None:
        """Closes the outermost of ``tags`` that is open inside the innermost of ``until``."""
        limit = max((self.at[t][-1] for t in until if self.at.get(t)), default=0)
        found = [at[i] for t in tags if (at := self.at.get(t)) and (i := bisect_right(at, limit)) < len(at)]
        if found:
            self.pop_to(min(found))

    def end(self, tag: str) -> None:
        """Closes the nearest such element; text elements are not looked for outside their block."""
        if (at := self.at.get(tag)) and (tag in BLOCK or at[-1] > self.blocks[-1]):
            self.pop_to(at[-1])


#: Where the search for an open paragraph ends.
HOLD_PARAGRAPHS = {"article", "body", "div", "section", "li", "td", "th", "blockquote", "main", "aside", "form"}


def parse(page: str) -> Node:
    open_ = _Open()
    end, n = 0, len(page)
    while end < n:
        m = MARKUP.search(page, end)
        text = page[end : m.start() if m else n]
        if text:
            open_.path[-1].children.append(text)
        if not m:
            break
        end = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            open_.end(tag)
            continue
        if tag in BLOCK:
            open_.close({"p"}, HOLD_PARAGRAPHS)
        if tag in CLOSES:
            open_.close(*CLOSES[tag])
        above = open_.path[-1]
        node = Node(tag, above, *_furniture(tag, m[3]))
        node.dropped = node.furniture != NO
        node.in_article = above.in_article or above.tag in ("article", "main")
        above.children.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}[\s/>]", re.I).search(page, end)
            if close is None:
                break
            end = page.find(">", close.start())
            end = n if end < 0 else end + 1
            node.furniture, node.dropped = ALWAYS, True
        elif tag not in VOID and not m[3].endswith("/"):
            open_.push(node)
    return open_.path[0]


def _score(node: Node, seen: list[Node]) -> None:
    """Characters, link characters and headings below each element, and the points of the blocks that hold text themselves."""
    stack = [(node, False, iter(node.children), [])]
    while stack:
        node, in_link, rest, own = stack[-1]
        child = next(rest, None)
        if child is None:
            stack.pop()
            node.headings += node.tag in HEADINGS
            node.titles += node.tag in ("h1", "main")
            if stack:
                above = stack[-1][0]
                above.chars += node.chars
                above.link_chars += node.link_chars
                above.headings += node.headings
                above.titles += node.titles
            if (node.tag in BLOCK or node.tag == "#root") and own:
                text = SPACES.sub(" ", html.unescape("".join(own))).strip()
                if text:
                    _give(node, text)
            seen.append(node)
        elif isinstance(child, str):
            size = len(child.strip())
            node.chars += size
            node.link_chars += size * in_link
            own.append(child)
        elif child.tag == "br":
            own.append(" ")
        elif not child.dropped:
            # Text elements add to their block's text.
            stack.append((child, in_link or child.tag == "a", iter(child.children), [] if child.tag in BLOCK else own))


def _give(node: Node, text: str) -> None:
    """A point, one for each comma, and one for each hundred characters up to three; short lines give a fraction."""
    points = 1 + len(COMMAS.findall(text)) + min(len(text) / 100, 3) if len(text) >= 25 else len(text) / 100
    if node.tag in ("li", "dt", "dd", "h1", "h2", "h3", "h4", "h5", "h6", "caption", "figcaption"):
        points /= 2
    above, level = node.parent or node, 0
    while above is not None and level < 5:
        above.points += points / (1, 2, 6, 9, 12)[level]
        above, level = above.parent, level + 1


def _density(node: Node) -> float:
    return node.link_chars / node.chars if node.chars else 0.0


def _blocks(nodes: list[Node]) -> list[str]:
    """Texts of the blocks below ``nodes`` in page order."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = SPACES.sub(" ", html.unescape("".join(run))).strip()
        if text:
            out.append(text)
        run.clear()

    for top in nodes:
        stack: list[tuple[Node, Iterator]] = [(top, iter(top.children))]
        while stack:
            node, rest = stack[-1]
            child = next(rest, None)
            if child is None:
                stack.pop()
                if node.tag in BLOCK:
                    flush()
            elif isinstance(child, str):
                run.append(child)
            elif child.tag == "br":
                run.append(" ")
            elif not child.dropped:
                if child.tag in BLOCK:
                    flush()
                stack.append((child, iter(child.children)))
        flush()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    _settle(root)
    best = _best(root)
    if best is None:
        return "\n\n".join(_blocks([root]))
    if _drop_links(root, best):
        best = _best(root)
    while best.tag not in ("article", "main") and (above := best.parent) and above.tag not in ("#root", "html", "body"):
        if (above.link_chars - best.link_chars) * 2 > above.chars - best.chars:
            break
        best = above
    if best.parent is None or best.tag in ("html", "body"):
        return "\n\n".join(_blocks([best]))
    kept, heading = [], None
    for child in best.parent.children:
        if isinstance(child, str) or child.dropped or not child.chars:
            continue
        prose = child.tag == "p" and _density(child) < 0.25 and child.chars >= 80
        if child is best and heading is not None:
            kept.append(heading)
        # A section of its own beside an article that no tag names: a heading and text that is no links.
        section = best.tag not in ("article", "main") and child.headings and child.chars >= 60 and _density(child) < 0.25
        if child is best or child.points >= max(10.0, best.points * 0.2) or prose or section:
            kept.append(child)
        heading = child if child.tag in HEADINGS and _density(child) < 0.5 else None
    return "\n\n".join(_blocks(kept))


def _best(root: Node) -> Node | None:
    """The element with most points, after a fresh scoring; None where nothing has any."""
    seen: list[Node] = []
    _reset(root)
    _score(root, seen)
    for node in seen:
        node.points *= 1 - _density(node)
    best = max(seen, key=lambda x: x.points)
    return best if best.points > 0 else None


def _reset(root: Node) -> None:
    stack = [root]
    while stack:
        node = stack.pop()
        node.points, node.chars, node.link_chars, node.headings, node.titles = 0.0, 0, 0, 0, 0
        stack.extend(c for c in node.children if not isinstance(c, str) and not c.dropped)


def _settle(root: Node) -> None:
    """Decides which elements that may be furniture are none: those that wrap the article, and heads of articles."""
    open_, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.furniture in (UNLESS_WRAPPER, IN_DOUBT):
            open_.append(node)
            node.dropped = False
        stack.extend(c for c in node.children if not isinstance(c, str) and c.furniture != ALWAYS)
    if not open_:
        return
    _score(root, [])
    for node in open_:
        most, links = node.chars * 2 > root.chars, _density(node)
        if node.furniture == IN_DOUBT:
            kept = most and links <= 0.25
        else:
            kept = links <= 0.5 and (node.chars * 10 >= root.chars * 9 or most and node.titles > 0)
        kept |= node.head and node.in_article and node.headings > 0 and links <= 0.5
        node.dropped = not kept


def _drop_links(root: Node, best: Node) -> bool:
    """Drops parts that are mostly links, such as a list of pages beside the paragraphs.

    Never what holds ``best``, nothing inside an article, and no list under a heading that names sources.
    """
    holds, node = set(), best
    while node is not None:
        holds.add(id(node))
        node = node.parent
    stack, found = [root], False
    while stack:
        before = None
        for child in stack.pop().children:
            if isinstance(child, str) or child.dropped:
                continue
            sources = before is not None and before.tag in HEADING_TAGS and SOURCES.search(" ".join(_blocks([before])))
            if child.tag in LISTS and id(child) not in holds and child.chars >= 40 and _density(child) > 0.6 and not sources:
                child.dropped = found = True
            elif child.tag != "article":
                stack.append(child)
            before = child
    return found


def extract_text(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """Adds ``text`` and ``n_chars`` (code points) in place of the html column."""
    keep = [f for f in pages.schema.fields if f.name not in (html_column, "text", "n_chars")]
    columns = [f.name for f in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "text string", "n_chars long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [main_text(x.as_py()) for x in batch.column(html_column)]
                arrays = [batch.column(c) for c in columns]
                arrays += [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, [*columns, "text", "n_chars"])

    return pages.select(*columns, html_column).mapInArrow(run, schema)

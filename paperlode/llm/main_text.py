"""The main text of web pages by tree scoring.

A page becomes a tree of its block elements with blocks of text below them. Elements that never hold the article (by
tag, role or name) go with all they hold. Each block passes points for its length and commas to the elements above it,
half of them a level up and less further up; an element's points are discounted by the share of its text that is links.
The best element and those of its siblings that read like it are kept.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .token_ids import groups

#: Elements without an end tag, elements whose content is no markup, and elements that begin and end blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td "
    "tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks that hold text themselves; other blocks hold blocks, and text right below them counts as a paragraph of theirs.
LEAVES = HEADINGS | frozenset("p pre li dt dd td th figcaption caption summary address blockquote".split())
#: Elements that never hold the article.
DROPPED = frozenset("head nav footer aside form script style title textarea noscript template iframe noembed noframes svg button select input dialog menu search object canvas audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Words of class names and ids of menus, headers, footers, sidebars, notices, adverts, forms and reader comments.
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner billboard promo promos promoted promotion sponsor sponsored sponsors outbrain taboola "
    "menu menus nav navbar navigation navi topnav subnav breadcrumb breadcrumbs crumbs pager pagination paging toc skip "
    "header masthead topbar footer foot bottombar copyright colophon legal sidebar sidebars side aside rail widget widgets "
    "cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay lightbox toast paywall newsletter subscribe subscription signup login signin register "
    "form search searchbox comment comments commentlist respond reply replies disqus discussion feedback "
    "share sharing social socials follow related recommended recommendations recirc teasers trending popular hidden".split()
)
#: Words beside which a name speaks of the page's layout, not of noise.
LAYOUT = frozenset("has with no without content main article body page wrapper container post entry text story layout".split())
#: End tags that a start tag implies: name -> (elements that it closes, elements beyond which it does not look).
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "thead": (("thead", "tbody", "tfoot"), ("table",)), "tbody": (("thead", "tbody", "tfoot"), ("table",)), "tfoot": (("thead", "tbody", "tfoot"), ("table",)),
}

_QUOTED = re.compile(r"""[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>""")
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def tags(html: str):
    """(kind, name, text): `text` with text, `open` with the tag's attributes, or `close`. Linear in the page."""
    at, end, quoted = 0, len(html), True
    while at < end:
        lt = html.find("<", at)
        if lt < 0 or lt + 1 >= end:
            yield "text", "", html[at:]
            return
        nxt = html[lt + 1]
        closing = nxt == "/"
        name = _NAME.match(html, lt + 1 + closing)
        if not name and not closing and nxt not in "!?":
            yield "text", "", html[at : lt + 1]  # a plain <
            at = lt + 1
            continue
        if lt > at:
            yield "text", "", html[at:lt]
        if html.startswith("<!--", lt):
            stop = html.find("-->", lt + 4)
            at = end if stop < 0 else stop + 3
            continue
        close = _QUOTED.match(html, name.end()) if name and quoted else None
        if name and not close:
            quoted = False  # a quote is left open: from here on a tag ends at the next >
        stop = close.end() if close else html.find(">", lt) + 1
        if not stop:
            return
        at = stop
        if name:
            tag = name[0].lower()
            yield ("close" if closing else "open"), tag, html[name.end() : stop - 1]
            if not closing and tag in RAW:
                rest = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, at)
                if tag == "textarea" and not rest:
                    continue
                at = rest.start() if rest else end


def is_noise(tag: str, attributes: str) -> bool:
    """Whether an element never holds the article, by its tag, role, visibility, class or id."""
    if tag in DROPPED:
        return True
    if not attributes or tag in ("html", "body", "main", "article"):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "role" and value.lower() in ROLES or key == "hidden" and value.lower() != "until-found" or key == "aria-hidden" and value.lower() == "true":
            return True
        if key == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if key in ("class", "id"):
            for name in value.split():
                words = {w.lower() for w in _WORDS.findall(name)}
                if words & NOISE and not words & LAYOUT:
                    return True
    return False


class Node:
    """An element, with what it holds in order: elements, and blocks of text."""

    __slots__ = ("tag", "up", "block", "noise", "below", "holder", "score", "length", "linked", "links")

    def __init__(self, tag: str, up: Node | None, noise: bool):
        self.tag, self.up, self.block, self.noise, self.below = tag, up, tag in BLOCKS, noise, []
        self.holder = tag in ("article", "main") or bool(up and up.holder)  # stands in an article
        self.score, self.length, self.linked, self.links = 0.0, 0, 0, 0


class Block:
    """A stretch of text without a block inside; `linked` characters of it are links."""

    __slots__ = ("up", "text", "linked", "links")

    def __init__(self, up: Node, text: str, linked: int, links: int):
        self.up, self.text, self.linked, self.links = up, text, linked, links


def tree(html: str) -> tuple[list[Node], list[Block]]:
    """The page's block elements, outer ones first, and all its blocks outside noise, both in page order."""
    root = Node("html", None, False)
    open_, nodes, blocks = [root], [root], []
    words: list[str] = []
    links: list[str] = []
    here, n_links, in_link = root, 0, 0  # in_link: open links

    def flush() -> None:
        nonlocal n_links
        if words:
            text = " ".join(unescape("".join(words)).split())
            if text:
                block = Block(here, text, min(len(text), len(" ".join(unescape("".join(links)).split()))), n_links)
                here.below.append(block)
                blocks.append(block)
        words.clear()
        links.clear()
        n_links = 0

    def pop(to: int) -> None:
        nonlocal here, in_link
        for n in open_[to:]:
            if n.block:
                flush()
                here = n.up
                break
        in_link -= sum(n.tag == "a" for n in open_[to:])
        del open_[to:]

    for kind, tag, text in tags(html):
        if kind == "text":
            if not open_[-1].noise:
                words.append(text)
                if in_link:
                    links.append(text)
        elif kind == "open":
            if tag == "br":
                words.append(" ")
                continue
            if tag in BLOCKS:
                for i in range(len(open_) - 1, 0, -1):  # a block ends the paragraph around it
                    if open_[i].tag == "p":
                        pop(i)
                        break
                    if open_[i].block:
                        break
            if tag in IMPLIED:
                ended, beyond = IMPLIED[tag]
                for i in range(len(open_) - 1, 0, -1):
                    if open_[i].tag in ended:
                        pop(i)
                        break
                    if open_[i].tag in beyond:
                        break
            if tag in ("html", "body"):
                continue  # the page as a whole
            if tag in BLOCKS:
                flush()
            if tag in VOID:
                continue
            header = tag == "header" and not here.holder
            node = Node(tag, here, open_[-1].noise or header or is_noise(tag, text))
            if node.block:
                here.below.append(node)
                nodes.append(node)
                here = node
            elif tag == "a":
                in_link += 1
                n_links += 1
            open_.append(node)
        else:
            for i in range(len(open_) - 1, 0, -1):
                if open_[i].tag == tag:
                    pop(i)
                    break
                if open_[i].block and tag not in BLOCKS and tag not in RAW:
                    break  # an inline end tag does not reach out of its block
    flush()
    return nodes, blocks


def density(node: Node) -> float:
    return node.linked / node.length if node.length else 0.0


#: Levels up to which points are passed.
REACH = 12


def score(nodes: list[Node], blocks: list[Block]) -> None:
    """Points of all blocks to the elements above them, and lengths of text and links."""
    for b in blocks:
        points = (1 + b.text.count(",") + b.text.count("，") + min(len(b.text) / 100, 3)) * (1 if len(b.text) >= 25 else 0.2)
        points *= 1 - b.linked / len(b.text)
        node, level = (b.up.up if b.up.tag in LEAVES and b.up.up else b.up), 0
        while node and level < REACH:
            node.score += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            node, level = node.up, level + 1
        b.up.length += len(b.text)
        b.up.linked += b.linked
        b.up.links += b.links
    for node in reversed(nodes[1:]):
        node.up.length += node.length
        node.up.linked += node.linked
        node.up.links += node.links


def worth(node: Node) -> float:
    return node.score * (1 - density(node)) * (3 if node.tag == "article" else 2 if node.tag == "main" else 1)


def is_menu(node: Node) -> bool:
    """Whether an element without a meaning of its own is a list of links."""
    return node.tag in ("ul", "ol", "div", "table", "section", "dl") and node.links >= 3 and density(node) > 0.7


def read(node: Node, prune: bool) -> list[str]:
    """The text of a kept element, block by block."""
    found, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, Block):
            found.append(x.text)
        elif not x.noise and not (prune and is_menu(x)):
            if x.tag == "header":  # of an article: its headings
                todo += [c for c in reversed(x.below) if isinstance(c, Node) and c.tag in HEADINGS | {"hgroup"}]
            else:
                todo += reversed(x.below)
    return found


def main_text(html: str) -> str:
    """The blocks of the page's article, one a line; empty if there are none."""
    nodes, blocks = tree(html)
    if not blocks:
        return ""
    score(nodes, blocks)
    # the first of equals, which is the outer one
    best = max((n for n in nodes if not n.noise and (n.tag not in LEAVES or n.tag in ("td", "blockquote"))), key=worth)
    meant = best.tag in ("article", "main")
    if not best.up:
        return "\n".join(read(best, not meant))
    least, found = 0.2 * worth(best), []
    heading = any(isinstance(c, Node) and c.tag in HEADINGS for c in best.below)
    siblings = best.up.below
    place = siblings.index(best)
    for k, c in enumerate(siblings):
        if c is best:
            found += read(c, not meant)
        elif isinstance(c, Block):
            if not meant and len(c.text) > 80 and c.linked < 0.25 * len(c.text):
                found.append(c.text)
        elif c.noise or c.tag == "header":
            continue
        elif c.tag in HEADINGS:
            if k + 1 == place and not heading:
                found += read(c, True)
        elif c.tag in LEAVES:
            if c.length > 80 and density(c) < 0.25 and (not meant or best.up.tag in ("main", "article")):
                found += read(c, True)
        elif c.tag == best.tag and worth(c) >= least and density(c) < 0.25:
            found += read(c, not meant)
    return "\n".join(found)


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text (its main text, empty if there is none), n_chars (code points of it).

    pages: page_id, url, html (null: empty); other columns are left out, rows may repeat, null ids and urls stay null.
    White space, no-break spaces too, becomes one space inside a block; a line break inside a paragraph is such space.
    Markup need not be well-formed: unclosed elements end where their parent ends, an open quote or comment takes the
    rest of its tag or of the page. Every page is read whole, however long it is.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        for batch in batches:
            for a, b in groups(batch):
                texts = [main_text(h) if h else "" for h in batch.column(2).slice(a, b - a).to_pylist()]
                yield pa.record_batch([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")

"""Main text of web pages by tree scoring (operator 5).

Each page becomes a small tree. Blocks of text give points for their length and
commas to the containers above them, in full to the parent, half to the next,
less further up; a container's sum is discounted by its share of linked text.
The best container is kept, widened to the article that holds it, with siblings
that score well enough, paragraphs beside it and the heading that leads it. What
stands in menus, headers, footers, sidebars, notices, adverts, forms and reader
comments takes no part. Words of class names that articles use too (a dinner's
menu, a storm alert) set aside only what is mostly links, if it lies inside an
article or is itself a heading, a paragraph or the like.

Defined cases: a null or empty html, and one without text, give an empty text;
unclosed, crossed and cut-off tags are closed as browsers do in the common
cases; repeated rows are extracted one by one; an empty table gives an empty
result; other columns are ignored. Pages are independent; nothing is shuffled.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset((
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr").split())
#: Elements that never hold main text.
DROPPED = frozenset((
    "head title script style noscript template nav footer aside form button select option textarea input iframe object "
    "embed svg canvas audio video map dialog menu frameset noframes datalist").split())
#: Roles, and words in class or id, of parts that aren't main text.
ROLES = frozenset("navigation banner contentinfo complementary dialog alertdialog alert search menu menubar form toolbar".split())
WORDS = frozenset((
    "ad ads advert adverts advertisement advertising adbox adsense banner sponsor sponsored promo promotion cookie cookies "
    "consent gdpr notice popup modal overlay sidebar aside comment comments commentlist disqus respond replies share "
    "sharing social related recommended breadcrumb breadcrumbs menu nav navbar navigation footer masthead pagination "
    "pager newsletter subscribe subscription signup login toolbar widget skip hidden alert").split())
#: Those of them that name containers, and texts, of articles as well.
DOUBTFUL_PARTS, DOUBTFUL_TEXTS = frozenset(["menu"]), frozenset(["menu", "alert", "skip"])
#: Elements that are text themselves rather than a part of the page.
TEXTUAL = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre li dt dd td th tr figure figcaption caption".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
ENDED = re.compile(r"[.!?\u2026][\"'\u2019\u201d\u00bb)]*$")
#: Words of names that say what an element lies beside or without, not what it is.
ABOUT = frozenset("has have with without no".split())
#: Words of names of main text; one such class outweighs others ("main-content has-sidebar").
CONTENT = frozenset("article content main post entry story body text".split())
#: A start tag of the key closes an open element of the set, if no element of
#: the scope stands between.
CLOSES = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
SCOPE = frozenset("html body article main section div ul ol dl table blockquote aside nav footer header form td th li".split())
TOKENS = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "parent", "children", "dropped", "content", "points", "size", "linked")

    def __init__(self, tag: str, parent: Node | None, dropped: bool, content: bool = False):
        self.tag, self.parent, self.dropped, self.content = tag, parent, dropped, content
        self.children: list = []  # nodes and texts in page order
        self.points, self.size, self.linked = 0.0, 0, 0


def named(attributes) -> list[list[str]]:
    """The words of each class and of the id."""
    return [TOKENS.findall(part) for name, value in attributes if name in ("class", "id") for part in (value or "").lower().split()]


def set_aside(tag: str, attributes) -> bool:
    """Whether an element holds something else than main text, whatever it says."""
    if tag in DROPPED:
        return True
    if tag in ("html", "body", "main"):
        return False
    for name, value in attributes:
        value = (value or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def other_part(names: list[list[str]], words: frozenset) -> bool:
    """Whether one of the names has one of the words and no other name speaks for main text."""
    aside = [not WORDS.isdisjoint(name) for name in names]
    return any(not words.isdisjoint(name) and ABOUT.isdisjoint(name) for name in names) and not any(
        not a and not CONTENT.isdisjoint(name) for a, name in zip(aside, names, strict=True))


class Tree(HTMLParser):
    """Builds the tree; elements set aside keep no children."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", None, False)
        self.doubtful: list[Node] = []

    def handle_starttag(self, tag, attributes):
        if tag not in INLINE:
            if tag in CLOSES:
                self.end_open(CLOSES[tag], SCOPE - CLOSES[tag])
            else:
                self.end_open(("p",), SCOPE)
        if tag in VOID:
            self.at.children.append(" ")
            return
        # A page's header is set aside; one inside an article holds its title.
        dropped = self.at.dropped or set_aside(tag, attributes) or tag == "header" and not self.inside("article")
        names = named(attributes) if tag not in ("html", "body", "main") and not dropped else []
        doubt = False
        if names and other_part(names, WORDS):
            doubtful = DOUBTFUL_TEXTS if tag in TEXTUAL else DOUBTFUL_PARTS if self.at.content else frozenset()
            doubt = not other_part(names, WORDS - doubtful)
            dropped = not doubt
        content = not dropped and (self.at.content or tag in ("article", "main") or any(
            WORDS.isdisjoint(name) and not CONTENT.isdisjoint(name) for name in names))
        node = Node(tag, self.at, dropped, content)
        if doubt:
            self.doubtful.append(node)
        self.at.children.append(node)
        self.at = node

    def inside(self, tag: str) -> bool:
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        return node is not None

    def end_open(self, tags, scope) -> None:
        node = self.at
        while node.parent is not None and node.tag not in tags:
            if node.tag in scope:
                return
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            if tag in INLINE and node.tag not in INLINE:
                return  # a stray end of formatting closes no block
            node = node.parent
        if node.parent is not None:
            self.at = node.parent
        elif tag == "p":
            self.at.children.append(" ")

    def handle_data(self, data):
        if not self.at.dropped:
            self.at.children.append(data)


def parse(html: str) -> Node:
    tree = Tree()
    tree.feed(html)
    HTMLParser.close(tree)
    for node in reversed(tree.doubtful):
        own = blocks(node)
        node.dropped = 2 * sum(linked for _, _, linked in own) >= sum(len(text) for _, text, _ in own)
    return tree.root


def blocks(node: Node):
    """(owner, text, linked characters) of each block of text below a node, in
    page order; text directly in a container is a block of that container."""
    out, run, linked = [], [], [0]

    def flush(owner):
        text = " ".join("".join(run).split())
        if text:
            out.append((owner, text, min(linked[0], len(text))))
        run.clear()
        linked[0] = 0

    # An explicit stack: pages may nest deeper than Python's calls may.
    stack = [(node, iter(node.children), node, False)]
    while stack:
        here, rest, owner, in_link = stack[-1]
        for child in rest:
            if isinstance(child, str):
                run.append(child)
                if in_link:
                    linked[0] += len(child.strip())
            elif not child.dropped:
                if child.tag in INLINE:
                    stack.append((child, iter(child.children), owner, in_link or child.tag == "a"))
                else:
                    flush(owner)
                    stack.append((child, iter(child.children), child, in_link))
                break
        else:
            stack.pop()
            if here.tag not in INLINE:
                flush(owner)
    return out


def main_text(html: str) -> str:
    """The main text: blocks in page order, one per line."""
    found = blocks(parse(html))
    if not found:
        return ""
    scored = {}
    for owner, text, linked in found:
        points = 1 + text.count(",") + min(len(text) / 100, 3)
        if owner.tag in (*HEADINGS, "th"):
            points = 0.5
        holder = owner if owner.tag in ("div", "section", "article", "main", "body", "#root") else owner.parent
        level, node = 0, holder
        while node is not None:
            node.points += points / (1, 2)[level] if level < 2 else points / (3 * level)
            node.size += len(text)
            node.linked += linked
            scored[id(node)] = node
            level, node = level + 1, node.parent
    worth = lambda n: n.points * (1 - n.linked / max(1, n.size))
    best = max(scored.values(), key=worth)
    node, article = best, None
    while node is not None:
        if node.tag == "article" or node.tag == "main" and article is None:
            article = node
        node = node.parent
    if article is not None:
        best = article
    kept = [best]
    if best.parent is not None and best.tag not in ("body", "main"):
        least = max(10.0, 0.2 * worth(best))
        beside = [s for s in best.parent.children if isinstance(s, Node) and not s.dropped and s is not best]
        if best.tag == "article":
            beside = [s for s in beside if s.tag == "article"]
        kept += [s for s in beside if id(s) in scored and worth(s) >= least or s.tag == "p" and prose(s)]
    chosen = {id(n) for n in kept}
    within = []
    for owner, _, _ in found:
        node = owner
        while node is not None and id(node) not in chosen:
            node = node.parent
        within.append(node is not None)
    first = within.index(True)
    for i in range(lead(found, first), first):
        within[i] = True
    return "\n".join(text for (_, text, _), inside in zip(found, within, strict=True) if inside)


def lead(found: list, first: int) -> int:
    """Where the headings start that lead the block at ``first``: those right before
    it that are hardly linked."""
    at = first
    while at and found[at - 1][0].tag in HEADINGS and 2 * found[at - 1][2] < len(found[at - 1][1]):
        at -= 1
    return at


def prose(node: Node) -> bool:
    """A paragraph beside the best container: long and hardly linked, or a sentence
    without a link."""
    own = blocks(node)
    size, linked = sum(len(text) for _, text, _ in own), sum(linked for _, _, linked in own)
    return linked < 0.25 * size if size > 80 else bool(own) and not linked and bool(ENDED.search(own[-1][1]))


def extract(pages: DataFrame) -> DataFrame:
    """Main text of every page."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(h or "") for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")

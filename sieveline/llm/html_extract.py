"""HTML extraction by tree scoring: text blocks pass points to their ancestors, and the best container is kept.

A page is read into a light tree. Each paragraph's points (its length and its commas) go whole to its parent, half to
its grandparent and on by thirds; a container's sum is discounted by the share of its text inside links. The best
container is kept with siblings that score well enough. Parts that are no article (menus, footers, notices and so on) are
left out by tag, role or name before any scoring.
"""

from __future__ import annotations

import re
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tags without content, tags whose content is no text, tags that are never article, and block tags.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe object svg math canvas audio video head select".split())
SKIPPED = frozenset("nav header footer aside form button menu dialog fieldset".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Names (of class or id) of parts that are no article, matched as whole parts of a name.
UNWANTED = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|banner|breadcrumb|breadcrumbs|comment|comments|commentlist|cookie|cookies|consent|dialog|disqus|footer|gdpr|header|menu|modal|nav|navbar|navigation|newsletter|notice|notices|overlay|pager|pagination|popup|promo|promotion|related|replies|reply|responses|share|sharing|sidebar|signup|social|sponsor|sponsored|subscribe|subscription|toolbar|widget|widgets)(?:$|[\s_-])",
    re.I,
)
#: Parts of a longer name that tell of a page's layout as often as of a part that is no article: "has-sidebar", "with-header".
LAYOUT = re.compile(r"^(?:banner|breadcrumbs?|footer|header|menu|nav|navbar|navigation|notices?|share|sharing|sidebar|social|toolbar|widgets?)$", re.I)
#: Paragraphs by tag; other runs of text are paragraphs from so many characters on.
PARAGRAPHS, LONG_RUN = frozenset("p pre blockquote".split()), 80
#: A paragraph's points reach so many ancestors, and an end of a list item or cell is looked for among so many.
REACH = 24
#: A spared part has at most this share of its paragraphs in links.
SPARED_LINKS = 1 / 3
UNWANTED_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog form toolbar".split())
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ATTRS = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_ENDS = {tag: re.compile(r"</head|<body" if tag == "head" else f"</{tag}", re.I) for tag in RAW}
_SPACE = re.compile(r"\s+")
#: A tag that closes an open p; list items, cells and definitions close their own kind.
_SELF_CLOSING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


class Node:
    """An element. `block` is the nearest block around it, itself included, and `part` the nearest part that may be hidden."""

    __slots__ = ("tag", "parent", "children", "hidden", "points", "named", "soft", "block", "part", "inline", "chars", "links", "kept", "marked")

    def __init__(self, tag: str, parent: "Node | None", hidden: bool = False, named: str = "", soft: str = ""):
        self.tag, self.parent, self.hidden, self.named = tag, parent, hidden, named
        self.children: list[Node | str] = []
        self.points, self.chars, self.links = 0.0, 0, 0
        self.soft = "" if hidden else soft
        self.block: Node = self if parent is None or tag in BLOCKS else parent.block
        self.part: Node | None = self if self.soft else parent.part if parent else None
        #: Of a block: how many elements of each inline tag are open in it.
        self.inline: dict[str, int] = {}
        self.kept = self.marked = False


def _unwanted(tag: str, attrs: str) -> tuple[bool, str, str]:
    """Whether a part is hidden for good, its names, and why it is hidden unless it holds the article: form, layout or name."""
    if tag in SKIPPED and tag != "form":
        return True, "", ""
    soft = "form" if tag == "form" else ""
    if not attrs or attrs.isspace():
        return False, "", soft
    found = {k.lower(): unescape(a or b or c or "") for k, a, b, c in _ATTR.findall(attrs)}
    names = f"{found.get('class', '')} {found.get('id', '')}"
    style = found.get("style", "").replace(" ", "").lower()
    hidden = (
        "hidden" in found or found.get("aria-hidden") == "true" or found.get("role", "").lower() in UNWANTED_ROLES
        or "display:none" in style or "visibility:hidden" in style
    )
    whole = tag in ("html", "body", "article", "main")
    if not whole and UNWANTED.search(names):
        words = [w for w in names.split() if UNWANTED.search(w)]
        parts = [x for w in words for x in re.split("[_-]", w) if UNWANTED.search(x)]
        named = any(UNWANTED.fullmatch(w) for w in words) or not all(map(LAYOUT.match, parts))
        soft = "name" if named else soft or "layout"
    return hidden, names, soft


def parse(page: str) -> list[Node]:
    """The elements of a page in order, its root first: a light tree, as tolerant of unclosed and misplaced tags as browsers are.

    Time grows with the page's length, however its tags are nested. An attribute's quote that nothing closes ends with
    its tag; an element whose content is no text, and which nothing closes, holds nothing (script and style hold the rest).
    """
    root = at = Node("#root", None)
    nodes, pos, end = [root], 0, len(page)
    open_blocks: dict[str, int] = {}
    endless: set[str] = set()  # tags without content whose end does not come any more

    def close(to: Node) -> Node:
        """Close all open elements up to `to` and return what is open then."""
        node = at
        while True:
            counts = open_blocks if node.block is node else node.block.inline
            counts[node.tag] -= 1
            if node is to:
                return node.parent
            node = node.parent

    while pos < end:
        start = page.find("<", pos)
        if start < 0:
            at.children.append(page[pos:])
            break
        if start > pos:
            at.children.append(page[pos:start])
        if page.startswith(("<!", "<?"), start):
            mark = "-->" if page.startswith("<!--", start) else ">"
            pos = page.find(mark, start + 2)
            if pos < 0:
                if mark == ">":
                    at.children.append(page[start:])
                break
            pos += len(mark)
            continue
        m = _TAG.match(page, start)
        if not m:
            at.children.append("<")
            pos = start + 1
            continue
        stop = _ATTRS.match(page, m.end()).end()
        if stop == end or page[stop] != ">":
            stop = page.find(">", m.end())
            if stop < 0:
                at.children.append(page[start:])
                break
        tag, attrs, pos = m[2].lower(), page[m.end() : stop], stop + 1
        if m[1]:
            if tag in BLOCKS:
                if open_blocks.get(tag):
                    node = at.block
                    while node.tag != tag:
                        node = node.parent.block
                    at = close(node)
                elif tag == "p":
                    nodes.append(Node("p", at))
                    at.children.append(nodes[-1])
            elif at.block.inline.get(tag):  # an inline end tag does not close blocks around it
                node = at
                while node.tag != tag:
                    node = node.parent
                at = close(node)
            continue
        if tag in RAW:
            if tag not in ("svg", "math") or not attrs.rstrip().endswith("/"):
                found = None if tag in endless else _ENDS[tag].search(page, pos)
                if found:
                    pos = found.start()
                else:
                    endless.add(tag)
                    pos = end if tag in ("script", "style") else pos
            continue
        if tag == "br":
            at.children.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                nodes.append(Node("hr", at))
                at.children.append(nodes[-1])
            continue
        if tag in BLOCKS:
            if at.block.tag == "p" or at.block.tag in HEADINGS and tag in HEADINGS:
                at = close(at.block)
            closes, node = _SELF_CLOSING.get(tag), at
            for _ in range(REACH if closes else 0):
                if node is root or node.tag in ("ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "div", "article", "body"):
                    break
                above = node.parent
                if node.tag in closes:
                    at = close(node)
                    if tag != "tr":
                        break
                node = above
        child = Node(tag, at, *_unwanted(tag, attrs))
        nodes.append(child)
        at.children.append(child)
        if not attrs.rstrip().endswith("/"):
            at = child
            counts = open_blocks if child.block is child else child.block.inline
            counts[tag] = counts.get(tag, 0) + 1
    if any(n.soft for n in nodes):
        _hide(nodes)
    return nodes


def _hide(nodes: list[Node]) -> None:
    """Hide forms and parts with unwanted names, but spare those that hold the article.

    Forms and parts that are named for the layout are spared if their paragraphs are the larger part of the page's, with
    few links. Others must hold ten times the paragraphs that no such part holds, and an article's own tag or title.
    """
    own: dict[int, int] = {}
    linked: dict[int, int] = {}
    total = outside = 0
    for node, text, links in blocks_of(nodes[0]):
        if node.tag not in PARAGRAPHS and len(text) < LONG_RUN:
            continue
        total += len(text)
        if node.part is None:
            outside += len(text)
        else:
            own[id(node.part)] = own.get(id(node.part), 0) + len(text)
            linked[id(node.part)] = linked.get(id(node.part), 0) + links
    for node in reversed(nodes[1:]):  # inner parts come before those around them
        if node.soft:
            size, links = own.get(id(node), 0), linked.get(id(node), 0)
            holds = size > 10 * outside and node.marked if node.soft == "name" else 2 * size > total
            node.hidden = not (size and holds and links <= SPARED_LINKS * size)
            around = node.parent.part
            if not node.hidden and around is not None:
                own[id(around)] = own.get(id(around), 0) + size
                linked[id(around)] = linked.get(id(around), 0) + links
        # An article's own tag or a title of the first level is seen from outside if nothing between is hidden.
        if not node.hidden and (node.marked or node.tag in ("article", "main", "h1")):
            node.parent.marked = True


def blocks_of(root: Node) -> list[tuple[Node, str, int]]:
    """(nearest block node, text, characters inside links) of each run of text between block borders, in page order."""
    out: list[tuple[Node, str, int]] = []
    run: list[str] = []
    state = {"owner": root, "links": 0}

    def flush(owner: Node) -> None:
        if run:
            text = _SPACE.sub(" ", unescape("".join(run))).strip()
            if text:
                out.append((state["owner"], text, min(state["links"], len(text))))
            run.clear()
        state["owner"], state["links"] = owner, 0

    stack: list[tuple[Node, Node, int, int]] = [(root, root, 0, 0)]  # node, nearest block, next child, links around
    while stack:
        node, owner, i, linked = stack.pop()
        if i >= len(node.children):
            if node.tag in BLOCKS and stack:
                flush(stack[-1][1])
            continue
        stack.append((node, owner, i + 1, linked))
        child = node.children[i]
        if isinstance(child, str):
            run.append(child)
            if linked:
                state["links"] += len(child.strip())
        elif child.hidden:
            if child.tag in BLOCKS:
                flush(owner)
        elif child.tag in BLOCKS:
            flush(child)
            stack.append((child, child, 0, linked))
        else:
            stack.append((child, owner, 0, linked or child.tag == "a"))
    flush(root)
    return out


def main_text(page: str | None) -> str:
    """The article's blocks in page order, one to a line; empty if there are none."""
    if not page:
        return ""
    nodes = parse(page)
    found = blocks_of(nodes[0])
    if not found:
        return ""
    for owner, text, linked in found:
        owner.chars += len(text)
        owner.links += linked
        points = 0.0 if owner.tag in HEADINGS else 1 + text.count(",") + text.count("،") + text.count("、") + min(len(text) / 100, 3)
        up = owner if owner.tag not in ("p", "pre", "blockquote", "li", "td") else owner.parent or owner
        for level in range(REACH):
            up.points += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            up = up.parent
            if up is None:
                break
    for node in reversed(nodes[1:]):
        node.parent.chars += node.chars
        node.parent.links += node.links
    score = lambda n: (n.points + (25 if n.tag in ("article", "main") else 0)) * (1 - n.links / max(1, n.chars))
    texted = [n for n in nodes if n.chars]
    best = max((n for n in texted if n.tag != "#root"), key=score, default=nodes[0])
    # The whole page around several articles or sections of like score is the container.
    best.kept = True
    if best.parent is not None:
        bar = max(10.0, 0.2 * score(best))
        for sibling in best.parent.children:
            if isinstance(sibling, Node) and sibling.chars and sibling is not best:
                size, density = sibling.chars, sibling.links / sibling.chars
                alike = 0.2 * score(best) if sibling.named and sibling.named == best.named else 0
                if score(sibling) + alike >= bar or sibling.tag == "p" and (size > 80 and density < 0.25 or size <= 80 and density == 0) or sibling.tag in HEADINGS and best.tag not in ("article", "main"):
                    sibling.kept = True
    for node in nodes[1:]:
        node.kept = node.kept or node.parent.kept
    loose = best.parent is not None and best.tag not in ("article", "main", "body", "html")
    return "\n".join(text for owner, text, linked in found if owner.kept or loose and owner is best.parent and linked == 0)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    Null, empty or textless html has an empty text. Whole pages are read, however long; repeated rows are treated
    alike, each in its own row; extra columns are ignored; an empty table gives no rows.
    """

    def run(batches):
        for b in batches:
            texts = [main_text(h) for h in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInPandas(run, "page_id long, url string, text string, n_chars long")

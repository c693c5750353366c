"""Main text of web pages by tree scoring.

Each paragraph gives its ancestors points for its length and its commas, less from level to level.
A container's points are discounted by its link density; the best container and those of its
siblings that read like more of the article are kept. What isn't article text wherever it stands
(menus, page headers and footers, sidebars, notices, adverts, forms, comments, hidden parts, scripts)
is left out of the tree before; what only its name marks so, after a look at what it holds.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Elements whose content is no markup: it ends at the end tag of the same name.
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>|</{t}\Z", re.I) for t in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript")}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: Start tags that end an open paragraph.
_ENDS_P = set("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul tbody thead tfoot tr td th".split())
#: Start tag: the open elements that it ends, up to one of the others.
_IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"})}
_NEVER = set("nav aside footer form menu dialog button select option datalist input fieldset svg math canvas object embed applet audio video template head script style textarea title xmp iframe noembed noframes noscript map search".split())
_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist status".split())
#: Words in class or id that mark what isn't article text.
_JUNK = set("""ad ads adv advert advertisement advertisements adverts adsense adslot adbox banner bannerad sponsor sponsored sponsors promo promos promotion promoted
menu nav navbar navigation navigator sidebar sidenav aside rail footer masthead topbar topnav breadcrumb breadcrumbs pagination pager
comment comments commentlist disqus respond responses replies reply discussion guestbook
cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay lightbox paywall
newsletter subscribe subscription signup signin login register share sharing sharebar social follow
related recommended recommendations recirculation popular trending teaser teasers widget widgets toolbar search searchbox tags taglist skip skiplink hidden offscreen""".split())
#: Of these, the ones that name what readers wrote: a good word beside them (comment-body) doesn't count.
_READERS = set("comment comments commentlist disqus respond responses replies reply discussion guestbook".split())
_GOOD = set("article body content entry main page post story text blog news prose markdown".split())
_SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_TAG_POINTS = {"article": 30.0, "main": 15.0, "section": 5.0, "div": 5.0, "blockquote": 3.0, "td": 3.0, "pre": 3.0, "ol": -3.0, "ul": -3.0, "dl": -3.0, "li": -3.0, "th": -5.0, "header": -5.0}


class Node:
    __slots__ = ("children", "good", "junk", "level", "links", "parent", "points", "size", "tag")

    def __init__(self, tag: str, parent: Node | None, points: float, junk: bool = False, good: bool = False):
        self.tag, self.parent, self.points, self.junk, self.good = tag, parent, points, junk, good
        self.level = parent.level + 1 if parent else 0
        self.children: list = []  # nodes, and blocks as (text, characters in links)
        self.size = self.links = 0


def _judged(tag: str, attributes: str, inside: bool, by_name: bool) -> tuple[bool, float, bool, bool]:
    """(whether the element is left out, the points that its class gives, and whether its name is junk, or good)."""
    article = tag in ("article", "main")
    if tag in _NEVER or tag == "header" and not inside:
        return True, 0, False, False
    if not attributes.strip(" /\n\t"):
        return False, 0, False, article
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    if tag in ("body", "html"):
        return False, 0, False, False
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(found.get("style", "")) or found.get("role", "").lower() in _ROLES:
        return True, 0, False, False
    names = {w.lower() for w in _SPLIT.split(f"{found.get('class', '')} {found.get('id', '')}") if w}
    good = bool(names & _GOOD)
    if names & _JUNK and not (good and names & _JUNK <= {"page", "related", "alert", "follow", "search", "tags", "hidden", "social", "popular"} and article):
        return by_name and tag in _INLINE, 0.0 if good and not article else -25.0, by_name and not article, good and not article and not names & _READERS
    return False, 25.0 if good else 0, False, article or good


def parse(html: str, by_name: bool = True) -> Node:
    """The tree of block elements; text is gathered in blocks, without what never is article text.

    Blocks with junk names stay in it, marked; ``by_name`` False takes no name for junk.
    """
    root = Node("body", None, 0)
    here, skipped, depth, text, links, link_depth = root, [], {}, [], 0, 0
    stack: list[tuple[str, Node | None]] = []  # open elements; inline ones have no node
    places: dict[str, list[int]] = {}  # where in the stack a tag is open, so that no tag looks through all of it
    block_places: list[int] = []
    last = lambda tags: max((places[t][-1] for t in tags if places.get(t)), default=-1)

    def flush() -> None:
        nonlocal links
        if text:
            block = " ".join("".join(text).split())
            if block:
                here.children.append((block, min(links, len(block))))
            text.clear()
        links = 0

    def close(k: int) -> None:
        """Close all open elements from place k on."""
        nonlocal here, link_depth
        while len(stack) > k:
            tag, node = stack.pop()
            places[tag].pop()
            if node is not None:
                block_places.pop()
                flush()
                here = node.parent
            elif tag == "a":
                link_depth = max(0, link_depth - 1)

    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        end = m.start() if m else n
        if end > at and not skipped:
            piece = html[at:end]
            text.append(unescape(piece) if "&" in piece else piece)
            if link_depth:
                links += len(text[-1].strip())
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag or html[m.end() - 1] != ">":
            continue
        attributes = (m[3] if m[2] else m[6]) or ""
        if m[1] or m[4]:  # an end tag
            if skipped:
                if depth.get(tag):
                    while True:
                        gone = skipped.pop()
                        depth[gone] -= 1
                        if gone == tag:
                            break
                continue
            if tag == "br" or tag == "p" and not places.get("p"):
                text.append(" ") if tag == "br" else flush()
                continue
            k = last((tag,))
            if k >= 0 and not (tag in _INLINE and block_places and block_places[-1] > k):  # an inline end tag doesn't end blocks
                close(k)
            continue
        if tag in _RAW:
            stop = _RAW[tag].search(html, at)
            at = stop.end() if stop else n
            if not skipped:
                text.append(" ")
            continue
        if skipped:
            if tag not in _VOID and not attributes.endswith("/"):
                skipped.append(tag)
                depth[tag] = depth.get(tag, 0) + 1
            continue
        if tag in _VOID:
            if tag == "hr":
                close(places["p"][0] if places.get("p") else len(stack))
                flush()
            else:
                text.append(" ")
            continue
        if tag in ("html", "body"):
            continue
        if tag in _ENDS_P and places.get("p") and places["p"][-1] > last(("table", "td", "th", "button", "object")):
            close(places["p"][-1])
        if tag in _IMPLIED:
            ended, limit = _IMPLIED[tag]
            floor = last(limit)
            above = [places[t][k] for t in ended if places.get(t) and (k := bisect_right(places[t], floor)) < len(places[t])]
            close(min(above, default=len(stack)))
        inside = tag == "header" and bool(places.get("article") or places.get("main"))
        out, points, junk, good = _judged(tag, attributes, inside, by_name)
        if out:
            if tag not in _INLINE:
                flush()
            else:
                text.append(" ")
            if not attributes.endswith("/") or tag not in ("svg", "math"):
                skipped.append(tag)
                depth[tag] = depth.get(tag, 0) + 1
            continue
        places.setdefault(tag, []).append(len(stack))
        if tag in _INLINE:
            stack.append((tag, None))
            link_depth += tag == "a"
            continue
        flush()
        node = Node(tag, here, points + _TAG_POINTS.get(tag, 0.0), junk, good)
        here.children.append(node)
        here = node
        block_places.append(len(stack))
        stack.append((tag, node))
    close(0)
    flush()
    return root


def _nodes(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        out.append(node := todo.pop())
        todo.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return out


def blocks(node: Node) -> Iterator[str]:
    """Texts of the blocks under a node in page order."""
    todo: list = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, Node):
            todo.extend(reversed(x.children))
        else:
            yield x[0]


def _paragraph(text: str) -> float:
    return 1 + text.count(",") + text.count("，") + text.count("、") + min(len(text) / 100, 3.0)


def _without_junk(root: Node) -> bool:
    """Take blocks with junk names out of a tree, and say whether any text but headings is left.

    A wrapper may name its sidebar: a block stays if it or something in it also has a good name, and
    it holds half of the paragraphs outside hopeless junk, few of them links. What it holds is judged likewise.
    """

    def weigh(nodes: list[Node]) -> tuple[dict[Node, float], dict[Node, float], set[Node]]:
        texts, links, good = {}, {}, set()
        for x in reversed(nodes):  # children before their parents
            long = [c for c in x.children if not isinstance(c, Node) and len(c[0]) >= 25]
            inner = [c for c in x.children if isinstance(c, Node)]
            texts[x] = sum(len(c[0]) for c in long) + sum(texts[c] for c in inner)
            links[x] = sum(c[1] for c in long) + sum(links[c] for c in inner)
            if x.good or any(c in good for c in inner):
                good.add(x)
        return texts, links, good

    nodes = _nodes(root)
    if not any(x.junk for x in nodes):
        return True
    for hopeless in (True, False):
        texts, links, good = weigh(nodes)
        gone = {x for x in nodes if x.junk and (x not in good if hopeless else not texts[x] or 2 * texts[x] < texts[root] or 3 * links[x] > texts[x])}
        for x in {x.parent for x in gone}:
            x.children = [c for c in x.children if not isinstance(c, Node) or c not in gone]
        nodes = _nodes(root)
    return any(x.tag not in ("h1", "h2", "h3", "h4", "h5", "h6") and not all(isinstance(c, Node) for c in x.children) for x in nodes)


def main_text(html: str | None) -> str:
    """The article's blocks, one to a line; empty if the page has no text."""
    if not html:
        return ""
    root = parse(html)
    if not _without_junk(root):
        root = parse(html, by_name=False)
    nodes = _nodes(root)
    for node in reversed(nodes):  # children before their parents: each adds up once
        for c in node.children:
            node.size += c.size if isinstance(c, Node) else len(c[0])
            node.links += c.links if isinstance(c, Node) else c[1]
    gained: dict[Node, float] = {}
    for node in nodes:
        for c in node.children:
            if isinstance(c, Node):
                continue
            if len(c[0]) < 25 or node.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                continue
            points = _paragraph(c[0]) * (1 - c[1] / len(c[0]))
            up: Node | None = node if node.tag in ("div", "section", "article", "main", "body", "td") else node.parent or node
            share = 1
            while up is not None and share <= 4:
                gained[up] = gained.get(up, 0.0) + points / share
                up, share = up.parent, share * 2 if share < 2 else share + 1
    density = lambda x: x.links / x.size if x.size else 0.0
    scores = {x: (g + x.points) * (1 - density(x)) for x, g in gained.items() if x is not root}
    if not scores:
        whole = [x for x in nodes if x.tag in ("article", "main") and x.size]
        best = max(whole, key=lambda x: x.size, default=root)
        return "\n".join(blocks(best))
    best = max(scores, key=lambda x: (scores[x], -x.level))
    # a container that holds several articles' worth of the same text is the better choice if it adds much
    while best.parent is not None and best.parent is not root and scores.get(best.parent, 0) >= 0.75 * scores[best] and best.parent.size > best.size and density(best.parent) < 0.25 and best.tag not in ("article", "main"):
        best = best.parent
    if best.parent is None:
        return "\n".join(blocks(best))
    floor, out = max(10.0, 0.2 * scores[best]), []
    for c in best.parent.children:
        if c is best:
            out.extend(blocks(c))
        elif best.tag in ("article", "main"):
            if isinstance(c, Node) and c.tag == best.tag and scores.get(c, 0) >= floor:
                out.extend(blocks(c))
        elif not isinstance(c, Node):
            if len(c[0]) > 80 and c[1] < 0.25 * len(c[0]):
                out.append(c[0])
        elif scores.get(c, 0) >= floor or c.tag in ("p", "h1", "h2") and c.size and (density(c) == 0 and (c.tag != "p" or re.search(r"[.!?…]$", next(iter(blocks(c)), ""))) or c.size > 80 and density(c) < 0.25):
            out.extend(blocks(c))
    return "\n".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars (code points of text).

    A null or empty html gives an empty text. Null ids and urls and repeated rows are rows like
    others; other columns don't matter. An empty table gives an empty result. A page may be of any length and nest to
    any depth: each tag, block and container is looked at a fixed number of times. Of containers with one score the
    one nearest the root is the best, then the first on the page.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        for batch in batches:
            held, start, size = [], 0, 0
            for k, html in enumerate(batch.column("html")):
                held.append(main_text(html.as_py()))
                size += len(held[-1])
                if size > 4 << 20 or k + 1 == batch.num_rows:
                    n = len(held)
                    yield pa.RecordBatch.from_arrays([batch.column("page_id").slice(start, n), batch.column("url").slice(start, n), pa.array(held, pa.string()), pa.array(list(map(len, held)), pa.int64())], schema=schema)
                    held, start, size = [], k + 1, 0

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")

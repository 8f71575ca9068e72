"""Main-text extraction by composite text density.

A page becomes a tree of elements. Elements that hold no article text by their
nature (menus, headers, footers, sidebars, forms, scripts, notices, adverts,
reader comments: by tag, role, class name or id) leave it first; where only a
part of a name says so, unless the element holds much of the page's text. Reader
comments are also known by their form: at least ``FEWEST_COMMENTS`` elements of one tag
and class, side by side, each with a paragraph and none with a heading, that
make up their parent and follow paragraphs of other text.
Each remaining block's density is its characters per tag, adjusted by the
share of link characters and link tags against the page's own:

    C/T * log_b(C/LC * T/LT),  b = ln(C/nLC * LC + LCb/Cb * C + e)

with C characters, T tags, LC link characters, LT link tags, nLC the rest,
LCb and Cb those of the body; zeros count as one. The subtree whose children's
densities add up to the most is the core of the article; the article or main
element around it is all article. The least density on the path from there to
the body is the threshold: blocks beside the path, up to the outermost main or
article or else to the body, stay if they reach it, or if they have headings,
paragraphs, lists or the like and no more than half of their text is links; so
does bare text. An article beside that outermost one belongs to it if it
reaches the threshold and no more than half of its text is links.

Character references are decoded, white space inside a block becomes one
space, blocks are joined in page order by an empty line. Null or empty html
gives an empty text; html without tags is one block; unclosed and crossed tags
are closed as browsers do in the common cases, in time about proportional to the
page however it is nested. Repeated rows keep their rows; an empty table gives
an empty result; only the columns asked for are read.
"""

from __future__ import annotations

import html as entities
import math
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.llm.common import add_columns

#: What may begin with a less-than sign: a comment, a start or end tag, a declaration.
_OPEN = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*+)|[!?/])")
_MARK = re.compile("[>\"']")
# One attribute after the other: a whole name, and its value if it has one.
_ATTR = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes select".split())
DROP = frozenset("nav header footer aside form button dialog menu svg math canvas object audio video map datalist fieldset input label meter output progress head".split())
BLOCK = frozenset(
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre blockquote figure figcaption table caption thead tbody tfoot tr td th address hgroup details summary center search".split()
)
#: Blocks that articles are written in.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 hgroup ul ol dl pre blockquote figure table details".split())
#: Words of a class, id or role that mark an element as no part of the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adbox banner sponsor sponsored promo promotion sidebar aside comment comments discussion disqus respond reply replies nav navbar navigation menu breadcrumb breadcrumbs header masthead footer cookie cookies consent gdpr notice notices alert popup modal overlay share sharing social related recommended newsletter subscribe subscription signup login search pagination pager toolbar widget widgets tags skip contentinfo complementary".split()
)
#: Words beside a mark that leave it a mark.
NEUTRAL = frozenset("area box block container form list section thread wrap wrapper".split())
#: What may stand in a head; any other start tag or text ends it.
HEAD = frozenset("base basefont bgsound link meta title script style noscript template".split())
KEEP = frozenset("html body main article".split())
#: Elements that a list of reader comments is made of, how many alike make one, and the prose that comes before it.
ITEMS = frozenset("div section article li".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
FEWEST_COMMENTS, PROSE_BEFORE = 5, 200
#: Start tags that end an open element of the named kinds.
_P_ENDERS = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
#: Elements that hide the open ones of a kind from what is inside them.
_SCOPE = {"ul": "li", "ol": "li", "menu": "li", "dl": "dd", "table": "tr"}
_KIND = {"li": "li", "dt": "dd", "dd": "dd", "tr": "tr", "td": "tr", "th": "tr", "thead": "tr", "tbody": "tr", "tfoot": "tr"}


class Node:
    __slots__ = ("tag", "parent", "kids", "dropped", "doubt", "link", "chars", "links", "tags", "link_tags", "density", "total", "depth", "p", "open", "names")

    def __init__(self, tag: str, parent: Node | None, dropped: bool, link: bool):
        # The open paragraph that a block would end, and the outermost open items of lists and tables by kind and tag.
        self.depth = parent.depth + 1 if parent else 0
        self.p = self if tag == "p" else parent.p if parent and tag not in BLOCK and tag not in DROP else None
        self.open: dict[str, dict[str, Node]] = parent.open if parent else {"li": {}, "dd": {}, "tr": {}}
        if tag in _SCOPE:
            self.open = {**self.open, _SCOPE[tag]: {}}
        self.tag, self.parent, self.dropped, self.link = tag, parent, dropped, link
        self.doubt = False
        self.names = ""
        self.kids: list[Node | str] = []
        self.chars = self.links = self.tags = self.link_tags = 0
        self.density = self.total = 0.0


def _attributes(source: str) -> dict[str, str]:
    """Names and values of a start tag; of a name that repeats the first counts."""
    found: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(source):
        found.setdefault(name.lower(), a or b or c)
    return found


def _marked(tag: str, attributes: dict[str, str]) -> bool | None:
    """Whether an element is no part of the article; None if only a part of a class name, id or role says so."""
    if tag in DROP:
        return True
    if not attributes or tag in KEEP:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in attributes.get("style", "").lower().replace(" ", ""):
        return True
    doubt = False
    for name in ("class", "id", "role"):
        for whole in attributes.get(name, "").lower().split():
            words = {w for w in re.split(r"[^a-z]+", whole) if w}
            if not MARKS.isdisjoint(words):
                if words <= MARKS | NEUTRAL:
                    return True
                doubt = True
    return None if doubt else False


def _drop_comments(root: Node) -> None:
    """Drop the lists of reader comments, known by their form."""
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        order.append(n)
        stack.extend(k for k in reversed(n.kids) if isinstance(k, Node) and not k.dropped)
    # Characters, paragraphs and headings inside, and the prose before an element in page order.
    inside: dict[int, tuple[int, int, int]] = {}
    for n in reversed(order):
        kids = [inside[id(k)] for k in n.kids if isinstance(k, Node) and not k.dropped]
        own = sum(len(k) - k.count(" ") for k in n.kids if isinstance(k, str)) * (not n.link)
        inside[id(n)] = (own + sum(k[0] for k in kids), (n.tag == "p") + sum(k[1] for k in kids), (n.tag in HEADINGS) + sum(k[2] for k in kids))
    prose, gone = 0, None
    for n in order:
        if gone is not None and n.depth > gone:
            continue
        gone = None
        if n.tag == "p":
            prose += inside[id(n)][0]
        if n.parent is None or n.tag in KEEP or prose < PROSE_BEFORE or inside[id(n)][2]:
            continue
        alike: dict[tuple[str, str], list[int]] = {}
        for k in n.kids:
            if isinstance(k, Node) and not k.dropped and k.tag in ITEMS and k.names and inside[id(k)][1]:
                alike.setdefault((k.tag, k.names), []).append(inside[id(k)][0])
        if any(len(x) >= FEWEST_COMMENTS and 5 * sum(x) >= 4 * inside[id(n)][0] for x in alike.values()):
            n.dropped, gone = True, n.depth


def _settle(root: Node) -> None:
    """Drop the elements in doubt unless their text speaks for them: a quarter of the page's own, or half of it together and not mostly links."""
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        order.append(n)
        stack.extend(k for k in n.kids if isinstance(k, Node) and not k.dropped)
    text: dict[int, int] = {}
    links: dict[int, int] = {}
    for n in reversed(order):
        own = sum(len(" ".join(_decoded(k).split())) for k in n.kids if isinstance(k, str))
        kids = [id(k) for k in n.kids if isinstance(k, Node) and not k.dropped]
        text[id(n)] = own * (not n.link) + sum(text[k] for k in kids)
        links[id(n)] = own * n.link + sum(links[k] for k in kids)
    most = text[id(root)]
    small, stack = [], [root]
    while stack:
        n = stack.pop()
        if n.doubt and 4 * text[id(n)] < max(1, most):
            small.append(n)
        else:
            stack.extend(k for k in n.kids if isinstance(k, Node) and not k.dropped)
    together = 2 * sum(text[id(n)] for n in small) >= max(1, most)
    for n in small:
        n.dropped = not (together and text[id(n)] >= links[id(n)])


class Ends:
    """Where tags end: at the first ``>`` outside quotes; where quotes don't pair up, at the first of all.

    One pass from the back over the marks gives the end for every place, so
    that text full of opened tags costs no more than other text.
    """

    def __init__(self, source: str):
        self.at = [m.start() for m in _MARK.finditer(source)]
        self.plain: list[int] = [-1] * (len(self.at) + 1)
        self.any: list[int] = [-1] * (len(self.at) + 1)
        quote = {'"': -1, "'": -1}
        for k in range(len(self.at) - 1, -1, -1):
            c = source[self.at[k]]
            if c == ">":
                self.plain[k] = self.any[k] = self.at[k]
            else:
                self.any[k] = self.any[k + 1]
                self.plain[k] = self.plain[quote[c] + 1] if quote[c] >= 0 else -1
                quote[c] = k

    def after(self, place: int, quotes: bool = True) -> int:
        """The place of the ``>``, -1 if there is none."""
        k = bisect_left(self.at, place)
        return self.plain[k] if quotes and self.plain[k] >= 0 else self.any[k]


class Tree:
    """The open element, and how many of each name are open."""

    def __init__(self) -> None:
        self.root = self.node = Node("html", None, False, False)
        self.count: dict[str, int] = {"html": 1}

    def enter(self, node: Node) -> None:
        self.node = node
        self.count[node.tag] = self.count.get(node.tag, 0) + 1
        if node.tag in _KIND:
            node.parent.open[_KIND[node.tag]].setdefault(node.tag, node)

    def leave(self, until: Node) -> None:
        """Close open elements up to ``until``, which stays open."""
        while self.node is not until:
            n = self.node
            self.count[n.tag] -= 1
            if n.tag in _KIND:
                same = n.parent.open[_KIND[n.tag]]
                if same.get(n.tag) is n:
                    del same[n.tag]
            self.node = n.parent

    def end(self, tag: str) -> bool:
        """Close the innermost element of that name, the root excepted; whether there is one."""
        if not self.count.get(tag):
            return False
        up = self.node
        while up.tag != tag:
            up = up.parent
        if up.parent is None:
            return False
        self.leave(up.parent)
        return True

    def end_before(self, tag: str) -> None:
        """Close what a start tag ends without an end tag."""
        if tag in _P_ENDERS and self.node.p is not None:
            self.leave(self.node.p.parent)
        if tag == "option" and self.node.tag == "option":
            self.leave(self.node.parent)
        if tag in _CLOSES:
            same = self.node.open[_KIND[tag]]
            hits = [same[t] for t in _CLOSES[tag] if t in same]
            if hits:
                self.leave(min(hits, key=lambda n: n.depth).parent)


def parse(source: str) -> Node:
    tree = Tree()
    root = tree.root
    ends = Ends(source)
    doubt = False
    head = body = None
    at, size = 0, len(source)
    text: list[str] = []

    def flush() -> None:
        whole = "".join(text)
        text.clear()
        if whole:
            if tree.node is head and not whole.isspace():
                tree.leave(root)
            tree.node.kids.append(whole)

    while at < size:
        m = _OPEN.search(source, at)
        if not m:
            break
        if m[1]:
            stop = source.find("-->", m.end())
            after = stop + 3 if stop >= 0 else size
        else:
            stop = ends.after(m.end(), bool(m[3]))
            if stop < 0:
                break
            after = stop + 1
        text.append(source[at : m.start()])
        flush()
        at = after
        if not m[3]:
            continue
        tag, attributes = m[3].lower(), source[m.end() : stop]
        if m[2]:
            if not tree.end(tag) and tag == "p":
                tree.node.kids.append(Node("p", tree.node, tree.node.dropped, tree.node.link))
            continue
        if tag in ("html", "body"):
            if tag == "body" and body is None and tree.node in (root, head):
                tree.leave(root)
                body = Node("body", root, False, False)
                root.kids.append(body)
                tree.enter(body)
            continue
        if tree.node is head and tag not in HEAD:
            tree.leave(root)
        if tag in RAW:
            stop = re.compile(f"</{re.escape(tag)}\\b[^>]*+>", re.I).search(source, at)
            at = stop.end() if stop else size
            continue
        tree.end_before(tag)
        node = tree.node
        names = _attributes(attributes)
        marked = _marked(tag, names)
        new = Node(tag, node, node.dropped or bool(marked), node.link or tag == "a")
        new.names = names.get("class", "")
        if marked is None and not new.dropped:
            new.doubt = doubt = True
        if tag == "head" and head is None and node is root:
            head = new
        node.kids.append(new)
        if tag not in VOID and (tag == "a" or not attributes.endswith("/")):
            tree.enter(new)
    text.append(source[at:])
    flush()
    if doubt:
        _settle(root)
    _drop_comments(root)
    return root


def _decoded(text: str) -> str:
    return entities.unescape(text) if "&" in text else text


def _measure(root: Node) -> list[Node]:
    """Counts of every kept node, bottom-up; the nodes in page order."""
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        if n.dropped:
            continue
        order.append(n)
        stack.extend(k for k in reversed(n.kids) if isinstance(k, Node))
    for n in reversed(order):
        for k in n.kids:
            if isinstance(k, str):
                size = len(" ".join(_decoded(k).split()))
                n.chars += size
                n.links += size * n.link
            elif not k.dropped:
                n.chars += k.chars
                n.links += k.links
                n.tags += k.tags + 1
                n.link_tags += k.link_tags + (k.tag == "a")
    body = root
    for n in order:
        if n.tag == "body":
            body = n
            break
    share = body.links / max(1, body.chars)
    for n in order:
        if n.chars:
            c, t, lc, lt = n.chars, max(1, n.tags), max(1, n.links), max(1, n.link_tags)
            base = math.log(c / max(1, c - n.links) * lc + share * c + math.e)
            n.density = c / t * math.log(max(c / lc * t / lt, 1.0 + 1e-9)) / math.log(max(base, 1.0 + 1e-9)) if base > 1 else c / t
    for n in order:
        n.total = sum(k.density for k in n.kids if isinstance(k, Node) and not k.dropped and k.tag in BLOCK)
    return order


def _beside(n: Node, on_path: Node, least: float) -> set[tuple[int, int]]:
    """(node, place) of the children of a path node that belong to the article: blocks by themselves, bare text in runs between them."""
    picked: set[tuple[int, int]] = set()
    run, chars, links = [], 0, 0
    for i, k in enumerate([*n.kids, None]):
        if isinstance(k, Node) and k.dropped:
            continue
        if k is None or k is on_path or isinstance(k, Node) and k.tag in BLOCK:
            if 2 * links <= chars:
                picked.update(run)
            run, chars, links = [], 0, 0
            if k is not None and k is not on_path and (k.density >= least or 2 * k.links <= k.chars and _has_prose(k)):
                picked.add((id(n), i))
        else:
            size = len(" ".join(_decoded(k).split())) if isinstance(k, str) else k.chars
            run.append((id(n), i))
            chars += size
            links += size * n.link if isinstance(k, str) else k.links
    return picked


def _has_prose(n: Node) -> bool:
    stack = [n]
    while stack:
        k = stack.pop()
        if k.tag in PROSE:
            return True
        stack.extend(x for x in k.kids if isinstance(x, Node) and not x.dropped)
    return False


def main_blocks(source: str | None) -> list[str]:
    """The blocks of the article."""
    if not source or not source.strip():
        return []
    root = parse(source)
    order = _measure(root)
    blocks = [n for n in order if n.tag in BLOCK]
    core = max(blocks, key=lambda n: n.total) if blocks else root
    if core.total <= 0:
        core = max(blocks, key=lambda n: n.density) if blocks else root
        if core.tag == "p" and core.parent is not None:
            core = core.parent
    path = [core]
    while path[-1].tag != "body" and path[-1].parent is not None:
        path.append(path[-1].parent)
    around = [k for k, n in enumerate(path) if n.tag in ("article", "main")]
    first, last = (around[0], around[-1]) if around else (0, len(path) - 1)
    least = min(n.density for n in path[first:])
    picked: set[tuple[int, int]] = set()
    for k in range(first, last):
        picked |= _beside(path[k + 1], path[k], least)
    top = path[last]
    if top.tag == "article":
        beside = [(id(top.parent), i) for i, k in enumerate(top.parent.kids) if isinstance(k, Node) and k is not top and k.tag == "article" and not k.dropped and k.density >= least and 2 * k.links <= k.chars]
        if beside:
            picked.update(beside)
            top = top.parent
    return _texts(top, picked, path[first])


def _texts(top: Node, picked: set[tuple[int, int]], core: Node) -> list[str]:
    out: list[str] = []
    now: list[str] = []

    def flush() -> None:
        text = " ".join("".join(now).split())
        now.clear()
        if text:
            out.append(text)

    # (node, inside a picked subtree); None closes a block
    stack: list[tuple] = [(top, False)]
    while stack:
        n, inside = stack.pop()
        if n is None:
            flush()
        elif isinstance(n, str):
            if inside:
                now.append(_decoded(n))
        elif n.tag in VOID:
            now.append(" ")
            if n.tag == "hr":
                flush()
        elif not n.dropped:
            inside = inside or n is core
            block = n.tag in BLOCK and n.tag not in ("td", "th")
            if block:
                flush()
                stack.append((None, False))
            elif n.tag in ("td", "th"):
                now.append(" ")
            stack.extend((n.kids[i], inside or (id(n), i) in picked) for i in reversed(range(len(n.kids))))
    flush()
    return out


def main_text(source: str | None) -> str:
    return "\n\n".join(main_blocks(source))


def extract_text(df: DataFrame, source: Column, /, **keep: Column) -> DataFrame:
    """Columns ``keep`` and ``text``, the main text; a kept column of that name is left out."""

    def start():
        return lambda pages: [pa.array([main_text(x) for x in pages.to_pylist()], pa.string())]

    return add_columns(df, keep, [source.cast("string")], [T.StructField("text", T.StringType())], start)


def char_count(text: Column) -> Column:
    return F.length(text).cast("long")

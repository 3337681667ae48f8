"""Main text of web pages by consensus: pages of a host vote on where their articles stand.

A page's containers are scored by the running text in them. Each page votes for the generalised paths
of its best containers, Spark adds the votes per host, and every page is read again at the path its
host has chosen, together with the rest of the article around it. A page without that path falls back
on its own best container.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echotrail.llm.common import name
from echotrail.session import cut_lineage, small_side

# ---- fixed values: element names of HTML ----------------------------------------------------------
BLOCKS = frozenset((
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol p pre search section summary table tbody td "
    "template tfoot th thead tr ul").split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
# Elements that are never part of an article.
OUTSIDE = frozenset((
    "aside audio button canvas datalist dialog footer form head header iframe input label map menu nav noembed noframes noscript object "
    "optgroup option script search select style svg template textarea title video").split())
CONTAINERS = frozenset("article body center dd div form html li main section table tbody td".split())
# Opening the key closes an open element of the value.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th"), "body": ("head",),
}
# An element named in CLOSES is looked for no further up than the next of these.
SCOPES = frozenset("ul ol dl table html body article section div aside nav form main".split())
# Words in class, id or role that mark what surrounds an article.
MARKS = frozenset((
    "ad ads adbox adslot advert adverts advertisement advertising adsense alert alerts announcement author-box banner banners breadcrumb breadcrumbs byline-box "
    "comment comments commentlist complementary consent contentinfo cookie cookies copyright dialog discussion disqus dropdown feedback footer footnav form "
    "gdpr header hidden legal login masthead menu menubar modal nav navbar navigation newsletter notice notices notification offcanvas outbrain overlay pager "
    "pagination paywall popup popups promo promos promoted promotion recommended recommendations related replies reply respond responses search share sharing "
    "shoutbox sidebar sidenav signup skip social sponsor sponsored sponsors subscribe subscription taboola tagcloud teaser teasers toolbar topbar tracking warning widget widgets").split())
# Marks of what never wraps an article, however long it is.
BESIDE = frozenset((
    "ad ads adverts advertisement advertising comment comments commentlist consent cookie cookies copyright disqus gdpr newsletter outbrain promo promos "
    "recommended recommendations related replies reply respond responses shoutbox sponsored taboola teaser teasers").split())
# Marks that count on a heading, paragraph, item or cell too, when they are its whole name.
STRICT = frozenset((
    "ad ads adbox adslot advert adverts advertisement advertising adsense comment comments commentlist consent cookie cookies disqus gdpr newsletter "
    "outbrain promo promos reply replies respond shoutbox sponsored taboola").split())
# Marks that inside an article do not count for what reads like the article.
LOOSE = frozenset("discussion feedback form header legal related respond response responses search teaser teasers warning <form>".split()) - STRICT
TEXTUAL = frozenset("blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre summary td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# ---------------------------------------------------------------------------------------------------

VOTES = 3
RUNNING = 40
_OPENING = re.compile(r"<!--|<!\[CDATA\[|<[!?]|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_QUOTE_OR_END = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
# Class names that tell how a page is laid out, as has-sidebar.
_STATE = re.compile(r"(?:has|is|no|with|without)[-_]")


@dataclass(eq=False)
class Node:
    """An open or closed element. All pointers go to the nearest element at or above it, so nothing is walked twice.

    ``key`` stands for the path: a digest of the key above and the own label. ``order`` and ``last`` are the numbers of
    the first and last element in it.
    """

    tag: str
    parent: "Node | None"
    outside: bool
    label: str = ""
    key: bytes = b""
    marks: tuple[tuple[str, frozenset[str]], ...] = ()
    order: int = 0
    last: int = 0
    block: "Node | None" = None
    box: "Node | None" = None
    holder: "Node | None" = None
    listed: "Node | None" = None
    marked: "Node | None" = None
    score: float = 0.0

    @property
    def path(self) -> str:
        labels, node = [], self
        while node is not None:
            if node.label:
                labels.append(node.label)
            node = node.parent
        return ">".join(reversed(labels))


def _step(above: bytes, label: str) -> bytes:
    return blake2b(above + label.encode("utf-8", "replace"), digest_size=16).digest()


def _key_of(path: str) -> bytes:
    key = b""
    for label in path.split(">") if path else []:
        key = _step(key, label)
    return key


@dataclass
class Block:
    node: Node
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    menu: int | None = None


def _label(tag: str, attributes: dict[str, str]) -> str:
    """Tag and class names, numbers taken out, so that pages of one template agree."""
    names = sorted({re.sub(r"\d+", "#", c).replace(">", "") for c in attributes.get("class", "").split()})
    return ".".join([tag, *names])


def _hidden(tag: str, attributes: dict[str, str]) -> bool:
    if tag in OUTSIDE and tag != "form":
        return True
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return True
    return bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", ""), re.I))


def _marks(tag: str, attributes: dict[str, str]) -> tuple[tuple[str, frozenset[str]], ...]:
    """Names that mark an element as standing beside an article, each with its marking words."""
    if tag in ("html", "body", "article", "main"):
        return ()
    found = {"<form>": frozenset(("<form>",))} if tag == "form" else {}
    for key in ("class", "id", "role"):
        for value in attributes.get(key, "").split():
            words = frozenset(w for w in (w.lower() for w in _WORD.findall(value)) if w in MARKS)
            if value.lower() in MARKS:
                words |= {value.lower()}
            if tag in TEXTUAL and value.lower() not in STRICT:
                continue
            if words:
                found[re.sub(r"\d+", "#", value.lower())] = words
    return tuple(found.items())


def tags_of(source: str) -> Iterator[tuple[int, int, str, str, str]]:
    """``start, end, slash, name, rest`` of every tag; comments and the like have no name.

    A ``>`` inside a quoted attribute does not end a tag. Where a quote or a tag stays open to the end of the page,
    this and all later tags end at the next ``>`` whatever the quotes say, so every page is read once.
    """
    at, quotes = 0, True
    while (m := _OPENING.search(source, at)) is not None:
        start, end = m.start(), -1
        if m[2] is None:
            close = {"<!--": "-->", "<![CDATA[": "]]>"}.get(m[0], ">")
            end = source.find(close, m.end())
            end = len(source) if end < 0 else end + len(close)
            yield start, end, "", "", ""
            at = end
            continue
        here = m.end()
        while quotes:
            q = _QUOTE_OR_END.search(source, here)
            if q is None:
                quotes = False
            elif q[0] == ">":
                end = q.end()
                break
            else:
                here = source.find(q[0], q.end()) + 1
                quotes = here > 0
        if end < 0:
            end = source.find(">", m.end()) + 1
            if not end:
                return
        at = yield_at = end
        yield start, yield_at, m[1], m[2].lower(), source[m.end():end - 1]


def blocks_of(source: str) -> list[Block]:
    """Blocks of running text in page order; hidden ones and those in elements of ``OUTSIDE`` are left out
    already, those in marked elements are not."""
    root = Node("", None, False)
    root.block = root.box = root
    stack, blocks, current = [root], [], None
    opened: dict[str, int] = {}
    at, order = 0, 0

    def add(text: str) -> None:
        nonlocal current
        top = stack[-1]
        if top.outside or not text:
            return
        if current is None:
            current = Block(top.block)
            blocks.append(current)
        current.parts.append(text)
        if any(n.tag == "a" for n in stack[-4:]):
            current.linked += len(text.strip())

    def close(index: int) -> None:
        nonlocal current
        for n in stack[index:]:
            n.last = order
            opened[n.tag] -= 1
            if n.tag in BLOCKS:
                current = None
        del stack[index:]

    for start, end, slash, tag, rest in tags_of(source):
        if start < at:  # inside a script or the like
            continue
        add(source[at:start])
        at = end
        if not tag:
            if source.startswith("<![CDATA[", start):
                add(html.escape(source[start + 9:end].removesuffix("]]>"), quote=False))
            continue
        if slash:
            if opened.get(tag):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        close(i)
                        break
            elif tag in BLOCKS:
                current = None
            continue
        attributes = {}
        if rest and not rest.isspace():
            for a in _ATTRIBUTE.finditer(rest):
                attributes.setdefault(a[1].lower(), html.unescape((a[2] or "").strip("\"'")))
        if tag in BLOCKS:
            # A block ends an open paragraph, together with what was left open inside.
            for i in range(len(stack) - 1, 0, -1) if opened.get("p") else ():
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in BLOCKS:
                    break
            current = None
        for closed in CLOSES.get(tag, ()):
            for i in range(len(stack) - 1, 0, -1) if opened.get(closed) else ():
                if stack[i].tag == closed:
                    close(i)
                    break
                if stack[i].tag in SCOPES and stack[i].tag != closed:
                    break
        if tag in VOID:
            if tag in ("br", "wbr"):
                add(" " if tag == "br" else "")
            continue
        parent = stack[-1]
        order += 1
        node = Node(tag, parent, parent.outside or _hidden(tag, attributes), key=parent.key, marks=_marks(tag, attributes), order=order, last=order)
        if tag in BLOCKS:
            node.label = _label(tag, attributes)
            node.key = _step(parent.key, node.label)
        node.block = node if tag in BLOCKS else parent.block
        node.box = node if tag in CONTAINERS else parent.box
        node.holder = node if tag in ("article", "main") else parent.holder
        node.listed = node if tag in ("ul", "ol", "dl") else parent.listed
        node.marked = node if node.marks else parent.marked
        if tag in RAW:
            found = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(source, at)
            at = found.end() if found else len(source)
            continue
        if rest.rstrip().endswith("/") and tag not in BLOCKS and tag not in ("a", "b", "i", "em", "strong", "span"):
            continue
        stack.append(node)
        opened[tag] = opened.get(tag, 0) + 1
    add(source[at:])
    for n in stack:
        n.last = order
    return blocks


def _clean(block: Block) -> str:
    return " ".join(html.unescape("".join(block.parts)).split())


def _unlinked(block: Block, text: str) -> int:
    """Length of a block of running text; 0 for short ones and for those that are mostly links."""
    free = len(text) - min(block.linked, len(text))
    return free if len(text) >= RUNNING and 2 * free > len(text) else 0


def _chain(node: Node) -> Iterator[Node]:
    """Marked elements at and above ``node``."""
    found = node.marked
    while found is not None:
        yield found
        found = found.parent.marked


def _excused(node: Node, lifted: set[str]) -> bool:
    covered = frozenset().union(*(words for mark, words in node.marks if mark in lifted))
    return all(words <= covered for _, words in node.marks)


def _below(node: Node, top: Node) -> bool:
    return top.order <= node.order <= top.last


def _marked(texts: list[tuple[Block, str]]) -> list[Node]:
    """Marked elements above the blocks, outer ones first; each is visited once."""
    found: dict[int, Node] = {}
    for b, _ in texts:
        node = b.node.marked
        while node is not None and id(node) not in found:
            found[id(node)] = node
            node = node.parent.marked
    return sorted(found.values(), key=lambda n: n.order)


def _article_like(texts: list[tuple[Block, str]], marked: list[Node], tops: list[Node]) -> set[int]:
    """Marked elements inside an article that read like it: most of their text is running and unlinked, and their marks are loose."""
    size: dict[int, list[int]] = {id(n): [0, 0] for n in marked}
    for b, t in texts:
        if b.node.marked is not None:
            got = size[id(b.node.marked)]
            got[0] += len(t)
            got[1] += _unlinked(b, t)
    for n in reversed(marked):
        if n.parent.marked is not None:
            above = size[id(n.parent.marked)]
            above[0] += size[id(n)][0]
            above[1] += size[id(n)][1]
    return {id(n) for n in marked if 2 * size[id(n)][1] > size[id(n)][0] and all(words <= LOOSE for _, words in n.marks)
            and (n.parent.holder is not None or any(top is not n and _below(n, top) for top in tops))}


def _unmarked(texts: list[tuple[Block, str]], inside: set[int], tops: list[Node]) -> list[tuple[Block, str]]:
    """Blocks outside marked elements.

    A mark is lifted if the elements that have it hold most of the page's running text, or the only
    article or main element with such text: they wrap the article. The marks of ``BESIDE`` are lifted
    only if they hold an article and no running text stands elsewhere. Marked elements in ``inside``
    count as unmarked, and so does what reads like an article in one, or in ``tops``. A heading stays
    in an article whose header it is in.
    """
    lifted: set[str] = set()
    total = sum(_unlinked(b, t) for b, t in texts)
    marked = _marked(texts)
    free = inside | _article_like(texts, marked, tops)
    while True:
        blocked: dict[int, Node | None] = {}
        for n in marked:
            outer = blocked[id(n.parent.marked)] if n.parent.marked is not None else None
            blocked[id(n)] = outer or (None if id(n) in free or _excused(n, lifted) else n)
        kept, held, articles, places, beside = [], {}, set(), {}, {}
        others: dict[int, Node] = {}
        for b, t in texts:
            node = blocked[id(b.node.marked)] if b.node.marked is not None else None
            size = _unlinked(b, t)
            if node is not None and b.node.tag in HEADINGS and node is b.node.marked and node.parent.holder is not None and all(w <= {"header"} for _, w in node.marks):
                kept.append((b, t))
            elif node is None:
                kept.append((b, t))
                if size and b.node.holder is not None:
                    others[id(b.node.holder)] = b.node.holder
            elif size:
                for mark, words in node.marks:
                    if mark in lifted:
                        continue
                    held[mark] = held.get(mark, 0) + size
                    beside[mark] = bool(words & BESIDE) and not _STATE.match(mark)
                    if b.node.holder is not None and b.node.holder.order > node.order:
                        articles.add(mark)
                    places.setdefault(mark, set()).add(node.order)
        if len(kept) == len(texts):
            return kept
        elsewhere = any(_unlinked(b, t) for b, t in kept)
        sure = {m for m, size in held.items() if (m in articles and not elsewhere if beside[m] else m in articles or 2 * size > total)}
        more = set()
        for m in sure:
            orders = sorted(places[m])
            # Every other article must have one of the mark's elements inside it.
            if all((i := bisect_left(orders, h.order)) < len(orders) and orders[i] <= h.last for h in others.values()):
                more.add(m)
        if not more:
            return kept
        lifted |= more


def _holding(texts: list[tuple[Block, str]]) -> list[Node]:
    """All elements that hold blocks, each once."""
    found: dict[int, Node] = {}
    for b, _ in texts:
        node = b.node
        while node is not None and id(node) not in found:
            found[id(node)] = node
            node = node.parent
    return list(found.values())


def _at(texts: list[tuple[Block, str]], path: str) -> list[Node]:
    """Containers at ``path`` that hold blocks, in page order."""
    key = _key_of(path)
    return sorted((n for n in _holding(texts) if n.key == key and (n.tag in CONTAINERS or not n.tag)), key=lambda n: n.order)


def read_page(source: str, path: str | None = None) -> tuple[list[tuple[Block, str]], list[Node]]:
    """Blocks with their text, and the scored containers, best first.

    A block gives its container a score by its length and its commas, the container above half of that,
    and nothing where most of it is links. Lists that are all links are menus and leave the page. Marks
    above a container at ``path`` do not count if no other container stands there.
    """
    whole = [(b, t) for b, t in ((b, _clean(b)) for b in blocks_of(source)) if t]
    tops = [n for n in _at(whole, path) if n.tag] if path is not None else []
    texts = _unmarked(whole, set(), tops)
    if tops and len(texts) < len(whole) and not _at(texts, path):
        inside = {id(n) for node in tops for n in _chain(node) if not any(words & BESIDE for _, words in n.marks)}
        texts = _unmarked(whole, inside, tops) if inside else texts
    lists: dict[int, list] = {}
    for b, t in texts:
        node = b.node.listed
        if node is not None:
            got = lists.setdefault(id(node), [0, 0, 0])
            got[0] += len(t)
            got[1] += min(b.linked, len(t))
            got[2] += bool(b.linked)
            b.menu = id(node)
        else:
            b.menu = None
    menus = {k for k, (size, linked, n) in lists.items() if n >= 3 and linked > 0.8 * size}
    texts = [(b, t) for b, t in texts if b.menu not in menus]
    found: dict[int, Node] = {}
    for b, t in texts:
        share = min(b.linked, len(t)) / len(t)
        score = (len(t) ** 0.5 + t.count(",") + t.count(".")) * (1 - share) if len(t) >= 20 else 0.5 * (1 - share)
        node, weight = b.node.box, 1.0
        for _ in range(3):
            node.score += score * weight
            found[id(node)] = node
            if node.parent is None:
                break
            node, weight = node.parent.box, weight * 0.4
    for node in found.values():
        if node.tag in ("article", "main"):
            node.score *= 1.5
    return texts, sorted(found.values(), key=lambda n: (-n.score, n.order))


def _covered(texts: list[tuple[Block, str]], tops: list[Node]) -> set[int]:
    """Blocks below any of ``tops``; of a page's body only those that stand in no container of their own."""
    bodies = {id(t) for t in tops if t.tag in ("", "html", "body")}
    spans: list[tuple[int, int]] = []
    for t in sorted((t for t in tops if id(t) not in bodies), key=lambda t: t.order):
        if not spans or t.order > spans[-1][1]:
            spans.append((t.order, t.last))
    out = set()
    for b, _ in texts:
        i = bisect_right(spans, (b.node.order, 1 << 62)) - 1
        if id(b.node.box) in bodies or (i >= 0 and b.node.order <= spans[i][1]):
            out.add(id(b))
    return out


def whole_of(texts: list[tuple[Block, str]], node: Node) -> Node:
    """The element that holds the whole article whose best container is ``node``.

    The nearest article; else the main element or the lowest container in which a heading or running
    text stands beside ``node``. What stands there in a container of its own has to be a fifth as long
    as ``node``, or it is a box beside the article.
    """
    holder = node.holder
    if holder is node:
        return node
    above = holder
    while above is not None and above.tag != "article":
        above = above.parent.holder
    if above is not None:
        return above
    # Running text and main headings by the number of their element, so that any element's share is a difference.
    rows = sorted((b.node.order, _unlinked(b, t), b.node.tag == "h1") for b, t in texts)
    orders, sums, heads = [r[0] for r in rows], [0], [0]
    for _, size, head in rows:
        sums.append(sums[-1] + size)
        heads.append(heads[-1] + head)
    bare: dict[int, list[int]] = {}
    for b, t in texts:
        got = bare.setdefault(id(b.node.box), [0, 0])
        got[0] += _unlinked(b, t)
        got[1] += b.node.tag == "h1"

    def held(n: Node) -> tuple[int, int]:
        i, j = bisect_left(orders, n.order), bisect_right(orders, n.last)
        return sums[j] - sums[i], heads[j] - heads[i]

    own, own_heads = held(node)
    lowest, top = None, node.parent
    while top is not None:
        if top.tag in CONTAINERS or not top.tag:
            direct = bare.get(id(top), [0, 0])
            rest = direct if top.tag in ("", "html", "body") else [x - y for x, y in zip(held(top), (own, own_heads))]
            if direct[0] or rest[1] or 5 * rest[0] >= max(own, 1):
                if top.tag == "main":
                    return top
                lowest = lowest or top
        if top is holder:
            break
        top = top.parent
    return lowest or node


def page_votes(source: str) -> list[tuple[str, str, float]]:
    """Paths of the best containers, those of the whole articles around them, and their part of the scores."""
    texts, nodes = read_page(source)
    best = nodes[:VOTES]
    total = sum(n.score for n in best) or 1.0
    return [(n.path, whole_of(texts, n).path, n.score / total) for n in best]


def extract(source: str, path: str | None, whole: str | None = None) -> str:
    """Text of the articles at ``whole`` around all containers at ``path``, or around the page's own best
    ones if there are none: all that share the path of the best. Blocks beside the containers that are mostly links stay out."""
    texts, nodes = read_page(source, path)
    chosen = _at(texts, path) if path is not None else []
    tops: dict[int, Node] = {}
    if not chosen and whole is not None:
        chosen = [n for n in _at(texts, whole) if n.tag not in ("", "html", "body")]
    if not chosen and nodes:
        chosen, whole = [n for n in _at(texts, nodes[0].path)], None
        tops = {id(t): t for t in (whole_of(texts, n) for n in chosen[:1])}
        for n in chosen[1:]:
            if n.holder is not None and n.holder is not chosen[0].holder:
                tops[id(n.holder)] = n.holder
    key = _key_of(whole) if whole is not None else None
    for node in chosen if whole is not None else []:
        top = node
        while top is not None and not (top.key == key and (top.tag in CONTAINERS or not top.tag)):
            top = top.parent
        if top is not None:
            tops[id(top)] = top
    core = set().union(*([_covered(texts, [n for n in chosen if n.tag not in ("", "html", "body")])] if chosen else []))
    core |= {id(b) for b, _ in texts if any(n.tag in ("", "html", "body") for n in chosen)}
    more = _covered(texts, list(tops.values()))
    return "\n".join(t for b, t in texts if id(b) in core or (id(b) in more and 2 * min(b.linked, len(t)) <= len(t)))


def host_of(url: Column) -> Column:
    """Lower-case host of a URL; empty for what has none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host, path, whole``: where the pages of each host say that their articles stand, by the best
    container and by the element that holds all of the article.

    Votes are added with partial sums, so a host with a third of all pages is no hot group. Of equal
    sums the first path in code point order wins. Pages without a host choose for themselves.
    """
    rows = pages.select(host_of(name(url_col)).alias("host"), F.coalesce(name(html_col).cast("string"), F.lit("")).alias("html")).filter("host <> ''")

    def vote(batches):
        for batch in batches:
            hosts, paths, wholes, shares = [], [], [], []
            for h, t in zip(batch.column(0), batch.column(1)):
                for path, whole, share in page_votes(t.as_py()):
                    hosts.append(h.as_py())
                    paths.append(path)
                    wholes.append(whole)
                    shares.append(round(share * 1_000_000))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(wholes, pa.string()), pa.array(shares, pa.int64())],
                                             names=["host", "path", "whole", "share"])

    votes = rows.mapInArrow(vote, "host string, path string, whole string, share long").groupBy("host", "path", "whole").agg(F.sum("share").alias("share"))
    paths = votes.groupBy("host", "path").agg(F.sum("share").alias("share"), F.min_by("whole", F.struct(-F.col("share"), F.col("whole"))).alias("whole"))
    return paths.groupBy("host").agg(F.min_by(F.struct("path", "whole"), F.struct(-F.col("share"), F.col("path"))).alias("best")).select("host", "best.path", "best.whole")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``.

    ``text`` has the article's blocks in page order, one to a line, white space inside a block as one
    space, character references decoded; empty if there is no article. Null html is an empty page; a
    null or odd URL has no host, and such a page is read at its own best container. Repeated rows are
    read alike and each votes. An empty table gives an empty result; other columns are ignored.
    """
    winners = cut_lineage(host_paths(pages, url_col, html_col))
    rows = pages.select(name(id_col).alias("page_id"), name(url_col).cast("string").alias("url"), host_of(name(url_col)).alias("host"),
                        F.coalesce(name(html_col).cast("string"), F.lit("")).alias("html"))
    joined = rows.join(small_side(winners, 512), "host", "left").select("page_id", "url", "path", "whole", "html")
    id_type = joined.schema["page_id"].dataType.simpleString()

    def read(batches):
        for batch in batches:
            texts = [extract(t.as_py(), p.as_py(), w.as_py()) for p, w, t in zip(batch.column(2), batch.column(3), batch.column(4))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(read, f"page_id {id_type}, url string, text string, n_chars long")

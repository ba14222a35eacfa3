"""HTML extraction by union-free wrappers inferred per host.

A page becomes a stream of block tags and text. The pages of a host are aligned one after another with the host's wrapper, a regular
expression without unions over tags and text slots: a page takes the cheapest way through the expression, and each mismatch is
resolved by generalising it. What the page lacks becomes optional, what only it has is put in as optional, what follows itself, one element or a
group of up to four, becomes repeated, and text that differs makes a slot of what was a constant. Children in no order that a sequence of
LONG entries could hold become one repeated group of optional elements.

The main text comes through the wrapper. Each page is matched with it, and each of its texts is taken or left by what the expression knows of the slot that it
fell into: texts that all pages have there are template, slots that are mostly links are menus, and the elements around the slot say whether it is
in an article, a menu, a footer and the like (``step``). Slots in an article are taken whole; where a page has no article, template and menus are left out.
Text is template only if at least SAME_ON different pages agree on it, so copies of a page do not empty each other.

A task folds its own pages and sends one wrapper a host; wrappers are merged in two steps, as a wrapper is aligned just as a page is. A host with a third of all
pages costs as many rows as there are tasks. All pages take part. Nothing is recursive; a wrapper has at most MAX_NODES nodes, the rarest go first,
and a text whose place was dropped is judged by its own page, which is all that is known of it.

Cases: null html gives an empty text; a null url is a host of its own; very long and deep pages are read in one pass; repeated rows count as one page where pages must differ;
an empty table gives no rows; other columns are ignored; broken markup is read as browsers do in the common cases (implied ends of p, li,
td and the like, ends without a start dropped, a tag cut off at the end of the page dropped).
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placemill.llm.common import tidy, written

_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*)>|<[a-zA-Z][^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_RAW = frozenset("script style noscript iframe template textarea title xmp noembed noframes svg math object select canvas audio video".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
#: An element that begins ends an open one of these, unless one of the latter set stands between.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "body": ({"head"}, set())}
_SCOPE = frozenset("article aside section div table td th nav footer header main form body".split())

_OUT_TAGS = frozenset("nav footer aside form button dialog head menu fieldset search".split())
_OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle adslot banner banners breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disclaimer disqus footer gdpr legal login menu modal nav navbar navigation newsletter "
    "notice notices notification pager pagination popup promo promotion promoted recommended related replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget".split()
)
#: Words that name a subject as often as a part of the page; in an article the slot's text decides.
_SUBJECTS = frozenset("legal notification promotion recommended related respond search social".split())
#: A class with one of these tells what a page has or allows (has-sidebar, comment-open), not what the element is.
_STATES = frozenset("closed disabled enabled has no open with without".split())
_OUT_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
_IN_TAGS = frozenset("article main".split())
_IN_WORDS = ("articlebody", "article-body", "entry-content", "post-content", "article-content", "post-body", "story-body", "main-content")
#: Text is template only if so many different pages agree on it.
SAME_ON = 5
BROADCAST_BYTES = 16 << 20
HOT = 200
#: Nodes of wrappers that a task holds, and parts of a host that one step merges.
HELD_NODES = 200_000
PARTS = 32


@lru_cache(maxsize=20_000)
def _key(name: str, attrs: str) -> str:
    """A tag's name with its classes, id and role, digits left out."""
    parts = [name]
    for m in _ATTR.finditer(attrs):
        a, v = m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or "").lower()
        if a in ("class", "id"):
            parts += [("." if a == "class" else "#") + x for x in (re.sub(r"\d+", "", w) for w in v.split()) if x]
        elif a in ("role", "itemprop"):
            parts.append(f"[{v.strip()}]")
        elif (a == "aria-hidden" and v == "true") or (a == "style" and re.search(r"display\s*:\s*none", v)):
            parts.append("!")
    if re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", re.sub(r"\"[^\"]*\"|'[^']*'", "", attrs)):
        parts.append("!")
    return " ".join(dict.fromkeys(parts)).replace("/", "|")


@lru_cache(maxsize=50_000)
def _is_out(key: str) -> bool:
    name, *rest = key.split(" ")
    if name in _OUT_TAGS or "!" in rest:
        return True
    return bool(_words(key) & _OUT_WORDS) or any(x[1:-1] in _OUT_ROLES for x in rest if x[0] == "[")


def _words(key: str) -> set[str]:
    """Parts of the classes and ids, but for those that tell a state."""
    split = [[w for w in re.split(r"[-_.#:]+", x) if w] for x in key.split(" ")[1:] if x[0] in ".#"]
    return {w for ws in split if not _STATES & {*ws} for w in ws}


@lru_cache(maxsize=50_000)
def _is_out_whole(key: str) -> bool:
    """As ``_is_out``, but only whole names count, and a form may hold a page."""
    name, *rest = key.split(" ")
    if (name in _OUT_TAGS and name != "form") or "!" in rest:
        return True
    return any(x[1:] in _OUT_WORDS for x in rest if x[0] in ".#") or any(x[1:-1] in _OUT_ROLES - {"form"} for x in rest if x[0] == "[")


@lru_cache(maxsize=50_000)
def _is_subject(key: str) -> bool:
    """Whether only words that may be subjects make the element out."""
    name, *rest = key.split(" ")
    return name not in _OUT_TAGS and "!" not in rest and not any(x[1:-1] in _OUT_ROLES for x in rest if x[0] == "[") and _words(key) & _OUT_WORDS <= _SUBJECTS


@lru_cache(maxsize=50_000)
def _is_in(key: str) -> bool:
    name, *rest = key.split(" ")
    return name in _IN_TAGS or any(x[1:-1] in ("main", "article", "articlebody") for x in rest if x[0] == "[") or any(x[1:] in _IN_WORDS for x in rest if x[0] in ".#")


class Page:
    """A page as a tree: an element is [key, children], a text ["#", text, characters in links]."""

    def __init__(self, html: str):
        self.root: list = ["", []]
        self._names, self._nodes, self._open_names = [""], [self.root], {}
        self._text: list[str] = []
        self._links = self._in_link = 0
        self._read(html)

    def _flush(self) -> None:
        if self._text:
            text = " ".join(entities.unescape("".join(self._text)).split())
            if text:
                self._nodes[-1][1].append(["#", text, min(self._links, len(text))])
            self._text, self._links = [], 0

    def _open(self, name: str, key: str) -> None:
        self._flush()
        node = [key, []]
        self._nodes[-1][1].append(node)
        self._nodes.append(node)
        self._names.append(name)
        self._open_names[name] = self._open_names.get(name, 0) + 1

    def _close(self, names: set[str] | frozenset[str], until: set[str] | frozenset[str]) -> None:
        if not any(self._open_names.get(n) for n in names):
            return
        for i in range(len(self._names) - 1, 0, -1):
            if self._names[i] in names:
                self._flush()
                for n in self._names[i:]:
                    self._open_names[n] -= 1
                del self._names[i:], self._nodes[i:]
                return
            if self._names[i] in until:
                return

    def _read(self, html: str) -> None:
        at, size = 0, len(html)
        lower = None
        while at < size:
            m = _TOKEN.search(html, at)
            if m is None:
                self._put(html[at:])
                break
            if m.start() > at:
                self._put(html[at : m.start()])
            at = m.end()
            if m[1]:
                name = m[1].lower()
                if name == "a":
                    self._in_link = max(0, self._in_link - 1)
                if name == "br":
                    self._text.append(" ")
                elif name not in _VOID:
                    self._close({name}, frozenset() if name not in ("p", "li") else _SCOPE)
            elif m[2]:
                name = m[2].lower()
                if name in _VOID:
                    if name == "br":
                        self._text.append(" ")
                    elif name == "hr":
                        self._close({"p"}, _SCOPE)
                        self._flush()
                    continue
                if name in _RAW:
                    if m[3].endswith("/") and name in ("svg", "math"):
                        continue
                    lower = lower if lower is not None else html.lower() if html.isascii() else "".join(map(_ascii_lower, html))
                    end = lower.find(f"</{name}", at)
                    if end < 0:
                        break
                    at = html.find(">", end) + 1 or size
                    continue
                key = _key(name, m[3]) if m[3] else name
                if name in _INLINE and not (m[3] and _is_out(key)):
                    self._in_link += name == "a"
                    continue
                if name in _CLOSES_P:
                    self._close({"p"}, _SCOPE)
                if name in _ENDS:
                    self._close(*_ENDS[name])
                self._open(name, key)
        self._flush()

    def _put(self, text: str) -> None:
        self._text.append(text)
        if self._in_link:
            self._links += len(text)


def _ascii_lower(c: str) -> str:
    return c.lower() if c.isascii() else c


#: Where a text is: a place ("open", "in", "subject", "out") and whether something around it is out only by a part of its name.
START = ("open", False)


@lru_cache(maxsize=100_000)
def step(state: tuple[str, bool], key: str) -> tuple[str, bool]:
    """The state inside an element: "in" an article; "subject", in one but under a word that may name a subject; "out" of what is main text.

    What is out only by a part of a class or by a form, outside an article, is weak: an article in it counts, else it is text of last resort.
    """
    place, weak = state
    if place == "out":
        return state
    words = key.split(" ")
    if words[0] in ("html", "body"):
        return ("out", weak) if "!" in words else state
    entered = _is_in(key)
    if _is_out(key):
        if place in ("in", "subject"):
            if not (_is_subject(key) or (entered and not _is_out_whole(key))):
                return "out", weak
            place = place if entered else "subject"
        elif _is_out_whole(key):
            return "out", weak
        elif not entered:
            weak = True
    elif place == "open" and (words[0] == "header" or ".header" in words or "#header" in words):
        return "out", weak
    return ("in" if entered and place == "open" else place), weak


def tier(state: tuple[str, bool], chars: int, links: int) -> str | None:
    """The tier that a slot's texts belong to, None for none; a page takes the first tier of which it has text."""
    place, weak = state
    if place == "out":
        return None
    if weak:
        if place != "open":
            return "around"
        return "loose" if links <= chars / 2 else None
    if place == "in":
        return "inside"
    return ("inside" if place == "subject" else "outside") if links <= chars / 2 else None


TIERS = ("inside", "around", "outside", "loose")
#: A sequence of more entries becomes one repeated group of optional elements, "*".
LONG = 40
#: Nodes of a host's wrapper; beyond it those that the fewest pages have are left out.
MAX_NODES = 20_000
#: Remembered ways of child lists through a node's sequence.
WAYS = 500
#: What a way costs: an element of the page that the expression lacks, a required entry skipped, a group begun again.
LACKS, SKIPS, AGAIN = 8.0, 1.0, 0.01


class Node:
    """An entry of the expression: ``least`` 0 is optional, ``most`` 2 repeated. "#" is a slot, "()" a group of entries, "*" a group in any order."""

    __slots__ = ("key", "least", "most", "kids", "seen", "ways", "chars", "links", "common", "pages", "tier")

    def __init__(self, key: str, least: int = 1, most: int = 1):
        self.key, self.least, self.most = key, least, most
        self.kids: list[Node] = []
        self.seen = 0  # elements of pages, or pages with text in the slot
        self.ways: dict[tuple, list] = {}
        self.chars = self.links = 0
        self.common: set[int] = set()  # hashes of texts that each page has in the slot
        self.pages: set[int] = set()  # up to SAME_ON different pages that do
        self.tier: str | None = None

    def leaves(self) -> list[tuple[Node, Node | None]]:
        return [pair for k in self.kids for pair in ([(x, k) for x in k.kids] if k.key in ("()", "*") else [(k, None)])]


def tokens_of(names: tuple[str, ...] | list[str]) -> tuple[list[list], list[list[str]]]:
    """Child names as [name, positions, whether in a run]: runs are one token, and of groups that follow themselves two rounds are left; and such groups of more rounds."""
    out: list[list] = []
    units: list[list[str]] = []
    for i, n in enumerate(names):
        if out and out[-1][0] == n:
            out[-1][1].append(i)
            out[-1][2] = True
        else:
            out.append([n, [i], False])
    for width in range(2, 5):
        i = 0
        while i + 3 * width <= len(out):
            unit = [t[0] for t in out[i : i + width]]
            n = 1
            while [t[0] for t in out[i + n * width : i + (n + 1) * width]] == unit:
                n += 1
            if n > 2:
                units.append(unit)
                for k in range(2 * width, n * width):
                    into, more = out[i + width + k % width], out[i + k]
                    into[1] += more[1]
                    into[2] |= more[2]
                del out[i + 2 * width : i + n * width]
            i += 1
    return out, units


def way(leaves: list[tuple[Node, Node | None]], names: list[str]) -> tuple[float, list[int]]:
    """The cheapest way of ``names`` through a sequence: its cost and the leaf of each name, -1 for none."""
    m = len(leaves)
    need = [0]
    for x, g in leaves:
        need.append(need[-1] + (x.least and (g is None or g.least)))
    at: dict[str, list[int]] = {}
    for j, (x, _) in enumerate(leaves):
        at.setdefault(x.key, []).append(j)
    first, last = {}, {}
    for j, (_, g) in enumerate(leaves):
        if g is not None and g.most == 2:
            first.setdefault(id(g), j)
            last[id(g)] = j
    far = float("inf")
    cost = [0.0] + [far] * m  # by leaf just taken, one more than its number; 0 before any
    back: list[list[tuple[int, int]]] = []
    for name in names:
        new = [c + LACKS for c in cost]
        came = [(p, -1) for p in range(m + 1)]
        for j in at.get(name, ()):
            g = leaves[j][1]
            a, z = (first[id(g)], last[id(g)]) if g is not None and g.most == 2 else (m, -1)
            for p in range(m + 1):
                if cost[p] == far:
                    continue
                if p <= j:  # leaves p .. j-1 are skipped
                    c = cost[p] + SKIPS * (need[j] - need[p])
                elif a < p <= z + 1:
                    c = cost[p] + SKIPS * (need[z + 1] - need[p] + need[j] - need[a]) + AGAIN
                else:
                    continue
                if c < new[j + 1]:
                    new[j + 1], came[j + 1] = c, (p, j)
        cost = new
        back.append(came)
    ends = [c + SKIPS * (need[m] - need[p]) for p, c in enumerate(cost)]
    p = min(range(m + 1), key=ends.__getitem__)
    best, route = ends[p], []
    for came in reversed(back):
        p, j = came[p]
        route.append(j)
    return best, route[::-1]


def _optional(node: Node) -> bool:
    was, node.least = node.least, 0
    return bool(was)


def _generalise(parent: Node, leaves: list[tuple[Node, Node | None]], fresh: list[Node | None], route: list[int]) -> bool:
    """Resolve the mismatches of a way: skipped entries become optional, and ``fresh`` nodes are put in where names found no leaf."""
    taken = {j for j in route if j >= 0}
    used = {id(leaves[j][1]) for j in taken}
    changed, p = False, 0
    for j in [*(j for j in route if j >= 0), len(leaves)]:
        if p <= j:
            skipped = range(p, j)
        else:
            group = [k for k in range(len(leaves)) if leaves[k][1] is leaves[j][1]]
            skipped = [k for k in group if k >= p or k < j]
        for k in skipped:
            x, g = leaves[k]
            changed |= _optional(g if g is not None and id(g) not in used else x)
        p = j + 1
    before: list[Node] = []
    inside: dict[int, list[Node]] = {}
    after: dict[int, list[Node]] = {}
    p = -1
    for k, j in enumerate(route):
        if j >= 0:
            p = j
        elif (node := fresh[k]) is not None:
            changed = True
            following = next((x for x in route[k + 1 :] if x >= 0), -1)
            g = leaves[p][1] if p >= 0 else None
            if p < 0:
                before.append(node)
            elif g is not None and not (following >= 0 and leaves[following][1] is g):
                after.setdefault(id(g), []).append(node)
            else:
                inside.setdefault(id(leaves[p][0]), []).append(node)
    if before or inside or after:
        out = before
        for k in parent.kids:
            out.append(k)
            if k.key == "()":
                k.kids = [y for x in k.kids for y in (x, *inside.get(id(x), ()))]
                out += after.get(id(k), ())
            else:
                out += inside.get(id(k), ())
        parent.kids = out
    return changed


def _tidied(parent: Node) -> list[tuple[Node, Node]]:
    """Like neighbours become one repeated entry, groups that follow themselves one repeated group, long sequences a group in any order; what is to be merged."""
    merges: list[tuple[Node, Node]] = []

    def joined(kids: list[Node]) -> list[Node]:
        out: list[Node] = []
        for k in kids:
            if out and out[-1].key == k.key and k.key not in ("()", "*"):
                out[-1].least, out[-1].most = max(out[-1].least, k.least), 2
                merges.append((out[-1], k))
            else:
                out.append(k)
        return out

    for k in parent.kids:
        if k.key == "()":
            k.kids = joined(k.kids)
    kids = joined(parent.kids)
    for width in range(2, 5):
        i = 0
        while i + 2 * width <= len(kids):
            unit = kids[i : i + width]
            names, n = [k.key for k in unit], 1
            if "()" in names or "*" in names:
                i += 1
                continue
            while [k.key for k in kids[i + n * width : i + (n + 1) * width]] == names:
                n += 1
            if n > 1:
                rounds = [kids[j : j + width] for j in range(i, i + n * width, width)]
                # a round just put in is there as a whole or not at all
                counted = [r for r in rounds if any(k.least or k.seen for k in r)] or rounds
                group = Node("()", max(k.least for r in rounds for k in r), 2)
                for c, x in enumerate(unit):
                    x.least, x.most = min(r[c].least for r in counted), max(r[c].most for r in rounds)
                    merges += [(x, r[c]) for r in rounds[1:]]
                group.kids = unit
                kids = [*kids[:i], group, *kids[i + n * width :]]
            i += 1
    parent.kids = kids
    if len(leaves := parent.leaves()) > LONG and not _any_order(parent):
        merges += _made_any_order(parent, leaves)
    return merges


def _any_order(node: Node) -> bool:
    return bool(node.kids) and node.kids[0].key == "*"


def _made_any_order(parent: Node, leaves: list[tuple[Node, Node | None]]) -> list[tuple[Node, Node]]:
    found: dict[str, Node] = {}
    merges = []
    for x, _ in leaves:
        if x.key in found:
            merges.append((found[x.key], x))
        else:
            found[x.key] = x
            x.least, x.most = 0, 2
    group = Node("*", 0, 2)
    group.kids = list(found.values())
    parent.kids = [group]
    return merges


def _repeats(parent: Node, names: list[str]) -> bool:
    """Whether a sequence takes a group any number of times: three rounds go through it, one of them again through the same entries."""
    route = way(parent.leaves(), 3 * names)[1]
    return -1 not in route and any(a >= b for a, b in zip(route, route[1:]))


def merge(pairs: list[tuple[Node, Node]]) -> None:
    """Take up each second node in the first: a wrapper is aligned as a page is, its repeated groups shown twice."""
    work = list(pairs)
    while work:
        x, y = work.pop()
        if x.key == "#":
            if y.seen:
                x.common = x.common & y.common if x.seen else y.common
                x.pages = {*sorted(x.pages | y.pages)[:SAME_ON]} if x.common else set()
            x.seen, x.chars, x.links = x.seen + y.seen, x.chars + y.chars, x.links + y.links
            continue
        x.ways.clear()
        if not x.kids:
            x.kids = y.kids
            if x.seen:
                for k in x.kids:
                    k.least = 0
        elif y.kids or y.seen:
            # name, node, most, and whether it is required; the second round of a group has no nodes but names the first one's
            shown: list[tuple[str, Node | None, int, bool | Node]] = []
            groups = [k for k in y.kids if k.key == "()" and k.most == 2]
            for k in y.kids:
                if k.key in ("()", "*"):
                    shown += [(v.key, v, v.most, bool(v.least and k.least)) for v in k.kids]
                    if k.key == "()" and k.most == 2:
                        shown += [(v.key, None, v.most, v) for v in k.kids]
                else:
                    shown.append((k.key, k, k.most, bool(k.least)))
            leaves = x.leaves()
            if _any_order(x) or _any_order(y) or len(shown) > LONG:
                if not _any_order(x):
                    work += _made_any_order(x, leaves)
                have = {k.key: k for k in x.kids[0].kids}
                for name, v, _, _ in shown:
                    if v is None:
                        continue
                    if name in have:
                        work.append((have[name], v))
                    else:
                        v.least, v.most = 0, 2
                        have[name] = v
                        x.kids[0].kids.append(v)
            else:
                _, route = way(leaves, [t[0] for t in shown])
                below, fresh = [], []
                went: dict[int, int] = {}
                for (name, v, most, least), j in zip(shown, route, strict=True):
                    if j < 0:
                        node = v if v is not None else Node(name)
                        node.least, node.most = 0, most
                        fresh.append(node)
                        continue
                    fresh.append(None)
                    leaf = leaves[j][0]
                    leaf.most = max(leaf.most, most)
                    if v is not None:
                        below.append((leaf, v))
                        went[id(v)] = j
                    if not (went.get(id(least)) == j if isinstance(least, Node) else least):
                        leaf.least = 0
                _generalise(x, leaves, fresh, route)
                work += _tidied(x)
                if not _any_order(x) and not all(_repeats(x, [v.key for v in k.kids]) for k in groups):
                    work += _made_any_order(x, x.leaves())
                work += below  # first, before what they go to is merged itself
        x.seen += y.seen


class HostWrapper:
    """A host's wrapper: learned page by page, merged with others, and matched."""

    def __init__(self) -> None:
        self.root = Node("")
        self.size = 1

    def _aligned(self, node: Node, names: tuple[str, ...], learn: bool) -> tuple[list[Node | None], bool]:
        """The entry of each child, and whether the wrapper had to be generalised for them."""
        tokens, units = tokens_of(names)
        changed = False
        for _ in range(4):
            if learn and len(tokens) > LONG and not _any_order(node):
                merge(_made_any_order(node, node.leaves()))
                changed = True
            leaves = node.leaves()
            if _any_order(node):
                have = {x.key: j for j, (x, _) in enumerate(leaves)}
                if learn and (new := [t[0] for t in tokens if t[0] not in have]):
                    node.kids[0].kids += [Node(n, 0, 2) for n in dict.fromkeys(new)]
                    self.size += len(new)
                    changed = True
                    continue
                route = [have.get(t[0], -1) for t in tokens]
                break
            route = way(leaves, [t[0] for t in tokens])[1] if leaves else [-1] * len(tokens)
            if not learn:
                break
            for t, j in zip(tokens, route, strict=True):
                if j >= 0 and t[2] and leaves[j][0].most == 1:
                    leaves[j][0].most, changed = 2, True
            fresh = [Node(t[0], int(not node.seen and not node.kids), 1 + t[2]) if j < 0 else None for t, j in zip(tokens, route, strict=True)]
            if not leaves and tokens:
                node.kids, grown = [n for n in fresh if n is not None], True
                changed = True
            else:
                changed |= _generalise(node, leaves, fresh, route)
                grown = any(n is not None for n in fresh)
            if grown:
                self.size += len(tokens)
                merge(_tidied(node))
            elif all(_repeats(node, unit) for unit in units):
                break
            else:
                merge(_made_any_order(node, leaves))
                changed = True
        if changed:
            node.ways.clear()
        targets: list[Node | None] = [None] * len(names)
        for t, j in zip(tokens, route, strict=True):
            if j >= 0:
                for i in t[1]:
                    targets[i] = leaves[j][0]
        return targets, changed

    def texts(self, page: Page, learn: bool = False) -> tuple[list[tuple], bool]:
        """The page's texts in order, each with its slot (None where the wrapper has none), link characters and state."""
        out: list[tuple] = []
        changed = False
        work: list[tuple] = [(self.root, page.root, START)]
        while work:
            node, raw, state = work.pop()
            if raw[0] == "#":
                out.append((node, raw[1], raw[2], state))
                continue
            kids = raw[1]
            if node is None:
                targets = [None] * len(kids)
            else:
                names = tuple([k[0] for k in kids])
                targets = node.ways.get(names)
                if targets is None:
                    targets, new = self._aligned(node, names, learn)
                    changed |= new
                    if len(names) <= 100:
                        if len(node.ways) >= WAYS:
                            node.ways.clear()
                        node.ways[names] = targets
                if learn:
                    node.seen += 1
            for t, k in zip(reversed(targets), reversed(kids), strict=True):
                work.append((t, k, state if k[0] == "#" else step(state, k[0])))
        return out, changed

    def add(self, html: str) -> None:
        page = Page(html)
        found, changed = self.texts(page, learn=True)
        if changed:  # slots may have merged since
            found, _ = self.texts(page)
        of_page: dict[int, list] = {}
        hashes = []
        for slot, text, links, _ in found:
            hashes.append(h := xxhash.xxh64_intdigest(text))
            if slot is not None:
                got = of_page.setdefault(id(slot), [slot, 0, 0, set()])
                got[1] += len(text)
                got[2] += links
                got[3].add(h)
        said = hash(tuple(hashes))
        for slot, chars, links, texts in of_page.values():
            slot.common = slot.common & texts if slot.seen else texts
            if not slot.common:
                slot.pages = set()
            elif len(slot.pages) < SAME_ON:
                slot.pages.add(said)
            slot.seen, slot.chars, slot.links = slot.seen + 1, slot.chars + chars, slot.links + links
        if self.size > MAX_NODES:
            self.prune()

    def merge(self, other: HostWrapper) -> None:
        merge([(self.root, other.root)])
        self.size = len(self.nodes())
        if self.size > MAX_NODES:
            self.prune()

    def nodes(self) -> list[Node]:
        """All nodes, each before its children."""
        out, work = [], [self.root]
        while work:
            out.append(node := work.pop())
            work += reversed(node.kids)
        return out

    def prune(self) -> None:
        """Leave out the rarest entries until half of MAX_NODES is left or all entries are alike."""
        most = 1
        while len(found := self.nodes()) > MAX_NODES // 2 and most < self.root.seen:
            for node in found:
                node.kids = [k for k in node.kids if k.seen > most or (k.key in ("()", "*") and k.kids)]
                node.ways.clear()
            most *= 2
        self.size = len(self.nodes())

    def decide(self) -> HostWrapper:
        """Give each slot its tier, and leave it the texts that are template, none but where SAME_ON different pages agree."""
        work = [(self.root, START)]
        while work:
            node, state = work.pop()
            if node.key == "#":
                node.tier = tier(state, node.chars, node.links)
                if len(node.pages) < SAME_ON or state == ("in", False) or (state[1] and state[0] != "open"):
                    node.common = set()
                node.pages = set()
            work += [(k, state if k.key in ("#", "()", "*") else step(state, k.key)) for k in node.kids]
        return self

    def extract(self, html: str) -> str:
        """The main text of a page of the host, after ``decide``."""
        by_tier: dict[str | None, list[str]] = {}
        for slot, text, links, state in self.texts(Page(html))[0]:
            if slot is None:
                of = tier(state, len(text), links)
            else:
                of = None if slot.common and xxhash.xxh64_intdigest(text) in slot.common else slot.tier
            by_tier.setdefault(of, []).append(text)
        return " ".join(next((by_tier[t] for t in TIERS if t in by_tier), ()))

    def dump(self) -> bytes:
        flat = [[n.key, n.least, n.most, n.seen, len(n.kids), *([n.chars, n.links, sorted(n.common), sorted(n.pages), n.tier] if n.key == "#" else [])] for n in self.nodes()]
        return zlib.compress(json.dumps(flat, separators=(",", ":")).encode(), 1)

    @classmethod
    def load(cls, data: bytes) -> HostWrapper:
        out = cls()
        flat = json.loads(zlib.decompress(data))
        out.size = len(flat)
        open_: list[list] = []  # node and how many children it still waits for
        for key, least, most, seen, n, *stats in flat:
            node = Node(key, least, most)
            node.seen = seen
            if stats:
                node.chars, node.links, node.tier = stats[0], stats[1], stats[4]
                node.common, node.pages = set(stats[2]), set(stats[3])
            while open_ and not open_[-1][1]:
                open_.pop()
            if open_:
                open_[-1][0].kids.append(node)
                open_[-1][1] -= 1
            else:
                out.root = node
            open_.append([node, n])
        return out

    def expression(self) -> str:
        """The wrapper as a regular expression over tags and slots, for people."""
        out: list[str] = []
        work: list[Node | str] = [self.root]
        while work:
            node = work.pop()
            if isinstance(node, str):
                out.append(node)
                continue
            times = {(1, 1): "", (0, 1): "?", (1, 2): "+", (0, 2): "*"}[node.least, node.most]
            if node.key == "#":
                out.append("#" + times)
                continue
            before, after = ("(", ")") if node.key in ("()", "*") else (f"<{node.key}>", f"</{node.key.split(' ')[0]}>")
            out.append(before)
            work.append(after + times)
            for i, k in enumerate(reversed(node.kids)):
                work += [" ", k] if i else [k]
        return "".join(out)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)", 1))


def infer(pages: DataFrame) -> DataFrame:
    """``pages(host, html)`` -> ``host, wrapper, pages``: each host's decided wrapper (see ``HostWrapper.load``) and how many pages it was learned from."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, HostWrapper] = {}
        part = TaskContext.get().partitionId() << 32
        size = 0

        def rows(part: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([part] * len(found), pa.int64()), pa.array([w.dump() for w in found.values()], pa.binary())], names=["host", "part", "wrapper"])

        for batch in batches:
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if host not in found:
                    found[host] = HostWrapper()
                before = found[host].size
                found[host].add(html.as_py())
                size += found[host].size - before + 1
                if size > HELD_NODES:
                    yield rows(part)
                    found, size, part = {}, 0, part + 1
        if found:
            yield rows(part)

    def merged(table: pa.Table) -> tuple[HostWrapper, pa.Table]:
        table = table.sort_by("part")
        whole = HostWrapper()
        for data in table.column("wrapper"):
            whole.merge(HostWrapper.load(data.as_py()))
        return whole, table

    def some(table: pa.Table) -> pa.Table:
        if len(table) == 1:
            return table
        whole, table = merged(table)
        return pa.table({"host": table.column("host")[:1], "part": table.column("part")[:1], "wrapper": [whole.dump()]})

    def all_(table: pa.Table) -> pa.Table:
        whole, table = merged(table)
        return pa.table({"host": table.column("host")[:1], "wrapper": [whole.decide().dump()], "pages": pa.array([whole.root.seen], pa.int64())})

    parts = pages.select("host", "html").mapInArrow(tidy(local), "host string, part long, wrapper binary")
    parts = parts.groupBy("host", F.pmod(F.xxhash64("part"), F.lit(PARTS))).applyInArrow(lambda _, table: some(table), "host string, part long, wrapper binary")
    return parts.groupBy("host").applyInArrow(all_, "host string, wrapper binary, pages long")


def extract(pages: DataFrame, sent_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.

    Wrappers of ``sent_bytes`` in all go to the pages. If there are more, those of the hosts with more than a HOT-th of all pages do, which are fewer than HOT, and
    the pages of the other hosts meet theirs by shuffle.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host_of(F.col("url")).alias("host"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    wrappers = written(infer(rows), "wrappers").select(F.col("host").alias("w_host"), "wrapper", "pages")
    size, n = wrappers.agg(F.coalesce(F.sum(F.octet_length("w_host") + F.octet_length("wrapper")), F.lit(0)), F.coalesce(F.sum("pages"), F.lit(0))).first()
    match = F.col("host") == F.col("w_host")
    if size <= sent_bytes:
        joined = rows.join(F.broadcast(wrappers), match)
    else:
        hot, others = wrappers.filter(F.col("pages") * HOT > n), wrappers.filter(F.col("pages") * HOT <= n)
        joined = rows.join(F.broadcast(hot), match).union(rows.join(F.broadcast(hot.select("w_host")), match, "left_anti").join(others.hint("merge"), match))

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, HostWrapper] = {}
        held = 0
        for batch in batches:
            texts = []
            for host, html, data in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4), strict=True):
                if (wrapper := known.get(host)) is None:
                    if held > HELD_NODES:
                        known, held = {}, 0
                    wrapper = known[host] = HostWrapper.load(data.as_py())
                    held += wrapper.size
                texts.append(wrapper.extract(html.as_py()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "host", "html", "wrapper").mapInArrow(tidy(fn), "page_id long, url string, text string, n_chars long")

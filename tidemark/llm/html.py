"""Main text of web pages by wrappers: union-free regular expressions over block structure and texts, inferred per host.

First the tags of a host's pages are aligned: a page becomes a tree of block elements in which repetitions are folded into
groups; trees that many pages share are counted once; the others are aligned, tree by tree, in rounds of bounded groups:
what only one side has becomes optional, runs become repeated. Then the texts: all pages are laid along the wrapper, and
the texts that meet at each of its places are compared. A place whose text never differs is a part of the template, any
other is a slot. Last the wrapper decides, once for the host: the article is where the slots hold most running text, summed
over all pages; names of tags and classes count as a prior. Pages are then read through the wrapper.
"""

from __future__ import annotations

import bisect
import hashlib
import html
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: Elements within a block, elements without content, elements whose content is no markup, and elements that a sibling
#: of the same set ends. Fixed values.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe noembed noframes xmp".split())
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Elements that never belong to an article, names (class, id, role) that say so, and elements and names of articles. Fixed values.
BAD_TAGS = set("aside button dialog fieldset footer form head header iframe input menu nav noscript object script select style svg template textarea title".split())
BAD_NAMES = re.compile(
    r"(?:^|[-_ ])(?:ads?|adsense|adverts?|advertisements?|sponsor(?:ed|s)?|promos?|promotions?|banners?|nav|navbar|navigation|navigations|menus?|breadcrumbs?|pagination|pager|"
    r"header|masthead|topbar|footer|sidebar|aside|widgets?|related|recommended|share|sharing|social|comments?|commentlist|respond|reply|replies|disqus|discussion|notices?|alerts?|"
    r"cookies?|consent|gdpr|newsletter|subscribe|subscription|signup|login|search|popup|modal|overlay|toolbar|complementary|contentinfo|hidden)(?:$|[-_ ])"
)
GOOD_TAGS, GOOD_NAMES = {"article", "main"}, re.compile(r"(?:^|[-_ ])(?:articlebody|article-?body|article-?content|post-?content|post-?body|entry-?content|main-?content|article|main)(?:$|[-_ ])")
#: Elements that may hold an article among other things; the rest are blocks of one. Fixed values.
HOLDERS = set("html body div section article main center table tbody tr td".split()) | {""}
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Trees that one task aligns at most in a round; bytes of wrappers up to which they are broadcast; salts beyond that.
ROUND, BROADCAST_BYTES, SALTS = 64, 16 << 20, 32
#: Levels of a tree (what lies deeper becomes part of the last), items of a wrapper (the outermost; what lies deeper is
#: judged by what is around it), and cells of an alignment that is exact; longer lists are aligned by equal occurrences.
DEPTH, MOST_ITEMS, CELLS = 100, 4000, 1 << 18
#: Pages that a text needs to count as template, characters of running text, and what a good or bad name counts.
LEAST_PAGES, RUNNING, GOOD_PRIOR, BAD_PRIOR = 10, 25, 3.0, 0.05
#: Failures to find the end of a quoted attribute after which quotes of a page are no longer heeded: else each could cost
#: the length of the page.
MOST_FAILURES = 8

_STRICT = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_NAMES = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)


class Node:
    """A block element: key (tag and names), children (nodes and texts), whether it shows."""

    __slots__ = ("children", "hidden", "key", "tag")

    def __init__(self, tag: str, key: str, hidden: bool = False):
        self.tag, self.key, self.hidden, self.children = tag, key, hidden, []


class Text:
    """Pieces of text of one block and how many of their characters are links."""

    __slots__ = ("linked", "pieces")
    key = "#"

    def __init__(self):
        self.pieces, self.linked = [], 0

    def value(self) -> str:
        return " ".join("".join(self.pieces).split())


def _tags(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(from, to, slash, tag, attributes) of each tag; ("", "") for comments and declarations. Linear in the page."""
    at, last, failures = 0, page.rfind(">"), 0
    while True:
        start = page.find("<", at)
        if start < 0:
            return
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            end = len(page) if end < 0 else end + 3
            at = (yield start, end, "", "", "") or end
            continue
        if start > last:  # nothing ends any more, and only a comment needs no end
            at = page.find("<!--", start)
            if at < 0:
                return
            continue
        if page[start + 1 : start + 2] in ("!", "?"):
            end = page.find(">", start) + 1
            at = (yield start, end, "", "", "") or end
            continue
        m = _STRICT.match(page, start) if failures < MOST_FAILURES else None
        if m is None:
            m = _LOOSE.match(page, start)
            failures += m is not None
        if m is None:
            at = start + 1
            continue
        at = (yield start, m.end(), m[1], m[2].lower(), m[3]) or m.end()


@lru_cache(maxsize=4096)
def _key(tag: str, attributes: str) -> tuple[str, bool]:
    names = " ".join(sorted({w for x in _NAMES.findall(attributes) for w in re.sub(r"\d+", "0", (x[1] or x[2] or x[3]).lower()).split()}))
    return (f"{tag} {names}" if names else tag), bool(_HIDDEN.search(attributes))


def tree(page: str) -> Node:
    """The block structure of a page; ends that are missing are implied, ends that match nothing are ignored."""
    root = Node("", "")
    stack, done, links = [root], 0, 0
    over: list[str] = []  # open elements beyond DEPTH, whose content belongs to the last level
    beyond: Counter[str] = Counter()
    lower = None

    def put(raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        own = stack[-1].children
        if not own or not isinstance(own[-1], Text):
            if not text.strip():
                return
            own.append(Text())
        own[-1].pieces.append(text)
        if links:
            own[-1].linked += len(text)

    found = _tags(page)
    step = next(found, None)
    while step is not None:
        start, end, slash, tag, attributes = step
        jump = None
        if start > done:
            put(page[done:start])
        done = end
        if not tag:
            pass
        elif slash:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in INLINE:
                pass
            elif beyond[tag]:
                while True:
                    last = over.pop()
                    beyond[last] -= 1
                    if last == tag:
                        break
            elif not over:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        del stack[i:]
                        links = 0
                        break
        elif tag in INLINE:
            links = 1 if tag == "a" else links
            if tag == "br":
                put(" ")
        else:
            if not over:
                if tag in ENDS_P and stack[-1].tag == "p":
                    stack.pop()
                elif tag in ENDS:
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i].tag in ENDS[tag]:
                            del stack[i:]
                            break
                        if stack[i].tag not in ("p", "li", "dt", "dd", "td", "th"):
                            break
            links = 0
            node = Node(tag, *_key(tag, attributes)) if attributes and len(attributes) < 1000 else Node(tag, *_key.__wrapped__(tag, attributes)) if attributes else Node(tag, tag)
            stack[-1].children.append(node)
            if tag in RAW:
                lower = lower if lower is not None else page.lower()
                close = lower.find(f"</{tag}", done)
                close = len(page) if close < 0 else close
                raw = Text()
                raw.pieces.append(page[done:close])
                node.children.append(raw)
                done = jump = close
            elif tag not in VOID and not attributes.rstrip().endswith("/"):
                if len(stack) < DEPTH:
                    stack.append(node)
                else:
                    over.append(tag)
                    beyond[tag] += 1
        step = None if jump is not None and jump >= len(page) else next(found, None) if jump is None else _sent(found, jump)
    if done < len(page):
        put(page[done:])
    return root


def _sent(found, at: int):
    try:
        return found.send(at)
    except StopIteration:
        return None


# Wrappers: [key, mark, items]; mark is "" (once), "?" (at most once), "+" (once or more), "*" (any number); key "#" is a
# place of text and "()" a group of items.


def _written(item: list, inner: list[str]) -> str:
    return f'[{json.dumps(item[0], ensure_ascii=False)},"{item[1]}",[{",".join(inner)}]]'


def _fold(items: list, names: list[str]) -> tuple[list, list[str]]:
    for width in (1, 2, 3):
        i, out, kept = 0, [], []
        while i < len(items):
            n = 1
            if i + 2 * width <= len(items):
                block = names[i : i + width]
                while block == names[i + n * width : i + (n + 1) * width]:
                    n += 1
            if n > 1:
                own = items[i : i + width]
                item = [own[0][0], "+", own[0][2]] if width == 1 and own[0][0] != "()" else ["()", "+", own]
                out.append(item)
                kept.append(json.dumps(item, separators=(",", ":"), ensure_ascii=False))
                i += n * width
            else:
                out.append(items[i])
                kept.append(names[i])
                i += 1
        items, names = out, kept
    return items, names


def fold(items: list) -> list:
    """Runs of up to three items that repeat become one item or group with "+"."""
    return _fold(items, [json.dumps(x, separators=(",", ":"), ensure_ascii=False) for x in items])[0]


_TEXT = ["#", "", []]


def _skeleton(node: Node) -> tuple[list, str]:
    items, names = [], []
    for x in node.children:
        if isinstance(x, Text):
            items.append(_TEXT)
            names.append('["#","",[]]')
        elif x.tag not in VOID:
            item, name = _skeleton(x)
            items.append(item)
            names.append(name)
    items, names = _fold(items, names)
    item = [node.key, "", items]
    return item, _written(item, names)


def skeleton(node: Node) -> list:
    """The node's structure, folded. As deep as the tree: DEPTH levels at most."""
    return _skeleton(node)[0]


def _both(a: str, b: str) -> str:
    many, none = "+" in a + b or "*" in a + b, "?" in a + b or "*" in a + b
    return ("*" if none else "+") if many else ("?" if none else "")


def _head(item: list) -> str:
    return item[0] if item[0] != "()" else "(" + " ".join(x[0] for x in item[2]) + ")"


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a common order of two lists: the longest where the lists are short; else, the longest among pairs of an
    n-th occurrence in one and the n-th of the same in the other."""
    n, m = len(a), len(b)
    first = 0
    while first < min(n, m) and a[first] == b[first]:
        first += 1
    last = 0
    while last < min(n, m) - first and a[n - 1 - last] == b[m - 1 - last]:
        last += 1
    before = [(i, i) for i in range(first)]
    behind = [(n - i, m - i) for i in range(last, 0, -1)]
    a, b = a[first : n - last], b[first : m - last]
    if not a or not b:
        return before + behind
    if len(a) * len(b) <= CELLS:
        best = [[0] * (len(b) + 1)]
        for x in reversed(a):
            under, row = best[-1], [0]
            for j in range(len(b) - 1, -1, -1):
                row.append(under[j + 1] + 1 if x == b[j] else max(under[j], row[-1]))
            best.append(row[::-1])
        best.reverse()
        i = j = 0
        inner = []
        while i < len(a) and j < len(b):
            if a[i] == b[j]:
                inner.append((i, j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    else:
        places: dict[tuple[str, int], int] = {}
        count: Counter[str] = Counter()
        for j, x in enumerate(b):
            places[x, count[x]] = j
            count[x] += 1
        count.clear()
        pairs = []
        for i, x in enumerate(a):
            if (j := places.get((x, count[x]))) is not None:
                pairs.append((i, j))
            count[x] += 1
        ends, at, back = [], [], []  # the longest rising run of j
        for k, (_, j) in enumerate(pairs):
            p = bisect.bisect_left(ends, j)
            back.append(at[p - 1] if p else -1)
            ends[p : p + 1], at[p : p + 1] = [j], [k]
        inner, k = [], at[-1] if at else -1
        while k >= 0:
            inner.append(pairs[k])
            k = back[k]
        inner.reverse()
    return before + [(i + first, j + first) for i, j in inner] + behind


def align(a: list, b: list) -> list:
    """Merge two lists of items: what they have in common order stays, the rest becomes optional."""
    out: list = []

    before = ""  # which side the last item was from

    def add(item: list, side: str) -> None:
        nonlocal before
        # neighbours of one kind are a repeated item, but for those that one side, or both, have as neighbours too
        if side != before and out and item[0] != "()" and _head(out[-1]) == _head(item):
            last, side = out.pop(), "repeated"
            item = [item[0], "+" if "" in (last[1], item[1]) or "+" in (last[1], item[1]) else "*", align(last[2], item[2])]
        out.append(item)
        before = side

    i = j = 0
    for x, y in [*_common([_head(x) for x in a], [_head(x) for x in b]), (len(a), len(b))]:
        for item in a[i:x]:
            add([item[0], _both(item[1], "?"), item[2]], "a")
        for item in b[j:y]:
            add([item[0], _both(item[1], "?"), item[2]], "b")
        if x < len(a):
            add([a[x][0], _both(a[x][1], b[y][1]), align(a[x][2], b[y][2])], "both")
        i, j = x + 1, y + 1
    return out


def _pruned(item: list) -> list:
    """The outermost MOST_ITEMS items."""
    left, level, root = MOST_ITEMS, [(None, item)], None
    while level:
        below = []
        for into, x in level:
            own = [x[0], x[1], []]
            left -= 1
            if into is None:
                root = own
            else:
                into.append(own)
            below += [(own[2], y) for y in x[2]]
        level = below[: max(0, left)]
    return root


def merge(trees: list[str]) -> str:
    """One wrapper for all trees."""
    whole = json.loads(trees[0])
    for other in trees[1:]:
        whole = _pruned(["", "", align(whole[2], json.loads(other)[2])])
    return json.dumps(_pruned(whole), separators=(",", ":"), ensure_ascii=False)


BAD, NEUTRAL, GOOD = -1, 0, 1


@lru_cache(maxsize=4096)
def zone(key: str) -> int:
    """What a node's own tag and names say of what it holds."""
    tag, _, names = key.partition(" ")
    if tag in GOOD_TAGS and not BAD_NAMES.search(names):
        return GOOD
    if tag in BAD_TAGS or any(BAD_NAMES.search(x) for x in names.split()):
        return BAD
    return GOOD if tag in ("div", "section", "td") and any(GOOD_NAMES.search(x) for x in names.split()) else NEUTRAL


class Place:
    """An item of a wrapper: its number, its items (out of groups) and where to find them by key, and its zone."""

    __slots__ = ("bad", "good", "items", "key", "many", "number", "of", "tag")

    def __init__(self, key: str, number: int, good: bool, bad: bool, many: bool):
        self.key, self.number, self.good, self.bad, self.many = key, number, good, bad, many
        self.tag, self.items, self.of = key.split(" ")[0], [], {}


def _spread(spots: list[tuple[int, str]], n: int) -> list[int]:
    """Which of the items of one key (place, mark) the ``n`` children of that key are, in order: one each; what is too many
    is more of a repeated one, what is too few leaves out optional ones, the last first."""
    if len(spots) == 1:
        return [spots[0][0]] * n
    if n >= len(spots):
        more = next((i for i, x in enumerate(spots) if x[1] in ("+", "*")), len(spots) - 1)
        return [x[0] for i, x in enumerate(spots) for _ in range(n - len(spots) + 1 if i == more else 1)]
    out = set(sorted((i for i, x in enumerate(spots) if x[1] in ("?", "*")), reverse=True)[: len(spots) - n])
    return [x[0] for i, x in enumerate(spots) if i not in out][:n]


def _titled(item: list) -> bool:
    return any(x[0].split(" ")[0] == "h1" or _titled(x) for x in item[2])


class Wrapper:
    """A wrapper as places, in page order, and what has been decided: which places hold the article (inside), which do not
    though they lie within (outside), which texts belong to the template (number -> hash)."""

    def __init__(self, text: str, decided: str = ""):
        self.places: list[Place] = []
        self.root = self._place(json.loads(text), False, False, False)
        found = json.loads(decided) if decided else {"inside": [], "outside": [], "template": {}}
        self.inside, self.outside = set(found["inside"]), set(found["outside"])
        self.template = {int(k): v for k, v in found["template"].items()}

    def _place(self, item: list, good: bool, bad: bool, many: bool) -> Place:
        z = zone(item[0])
        if good and item[0].split(" ")[0] == "header" and _titled(item):
            z = NEUTRAL
        own = Place(item[0], len(self.places), good or z == GOOD, bad or z == BAD, many)
        self.places.append(own)

        def add(x: list, mark: str) -> None:
            mark = _both(x[1], mark)
            if x[0] == "()":
                for y in x[2]:
                    add(y, mark)
            else:
                own.of.setdefault(x[0], []).append((len(own.items), mark))
                own.items.append(self._place(x, own.good, own.bad, many or mark in ("+", "*")))

        for x in item[2]:
            add(x, "")
        return own

    def texts(self, top: Node) -> list[tuple[Text, Place | None, Place, bool, str]]:
        """The texts of a page in order: its place (None: the wrapper has none), the innermost place around it, whether
        something bad that the wrapper does not know is around it, and the path above."""
        out: list = []

        def walk(node: Node, place: Place, known: bool, bad: bool, path: str) -> None:
            at = {k: iter(_spread(place.of[k], n)) for k, n in Counter(x.key for x in node.children).items() if k in place.of} if known else {}
            for child in node.children:
                own = place.items[next(at[child.key])] if child.key in at else None
                if isinstance(child, Text):
                    out.append((child, own, own or place, bad, path))
                elif not child.hidden:
                    walk(child, own or place, own is not None, bad or own is None and zone(child.key) == BAD, f"{path}/{child.key}")

        walk(top, self.root, True, False, "")
        return out

    def article(self, texts: list[tuple[Text, Place | None, Place, bool, str]]) -> list[Text]:
        """Those of a page's texts that the wrapper takes for the article: within its inside places, but for the template's.
        Where that would leave a page with headings alone, all of its pages are copies, and the texts stay."""
        around: dict[int, bool] = {}

        def mark(place: Place, within: bool) -> None:
            within = (within or place.number in self.inside) and place.number not in self.outside
            around[place.number] = within
            for x in place.items:
                mark(x, within)

        mark(self.root, False)
        found = [(t, own, _tag(path)) for t, own, near, bad, path in texts if around[near.number] and not bad]
        varying = [(t, tag) for t, own, tag in found if own is None or own.number not in self.template or self.template[own.number] != digest(t.value())]
        return [t for t, _ in varying] if any(tag not in HEADINGS and t.value() for t, tag in varying) else [t for t, *_ in found]


def _tag(path: str) -> str:
    """The tag of the innermost element of a path."""
    return path.rpartition("/")[2].split(" ")[0]


def digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def measure(page: Node, wrapper: Wrapper) -> dict[int, list[int]]:
    """By place: texts, pages (1), characters, characters in links, of running text, smallest and largest hash of a text."""
    found: dict[int, list[int]] = {}
    for text, own, _, _, _ in wrapper.texts(page):
        if own is None or own.tag in ("style", "script"):
            continue
        value = text.value()
        size, h = len(value), digest(value)
        running = size if size >= RUNNING and text.linked * 3 < size else 0
        x = found.get(own.number)
        if x is None:
            found[own.number] = [1, 1, size, text.linked, running, h, h]
        else:
            found[own.number] = [x[0] + 1, 1, x[2] + size, x[3] + text.linked, x[4] + running, min(x[5], h), max(x[6], h)]
    return found


def decide(text: str, stats: dict[int, list[int]]) -> str:
    """What a host's wrapper and the texts along it say: see Wrapper.

    A place's mass is its running text, and a fifth of its other text, over all pages; texts of the template have none.
    From the top, the article is sought in the children that hold most; the search ends where blocks of text hold a
    quarter themselves, or where a name says article and none below does. Headings of the first level that differ from page
    to page belong to it too.
    """
    wrapper = Wrapper(text)
    template = {i: x[5] for i, x in stats.items() if x[5] == x[6] and x[1] >= LEAST_PAGES and not wrapper.places[i].many}
    mass, plain, chars, linked = ({} for _ in range(4))

    def weigh(place: Place, heading: bool) -> None:
        heading = heading or place.tag in HEADINGS
        own = stats.get(place.number)
        plain[place.number] = mass[place.number] = 0.0
        chars[place.number], linked[place.number] = (own[2], own[3]) if own else (0, 0)
        if own and (place.number not in template or heading):
            prior = BAD_PRIOR if place.bad else GOOD_PRIOR if place.good else 1.0
            mass[place.number] = prior * (own[4] + 0.2 * max(0, own[2] - own[4] - own[3]) + 0.001 * own[0])
        for x in place.items:
            weigh(x, heading)
            for held in (mass, chars, linked):
                held[place.number] += held[x.number]
            if x.tag not in HOLDERS or not any(y.key != "#" for y in x.items):
                plain[place.number] += mass[x.number]
        if heading:
            template.pop(place.number, None)

    weigh(wrapper.root, False)

    def better(place: Place) -> bool:
        return any(not x.bad and (zone(x.key) == GOOD and mass[x.number] >= 0.5 * mass[place.number] or better(x)) for x in place.items if mass[x.number])

    inside, todo = [], [wrapper.root]
    while todo:
        place = todo.pop()
        holders = [x for x in place.items if x.tag in HOLDERS and any(y.key != "#" for y in x.items) and mass[x.number] >= 0.1 * mass[place.number] > 0]
        if not holders or plain[place.number] >= 0.25 * mass[place.number] or zone(place.key) == GOOD and not better(place):
            inside.append(place.number)
        else:
            todo += [x for x in holders if not x.bad] or holders
    outside = [x.number for x in wrapper.places if x.bad and not any(wrapper.places[i].bad for i in inside)]
    # lists of links among the blocks of an article
    outside += [x.number for x in wrapper.places if x.tag in ("ul", "ol", "dl", "div") and not x.bad and chars[x.number] and linked[x.number] >= 0.9 * chars[x.number] and x.number not in inside and _texts(x, stats) >= 3]
    # a title above the article, but not one that all pages share
    varies = lambda i: i in stats and (stats[i][5] != stats[i][6] or stats[i][1] < LEAST_PAGES)
    held = [x.number for x in wrapper.places if x.tag == "h1" and not x.bad and any(varies(y.number) for y in x.items)]
    return json.dumps({"inside": sorted({*inside, *held}), "outside": sorted(set(outside)), "template": template}, separators=(",", ":"))


def _texts(place: Place, stats: dict[int, list[int]]) -> float:
    """Texts per page below a place."""
    own = stats.get(place.number)
    return (own[0] / own[1] if own else 0.0) + sum(_texts(x, stats) for x in place.items)


def _mass(texts: list[tuple[Text, Place | None, Place, bool, str]]) -> dict[str, int]:
    """Characters of plain running text by the path of the container around the block, in no bad zone."""
    mass: dict[str, int] = {}
    for text, _, near, bad, path in texts:
        value = text.value()
        if not bad and not near.bad and len(value) >= RUNNING and text.linked * 3 < len(value):
            around = path.rpartition("/")[0]
            mass[around] = mass.get(around, 0) + len(value)
            above = around.rpartition("/")[0]
            mass[above] = mass.get(above, 0) + len(value) // 3
    return mass


def extract(page: str, wrapper: Wrapper) -> str:
    """The article's blocks, one to a line. A page that has nothing but a title at the host's places is judged by itself: by
    names that say article, else by its own mass."""
    texts = wrapper.texts(tree(page))
    chosen = set(map(id, wrapper.article(texts)))
    tops = {id(t) for t, _, _, _, path in texts if _tag(path) == "h1"}
    if not any(id(t) in chosen - tops and t.value() for t, *_ in texts):
        alone = {id(t) for t, _, near, bad, _ in texts if near.good and not near.bad and not bad and t.value()}
        if not alone:
            mass = _mass(texts)
            under = max(mass, key=lambda p: (mass[p], p), default=None)
            if under is not None:
                alone = {id(t) for t, _, near, bad, path in texts if not bad and not near.bad and f"{path}/".startswith(f"{under}/")}
        chosen |= alone
    return "\n".join(v for v in (t.value() for t, *_ in texts if id(t) in chosen) if v)


def host_of(url: str | None) -> str:
    m = re.match(r"(?is)^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _slim(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))


def structures(pages: DataFrame) -> DataFrame:
    """(host, wrapper): one wrapper per host, of tags and places of text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = {(host_of(url), _skeleton(tree(page or ""))[1]) for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)}
            if counts:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts]), pa.array([k[1] for k in counts])], names=["host", "form"])

    def join_trees(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        return pa.table({"host": [key[0].as_py()], "form": [merge(sorted(group.column("form").to_pylist(), key=lambda f: (len(f), f)))]})

    trees = cut(pages.select("url", "html").mapInArrow(read, "host string, form string").distinct())
    while True:
        counted = trees.groupBy("host").agg(F.count(F.lit(1)).alias("k"))
        most = counted.agg(F.max("k")).first()[0] or 0
        if most <= 1:
            return trees.select("host", F.col("form").alias("wrapper"))
        part = F.pmod(F.xxhash64("form"), F.ceil(F.col("k") / ROUND)).alias("part")
        trees = cut(trees.join(counted, "host").select("host", "form", part).groupBy("host", "part").applyInArrow(join_trees, "host string, form string"))


def _along(pages: DataFrame, made: DataFrame, columns: list[str], run: Callable, schema: str) -> DataFrame:
    """``run(host, columns of made, rows of a page)`` over all pages, each beside its host's row of ``made``."""
    made = made.select("host", *columns)
    size = made.agg(F.sum(sum(F.octet_length(c) for c in ["host", *columns]))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        shared = pages.sparkSession.sparkContext.broadcast({r["host"]: tuple(r[c] for c in columns) for r in made.collect()})

        def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from run(((host_of(u), shared.value[host_of(u)], i, u, p) for i, u, p in zip(*[c.to_pylist() for c in batch.columns], strict=True)))

        return _slim(pages).mapInArrow(direct, schema)

    def host(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([host_of(u) for u in batch.column(1).to_pylist()], pa.string())], names=["page_id", "url", "html", "host"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                yield from run(((h, tuple(own), i, u, p) for i, u, p, h, *own in zip(*[c.to_pylist() for c in part.columns], strict=True)))

    # a host may hold a large share of all pages
    salt = F.pmod(F.xxhash64("page_id", F.hash("html")), F.lit(SALTS))
    rows = _slim(pages).mapInArrow(host, "page_id long, url string, html string, host string").withColumn("salt", salt)
    rows = rows.join(made.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["host", "salt"])
    return rows.select("page_id", "url", "html", "host", *columns).mapInArrow(joined, schema)


def _known(most: int = 500) -> Callable[..., Wrapper]:
    held: dict[tuple[str, ...], Wrapper] = {}

    def get(*own: str) -> Wrapper:
        if own not in held:
            if len(held) > most:
                held.clear()
            held[own] = Wrapper(*own)
        return held[own]

    return get


_STATS = ["texts", "pages", "chars", "linked", "running", "low", "high"]


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper, decided): each host's wrapper and what has been decided by the texts along it."""
    made, known = cut(structures(pages)), _known()

    def texts(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], list[int]] = {}
        for host, own, _, _, page in rows:
            for number, x in measure(tree(page or ""), known(*own)).items():
                y = found.get((host, number))
                found[host, number] = x if y is None else [*(a + b for a, b in zip(x[:5], y, strict=False)), min(x[5], y[5]), max(x[6], y[6])]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found]), pa.array([k[1] for k in found], pa.int32()), *(pa.array(list(c), pa.int64()) for c in zip(*found.values(), strict=True))], names=["host", "place", *_STATS])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [decide(form, {x["place"]: [x[c] for c in _STATS] for x in own or []}) for form, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.string())], names=["host", "wrapper", "decided"])

    seen = _along(pages, made, ["wrapper"], texts, "host string, place int, " + ", ".join(f"{c} long" for c in _STATS))
    whole = seen.groupBy("host", "place").agg(*[F.sum(c).alias(c) for c in _STATS[:5]], F.min("low").alias("low"), F.max("high").alias("high"))
    by_host = whole.groupBy("host").agg(F.collect_list(F.struct("place", *_STATS)).alias("stats"))  # MOST_ITEMS at most
    return made.join(by_host, "host", "left").select("host", "wrapper", "stats").mapInArrow(settle, "host string, wrapper string, decided string")


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars per row of ``pages`` (page_id, url, html).

    Null html is an empty page (text ''), a null url belongs to the host ''. Repeated rows give a row each; other columns
    play no part. A page without article or running text gives ''. An empty table gives no rows.
    """
    made, known = cut(wrappers(pages)), _known()

    def run(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        ids, urls, out = [], [], []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

        for _, own, page_id, url, page in rows:
            ids.append(page_id)
            urls.append(url)
            out.append(extract(page or "", known(*own)))
            if len(out) >= 1000:
                yield batch()
                ids, urls, out = [], [], []
        if out:
            yield batch()

    return _along(pages, made, ["wrapper", "decided"], run, "page_id long, url string, text string, n_chars long")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_pages(table(spark, sf_dir, "pages"))

"""Operator 2: HTML main text by union-free wrapper inference.

A page is a tree of containers with text slots (`#`): elements of running text (p, li, h2,
b ..) belong to the slot that they stand in, containers without text fall away.  Siblings
that repeat fold into a repeated group, of any width.  The trees of a host are aligned one
after another, siblings against siblings; where they differ, the nearer of the two next
places at which they meet again is taken, and what only some pages have becomes an
optional group.  The result is the host's wrapper: a regular expression of tokens, slots,
optional and repeated groups without unions (`expression`), which matches every page it
was made from.

With every slot of the wrapper go the pages that have it, the characters of text and of
links in it, and whether its text is the same on all of them.  A page is matched against
its host's wrapper, and of the slots that it has those of the article are chosen from what
the wrapper knows (`main_slots`): not those inside menus, notices and the like, unless such
an element holds most of the page; then those in article or main elements; else, without
texts that stay the same from page to page where a good part of the page changes, those in
the smallest element around nine tenths of the text.  So a host may have
several templates, and each page gets the slots of its own.

Pages of one tree fold within a task, and a host's trees are merged in rounds of groups of
`GROUP`, dealt by hash, until each host has one wrapper: no task holds a hot host.
Wrappers are broadcast while they are few (a checked size), else they are joined by host.

Null and empty pages give an empty text, an empty table gives no rows.  Null urls and those
without a host count as one host.  Repeated rows and ids give a row each; other columns are
not read, whatever their names.  Very long pages are read whole; elements nested deeper
than `MAX_DEPTH` count as their ancestor there.  Broken markup is read as browsers do in the
main: unclosed paragraphs end at the next one, a cut-off tag or comment ends the page.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm import words as W
from lodestar.llm.storage import finished, saved

#: Wrappers are broadcast up to this many hosts and bytes.
MAX_HOSTS, MAX_BYTES = 20_000, 16 << 20
#: Trees that are merged in one group.
GROUP = 64
#: Nested containers that are told apart.
MAX_DEPTH = 100
#: Next places of an element among its siblings that are tried as the start of a repeat.
TRIES = 4
#: Text that stays the same is left out where the text that changes is one part in so many or more.
LEAST_MOVING = 6

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|svg|textarea|select|object)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:"[^"<]*"|'[^'<]*'|[^'">])*(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)|(?P<text>[^<]+|<)""",
    re.S | re.I,
)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", re.I)
_SPACE = re.compile(r"\s+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
#: Elements that only hold running text; the container of a slot is what is around them.
_FLOW = _INLINE | frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li ul ol dl dt dd figure figcaption table tbody thead tr td th".split())
_HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
_BLOCKS = _FLOW - _INLINE | frozenset("div section article main nav aside footer header form hr address fieldset details".split())
#: Elements that never hold the article; and those, beside the words of class, id and role below, that
#: only speak against an element unless it holds most of the page.
_AWAY = frozenset("head title nav footer aside button menu dialog".split())
_DOUBTFUL = frozenset(["form"])
_AWAY_WORDS = frozenset("ad ads advert advertisement adverts sponsor sponsored promo promoted banner nav navbar navigation menu breadcrumb breadcrumbs footer sidebar side aside widget cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe signup login form comment comments disqus replies reply respond share sharing social related recommended masthead toolbar pagination pager skip".split())
_MAIN = frozenset("article main".split())


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("open" | "close" | "text", element name or text, class and id words)."""
    for m in _TOKEN.finditer(page):
        if m["text"] is not None:
            yield "text", m[0], ""
        elif (tag := _TAG.match(m[0])) and not m[1]:
            name = tag[2].lower()
            if tag[1]:
                yield "close", name, ""
            else:
                named = sorted({w for x in _NAMED.findall(m[0]) for w in re.split(r"[^a-z]+", x.lower()) if w})
                yield "open", name, ".".join(named)


def is_away(path: tuple[str, ...]) -> bool:
    """Whether an element around a slot rules the article out by its name."""
    inside = False
    for part in path:
        name = part.partition(".")[0]
        if name in _AWAY or (name == "header" and not inside):
            return True
        inside |= name in _MAIN
    return False


def is_doubtful(label: str) -> bool:
    """Whether an element's name or words speak against it."""
    name, _, words = label.partition(".")
    return name in _DOUBTFUL or (name not in ("html", "body") and any(w in _AWAY_WORDS for w in words.split(".")))


#: A node is [label, optional, repeated, children]; repeated is the number of siblings from it on
#: that repeat together.  A slot has the label "#" and instead of children
#: [pages, least hash, greatest hash, characters outside links, characters in links].
Node = list


class Page:
    """The tree of a page, and its texts in order as (slot, text, number of the block)."""

    def __init__(self, page: str):
        self.root: Node = ["", 0, 0, []]
        self.texts: list[tuple[Node, str, int]] = []
        #: slots that were folded into another one
        self.moved: dict[int, Node] = {}
        self._open: list[tuple[str, Node, int]] = []
        self.links = 0
        block = 0
        for kind, name, words in tokens(page):
            if kind == "text":
                self._text(name, block)
                continue
            if kind == "open":
                self._start(name, words)
            else:
                self._end(name, {"table", "article", "main", "body"} - {name} if name in _FLOW else set())
            block += name not in _INLINE
        self._pruned(self.root)

    def folded(self) -> Page:
        self._fold(self.root)
        return self

    def slot(self, slot: Node) -> Node:
        while id(slot) in self.moved:
            slot = self.moved[id(slot)]
        return slot

    def _text(self, text: str, block: int) -> None:
        kids, size = (self._open[-1][1] if self._open else self.root)[3], len(text.strip())
        if not kids or kids[-1][0] != "#":
            if not size:
                return
            kids.append(["#", 0, 0, [1, 0, 0, 0, 0]])
        slot = kids[-1]
        if size:
            slot[3][3 + (self.links > 0)] += size
            slot[3][1] = slot[3][2] = slot[3][1] + crc32(text.strip().encode("utf-8", "surrogatepass"))
        self.texts.append((slot, text, block))

    def _start(self, name: str, words: str) -> None:
        if name in _BLOCKS:
            self._end("p", {"div", "section", "article", "main", "body", "td", "th", "li", "aside", "form", "nav", "footer", "header"})
        if name in ("li", "td", "th", "tr", "dt", "dd", "option"):
            self._end(name, {"ul", "ol", "table", "tbody", "thead", "dl", "select"})
        if name in _VOID:
            return
        node, depth = (self._open[-1][1:] if self._open else (self.root, 0))
        if depth < MAX_DEPTH and (name not in _FLOW or is_away((name,)) or is_doubtful(f"{name}.{words}")):
            node[3].append(kid := [f"{name}.{words}" if words else name, 0, 0, []])
            node, depth = kid, depth + 1
        self._open.append((name, node, depth))
        self.links += name == "a"

    def _end(self, name: str, fence: set[str]) -> None:
        for i in range(len(self._open) - 1, -1, -1):
            if self._open[i][0] == name:
                self.links -= sum(x[0] == "a" for x in self._open[i:])
                del self._open[i:]
                return
            if self._open[i][0] in fence:
                return

    def _pruned(self, node: Node) -> bool:
        node[3] = [k for k in node[3] if k[0] == "#" or self._pruned(k)]
        return bool(node[3])

    def _absorb(self, a: Node, b: Node) -> None:
        absorb(a, b, _same_page, lambda old, new: self.moved.__setitem__(id(old), new))

    def _fold(self, node: Node) -> None:
        """Siblings that repeat become one group."""
        out: list[Node] = []
        for k in node[3]:
            if k[0] != "#":
                self._fold(k)
            if out and out[-1][0] == k[0]:
                self._absorb(out[-1], k)
                out[-1][2] = max(1, out[-1][2])
            else:
                out.append(k)
        i = 0
        while i < len(out):
            seen = 0
            for j in range(i + 2, len(out)):
                if out[j][0] == out[i][0]:
                    seen, w = seen + 1, j - i
                    if j + w <= len(out) and all(out[i + k][0] == out[j + k][0] for k in range(w)):
                        n = 1
                        while j + (n + 1) * w <= len(out) and all(out[i + k][0] == out[j + n * w + k][0] for k in range(w)):
                            n += 1
                        loose = out[i][2] or any(out[j + k * w][2] for k in range(n))
                        for k in range(n * w):
                            out[i + k % w][2] = max(out[i + k % w][2], out[j + k][2])
                            self._absorb(out[i + k % w], out[j + k])
                        for x in out[i : i + w] if loose else []:
                            x[1] = 1
                        out[i][2] = w
                        del out[j : j + n * w]
                        seen = TRIES
                    if seen == TRIES:
                        break
            i += 1
        node[3] = out


def _same_page(a: list[int], b: list[int]) -> None:
    a[1] = a[2] = a[1] + b[1]
    a[3] += b[3]
    a[4] += b[4]


def _other_page(a: list[int], b: list[int]) -> None:
    a[0] += b[0]
    a[1], a[2] = min(a[1], b[1]), max(a[2], b[2])
    a[3] += b[3]
    a[4] += b[4]


def _places(row: list[Node]) -> dict[str, list[int]]:
    out: dict[str, list[int]] = defaultdict(list)
    for i, x in enumerate(row):
        out[x[0]].append(i)
    return out


def pairs(old: list[Node], new: list[Node]) -> Iterator[tuple[int | None, int | None]]:
    """How two rows of siblings are aligned: (i, j) where they meet, else (i, None) or (None, j)."""
    ahead_old, ahead_new, i, j, far = _places(old), _places(new), 0, 0, len(old) + len(new)

    def skip(ahead: dict[str, list[int]], label: str, at: int) -> int:
        places = ahead.get(label, [])
        k = bisect_left(places, at)
        return places[k] - at if k < len(places) else far

    while i < len(old) and j < len(new):
        if old[i][0] == new[j][0]:
            yield i, j
            i, j = i + 1, j + 1
            continue
        a, b = skip(ahead_old, new[j][0], i), skip(ahead_new, old[i][0], j)
        if a == b == far:
            a = b = 1
        elif a <= b:
            b = 0
        else:
            a = 0
        for _ in range(a):
            yield i, None
            i += 1
        for _ in range(b):
            yield None, j
            j += 1
    yield from ((k, None) for k in range(i, len(old)))
    yield from ((None, k) for k in range(j, len(new)))


def absorb(a: Node, b: Node, add: Callable, move: Callable = lambda old, new: None) -> None:
    """Makes `a` match all that `b` matches too; `b` is used up."""
    a[1] |= b[1]
    if a[0] == "#":
        add(a[3], b[3])
        move(b, a)
        return
    out, spans = [], []
    place: tuple[dict[int, int], dict[int, int]] = ({}, {})
    for i, j in pairs(a[3], b[3]):
        x = b[3][j] if i is None else a[3][i]
        if i is None or j is None:
            x[1] = 1
        for k, at in ((0, i), (1, j)):
            if at is not None:
                place[k][at] = len(out)
        out.append(x)
    for k, row in enumerate((a[3], b[3])):
        spans += [(place[k][i], place[k][i + x[2] - 1] + 1, x[2]) for i, x in enumerate(row) if x[2]]
    for i, j in [(i, j) for i, j in pairs(a[3], b[3]) if i is not None and j is not None]:
        absorb(a[3][i], b[3][j], add, move)
    a[3] = out
    for x in out:
        x[2] = 0
    for start, end, loose in _joined(spans):
        out[start][2] = end - start
        if loose:
            for x in out[start:end]:
                x[1] = 1


def _joined(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, bool]]:
    """Repeated groups that do not cross: those that overlap become one, whose members may be missing."""
    out: list[tuple[int, int, bool]] = []
    for start, end, width in sorted(spans):
        if out and start < out[-1][1] and (start, end) != out[-1][:2]:
            out[-1] = (out[-1][0], max(end, out[-1][1]), True)
        elif not out or start >= out[-1][1]:
            out.append((start, end, False))
    return out


def _row(kids: list[Node]) -> Iterator[str]:
    until: list[int] = []
    for i, (label, optional, repeated, inside) in enumerate(kids):
        if repeated:
            yield "("
            until.append(i + repeated)
        one = "#" if label == "#" else f"<{label}>{''.join(_row(inside))}</{label}>"
        yield f"({one})?" if optional else one
        while until and until[-1] <= i + 1:
            yield ")+"
            until.pop()


def expression(wrapper: Node) -> str:
    """The wrapper as a regular expression over tokens; # is a text slot."""
    return "".join(_row(wrapper[3]))


def slots(wrapper: Node) -> list[tuple[tuple[str, ...], tuple[int, ...], Node]]:
    """Every slot with the labels and the places of the elements around it."""
    out, stack = [], [(wrapper, (), ())]
    while stack:
        node, labels, places = stack.pop()
        for i, k in enumerate(node[3]):
            if k[0] == "#":
                out.append((labels, places, k))
            else:
                stack.append((k, (*labels, k[0]), (*places, i)))
    return out


def matched(wrapper: Node, page: Node) -> dict[int, Node]:
    """The wrapper's slot for each slot of a folded page, by the page's slot; what the wrapper lacks is left out."""
    out, stack = {}, [(wrapper, page)]
    while stack:
        a, b = stack.pop()
        for i, j in pairs(a[3], b[3]):
            if i is not None and j is not None:
                x, y = a[3][i], b[3][j]
                if x[0] == "#":
                    out[id(y)] = x
                else:
                    stack.append((x, y))
    return out


Known = tuple[tuple[str, ...], tuple[int, ...], Node]


def _size(x: Known) -> float:
    """A page's characters in a slot, outside links."""
    return max(0, x[2][3][3] - x[2][3][4]) / x[2][3][0]


def _without_doubtful(known: list[Known]) -> list[Known]:
    """Slots outside of doubtful elements.

    An element that holds half of the text or more is not doubtful if it holds an article,
    main or h1 element too, or if nothing would be left without it."""
    total, weight, holds = sum(map(_size, known)), defaultdict(float), set()
    for x in known:
        for n, label in enumerate(x[0]):
            if is_doubtful(label):
                weight[x[1][: n + 1]] += _size(x)
                if any(p.partition(".")[0] in _MAIN or p.partition(".")[0] == "h1" for p in x[0][n:]):
                    holds.add(x[1][: n + 1])
    most = {p for p, w in weight.items() if 2 * w >= total}
    for fine in (most & holds, most):
        left = [x for x in known if not any(is_doubtful(label) and x[1][: n + 1] not in fine for n, label in enumerate(x[0]))]
        if any(_size(x) for x in left):
            break
    return left


def main_slots(known: list[Known]) -> set[int]:
    """Which of a page's slots hold the article, by what the wrapper knows of them.

    Article and main elements count first.  Without them, text that is the same on every
    page of the host that has it, on two or more, is left out where what changes is a part
    of one in LEAST_MOVING or more, so not a date beside an article that many pages share;
    then the smallest element around nine tenths of the text counts."""
    left = _without_doubtful([x for x in known if not is_away(x[0])])
    marked = [x for x in left if any(p.partition(".")[0] in _MAIN or p.partition(".")[2] == "main" for p in x[0])]
    if marked:
        return {id(x[2]) for x in marked}
    moving = [x for x in left if x[2][3][0] < 2 or x[2][3][1] != x[2][3][2]]
    if LEAST_MOVING * sum(map(_size, moving)) >= sum(map(_size, left)) > 0:
        left = moving
    weight: dict[tuple[int, ...], float] = defaultdict(float)
    for x in left:
        for n in range(len(x[1]) + 1):
            weight[x[1][:n]] += _size(x)
    total = weight.get((), 0)
    best = max((p for p, w in weight.items() if 10 * w >= 9 * total), key=lambda p: (len(p), p), default=())
    return {id(x[2]) for x in left if x[1][: len(best)] == best}


class Reader:
    """Texts of a host's pages by its wrapper."""

    def __init__(self, wrapper: Node):
        self.wrapper = wrapper
        self.known = {id(x[2]): x for x in slots(wrapper)}
        self.chosen: dict[frozenset[int], set[int]] = {}

    def text(self, page: str | None) -> str:
        if not page:
            return ""
        tree = Page(page).folded()
        of = matched(self.wrapper, tree.root)
        has = frozenset(id(x) for x in of.values())
        if has not in self.chosen:
            if len(self.chosen) > 1000:
                self.chosen.clear()
            self.chosen[has] = main_slots([self.known[k] for k in self.known if k in has])
        main, parts, at = self.chosen[has], [], None
        for slot, text, block in tree.texts:
            to = of.get(id(tree.slot(slot)))
            if to is not None and id(to) in main:
                if at != (block, id(slot)):
                    parts.append([])
                at = (block, id(slot))
                parts[-1].append(html.unescape(text))
        return " ".join(b for b in (_SPACE.sub(" ", "".join(x)).strip() for x in parts) if b)


def merged(trees: list[Node]) -> Node:
    """The wrapper of several trees; they are used up."""
    first = trees[0]
    for x in trees[1:]:
        absorb(first, x, _other_page)
    return first


def host(url: Column) -> Column:
    """The host of a url in small letters; empty for null and for what has none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, pages, wrapper, expression): the wrapper of every host as JSON, and to read."""
    rows = pages.select(host(F.col(url_col)).alias("host"), F.col(html_col).alias("_html"))
    kind = "host string, pages bigint, wrapper string"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts = batch.column("host").to_pylist()
            trees: dict[tuple[str, str], tuple[int, Node]] = {}
            for at, _, texts in W.chunks(batch, "_html"):
                for h, t in zip(hosts[at:], texts):
                    if t and (tree := Page(t.decode()).folded().root)[3]:
                        key = (h, expression(tree))
                        n, known = trees.get(key, (0, tree))
                        if n:
                            absorb(known, tree, _other_page)
                        trees[key] = (n + 1, known)
            yield pa.RecordBatch.from_pydict({"host": pa.array([h for h, _ in trees], pa.string()), "pages": pa.array([n for n, _ in trees.values()], pa.int64()), "wrapper": pa.array([json.dumps(x) for _, x in trees.values()], pa.string())})

    def join(group: pa.Table) -> pa.Table:
        found = sorted(zip(group.column("pages").to_pylist(), group.column("wrapper").to_pylist()), key=lambda x: (-x[0], x[1]))
        whole = merged([json.loads(x) for _, x in found])
        return pa.table({"host": group.column("host")[:1], "pages": pa.array([sum(n for n, _ in found)], pa.int64()), "wrapper": pa.array([json.dumps(whole)], pa.string())})

    now = saved(rows.mapInArrow(read, kind), "trees")
    while True:
        n = now.groupBy("host").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if n <= 1:
            break
        parts = now.groupBy("host").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts"))
        dealt = now.join(parts, "host").withColumn("part", F.pmod(F.xxhash64("pages", "wrapper"), F.col("parts")))
        now = saved(dealt.groupBy("host", "part").applyInArrow(join, kind), "trees")

    @F.arrow_udf("string")
    def readable(wrapper: pa.Array) -> pa.Array:
        return pa.array([expression(json.loads(x)) for x in wrapper.to_pylist()], pa.string())

    return now.withColumn("expression", readable("wrapper"))


@finished("main-text")
def extract(pages: DataFrame, found: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page, by the wrappers of `wrappers`; written to the shared folder."""
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"), host(F.col(url_col)).alias("host"))
    schema = f"_id {rows.schema['_id'].dataType.simpleString()}, _url string, text string, n_chars bigint"
    size = found.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("wrapper") + F.length("host")), F.lit(0)).alias("bytes")).first()
    few = size["n"] <= MAX_HOSTS and size["bytes"] <= MAX_BYTES
    shared = pages.sparkSession.sparkContext.broadcast({r["host"]: r["wrapper"] for r in found.select("host", "wrapper").collect()}) if few else None
    rows = rows if few else rows.join(found.select("host", "wrapper"), "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Reader] = {}

        def reader(host: str, wrapper: str | None) -> Reader:
            if host not in known:
                if len(known) > 1000:
                    known.clear()
                known[host] = Reader(json.loads(wrapper) if wrapper else ["", 0, 0, []])
            return known[host]

        for batch in batches:
            hosts = batch.column("host").to_pylist()
            wraps = [shared.value.get(h) for h in hosts] if few else batch.column("wrapper").to_pylist()
            for at, end, texts in W.chunks(batch, "_html"):
                out = [reader(h, x).text(t.decode() if t else None) for t, h, x in zip(texts, hosts[at:end], wraps[at:end])]
                yield pa.RecordBatch.from_arrays([batch.column("_id").slice(at, end - at), batch.column("_url").slice(at, end - at), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["_id", "_url", "text", "n_chars"])

    return rows.mapInArrow(run, schema).select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text", "n_chars")

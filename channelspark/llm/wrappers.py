"""Main text of web pages by union-free regular-expression inference over the pages of a host.

A page is a stream of tags and texts. Per host the streams are aligned one after the other into one *wrapper*: a
regular expression without unions, made of block elements, text slots, optional parts (``?``) and repeated groups (``+``). Where two
streams differ, neighbours that look alike are first folded into a repeated group and what is left without a partner becomes optional;
differing texts become a slot. Each text slot keeps what is needed to tell fixed text from content: on how many pages it was seen, the least and
greatest hash of its text, its characters and those inside links.

The wrapper then says, slot by slot, what is main text: below the article (or main) element and outside of menus,
headers, footers, sidebars, notices, adverts, forms, scripts and comments, told by tag and by class, id and role names; where a
host's pages name no article, the smallest part that holds most of the changing text outside of links. A page is aligned
with its host's wrapper to read its text.

Spark spreads the work: streams are first merged with those of the same shape inside a batch, then per host and part of the shapes, then
per host. A merge holds one wrapper and one stream, in the order of the shapes, so a host with most of all pages needs no large group and the
outcome does not depend on the partitioning. Pages meet their wrapper by a join that may be split. Nothing is collected.

Defined cases: null html counts as empty and gives the empty text; a null or odd url is a host of its own kind (the empty
one); copies of a page count as evidence of nothing where all texts are equal; texts of any length are read whole; an empty table gives an empty
result; extra columns are kept in ``row``, whatever their names. The only size rule: lists of more than ``LONG`` neighbours are aligned by
first match instead of the longest common part, which keeps all their texts.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from channelspark.llm.common import packed
from channelspark.session import stored

LONG = 400
#: Wrappers that a task keeps ready.
KNOWN = 256
#: Elements nested deeper only break the text.
DEEP = 150
#: Longest repeated group that is looked for, in neighbouring elements.
PERIOD = 4
#: Parts into which a host's shapes are dealt before its wrapper is made.
PARTS = 32

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[^<]+|<""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NUMBER = re.compile(r"(?<![^\s_-])\d+(?![^\s_-])")
#: Elements that break the text, by the HTML standard's default style (fixed values).
BLOCKS = frozenset("""
address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset
h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre search section summary
table tbody td tfoot th thead tr ul xmp
""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes template svg math object canvas audio video select button map".split())
#: An opening tag closes an open element of these kinds first, unless one of the barriers lies between.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
          "thead": {"thead", "tbody", "tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
BARRIERS = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}}
TABLE_BARRIER = frozenset(["table"])
PARAGRAPH_ENDERS = BLOCKS - {"caption", "dd", "dt", "legend", "li", "optgroup", "option", "tbody", "td", "tfoot", "th", "thead", "tr", "head", "body", "html"} | {"li", "dd", "dt"}

#: Elements that may hold anything; equal tags alone make no repetition of them.
BOXES = frozenset("div section article table main center body ul ol dl".split())

#: Names that mark what is not the article (fixed values); whole words of class, id and role.
NOT_MAIN_TAGS = frozenset("nav footer aside form fieldset head menu dialog search legend option".split())
NOT_MAIN = frozenset("""
ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner nav navbar navigation menu menus submenu
breadcrumb breadcrumbs sidebar sidenav rail aside complementary footer footnav masthead topbar toolbar notice notices cookie cookies consent gdpr alert disclaimer
popup modal overlay comment comments commentlist reply replies respond responses discussion disqus feedback form search searchbox login
signup subscribe subscription newsletter share sharing social related recommended recommendations pagination pager widget widgets skip
contentinfo toc tags kommentar kommentare comentario comentarios commentaire commentaires
""".split())
QUALIFIERS = frozenset(["has", "with", "no", "without"])
HEADER = frozenset(["header", "head"])
ARTICLE_NAMES = frozenset("article articlebody post entry story articlecontent postcontent entrycontent articletext storybody".split())
MAIN_NAMES = frozenset("main maincontent content".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


@dataclass(slots=True)
class Item:
    """``key`` is ``#`` for a text slot, ``()`` for a repeated group, otherwise tag and names; ``flag`` is empty, ``?``, ``+`` or ``*``."""

    key: str
    flag: str = ""
    items: list[Item] = field(default_factory=list)
    slot: list | None = None


def text_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) >> 11


def names_of(attributes: str) -> list[str]:
    """Words of class, id and role; numbers of their own go (``post-123``), as they tell pages apart, not places."""
    found = []
    for name, *values in ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name in ("class", "id", "role"):
            found += [w for w in NUMBER.sub("", entities.unescape("".join(values))).split() if w.strip("-_")]
        elif name == "hidden":
            found.append("hidden")
        elif name == "aria-hidden" and "".join(values).strip().lower() == "true":
            found.append("hidden")
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", "".join(values), re.I):
            found.append("hidden")
    return sorted(set(found))


class Page:
    """Block elements of a page with one text slot per run of text; ``texts`` holds the runs."""

    def __init__(self, source: str):
        self.texts: list[str] = []
        self.root = Item("")
        self._open = [self.root]
        self._run: list[str] = []
        self._linked = 0
        self._anchor = 0
        self._too_deep: dict[str, int] = {}
        self._read(source)
        self._flush()
        while self._open:
            self._close()

    def _read(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            token = TOKEN.match(source, at)
            at = token.end()
            tag = token[2] or token[5]
            if not tag:
                if not token[0].startswith("<") or token[0] == "<":
                    self._text(token[0])
                continue
            tag, closing, attributes = tag.lower(), token[1] or token[4], token[3] or token[6] or ""
            if closing:
                self._end(tag)
            elif tag in RAW:
                if not attributes.rstrip().endswith("/"):
                    close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
                    at = close.end() if close else end if tag in ("script", "style", "textarea", "title", "xmp") else at
            else:
                self._start(tag, attributes)

    def _text(self, raw: str) -> None:
        text = entities.unescape(raw)
        self._run.append(text)
        if self._anchor:
            self._linked += len(text.strip())

    def _start(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self._flush()
            if tag in PARAGRAPH_ENDERS:
                self._close_open({"p"}, TABLE_BARRIER)
            if tag in CLOSES:
                self._close_open(CLOSES[tag], BARRIERS.get(tag, TABLE_BARRIER))
            if tag in ("html", "body") and any(i.key.split(" ")[0] == tag for i in self._open):
                return
            if len(self._open) > DEEP:
                if tag not in VOID:
                    self._too_deep[tag] = self._too_deep.get(tag, 0) + 1
                return
            item = Item(" ".join([tag, *names_of(attributes)]))
            self._open[-1].items.append(item)
            if tag not in VOID:
                self._open.append(item)
        elif tag == "a":
            self._anchor = 1
        elif tag == "br":
            self._run.append(" ")

    def _end(self, tag: str) -> None:
        if tag in BLOCKS:
            self._flush()
            if self._too_deep.get(tag):
                self._too_deep[tag] -= 1
                return
            for depth in range(len(self._open) - 1, 0, -1):
                if self._open[depth].key.split(" ")[0] == tag:
                    while len(self._open) > depth:
                        self._close()
                    return
        elif tag == "a":
            self._anchor = 0

    def _close_open(self, tags: set[str], barriers) -> None:
        for depth in range(len(self._open) - 1, 0, -1):
            own = self._open[depth].key.split(" ")[0]
            if own in tags:
                while len(self._open) > depth:
                    self._close()
            elif own in barriers or own in ("article", "section", "div", "td", "th", "body"):
                return

    def _close(self) -> None:
        self._flush()
        item = self._open.pop()
        item.items = fold(item.items)

    def _flush(self) -> None:
        text = " ".join("".join(self._run).split())
        if text:
            slot = [[len(self.texts)], 1, text_hash(text), 0, len(text), min(self._linked, len(text))]
            slot[3] = slot[2]
            self._open[-1].items.append(Item("#", slot=slot))
            self.texts.append(text)
        self._run, self._linked = [], 0


# A slot: [places in the page's texts], pages, least hash, greatest hash, characters, characters in links, [is it main text].


def both_slots(a: list, b: list) -> list:
    return [a[0] + b[0], a[1] + b[1], min(a[2], b[2]), max(a[3], b[3]), a[4] + b[4], a[5] + b[5], *(a[6:] or b[6:])]


def joined(a: str, b: str) -> str:
    """Flag of an item that has flag ``a`` here and ``b`` there."""
    many, maybe = a in ("+", "*") or b in ("+", "*"), a in ("?", "*") or b in ("?", "*")
    return "*" if many and maybe else "+" if many else "?" if maybe else ""


def merged(a: Item, b: Item, flag: str | None = None, folded: bool = True) -> Item:
    flag = joined(a.flag, b.flag) if flag is None else flag
    if a.key == "#":
        return Item("#", flag, slot=both_slots(a.slot, b.slot))
    return Item(a.key, flag, aligned(a.items, b.items, folded))


def optional(item: Item) -> Item:
    return Item(item.key, joined(item.flag, "?"), item.items, item.slot)


def alike(a: Item, b: Item) -> bool:
    """Elements and slots are alike by key, groups by the keys of what they repeat."""
    return a.key == b.key and (a.key != "()" or [i.key for i in a.items] == [i.key for i in b.items])


def repeats(a: Item, b: Item) -> bool:
    """Whether ``b`` repeats ``a``: alike, and boxes that may hold anything must hold the same kinds of things."""
    if not alike(a, b):
        return False
    return a.key.split(" ")[0] not in BOXES or {i.key for i in a.items} == {i.key for i in b.items}


def fold(items: list[Item]) -> list[Item]:
    """Neighbours that repeat become one item or one group with the flag ``+``."""
    if len(items) < 2:
        return items
    for period in range(1, PERIOD + 1):
        out: list[Item] = []
        at = 0
        while at < len(items):
            first = items[at : at + period]
            end = at + period
            if period > 1 and not (len(first) == period and len({i.key for i in first}) > 1):
                out.append(items[at])
                at += 1
                continue
            body = first
            while len(again := items[end : end + period]) == period and all(map(repeats, body, again)):
                body = [merged(x, y, joined(x.flag, y.flag) if period > 1 else "+") for x, y in zip(body, again)]
                end += period
            if end == at + period:
                out.append(items[at])
                at += 1
            else:
                out += body if period == 1 else [Item("()", "+", body)]
                at = end
        items = out
    return items


def partners(a: Sequence[Item], b: Sequence[Item]) -> Iterator[tuple[int, int]]:
    """Pairs of places that the longest common part of both lists takes."""
    head = 0
    while head < min(len(a), len(b)) and alike(a[head], b[head]):
        yield head, head
        head += 1
    n, m = len(a), len(b)
    tail = 0
    while tail < min(n, m) - head and alike(a[n - 1 - tail], b[m - 1 - tail]):
        tail += 1
    x, y = a[head : n - tail], b[head : m - tail]
    if max(len(x), len(y)) > LONG:
        at = 0
        for i, item in enumerate(x):
            j = next((j for j in range(at, min(len(y), at + LONG)) if alike(item, y[j])), None)
            if j is not None:
                yield head + i, head + j
                at = j + 1
    elif x and y:
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in reversed(range(len(x))):
            for j in reversed(range(len(y))):
                best[i][j] = best[i + 1][j + 1] + 1 if alike(x[i], y[j]) else max(best[i + 1][j], best[i][j + 1])
        i = j = 0
        while i < len(x) and j < len(y):
            if alike(x[i], y[j]):
                yield head + i, head + j
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    for k in reversed(range(tail)):
        yield n - 1 - k, m - 1 - k


def aligned(a: list[Item], b: list[Item], folded: bool = True) -> list[Item]:
    """One list that generates both; ``folded`` looks for repeated groups among what had no partner."""
    out: list[Item] = []
    i = j = 0
    for x, y in [*partners(a, b), (len(a), len(b))]:
        out += [optional(item) for item in a[i:x]] + [optional(item) for item in b[j:y]]
        if x < len(a):
            out.append(merged(a[x], b[y], None, folded))
        i, j = x + 1, y + 1
    return fold(out) if folded and len(out) > max(len(a), len(b)) else out


def shape(items: list[Item]) -> str:
    return "".join(f"<{i.key}{i.flag}{shape(i.items)}>" for i in items)


def packed_items(items: list[Item]) -> list:
    return [[i.key, i.flag, i.slot[1:] if i.slot else packed_items(i.items)] for i in items]


def unpacked_items(rows: list) -> list[Item]:
    return [Item("#", f, slot=[[], *body]) if k == "#" else Item(k, f, unpacked_items(body)) for k, f, body in rows]


# What is main text.


def words_of(key: str) -> set[str]:
    """Lower-case words of an element's names, alone and as neighbours written together; ``has-sidebar`` names no sidebar."""
    found = set()
    for name in key.split(" ")[1:]:
        parts = [p.lower() for p in re.findall(r"[A-Z]?[a-zà-ÿ]+|[A-Z]+(?![a-z])", name)]
        if QUALIFIERS & set(parts):
            continue
        found |= {*parts, *("".join(pair) for pair in zip(parts, parts[1:]))}
    return found


def by_tag(item: Item) -> bool:
    return item.key.split(" ")[0] == "article" and not is_aside(item, True)


def by_name(names: frozenset[str]):
    def test(item: Item) -> bool:
        tag = item.key.split(" ")[0]
        return (tag in names or bool(words_of(item.key) & names)) and tag not in ("html", "body", *HEADINGS) and not is_aside(item, True)

    return test


def is_aside(item: Item, inside: bool) -> bool:
    """Whether the element is none of the main text; a header inside an article belongs to it."""
    tag, words = item.key.split(" ")[0], words_of(item.key)
    return (tag in NOT_MAIN_TAGS or bool(words & NOT_MAIN) or "hidden" in words
            or not inside and (tag == "header" or bool(words & HEADER)))


def slots(items: list[Item]) -> Iterator[Item]:
    for item in items:
        if item.key == "#":
            yield item
        else:
            yield from slots(item.items)


def decide(wrapper: list[Item]) -> None:
    """Append to every slot whether it is main text."""
    for slot in slots(wrapper):
        slot.slot[6:] = [False]
    found: list[Item] = []
    for test in (by_tag, by_name(ARTICLE_NAMES), by_name(MAIN_NAMES)):
        found = found or [i for i in named(wrapper, test) if any(True for _ in slots(i.items))]
    # an article inside a box whose names (or an all-embracing form) would exclude it, where there is no other
    found = found or [i for i in named(wrapper, lambda i: i.key.split(" ")[0] in ("article", "main"), False) if any(True for _ in slots(i.items))]
    if found:
        for item in found:
            mark(item.items, True)
        return
    changing = any(varies(s) for s in slots(wrapper))
    part, inside = wrapper, False
    while True:
        open_items = [i for i in part if i.key != "#" and not is_aside(i, inside)]
        weights = [weight(i.items, changing) for i in open_items]
        whole = weight(part, changing)
        best = max(range(len(weights)), key=weights.__getitem__, default=None)
        if best is None or 2 * weights[best] <= whole or open_items[best].key.split(" ")[0] in ("p", *HEADINGS) or open_items[best].flag in ("+", "*"):
            break
        part = open_items[best].items
    mark(part, False, lambda s: not changing or varies(s))
    if not any(s.slot[6] for s in slots(wrapper)):
        mark(part, False)


def named(items: list[Item], test, strict: bool = True) -> list[Item]:
    """Outermost elements that pass ``test``, outside of menus and the like (unless not ``strict``: of all but boxes and forms)."""
    found = []
    for item in items:
        if item.key != "#" and test(item):
            found.append(item)
        elif item.key != "#" and (not is_aside(item, False) or not strict and item.key.split(" ")[0] in (*BOXES, "form")):
            found += named(item.items, test, strict)
    return found


def varies(item: Item) -> bool:
    """A slot that shows one text on several pages is fixed; one mostly of links is a menu."""
    _, pages, least, most, chars, linked, *_ = item.slot
    return (pages < 2 or least != most) and 2 * linked < chars


def weight(items: list[Item], changing: bool) -> int:
    total = 0
    for item in items:
        if item.key == "#":
            total += (item.slot[4] - item.slot[5]) if varies(item) or not changing else 0
        elif not is_aside(item, False):
            total += weight(item.items, changing)
    return total


def mark(items: list[Item], inside: bool, test=lambda s: True) -> None:
    for item in items:
        if item.key == "#":
            item.slot[6:] = [test(item)]
        elif not is_aside(item, inside):
            mark(item.items, inside, test)


def read(page: Page, wrapper: list[Item]) -> str:
    """Main text of a page by its host's wrapper."""
    own = {item.slot[0][0]: item for item in slots(page.root.items)}
    places: list[int] = []
    unknown = False
    for item in slots(aligned(wrapper, page.root.items, folded=False)):
        first, *measures = item.slot
        if first:
            unknown |= not measures[5:]
            own[first[0]].slot[1:] = measures[:5]
            places += first if measures[5:] == [True] else []
    if unknown or not places:  # a page of another build than the wrapper's: by its own elements and the host's measures
        decide(page.root.items)
        places = [place for item in slots(page.root.items) if item.slot[6] for place in item.slot[0]]
    return "\n".join(page.texts[place] for place in sorted(places))


# Spark.


def host_of(url: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:\\]+)", 1)), F.lit(""))


WRAPPER = "host string, part int, shape string, wrapper string"


def streams(pages: DataFrame) -> DataFrame:
    """Folded streams of (host, html), merged with those of the same shape in their batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[str, str], list[Item]] = {}
            for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                items = Page(source).root.items
                for slot in slots(items):
                    slot.slot[0] = []
                key = (host, shape(items))
                found[key] = aligned(found[key], items) if key in found else items
            yield rows([(h, text_hash(s) % PARTS, s, w) for (h, s), w in found.items()])

    return pages.mapInArrow(run, WRAPPER)


def rows(found: list[tuple[str, int, str, list[Item]]]) -> pa.RecordBatch:
    hosts, parts, shapes, wrappers = zip(*found) if found else ([],) * 4
    return pa.RecordBatch.from_arrays([
        pa.array(hosts, pa.string()), pa.array(parts, pa.int32()), pa.array(shapes, pa.string()),
        pa.array([json.dumps(packed_items(w), separators=(",", ":")) for w in wrappers], pa.string()),
    ], names=["host", "part", "shape", "wrapper"])


def merging(found: DataFrame, key: Sequence[str], final: bool) -> DataFrame:
    """One wrapper per ``key``: sorted rows come in one by one, a task holds the wrapper so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, wrapper, same = None, [], ("", [])

        def done() -> list:
            if current is None:
                return []
            whole = aligned(wrapper, same[1])
            if final:
                decide(whole)
            return [(current[0], current[1], "" if final else shape(whole), whole)]

        for batch in batches:
            out = []
            for host, part, build, text in zip(*(batch.column(c).to_pylist() for c in ("host", "part", "shape", "wrapper"))):
                own, items = (host, 0 if final else part), unpacked_items(json.loads(text))
                if own != current:
                    out += done()
                    current, wrapper, same = own, items, (build, [])
                elif not same[1] and build == same[0]:  # measures of one shape first, so their order does not matter
                    wrapper = aligned(wrapper, items)
                elif build == same[0]:
                    same = (build, aligned(same[1], items))
                else:
                    wrapper = aligned(wrapper, same[1])
                    same = (build, items)
            yield rows(out)
        yield rows(done())

    return found.repartition(*key).sortWithinPartitions(*key, "shape").mapInArrow(run, WRAPPER)


def infer(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row (``host``, ``wrapper``) per host."""
    source = pages.select(host_of(url_col).alias("host"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    found = stored(streams(source), "page-streams")
    return stored(merging(merging(found, ["host", "part"], False), ["host"], True).select("host", "wrapper"), "wrappers")


def extract(pages: DataFrame, wrappers: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``row`` (the input row) and ``text``, its main text."""
    source = pages.select(packed(pages).alias("row"), host_of(url_col).alias("host"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))

    @F.pandas_udf("string")
    def text_of_page(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known: dict[str, list[Item]] = {}
        for sources, texts in batches:
            out = []
            for html, text in zip(sources, texts):
                if text not in known:
                    if len(known) >= KNOWN:
                        known.clear()
                    known[text] = unpacked_items(json.loads(text))
                out.append(read(Page(html), known[text]))
            yield pd.Series(out, dtype=object)

    return source.join(wrappers, "host").select("row", text_of_page("html", "wrapper").alias("text"))

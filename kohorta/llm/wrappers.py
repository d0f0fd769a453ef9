"""Main text of web pages by union-free wrappers inferred for each host.

A page becomes a stream of tokens: tags (with class and id words) and text.  Runs of equal token groups are
folded into repeated groups; then the streams of a host's pages are aligned one after the other, and every
mismatch is resolved into an optional group, a repeated group (where one side is another instance of a group
that the other repeats) or a text slot.  The outcome is a union-free regular expression with text slots, each
of which has a place: its chain of containers.

Every page of a host is read against its slots: a place whose texts are the same on the pages that fill it is part of
the template, one whose texts differ holds what the page says.  A place whose slots the expression has inside links
only is a menu.  The wrapper's main places are those inside an article (or else main) element, or where the
host has none all but menus; template text goes, and so do places that the names of their elements, or words of
classes, say are something else.  Extraction reads a page's text at those places.

Every page's folded stream takes part: equal ones of a host, its shapes, are aligned once.  A host's shapes are dealt
to buckets that are aligned by themselves, and the buckets' expressions then with each other, so that no task
sees all shapes of a large host.

Defined results: null and empty html give an empty text; a host with one page has a wrapper of that page; a
page with text, but none at its host's main places, is read by its own; where all of a host's pages say the
same, that is the page's text; unclosed elements end with their container; repeated rows give repeated results.
"""

from __future__ import annotations

import html as _html
import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, small_batches, stored

from .url_rules import host_of

#: Distinct shapes that a task keeps to send each once.
KEPT_SHAPES = 20_000
#: Groups that a host's shapes are dealt to.
BUCKETS = 32
#: Pages of different text that must fill a place before its text can count as the template's, times that they outnumber the place's
#: texts, and the share that they are of all such pages of the host.
TEMPLATE_PAGES, TEMPLATE_TIMES, TEMPLATE_SHARE = 3, 3, 0.5
#: Stands for a page as a whole among its places; no place has a line break.
WHOLE = "\n"
#: Bytes of all hosts' main places up to which they are broadcast.
BROADCAST_BYTES = 32 << 20
LONGEST_GROUP = 8

# Elements of HTML.
DROPPED = {"script", "style", "noscript", "template", "svg", "iframe", "textarea", "select", "button", "object", "canvas", "math", "title"}
#: Of these, what runs to the closing tag or the end of the page, and what does so only if it is closed before the next of its name.
RAW, RAW_IF_CLOSED = {"script", "style", "textarea", "title"}, {"iframe", "noscript"}
FOREIGN = {"svg", "math"}
BOILERPLATE = {"nav", "header", "footer", "aside", "form", "head", "menu", "dialog"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "li", "main", "menu", "nav", "ol", "p",
    "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
CONTAINERS = {"html", "head", "body", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "menu", "dialog", "ul", "ol", "dl", "table"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Words of class and id attributes, and roles, of what is not the article.
MARKS = {
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "banners", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie",
    "cookies", "discussion", "disqus", "footer", "header", "masthead", "menu", "nav", "navbar", "navigation", "newsletter", "notice", "notices",
    "pagination", "popup", "promo", "promoted", "related", "reply", "replies", "respond", "share", "sharing", "sidebar", "social", "sponsor",
    "sponsored", "subscribe", "toolbar", "widget", "widgets", "complementary", "contentinfo", "alert",
}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>" + "|".join(sorted(RAW)) + r")(?![\w:-])(?:\"[^\"]*\"|'[^']*'|[^'\"<>])*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<sure>" + "|".join(sorted(RAW_IF_CLOSED)) + r")(?![\w:-])(?:\"[^\"]*\"|'[^']*'|[^'\"<>])*+(?<!/)>(?:(?!<(?P=sure)(?![\w:-])).)*?</(?P=sure)\s*>"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][\w:-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\"<>])*+)>"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.I | re.S,
)
#: A slash that ends a tag and is not the end of an unquoted value.
_CLOSED = re.compile(r"(?:^|[\s\"'])[^\s\"'=]*/\s*$")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_WORD = re.compile(r"[a-z]+")

TEXT = "#"
Token = tuple


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, words or text): kinds are open, close and text; comments and dropped elements are out.

    A dropped element ends with its closing tag, with that of an element around it, or at once if it closes itself.
    """
    stack: list[str] = []
    count: Counter[str] = Counter()
    dropped = -1  # place of the dropped element in the stack
    for m in _TOKEN.finditer(page):
        if m["text"] is not None:
            if dropped < 0:
                yield "text", "", m["text"]
        elif m["tag"]:
            tag = m["tag"].lower()
            if m["close"]:
                if count[tag]:
                    while True:
                        count[last := stack.pop()] -= 1
                        if last == tag:
                            break
                    if len(stack) <= dropped:
                        dropped = -1
                if dropped < 0 and tag not in DROPPED:
                    yield "close", tag, ""
                continue
            foreign = dropped >= 0 and stack[dropped] in FOREIGN
            ends = tag in VOID or ((foreign or tag in DROPPED) and _CLOSED.search(m["attrs"]) is not None)
            if dropped < 0 and tag in DROPPED:
                dropped = -1 if ends else len(stack)
            elif dropped < 0:
                names = " ".join(x.strip("\"'") for x in _NAMES.findall(m["attrs"])).lower() if m["attrs"] else ""
                yield "open", tag, " ".join(sorted(set(_WORD.findall(names))))
            if not ends:
                stack.append(tag)
                count[tag] += 1


def blocks(stream: Iterable[tuple[str, str, str]]) -> Iterator[tuple[str, str]]:
    """(place, text) of each block of a page's tokens in order.  A place is the chain of open containers."""
    stack: list[str] = []
    place, parts = "", []

    def flush() -> Iterator[tuple[str, str]]:
        if parts and (text := " ".join(_html.unescape("".join(parts)).split())):
            yield place, text
        parts.clear()

    for kind, name, what in stream:
        if kind == "text":
            parts.append(what)
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name not in BLOCKS:
            continue
        yield from flush()
        if name in CONTAINERS:
            if kind == "open":
                stack.append(f"{name} {what}".strip())
            elif any(x.split(" ")[0] == name for x in stack):
                while stack.pop().split(" ")[0] != name:
                    pass
            place = "/".join(stack)
    yield from flush()


def skeleton(stream: Iterable[tuple[str, str, str]]) -> list[Token]:
    """Tags and text slots of a page's tokens; neighbouring texts are one slot, white space none."""
    out: list[Token] = []
    for kind, name, what in stream:
        if kind == "text":
            if what.strip() and (not out or out[-1] != (TEXT,)):
                out.append((TEXT,))
        elif name not in VOID:
            out.append((kind, name, what))
    return out


def fold(items: list[Token]) -> list[Token]:
    """Equal neighbouring groups become one repeated group, innermost first."""
    for size in range(1, LONGEST_GROUP + 1):
        out: list[Token] = []
        i = 0
        while i < len(items):
            group, n = items[i : i + size], 1
            while len(group) == size and items[i + n * size : i + (n + 1) * size] == group:
                n += 1
            if n > 1 and not (size == 1 and group[0] == (TEXT,)):
                body = tuple(group)
                out.append(("repeat", body[0][1] if size == 1 and body[0][0] == "repeat" else body))
                i += n * size
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def _absorb(items: list[Token], bodies: set[tuple]) -> list[Token]:
    """Single instances of groups that the other stream repeats become repeated groups as well."""
    for body in sorted(bodies, key=len):
        out, i = [], 0
        while i < len(items):
            if tuple(items[i : i + len(body)]) == body:
                i += len(body)
                if not out or out[-1] != ("repeat", body):
                    out.append(("repeat", body))
            elif items[i] == ("repeat", body) and out and out[-1] == items[i]:
                i += 1
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def align(wrapper: list[Token], page: list[Token]) -> list[Token]:
    """The wrapper widened to match the page as well."""
    bare = lambda x: x[1] if x[0] == "optional" else x
    known = [bare(x) for x in wrapper]
    bodies = {x[1] for x in [*known, *page] if x[0] == "repeat"}
    if bodies:
        known_again = _absorb(known, bodies)
        if len(known_again) != len(known):
            wrapper, known = known_again, known_again
        page = _absorb(page, bodies)
    out: list[Token] = []
    optional = lambda x: x if x[0] == "optional" else ("optional", x)
    for op, a, b, c, d in SequenceMatcher(None, known, page, autojunk=False).get_opcodes():
        if op == "equal":
            out += wrapper[a:b]
        else:
            out += map(optional, wrapper[a:b])
            out += (("optional", x) for x in page[c:d])
    return out


def infer(pages: list[str]) -> list[Token]:
    return aligned(fold(skeleton(tokens(page))) for page in pages)


def aligned(shapes: Iterable[list[Token]]) -> list[Token]:
    """The wrapper of folded streams."""
    wrapper: list[Token] = []
    for i, shape in enumerate(shapes):
        wrapper = align(wrapper, shape) if i else shape
    return wrapper


def slots(items: Iterable[Token]) -> dict[str, bool]:
    """The places of an expression's text slots, and whether all of a place's slots are inside links."""
    stack: list[str] = []
    out: dict[str, bool] = {}
    links = 0

    def walk(x: Token) -> None:
        nonlocal links
        if x == (TEXT,):
            place = "/".join(stack)
            out[place] = out.get(place, True) and links > 0
        elif x[0] == "repeat":
            for y in x[1]:
                walk(y)
        elif x[0] == "optional":
            walk(x[1])
        elif x[1] == "a":
            links = links + 1 if x[0] == "open" else max(0, links - 1)
        elif x[1] in CONTAINERS:
            if x[0] == "open":
                stack.append(f"{x[1]} {x[2]}".strip())
            elif any(y.split(" ")[0] == x[1] for y in stack):
                while stack.pop().split(" ")[0] != x[1]:
                    pass

    for x in items:
        walk(x)
    return out


def is_aside(place: str) -> bool:
    """Whether a place lies in what is not the article: by element, or by words of class, id or role."""
    inside = False
    for part in filter(None, place.split("/")):
        name, *words = part.split(" ")
        if name in ("article", "main") and not MARKS & set(words):
            inside = True
        own_heading = inside and name == "header" and not MARKS - {"header"} & set(words)
        if (name in BOILERPLATE and not own_heading) or (name not in ("html", "body", "article", "main") and not own_heading and MARKS & set(words)):
            return True
        if name in ("article", "section") and {"comment", "comments", "reply", "replies"} & set(words):
            return True
    return False


@dataclass(frozen=True)
class Place:
    """What a wrapper knows of a place: whether it only has links, how many pages of different text fill it with how many texts, their characters, and how many such pages the host has."""

    linked: bool = False
    pages: int = 1
    texts: int = 1
    chars: int = 0
    host: int = 1

    @property
    def template(self) -> bool:
        return self.pages >= TEMPLATE_PAGES and self.texts * TEMPLATE_TIMES <= self.pages and self.pages >= TEMPLATE_SHARE * self.host

    @property
    def said(self) -> float:
        """The characters, with equal texts counted once."""
        return self.chars * self.texts / self.pages


def main_places(known: dict[str, Place]) -> list[str]:
    """The places that hold the article: inside an article (or else main) element, or where there is none all but menus.

    Outside such elements template text goes, but never the place that says the most; inside them, whatever pages share stays.
    """
    open_to = [p for p in known if not is_aside(p)]
    if not open_to:  # a name on the page's outermost element says too much
        open_to = [p for p in known if not BOILERPLATE & {x.split(" ")[0] for x in p.split("/")}]
    for name in ("article", "main"):
        if inside := [p for p in open_to if any(x.split(" ")[0] == name for x in p.split("/"))]:
            return sorted(inside)
    open_to = [p for p in open_to if not known[p].linked] or open_to
    if not open_to:
        return []
    largest = max(open_to, key=lambda p: (known[p].said, p))
    return sorted(p for p in open_to if p == largest or not known[p].template)


def wrapper_of(expression: list[Token], counted: dict[str, tuple[int, int, int]], host: int = 1) -> dict:
    """A host's wrapper: its expression, the slots' places with (pages, texts, characters) as counted, and the main ones of its ``host`` pages."""
    linked = slots(expression)
    known = {p: Place(linked.get(p, False), *counted.get(p, (1, 1, 0)), host) for p in sorted({*linked, *counted})}
    places = {p: [x.linked, x.pages, x.texts, x.chars] for p, x in known.items()}
    return {"expression": expression, "places": places, "main": main_places(known)}


def extract(page: str | None, main: Iterable[str] | None = None) -> str:
    """The page's text at its host's main places, or at its own."""
    stream = list(tokens(page or ""))
    found = list(blocks(stream))
    chosen = set(main or ())
    if not any(p in chosen for p, _ in found):
        linked = slots(skeleton(stream))
        chars: Counter[str] = Counter()
        for place, text in found:
            chars[place] += len(text)
        chosen = set(main_places({p: Place(linked.get(p, False), chars=n) for p, n in chars.items()}))
    return "\n".join(text for place, text in found if place in chosen)


def _tuples(x):
    return tuple(map(_tuples, x)) if isinstance(x, list) else x


def _hash(*parts: str) -> int:
    return int.from_bytes(blake2b("\n".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


@frugal
def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every page a row for each place and one for ``WHOLE``: (host, place, hash of the page's text, hash of the place's text, characters); and its shape, once a task."""
    sent: set[int] = set()
    for batch in batches:
        rows: list[tuple] = []
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            stream = list(tokens(page or ""))
            texts: dict[str, list[str]] = {}
            for place, text in blocks(stream):
                texts.setdefault(place, []).append(text)
            own = _hash(*(x for place, lines in texts.items() for x in (place, *lines)))
            rows.append((host, None, WHOLE, own, own, 0))
            rows += ((host, None, place, own, _hash(*lines), sum(map(len, lines))) for place, lines in texts.items())
            shape = json.dumps(fold(skeleton(stream)))
            if (key := _hash(host, shape)) not in sent:
                if len(sent) >= KEPT_SHAPES:
                    sent.clear()
                sent.add(key)
                rows.append((host, shape, None, None, None, None))
        types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        columns = zip(*rows, strict=True) if rows else [[]] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["host", "shape", "place", "page", "text", "chars"])


def _expressions(table: pa.Table, column: str) -> list[Token]:
    return aligned(list(_tuples(json.loads(x))) for x in sorted(table[column].to_pylist()))


def _infer(key, table: pa.Table) -> pa.Table:
    return pa.table({"host": [key[0].as_py()], "expression": [json.dumps(_expressions(table, "shape"))]})


def _decide(key, parts: pa.Table, counted: pa.Table) -> pa.Table:
    """A host's wrapper, from its buckets' expressions (``BUCKETS`` at most) and its places."""
    of_place = {r["place"]: (r["pages"], r["texts"], r["chars"]) for r in counted.to_pylist()}
    host, _, _ = of_place.pop(WHOLE, (1, 1, 0))
    wrapper = wrapper_of(_expressions(parts, "expression"), of_place, host)
    return pa.table({"host": [key[0].as_py()], "wrapper": [json.dumps(wrapper)], "main": [json.dumps(wrapper["main"])]})


@frugal
def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parsed: dict[str | None, list[str]] = {None: []}
    for batch in batches:
        texts = []
        for page, main in zip(batch.column("html").to_pylist(), batch.column("main").to_pylist(), strict=True):
            if main not in parsed:
                if len(parsed) > 500:
                    parsed = {None: []}
                parsed[main] = json.loads(main)
            texts.append(extract(page, parsed[main]))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])


def host_wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, wrapper, main): every host's wrapper and its main places as JSON, inferred from all its pages."""
    small_batches(pages.sparkSession)
    some = pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html"))
    read = stored(some.mapInArrow(_read, "host string, shape string, place string, page bigint, text bigint, chars bigint"), "places")
    shapes = read.where("shape IS NOT NULL").select("host", "shape").distinct()
    dealt = shapes.groupBy("host", F.pmod(F.xxhash64("shape"), F.lit(BUCKETS)).alias("bucket"))
    parts = dealt.applyInArrow(lambda k, t: _infer(k, t), "host string, expression string")
    counted = read.where("place IS NOT NULL").groupBy("host", "place").agg(F.countDistinct("page").alias("pages"), F.countDistinct("text").alias("texts"), F.sum("chars").alias("chars"))
    return parts.groupBy("host").cogroup(counted.groupBy("host")).applyInArrow(lambda k, a, b: _decide(k, a, b), "host string, wrapper string, main string")


def main_texts(pages: DataFrame, url: str = "url", html: str = "html", key: str = "page_id") -> DataFrame:
    """(``key``, url, text, n_chars) of every row."""
    mains = stored(host_wrappers(pages, url, html).select("host", "main"), "wrappers")
    size = mains.agg(F.coalesce(F.sum(F.length("host") + F.length("main") + 64), F.lit(0))).first()[0]
    made = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(F.col(url)).alias("host"))
    kind = made.schema["id"].dataType.simpleString()
    joined = made.join(F.broadcast(mains) if size <= BROADCAST_BYTES else mains, "host", "left").select("id", "url", "html", "main")
    return joined.mapInArrow(_extract, f"id {kind}, url string, text string, n_chars bigint").withColumnRenamed("id", key)

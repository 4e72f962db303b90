"""HTML documents as rows of elements, by a scanner that reports what it can't pair instead of repairing it."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versotext.functions.text import ENTITY, decode_entity, qualifies_as_copy

#: Fixed values of HTML: elements without content, with text content only, and whose content is never copy.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
TEXT_ONLY = frozenset(("title", "textarea"))
OPAQUE = frozenset("template noscript xmp plaintext pre".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em i ins kbd mark q s samp small span strong sub sup time u var".split())
#: Attributes that hold copy.
COPY_ATTRIBUTES = ("alt", "aria-label", "title", "placeholder")
COPY_METAS = ("description", "og:title", "og:description", "og:image:alt", "twitter:title", "twitter:description")

TAG = re.compile(r"<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
BEGIN = re.compile(r"<(/?)[a-zA-Z]")
ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACE = re.compile(r"[ \t\r\n\f]+")

ELEMENTS = "page_id long, el_id int, parent_id int, tag string, attrs map<string,string>, ancestors array<string>, text string, full_text string, tags int, has_alt boolean, key_element boolean, line int, offset int, fault string"


def blank(source: str) -> str:
    """Comments, CDATA, declarations and the content of script and style as spaces; line ends and offsets stay."""
    def spaces(part: str) -> str:
        return re.sub(r"[^\n]", " ", part)

    out, at = [], 0
    marks = re.compile(r"<!--|<!\[CDATA\[|<[!?]|<(script|style)\b", re.I)
    while m := marks.search(source, at):
        out.append(source[at : m.start()])
        if m[1]:
            opened = source.find(">", m.end())
            opened = len(source) if opened < 0 else opened + 1
            closing = re.compile(rf"</{m[1]}\s*>", re.I).search(source, opened)
            end = closing.start() if closing else len(source)
            out += [source[m.start() : opened], spaces(source[opened:end])]
        else:
            stop = {"<!--": "-->", "<![CDATA[": "]]>"}.get(m[0].upper(), ">")
            end = source.find(stop, m.end())
            end = len(source) if end < 0 else end + len(stop)
            out.append(spaces(source[m.start() : end]))
        at = end
    out.append(source[at:])
    return "".join(out)


def decode(text: str) -> str:
    return ENTITY.sub(decode_entity, text)


class Tags:
    """The tags of a source, in order. What looks like one but never closes is text.

    A first failure to close reads the places of brackets and quotes once. From then on a place from
    which no bracket is reached is never tried again, so all the reading takes time in proportion to the source.
    """

    def __init__(self, source: str):
        self.source = source
        self.marks: list[int] | None = None
        self.dead: set[int] = set()

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(begin, end, whether it closes, name, what follows the name) of the first tag from ``at`` on."""
        while m := BEGIN.search(self.source, at):
            if self.marks is None:
                if found := TAG.match(self.source, m.start()):
                    return m.start(), found.end(), bool(m[1]), found["name"], found["rest"]
                self._read()
            if (end := self._end(m.end())) > 0:
                name = self._first(self.ends, m.end() - 1)
                return m.start(), end, bool(m[1]), self.source[m.end() - 1 : name], self.source[name : end - 1]
            at = m.end()
        return None

    def _read(self) -> None:
        self.marks = [x.start() for x in re.finditer("[>\"']", self.source)]
        self.quotes = {q: [x for x in self.marks if self.source[x] == q] for q in "\"'"}
        self.ends = [x.start() for x in re.finditer(r"[\s/>]", self.source)]

    @staticmethod
    def _first(places: list[int], at: int) -> int:
        n = bisect_left(places, at)
        return places[n] if n < len(places) else -1

    def _end(self, at: int) -> int:
        """The place after the bracket that ends a tag, 0 if none does; quotes count after the name."""
        at, tried = self._first(self.ends, at - 1), []
        while at >= 0:
            mark = self._first(self.marks, at)
            if mark < 0 or mark in self.dead:
                break
            if self.source[mark] == ">":
                return mark + 1
            tried.append(mark)
            at = self._first(self.quotes[self.source[mark]], mark + 1) + 1 or -1
        self.dead.update(tried)
        return 0


@dataclass
class Element:
    el_id: int
    parent: Element | None
    tag: str
    attrs: dict[str, str]
    offset: int
    fault: str | None = None
    closed: bool = False
    items: list[Element | str] = field(default_factory=list)

    def opaque(self) -> bool:
        node: Element | None = self
        while node:
            if node.tag in OPAQUE:
                return True
            node = node.parent
        return False


def attributes(rest: str) -> dict[str, str]:
    """The first value of each attribute, entities decoded; one without a value is the empty text."""
    found: dict[str, str] = {}
    for m in ATTR.finditer(rest.rstrip("/ ") if rest.endswith("/") else rest):
        found.setdefault(m[1].lower(), decode(m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""))
    return found


def scan(source: str) -> list[Element]:
    """Elements in document order. An end tag without its start, and a start without its end, are faults of the element they touch."""
    clean = blank(source)
    elements: list[Element] = []
    stack: list[Element] = []
    standing: Counter[str] = Counter()  # the names on the stack
    tags, at = Tags(clean), 0

    def put(text: str) -> None:
        if stack and text:
            stack[-1].items.append(text)

    while tag := tags.next(at):
        begin, end, closes, name, rest = tag
        put(clean[at:begin])
        at, name = end, name.lower()
        if closes:
            if not standing[name]:
                if stack:
                    stack[-1].fault = stack[-1].fault or f"stray </{name}>"
                continue
            while (last := stack.pop()).tag != name:
                last.fault = last.fault or f"unclosed <{last.tag}>"
                standing[last.tag] -= 1
            last.closed = True
            standing[name] -= 1
            continue
        e = Element(len(elements), stack[-1] if stack else None, name, attributes(rest), begin)
        elements.append(e)
        if stack:
            stack[-1].items.append(e)
        if name in VOID or rest.endswith("/"):
            e.closed = True
        elif name in TEXT_ONLY:
            stop = re.compile(rf"</{name}\s*+>", re.I).search(clean, at)
            e.items.append(clean[at : stop.start() if stop else len(clean)])
            e.closed, e.fault = bool(stop), None if stop else f"unclosed <{name}>"
            at = stop.end() if stop else len(clean)
        else:
            stack.append(e)
            standing[name] += 1
    put(clean[at:])
    for left in stack:
        left.fault = left.fault or f"unclosed <{left.tag}>"
    return elements


def value(e: Element) -> tuple[str, int]:
    """The element's text with inline children as numbered tags, in order of their starts, and how many there are."""
    out: list[str] = []
    n = 0
    todo: list[Element | str] = list(reversed(e.items))
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            out.append(item if item.startswith("\0") else decode(item))
        elif item.tag in VOID or not item.items:
            n += 1
            out.append(f"<{n}/>")
        else:
            n += 1
            out.append(f"<{n}>")
            todo.append(f"\0</{n}>")
            todo += reversed(item.items)
    text = SPACE.sub(" ", "".join(x.removeprefix("\0") for x in out)).strip(" \t\r\n\f")
    return text, n


def full_text(e: Element) -> tuple[str, bool]:
    """All text below the element, and whether an image with an alt text or a label stands below it."""
    out, alt = [], False
    todo: list[Element | str] = list(reversed(e.items))
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            out.append(decode(item))
        else:
            alt = alt or bool(item.attrs.get("alt", "").strip() or item.attrs.get("aria-label", "").strip())
            todo += reversed(item.items)
    return SPACE.sub(" ", "".join(out)).strip(), alt


def is_key_element(e: Element) -> bool:
    """Text of its own, only inline elements inside, and no element above that is one already."""
    if e.opaque() or e.fault or e.tag in ("script", "style"):
        return False
    own = any(isinstance(i, str) and i.strip() for i in e.items)
    return own and all(isinstance(i, str) or i.tag in INLINE or i.tag in VOID for i in e.items) and not (e.tag in INLINE and e.parent is not None and any(isinstance(i, str) and i.strip() for i in e.parent.items))


def rows(page_id: int | None, source: str) -> list[tuple]:
    starts = [0, *(m.end() for m in re.finditer("\n", source))]
    out = []
    for e in scan(source):
        ancestors, node = [], e.parent
        while node:
            ancestors.append(node.tag)
            node = node.parent
        text, tags = value(e)
        whole, alt = full_text(e)
        out.append((page_id, e.el_id, e.parent.el_id if e.parent else None, e.tag, list(e.attrs.items()), ancestors, text, whole, tags, alt, is_key_element(e), bisect_right(starts, e.offset), e.offset, e.fault))
    return out


def elements(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """A row for each element of each page; null pages have none."""
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.list_(pa.string()), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.bool_(), pa.int32(), pa.int32(), pa.string()]
    names = ["page_id", "el_id", "parent_id", "tag", "attrs", "ancestors", "text", "full_text", "tags", "has_alt", "key_element", "line", "offset", "fault"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 64):
                part = batch.slice(begin, 64)
                found = [r for i, h in zip(part.column("page_id").to_pylist(), part.column("html").to_pylist(), strict=True) for r in rows(i, h or "")]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html")).mapInArrow(run, ELEMENTS)


def proposals(elements_: DataFrame) -> DataFrame:
    """``page_id, line, place, tags, text`` of every copy candidate: key elements' values and copy attributes, in order."""
    own = elements_.where(F.col("key_element") & qualifies_as_copy(F.col("text"))).select("page_id", "line", "el_id", F.lit("text").alias("place"), "tags", "text", F.lit(1).alias("rank"))
    attr = elements_.where("fault is null").select("page_id", "line", "el_id", "tag", "attrs", F.explode(F.array(*map(F.lit, COPY_ATTRIBUTES))).alias("name"))
    attr = attr.select("page_id", "line", "el_id", F.concat(F.lit("@"), "name").alias("place"), F.lit(0).alias("tags"), F.element_at("attrs", F.col("name")).alias("text"), F.lit(0).alias("rank"))
    name = F.coalesce(F.element_at("attrs", F.lit("name")), F.element_at("attrs", F.lit("property")))
    meta = elements_.where((F.col("tag") == "meta") & name.isin(*COPY_METAS)).select("page_id", "line", "el_id", F.concat(F.lit("meta:"), name).alias("place"), F.lit(0).alias("tags"), F.element_at("attrs", F.lit("content")).alias("text"), F.lit(0).alias("rank"))
    found = own.unionByName(attr.unionByName(meta).where(F.col("text").isNotNull() & qualifies_as_copy(F.col("text"))))
    return found.orderBy("page_id", "el_id", "rank", "place").drop("rank")


#: What each element's text is called in a key.
ROLES = {"h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "a": "link", "button": "button", "label": "label", "li": "item", "p": "text", "title": "page_title", "option": "option", "figcaption": "caption", "td": "cell", "th": "cell", "summary": "summary", "legend": "legend"}
LANDMARKS = ("nav", "header", "footer", "main", "aside", "form", "section", "article", "dialog")


def role(tag: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for t, r in ROLES.items():
        out = out.when(tag == t, r)
    return out.otherwise("text")


def section(ancestors: Column) -> Column:
    """The nearest landmark above an element; null if there is none."""
    return F.get(F.filter(ancestors, lambda a: a.isin(*LANDMARKS)), F.lit(0))


def ordered_marks(marks: DataFrame) -> DataFrame:
    """Marks (file, offset, head, is_attribute): head texts last, then by file and offset, attributes before elements."""
    return marks.orderBy(F.col("head"), "file", "offset", F.desc("is_attribute"))

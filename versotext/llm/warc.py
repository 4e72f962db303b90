"""WARC derivatives: metadata and plain-text conversion records of response records.

For each response a ``metadata`` record (headers, digest, links, title) and a
``conversion`` record (the page's visible text) are made. Both name the response
in ``WARC-Refers-To`` and each other in ``WARC-Concurrent-To``, and repeat the response's
target, date and payload digest. Record ids are version-5
UUIDs of the response's id and the record's kind, so that a task run twice writes the same records. The response's record id, date, status, HTTP headers and
payload digest are carried over where columns hold them, and made up where none does.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versotext.llm.text import pieces, raw_texts

SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:warc:derivatives")
#: A tag's name, and its attributes up to the bracket that ends it: a quote opens a value only after an equals sign.
NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
REST = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])))*+>")
ATTRIBUTE = re.compile(r"([^\s/>=\"'][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
#: Elements whose content is no text; an svg that closes itself ends at once, of the others HTML ignores the slash.
HIDDEN = {name: re.compile(rf"</{name}\s*+>", re.I) for name in ("script", "style", "noscript", "template", "svg")}
TITLE_END = re.compile(r"</title\s*+>", re.I)
BLOCK = frozenset("address article aside blockquote body br caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section select table tbody td tfoot th thead title tr ul".split())
LINK = {"a": ("href", "A@/href"), "link": ("href", "LINK@/href"), "img": ("src", "IMG@/src"), "script": ("src", "SCRIPT@/src"), "iframe": ("src", "IFRAME@/src"), "form": ("action", "FORM@/action")}

RECORDS = "page_id long, record_type string, record_id string, refers_to string, concurrent_to string, target_uri string, warc_date string, content_type string, source_digest string, block_digest string, content_length long, n_links long, block string, record string"


def digest(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, chr(31).join(parts))}>"


class Page:
    """A page's visible text, links and title, read in one pass whose time is in proportion to its length."""

    def __init__(self, source: str):
        self.source = source
        self.title: str | None = None
        self.links: list[dict[str, str]] = []
        self.parts: list[str] = []
        self._read()
        lines = html.unescape("".join(self.parts)).split("\n")
        self.text = "\n".join(line for line in (" ".join(line.split()) for line in lines) if line)

    def _read(self) -> None:
        source, at, size = self.source, 0, len(self.source)
        # what was once looked for in vain up to the end isn't looked for again
        self.strict = self.lasting = self.titled = True
        while at < size:
            begin = source.find("<", at)
            if begin < 0:
                break
            self._text(at, begin)
            if source.startswith("<!--", begin):
                at = self._after("-->", begin + 4)
            elif source.startswith("<![CDATA[", begin):
                at = self._after("]]>", begin + 9)
            elif (m := NAME.match(source, begin)) and (end := self._tag_end(m.end(), begin)) > 0:
                at = self._tag(m, end)
            elif source[begin + 1 : begin + 2] in ("!", "?") and (end := self._bracket(begin)) > 0:
                at = end
            else:
                self.parts.append("<")
                at = begin + 1
        self._text(at, size)

    def _text(self, begin: int, end: int) -> None:
        if begin < end:
            self.parts.append(re.sub(r"\s+", " ", self.source[begin:end]))

    def _after(self, mark: str, at: int) -> int:
        self.parts.append(" ")
        end = self.source.find(mark, at)
        return end + len(mark) if end >= 0 else len(self.source)

    def _bracket(self, at: int) -> int:
        """The place after the next closing bracket, 0 without one."""
        if not self.lasting:
            return 0
        end = self.source.find(">", at) + 1
        self.lasting = end > 0
        return end

    def _tag_end(self, at: int, begin: int) -> int:
        """Where a tag ends. After a quote that never closes any bracket ends a tag, in the rest of the page."""
        if self.strict:
            if m := REST.match(self.source, at):
                return m.end()
            self.strict = False
        return self._bracket(begin)

    def _tag(self, m: re.Match, end: int) -> int:
        name, closing = m[1].lower(), self.source[m.start() + 1] == "/"
        inside = self.source[m.end() : end - 1]
        if not closing and name in LINK:
            kind, path = LINK[name]
            value = next((a for a in ATTRIBUTE.finditer(inside) if a[1].lower() == kind), None)
            if value and (url := value[2] or value[3] or value[4]):
                self.links.append({"path": path, "url": html.unescape(url)})
        if not closing and name in HIDDEN and not (name == "svg" and inside.endswith("/")):
            self.parts.append(" ")
            stop = HIDDEN[name].search(self.source, end)
            return stop.end() if stop else len(self.source)
        if not closing and name == "title" and (stop := TITLE_END.search(self.source, end) if self.titled else None):
            if self.title is None:
                self.title = " ".join(html.unescape(self.source[end : stop.start()]).split())
            self.parts.append(" ")
            return stop.end()
        if not closing and name == "title":
            self.titled = False
        if name in BLOCK:
            self.parts.append("\n")
        return end


def page_text(source: str) -> str:
    """The visible text: block elements start new lines, white space is collapsed, entities are decoded, empty lines go."""
    return Page(source).text


def page_links(source: str) -> list[dict[str, str]]:
    """Links in order, with the element and attribute that holds each."""
    return Page(source).links


def render(headers: list[tuple[str, str]], block: bytes) -> str:
    """The record as it stands in a WARC file; ``block`` is UTF-8."""
    return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n" + block.decode("utf-8") + "\r\n\r\n"


def fields(http: list[tuple[str, str]]) -> dict[str, str | list[str]]:
    """HTTP headers by name; a name that stands more than once, in whatever case, keeps all its values in order."""
    names: dict[str, str] = {}
    values: dict[str, list[str]] = {}
    for name, value in http:
        values.setdefault(names.setdefault(name.lower(), name), []).append(value)
    return {name: own[0] if len(own) == 1 else own for name, own in values.items()}


def derive(page_id: int | None, url: str, date: str, raw: bytes, http: list[tuple[str, str]], status: str = "200", source_id: str | None = None, source_digest: str | None = None) -> list[tuple]:
    """The response's two records as rows of ``RECORDS``."""
    source = raw.decode("utf-8", "replace")
    response, payload = source_id or record_id(url, str(page_id), "response"), source_digest or digest(raw)
    page = Page(source)
    links = page.links
    # the two records name each other
    made = {kind: record_id(source_id, kind) if source_id else record_id(url, str(page_id), kind) for kind in ("metadata", "conversion")}
    meta = {"Envelope": {"WARC-Header": {"WARC-Type": "response", "WARC-Record-ID": response, "WARC-Target-URI": url, "WARC-Date": date, "WARC-Payload-Digest": payload}, "HTTP-Response": {"Status": status, "Headers": fields(http)}, "HTML": {"Title": page.title, "Links": links}, "Payload-Length": len(raw)}}
    out = []
    for kind, other, content_type, text in (("metadata", "conversion", "application/json", json.dumps(meta, ensure_ascii=False, sort_keys=True)), ("conversion", "metadata", "text/plain", page.text)):
        block = text.encode("utf-8", "replace")
        headers = [("WARC-Type", kind), ("WARC-Record-ID", made[kind]), ("WARC-Refers-To", response), ("WARC-Concurrent-To", made[other]), ("WARC-Target-URI", url), ("WARC-Date", date), ("WARC-Source-Payload-Digest", payload), ("WARC-Block-Digest", digest(block)), ("Content-Type", content_type), ("Content-Length", str(len(block)))]
        out.append((page_id, kind, made[kind], response, made[other], url, date, content_type, payload, digest(block), len(block), len(links), block.decode("utf-8"), render(headers, block)))
    return out


def derivatives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "1970-01-01T00:00:00Z", record_id_col: str | None = None, date_col: str | None = None, status_col: str | None = None, headers_col: str | None = None, digest_col: str | None = None) -> DataFrame:
    """Two rows for each response: its metadata record and its conversion record.

    ``record`` holds the whole record as text, ``block`` its content; the other columns
    repeat the headers.

    The optional columns hold what the responses' own records say: record id, WARC-Date and
    payload digest as they stand there, HTTP status, and HTTP headers as an array of (name,
    value) or a map. Without a column, or where it is null: an id made of url and page id,
    ``date``, the digest of the page, 200, and a Content-Type of UTF-8 HTML with the page's length.

    A null page counts as an empty payload, a null url as the empty url and a null id
    stays null. Repeated rows give records with equal ids. Other columns are ignored.
    """
    given = [F.col(f"`{c}`").cast("string").alias(name) for name, c in (("record", record_id_col), ("date", date_col), ("status", status_col), ("digest", digest_col)) if c]
    if headers_col:
        headers = F.col(f"`{headers_col}`")
        headers = F.map_entries(headers) if pages.select(headers).schema[0].dataType.typeName() == "map" else headers
        given.append(headers.cast("array<struct<name:string,value:string>>").alias("headers"))
    own = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"), *given)
    names = [c.split()[0] for c in RECORDS.split(", ")]
    kinds = [pa.int64() if c.endswith("long") else pa.string() for c in RECORDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html", 2_000_000):
            rows = []
            nulls = [None] * batch.num_rows
            sources = [batch.column(name).to_pylist() if name in batch.schema.names else nulls for name in ("record", "date", "status", "digest", "headers")]
            for page_id, url, raw, source_id, stamp, status, sum_, sent in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), raw_texts(batch, "html"), *sources, strict=True):
                http = [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(raw)))] if sent is None else [(h["name"] or "", h["value"] or "") for h in sent if h]
                rows += derive(page_id, url, stamp or date, raw, http, status or "200", source_id, sum_)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return own.mapInArrow(run, RECORDS)


#: What ends a record in a WARC file.
END = "\r\n\r\n"


def write_warc(derived: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write the records of :func:`derivatives` as WARC files, one for each partition, committed by Spark."""
    records = derived.select(F.expr(f"substring(record, 1, char_length(record) - {len(END)})"))
    records.write.option("lineSep", END).option("compression", compression).text(path)


def parse_response(raw: bytes) -> dict:
    """A WARC response record's id, date, url, status, HTTP headers (name and value, in order), payload digest and payload.

    Header lines end with a line feed, with or without a carriage return; what a record lacks is None.
    """
    def headers(lines: list[bytes]) -> list[tuple[str, str]]:
        pairs = [line.decode("utf-8", "replace").partition(":") for line in lines]
        return [(name.strip(), value.strip()) for name, mark, value in pairs if mark]

    def parted(data: bytes) -> tuple[list[bytes], bytes]:
        m = re.search(rb"\r?\n\r?\n", data)
        return re.split(rb"\r?\n", data[: m.start()] if m else data), data[m.end() :] if m else b""

    head, block = parted(raw)
    own = {name.lower(): value for name, value in headers(head[1:])}
    if own.get("content-length", "").isdigit():
        block = block[: int(own["content-length"])]
    first, payload = parted(block)
    status = re.match(rb"HTTP/\S+ (\d{3})", first[0])
    if not status:
        first, payload = [b""], block
    return {"record_id": own.get("warc-record-id"), "date": own.get("warc-date"), "url": own.get("warc-target-uri"), "digest": own.get("warc-payload-digest"), "status": status[1].decode() if status else None, "headers": headers(first[1:]) if status else None, "html": payload.decode("utf-8", "replace")}


def responses(records: DataFrame, record_col: str = "record") -> DataFrame:
    """Columns for :func:`derivatives` (see ``SOURCE``) of WARC response records given as binary or text, a row each; null records are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "record", 2_000_000):
            found = [parse_response(raw) for raw in raw_texts(batch, "record")]
            kinds = [pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())])) if n == "headers" else pa.string() for n in RESPONSE]
            columns = [[[{"name": k, "value": v} for k, v in r[n]] if n == "headers" and r[n] is not None else r[n] for r in found] for n in RESPONSE]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], list(RESPONSE))

    own = records.select(F.col(f"`{record_col}`").cast("binary").alias("record")).where("record is not null")
    return own.mapInArrow(run, "record_id string, date string, url string, digest string, status string, headers array<struct<name:string,value:string>>, html string").withColumn("page_id", F.lit(None).cast("long"))


RESPONSE = ("record_id", "date", "url", "digest", "status", "headers", "html")
#: How the columns of :func:`responses` are handed to :func:`derivatives`.
SOURCE = {"record_id_col": "record_id", "date_col": "date", "status_col": "status", "headers_col": "headers", "digest_col": "digest"}

"""WARC derivatives: metadata and plain-text conversion records that refer to the responses they come from."""

from __future__ import annotations

import base64
import hashlib
import html
import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm.shared import bounded_batches, only, slices

#: The date of records made from tables that have none.
DATE = "2024-01-01T00:00:00Z"
RESPONSE = "page_id long, record_id string, target_uri string, warc_date string, http_head string, payload binary, payload_digest string, block_digest string"
DERIVED = (
    "page_id long, warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, "
    "source_head string, source_payload_digest string, source_block_digest string, block_digest string, content_length long, content string"
)

# Elements whose text isn't shown: those that hold raw text, and those that hold elements. Elements that stand on lines of their own.
# (Fixed values of HTML.)
_RAW = "script|style|iframe|title"
_NESTED = "noscript|template|svg"
_BLOCK = "address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h1|h2|h3|h4|h5|h6|header|hr|html|li|main|nav|ol|option|p|pre|section|table|td|th|title|tr|ul"

_HIDING = re.compile(rf"<!--|<(?:(?P<raw>{_RAW})|(?P<close>/?)(?P<nested>{_NESTED}))(?=[\s/>])[^<>]*>", re.I)
_CLOSE = {name: re.compile(rf"</{name}(?=[\s/>])[^<>]*>", re.I) for name in _RAW.split("|")}
_COMMENT_OR_CODE = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)(?=[\s/>])[^<>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BREAK = re.compile(rf"</?(?:{_BLOCK})(?=[\s/>])[^<>]*>", re.I)
_TAG = re.compile(r"<[/!?]?[A-Za-z][^<>]*>")
_BLANKS = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[ \n]*")
_TITLE = re.compile(r"<title(?=[\s>])[^<>]*>(.*?)</title\s*>", re.S | re.I)
_LANG = re.compile(r"<html\s[^<>]*?\blang\s*=\s*[\"']?([A-Za-z0-9-]+)", re.I)
_CHARSET = re.compile(r"<meta\s[^<>]*?charset\s*=\s*[\"']?([A-Za-z0-9_-]+)", re.I)
_LINK = re.compile(r"<a\s[^<>]*?\bhref\s*=\s*(?:\"([^\"<>]*)\"|'([^'<>]*)'|([^\s\"'<>]+))", re.I)


def digest(block: bytes) -> str:
    """A block's or payload's labelled digest."""
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: object) -> str:
    """A record's identifier, the same whenever it is made again."""
    h = hashlib.sha1("\0".join(map(str, parts)).encode("utf-8", "surrogatepass")).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-{'89ab'[int(h[16], 16) & 3]}{h[17:20]}-{h[20:32]}>"


#: How many unclosed elements within it a closing tag looks past; deeper ones count as never closed.
DEEP = 64


def _hidden(page: str) -> list[tuple[int, int]]:
    """Stretches of a page that aren't shown, outer ones after those within them.

    A comment, script, style or frame that is never closed goes on to the end, as HTML has it; an unclosed title ends at the
    next tag. An unclosed noscript, template or svg hides nothing, and a head hides no more than the elements in it: its end
    tag may be left out.
    """
    out: list[tuple[int, int]] = []
    opened: list[tuple[str, int]] = []
    endless: set[str] = set()
    at = 0
    while m := _HIDING.search(page, at):
        at = m.end()
        if m["raw"]:
            name = m["raw"].lower()
            end = None if name in endless else _CLOSE[name].search(page, at)
            if end:
                at = end.end()
            else:
                endless.add(name)
                at = max(at, page.find("<", at)) if name == "title" else len(page)
            out.append((m.start(), at))
        elif m["nested"] is None:
            end = page.find("-->", m.end())
            at = len(page) if end < 0 else end + 3
            out.append((m.start(), at))
        elif not m["close"]:
            if not m[0].endswith("/>"):
                opened.append((m["nested"].lower(), m.start()))
        else:
            name = m["nested"].lower()
            place = next((k for k in range(len(opened) - 1, max(len(opened) - 1 - DEEP, -1), -1) if opened[k][0] == name), None)
            if place is not None:
                out.append((opened[place][1], at))
                del opened[place:]
    return out


def _shown(page: str) -> str:
    parts, end = [], len(page)
    for a, b in reversed(_hidden(page)):
        if a < end:
            parts.append(page[b:end] if b < end else "")
            end = min(a, end)
    parts.append(page[:end])
    return " ".join(reversed(parts))


def plain_text(page: str) -> str:
    """The text that a page shows: hidden elements and comments dropped, a line for each block, white space joined."""
    text = _TAG.sub("", _BREAK.sub("\n", _shown(page)))
    if "&" in text:
        text = html.unescape(text)
    return _LINES.sub("\n", _BLANKS.sub(" ", text.replace("\r", "\n"))).strip()


def describe(page: str, url: str) -> list[tuple[str, str]]:
    """Fields of a metadata record: title, language, character set and the links, in their order, against the page's address."""
    one = lambda s: " ".join(html.unescape(s).split())
    seen = _COMMENT_OR_CODE.sub(" ", page)
    out = []
    if m := _TITLE.search(seen):
        out.append(("title", one(_TAG.sub("", m[1]))))
    if m := _LANG.search(seen):
        out.append(("language", m[1].lower()))
    if m := _CHARSET.search(seen):
        out.append(("charset", m[1].lower()))
    for m in _LINK.finditer(seen):
        target = one(m[1] or m[2] or m[3] or "")
        try:
            out.append(("outlink", urljoin(url, target)))
        except ValueError:  # no address, such as a broken IPv6 host
            out.append(("outlink", target))
    return out


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of fetched pages (page_id, url, html); a null page or address counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for i, url, page in zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), b.column("html").to_pylist(), strict=True):
                body = (page or "").encode("utf-8", "surrogatepass")
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n"
                rows.append((i, record_id("response", i, url, date), url or "", date, head, body, digest(body), digest(head.encode() + body)))
            yield _batch(rows, RESPONSE)

    return only(bounded_batches(pages), "page_id", "url", "html").selectExpr("cast(page_id as long) as page_id", "url", "html").mapInArrow(run, RESPONSE)


_ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    names, kinds = zip(*[f.strip().split(" ") for f in ddl.split(",")], strict=True)
    columns = list(zip(*rows, strict=True)) or [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[k]) for c, k in zip(columns, kinds, strict=True)], list(names))


def _charset(head: str) -> str:
    m = re.search(r"(?im)^content-type:[^\r\n]*charset=\"?([A-Za-z0-9_-]+)", head)
    return m[1] if m else "utf-8"


def derive(source: DataFrame) -> DataFrame:
    """Two derivative records of every response: its metadata and its plain text.

    Both name the response they come from (refers_to) and keep its address, date, HTTP head and
    digests; block_digest is that of their own content. A payload is decoded by the character set of
    its HTTP head, else as UTF-8; bytes that don't fit become replacement signs. A null or empty
    payload gives a metadata record with the source's fields alone and an empty conversion. Repeated rows
    give records with equal identifiers. A response's records are made where it is read: nothing is
    shuffled. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for r in b.to_pylist():
                head, payload, url = r["http_head"] or "", r["payload"] or b"", r["target_uri"] or ""
                try:
                    page = payload.decode(_charset(head), "replace")
                except LookupError:
                    page = payload.decode("utf-8", "replace")
                page = page.replace("\0", "")
                fields = [("source-payload-digest", r["payload_digest"] or ""), ("source-block-digest", r["block_digest"] or "")]
                fields += [("http-header", line) for line in head.splitlines() if line]
                fields += describe(page, url)
                meta = "".join(f"{k}: {v}\r\n" for k, v in fields)
                for kind, content, mime in (("metadata", meta, "application/warc-fields"), ("conversion", plain_text(page), "text/plain; charset=utf-8")):
                    block = content.encode("utf-8", "replace")
                    out.append((
                        r["page_id"], kind, record_id(kind, r["record_id"]), r["record_id"], url, r["warc_date"], mime, head, r["payload_digest"], r["block_digest"],
                        digest(block), len(block), block.decode(),
                    ))
            yield _batch(out, DERIVED)

    names = [f.strip().split(" ")[0] for f in RESPONSE.split(",")]
    return only(source, *names).mapInArrow(run, DERIVED)


def write_warc(records: DataFrame, path: str) -> None:
    """Write derivative records as WARC files, one a partition, through Spark's own writer.

    A record names the response it comes from, with its address, date and digests; its HTTP head is kept as
    WARC-Source-Header lines, one a header. The two line ends after a block are the writer's line separator, so the files are
    whole WARC files.
    """
    line = lambda name, value: F.concat(F.lit(f"{name}: "), F.coalesce(value, F.lit("")), F.lit("\r\n"))
    heads = F.filter(F.split(F.coalesce("source_head", F.lit("")), "[\\r\\n]+"), lambda x: x != "")
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("warc_type")), line("WARC-Record-ID", F.col("record_id")), line("WARC-Refers-To", F.col("refers_to")),
        line("WARC-Refers-To-Target-URI", F.col("target_uri")), line("WARC-Refers-To-Date", F.col("warc_date")),
        line("WARC-Target-URI", F.col("target_uri")), line("WARC-Date", F.col("warc_date")), line("WARC-Block-Digest", F.col("block_digest")),
        line("WARC-Source-Payload-Digest", F.col("source_payload_digest")), line("WARC-Source-Block-Digest", F.col("source_block_digest")),
        F.array_join(F.transform(heads, lambda x: F.concat(F.lit("WARC-Source-Header: "), x, F.lit("\r\n"))), ""),
        line("Content-Type", F.col("content_type")), line("Content-Length", F.col("content_length").cast("string")), F.lit("\r\n"),
    )
    records.select(F.concat(head, "content").alias("value")).write.option("lineSep", "\r\n\r\n").text(path)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records of an uncompressed WARC file; header names in lower case."""
    at = 0
    while (start := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", start)
        if end < 0:
            return
        headers, size = _headers(data[start:end])
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size


def _headers(head: bytes) -> tuple[dict[str, str], int]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    size = headers.get("content-length", "0")
    return headers, int(size) if size.isdigit() else 0


#: What parts one record from the next, and the start that it takes from the next one.
_BETWEEN, _START = b"\r\n\r\nWARC/1.", b"WARC/1."


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Response records of WARC files (plain or gzip), as `derive` takes them; page_id is null.

    Spark's text reader parts a file where an end of a record meets the start of the next, and unpacks gzip as it reads, so
    memory follows one record and a plain file is read by many tasks. A record whose block is shorter than its
    Content-Length holds such a place itself; it is joined with what comes next in its split until it is complete. A
    record that is cut off by the end of its file or split is left out, as are records of other types.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = b""
        for b in batches:
            rows = []
            for piece in b.column("value").to_pylist():
                if held:
                    data = held + _BETWEEN + piece
                else:
                    data = piece if piece.startswith(_START) else _START + piece
                held = b""
                end = data.find(b"\r\n\r\n")
                if end < 0:
                    continue
                h, size = _headers(data[:end])
                block = data[end + 4 : end + 4 + size]
                if len(block) < size:
                    held = data
                elif h.get("warc-type") == "response":
                    head, _, body = block.partition(b"\r\n\r\n")
                    rows.append((None, h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-date"), head.decode("latin-1") + "\r\n\r\n", body, h.get("warc-payload-digest", digest(body)), h.get("warc-block-digest", digest(block))))
            yield _batch(rows, RESPONSE)

    pieces = spark.read.option("lineSep", _BETWEEN.decode()).text(path).select(F.col("value").cast("binary").alias("value"))
    return bounded_batches(pieces).mapInArrow(run, RESPONSE)

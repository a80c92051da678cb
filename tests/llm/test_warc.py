from __future__ import annotations

import gzip
from html.parser import HTMLParser
from pathlib import Path

import duckdb
import pytest

from foldwise.llm import warc


class Shown(HTMLParser):
    """An independent reading of the text a page shows: a parser that keeps the open elements of every piece of text."""

    block = set(warc._BLOCK.split("|"))

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.closed, self.out, self.links, self.n = [], set(), [], [], 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "iframe", "title", "noscript", "template", "svg"):
            self.n += 1
            self.open.append((tag, self.n))
            if tag in ("script", "style", "iframe"):
                self.closed.add(self.n)
        elif tag in self.block:
            self.out.append(("\n", list(self.open)))
        if tag == "a" and dict(attrs).get("href") is not None:
            self.links.append(dict(attrs)["href"])

    def handle_endtag(self, tag):
        if tag in [t for t, _ in self.open]:
            while True:
                name, n = self.open.pop()
                self.closed.add(n)
                if name == tag:
                    break
        elif tag in self.block:
            self.out.append(("\n", list(self.open)))

    def handle_data(self, data):
        self.out.append((data, list(self.open)))

    def text(self) -> str:
        return "".join(d for d, inside in self.out if not any(n in self.closed for _, n in inside))


def shown(page: str) -> str:
    p = Shown()
    p.feed(page)
    p.close()
    lines = [" ".join(line.split()) for line in p.text().split("\n")]
    return "\n".join(line for line in lines if line)


PAGE = '<!DOCTYPE html><html lang="FR"><head><meta charset="utf-8"><title>A &amp; b\n c</title><style>p{}</style><script>var t="</p>";</script></head><body><!-- <p>no</p> --><nav><a href="/x?a=1&amp;b=2">X</a> <a class=k href=y>Y</a></nav><p>1 &lt; 2 and 3 > 2 <b>bo</b>ld&nbsp;text<br>next</p></body></html>'


def test_page():
    assert warc.plain_text(PAGE) == "X Y\n1 < 2 and 3 > 2 bold text\nnext" == shown(PAGE)
    assert warc.describe(PAGE, "http://h.example/d/p") == [("title", "A & b c"), ("language", "fr"), ("charset", "utf-8"), ("outlink", "http://h.example/x?a=1&b=2"), ("outlink", "http://h.example/d/y")]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<html><head><title>x</title><body><p>all the text</p>", "all the text"),
        ("<head><meta charset=utf-8><title>x</title><p>one<p>two", "one\ntwo"),
        ("<p>a<noscript>b<p>c", "a b\nc"),
        ("<p>a<noscript>b</noscript>c", "a c"),
        ("<svg><svg>x</svg>y</svg>z<svg/>w", "z w"),
        ("<template><noscript>x</template>y", "y"),
        ("<p>a<script>b<p>c", "a"),
        ("<title>t<p>a</p><title>u<p>b", "a\nb"),
        ("<head><style>x</style></head>a<!-- b -->c<!-- d", "a c"),
    ],
)
def test_elements_that_are_not_closed(page, text):
    got = warc.plain_text(page)
    assert got.replace(" ", "") == text.replace(" ", "")
    if "<title>t<p>" not in page and "<!-- d" not in page:
        assert shown(page).replace(" ", "") == text.replace(" ", "")


@pytest.mark.parametrize("page", ["<title>" * 30000, "<svg>" * 30000 + "</svg>" * 30000, "<noscript>" * 20000 + "</template>" * 20000, "<svg>" * 100 + "<noscript>" + "</svg>" * 3])
def test_many_open_elements_take_linear_time(page):
    assert len(warc.plain_text(page)) < 10


@pytest.mark.parametrize("page", ["", "no tags", "<" * 20000, "a < b", "<p", "<!-- open", "<script>x", "&#0;&bogus;&amp", "<p>" * 3000, "x" * 200_000])
def test_odd_pages(page):
    assert isinstance(warc.plain_text(page), str) and isinstance(warc.describe(page, ""), list)


def test_equals_another_parser_on_the_tables_pages():
    path = Path("/root/testdata/sf0.001/pages.parquet")
    if not path.exists():
        pytest.skip("no tables")
    for url, page in duckdb.sql(f"select url, html from '{path}'").fetchall():
        assert warc.plain_text(page) == shown(page)
        p = Shown()
        p.feed(page)
        assert len([1 for k, _ in warc.describe(page, url) if k == "outlink"]) == len(p.links)


def test_records_on_spark(spark, tmp_path):
    rows = [(1, "http://h.example/d/p", PAGE, "x"), (2, None, None, "x"), (3, "http://[bad", '<a href="q">', "x"), (1, "http://h.example/d/p", PAGE, "x"), (None, "u", "é\0é", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, content string")
    source = warc.responses(pages)
    out = warc.derive(source)
    got = out.collect()
    assert len(got) == 2 * len(rows) and len({r.record_id for r in got}) == 8
    by_id = {r.record_id: r for r in source.collect()}
    for r in got:
        s = by_id[r.refers_to]
        assert (r.target_uri, r.warc_date, r.source_head, r.source_payload_digest, r.source_block_digest) == (s.target_uri, s.warc_date, s.http_head, s.payload_digest, s.block_digest)
        assert warc.digest(s.payload) == s.payload_digest and warc.digest(s.http_head.encode() + s.payload) == s.block_digest
        assert r.block_digest == warc.digest(r.content.encode()) and r.content_length == len(r.content.encode())
        assert r.warc_type == "metadata" and f"source-payload-digest: {s.payload_digest}\r\n" in r.content or r.content == warc.plain_text(s.payload.decode().replace("\0", ""))
    warc.write_warc(out.coalesce(1), str(tmp_path / "out"))
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*")))
    records = list(warc.parse_warc(data))
    assert len(records) == len(got)
    for h, block in records:
        assert h["warc-block-digest"] == warc.digest(block) and h["warc-refers-to"] in by_id
        origin = by_id[h["warc-refers-to"]]
        assert (h["warc-refers-to-target-uri"], h["warc-refers-to-date"]) == (origin.target_uri, origin.warc_date)
        assert h["warc-source-payload-digest"] == origin.payload_digest and h["warc-source-header"] in origin.http_head
    assert warc.derive(warc.responses(pages).limit(0)).count() == 0


def test_reads_plain_files_by_record(spark, tmp_path):
    """Blocks that hold the sign of a record's start, bytes that are no UTF-8, other types, and a record that is cut off."""
    bodies = [b"<p>one</p>", b"a\r\n\r\nWARC/1.0\r\nContent-Length: 3\r\n\r\nb", b"\xff\xfe" * 50, b"", b"x" * 5000]
    data = b""
    for k, body in enumerate(bodies):
        http = b"HTTP/1.1 200 OK\r\n\r\n" + body
        data += b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <r%d>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (k, len(http), http)
        data += b"WARC/1.0\r\nWARC-Type: request\r\nContent-Length: 4\r\n\r\nGET \r\n\r\n"
    (tmp_path / "a.warc").write_bytes(data + b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 100\r\n\r\ncut off")
    got = {r.record_id: bytes(r.payload) for r in warc.read_responses(spark, str(tmp_path)).collect()}
    assert got == {f"<r{k}>": body for k, body in enumerate(bodies)}


def test_reads_warc_files(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\n\r\n<p>caf\xe9</p>"
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 2\r\n\r\nok\r\n\r\n"
    rec = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Target-URI: http://a.example/\r\nWARC-Date: 2020-02-02T00:00:00Z\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(http), http)
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(rec))
    got = {r.warc_type: r for r in warc.derive(warc.read_responses(spark, str(tmp_path))).collect()}
    assert got["conversion"].content == "café" and got["conversion"].refers_to == "<urn:uuid:1>"
    assert "http-header: HTTP/1.1 200 OK" in got["metadata"].content

"""WARC derivatives: metadata and plain-text conversion records from responses (operator 4).

``responses`` makes response records of raw pages; ``derive`` turns response records into a linked
metadata record and a plain-text conversion record each. Links go by WARC-Refers-To, the source's
target URI, date and payload digest are kept, and every block gets a digest of its own.

Scale: a map over records with no shuffle; ids are name-based (from the source's id and the kind of
record), so a task that is run again makes the same records.
"""

from __future__ import annotations

import base64
import json
import re
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import sha1
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.shared import small_batches

#: All records are dated so unless the input has a date of its own.
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122
_CONTROL = re.compile(r"[\x00-\x08\x0a-\x1f\x7f]")
_BREAKS = frozenset("address article aside blockquote br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul title".split())


def digest(block: bytes) -> str:
    """A block's digest as WARC headers give it."""
    return "sha1:" + base64.b32encode(sha1(block).digest()).decode()


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, '|'.join(map(str, parts)))}>"


_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)(\s*=\s*)?")
_BARE = re.compile(r"[^\s>]*")
_ENDS = re.compile(r"</(script|style|noscript|template|title)(?=[\s/>])", re.IGNORECASE)
_ENDLESS = re.compile(r"&#(?:[0-9]{9,}|[xX][0-9a-fA-F]{9,});?")


def _plain(text: str) -> str:
    """``text`` with character references resolved; one whose number is too long to be a character becomes U+FFFD."""
    if "&" not in text:
        return text
    return unescape(_ENDLESS.sub(lambda m: m[0] if len(m[0].strip("&#xX;").lstrip("0")) < 9 else "\ufffd", text) if "&#" in text else text)


class _Tags:
    """A page's tags in one pass: no place is read again, however the page is broken.

    What follows the last ``>`` has no tags. A quoted value ends at the next such quote, if there is one; once a tag
    has run to the end of the page without its ``>``, quotes are no longer minded and tags end at the first.
    """

    def __init__(self, html: str) -> None:
        self.html = html
        self.last = html.rfind(">")
        self.last_quote = {q: html.rfind(q) for q in "\"'"}
        self.last_comment = html.rfind("-->")
        self.quotes = True

    def start(self, at: int) -> tuple[dict[str, str], int]:
        """Attributes from ``at`` on, behind a tag's name, and where the tag ends."""
        begin, found, html = at, {}, self.html
        while self.quotes:
            if html.startswith(">", at):
                return found, at + 1
            m = _ATTRIBUTE.match(html, at)
            if m is None:
                # blanks, slashes or a lone "=" before the end
                at += 1
                if at > self.last:
                    break
                continue
            name, value, at = m[1].lower(), "", m.end()
            if m[2] is not None:
                quote = html[at : at + 1]
                if quote and quote in "\"'" and at < self.last_quote[quote]:
                    end = html.find(quote, at + 1)
                    value, at = html[at + 1 : end], end + 1
                else:
                    bare = _BARE.match(html, at)
                    value, at = bare[0], bare.end()
            found.setdefault(name, value)
            if at > self.last:
                break
        self.quotes = False
        return {}, html.find(">", begin) + 1

    def __iter__(self) -> Iterator[tuple[str, str, dict[str, str], int, int]]:
        """(kind, name or text, attributes, from, to): kind is text, start or end; comments and declarations are left out."""
        html, at, n = self.html, 0, len(self.html)
        while at < n:
            low = html.find("<", at)
            if low < 0 or low > self.last:
                yield "text", html[at:], {}, at, n
                return
            if low > at:
                yield "text", html[at:low], {}, at, low
            end_tag = html.startswith("/", low + 1)
            name = _NAME.match(html, low + 1 + end_tag)
            if html.startswith("<!--", low) and low + 2 <= self.last_comment:
                at = html.find("-->", low + 2) + 3
            elif html.startswith(("<!", "<?"), low) or (end_tag and name is None):
                at = html.find(">", low) + 1
            elif name is None:
                yield "text", "<", {}, low, low + 1
                at = low + 1
            elif end_tag:
                at = html.find(">", low) + 1
                yield "end", name[0].lower(), {}, low, at
            else:
                found, at = self.start(name.end())
                skip = yield "start", name[0].lower(), found, low, at
                if skip is not None:
                    at = skip
                    yield "", "", {}, at, at


def read_page(html: str) -> tuple[str, str, list[dict[str, str]], str]:
    """(text, title, links, language): visible text by line, white space collapsed, empty lines left out.

    Scripts, styles, noscript and template elements are not visible; one of the last two that has no end hides
    nothing, and a script or style without one hides the rest, as in a browser. Text in a head that is in none of
    its elements belongs to the body. A title without an end ends at the next tag. Time is in proportion to length.
    """
    ends: dict[str, list[int]] = {}
    for m in _ENDS.finditer(html):
        ends.setdefault(m[1].lower(), []).append(m.start())

    def end_of(tag: str, at: int) -> int | None:
        """Where the tag's next end begins."""
        own = ends.get(tag, [])
        i = bisect_left(own, at)
        return own[i] if i < len(own) else None

    parts, titles, links, hidden = [], [], [], []
    lang = ""
    tags = iter(_Tags(html))
    for kind, name, found, _, to in tags:
        if kind == "text":
            if not hidden:
                parts.append(name)
        elif kind == "start":
            if name == "html":
                lang = _plain(found.get("lang", "")) or lang
            if name in ("a", "link", "area") and found.get("href"):
                links.append({"path": f"{name.upper()}@/href", "url": _plain(found["href"])})
            elif name in ("img", "script", "iframe") and found.get("src"):
                links.append({"path": f"{name.upper()}@/src", "url": _plain(found["src"])})
            if name in ("script", "style", "title"):
                stop = end_of(name, to)
                if stop is None:
                    stop = len(html) if name != "title" else html.find("<", to) if html.find("<", to) >= 0 else len(html)
                if name == "title":
                    titles.append(html[to:stop])
                tags.send(stop)
            elif name in ("noscript", "template") and end_of(name, to) is not None:
                hidden.append(name)
            elif name == "body":
                hidden.clear()
            if name in _BREAKS:
                parts.append("\n")
        elif kind == "end":
            if name in hidden:
                del hidden[hidden.index(name) :]
            if name in _BREAKS:
                parts.append("\n")
    lines = (" ".join(x.split()) for x in _plain("".join(parts)).split("\n"))
    return "\n".join(x for x in lines if x), " ".join(_plain("".join(titles)).split()), links, lang


def field(value: str) -> str:
    """A header's value: control characters, which would end the line, percent-encoded."""
    return _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", value)


def serialise(headers: dict[str, str], block: bytes) -> bytes:
    """A WARC/1.0 record: named fields, block, and the two line ends that close it."""
    fields = "".join(f"{k}: {field(v)}\r\n" for k, v in headers.items())
    return f"WARC/1.0\r\n{fields}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """The named fields and the block of one record; ValueError if it is no whole record."""
    head, sep, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
    n = int(fields["Content-Length"])
    if not 0 <= n <= len(rest):
        raise ValueError("the block is cut short")
    return fields, rest[:n]


_RECORD = "warc_type string, record_id string, refers_to string, target_uri string, payload_digest string, block_digest string, record binary"
_FIELDS = [(n, pa.binary() if n == "record" else pa.string()) for n in ("warc_type", "record_id", "refers_to", "target_uri", "payload_digest", "block_digest", "record")]


def _row(page_id: int | None, fields: dict[str, str], block: bytes) -> dict:
    return {
        "page_id": page_id, "warc_type": fields["WARC-Type"], "record_id": fields["WARC-Record-ID"], "refers_to": fields.get("WARC-Refers-To"),
        "target_uri": fields.get("WARC-Target-URI"), "payload_digest": fields.get("WARC-Payload-Digest"), "block_digest": fields["WARC-Block-Digest"], "record": serialise(fields, block),
    }


def _mapped(df: DataFrame, f, rows: int = 64) -> DataFrame:  # noqa: ANN001
    schema = pa.schema([("page_id", pa.int64()), *_FIELDS])

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = [x for r in batch.slice(at, rows).to_pylist() for x in f(r)]
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return small_batches(df).mapInArrow(run, f"page_id long, {_RECORD}")


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """One response record for each row of ``pages`` (page_id, url, html).

    The block is an HTTP response whose body is the page in UTF-8. A null page is an empty body; a null
    url leaves WARC-Target-URI out, and one with line ends or other control characters has them percent-encoded. Rows that repeat make equal records; an empty table gives an empty one.
    """

    def make(r: dict) -> list[dict]:
        body = (r["html"] or "").encode()
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
        fields = {"WARC-Type": "response", "WARC-Record-ID": record_id("response", r["page_id"], r["url"], digest(body)), "WARC-Date": date}
        if r["url"] is not None:
            fields["WARC-Target-URI"] = field(r["url"])
        fields |= {"WARC-Payload-Digest": digest(body), "WARC-Block-Digest": digest(block), "Content-Type": "application/http; msgtype=response"}
        return [_row(r["page_id"], fields, block)]

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return _mapped(rows, make)


def derive(records: DataFrame) -> DataFrame:
    """A metadata and a conversion record for each response record (page_id, record) of ``records``.

    Both refer to the response's id and keep its target URI, date and payload digest. The metadata block
    is JSON: the source's WARC and HTTP headers, title, language and links. The conversion block is the
    page's visible text. Records that are no responses, null or broken give one ``metadata`` record
    whose block holds the error, so nothing is lost; an empty table gives an empty one.
    """

    def make(r: dict) -> list[dict]:
        try:
            source, block = parse(r["record"] or b"")
            if source.get("WARC-Type") != "response" or not source.get("WARC-Record-ID"):
                raise ValueError("not a response with an id")
        except (ValueError, KeyError) as e:
            text = json.dumps({"error": str(e)}).encode()
            fields = {"WARC-Type": "metadata", "WARC-Record-ID": record_id("error", r["page_id"], digest(r["record"] or b"")), "WARC-Date": DATE, "WARC-Block-Digest": digest(text), "Content-Type": "application/json"}
            return [_row(r["page_id"], fields, text)]
        head, _, body = block.partition(b"\r\n\r\n")
        status, *lines = head.decode("latin-1").split("\r\n")
        text, title, links, lang = read_page(body.decode("utf-8", "replace"))
        meta = {"warc_headers": source, "http_status": status, "http_headers": dict(x.split(": ", 1) for x in lines if ": " in x), "title": title, "language": lang, "links": links}
        kinds = (("metadata", "application/json", json.dumps(meta, ensure_ascii=False, sort_keys=True).encode()), ("conversion", "text/plain", text.encode()))
        out = []
        for kind, content, made in kinds:
            fields = {"WARC-Type": kind, "WARC-Record-ID": record_id(kind, source["WARC-Record-ID"]), "WARC-Date": source.get("WARC-Date", DATE)}
            if "WARC-Target-URI" in source:
                fields["WARC-Target-URI"] = source["WARC-Target-URI"]
            fields |= {"WARC-Refers-To": source["WARC-Record-ID"], "WARC-Payload-Digest": source.get("WARC-Payload-Digest", digest(body)), "WARC-Block-Digest": digest(made), "Content-Type": content}
            out.append(_row(r["page_id"], fields, made))
        return out

    return _mapped(records.select("page_id", "record"), make)

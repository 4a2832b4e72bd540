"""WARC derivatives: from each response a linked metadata record and a plain-text conversion record.

Derived records name the response in WARC-Refers-To and keep its target,
date and payload digest; the metadata record carries the source's HTTP
headers, title, language and outlinks as warc-fields. Record ids are
computed from the response's id, so a task that runs again makes the same
records. Records are rows until `render` makes their bytes; `read_records`
reads the files' bytes back. Nothing is shuffled.

Defined cases: null url or html is empty; markup that never closes runs to
the end of the page, but for a title, whose text is then shown; a very long
page takes time in proportion to its length; a payload is unpacked by its
transfer and content codings (chunked, gzip, deflate; others stay packed) and
read in its charset; a response's own payload digest is kept, and computed
where it has none; repeated pages give repeated records; of files, damaged or
cut-off records are left out and the others read, in time in proportion to the
file; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as entities
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = "WARC/1.1"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 4122
DATE = "2024-01-01T00:00:00Z"

#: Elements whose content isn't shown, and elements that begin a line of their own (fixed values).
HIDDEN = frozenset("script style noscript template svg".split())
BLOCK = frozenset("p div br hr h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th thead tbody section article aside header footer nav main form blockquote pre figure figcaption body html head".split())

MARK = re.compile(r"<(?:(!--)|(/?)([A-Za-z][A-Za-z0-9:-]*)|[!?])")
LANGUAGE = re.compile(r"(?:^|\s)lang\s*=\s*[\"']?([A-Za-z-]+)", re.IGNORECASE)
HREF = re.compile(r"(?:^|[\s\"'/])href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
CLOSING = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in (*HIDDEN, "title")}
GZIP = b"\x1f\x8b\x08"
STEP = 1 << 16
#: Longest head of a record, and most bytes that a payload is unpacked to.
MOST_HEAD, MOST_PAYLOAD = 1 << 16, 1 << 28
CHARSET = re.compile(r"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", re.IGNORECASE)


def read_page(page: str) -> tuple[str | None, str, list[str], str]:
    """(title, language, links, visible text with a line for each block) of a page, in one pass: a mark is never read twice."""
    shown, links, title, language, at, unclosed = [], [], None, "", 0, set()
    while mark := MARK.search(page, at):
        shown.append(page[at : mark.start()])
        if mark[1]:
            end = page.find("-->", mark.end())
            shown.append(" ")
            at = len(page) if end < 0 else end + 3
            continue
        end = page.find(">", mark.end())
        at = len(page) if end < 0 else end + 1
        name, inside = (mark[3] or "").lower(), page[mark.end() : max(end, mark.end())]
        if mark[2] or not name:
            shown.append("\n" if name in BLOCK else "")
            continue
        if name in CLOSING and name not in unclosed:
            close = CLOSING[name].search(page, at)
            if close is None and name in HIDDEN:
                at = len(page)
            elif close is None:
                unclosed.add(name)
            else:
                title = page[at : close.start()] if name == "title" and title is None else title
                at = close.end()
            shown.append(" ")
        elif name in BLOCK:
            shown.append("\n")
        if name == "html" and not language and (found := LANGUAGE.search(inside)):
            language = found[1].lower()
        if name == "a" and (found := HREF.search(inside)):
            links.append(next(x for x in found.groups() if x is not None))
    shown.append(page[at:])
    lines = (" ".join(line.split()) for line in entities.unescape("".join(shown)).split("\n"))
    return title, language, links, "\n".join(line for line in lines if line)


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(31).join(parts))}>"


def http_block(headers: list[tuple[str, str]], payload: bytes) -> bytes:
    return "".join(["HTTP/1.1 200 OK\r\n", *(f"{k}: {v}\r\n" for k, v in headers), "\r\n"]).encode() + payload


def split_http(block: bytes) -> tuple[str, bytes]:
    """(status line and headers, payload) of a response's block."""
    head, _, payload = block.partition(b"\r\n\r\n")
    return head.decode("utf-8", "replace"), payload


def unchunked(body: bytes) -> bytes:
    """The data of a chunked body; what comes after a damaged chunk is left out."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at, at + 4096)) >= 0:
        size = body[at:end].partition(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,12}", size) or not int(size, 16):
            break
        out.append(body[end + 2 : end + 2 + int(size, 16)])
        at = end + 4 + int(size, 16)
    return b"".join(out)


def inflated(body: bytes, coding: str) -> bytes:
    """The data of a gzip or deflate body up to its damage; of another coding the body itself."""
    if coding not in ("gzip", "x-gzip", "deflate"):
        return body
    ways = (31,) if coding != "deflate" else (15, -15)
    for way in ways:
        unpack, out, at, size = zlib.decompressobj(way), [], 0, 0
        try:
            while not unpack.eof and at < len(body) and size < MOST_PAYLOAD:
                out.append(unpack.decompress(body[at : at + STEP]))
                size += len(out[-1])
                at += STEP
        except zlib.error:
            pass
        if size:
            return b"".join(out)
    return b""


def page_of(head: str, payload: bytes) -> str:
    """The text of a payload, by its transfer and content codings and its charset (of the header, else of the page's first kilobyte, else UTF-8)."""
    named: dict[str, str] = {}
    for line in head.split("\r\n")[1:]:
        k, _, v = line.partition(":")
        named[k.strip().lower()] = v.strip()
    if "chunked" in named.get("transfer-encoding", "").lower():
        payload = unchunked(payload)
    for coding in reversed([x.strip() for x in named.get("content-encoding", "").lower().split(",") if x.strip()]):
        payload = inflated(payload, coding)
    told = CHARSET.search(named.get("content-type", "")) or CHARSET.search(payload[:1024].decode("latin-1"))
    try:
        return payload.decode(told[1] if told else "utf-8", "replace")
    except (LookupError, UnicodeError):
        return payload.decode("utf-8", "replace")


def derive(response: dict) -> tuple[dict, dict]:
    """The metadata and conversion records of a response record."""
    head, payload = split_http(response["block"])
    shared = {"refers_to": response["record_id"], "target_uri": response["target_uri"], "date": response["date"], "source_payload_digest": response.get("source_payload_digest") or digest(payload)}
    title, language, links, text = read_page(page_of(head, payload))
    fields = [("title", " ".join(entities.unescape(title or "").split())), ("language", language), *(("outlink", entities.unescape(x).replace("\n", " ").replace("\r", " ")) for x in links)]
    fields += [(f"source-{k.strip().lower()}", v.strip()) for k, _, v in (line.partition(":") for line in head.split("\r\n")[1:]) if k.strip()]
    described = "".join(f"{k}: {v}\r\n" for k, v in fields).encode()
    metadata = shared | {"type": "metadata", "record_id": record_id(response["record_id"], "metadata"), "content_type": "application/warc-fields", "block": described}
    conversion = shared | {"type": "conversion", "record_id": record_id(response["record_id"], "conversion"), "content_type": "text/plain; charset=utf-8", "block": text.encode()}
    return metadata, conversion


def render(record: dict) -> bytes:
    """A record's bytes, as one gzip member."""
    headers = [("WARC-Type", record["type"]), ("WARC-Record-ID", record["record_id"]), ("WARC-Date", record["date"]), ("WARC-Target-URI", record["target_uri"])]
    if record.get("refers_to"):
        headers += [("WARC-Refers-To", record["refers_to"]), ("WARC-Refers-To-Target-URI", record["target_uri"]), ("WARC-Refers-To-Date", record["date"]), ("X-Source-Payload-Digest", record["source_payload_digest"])]
    else:
        headers.append(("WARC-Payload-Digest", record.get("source_payload_digest") or digest(split_http(record["block"])[1])))
    headers += [("WARC-Block-Digest", digest(record["block"])), ("Content-Type", record["content_type"]), ("Content-Length", str(len(record["block"])))]
    head = "".join([VERSION + "\r\n", *(f"{k}: {v}\r\n" for k, v in headers), "\r\n"]).encode()
    return gzip.compress(head + record["block"] + b"\r\n\r\n", mtime=0)


def members(data: bytes):
    """What the gzip members of a file hold; of a damaged member what comes before the damage, then on to the next one."""
    at = data.find(GZIP)
    while at >= 0:
        inflate, out, fed = zlib.decompressobj(31), [], at
        try:
            while not inflate.eof and fed < len(data):
                out.append(inflate.decompress(data[fed : fed + STEP]))
                fed += STEP
            after = min(fed, len(data)) - len(inflate.unused_data)
        except zlib.error:
            after = at + 1
        yield b"".join(out)
        at = data.find(GZIP, after)


def parse(data: bytes) -> list[dict]:
    """The records in a file's bytes, plain or gzip members; a record that is cut off or has no length is left out."""
    if data[:2] == GZIP[:2]:
        return [r for part in members(data) for r in parse_plain(part)]
    return parse_plain(data)


def parse_plain(data: bytes) -> list[dict]:
    out, at = [], 0
    while (start := data.find(b"WARC/", at)) >= 0:
        if start and data[start - 1 : start] != b"\n":  # a version stands at the start of a line
            at = start + 5
            continue
        again = data.find(b"\nWARC/", start, start + MOST_HEAD)
        end = data.find(b"\r\n\r\n", start, again if again >= 0 else start + MOST_HEAD)
        if end < 0:  # a head that is cut off
            at = again + 1 if again >= 0 else start + 5
            continue
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in data[start:end].decode("utf-8", "replace").split("\r\n")[1:])}
        size = headers.get("content-length", "")
        if not size.isdecimal() or end + 4 + int(size) > len(data):
            at = start + 5
            continue
        at = end + 4 + int(size)
        out.append({"type": headers.get("warc-type", ""), "record_id": headers.get("warc-record-id", ""), "refers_to": headers.get("warc-refers-to"), "target_uri": headers.get("warc-target-uri", ""), "date": headers.get("warc-date", ""), "source_payload_digest": headers.get("x-source-payload-digest") or headers.get("warc-payload-digest"), "content_type": headers.get("content-type", ""), "block": data[end + 4 : at]})
    return out


RECORD = "page_id long, type string, record_id string, refers_to string, target_uri string, date string, source_payload_digest string, content_type string, block binary"
FIELDS = [x.split()[0] for x in RECORD.split(", ")]


def batch_of(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "block": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[f] for r in rows], kinds.get(f, pa.string())) for f in FIELDS], names=FIELDS)


def read_records(files: DataFrame) -> DataFrame:
    """Records of the files in a binaryFile DataFrame; page_id is null."""

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                found = parse(data.as_py() or b"")
                for k in range(0, len(found), 500):
                    yield batch_of([{"page_id": None} | r for r in found[k : k + 500]])

    return files.select("content").mapInArrow(run, RECORD)


def response_of(page_id: int | None, url: str | None, page: str | None, date: str = DATE) -> dict:
    payload = (page or "").encode()
    block = http_block([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))], payload)
    return {"page_id": page_id, "type": "response", "record_id": record_id(str(page_id), url or ""), "refers_to": None, "target_uri": url or "", "date": date, "source_payload_digest": None, "content_type": "application/http; msgtype=response", "block": block}


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """A response record for each page."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                rows = [response_of(i, u, h, date) for i, u, h in zip(*(c.to_pylist() for c in batch.slice(k, 500).columns))]
                yield batch_of(rows)

    return pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string")).mapInArrow(run, RECORD)


def derivatives(records: DataFrame) -> DataFrame:
    """Metadata and conversion records of the responses among `records`."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                rows = [{"page_id": r["page_id"]} | d for r in batch.slice(k, 500).to_pylist() for d in derive(r)]
                yield batch_of(rows)

    return records.filter("type = 'response'").select(*FIELDS).mapInArrow(run, RECORD)


def report(pages: DataFrame) -> DataFrame:
    """One row per derived record: its links, digests and block."""
    found = derivatives(responses(pages))
    return found.select("page_id", "type", "record_id", "refers_to", "target_uri", "source_payload_digest", F.octet_length("block").cast("long").alias("content_length"), F.sha2("block", 256).alias("block_sha256"), F.decode("block", "UTF-8").alias("content"))

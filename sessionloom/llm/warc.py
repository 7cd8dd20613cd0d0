"""WARC records and the derivatives built from responses.

A response becomes two records that refer to it: a metadata record (``application/warc-fields``:
the source's WARC and HTTP headers, title, links) and, where the payload is text, a conversion
record in plain text. Both carry ``WARC-Refers-To``, ``WARC-Target-URI``, ``WARC-Date`` and digests
of their own; the source's digests are kept in the metadata and checked against its payload.

Record ids are UUIDs derived from the source record, so a task that runs again writes the same ids.
"""

from __future__ import annotations

import base64
import gzip
import html
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from hashlib import sha1
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CRLF = b"\r\n"
DATE = "2024-01-01T00:00:00Z"
SCHEMA = (
    "source_id string, record_type string, record_id string, refers_to string, target_uri string, warc_date string, "
    "content_type string, content_length long, block_digest string, payload_digest string, source_payload_digest string, "
    "digest_ok boolean, complete boolean, http_status int, n_links long, n_chars long, block binary"
)
#: bytes of blocks that are handed on at once, and what a row counts besides
OUT_BYTES, ROW_BYTES = 32 << 20, 512
FIELDS = [x.split() for x in SCHEMA.split(", ")]
ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}

DROPPED = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|title)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.I | re.S)
TITLE = re.compile(r"<title\b[^>]*>(.*?)(?:</title|\Z)", re.I | re.S)
LINK = re.compile(r"""<(a|img|link|script|iframe|area|form|source)\b[^>]*?\s(?:href|src|action)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
BREAK = re.compile(r"</?(?:p|div|h[1-6]|li|ul|ol|tr|table|br|hr|section|article|header|footer|nav|aside|main|blockquote|pre|td|th|dd|dt|dl|form|title|head)\b[^>]*>", re.I)
ANY_TAG = re.compile(r"<[/!?a-zA-Z][^>]*>")
GZIP, PIECE = b"\x1f\x8b\x08", 1 << 18
CHARSET = re.compile(rb"charset\s*=\s*[\"']?([a-zA-Z0-9_.:-]+)", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(sha1(data).digest()).decode()


def record(kind: str, headers: Iterable[tuple[str, str]], block: bytes) -> bytes:
    """One WARC/1.0 record; type, length and block digest are added."""
    lines = [b"WARC/1.0", f"WARC-Type: {kind}".encode()]
    lines += [f"{k}: {v}".encode() for k, v in headers]
    lines += [f"WARC-Block-Digest: {digest(block)}".encode(), f"Content-Length: {len(block)}".encode()]
    return CRLF.join(lines) + CRLF * 2 + block + CRLF * 2


def _headers(raw: bytes) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for line in raw.decode("utf-8", "replace").replace("\r\n", "\n").split("\n"):
        if line[:1] in " \t" and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            k, v = line.split(":", 1)
            out.append((k.strip(), v.strip()))
    return out


def parse(raw: bytes) -> Iterator[tuple[dict[str, str], list[tuple[str, str]], bytes]]:
    """Records of plain WARC bytes as (headers by lower-case name, headers in order, block).

    Bytes that do not begin a record are passed over up to the next record's first line. A block
    that ends before its Content-Length comes as far as it goes.
    """
    at = 0
    while (at := raw.find(b"WARC/", at)) >= 0:
        found = re.compile(rb"\r?\n\r?\n").search(raw, at)
        if not found:
            return
        ordered = _headers(raw[at : found.start()].split(b"\n", 1)[-1])
        named = {k.lower(): v for k, v in ordered}
        length = named.get("content-length", "")
        if not (length.isascii() and length.isdigit()):
            at = found.end()
            continue
        end = found.end() + int(length)
        yield named, ordered, raw[found.end() : end]
        at = end


def members(raw: bytes) -> Iterator[tuple[bytes, int]]:
    """The gzip members of a file, one after another, as (bytes, damaged bytes); plain bytes are one.

    A damaged member gives what can be unpacked of it; reading goes on at the next member's mark.
    """
    if raw[:2] != GZIP[:2]:
        yield raw, 0
        return
    at = 0
    while (at := raw.find(GZIP, at)) >= 0:
        member, out, end = zlib.decompressobj(31), [], at
        try:
            while not member.eof and end < len(raw):
                out.append(member.decompress(raw[end : end + PIECE]))
                end += PIECE
            sound = member.eof
        except zlib.error:
            sound = False
        if sound:
            end = min(end, len(raw)) - len(member.unused_data)
            yield b"".join(out), 0
        else:
            end = raw.find(GZIP, at + 1)
            end = len(raw) if end < 0 else end
            yield b"".join(out), end - at
        at = end


def unpacked(raw: bytes) -> Iterator[tuple[bytes, int]]:
    """``members``, where a record that goes on in the next member is put together."""
    held, lost = b"", 0
    for data, damaged in members(raw):
        if held and data.startswith(b"WARC/"):
            yield held, lost
            held, lost = b"", 0
        held, lost = held + data, lost + damaged
    yield held, lost


def http_parts(block: bytes) -> tuple[int | None, list[tuple[str, str]], bytes]:
    """Status, headers and payload of an HTTP response; without a status line all is payload."""
    if not block.startswith(b"HTTP/"):
        return None, [], block
    found = re.compile(rb"\r?\n\r?\n").search(block)
    head, payload = (block[: found.start()], block[found.end() :]) if found else (block, b"")
    first, _, rest = head.partition(b"\n")
    status = re.match(rb"HTTP/\S+\s+(\d{3})", first)
    headers = _headers(rest)
    if any(k.lower() == "content-encoding" and "gzip" in v.lower() for k, v in headers):
        try:
            payload = gzip.decompress(payload)
        except (OSError, EOFError, zlib.error):
            pass  # a broken body is kept as it is
    return int(status[1]) if status else None, headers, payload


def plain_text(page: str) -> str:
    """The page's text, a line for each run between block-level tags."""
    page = DROPPED.sub(" ", page)
    page = ANY_TAG.sub("", BREAK.sub("\x00", page))
    lines = (" ".join(x.split()) for x in html.unescape(page).split("\x00"))
    return "\n".join(x for x in lines if x)


def _id(source: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{source}#{kind}')}>"


def derive(named: dict[str, str], ordered: list[tuple[str, str]], block: bytes) -> list[dict]:
    """The derivatives of one record; none for records that are not responses."""
    if named.get("warc-type", "").lower() not in ("response", "resource"):
        return []
    source, uri, date = named.get("warc-record-id", ""), named.get("warc-target-uri", "").strip("<>"), named.get("warc-date", "")
    response = named["warc-type"].lower() == "response"
    status, headers, payload = http_parts(block) if response else (None, [], block)
    raw_payload = block[len(block) - len(payload) :] if block.endswith(payload) else payload
    known = {k.lower(): v for k, v in headers}
    kind = known.get("content-type", "" if response else named.get("content-type", "")).split(";")[0].strip().lower()
    charset = CHARSET.search(known.get("content-type", "").encode()) or CHARSET.search(payload[:1024])
    try:
        text = payload.decode(charset[1].decode() if charset else "utf-8", "replace")
    except LookupError:
        text = payload.decode("utf-8", "replace")
    page = kind in ("text/html", "application/xhtml+xml") or (not kind and "<html" in text[:1024].lower())
    own = digest(raw_payload)
    complete = len(block) == int(named["content-length"])
    claimed = named.get("warc-payload-digest")
    fields = [(f"source-{k.lower()}", v) for k, v in ordered] + [(f"http-{k.lower()}", v) for k, v in headers]
    if status is not None:
        fields.append(("http-status", str(status)))
    links: list[str] = []
    if page:
        title = TITLE.search(text)
        if title:
            fields.append(("title", " ".join(html.unescape(title[1]).split())))
        links = [" ".join(html.unescape(a or b or c).split()) for _, a, b, c in LINK.findall(text)]
        fields += [("outlink", x) for x in links]
    if not complete:
        fields.append(("block-truncated-at", str(len(block))))
    common = {
        "source_id": source, "refers_to": source, "target_uri": uri, "warc_date": date, "source_payload_digest": claimed or own,
        "digest_ok": None if claimed is None else claimed == own, "complete": complete, "http_status": status, "n_links": len(links),
    }
    out = []
    body = "".join(f"{k}: {v}\r\n" for k, v in fields).encode()
    out.append(common | {"record_type": "metadata", "content_type": "application/warc-fields", "block": body, "n_chars": None})
    if page or kind.startswith("text/"):
        converted = plain_text(text) if page else text
        out.append(common | {"record_type": "conversion", "content_type": "text/plain", "block": converted.encode("utf-8", "replace"), "n_chars": len(converted)})
    for x in out:
        x |= {"record_id": _id(source or uri, x["record_type"]), "content_length": len(x["block"]), "block_digest": digest(x["block"])}
        x["payload_digest"] = x["block_digest"]
    return out


def damage(lost: int) -> dict:
    """The row that tells of bytes which could not be unpacked."""
    return dict.fromkeys([n for n, _ in FIELDS]) | {"record_type": "damaged", "content_length": lost}


def as_record(row: dict) -> bytes:
    """A derivative as WARC bytes."""
    return record(
        row["record_type"],
        [
            ("WARC-Record-ID", row["record_id"]),
            ("WARC-Refers-To", row["refers_to"]),
            ("WARC-Target-URI", row["target_uri"]),
            ("WARC-Date", row["warc_date"]),
            ("WARC-Payload-Digest", row["payload_digest"]),
            ("Content-Type", row["content_type"]),
        ],
        row["block"],
    )


def response(page_id: object, url: str | None, page: str | None, date: str = DATE) -> bytes:
    """A page as a response record, for tables that hold pages and no records."""
    body = (page or "").encode()
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(body)).encode() + CRLF * 2
    return record(
        "response",
        [
            ("WARC-Record-ID", _id(f"{page_id} {url or ''} {digest(body)}", "response")),
            ("WARC-Target-URI", " ".join((url or "").split())),
            ("WARC-Date", date),
            ("WARC-Payload-Digest", digest(body)),
            ("Content-Type", "application/http; msgtype=response"),
        ],
        head + body,
    )


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """``page_id`` and the response record (``warc``, binary) of every row; null html is an empty
    body, a null url an empty target, a null id stays null. A record's id comes from page, url and
    body, so equal rows have equal records and no others do. Other columns are not read; an empty
    table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids, urls, bodies = (c.to_pylist() for c in batch.slice(at, 256).columns)
                made = [response(i, u, h, date) for i, u, h in zip(ids, urls, bodies)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(made, pa.binary())], ["page_id", "warc"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, warc binary")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The files of a folder or glob (.warc, .warc.gz) as ``path`` and ``warc`` (binary).

    A file is one row, as Spark reads whole files; keep files at the customary 1 GB or less.
    """
    return spark.read.format("binaryFile").load(path).selectExpr("path", "content AS warc")


def derivatives(records: DataFrame, key: str, key_type: str = "string", with_block: bool = True, out_bytes: int = OUT_BYTES) -> DataFrame:
    """All derivatives of the records in ``warc`` of each row, with the row's ``key`` column.

    Null and empty ``warc`` values and records other than responses give nothing; repeated records
    give repeated derivatives; broken bytes between records are passed over; a digest that does
    not fit its payload is reported in ``digest_ok`` (null where the source claims none), not
    repaired, a block shorter than its Content-Length in ``complete``. Bytes of a gzip file that
    cannot be unpacked are a row of type ``damaged`` with their number in ``content_length``, and
    reading goes on behind them. Very long records are read whole, one member at a time, and results are
    handed on after about ``out_bytes`` of blocks. An empty table gives an empty result; other columns
    are not read.
    """
    fields = [(n, t) for n, t in FIELDS if with_block or n != "block"]

    def told(batch: pa.RecordBatch, keys: list[int], found: list[dict]) -> pa.RecordBatch:
        columns = [batch.column(key).take(pa.array(keys, pa.int64()))]
        columns += [pa.array([x[n] for x in found], ARROW[t]) for n, t in fields]
        return pa.RecordBatch.from_arrays(columns, [key, *(n for n, _ in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, found, held = [], [], 0
            for k, raw in enumerate(batch.column("warc")):
                for data, lost in unpacked(raw.as_py() or b""):
                    for row in chain((y for x in parse(data) for y in derive(*x)), [damage(lost)] if lost else []):
                        keys.append(k)
                        found.append(row)
                        held += ROW_BYTES + len(row["block"] or b"")
                        if held >= out_bytes:  # within a row, too: one archive may unpack to any size
                            yield told(batch, keys, found)
                            keys, found, held = [], [], 0
            yield told(batch, keys, found)

    return records.select(key, "warc").mapInArrow(run, f"`{key}` {key_type}, " + ", ".join(f"{n} {t}" for n, t in fields))


def packed(rows: DataFrame) -> DataFrame:
    """Derivatives (with their blocks) as gzip members in ``warc_gz``: the concatenated members of
    any rows are a valid .warc.gz file. Rows that tell of damage are no records and give none."""
    names = [n for n, _ in FIELDS if n != "source_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [gzip.compress(as_record(x), mtime=0) for x in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("record_id"), pa.array(made, pa.binary())], ["record_id", "warc_gz"])

    return rows.where("record_type <> 'damaged'").select(*names).mapInArrow(run, "record_id string, warc_gz binary")

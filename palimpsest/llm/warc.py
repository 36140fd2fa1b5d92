"""WARC derivatives: metadata and plain-text conversion records from response records.

A response record gives two records of its own: `metadata` (application/warc-fields: status and
headers of the source's HTTP message, title, outlinks, the source's digests) and `conversion`
(text/plain, UTF-8). Both name the response in WARC-Refers-To, repeat its target URI and date, and carry the
digest of their own block; the metadata names the conversion's id and the source's block and
payload digests, kept if the source states them, else computed. Ids are UUIDs from the source's id
and the record type, so a rerun makes the same records.

Everything is a map over records: no shuffle, and a record's bytes are all that is in memory. Files are read
as a stream of pieces between record ends, so their size doesn't matter; they are written with a gzip member per record and a warcinfo record first.

Defined cases: a null page has an empty payload, a null url no target URI; a record that isn't
an HTTP response yields a conversion of its block as text; malformed headers are skipped; a body whose transfer or content
coding is unknown or broken is taken as it is; records that are not
responses, and null ones, are passed over; equal pages with equal ids give equal records, a null id names them
like a value; an empty table gives none. Other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import itertools
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SPACE_OF_IDS = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122
CRLF = b"\r\n"
_HIDDEN = re.compile(r"<!--|<(script|style|noscript|template)\b", re.I)
_BLOCK = re.compile(r"</?(?:p|div|br|hr|h[1-6]|li|ul|ol|dl|dt|dd|table|tr|td|th|article|section|nav|header|footer|aside|main|pre|blockquote|title|body|form)\b[^>]*>", re.I)
_TAG = re.compile(r"<[a-zA-Z/!?][^>]*>")
_TITLE = re.compile(r"<title[^>]*>", re.I)
_ANCHOR = re.compile(r"<a\s[^>]*>", re.I)
_HREF = re.compile(r"\shref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACES = re.compile(r"[^\S\n]+")
_LINES = re.compile(r"\s*\n\s*")
SCHEMA = "source_id string, warc_type string, record_id string, refers_to string, concurrent_to string, target_uri string, date string, source_block_digest string, source_payload_digest string, block_digest string, record string, block string"


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def derived_id(source: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE_OF_IDS, f'{kind} {source}')}>"


def one_line(x: str) -> str:
    return " ".join(x.split())


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without the two line ends that close it."""
    head = [("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {one_line(v)}\r\n".encode() for k, v in [*fields, *head] if v) + CRLF + block


def split_headers(data: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """First line, header fields (continued lines joined), rest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    fields: list[tuple[str, str]] = []
    for x in lines:
        if x[:1] in " \t" and fields:
            fields[-1] = (fields[-1][0], f"{fields[-1][1]} {x.strip()}")
        elif ":" in x:
            k, v = x.split(":", 1)
            fields.append((k.strip(), v.strip()))
    return first, fields, rest


def response_record(key: str, url: str | None, page: str | None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """A response record around a page, as a crawler would have stored it."""
    payload = (page or "").encode("utf-8", "replace")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(payload)).encode() + b"\r\n\r\n" + payload
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", derived_id(f"{key} {url}", "response")), ("WARC-Date", date), ("WARC-Target-URI", url or ""), ("WARC-Payload-Digest", digest(payload)), ("Content-Type", "application/http; msgtype=response")]
    return record(fields, http)


def visible(page: str) -> str:
    """A page without scripts, styles and comments; one that never ends stays. Each is looked for once from its start, so the time is linear."""
    low, out, at, endless = page.lower(), [], 0, set()
    for m in _HIDDEN.finditer(page):
        if m.start() < at:
            continue
        close = f"</{m[1].lower()}" if m[1] else "-->"
        end = -1 if close in endless else low.find(close, m.end())
        end = end if end < 0 or not m[1] else low.find(">", end)
        if end < 0:
            endless.add(close)
            continue
        out += [page[at : m.start()], " "]
        at = end + (1 if m[1] else 3)
    return "".join([*out, page[at:]])


def plain_text(page: str) -> str:
    """The text of a page: without scripts, styles, comments and tags; a line per block."""
    page = visible(page)
    last = page.rfind(">") + 1  # no tag ends after it
    x = _TAG.sub("", _BLOCK.sub("\n", page[:last])) + page[last:]
    return _LINES.sub("\n", _SPACES.sub(" ", html.unescape(x))).strip()


def title_of(page: str) -> str:
    m = _TITLE.search(page)
    end = page.lower().find("</title", m.end()) if m else -1
    return html.unescape(page[m.end() : end]) if end >= 0 else ""


def outlinks(page: str) -> list[str]:
    page = visible(page)
    found = (_HREF.search(m[0]) for m in _ANCHOR.finditer(page, 0, page.rfind(">") + 1))
    return [html.unescape(next(x for x in m.groups() if x is not None)) for m in found if m]


def unchunked(body: bytes) -> bytes:
    """A chunked body's data; the body itself where its chunks don't hold."""
    out, at = [], 0
    while (end := body.find(CRLF, at)) >= 0:
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return body
        if size == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2
    return body


def uncoded(payload: bytes, headers: list[tuple[str, str]]) -> tuple[bytes, bytes]:
    """(entity body, content): the payload without its transfer coding, and that without its content coding."""
    import zlib

    h = {k.lower(): v.lower() for k, v in headers}
    body = unchunked(payload) if "chunked" in h.get("transfer-encoding", "") else payload
    content = body
    for coding in reversed([x.strip() for x in h.get("content-encoding", "").split(",")]):
        try:
            if coding in ("gzip", "x-gzip"):
                content = zlib.decompressobj(31).decompress(content)
            elif coding == "deflate":
                content = zlib.decompressobj(15 if content[:1] == b"\x78" else -15).decompress(content)
        except zlib.error:
            break
    return body, content


def derive(source: bytes) -> list[tuple[str, ...]]:
    """The two rows (columns of SCHEMA) that a response record gives; none for other records."""
    _, own, block = split_headers(source)
    h = {k.lower(): v for k, v in own}
    if h.get("warc-type", "").lower() != "response":
        return []
    block = block[: int(h["content-length"])] if h.get("content-length", "").isdigit() else block
    source_id, uri, date = h.get("warc-record-id", ""), h.get("warc-target-uri", ""), h.get("warc-date", "")
    is_http = block.startswith(b"HTTP/")
    status, headers, payload = split_headers(block) if is_http else ("", [], block)
    payload, content = uncoded(payload, headers)
    charset = next((m[1] for k, v in headers if k.lower() == "content-type" and (m := re.search(r"charset=[\"']?([\w-]+)", v, re.I))), "utf-8")
    try:
        page = content.decode(charset, "replace")
    except LookupError:
        page = content.decode("utf-8", "replace")
    block_digest, payload_digest = h.get("warc-block-digest") or digest(block), h.get("warc-payload-digest") or digest(payload)
    text = plain_text(page).encode("utf-8", "replace")
    ids = {k: derived_id(source_id, k) for k in ("metadata", "conversion")}
    lines = [("source-status", status), *[(f"source-header-{k.lower()}", v) for k, v in headers], ("source-block-digest", block_digest), ("source-payload-digest", payload_digest), ("conversion", ids["conversion"]), ("title", title_of(page)), *[("outlink", x) for x in outlinks(page)]]
    blocks = {"metadata": b"".join(f"{k}: {one_line(v)}\r\n".encode("utf-8", "replace") for k, v in lines if one_line(v)), "conversion": text}
    kinds = {"metadata": "application/warc-fields", "conversion": "text/plain; charset=utf-8"}
    rows = []
    for kind, other in (("metadata", "conversion"), ("conversion", "metadata")):
        fields = [("WARC-Type", kind), ("WARC-Record-ID", ids[kind]), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Refers-To", source_id), ("WARC-Concurrent-To", ids[other]), ("Content-Type", kinds[kind])]
        whole = record(fields, blocks[kind])
        rows.append((source_id, kind, ids[kind], source_id, ids[other], uri or None, date, block_digest, payload_digest, digest(blocks[kind]), whole.decode("utf-8", "replace"), blocks[kind].decode("utf-8", "replace")))
    return rows


def responses(pages: DataFrame) -> DataFrame:
    """page_id, record binary from pages(page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [response_record(str(k), u, t) for k, u, t in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=["page_id", "record"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, record binary")


def derivatives(records: DataFrame, key: str = "page_id") -> DataFrame:
    """The derived records of records(key long, record binary), with the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(key, pa.int64()), *[(x.split()[0], pa.string()) for x in SCHEMA.split(", ")]])
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                rows = [(i, *r) for i, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) if x is not None for r in derive(x)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)

    return records.select(F.col(key).cast("long").alias(key), "record").mapInArrow(run, f"{key} long, {SCHEMA}")


def member(data: bytes) -> bytes:
    """A record with the line ends that close it as a gzip member without its last byte, which is 0.

    That byte is the high one of the record's length. Where it isn't 0 (16 MB or more), an empty member follows, whose is.
    """
    data = gzip.compress(data + CRLF + CRLF, 6, mtime=0)
    return (data if data[-1] == 0 else data + gzip.compress(b"", mtime=0))[:-1]


def write_warc(derived: DataFrame, path: str, software: str = "palimpsest") -> None:
    """The records as .warc.gz files of a gzip member per record, the first a warcinfo record; a file per partition with records.

    The members are lines of Spark's text writer, whose line end is the last byte of each, so any file system works.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for b in batches:
            rows = [x.encode("utf-8", "replace") for x in b.column(0).to_pylist() if x is not None]
            if rows and first:
                first = False
                body = f"software: {software}\r\nformat: WARC File Format 1.1\r\n".encode()
                name = derived_id(digest(rows[0]), "warcinfo")
                rows.insert(0, record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", name), ("WARC-Date", "2024-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")], body))
            yield pa.RecordBatch.from_arrays([pa.array([member(x) for x in rows], pa.binary())], names=["value"])

    made = derived.select("record").mapInArrow(run, "value binary")
    made.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").text(path)
    spark = derived.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for x in files.listStatus(folder):
        name = x.getPath().getName()
        if name.endswith(".txt"):
            files.rename(x.getPath(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, f"{name[:-4]}.warc.gz"))


#: What stands between two records of a file.
BETWEEN = b"\r\n\r\nWARC/"


def whole_records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Records from a file's pieces between BETWEEN, joined again where a record holds it, cut at their stated lengths."""
    open_: list[bytes] = []
    held, need = 0, 0
    for n, piece in enumerate(pieces):
        piece = piece if n == 0 and piece.startswith(b"WARC/") else b"WARC/" + piece
        if open_ and held < need:
            open_.append(BETWEEN[:4] + piece)
            held += len(piece) + 4
            continue
        if open_:
            yield b"".join(open_)[:need]
        end = piece.find(b"\r\n\r\n")
        size = re.search(rb"\r\nContent-Length:[ \t]*(\d+)", piece if end < 0 else piece[: end + 2], re.I)
        # a piece that ends with its header has lost the line ends that close it
        open_, held, need = [piece], len(piece), (end if end >= 0 else len(piece)) + 4 + (int(size[1]) if size else 0)
    if open_:
        yield b"".join(open_)[:need]


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """path, record binary for every record of the WARC files under a path, gzipped (by their name) or not.

    Spark's text reader streams the pieces between records, so a file of any size is read with a record at a time in
    memory. A file that isn't gzipped may be split between tasks; a record that holds BETWEEN itself is then whole unless the split falls in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = ((n, x) for b in batches for n, x in zip(b.column(0).to_pylist(), b.column(1), strict=True))
        for name, part in itertools.groupby(flat, key=lambda x: x[0]):
            for r in whole_records(x.as_py() for _, x in part):
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([r], pa.binary())], names=["path", "record"])

    rows = spark.read.option("lineSep", BETWEEN.decode()).text(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("piece")).mapInArrow(run, "path string, record binary")


def op4_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(responses(table(spark, sf_dir, "pages")))

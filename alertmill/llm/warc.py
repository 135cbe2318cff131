"""WARC derivatives: metadata and plain-text conversion records of responses, linked to them.

A response is (record_id, target_uri, date, http_headers, payload). Its conversion record holds the page's text,
its metadata record the source headers, the payload's digest, title and outlinks; both name the response in
WARC-Refers-To, and the metadata record names the conversion in WARC-Concurrent-To.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertmill.llm.common import arrow_map, lean, session

# fixed values: elements whose text is not shown; those of the first line hold everything up to their end tag or the page's end
RAW = ("script", "style", "title")
UNSHOWN = (*RAW, "noscript", "template", "head")
# fixed values: elements that stand on lines of their own, and cells
BLOCKS = frozenset("p div br hr li ul ol dl dt dd tr table h1 h2 h3 h4 h5 h6 section article header footer nav aside main pre blockquote form figure option".split())
CELLS = frozenset(("td", "th"))
# attributes whose quotes close before the next tag; tags with others end at the first bracket
_ATTRS = r"(?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+"
TAG = re.compile(rf"<(?:(!--)|(/?)([a-zA-Z][a-zA-Z0-9]*+)({_ATTRS}>|[^<>]*>)|[a-zA-Z/!?](?:{_ATTRS}>|[^<>]*>))")
END = {name: re.compile(rf"(?i)</{name}\s*+>") for name in UNSHOWN}
TITLE = re.compile(r"(?i)<title\b[^<>]*>")
HREF = re.compile(r"(?i)\bhref\s*+=\s*+(?:\"([^\"<>]*)\"|'([^'<>]*)'|([^\s\"'<>]+))")
BLANK, LINES = re.compile(r"[ \t\r\f\v\xa0]+"), re.compile(r" ?\n[ \n]*")
CHARSET = re.compile(rb"(?i)charset\s*=\s*[\"']?([a-z0-9_:.-]+)")
EPOCH = "1970-01-01T00:00:00Z"
#: Bytes of record blocks that ``read`` hands on together, or one record.
READ_BYTES = 1 << 22
#: Bytes that a compressed body may unpack to, and those unpacked at a time.
UNPACKED, PIECE = 1 << 29, 1 << 20


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: str) -> str:
    """The same parts give the same identifier."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(chr(0).join(parts).encode()).digest()[:16], version=5)}>"


def shown(markup: str) -> tuple[str, list[str]]:
    """A page's raw text, without tags, comments and what is not shown, and its links as they stand, in one pass."""
    out, links, at, never = [], [], 0, set()
    while (m := TAG.search(markup, at)) is not None:
        out.append(markup[at : m.start()])
        at = m.end()
        comment, close, name, rest = m.groups()
        if comment:
            end = markup.find("-->", at)
            at = len(markup) if end < 0 else end + 3
            out.append(" ")
        elif name:
            name = name.lower()
            if name in UNSHOWN and not close and name not in never:
                end = END[name].search(markup, at)
                if end:
                    at = end.end()
                elif name in RAW:
                    at = len(markup)
                else:
                    never.add(name)
                out.append(" ")
            elif name in BLOCKS:
                out.append("\n")
            elif name in CELLS:
                out.append(" ")
            elif name == "a" and not close and (href := HREF.search(rest)):
                links.append(next(g for g in href.groups() if g is not None))
    out.append(markup[at:])
    return "".join(out), links


def tidy(raw: str) -> str:
    return LINES.sub("\n", BLANK.sub(" ", html.unescape(raw))).strip()


def page_text(markup: str) -> str:
    """The text of a page: no scripts, styles, comments or head; blocks on lines of their own, references decoded."""
    return tidy(shown(markup)[0])


def page_title(markup: str) -> str:
    m = TITLE.search(markup)
    end = END["title"].search(markup, m.end()) if m else None
    return " ".join(html.unescape(markup[m.end() : end.start()]).split()) if end else ""


def targets(links: list[str]) -> list[str]:
    """The targets of links, first mention first."""
    found = (html.unescape(x).strip() for x in links)
    return list(dict.fromkeys(x for x in found if x and not x.startswith(("#", "javascript:"))))


def fields_of(http_headers: str | None) -> dict[str, str]:
    """Header fields by lower-case name; lines without a colon, such as the status line, are none."""
    out = {}
    for line in (http_headers or "").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def unchunked(data: bytes) -> bytes:
    """The body of chunks; what is no chunk ends it, and a body without any chunk stands as it is."""
    out, at = [], 0
    while (end := data.find(b"\r\n", at)) >= 0:
        try:
            size = int(data[at:end].split(b";")[0], 16)
        except ValueError:
            break
        if size <= 0:
            return b"".join(out)
        out.append(data[end + 2 : end + 2 + size])
        at = end + 2 + size + 2
    return b"".join(out) if out else data


def members(data: bytes, bits: int) -> Iterator[bytes]:
    """The unpacked pieces of all members of compressed data, ``PIECE`` bytes at most at a time; data cut short end with what they hold."""
    while data:
        one = zlib.decompressobj(bits)
        while data and not one.eof:
            yield one.decompress(data, PIECE)
            data = one.unused_data if one.eof else one.unconsumed_tail
        if not one.eof:
            yield one.flush()


def unpacked(data: bytes, most: int = UNPACKED) -> bytes:
    """What gzip, zlib or raw deflate data hold, all members of it; what follows the last whole member and is none is passed over.

    Data that begin with no member stand as they are, and so do data that hold over ``most`` bytes, of which no more than that is ever unpacked.
    """
    for bits in (47, -15):
        out, size = [], 0
        try:
            for piece in members(data, bits):
                out.append(piece)
                size += len(piece)
                if size > most:
                    return data
        except zlib.error:
            if bits < 0 or not out:
                continue
        return b"".join(out)
    return data


def markup_of(http_headers: str | None, payload: bytes) -> str:
    """The page that a payload holds: chunks joined, compression undone, decoded by its charset; what is broken stands as it is."""
    fields = fields_of(http_headers)
    if "chunked" in fields.get("transfer-encoding", "").lower():
        payload = unchunked(payload)
    if fields.get("content-encoding", "").lower() in ("gzip", "x-gzip", "deflate"):
        payload = unpacked(payload)
    named = CHARSET.search(fields.get("content-type", "").encode()) or CHARSET.search(payload[:1024])
    try:
        return payload.decode(named[1].decode() if named else "utf-8", "replace")
    except (LookupError, UnicodeError):
        return payload.decode("utf-8", "replace")


def derivatives(response: dict) -> tuple[dict, dict]:
    """The metadata and the conversion record of a response.

    Both name the response and keep its payload digest, the source's own where it has one. The metadata block has the
    title, one source header a line, as it stood, and the links.
    """
    payload, own = response["payload"] or b"", response["record_id"]
    markup = markup_of(response["http_headers"], payload)
    raw, links = shown(markup)
    text = tidy(raw).encode()
    paid = response.get("payload_digest") or digest(payload)
    same = {"refers_to": own, "target_uri": response["target_uri"], "date": response["date"], "payload_digest": paid}
    converted = {"type": "conversion", "record_id": record_id("conversion", own or ""), "concurrent_to": None, "content_type": "text/plain; charset=utf-8", "block_digest": digest(text), "block": text, **same}
    fields = [("conversionOf", own or ""), ("payloadDigest", paid), ("title", page_title(markup))]
    fields += [("sourceHeader", " ".join(x.split("\r"))) for x in (response["http_headers"] or "").split("\r\n") if x]
    fields += [("outlink", " ".join(x.split())) for x in targets(links)]
    block = "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "replace")
    meta = {"type": "metadata", "record_id": record_id("metadata", own or ""), "concurrent_to": converted["record_id"], "content_type": "application/warc-fields", "block_digest": digest(block), "block": block, **same}
    return meta, converted


HEADERS = (("WARC-Type", "type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Concurrent-To", "concurrent_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"), ("WARC-Block-Digest", "block_digest"), ("WARC-Payload-Digest", "payload_digest"), ("Content-Type", "content_type"))


def to_bytes(record: dict) -> bytes:
    """A record in WARC/1.1; null fields are left out."""
    head = "".join(f"{name}: {record[key]}\r\n" for name, key in HEADERS if record.get(key) is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(record['block'])}\r\n\r\n".encode() + record["block"] + b"\r\n\r\n"


def records(file) -> Iterator[dict]:
    """The records of an open WARC file, one at a time; lines between records are passed over, a record cut short ends the file."""
    names = {k.lower(): v for k, v in HEADERS}
    try:
        while line := file.readline():
            if not line.startswith(b"WARC/"):
                continue
            fields = {}
            while (line := file.readline()).strip():
                name, colon, value = line.decode("utf-8", "replace").partition(":")
                if colon:
                    fields.setdefault(name.strip().lower(), value.strip())
            size = fields.get("content-length", "")
            if not size.isdigit():
                continue
            record = {v: fields.get(k) for k, v in names.items()}
            record["block"] = file.read(int(size))
            if record["type"] == "response":
                http, _, record["payload"] = record["block"].partition(b"\r\n\r\n")
                record["http_headers"] = http.decode("latin-1")
            yield record
    except (EOFError, zlib.error, gzip.BadGzipFile):
        return


def parse(data: bytes) -> list[dict]:
    """The records of a WARC file, plain or gzipped."""
    return list(records(opened(data)))


def opened(data: bytes):
    return gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)


RECORD = "type string, record_id string, refers_to string, concurrent_to string, target_uri string, date string, content_type string, block_digest string, payload_digest string, block binary"


def responses_of(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = EPOCH) -> DataFrame:
    """Responses (key, record_id, target_uri, date, http_headers, payload) of fetched pages.

    The identifier comes from id, URL and payload, so a row that is repeated has the same one. Null URLs stay null, null pages are empty.
    """
    session(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("key"), F.col(url_col).cast("string").alias("target_uri"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"))

    def step(batch):
        keys, urls, pay = (batch.column(c).to_pylist() for c in ("key", "target_uri", "payload"))
        heads = [f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(p)}" for p in pay]
        ids = [record_id("response", str(k), u or "", hashlib.sha256(p).hexdigest()) for k, u, p in zip(keys, urls, pay)]
        return {"key": batch.column("key"), "record_id": ids, "target_uri": batch.column("target_uri"), "date": [date] * len(ids), "http_headers": heads, "payload": batch.column("payload")}

    return arrow_map(rows, "key long, record_id string, target_uri string, date string, http_headers string, payload binary", step, "payload")


def derive(responses: DataFrame) -> DataFrame:
    """Two records (``RECORD``) for each response: its metadata and its conversion, with the response's ``key`` where it has one.

    ``responses`` are those of ``responses_of`` or of ``read``, where other records than responses are passed over; other
    columns are ignored. A null payload is empty, null URLs, dates and headers stay null or give no lines, repeated rows give
    equal records.
    """
    key = ["key"] if "key" in responses.columns else []
    rows = responses.where("type = 'response'") if "type" in responses.columns else responses
    paid = F.col("payload_digest") if "payload_digest" in responses.columns else F.lit(None)
    rows = rows.select(*key, "record_id", "target_uri", "date", "http_headers", paid.cast("string").alias("payload_digest"), F.coalesce("payload", F.lit(b"")).alias("payload"))

    def step(batch):
        out = [{**{k: r[k] for k in key}, **d} for r in batch.to_pylist() for d in derivatives(r)]
        return {k: [x[k] for x in out] for k in out[0]}

    kinds = f"key {rows.schema['key'].dataType.simpleString()}, " if key else ""
    return arrow_map(rows, kinds + RECORD, step, "payload")


def write(records: DataFrame, path: str) -> None:
    """One gzip member for each record, rows of a partition in one text-free binary column: a Parquet table of WARC members that concatenate to WARC files."""

    def step(batch):
        return {"member": [gzip.compress(to_bytes(r), mtime=0) for r in batch.to_pylist()]}

    arrow_map(records, "member binary", step, "block").write.mode("error").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all WARC files under ``path`` (plain or gzipped), blocks and response payloads included.

    A file is one task's and at most 2 GB as it is stored; its records are read and handed on one after the other, so
    unpacked files may be of any size. Fields that a record lacks are null; records cut short end their file.
    """
    session(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    keys = [*(v for _, v in HEADERS), "block", "http_headers", "payload"]
    schema = RECORD + ", http_headers string, payload binary"
    kinds = {"block": pa.binary(), "payload": pa.binary()}

    def run(batches):
        emit = lambda out: pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in out], kinds.get(k, pa.string())) for k in order], names=order)
        for batch in batches:
            for data in batch.column("content"):
                out, size = [], 0
                for r in records(opened(data.as_py() or b"")):
                    out.append(r)
                    size += len(r["block"])
                    if size >= READ_BYTES:
                        yield emit(out)
                        out, size = [], 0
                if out:
                    yield emit(out)

    order = [f.split()[0] for f in schema.split(", ")]
    assert set(order) == set(keys)
    return files.mapInArrow(lean(run), schema)


def op2_warc(spark, sf_dir):
    """One row a derivative record of every page, its block as a digest."""
    records = derive(responses_of(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return records.select(F.col("key").alias("page_id"), "type", "record_id", "refers_to", "concurrent_to", "target_uri", "date", "content_type", "block_digest", "payload_digest", F.length("block").cast("long").alias("n_bytes"), F.sha2("block", 256).alias("block_sha256"))

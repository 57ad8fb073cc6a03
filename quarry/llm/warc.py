"""WARC derivative builder: metadata and plain-text conversion records from response records.

``responses`` writes pages as WARC/1.1 response records; ``derivatives`` reads response records (of these or any
other maker), checks their digests and builds for each a metadata record and a conversion record that refer to it.
Both keep the source's URI and date, its digests and its HTTP headers.  Record ids follow from the source's id, which
follows from page, URL and content, so a retried task makes the same records and two captures of a page differ.

Defined results: very long pages are converted whole, in time linear in their length; a null url or html counts as empty; repeated rows give equal records; a record that is not a
response, or does not parse, gives one row of type ``invalid`` with its reason; an empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL name space of RFC 4122

_SILENT = re.compile(r"<!--.*?(-->|\Z)|<(script|style|template|noscript)\b.*?(</\2\s*>|\Z)|<![^>]*+>", re.S | re.I)
_BREAK = re.compile(
    r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|head|header|hr|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>",
    re.I,
)
_TAG = re.compile(r"</?[a-zA-Z][^>]*>")


def digest(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def plain_text(html: str) -> str:
    """All visible text, one line per block."""
    last = html.rfind(">") + 1  # no tag ends beyond; what is tried there would be tried in vain
    parts, at, open_end = [], 0, False
    for m in _SILENT.finditer(html, 0, last):
        parts += [html[at : m.start()], " "]
        at = m.end()
        open_end = m[1] == "" or m[3] == ""  # a comment or element without an end takes all that follows
    tail = "" if open_end else html[last:].partition("<!--")[0]
    text = _TAG.sub("", _BREAK.sub("\n", "".join(parts) + html[at:last])) + tail
    lines = (" ".join(line.split()) for line in entities.unescape(text).split("\n"))
    return "\n".join(line for line in lines if line)


def build_record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), *headers, ("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """(headers, block); ValueError if the bytes aren't one record."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not mark or not first.startswith("WARC/"):
        raise ValueError("no WARC header")
    headers = [(k.strip(), v.strip()) for k, colon, v in (line.partition(":") for line in lines) if colon]
    length = next((v for k, v in headers if k.lower() == "content-length"), "")
    if not length.isdigit() or int(length) > len(rest):
        raise ValueError("wrong Content-Length")
    return headers, rest[: int(length)]


def _clean(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def response_record(page_id: int | None, url: str, html: str, date: str) -> bytes:
    payload = html.encode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    return build_record(
        "response",
        [
            ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id} {url} {digest(payload)}')}>"),
            ("WARC-Target-URI", _clean(url)),
            ("WARC-Date", date),
            ("Content-Type", "application/http; msgtype=response"),
            ("WARC-Payload-Digest", digest(payload)),
        ],
        block,
    )


def _http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    head, mark, payload = block.partition(b"\r\n\r\n")
    status, *lines = head.decode("iso-8859-1").split("\r\n")
    if not mark or not status.startswith("HTTP/"):
        raise ValueError("no HTTP response")
    return status, [(k.strip(), v.strip()) for k, colon, v in (line.partition(":") for line in lines) if colon], payload


def derive(raw: bytes) -> list[dict]:
    """The metadata and the conversion record of a response record, as rows."""
    headers, block = parse_record(raw)
    source = {k.lower(): v for k, v in headers}
    if source.get("warc-type") != "response":
        raise ValueError("not a response")
    status, http, payload = _http(block)
    for name, of in (("warc-block-digest", block), ("warc-payload-digest", payload)):
        if source.get(name, digest(of)) != digest(of):
            raise ValueError(f"{name} does not hold")
    kind = next((v for k, v in http if k.lower() == "content-type"), "")
    charset = m[1] if (m := re.search(r"charset=[\"']?([\w-]+)", kind)) else "utf-8"
    try:
        text = payload.decode(charset, "replace")
    except LookupError:
        text = payload.decode("utf-8", "replace")
    text = plain_text(text).encode("utf-8", "replace")
    origin = source.get("warc-record-id", "")
    linked = [("WARC-Refers-To", origin), ("WARC-Target-URI", source.get("warc-target-uri", "")), ("WARC-Date", source.get("warc-date", ""))]
    conversion_id = f"<urn:uuid:{uuid.uuid5(SPACE, origin + ' conversion')}>"
    metadata_id = f"<urn:uuid:{uuid.uuid5(SPACE, origin + ' metadata')}>"
    about = {
        "source-block-digest": digest(block),
        "source-payload-digest": digest(payload),
        "http-status": status,
        "http-headers": [list(x) for x in http],
        "source-headers": [list(x) for x in headers],
        "conversion": conversion_id,
    }
    built = []
    for name, record_id, content_type, body in (
        ("metadata", metadata_id, "application/json", json.dumps(about, ensure_ascii=False, sort_keys=True).encode()),
        ("conversion", conversion_id, "text/plain; charset=utf-8", text),
    ):
        record = build_record(
            name,
            [("WARC-Record-ID", record_id), *linked, ("Content-Type", content_type), ("WARC-Payload-Digest", digest(body)), ("WARC-Source-Payload-Digest", digest(payload))],
            body,
        )
        built.append(
            {
                "record_type": name, "record_id": record_id, "refers_to": origin, "target_uri": source.get("warc-target-uri", ""), "date": source.get("warc-date", ""),
                "content_type": content_type, "block_digest": digest(body), "source_payload_digest": digest(payload), "source_headers": json.dumps(headers, ensure_ascii=False),
                "content_length": len(body), "reason": None, "record": record,
            }
        )
    return built


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Rows (id, record): each page as a response record."""
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((url_col, "url"), (html_col, "html")))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                records = [response_record(*x, date) for x in zip(*(part.column(i).to_pylist() for i in range(3)))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(records, pa.binary())], ["id", "record"])

    return rows.mapInArrow(run, "id long, record binary")


DERIVED = (
    "id long, record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, block_digest string, "
    "source_payload_digest string, source_headers string, content_length long, reason string, record binary"
)


def derivatives(source: DataFrame) -> DataFrame:
    """For each response record of (id, record) its metadata and conversion records."""
    names = [f.split()[0] for f in DERIVED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.binary() if n == "record" else pa.int64() if n in ("id", "content_length") else pa.string() for n in names]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, rows = batch.slice(at, 256), []
                for i, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    try:
                        rows += [{"id": i} | r for r in derive(raw or b"")]
                    except ValueError as why:
                        rows.append({"id": i, "record_type": "invalid", "reason": str(why)})
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types)], names)

    return source.select(F.col("id").cast("long").alias("id"), "record").mapInArrow(run, DERIVED)


def op10_warc_derivatives(spark, sf_dir: str) -> DataFrame:
    made = derivatives(responses(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return made.withColumnRenamed("id", "page_id").withColumn("record_sha256", F.sha2("record", 256)).drop("record", "reason")

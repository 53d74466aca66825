"""WARC archives, and a converter from the legacy ARC format.

:func:`parse_arc` reads an ARC file by its version block, the header fields which that
version declares, and each record's declared length. :func:`to_warc` makes the equivalent WARC
record: an identifier derived from the record's key, the ARC date as a timestamp, a type
(response, or revisit with a reference where an earlier record holds the same payload)
and SHA-256 digests of block and payload. :func:`write_archive` writes records as gzip files
with Spark's text writer (every record ends in two line ends, which is its line separator),
:func:`read_archive` reads them back by the lengths that they declare.

Defined cases: a null html is an empty payload; a null url becomes ``unknown:``, white space in
one is percent-encoded; a null page_id gives a response of its own; rows that repeat a page_id are
all of that page's type; payloads under ``MIN_REVISIT`` bytes are always responses; extra columns
are left out. A long payload is held whole by the task that converts or reads it, never in parts.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dealt_join, shared_path, stored

MIN_REVISIT, RECORDS_PER_FILE = 100, 2000
END = b"\r\n\r\n"
#: The fields of ARC record headers by version, and the profile of revisits.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
KEY_HEADER = b"X-Source-Key"
#: Our own header fields of revisits: the key of the page whose record they refer to, and the bytes of the payload left out.
REFERS_FIELD, BYTES_FIELD = "X-Refers-To-Key", "X-Payload-Length"


@dataclass(frozen=True)
class ArcRecord:
    version: int
    fields: dict[str, str]
    block: bytes


def write_arc(version: int, name: str, rows: list[tuple[str, str, str, bytes]]) -> bytes:
    """An ARC file of rows (url, ip, 14-digit date, block)."""
    fields = ARC_FIELDS[version]
    about = f"{version} 0 tideline\n{' '.join(fields)}\n".encode()
    out = [_arc_header(version, f"filedesc://{name}", "0.0.0.0", "20240101000000", "text/plain", len(about), 0, name), about, b"\n"]
    at = sum(map(len, out))
    for url, ip, date, block in rows:
        head = _arc_header(version, url, ip, date, "text/html", len(block), at, name)
        out += [head, block, b"\n"]
        at += len(head) + len(block) + 1
    return b"".join(out)


def _arc_header(version: int, url: str, ip: str, date: str, kind: str, length: int, at: int, name: str) -> bytes:
    middle = "" if version == 1 else f" 200 - - {at} {name}"
    return f"{url} {ip} {date} {kind}{middle} {length}\n".encode()


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file behind its version block."""
    at, version = 0, 0
    while at < len(data):
        end = data.index(b"\n", at)
        line = data[at:end].decode()
        if not version:
            length = int(line.rsplit(" ", 1)[1])
            about = data[end + 1 : end + 1 + length].split(b"\n")
            version = int(about[0].split(b" ")[0])
            names = about[1].decode().split(" ")
            if names != ARC_FIELDS.get(version):
                raise ValueError(f"ARC version {version} with fields {names}")
        else:
            values = line.rsplit(" ", len(names) - 1)
            if len(values) != len(names):
                raise ValueError(f"not an ARC header: {line[:80]}")
            length = int(values[-1])
            yield ArcRecord(version, dict(zip(names, values)), data[end + 1 : end + 1 + length])
        if len(data) < end + 1 + length:
            raise ValueError("an ARC record is shorter than declared")
        at = end + 1 + length + 1


def record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(b'record:' + key.encode()).digest())}>"


def split_http(block: bytes) -> tuple[bytes, bytes]:
    head, _, payload = block.partition(END)
    return head, payload


def http_field(head: bytes, name: bytes) -> str:
    found = re.search(rb"(?im)^" + re.escape(name) + rb":[ \t]*([^\r\n]*)", head)
    return found[1].decode() if found else ""


def to_warc(arc: ArcRecord, first_key: str | None) -> bytes:
    """The WARC record of an ARC record, without the line ends behind it; a revisit if ``first_key`` names an earlier one."""
    f = arc.fields
    head, payload = split_http(arc.block)
    key = http_field(head, KEY_HEADER)
    date = datetime.strptime(f["Archive-date"], "%Y%m%d%H%M%S")
    block = arc.block if first_key is None else head + END
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if first_key is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(key) if key else f'<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, str(f) + hashlib.sha256(arc.block).hexdigest())}>'}",
        f"WARC-Date: {date:%Y-%m-%dT%H:%M:%SZ}", f"WARC-Target-URI: {f['URL']}", f"WARC-IP-Address: {f['IP-address']}",
        f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if first_key is not None:
        lines += [f"WARC-Refers-To: {record_id(first_key)}", f"WARC-Profile: {REVISIT_PROFILE}", f"{REFERS_FIELD}: {first_key}", f"{BYTES_FIELD}: {len(payload)}"]
    return "\r\n".join(lines).encode() + END + block


def _page_block(key: str, payload: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + KEY_HEADER + b": " + key.encode() + f"\r\nContent-Length: {len(payload)}".encode() + END + payload


def _converted(batches):
    """Pages (page_id, url, html, first) as ARC files, one of each version a batch, and these as WARC records."""
    start = datetime(2024, 1, 1, tzinfo=UTC)
    for b in batches:
        for at in range(0, b.num_rows, 200):
            rows = b.slice(at, 200).to_pylist()
            out = []
            for version in (1, 2):
                own = [r for r in rows if (r["page_id"] or 0) % 2 == version - 1]
                listed, firsts = [], {}
                for r in own:
                    key = "" if r["page_id"] is None else str(r["page_id"])
                    url = re.sub(r"\s", lambda m: "".join(f"%{x:02X}" for x in m[0].encode()), r["url"] or "") or "unknown:"
                    firsts[key] = None if r["first"] is None else str(r["first"])
                    date = start + timedelta(seconds=(r["page_id"] or 0) % 31_000_000)
                    listed.append((url, "192.0.2.1", f"{date:%Y%m%d%H%M%S}", _page_block(key, (r["html"] or "").encode())))
                for arc in parse_arc(write_arc(version, f"part-{at}.arc", listed)):
                    out.append(to_warc(arc, firsts[http_field(split_http(arc.block)[0], KEY_HEADER)]))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])


def write_archive(pages: DataFrame, path: str) -> None:
    """Archives of all pages under ``path``; equal payloads are stored once.

    Only pages whose payload another page repeats are joined with its first page, a hot payload's over several tasks."""
    p = pages.select(F.col("page_id").cast("long"), "url", "html", F.when(F.octet_length("html") >= MIN_REVISIT, F.unhex(F.sha2("html", 256))).alias("digest"))
    able = F.col("digest").isNotNull() & F.col("page_id").isNotNull()
    firsts = p.where(able).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = stored(firsts)
    first = F.when(F.col("first") < F.col("page_id"), F.col("first")).alias("first")
    large = dealt_join(p.where(able), firsts.drop("n"), ["digest"], "page_id", firsts, "left").select("page_id", "url", "html", first)
    small = p.where(~able).select("page_id", "url", "html", F.lit(None).cast("long").alias("first"))
    records = large.unionByName(small).mapInArrow(_converted, "record binary")
    text = records.select(F.col("record").cast("string").alias("value"))
    text.write.option("compression", "gzip").option("lineSep", END.decode()).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of every record."""
    at = 0
    while at < len(data):
        end = data.index(END, at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = int(fields["content-length"])
        block = data[end + 4 : end + 4 + length]
        if len(block) < length:
            raise ValueError("a WARC record is shorter than declared")
        yield fields, block
        at = end + 4 + length + 4


def _inflated(data: bytes) -> bytes:
    out = []
    while data:
        one = zlib.decompressobj(31)
        out.append(one.decompress(data) + one.flush())
        data = one.unused_data
    return b"".join(out)


_READ = pa.schema([("key", pa.string()), ("record_id", pa.string()), ("type", pa.string()), ("refers_to", pa.string()), ("refers_key", pa.string()), ("digest", pa.string()), ("bytes", pa.int64())])


def _records(batches):
    for b in batches:
        for content in b.column(0):
            rows = []
            for f, block in parse_warc(_inflated(content.as_py())):
                head, payload = split_http(block)
                declared = f["warc-payload-digest"].removeprefix("sha256:")
                whole = f["warc-type"] == "response"
                digest = hashlib.sha256(payload).hexdigest() if whole else declared
                if digest != declared:
                    raise ValueError(f"payload digest of {f['warc-record-id']}")
                rows.append((http_field(head, KEY_HEADER), f["warc-record-id"], f["warc-type"], f.get("warc-refers-to"), f.get(REFERS_FIELD.lower()), digest, len(payload) if whole else int(f.get(BYTES_FIELD.lower(), -1))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _READ)], schema=_READ)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """key, record_id, type, refers_to (a record_id), refers_key (a key), digest and bytes of the payload of every record; -1 bytes for revisits that don't tell."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(_records, "key string, record_id string, type string, refers_to string, refers_key string, digest string, bytes long")


def resolved(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to (a page_id), all from the records' own fields."""
    page = F.when(F.col("key") != "", F.col("key")).cast("long")
    return records.select(page.alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("refers_key").cast("long").alias("refers_to"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return resolved(read_archive(spark, path))


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
f AS (SELECT b, min(page_id) AS first FROM p WHERE octet_length(b) >= 100 GROUP BY b)
SELECT page_id, octet_length(p.b) AS payload_bytes, sha256(p.b) AS payload_digest,
  CASE WHEN f.first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN f.first < page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.b = f.b
"""

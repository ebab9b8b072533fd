"""Web archives: pages written as legacy ARC files, converted to WARC, and read back.

Method (legacy archive converter):

1. ``write_arc``: each page becomes an ARC record whose content is an HTTP
   response (status line, headers with ``X-Page-Id``, the html in UTF-8).
   Every file opens with its ``filedesc://`` version block.  Version 1 header
   lines are ``URL IP-address Archive-date Content-type Archive-length``;
   version 2 adds ``Result-code Checksum Location Offset Filename``.  Files are
   gzip text parts written by Spark, one per task.
2. ``read_arc``: the version block tells which header line to expect; each
   record is cut by its declared length (the last field, so URLs may hold
   spaces).  The payload is the HTTP body; its SHA-1 is taken here.
3. Revisits: of records with equal payloads of at least ``REVISIT_BYTES``
   bytes, the one with the largest page id (then file and offset) is the
   response; the others are revisits of it.  Payload heads are found by an
   aggregate (map-side combined), and joined back by ``keys.lookup``, which
   broadcasts the few hot payloads and shuffles the rest.
4. ``write_warc``: WARC/1.1 records are synthesised from the ARC ones: record
   id (a name-based UUID of file and offset), ``WARC-Date`` from the 14-digit
   archive date, type ``response`` or ``revisit`` (identical-payload-digest
   profile, ``WARC-Refers-To`` the response's id, headers only), payload and
   block digests as base-32 SHA-1.  Each file opens with a ``warcinfo`` record.
   ARC files are joined to their decisions by path, so the payloads travel
   compressed and no record is shuffled on its own.
5. ``read_warc``: records cut by ``Content-Length``; a response's payload
   digest is checked against its SHA-1, a revisit's page is linked to its
   response by record id (``keys.lookup`` again).

Defined cases: null html is an empty payload; null url is written ``-``;
null page ids stand below all others in the choice of the response; repeated
pages are records of their own (one of equal page ids is the response); very
long pages are records like any other (one task holds one file, itself one
input split); empty tables give no rows; extra columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mendframe.sources.workspace import Workspace

from . import keys

# fixed values: payload bound of revisits, archive date of the pages, field lines of the two ARC versions
REVISIT_BYTES = 1000
ARCHIVE_DATE = "20240101000000"
ARC_FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length",
              2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Archives are gzip text parts; the fastest zlib level, as both archives are written once and read a few times.
GZIP = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}

PARSED = ("path string, offset long, version int, url string, ip string, date string, page_id long, "
          "payload_bytes long, digest binary")


def http_response(page_id: int | None, html: str | None) -> bytes:
    body = (html or "").encode()
    head = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n"
            f"X-Page-Id: {'' if page_id is None else page_id}\r\n\r\n")
    return head.encode() + body


def split_http(block: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and body of an HTTP response block."""
    end = block.find(b"\r\n\r\n")
    head, body = (block, b"") if end < 0 else (block[:end], block[end + 4:])
    fields = {}
    for line in head.decode("latin-1").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields, body


def page_of(fields: dict[str, str]) -> int | None:
    v = fields.get("x-page-id", "")
    return int(v) if v else None


class ArcFile:
    """The text of one ARC file, record by record: its version block first, offsets counted as it goes."""

    def __init__(self, part: int, version: int = 1, date: str = ARCHIVE_DATE):
        self.name, self.version, self.date = f"part-{part:05d}.arc", version, date
        spec = f"{version} 0 mendframe\n{ARC_FIELDS[version]}\n"
        self.first = f"filedesc://{self.name} 0.0.0.0 {date} text/plain {len(spec.encode())}\n{spec}"
        self.offset = len(self.first.encode()) + 1

    def record(self, page_id: int | None, url: str | None, html: str | None) -> str:
        content = http_response(page_id, html)
        url = (url or "-").replace("\n", "%0A").replace("\r", "%0D")
        if self.version == 1:
            line = f"{url} 0.0.0.0 {self.date} text/html {len(content)}"
        else:
            line = f"{url} 0.0.0.0 {self.date} text/html 200 - - {self.offset} {self.name} {len(content)}"
        text = line + "\n" + content.decode()
        self.offset += len(text.encode()) + 1   # the writer's line end follows each record
        return text


def write_arc(pages: DataFrame, path: str, version: int = 1) -> None:
    """ARC files (gzip) of all pages, one per task, written batch by batch."""
    def run(batches):
        arc = ArcFile(TaskContext.get().partitionId(), version)
        yield pa.RecordBatch.from_arrays([pa.array([arc.first], pa.string())], names=["value"])
        for b in batches:
            rows = zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([arc.record(*r) for r in rows], pa.string())], names=["value"])

    (pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
     .mapInArrow(run, "value string").write.mode("overwrite").options(**GZIP).text(path))


def parse_arc(data: bytes):
    """(offset, version, url, ip, date, content) of each record of one ARC file."""
    pos, version = 0, 1
    while pos < len(data):
        end = data.index(b"\n", pos)
        line = data[pos:end].decode()
        if not line:
            pos = end + 1
            continue
        if line.startswith("filedesc://"):
            fields = line.split(" ")
            length = int(fields[-1])
            spec = data[end + 1:end + 1 + length].decode()
            version = int(spec.split(" ", 1)[0])
            pos = end + 1 + length + 1
            continue
        fields = line.rsplit(" ", 4 if version == 1 else 9)
        length = int(fields[-1])
        yield pos, version, fields[0], fields[1], fields[2], data[end + 1:end + 1 + length]
        pos = end + 1 + length + 1


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """One narrow row per ARC record, with the SHA-1 and size of its payload."""
    def run(batches):
        for b in batches:
            out = {k: [] for k in ("path", "offset", "version", "url", "ip", "date", "page_id", "payload_bytes", "digest")}
            for p, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for offset, version, url, ip, date, block in parse_arc(gzip.decompress(content)):
                    fields, body = split_http(block)
                    for k, v in zip(out, (p, offset, version, url, ip, date, page_of(fields), len(body), hashlib.sha1(body).digest()),
                                    strict=True):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([
                ("path", pa.string()), ("offset", pa.int64()), ("version", pa.int32()), ("url", pa.string()), ("ip", pa.string()),
                ("date", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("digest", pa.binary())]))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("path", "content").mapInArrow(run, PARSED)


def decide(records: DataFrame) -> DataFrame:
    """``records`` with ``record_type`` and, for revisits, the response's page id, path, offset, url and date."""
    order = F.struct(F.col("page_id"), F.col("path"), F.col("offset"))
    heads = (records.filter(F.col("payload_bytes") >= REVISIT_BYTES).groupBy("digest")
             .agg(F.max(F.struct(order.alias("o"), "url", "date")).alias("h"))
             .select("digest", F.col("h.o.page_id").alias("head_page"), F.col("h.o.path").alias("head_path"),
                     F.col("h.o.offset").alias("head_offset"), F.col("h.url").alias("head_url"), F.col("h.date").alias("head_date")))
    joined = keys.lookup(records, heads, "digest")
    revisit = F.col("head_path").isNotNull() & ~((F.col("head_path") == F.col("path")) & (F.col("head_offset") == F.col("offset")))
    return joined.withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))


def record_id(path: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{path}#{offset}')}>"


def warc_date(date: str) -> str:
    return f"{date[0:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def sha1_label(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_record(headers: list[tuple[str, str]], block: bytes) -> str:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    return head + block.decode() + "\r\n"   # the writer's line end closes the record with its second CRLF


def write_warc(spark: SparkSession, arc_path: str, decided: DataFrame, path: str) -> None:
    """WARC files from the ARC files and the decision of each record."""
    per_file = decided.groupBy("path").agg(F.collect_list(F.struct(
        "offset", "digest", "record_type", "head_path", "head_offset", "head_url", "head_date")).alias("decisions"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(arc_path).select("path", "content")

    def run(batches):
        part = TaskContext.get().partitionId()
        info = b"software: mendframe\r\nformat: WARC File Format 1.1\r\n"
        yield pa.RecordBatch.from_arrays([pa.array([warc_record(
            [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(f"warcinfo-{part}", 0)),
             ("WARC-Date", warc_date(ARCHIVE_DATE)), ("WARC-Filename", f"part-{part:05d}.warc.gz"),
             ("Content-Type", "application/warc-fields")], info)], pa.string())], names=["value"])
        for b in batches:
            out = []
            for p, content, decisions in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                by_offset = {d["offset"]: d for d in decisions}
                for offset, _, url, ip, date, block in parse_arc(gzip.decompress(content)):
                    d = by_offset[offset]
                    fields, body = split_http(block)
                    common = [("WARC-Record-ID", record_id(p, offset)), ("WARC-Date", warc_date(date)), ("WARC-Target-URI", url),
                              ("WARC-IP-Address", ip), ("Content-Type", "application/http; msgtype=response"),
                              ("WARC-Payload-Digest", "sha1:" + base64.b32encode(d["digest"]).decode())]
                    if d["record_type"] == "revisit":
                        head = block[:len(block) - len(body)]
                        out.append(warc_record(
                            [("WARC-Type", "revisit"), *common, ("WARC-Profile", REVISIT_PROFILE),
                             ("WARC-Refers-To", record_id(d["head_path"], d["head_offset"])),
                             ("WARC-Refers-To-Target-URI", d["head_url"]), ("WARC-Refers-To-Date", warc_date(d["head_date"])),
                             ("WARC-Block-Digest", sha1_label(head))], head))
                    else:
                        out.append(warc_record([("WARC-Type", "response"), *common, ("WARC-Block-Digest", sha1_label(block))], block))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    (files.join(per_file, "path").select("path", "content", "decisions").mapInArrow(run, "value string")
     .write.mode("overwrite").options(**GZIP).option("lineSep", "\r\n").text(path))


def parse_warc(data: bytes):
    """(headers, block) of each WARC record."""
    pos = 0
    while pos < len(data):
        end = data.index(b"\r\n\r\n", pos)
        lines = data[pos:end].decode().split("\r\n")
        assert lines[0].startswith("WARC/"), lines[0]
        headers = {}
        for line in lines[1:]:
            k, _, v = line.partition(":")
            headers[k.strip().lower()] = v.strip()
        length = int(headers["content-length"])
        yield headers, data[end + 4:end + 4 + length]
        pos = end + 4 + length + 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, page_id, payload_bytes, payload_digest, record_type, refers_record) of each response and revisit."""
    def run(batches):
        for b in batches:
            out = {k: [] for k in ("record_id", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_record")}
            for content in b.column(0).to_pylist():
                for h, block in parse_warc(gzip.decompress(content)):
                    kind = h["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    fields, body = split_http(block)
                    digest = base64.b32decode(h["warc-payload-digest"].split(":", 1)[1]).hex()
                    if kind == "response":
                        if hashlib.sha1(body).hexdigest() != digest:
                            raise ValueError(f"payload digest differs in {h['warc-record-id']}")
                        size = len(body)
                    else:
                        size = int(fields["content-length"])
                    for k, v in zip(out, (h["warc-record-id"], page_of(fields), size, digest, kind, h.get("warc-refers-to")),
                                    strict=True):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([
                ("record_id", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                ("record_type", pa.string()), ("refers_record", pa.string())]))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, "record_id string, page_id long, payload_bytes long, payload_digest string, "
                                 "record_type string, refers_record string")


def archive_round_trip(pages: DataFrame, work: Workspace, version: int = 1) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of all pages, as read from the WARC files."""
    spark = pages.sparkSession
    arc, warc = f"{work.path}/arc", f"{work.path}/warc"
    write_arc(pages, arc, version)
    decided = work.save(decide(read_arc(spark, arc)), "arc_decisions")
    write_warc(spark, arc, decided, warc)
    records = work.save(read_warc(spark, warc), "warc_records")
    responses = records.filter(F.col("record_type") == "response").select(
        F.col("record_id").alias("refers_record"), F.col("page_id").alias("refers_to"))
    linked = keys.lookup(records, responses, "refers_record")
    return linked.select("page_id", "payload_bytes", "payload_digest", "record_type",
                         F.when(F.col("record_type") == "revisit", F.col("refers_to")).alias("refers_to"))

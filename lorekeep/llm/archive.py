"""From legacy ARC archives to WARC, and back out of the WARC files.

`arc_files` packs pages into ARC files of either version (one header line a record, with the
declared length last). `parse_arc` reads the version block, then each record's line by that
version's field list and exactly the declared number of bytes. `to_records` turns them into WARC
records: the version block becomes a warcinfo record, each document a response with a record id
derived from URL, date and content, the date in ISO form, and the SHA-256 of its payload (what
follows the HTTP head). `write_warc` writes them: of records with equal payloads of at least 100
bytes the one with the smallest page_id is a response, the others are revisits without payload
that refer to it; smaller payloads are always responses. `read_warc` reads the files back.

A task packs records into files of about WARC_BYTES; a file is one row for Spark's text writer,
whose line separator is the two CR LF that end a WARC record, so files come from the committer, in
any store that Spark can write, and hold any bytes. Payloads move between tasks only if a filter of
bounded size says that they may have a twin. A revisit names the response it refers to by record
id, URI and date; it has no payload, so its size and digest are read back from its headers.

Defined results: a null html is an empty payload; blanks in URLs are escaped, a null URL becomes
`urn:unknown`; pages that repeat the smallest page_id of their payload are all responses; pages
without page_id are never referred to unless none of the group has one (then all are responses);
an empty table gives no files and no rows; extra columns, whatever their names, are ignored.
Payloads of up to 1 GB are kept whole (a record is one value, which Spark holds to 2 GB); an ARC
file is closed after about ARC_BYTES, a WARC file after about WARC_BYTES.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm.common import hot_keys, key_filter, maybe_in, skew_join, work_dir, written

ARC_BYTES = 4 << 20
#: Payload bytes from which equal payloads are stored once.
LEAST_SHARED = 100
WARC_BYTES = 16 << 20

#: The fields of a record line in the two versions of the ARC format.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = "type string, page_id long, uri string, date string, record_id string, head binary, payload binary, digest string, n_bytes long"


#: Blanks that a URL in a record line must not hold.
BLANKS = r"[\x20\x09-\x0D]+"


# -- ARC ---------------------------------------------------------------------------------------
def arc_head(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 corpus\n{' '.join(ARC_FIELDS[version])}\n".encode()
    rest = ["0.0.0.0", date, "text/plain", *(["200", "-", "-", "0", name] if version == 2 else []), str(len(body))]
    return f"filedesc://{name} {' '.join(rest)}\n".encode() + body + b"\n"


def arc_record(version: int, url: str, date: str, content: bytes, offset: int, name: str) -> bytes:
    middle = ["200", hashlib.md5(content).hexdigest(), "-", str(offset), name] if version == 2 else []
    return " ".join([url, "0.0.0.0", date, "text/html", *middle, str(len(content))]).encode() + b"\n" + content + b"\n"


def parse_arc(data: bytes) -> Iterator[dict]:
    """The records of an ARC file, the version block first (as `filedesc`)."""
    at, fields = 0, None
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        end = data.index(b"\n", at)
        line = data[at:end].decode().split(" ")
        size = int(line[-1])
        body = data[end + 1 : end + 1 + size]
        if len(body) < size:
            raise ValueError(f"record at byte {at} is shorter than its declared {size} bytes")
        if fields is None:
            if not line[0].startswith("filedesc://"):
                raise ValueError("an ARC file begins with its version block")
            version = int(body.split(b" ", 1)[0])
            fields = ARC_FIELDS[version]
        if len(line) != len(fields):
            raise ValueError(f"record line at byte {at} has {len(line)} fields, version {version} has {len(fields)}")
        yield dict(zip(fields, line, strict=True)) | {"version": version, "content": body, "filedesc": line[0].startswith("filedesc://")}
        at = end + 1 + size


#: Capture times begin at this second and repeat after so many.
FIRST_SECOND, PERIOD = 1_700_000_000, 100_000_000


def arc_date(page_id: int | None) -> str:
    """A 14-digit capture time; pages carry none, so it is counted from a fixed day."""
    return datetime.fromtimestamp(FIRST_SECOND + (page_id or 0) % PERIOD, UTC).strftime("%Y%m%d%H%M%S")


def arc_packer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task, n = TaskContext.get().partitionId(), 0
    parts: list[bytes] = []
    size = 0

    def closed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.large_binary()).cast(pa.binary())], names=["arc"])

    for b in batches:
        for i in range(b.num_rows):
            page, url, html = (b.column(c)[i].as_py() for c in ("page_id", "url", "html"))
            html = html or b""
            name, version = f"part-{task:05d}-{n:04d}.arc", 1 + (task + n) % 2
            if not parts:
                parts, size = [arc_head(version, name, arc_date(0))], 0
            mark = b"" if page is None else b"X-Page-Id: %d\r\n" % page
            content = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + mark + b"Content-Length: %d\r\n\r\n" % len(html) + html
            url = re.sub(BLANKS, "%20", (url or "").strip(" \t\n\v\f\r")) or "urn:unknown"
            parts.append(arc_record(version, url, arc_date(page), content, size, name))
            size += len(parts[-1])
            if size >= ARC_BYTES:
                yield closed()
                parts, size, n = [], 0, n + 1
    if parts:
        yield closed()


def arc_files(pages: DataFrame) -> DataFrame:
    """One row an ARC file: its bytes."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").cast("binary").alias("html"))
    return rows.mapInArrow(arc_packer, "arc binary")


# -- conversion --------------------------------------------------------------------------------
def http_parts(content: bytes) -> tuple[bytes, bytes]:
    cut = content.find(b"\r\n\r\n")
    return (b"", content) if cut < 0 or not content.startswith(b"HTTP/") else (content[: cut + 4], content[cut + 4 :])


def header_of(head: bytes, name: bytes) -> str | None:
    for line in head.split(b"\r\n"):
        k, _, v = line.partition(b":")
        if k.strip().lower() == name.lower():
            return v.strip().decode()
    return None


def converter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split(" ")[0] for c in RECORD_SCHEMA.split(", ")]
    for b in batches:
        for arc in b.column("arc").to_pylist():
            rows = []
            for r in parse_arc(arc):
                d = r["Archive-date"]
                date = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
                head, payload = (b"", r["content"]) if r["filedesc"] else http_parts(r["content"])
                digest = hashlib.sha256(payload).hexdigest()
                page = header_of(head, b"X-Page-Id")
                ident = uuid.UUID(bytes=hashlib.sha256(f"{r['URL']} {date} {page} {digest}".encode()).digest()[:16], version=5)
                rows.append(("warcinfo" if r["filedesc"] else "response", page and int(page), r["URL"], date, f"<urn:uuid:{ident}>", head, payload, digest, len(payload)))
            cols = list(zip(*rows, strict=True))
            types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.binary(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


def to_records(arcs: DataFrame) -> DataFrame:
    """WARC records of ARC files (arc): see RECORD_SCHEMA."""
    return arcs.mapInArrow(converter, RECORD_SCHEMA)


# -- WARC --------------------------------------------------------------------------------------
def shared_payloads(payloads: DataFrame) -> DataFrame:
    """(digest, first, first_uri, n): payloads that several rows (page_id, url, digest, n_bytes) hold, and the page that keeps them."""
    uri = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), f"^{BLANKS}|{BLANKS}$", ""), BLANKS, "%20")
    big = payloads.where(F.col("n_bytes") >= LEAST_SHARED).withColumn("uri", F.when(uri == "", "urn:unknown").otherwise(uri))
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "uri"))).alias("f")
    return big.groupBy("digest").agg(first, F.count("*").alias("n")).where("n > 1").select("digest", F.col("f.page_id").alias("first"), F.col("f.uri").alias("first_uri"), "n")


def record_date(page_id: Column) -> Column:
    """arc_date of a page in the form of WARC dates."""
    return F.date_format(F.timestamp_seconds(F.lit(FIRST_SECOND) + F.pmod(F.coalesce(page_id, F.lit(0)), F.lit(PERIOD))), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def record_id(uri: Column, date: Column, page_id: Column, digest: Column) -> Column:
    """The id that the converter gives to a record: a name-based UUID."""
    h = F.sha2(F.concat_ws(" ", uri, date, F.coalesce(page_id.cast("string"), F.lit("None")), digest), 256)
    part = lambda i, n: F.substring(h, i, n)
    variant = F.element_at(F.array(*map(F.lit, "89ab")), (F.conv(part(17, 1), 16, 10).cast("int") % 4) + 1)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12), F.lit(">"))


def with_revisits(records: DataFrame, shared: DataFrame) -> DataFrame:
    """records with `refers_to`, the page whose response holds the payload, and its uri (null: the record itself)."""
    seen = maybe_in(records, F.xxhash64("digest"), key_filter(shared, F.xxhash64("digest")))
    seen = seen.withColumnRenamed("_hit", "_maybe")
    some = skew_join(seen.where("_maybe"), shared.select("digest", "first", "first_uri"), ["digest"], F.col("record_id"), hot_keys(shared, ["digest"], "n"), "left").select(*seen.columns, "first", "first_uri")
    none = seen.where("not _maybe").withColumn("first", F.lit(None).cast("long")).withColumn("first_uri", F.lit(None).cast("string"))
    both = none.unionByName(some).drop("_maybe")
    other = (F.col("type") == "response") & (F.col("n_bytes") >= LEAST_SHARED) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return both.withColumn("refers_to", F.when(other, F.col("first"))).drop("first")


def warc_packer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records as files of about WARC_BYTES; the end of the last one is the writer's line separator."""
    parts: list[bytes] = []
    size = 0

    def closed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b"\r\n\r\n".join(parts)], pa.binary())], names=["file"])

    for b in batches:
        for record in b.column("record"):
            parts.append(record.as_py())
            size += len(parts[-1])
            if size >= WARC_BYTES:
                yield closed()
                parts, size = [], 0
    if parts:
        yield closed()


def write_warc(records: DataFrame, path: str) -> None:
    """records with refers_to and first_uri as WARC/1.1 files under path."""
    again = F.col("refers_to").isNotNull()
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))
    kind = F.when(again, "revisit").otherwise(F.col("type"))
    block = F.when(again, F.col("head")).otherwise(F.concat("head", "payload"))
    mime = F.when(F.col("type") == "warcinfo", "application/warc-fields").otherwise("application/http; msgtype=response")
    met = record_date(F.col("refers_to"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Date", F.col("date")),
        F.when(F.col("type") == "warcinfo", "").otherwise(line("WARC-Target-URI", F.col("uri"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("WARC-Profile", F.when(again, REVISIT_PROFILE)),
        line("WARC-Refers-To", F.when(again, record_id(F.col("first_uri"), met, F.col("refers_to"), F.col("digest")))),
        line("WARC-Refers-To-Target-URI", F.when(again, F.col("first_uri"))),
        line("WARC-Refers-To-Date", F.when(again, met)),
        line("X-Payload-Length", F.when(again, F.col("n_bytes"))),
        line("X-Page-Id", F.col("page_id")),
        line("X-Refers-To-Page-Id", F.col("refers_to")),
        line("Content-Type", mime),
        line("Content-Length", F.octet_length(block)),
        F.lit("\r\n"),
    )
    whole = records.select(F.concat(head.cast("binary"), block).alias("record")).mapInArrow(warc_packer, "file binary")
    whole.select(F.col("file").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", 1).text(path)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    """(headers with lower-case names, block) of each record."""
    view, at = memoryview(data), 0
    while at < len(data):
        cut = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:cut].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(fields["content-length"])
        block = view[cut + 4 : cut + 4 + size]
        if len(block) < size or data[cut + 4 + size : cut + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where it says")
        yield fields, block
        at = cut + 8 + size


READ_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, target_uri string, warc_date string, refers_to_record string"


def warc_reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split(" ")[0] for c in READ_SCHEMA.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
    for b in batches:
        for i in range(b.num_rows):
            rows = []
            for f, block in parse_warc(b.column("content")[i].as_py()):
                kind, said = f["warc-type"], f.get("warc-payload-digest", "").removeprefix("sha256:")
                if kind == "warcinfo":
                    continue
                if kind == "revisit":
                    size, digest = int(f["x-payload-length"]), said
                else:
                    _, payload = http_parts(bytes(block))
                    size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                    if digest != said:
                        raise ValueError(f"{f['warc-record-id']}: the payload does not match its digest")
                page, to = f.get("x-page-id"), f.get("x-refers-to-page-id")
                rows.append((page and int(page), size, digest, kind, to and int(to), f["warc-record-id"], f["warc-target-uri"], f["warc-date"], f.get("warc-refers-to")))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row a response or revisit record of the WARC files under path; digests are verified."""
    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return files.select("content").mapInArrow(warc_reader, READ_SCHEMA)


def pages_through_archives(pages: DataFrame) -> DataFrame:
    """pages packed as ARC, converted, written as WARC and read back: one row a page, see READ_SCHEMA."""
    spark = pages.sparkSession
    raw = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    small = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.sha2(raw, 256).alias("digest"), F.octet_length(raw).alias("n_bytes"))
    shared = written(shared_payloads(small), "shared")
    path = f"{work_dir(spark)}/warc"
    write_warc(with_revisits(to_records(arc_files(pages)), shared), path)
    return read_warc(spark, path)

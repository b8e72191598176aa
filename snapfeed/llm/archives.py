"""Legacy web archives (ARC) to WARC, and both formats read and written by Spark.

ARC: a file begins with a ``filedesc:`` record whose second line gives the
version; every record is a header line of space-separated fields (version 1:
URL, IP, date, content type, length; version 2: also result code, checksum,
location, offset and file name before the length), a newline, as many bytes as
the length says, and a newline. WARC 1.1: header lines, a blank line, as many
bytes as Content-Length says, two blank lines.

Writers are Spark's text writer: a record is one value and the format's end of
record is the line separator, so any store Spark can write to will do (gzip
codec: whole-file members). Readers scan lines (or blank-line separated parts)
in file order inside a task and put records together again by their declared
length, so payloads may hold any line or blank line; memory is one record.
A gzip file is not split; Spark would split a plain one of more than
``spark.sql.files.maxPartitionBytes``, so such a file is refused with an error.

Conversion: record ids are UUIDs made from MD5 of URL, date and payload
digest; dates become ISO 8601; the record type is ``response``, or ``revisit``
where a payload of at least ``min_bytes`` equals that of the record with the
largest page id (which alone is kept whole), or ``resource`` for a block that is
no HTTP response. Digests are SHA-1 of the payload. Blocks are carried as bytes
and written as they were: status, headers and any encoding stay.

Defined cases: null html is an empty payload; a null URL becomes ``-``; white
space in a URL is percent-encoded; a null page id stays null (and is smaller
than any other); rows that repeat the largest page id of a group are all
responses; a line that should be a header and isn't is skipped up to the next
header; a record cut short by the end of its file is dropped; an empty table
gives empty archives and no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, scratch_path, small, stored, table

MIN_BYTES = 1000
ARC_END, WARC_END = "\n", "\r\n\r\n"
FIRST_DATE = 1_577_836_800  # date given to pages, which have none: this many seconds, plus the page id

ARC_FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length",
              2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
ARC_SCHEMA = ("version int, url string, ip string, date string, mime string, status string, page_id long, "
              "payload_bytes long, payload_digest string, payload string")
WARC_SCHEMA = ("record_id string, record_type string, url string, date string, page_id long, payload_bytes long, "
               "payload_digest string, refers_to_id string, refers_to long, declared_digest string, payload string")


def http_block(page_id: Column, payload: Column) -> Column:
    """HTTP response head (its Content-Length also tells a revisit's payload size)."""
    return F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: "),
                    F.coalesce(page_id.cast("string"), F.lit("")), F.lit("\r\nContent-Length: "),
                    F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"))


def url_field(url: Column) -> Column:
    u = F.coalesce(F.nullif(url, F.lit("")), F.lit("-"))
    return F.when(u.rlike(r"\s"), F.regexp_replace(F.url_encode(u), r"\+", "%20")).otherwise(u)


def write_arc(pages: DataFrame, path: str, version: int = 1, codec: str | None = "gzip") -> None:
    """One ARC file per partition of ``pages`` (page_id, url, html)."""
    payload = F.coalesce("html", F.lit(""))
    block = F.concat(http_block(F.col("page_id"), payload), payload)
    date = F.date_format(F.timestamp_seconds(F.lit(FIRST_DATE) + F.coalesce("page_id", F.lit(0)) % F.lit(10 ** 9)), "yyyyMMddHHmmss")
    head = [url_field(F.col("url")), F.lit("0.0.0.0"), date, F.lit("text/html")]
    if version == 2:
        head += [F.lit("200"), F.md5(payload), F.lit("-"), F.lit("0"), F.lit("pages.arc")]
    head.append(F.octet_length("block").cast("string"))
    about = f"{version} 0 snapfeed\n{ARC_FIELDS[version]}\n"
    desc = f"filedesc://pages.arc 0.0.0.0 20200101000000 text/plain {'200 - - 0 pages.arc ' if version == 2 else ''}{len(about)}\n{about}\n"
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    out = (pages.select("page_id", "url", payload.alias("html"), block.alias("block"))
           .select(F.concat(F.when(first, F.lit(desc)).otherwise(F.lit("")), F.concat_ws(" ", *head), F.lit("\n"), F.col("block")).alias("value")))
    out.write.text(path, lineSep=ARC_END, **({"compression": codec} if codec else {}))


ARC_BLOCKS = ARC_SCHEMA.replace("payload string", "head_bytes int, block binary")


def _lines(spark: SparkSession, path: str, end: str) -> DataFrame:
    """A file's parts in order, each file read by one task."""
    most = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    split = (spark.read.format("binaryFile").load(path).select("path", "length")
             .where((F.col("length") > most) & ~F.lower("path").endswith(".gz")).limit(1).collect())
    if split:
        raise ValueError(f"{split[0]['path']} is not compressed and larger than spark.sql.files.maxPartitionBytes, so it would be split")
    return spark.read.text(path, lineSep=end).select("value", F.xxhash64(F.input_file_name()).alias("file"))


def _head(block: bytes) -> tuple[dict[str, str], bytes, str]:
    """HTTP header fields, payload, status code of a response block."""
    if not block.startswith(b"HTTP/"):
        return {}, block, ""
    head, _, payload = block.partition(b"\r\n\r\n")
    first, *rest = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in rest)}
    return fields, payload, (first.split(" ") + ["", ""])[1]


def _number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"-?\d{1,18}", text) else None


class Bytes:
    """A file's bytes from its parts in order; ``end`` stood between them."""

    def __init__(self, parts: Iterator[bytes], end: bytes):
        self.parts, self.end, self.held, self.size = iter(parts), end, [], 0

    def more(self) -> bool:
        part = next(self.parts, None)
        if part is not None:
            self.held += [part, self.end]
            self.size += len(part) + len(self.end)
        return part is not None

    def take(self, n: int) -> bytes | None:
        """The next n bytes; None if the file ends before."""
        while self.size < n:
            if not self.more():
                return None
        data = b"".join(self.held)
        self.held, self.size = [data[n:]], len(data) - n
        return data[:n]

    def until(self, mark: bytes) -> bytes | None:
        """What lies before the next ``mark``, which is passed over; None at the end."""
        while True:
            data = b"".join(self.held)
            self.held = [data]
            at = data.find(mark)
            if at >= 0:
                self.take(at + len(mark))
                return data[:at]
            if not self.more():
                return None


def arc_records(lines: Iterator[bytes]) -> Iterator[dict]:
    """Records of a file's ARC lines. The version is that of its first record; a
    header line has that version's number of fields, a date and a length."""
    data, version = Bytes(lines, b"\n"), 0
    while (line := data.until(b"\n")) is not None:
        head = line.split(b" ")
        v = {5: 1, 10: 2}.get(len(head))
        if v is None or version not in (0, v) or not head[-1].isdigit() or not head[2].isdigit():
            continue
        block = data.take(int(head[-1]))
        if block is None:
            return
        version = v
        if head[0].startswith(b"filedesc:"):
            continue
        text = [f.decode("utf-8", "replace") for f in head]
        http, payload, status = _head(block)
        yield {"block": block, "head_bytes": len(block) - len(payload), "version": version, "url": text[0], "ip": text[1], "date": text[2], "mime": text[3],
               "status": text[4] if version == 2 else status, "page_id": _number(http.get("x-page-id")),
               "payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest(), "payload": payload}


def warc_records(parts: Iterator[bytes]) -> Iterator[dict]:
    """Records of a file's WARC parts (what lies between two CRLFs)."""
    data = Bytes(parts, b"\r\n\r\n")
    while (start := data.until(b"\r\n\r\n")) is not None:
        lines = start.strip(b"\r\n").decode("utf-8", "replace").split("\r\n")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = _number(head.get("content-length"))
        if not lines[0].startswith("WARC/") or length is None or length < 0:
            continue
        block = data.take(length)
        if block is None:
            return
        http, payload, _ = _head(block)
        revisit = head.get("warc-type") == "revisit"
        declared = head.get("warc-payload-digest", "").removeprefix("sha1:")
        size = _number(head.get("x-payload-bytes") or http.get("content-length")) if revisit else len(payload)
        yield {"record_id": head.get("warc-record-id", "").strip("<>"), "record_type": head.get("warc-type"),
               "url": head.get("warc-target-uri"), "date": head.get("warc-date"), "page_id": _number(http.get("x-page-id")),
               "payload_bytes": size, "payload_digest": declared if revisit else hashlib.sha1(payload).hexdigest(),
               "refers_to_id": head.get("warc-refers-to", "").strip("<>") or None,
               "refers_to": _number(head.get("x-refers-to-page-id")), "declared_digest": declared or None, "payload": payload}


def _reader(records: Callable, schema: str, with_payload: bool) -> Callable:
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [{"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]] for c in schema.split(", ")]
    carried = names[-1]

    def batch(rows: list[dict]) -> pa.RecordBatch:
        cols = [[r[n] for r in rows] for n in names]
        if carried == "payload":
            cols[-1] = [p.decode("utf-8", "replace") if with_payload else None for p in cols[-1]]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (p for b in batches for p in zip(b.column(1).to_pylist(), b.column(0).cast(pa.binary()).to_pylist()))
        rows, size = [], 0
        for _, own in groupby(parts, key=lambda p: p[0]):  # one file after the other
            for r in records(v for _, v in own):
                rows.append(r)
                size += len(r[carried]) if with_payload else 0
                if len(rows) >= 1000 or size > 4 << 20:
                    yield batch(rows)
                    rows, size = [], 0
        if rows:
            yield batch(rows)

    return run


def read_arc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    return _lines(spark, path, ARC_END).mapInArrow(_reader(arc_records, ARC_SCHEMA, with_payload), ARC_SCHEMA)


def read_arc_blocks(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_arc``, with each record's whole block as bytes and where its payload begins."""
    return _lines(spark, path, ARC_END).mapInArrow(_reader(arc_records, ARC_BLOCKS, True), ARC_BLOCKS)


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    return _lines(spark, path, WARC_END).mapInArrow(_reader(warc_records, WARC_SCHEMA, with_payload), WARC_SCHEMA)


def record_id(url: Column, date: Column, digest: Column, page_id: Column) -> Column:
    h = F.md5(F.concat_ws("|", url, date, digest, F.coalesce(page_id.cast("string"), F.lit(""))))
    return F.concat(F.lit("urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
                                          for x in (F.lit("-"), F.substring(h, a, n))][1:])


def revisits(heads: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Page ids (with digest) that revisit another, from narrow rows: the largest
    page id per digest is a map-side combined aggregate, stored before it is
    joined back, so that a digest with very many records can be split."""
    long_ = heads.where(F.col("payload_bytes") >= min_bytes)
    iso = iso_date(F.col("date"))
    keep = (long_.groupBy("payload_digest")
            .agg(F.max(F.struct("page_id", "url", iso.alias("iso"))).alias("k"), F.count(F.lit(1)).alias("n"))
            .where("n > 1")
            .select("payload_digest", F.col("k.page_id").alias("refers_to"), F.col("k.url").alias("refers_url"),
                    F.col("k.iso").alias("refers_iso"),
                    record_id(F.col("k.url"), F.col("k.iso"), F.col("payload_digest"), F.col("k.page_id")).alias("refers_to_id")))
    keep = stored(keep, "arc-keep")
    return (long_.select("page_id", "payload_digest").join(small(keep), "payload_digest")
            .where("refers_to IS NOT NULL AND NOT page_id <=> refers_to").distinct())


def iso_date(date: Column) -> Column:
    return F.date_format(F.try_to_timestamp(date, F.lit("yyyyMMddHHmmss")), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def arc_to_warc(records: DataFrame, again: DataFrame) -> DataFrame:
    """WARC records (column ``value``) of ARC records with their blocks; ``again``
    from ``revisits``. Bytes that are no UTF-8 pass through as they are."""
    again = again.withColumnsRenamed({"page_id": "_p", "payload_digest": "_d"})
    r = records.join(small(again), F.expr("page_id <=> _p AND payload_digest = _d"), "left")
    revisit = F.col("_d").isNotNull()
    iso = F.coalesce(iso_date(F.col("date")), F.lit("1970-01-01T00:00:00Z"))
    block = F.when(revisit, F.substring("block", F.lit(1), F.col("head_bytes"))).otherwise(F.col("block"))
    web = F.col("head_bytes") > 0
    kind = F.when(revisit, F.lit("revisit")).when(web, F.lit("response")).otherwise(F.lit("resource"))
    line = lambda name, value: F.concat(F.lit(f"\r\n{name}: "), value)
    refers = F.concat(line("WARC-Refers-To", F.concat(F.lit("<"), F.col("refers_to_id"), F.lit(">"))),
                      line("WARC-Refers-To-Target-URI", F.col("refers_url")), line("WARC-Refers-To-Date", F.col("refers_iso")),
                      F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                      line("X-Refers-To-Page-Id", F.col("refers_to").cast("string")), line("X-Payload-Bytes", F.col("payload_bytes").cast("string")))
    return r.select(F.concat(
        F.lit("WARC/1.1"), line("WARC-Type", kind),
        line("WARC-Record-ID", F.concat(F.lit("<"), record_id(F.col("url"), iso, F.col("payload_digest"), F.col("page_id")), F.lit(">"))),
        line("WARC-Date", iso), line("WARC-Target-URI", F.col("url")), line("WARC-IP-Address", F.col("ip")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, refers).otherwise(F.lit("")),
        line("Content-Type", F.when(revisit | web, F.lit("application/http; msgtype=response")).otherwise(F.col("mime"))),
        line("Content-Length", F.octet_length(block).cast("string")), F.lit(WARC_END), block.cast("string")).alias("value"))


def convert(spark: SparkSession, arc: str, warc: str, min_bytes: int = MIN_BYTES, codec: str | None = "gzip") -> None:
    """The ARC files under ``arc`` written as WARC files under ``warc``."""
    heads = stored(read_arc(spark, arc, with_payload=False).select("url", "date", "page_id", "payload_bytes", "payload_digest"), "arc-heads")
    again = stored(revisits(heads, min_bytes), "arc-revisits")
    (arc_to_warc(read_arc_blocks(spark, arc), again)
     .write.text(warc, lineSep=WARC_END, **({"compression": codec} if codec else {})))


def op8_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    odd = F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(2)) == 1
    write_arc(pages.where(~odd), f"{arc}/v1", 1)
    write_arc(pages.where(odd), f"{arc}/v2", 2)
    convert(spark, f"{arc}/*", warc)
    return read_warc(spark, warc, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM m
"""

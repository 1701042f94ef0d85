"""Legacy archive converter: ARC files to WARC records, and WARC files out and in.

An ARC file starts with a version block whose header line is ``filedesc://...``; its body names
the version and the fields of the header lines that follow: five in version 1, ten in version
2. A record is a header line, a body of exactly the declared length, and a line feed. For each
the converter makes the WARC record that says the same: an identifier derived from URI, date
and content, the date as a timestamp, a type (response for HTTP, resource for other content,
warcinfo for the version block) and SHA-256 digests of payload and block.

Archives are written by Spark's own text writer, whose rows are whole records and whose line
separator is what ends a record, gzipped as a stream; they are read as binary files. So
executors only use the shared folder. A file holds at most ``FILE_RECORDS`` records.

Edge cases: null contents are empty; white space and control characters of a URL are
percent-encoded, a null or empty one becomes ``unknown:``; payloads of less than ``LEAST_BYTES``
are never revisits; rows that tie for the smallest id of equal payloads are all responses; a
null id comes after all others; a declared length beyond the end of a file gives a record that
is marked truncated; unreadable header lines are skipped up to the next readable one; other
columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowloom.llm import scratch

#: Fixed values of the two formats: fields of a header line, by version.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARC_END, WARC_END = "\n", "\r\n\r\n"
#: Smallest payload that a revisit record may stand for.
LEAST_BYTES = 100
FILE_RECORDS = 2048
BATCH_BYTES = 4 << 20
#: Date of the first page; each page id is a second later, over a year.
FIRST_DATE = 1_704_067_200

CONVERTED = (
    "record_id string, record_type string, uri string, ip string, warc_date string, content_type string, arc_version int, "
    "head binary, payload binary, payload_bytes long, payload_digest string, block_digest string, truncated boolean"
)
READ = (
    "record_id string, record_type string, refers_to string, uri string, warc_date string, head binary, payload_bytes long, payload_digest string, digest_holds boolean"
)


# ---------------------------------------------------------------- pages to ARC


def arc_records(pages: DataFrame) -> DataFrame:
    """One text per page (page_id, url, html): its ARC record, after a version block where a file begins.

    Files alternate between version 1 and version 2. Pages become HTTP responses that carry
    their id and length.
    """
    n = F.monotonically_increasing_id()
    rows = pages.select(
        F.shiftright(n, 33).alias("part"),
        n.bitwiseAND((1 << 33) - 1).alias("nth"),
        F.col("page_id"),
        F.coalesce(F.nullif(F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20"), F.lit("")), F.lit("unknown:")).alias("url"),
        F.coalesce("html", F.lit("")).alias("html"),
    )
    version = 1 + (F.col("part") + F.floor(F.col("nth") / FILE_RECORDS)) % 2
    name = F.concat(F.lit("part-"), F.col("part"), F.lit("-"), F.floor(F.col("nth") / FILE_RECORDS), F.lit(".arc"))
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: "),
        F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit("\r\nContent-Length: "),
        F.octet_length("html").cast("string"),
        F.lit("\r\n\r\n"),
    )
    when = F.date_format(F.timestamp_seconds(FIRST_DATE + F.pmod(F.coalesce(F.col("page_id"), F.lit(0)), F.lit(31_536_000))), "yyyyMMddHHmmss")
    rows = rows.withColumns({"version": version, "name": name, "head": head, "date": when})
    size = (F.octet_length("head") + F.octet_length("html")).cast("string")
    v1 = F.concat_ws(" ", "url", F.lit("0.0.0.0"), "date", F.lit("text/html"), size)
    v2 = F.concat_ws(" ", "url", F.lit("0.0.0.0"), "date", F.lit("text/html"), F.lit("200"), F.lit("-"), F.lit("-"), F.lit("0"), "name", size)

    def block(v: int) -> Column:
        body = f"{v} 0 flowloom\n{ARC_FIELDS[v]}\n"
        middle = " 200 - - 0 " if v == 2 else " "
        more = F.concat(F.lit(middle), F.col("name"), F.lit(" ")) if v == 2 else F.lit(middle)
        return F.concat(F.lit("filedesc://"), F.col("name"), F.lit(" 0.0.0.0 20240101000000 text/plain"), more, F.lit(f"{len(body)}\n{body}\n"))

    opening = F.when(F.col("nth") % FILE_RECORDS != 0, "").when(F.col("version") == 1, block(1)).otherwise(block(2))
    return rows.select(F.concat(opening, F.when(F.col("version") == 1, v1).otherwise(v2), F.lit("\n"), "head", "html").alias("value"))


def write_records(records: DataFrame, path: str, end: str) -> None:
    """Write one-column rows of whole records to gzipped files."""
    records.write.option("lineSep", end).option("maxRecordsPerFile", FILE_RECORDS).option("compression", "gzip").text(path)


# ---------------------------------------------------------------- parsing


def inflate(data: bytes) -> bytes:
    """The content of a file of gzip members; other files as they are."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:
        one = zlib.decompressobj(31)
        out.append(one.decompress(data))
        out.append(one.flush())
        data = one.unused_data
    return b"".join(out)


def parse_arc(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes, bool]]:
    """(version, header fields, body, truncated) of each record of an ARC file."""
    version, at = 1, 0
    while at < len(data):
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        line, at = data[at:end].rstrip(b"\r"), end + 1
        fields = _arc_header(line, version)
        if fields is None:
            continue
        size = int(fields["Archive-length"])
        body = data[at : at + size]
        if fields["URL"].startswith("filedesc://"):
            said = body.split(b" ", 1)[0]
            version = int(said) if said in (b"1", b"2") else version
        yield version, fields, body, len(body) < size
        at += size


def _arc_header(line: bytes, version: int) -> dict[str, str] | None:
    """The fields of a header line: as many as its version has, counted from the end.

    The version block of a file comes before its version is known, so there either will do.
    """
    words = line.decode("utf-8", "replace").split(" ")
    for v in (2, 1) if line.startswith(b"filedesc://") else (version,):
        names = ARC_FIELDS[v].split(" ")
        if len(words) >= len(names) and words[-1].isascii() and words[-1].isdigit():
            rest = words[len(words) - len(names) + 1 :]
            found = dict(zip(names, [" ".join(words[: len(words) - len(rest)]), *rest], strict=True))
            if re.fullmatch(r"\d{14}", found["Archive-date"]):
                return found
    return None


def identifier(*parts: bytes) -> str:
    """A URN that depends on the parts alone."""
    x = bytearray(hashlib.sha256(b"\x00".join(parts)).digest()[:16])
    x[6], x[8] = x[6] & 0x0F | 0x80, x[8] & 0x3F | 0x80  # a custom UUID (version 8)
    h = x.hex()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def convert(version: int, fields: dict[str, str], body: bytes, truncated: bool) -> tuple:
    """The row of CONVERTED for an ARC record."""
    date = fields["Archive-date"]
    stamp = f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:]}Z"
    block = hashlib.sha256(body).hexdigest()
    kind, head, payload = "resource", b"", body
    if fields["URL"].startswith("filedesc://"):
        kind = "warcinfo"
    elif body.startswith(b"HTTP/") and (cut := body.find(b"\r\n\r\n")) >= 0:
        kind, head, payload = "response", body[: cut + 4], body[cut + 4 :]
    name = identifier(fields["URL"].encode(), date.encode(), block.encode())
    return (
        name, kind, fields["URL"], fields["IP-address"], stamp, "application/http; msgtype=response" if kind == "response" else fields["Content-type"], version,
        head, payload, len(payload), hashlib.sha256(payload).hexdigest() if head else block, block, truncated,
    )


def _batches(rows: Iterator[tuple], schema: pa.Schema, weight: int | None) -> Iterator[pa.RecordBatch]:
    """Rows in batches, each of bounded size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + (len(row[weight]) if weight is not None else 0)
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}


def _schema(ddl: str, drop: tuple[str, ...] = ()) -> tuple[str, pa.Schema, list[int]]:
    fields = [x.split() for x in ddl.split(", ")]
    kept = [i for i, (n, _) in enumerate(fields) if n not in drop]
    return ", ".join(" ".join(fields[i]) for i in kept), pa.schema([(fields[i][0], _ARROW[fields[i][1]]) for i in kept]), kept


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")


def read_arc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """All records of the ARC files in a folder, converted (CONVERTED; without head and payload if not asked for)."""
    ddl, schema, kept = _schema(CONVERTED, () if payload else ("head", "payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for content in b.column(0):
                    for record in parse_arc(inflate(content.as_buffer().to_pybytes())):
                        row = convert(*record)
                        yield tuple(row[i] for i in kept)

        yield from _batches(rows(), schema, kept.index(8) if payload else None)

    return _files(spark, path).mapInArrow(run, ddl)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-case name, block) of each record of a WARC file."""
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(fields.get("content-length", 0))
        yield fields, data[end + 4 : end + 4 + size]
        at = end + 4 + size


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """All records of the WARC files in a folder (READ). Of a revisit, size and digest are those of the payload it stands for."""
    ddl, schema, _ = _schema(READ)

    def row(fields: dict[str, str], block: bytes) -> tuple:
        kind, head, payload = fields.get("warc-type"), b"", block
        if fields.get("content-type", "").startswith("application/http") and (cut := block.find(b"\r\n\r\n")) >= 0:
            head, payload = block[: cut + 4], block[cut + 4 :]
        said = fields.get("warc-payload-digest", "").removeprefix("sha256:")
        if kind == "revisit":
            length = re.search(rb"\r\nContent-Length: (\d+)\r\n", head)
            size, digest = int(length[1]) if length else None, said
        else:
            size, digest = len(payload), hashlib.sha256(payload).hexdigest()
        return fields.get("warc-record-id"), kind, fields.get("warc-refers-to"), fields.get("warc-target-uri"), fields.get("warc-date"), head, size, digest, not said or digest == said

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches((row(*r) for b in batches for content in b.column(0) for r in parse_warc(inflate(content.as_buffer().to_pybytes()))), schema, 5)

    return _files(spark, path).mapInArrow(run, ddl)


# ---------------------------------------------------------------- converted records to WARC


def page_id(head: Column) -> Column:
    """The id that an HTTP head carries."""
    return F.expr("try_cast(nullif(regexp_extract(cast(%s as string), 'X-Page-Id: (-?[0-9]+)', 1), '') as long)" % head)


def warc_records(converted: DataFrame, index: DataFrame) -> DataFrame:
    """One text per converted record: its WARC record; a repeated payload becomes a revisit.

    index: record_id, page_id, uri, warc_date, payload_bytes, payload_digest of all responses.
    """
    large = index.where(F.col("payload_bytes") >= LEAST_BYTES)
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "record_id", "uri", "warc_date")).alias("first")
    repeated = scratch.keep(large.groupBy("payload_digest").agg(first, F.count("*").alias("n")).where("n > 1").drop("n"), "repeated")
    rows = converted.join(scratch.small(repeated, 20_000), "payload_digest", "left").withColumn("page_id", page_id("head"))
    later = (F.col("record_type") == "response") & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    rows = rows.withColumn("later", F.coalesce(later, F.lit(False)))
    block = F.when(F.col("later"), F.col("head")).otherwise(F.concat("head", "payload"))
    rows = rows.withColumn("block", block)

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    def of_first(name: str) -> Column:
        return F.when(F.col("later"), F.col(f"first.{name}"))

    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(F.col("later"), "revisit").otherwise(F.col("record_type"))),
        line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Date", F.col("warc_date")),
        line("WARC-Target-URI", F.when(F.col("record_type") != "warcinfo", F.col("uri"))),
        line("WARC-IP-Address", F.when(F.col("record_type") != "warcinfo", F.col("ip"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
        line("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.when(F.col("later"), F.sha2("block", 256)).otherwise(F.col("block_digest")))),
        line("WARC-Truncated", F.when(F.col("truncated"), "length")),
        line("WARC-Profile", F.when(F.col("later"), REVISIT_PROFILE)),
        line("WARC-Refers-To", of_first("record_id")),
        line("WARC-Refers-To-Target-URI", of_first("uri")),
        line("WARC-Refers-To-Date", of_first("warc_date")),
        line("Content-Type", F.col("content_type")),
        line("Content-Length", F.octet_length("block").cast("string")),
        F.lit("\r\n"),
    )
    return rows.select(F.concat(header.cast("binary"), "block").cast("string").alias("value"))


def archive_pages(pages: DataFrame) -> tuple[str, str]:
    """Pages to ARC files, those to WARC files; returns the two folders."""
    spark = pages.sparkSession
    arc, warc = scratch.new_path(spark, "arc"), scratch.new_path(spark, "warc")
    write_records(arc_records(pages), arc, ARC_END)
    convert_folder(spark, arc, warc)
    return arc, warc


def convert_folder(spark: SparkSession, arc: str, warc: str) -> None:
    """The ARC files of a folder to WARC files in another."""
    converted = read_arc(spark, arc)
    index = converted.where("record_type = 'response'").select("record_id", page_id("head").alias("page_id"), "uri", "warc_date", "payload_bytes", "payload_digest")
    write_records(warc_records(converted, scratch.keep(index, "arc-index")), warc, WARC_END)


def page_rows(spark: SparkSession, warc: str) -> DataFrame:
    """Of each page in WARC files: page_id, payload_bytes, payload_digest, record_type, refers_to (a page_id), digest_holds."""
    read = read_warc(spark, warc).where("record_type in ('response', 'revisit')")
    read = scratch.keep(read.select("record_id", page_id("head").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").alias("refers_id"), "digest_holds"), "warc-index")
    wanted = read.where("refers_id is not null").select(F.col("refers_id").alias("record_id")).distinct()
    named = read.where("record_type = 'response'").join(wanted, "record_id", "left_semi").groupBy("record_id").agg(F.min("page_id").alias("refers_to"))
    named = named.select(F.col("record_id").alias("refers_id"), "refers_to")
    return read.join(named, "refers_id", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_holds")

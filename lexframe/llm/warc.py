"""Legacy archive converter: ARC files (versions 1 and 2) to WARC files, and readers of both.

An ARC file is a sequence of version blocks and records. A version block names the header's fields in its third line; the
headers that follow it are parsed by those fields, whatever the version, and each payload is taken by its declared length.
The converter synthesises for each record what WARC asks for: an identifier derived from the record's content and place, an
ISO timestamp from the 14 digits, the record type, and block and payload digests.

Equal payloads are found by digest: counts and smallest ids per digest are pre-aggregated, and only digests that occur more
than once are joined back, so the pages of a huge group of copies are never gathered. Files are written by Spark's text
writer, whose line separator closes each record: any file system that Spark knows will do, and a lost task is written again.
A writer's row holds whole records up to about SEGMENT bytes, and a file holds FILE_ROWS such rows. Files are read whole, so a
file of over 2 GB must be cut before; contents are never shuffled.

A header that does not fit the version block, a length that is no number, and a payload that ends early give an error row of
read_arc() each; reading goes on at the next line that is a header. convert() leaves them out. A WARC file that is cut, no WARC
file or no whole gzip stream gives one error row of read_warc() after its records up to there (of a wrong gzip stream, up to the
read of some KB that fails), as what follows has no known place.

Defined cases: a null html is an empty payload; a null url is written as "-"; ids are written in decimal, and a null id as
"-", read back as null; repeated rows with one id are records of their own; ties of equal payloads go to the smallest id; an
empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import cut

SEGMENT, FILE_ROWS, LISTED = 4 << 20, 16, 1 << 20
CRLF = b"\r\n"
#: The record header fields of the two ARC versions.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _segments(records, head: bytes, between: bytes):
    """Join records to rows of about SEGMENT bytes; each row begins with head."""
    rows, held = [], 0
    for r in records:
        rows.append(r)
        held += len(r)
        if held >= SEGMENT:
            yield head + between.join(rows)
            rows, held = [], 0
    if rows:
        yield head + between.join(rows)


def _write(rows: DataFrame, path: str, separator: str) -> None:
    """rows: one binary column. The text writer takes bytes as they are."""
    out = rows.select(F.col("data").cast("string").alias("value")).write.option("lineSep", separator).option("maxRecordsPerFile", FILE_ROWS)
    out.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").mode("append").text(path)


def version_block(version: int) -> bytes:
    body = f"{version} 0 lexframe\n{ARC_FIELDS[version]}\n".encode()
    name, date = "filedesc://segment.arc", "20000101000000"
    fields = {1: f"{name} 0.0.0.0 {date} text/plain", 2: f"{name} 0.0.0.0 {date} text/plain 200 - - 0 segment.arc"}[version]
    return f"{fields} {len(body)}\n".encode() + body + b"\n"


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url: str = "url", html: str = "html", version: int = 1) -> None:
    """pages as ARC files, gzipped. The payload follows an HTTP head that carries its length and the page's id."""
    cols = pages.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{url}`").alias("url"), F.encode(F.coalesce(F.col(f"`{html}`"), F.lit("")), "UTF-8").alias("body"))

    def records(batches):
        for batch in batches:
            for id_, url_, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                body = body.as_py()
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\nX-Page-Id: {'-' if id_ is None else id_}\r\n\r\n".encode()
                place = re.sub(r"\s+", "%20", url_) if url_ else "-"
                middle = f"{place} 0.0.0.0 20000101000000 text/html"
                if version == 2:
                    middle += f" 200 {zlib.crc32(body):08x} - 0 segment.arc"
                yield f"{middle} {len(head) + len(body)}\n".encode() + head + body

    def run(batches):
        for data in _segments(records(batches), version_block(version), b"\n"):
            yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["data"])

    _write(cols.mapInArrow(run, "data binary"), path, "\n")


def _arc_header(line: bytes, names: list[str]) -> dict | None:
    """The fields of a record header by name, or None if the line is none: their number, date and length must be right."""
    parts = line.rstrip(b"\r\n").decode("utf-8", "replace").split(" ")
    if len(parts) > len(names):  # blanks inside the first field
        extra = len(parts) - len(names)
        parts = [" ".join(parts[: extra + 1]), *parts[extra + 1 :]]
    if len(parts) != len(names) or not re.fullmatch("[0-9]+", parts[-1]):
        return None
    fields = dict(zip(names, parts, strict=True))
    return fields if re.fullmatch("[0-9]{14}", fields["Archive-date"]) else None


def parse_arc(stream):
    """(fields, payload, error) of each record of an ARC stream; fields by the names of the version block in force. For what is
    no record, fields are None and error says why."""
    names: list[str] = []
    lost = False
    while line := stream.readline():
        if not line.strip():
            continue
        first = line.startswith(b"filedesc:")
        length = re.fullmatch(rb"[^\r\n]* ([0-9]+)\r?\n?", line) if first else None
        fields = _arc_header(line, names) if names and not first else None
        if not length and not fields:
            if not lost:  # the lines of a lost record give one error
                yield None, b"", f"{'not a header' if names or first else 'no version block before'}: {line[:200]!r}"
            lost = True
            continue
        size = int(length[1]) if first else int(fields["Archive-length"])
        payload = stream.read(size)
        if len(payload) < size:
            yield None, b"", f"a record declares {size} bytes, {len(payload)} are left: {line[:200]!r}"
            return
        lost = False
        if not first:
            yield fields, payload, None
            continue
        lines = payload.decode("utf-8", "replace").split("\n")
        names = lines[1].strip().split(" ") if len(lines) > 1 else []
        if lines[0].split(" ")[0] not in ("1", "2") or names[-1:] != ["Archive-length"] or "Archive-date" not in names:
            names = []
            yield None, b"", f"unknown version block: {payload[:200]!r}"


def _http(payload: bytes) -> tuple[bytes, bytes]:
    head, mark, body = payload.partition(b"\r\n\r\n")
    return (head + mark, body) if payload.startswith(b"HTTP/") and mark else (b"", payload)


def _header(head: bytes, name: str) -> str | None:
    m = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*([^\r\n]*)", head)
    return m[1].decode("utf-8", "replace").strip() if m else None


def _page_id(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"-?\d+", text) else None


def _files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def _each_file(batches):
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            data = content.as_py()
            yield path.as_py(), io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data))) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)


def _out(rows, schema: pa.Schema, limit: int = 4 << 20):
    """Record batches of dict rows, by about limit bytes of binary fields."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 100 + sum(len(v) for v in row.values() if isinstance(v, bytes))
        if size > limit:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


ARC_ROW = pa.schema([("file", pa.string()), ("place", pa.int64()), ("record_id", pa.string()), ("page_id", pa.int64()), ("uri", pa.string()), ("date", pa.string()), ("mime", pa.string()), ("http_head", pa.binary()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("error", pa.string())])
ARC_DDL = "file string, place bigint, record_id string, page_id bigint, uri string, date string, mime string, http_head binary, payload binary, payload_bytes bigint, payload_digest string, error string"


def _below(file: str, roots: list[str]) -> str:
    """The path of a file below the folder that was read, so that ids do not depend on where the folder lies."""
    bare = lambda p: re.sub(r"^[a-zA-Z][\w+.-]*:(//[^/]*)?", "", p)
    path = bare(file)
    for root in sorted((bare(r).rstrip("/") for r in roots), key=len, reverse=True):
        if path.startswith(f"{root}/"):
            return path[len(root) + 1 :]
    return path


def _arc_rows(file: str, name_of_file: str, stream, payloads: bool):
    for n, (fields, block, error) in enumerate(parse_arc(stream)):
        if error:
            yield {"file": file, "place": n, "error": error}
            continue
        head, body = _http(block)
        d, digest = fields["Archive-date"], base32_sha1(body)
        name = f"{name_of_file} {n} {fields['URL']} {d} {digest}"
        yield {
            "file": file, "place": n, "record_id": uuid.UUID(bytes=hashlib.sha1(name.encode()).digest()[:16], version=5).urn,
            "page_id": _page_id(_header(head, "X-Page-Id")), "uri": fields["URL"],
            "date": f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z", "mime": fields["Content-type"],
            "http_head": head if payloads else None, "payload": body if payloads else None, "payload_bytes": len(body), "payload_digest": digest,
        }


def read_arc(spark: SparkSession, path: str | list[str], payloads: bool = True) -> DataFrame:
    """The records of ARC files with the synthesised WARC identifier, timestamp and payload digest; file and place say where
    a record stands. error, where it is not null, says why there is no record."""

    roots = [path] if isinstance(path, str) else path

    def run(batches):
        yield from _out((r for file, stream in _each_file(batches) for r in _arc_rows(file, _below(file, roots), stream, payloads)), ARC_ROW)

    return _files(spark, path).mapInArrow(run, ARC_DDL)


def first_copies(records: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(payload_digest, payload_bytes, first_id, first_record) of the payloads of least_bytes or more that occur again."""
    known = records.where((F.col("payload_bytes") >= least_bytes) & F.col("page_id").isNotNull())
    first = known.groupBy("payload_digest", "payload_bytes").agg(F.count("*").alias("n"), F.min(F.struct("page_id", "record_id")).alias("first"))
    return first.where("n > 1").select("payload_digest", "payload_bytes", F.col("first.page_id").alias("first_id"), F.col("first.record_id").alias("first_record"))


def _warc_record(kind: str, r: dict, refers: str | None) -> bytes:
    head = r["http_head"] or b""
    block = head if kind == "revisit" else head + r["payload"]
    http = "application/http; msgtype=response" if head else r["mime"]
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{r['record_id']}>", f"WARC-Date: {r['date']}", f"WARC-Target-URI: {r['uri']}",
        f"WARC-Payload-Digest: sha1:{r['payload_digest']}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"Content-Type: {http}",
    ]
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block


def convert(spark: SparkSession, arc_path: str, warc_path: str, least_bytes: int = 0) -> None:
    """ARC files to gzipped WARC files. Of records with equal payloads of least_bytes or more, the one with the smallest id is
    a response and the others revisit it; all others are responses.

    Payloads are not shuffled: what a file's revisits refer to is joined to the file as a list. Error rows are left out.
    """
    digests = cut(read_arc(spark, arc_path, payloads=False).where("error IS NULL").select("file", "place", "record_id", "page_id", "payload_bytes", "payload_digest"), "digests")
    copies = cut(first_copies(digests, least_bytes), "copies")
    again = digests.join(copies, ["payload_digest", "payload_bytes"]).where("record_id <> first_record AND page_id IS NOT NULL")
    again = cut(again.select("file", "place", "first_record"), "again")
    # Lists are broadcast, so that no file's content moves: files are taken together up to LISTED records that revisit others.
    sizes = digests.groupBy("file").agg(F.count("*").alias("records")).orderBy("file").collect()
    groups, held = [[]], 0
    for r in sizes:
        if groups[-1] and held + r.records > LISTED:
            groups, held = [*groups, []], 0
        groups[-1].append(r.file)
        held += r.records

    def run(batches):
        def records():
            for batch in batches:
                refers = batch.column("refers").to_pylist()
                for i, (file, stream) in enumerate(_each_file([batch])):
                    known = dict(refers[i] or ())
                    for r in _arc_rows(file, _below(file, [arc_path]), stream, payloads=True):
                        if r.get("error"):
                            continue
                        first = known.get(r["place"])
                        yield _warc_record("revisit" if first else "response", r, first)

        for data in _segments(records(), b"", CRLF + CRLF):
            yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["data"])

    for names in groups:
        files = _files(spark, names if len(groups) > 1 else arc_path).withColumnRenamed("path", "file")
        mine = again if len(groups) == 1 else again.where(F.col("file").isin(names))
        lists = mine.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("place", "first_record"))).alias("refers"))
        _write(files.join(F.broadcast(lists), "file", "left").select("file", "content", "refers").mapInArrow(run, "data binary"), warc_path, "\r\n\r\n")


def parse_warc(stream):
    """(headers, block) of each record of a WARC stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC version line: {line[:200]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        length = int(headers["content-length"])
        block = stream.read(length)
        if len(block) < length:
            raise ValueError(f"a record declares {length} bytes, {len(block)} are left")
        yield headers, block


WARC_ROW = pa.schema([("file", pa.string()), ("place", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("uri", pa.string()), ("date", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to_record", pa.string()), ("intact", pa.bool_()), ("error", pa.string())])
WARC_DDL = "file string, place bigint, record_id string, record_type string, page_id bigint, uri string, date string, payload binary, payload_bytes bigint, payload_digest string, refers_to_record string, intact boolean, error string"


def _warc_row(h: dict, block: bytes, payloads: bool) -> dict:
    head, body = _http(block)
    revisit, said = h["warc-type"] == "revisit", h.get("warc-payload-digest", "").removeprefix("sha1:")
    digest = said if revisit else base32_sha1(body)
    return {
        "record_id": h["warc-record-id"].strip("<>"), "record_type": h["warc-type"], "page_id": _page_id(_header(head, "X-Page-Id")),
        "uri": h.get("warc-target-uri"), "date": h.get("warc-date"), "payload": None if revisit or not payloads else body,
        "payload_bytes": int(_header(head, "Content-Length") or 0) if revisit else len(body), "payload_digest": digest,
        "refers_to_record": h["warc-refers-to"].strip("<>") if "warc-refers-to" in h else None,
        "intact": digest == said and h.get("warc-block-digest") == f"sha1:{base32_sha1(block)}",
    }


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of WARC files; file and place say where a record stands. Digests are computed from what was read and held
    against the headers (intact); those of a revisit are of the payload that it refers to, as its headers declare them. error,
    where it is not null, says why the file is not read on."""

    def run(batches):
        def rows():
            for file, stream in _each_file(batches):
                n = 0
                try:
                    for h, block in parse_warc(stream):
                        yield {"file": file, "place": n, **_warc_row(h, block, payloads)}
                        n += 1
                except KeyError as e:
                    yield {"file": file, "place": n, "error": f"no header {e.args[0]}"}
                except (ValueError, EOFError, OSError, zlib.error) as e:  # what parse_warc() and gzip say of wrong bytes
                    yield {"file": file, "place": n, "error": str(e)}

        yield from _out(rows(), WARC_ROW)

    return _files(spark, path).mapInArrow(run, WARC_DDL)


def resolve(records: DataFrame) -> DataFrame:
    """records with refers_to, the page id of the record that a revisit refers to.

    Many revisits may refer to one record, so its side is reduced to the records referred to and written: both sides of the
    join are then plain scans, and Spark splits a skewed one.
    """
    wanted = records.where("refers_to_record IS NOT NULL").select(F.col("refers_to_record").alias("record_id")).distinct()
    targets = records.select("record_id", "page_id").join(wanted, "record_id", "left_semi").groupBy(F.col("record_id").alias("refers_to_record")).agg(F.min("page_id").alias("refers_to"))
    targets = cut(targets, "targets")  # one row for each id, whatever the archives hold
    return records.join(targets, "refers_to_record", "left")

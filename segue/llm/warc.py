"""Legacy web archives (ARC) to WARC, and both read back.

An ARC file starts with a version block; each record has one header line, whose fields depend on the version, and as
many bytes as the line declares. The converter parses those lines, and writes equivalent WARC records: identifiers
derived from url, date and block (uuid 5), timestamps in ISO 8601, types, and SHA-256 digests of block and payload. A record
whose payload is known to be stored elsewhere becomes a revisit record with its HTTP headers only.

Archives are files of one gzip member per record, in the folder that all executors share. A task writes a file of its
own under a new name; only the files named in the table that the job returns are read, so lost or repeated tasks do
no harm.

Defined results: a null html is the empty payload; a null url is written as `urn:page:` and the page's id. Blanks and
control characters in a url are percent-encoded, and the colon of `filedesc:`, which marks version blocks. Repeated rows are records of their own with one identifier, as they
are the same in all that an archive holds; of equal payloads of at least
SMALLEST bytes those with the smallest id are responses. Pages without an id are always responses. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segue.llm.common import new_path, written

#: Payloads below so many bytes are always stored in full.
SMALLEST = 100
#: Fixed values of the formats: the header fields of either ARC version in order, and the revisit profile.
ARC_FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "code", "checksum", "location", "offset", "filename", "length"),
}
ARC_NAMES = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
#: The first line of a version block: version, a reserved number, who wrote it.
VERSION_LINE = re.compile(rb"(\d+) \d+ [^\n]*\n")
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
FIRST_DATE = datetime(2000, 1, 1, tzinfo=timezone.utc)
#: Bytes of archive that are read at a time.
READ = 1 << 20


# -- ARC ---------------------------------------------------------------------------------------------------------


def arc_version_block(version: int, name: str = "arc") -> bytes:
    body = f"{version} 0 segue\n{ARC_NAMES[version]}\n".encode()
    fields = {"url": f"filedesc://{name}", "ip": "0.0.0.0", "date": "20000101000000", "type": "text/plain", "code": "200", "checksum": "-", "location": "-", "offset": "0", "filename": name, "length": str(len(body))}
    return (" ".join(fields[f] for f in ARC_FIELDS[version]) + "\n").encode() + body + b"\n"


def arc_record(version: int, url: str, date: str, block: bytes, name: str = "arc") -> bytes:
    fields = {"url": url, "ip": "0.0.0.0", "date": date, "type": "text/html", "code": "200", "checksum": "-", "location": "-", "offset": "0", "filename": name, "length": str(len(block))}
    return (" ".join(fields[f] for f in ARC_FIELDS[version]) + "\n").encode("utf-8", "surrogatepass") + block + b"\n"


class Source:
    """A stream of byte chunks that can be read by line and by length."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.held = chunks, bytearray()

    def _more(self) -> bool:
        for chunk in self.chunks:
            if chunk:
                self.held += chunk
                return True
        return False

    def line(self) -> bytes | None:
        """The next line without its end; None at the end of the stream."""
        start = 0
        while (at := self.held.find(b"\n", start)) < 0:
            start = len(self.held)
            if not self._more():
                if not self.held:
                    return None
                at = len(self.held)
                break
        out = bytes(self.held[:at])
        del self.held[: at + 1]
        return out.removesuffix(b"\r")

    def exactly(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._more():
                raise ValueError(f"archive ends {n - len(self.held)} bytes early")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def parse_arc(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of ARC data; the version block tells how its header lines are read."""
    source, fields = Source(chunks), None
    while (line := source.line()) is not None:
        if not line:
            continue
        parts = line.decode("utf-8", "surrogatepass").split(" ")
        if parts[0].startswith("filedesc://") and len(parts) in {len(x) for x in ARC_FIELDS.values()}:
            body = source.exactly(int(parts[-1]))
            if stated := VERSION_LINE.match(body):
                version = int(stated[1])
                if version not in ARC_FIELDS:
                    raise ValueError(f"unknown ARC version {version}")
                fields = ARC_FIELDS[version]
                continue
            if fields is not None and len(parts) == len(fields):  # a page of that scheme
                yield dict(zip(fields, parts)), body
                continue
        if fields is None or len(parts) != len(fields):
            raise ValueError(f"not an ARC header line: {line[:80]!r}")
        header = dict(zip(fields, parts))
        yield header, source.exactly(int(header["length"]))


# -- WARC --------------------------------------------------------------------------------------------------------


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP headers, with the empty line, and payload."""
    at = block.find(b"\r\n\r\n")
    return (b"", block) if at < 0 else (block[: at + 4], block[at + 4 :])


def record_id(url: str, date: str, block: bytes) -> str:
    name = f"{date} {hashlib.sha256(block).hexdigest()} {url}".encode("utf-8", "surrogatepass")
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def iso_date(date: str) -> str:
    """A 14-digit (or shorter) ARC date in ISO 8601."""
    full = (date + "00000101000000"[len(date) :])[:14]
    return datetime.strptime(full, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")


def warc_record(header: dict[str, str], block: bytes, stored_in: dict[str, str] | None = None) -> bytes:
    """The WARC record of an ARC record; with stored_in (url, date, id), a revisit of that record."""
    http, payload = split_http(block)
    lines = {"WARC-Type": "revisit" if stored_in else "response" if http.startswith(b"HTTP/") else "resource"}
    lines["WARC-Record-ID"] = record_id(header["url"], header["date"], block)
    lines["WARC-Date"] = iso_date(header["date"])
    lines["WARC-Target-URI"] = header["url"]
    lines["WARC-IP-Address"] = header["ip"]
    lines["WARC-Payload-Digest"] = "sha256:" + hashlib.sha256(payload).hexdigest()
    if stored_in:
        block = http
        lines["WARC-Profile"] = PROFILE
        lines["WARC-Refers-To"] = stored_in["id"]
        lines["WARC-Refers-To-Target-URI"] = stored_in["url"]
        lines["WARC-Refers-To-Date"] = iso_date(stored_in["date"])
    lines["WARC-Block-Digest"] = "sha256:" + hashlib.sha256(block).hexdigest()
    lines["Content-Type"] = "application/http; msgtype=response" if http.startswith(b"HTTP/") else header["type"]
    lines["Content-Length"] = str(len(block))
    head = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def gzip_member(raw: bytes) -> bytes:
    deflate = zlib.compressobj(1, zlib.DEFLATED, 31)
    return deflate.compress(raw) + deflate.flush()


def gunzip(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The content of any number of gzip members."""
    inflate = zlib.decompressobj(31)
    for chunk in chunks:
        while chunk:
            yield inflate.decompress(chunk)
            chunk = inflate.unused_data
            if inflate.eof:
                inflate = zlib.decompressobj(31)


def parse_warc(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of WARC data."""
    source = Source(chunks)
    while (line := source.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:80]!r}")
        header: dict[str, str] = {}
        while line := source.line():
            name, _, value = line.decode("utf-8", "surrogatepass").partition(":")
            header[name.strip().lower()] = value.strip()
        yield header, source.exactly(int(header["content-length"]))


# -- files in the shared folder ----------------------------------------------------------------------------------


def _place(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_archive(folder: str, records: Iterator[bytes]) -> tuple[str, int, int] | None:
    """A new gzip file in folder: its uri, records, bytes; None if there are no records."""
    first = next(records, None)
    if first is None:
        return None
    name = f"{uuid.uuid4().hex}.gz"
    store, path = _place(folder)
    store.create_dir(path, recursive=True)
    n = size = 0
    with store.open_output_stream(f"{path}/{name}", compression=None) as out:
        while first is not None:
            n, size = n + 1, size + len(first)
            out.write(gzip_member(first))
            first = next(records, None)
    return f"{folder}/{name}", n, size


def read_chunks(uri: str) -> Iterator[bytes]:
    store, path = _place(uri)
    with store.open_input_stream(path, compression=None) as stream:
        while chunk := stream.read(READ):
            yield chunk


def convert(arc: Iterator[bytes], stored: Iterator[dict[str, str] | None] | None = None) -> Iterator[bytes]:
    """ARC data to WARC records; stored says of each record in turn whether its payload is stored elsewhere."""
    for header, block in parse_arc(arc):
        yield warc_record(header, block, next(stored) if stored is not None else None)


def _converted(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            chunks = read_chunks(uri)
            if made := write_archive(folder, convert(gunzip(chunks) if uri.endswith(".gz") else chunks)):
                yield _manifest(made)


def _manifest(made: tuple[str, int, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x]) for x in made], names=["uri", "records", "bytes"])


MANIFEST = "uri string, records long, bytes long"


def convert_files(uris: DataFrame, folder: str) -> DataFrame:
    """(uri, records, bytes): ARC files, named in the column uri, written anew as WARC files in folder."""
    return written(uris.select("uri").mapInArrow(partial(_converted, folder=folder), MANIFEST), "warc-files")


# -- pages -------------------------------------------------------------------------------------------------------


def page_url(url: str | None, page_id: int | None) -> str:
    if not url:
        return f"urn:page:{page_id}"
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    return f"filedesc%3A{url[9:]}" if url.startswith("filedesc:") else url  # the scheme of version blocks


def page_date(page_id: int | None) -> str:
    """A date for each page, as pages have none: seconds after FIRST_DATE, within a century."""
    return (FIRST_DATE + timedelta(seconds=(page_id or 0) % 3_000_000_000)).strftime("%Y%m%d%H%M%S")


def _page_block(page_id: int | None, payload: bytes) -> bytes:
    name = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{name}Content-Length: {len(payload)}\r\n\r\n".encode() + payload


def _stored_page(url: str | None, page_id: int, payload: bytes) -> dict[str, str]:
    """The record of another page with the same payload."""
    url, date = page_url(url, page_id), page_date(page_id)
    return {"url": url, "date": date, "id": record_id(url, date, _page_block(page_id, payload))}


def _archived(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Pages to ARC data, in either version by turns of the batch, and that to a WARC file."""
    stored: list[dict[str, str] | None] = []

    def arc() -> Iterator[bytes]:
        for n, batch in enumerate(batches):
            version = 1 + n % 2
            yield arc_version_block(version)
            for page, url, html, first, first_url in zip(*(c.to_pylist() for c in batch.columns)):
                payload = html.encode("utf-8", "surrogatepass")
                stored.append(None if first is None else _stored_page(first_url, first, payload))
                yield arc_record(version, page_url(url, page), page_date(page), _page_block(page, payload))

    def stored_in() -> Iterator[dict[str, str] | None]:
        while True:
            yield stored.pop(0)

    if made := write_archive(folder, convert(arc(), stored_in())):
        yield _manifest(made)


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(uri, records, bytes): WARC files with a record for every page, repeated payloads as revisits."""
    spark = pages.sparkSession
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    digest = F.sha2(F.col("html"), 256)
    large = F.octet_length("html") >= SMALLEST
    kept = rows.where(large & F.col("page_id").isNotNull()).groupBy(digest.alias("digest")).agg(F.min(F.struct("page_id", "url")).alias("first"), F.count("*").alias("n")).where("n > 1")
    kept = written(kept.select("digest", F.col("first.page_id").alias("first"), F.col("first.url").alias("first_url")), "repeated-payloads")
    # what cannot be a repeat has a key of its own, so that no such rows meet in one task
    keyed = rows.withColumn("digest", F.when(large & F.col("page_id").isNotNull(), digest).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("page_id"), F.hash("url", "html"))))).join(kept, "digest", "left")
    refers = F.when(F.col("page_id").eqNullSafe(F.col("first")), F.lit(None)).otherwise(F.col("first"))
    made = keyed.select("page_id", "url", "html", refers.alias("first"), "first_url").mapInArrow(partial(_archived, folder=new_path(spark, "warc")), MANIFEST)
    return written(made, "warc-files")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers", "record_id", "target_uri", "date", "sound")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_())
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            rows = []
            for header, block in parse_warc(gunzip(read_chunks(uri))):
                http, payload = split_http(block)
                fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in http.decode("latin-1").split("\r\n"))}
                stated = header["warc-payload-digest"].removeprefix("sha256:")
                revisit = header["warc-type"] == "revisit"
                sound = header["warc-block-digest"] == "sha256:" + hashlib.sha256(block).hexdigest() and (revisit or hashlib.sha256(payload).hexdigest() == stated)
                page = fields.get("x-page-id")
                size = int(fields["content-length"]) if revisit else len(payload)
                rows.append((None if page is None else int(page), size, stated, header["warc-type"], header.get("warc-refers-to"), header["warc-record-id"], header["warc-target-uri"], header["warc-date"], sound))
                if len(rows) == 5_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def read_records(files: DataFrame) -> DataFrame:
    """The records of the WARC files named in the column uri; sound says whether the digests fit what was read.

    Every file is a task of its own.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers string, record_id string, target_uri string, date string, sound boolean"
    return files.select("uri").repartition(max(1, files.count())).mapInArrow(_read, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri, warc_date, sound) of every page, read back from its archive.

    refers_to is the page of the record that a revisit names, found by record id.
    """
    records = written(read_records(archive_pages(pages)), "warc-records")
    revisits = records.where("refers is not null").select(F.col("refers").alias("record_id")).distinct()
    firsts = records.where("record_type = 'response'").join(revisits, "record_id", "left_semi").groupBy("record_id").agg(F.min("page_id").alias("refers_to"))
    both = records.join(firsts.withColumnRenamed("record_id", "refers"), "refers", "left")
    return both.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", F.col("date").alias("warc_date"), "sound")


__all__ = ["archive_pages", "convert", "convert_files", "parse_arc", "parse_warc", "read_records", "round_trip"]

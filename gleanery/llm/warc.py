"""Web archives in ZIP packages: WARC records behind stored members, read by range without extraction.

A package holds ``archive/data.warc.gz`` (one gzip member a record) and
``indexes/index.cdxj`` (a line a record: where it lies), both stored, so that a
record's place in the package is its place in the member plus the member's.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.common import checkpoint_dir, staged, text_or_empty

#: Payloads shorter than this are stored again each time.
LEAST_REVISIT = 100
#: A package is closed once it holds so many bytes.
PACKAGE_BYTES = 256 << 20
#: Records that follow one another are read in ranges of about this many bytes.
RANGE_BYTES = 8 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
# Signatures and layouts of the ZIP format (little-endian).
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
END_SIZE, LOCATOR_SIZE, CENTRAL_SIZE, LOCAL_SIZE = 22, 20, 46, 30
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF

PACKAGES = "path string, records long, bytes long"
PLACES = "path string, start long, length long, page_id string, url string, payload_digest string, record_type string"
RECORDS = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary, intact boolean"
PLACE_NAMES, RECORD_NAMES = ([x.split()[0] for x in schema.split(", ")] for schema in (PLACES, RECORDS))


# ------------------------------------------------------------------ ZIP directories


def source(path: str):
    """A file that can be read by range, from whatever store pyarrow knows (file, hdfs, viewfs, s3, gs, abfs)."""
    fs, name = pafs.FileSystem.from_uri(path)
    return fs.open_input_file(name)


def read_range(file, start: int, length: int) -> bytes:
    got = file.read_at(length, start)
    if len(got) < length:
        raise ValueError(f"the file ends at {start + len(got)}, before {start + length}")
    return got


def directory(file) -> tuple[int, int, int]:
    """(place, size, entries) of the central directory, from the end of the file; ZIP64 records where the plain ones are full."""
    size = file.size()
    tail_at = max(0, size - END_SIZE - FULL16)
    tail = read_range(file, tail_at, size - tail_at)
    at = tail.rfind(END)
    while at >= 0 and (at + END_SIZE > len(tail) or at + END_SIZE + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):  # in a comment
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no end of a central directory")
    entries, length, place = struct.unpack_from("<HII", tail, at + 10)
    if entries == FULL16 or FULL32 in (length, place):
        locator_at = tail_at + at - LOCATOR_SIZE
        locator = read_range(file, locator_at, LOCATOR_SIZE) if locator_at >= 0 else b""
        if locator[:4] == LOCATOR64:
            record = read_range(file, struct.unpack_from("<Q", locator, 8)[0], 56)
            if record[:4] != END64:
                raise ValueError("no ZIP64 end of the central directory where the locator says")
            entries, length, place = struct.unpack_from("<QQQ", record, 32)
    return place, length, entries


def members(file) -> dict[str, dict]:
    """Name -> method, packed, size, header (the local header's place) of each entry of the central directory."""
    place, length, entries = directory(file)
    raw, at, out = read_range(file, place, length), 0, {}
    for _ in range(entries):
        if raw[at : at + 4] != CENTRAL:
            raise ValueError(f"no entry at {at} of the central directory")
        flags, method = struct.unpack_from("<HH", raw, at + 8)
        packed, size, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", raw, at + 20)
        header = struct.unpack_from("<I", raw, at + 42)[0]
        name = raw[at + CENTRAL_SIZE :][:n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = raw[at + CENTRAL_SIZE + n_name :][:n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == 1:  # ZIP64: eight bytes for each value that is full, in this order
                values = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                size, packed, header = (next(values) if v == FULL32 else v for v in (size, packed, header))
            extra = extra[4 + n :]
        out[name] = {"method": method, "packed": packed, "size": size, "header": header}
        at += CENTRAL_SIZE + n_name + n_extra + n_comment
    return out


def data_start(file, member: dict) -> int:
    """Where a member's bytes begin: its local header has a name and extra fields of its own."""
    head = read_range(file, member["header"], LOCAL_SIZE)
    if head[:4] != LOCAL:
        raise ValueError(f"no local header at {member['header']}")
    return member["header"] + LOCAL_SIZE + sum(struct.unpack_from("<HH", head, 26))


# --------------------------------------------------------------------------- records


def header_value(text: str) -> str:
    """A field's value on one line: control characters and blanks are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in text)


def record_id(page_id: str, url: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}#{url}')}>"


def record(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, refers_url: str | None, date: str) -> bytes:
    """A WARC 1.1 record.  That of a revisit has the headers of the response, whose length is the full payload's, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id or "", url or "")), ("WARC-Date", date)]
    fields += [("WARC-Target-URI", header_value(url))] if url is not None else []
    fields += [("Page-ID", page_id)] if page_id is not None else []
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to, refers_url or "")), ("Refers-To-Page-ID", refers_to)]
        fields += [("WARC-Refers-To-Target-URI", header_value(refers_url))] if refers_url is not None else []
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def fields_of(head: bytes) -> dict[str, str]:
    return {k.lower(): v.removeprefix(" ") for k, _, v in (x.partition(":") for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])}


def parsed(raw: bytes) -> tuple:
    """A row of RECORDS from an unpacked record; ``intact`` if lengths and digest are what its headers say."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = fields_of(head)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    full, digest = int(fields_of(http)["content-length"]), warc["warc-payload-digest"].rpartition(":")[2]
    kind = warc["warc-type"]
    if kind == "response":
        found = hashlib.sha256(payload).hexdigest()
        intact, digest = len(payload) == full and found == digest and rest[len(block) :] == b"\r\n\r\n", found
        full = len(payload)
    else:
        intact, payload = payload == b"", None
    return warc.get("page-id"), warc.get("warc-target-uri"), full, digest, kind, warc.get("refers-to-page-id"), payload, intact


# --------------------------------------------------------------------------- writing


class Package:
    """One ZIP file under way: records go out as they come, the index waits for the end."""

    def __init__(self, path: str):
        self.path, self.lines, self.at = path, [], 0
        fs, name = pafs.FileSystem.from_uri(path)
        fs.create_dir(name.rpartition("/")[0], recursive=True)
        self.out = fs.open_output_stream(name)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)

    def add(self, packed: bytes, about: dict) -> None:
        self.lines.append(json.dumps(about | {"offset": self.at, "length": len(packed)}, ensure_ascii=True))
        self.data.write(packed)
        self.at += len(packed)

    def close(self) -> tuple[str, int, int]:
        self.data.close()
        with self.zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as index:
            for line in self.lines:
                index.write(line.encode() + b"\n")
        self.zip.writestr(zipfile.ZipInfo("datapackage.json"), json.dumps({"profile": "data-package", "resources": [{"path": DATA}, {"path": INDEX}]}))
        self.zip.close()
        self.out.close()
        return self.path, len(self.lines), self.at


def gzipped(raw: bytes, level: int = 3) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def marked(pages: DataFrame, least: int, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """page_id, url, payload, digest and, for revisits, refers_to and refers_url.

    Only digests seen more than once are joined back; that join's hot keys are split by AQE.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(text_or_empty(html_col), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url")))
    heads = rows.filter(F.octet_length("payload") >= least).groupBy(F.col("digest").alias("of")).agg(F.count("*").alias("times"), first.alias("head"))
    heads = staged(heads.filter("times > 1 AND head IS NOT NULL").select("of", "head"), "warc-heads")
    again = F.col("head").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("head.page_id"))
    return rows.join(heads, F.col("digest") == F.col("of"), "left").select(
        "page_id", "url", "payload", "digest", F.when(again, F.col("head.page_id")).alias("refers_to"), F.when(again, F.col("head.url")).alias("refers_url")
    )


def write_packages(
    pages: DataFrame, folder: str, least: int = LEAST_REVISIT, package_bytes: int = PACKAGE_BYTES, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """Write a WARC record a page to ZIP packages below ``folder``; returns path, records, bytes of each package.

    Of pages with equal payloads of ``least`` bytes or more those with the smallest
    id are responses, the others revisit it.  Null html is an empty payload;
    null ids come last and are revisits if a page with an id has their payload.
    Each attempt of a task writes files of its own name, and only those of the
    attempts that counted are returned: whoever reads goes by this table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        stem, made, package = f"{folder}/part-{task.partitionId():05d}-{task.taskAttemptId()}", [], None
        for batch in batches:
            for page_id, url, payload, digest, refers_to, refers_url in zip(*(c for c in batch.columns)):
                page_id, url, payload, digest, refers_to, refers_url = (x.as_py() for x in (page_id, url, payload, digest, refers_to, refers_url))
                ident = None if page_id is None else str(page_id)
                raw = record(ident, url, payload, digest, None if refers_to is None else str(refers_to), refers_url, date)
                package = package or Package(f"{stem}-{len(made):03d}.wacz")
                about = {"page_id": ident, "url": url, "digest": digest, "type": "response" if refers_to is None else "revisit"}
                package.add(gzipped(raw), about)
                if package.at >= package_bytes:
                    made.append(package.close())
                    package = None
        if package:
            made.append(package.close())
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made)], names=["path", "records", "bytes"])

    return staged(marked(pages, least, id_col, url_col, html_col).mapInArrow(run, PACKAGES), "packages")


# --------------------------------------------------------------------------- reading


def index_lines(file, step: int = 1 << 20) -> Iterator[tuple[str, dict]]:
    """(name of the archive's member, line) of each stored index; read a step at a time."""
    found = members(file)
    stored = [n for n, m in found.items() if n.startswith("archive/") and n.endswith((".warc.gz", ".warc")) and m["method"] == 0]
    for name, m in found.items():
        if not (name.startswith("indexes/") and name.endswith((".cdxj", ".cdx")) and m["method"] == 0):
            continue
        at, rest = data_start(file, m), b""
        stop = at + m["size"]
        while at < stop:
            rest += read_range(file, at, min(step, stop - at))
            at += step
            *lines, rest = rest.split(b"\n") if at < stop else [*rest.split(b"\n"), b""]
            for line in lines:
                if brace := line.find(b"{") + 1:  # a key and a time may come before
                    about = json.loads(line[brace - 1 :])
                    member = about.get("filename") or stored[0]
                    yield next(n for n in stored if n in (member, f"archive/{member}")), about


def read_index(packages: DataFrame) -> DataFrame:
    """A row a record: the package's path, start and length in it, and what the index tells of it.

    Only directories and indexes are read, a package by one task; a package's size is bounded when it is written.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for path in (p for batch in batches for p in batch["path"]):
            with source(path) as file:
                found, begins, rows = members(file), {}, []
                for name, about in index_lines(file):
                    if name not in begins:
                        begins[name] = data_start(file, found[name])
                    rows.append((path, begins[name] + int(about["offset"]), int(about["length"]), about.get("page_id"), about.get("url"), about.get("digest"), about.get("type")))
                    if len(rows) == 20_000:
                        yield pd.DataFrame(rows, columns=PLACE_NAMES)
                        rows = []
                yield pd.DataFrame(rows, columns=PLACE_NAMES)

    return packages.select("path").mapInPandas(run, PLACES)


def read_records(places: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records at ``places`` (path, start, length; all of an index or what a filter left of it).

    Places of one package that lie within ``range_bytes`` are read in one request.
    Returns page_id, url, payload_bytes, payload_digest, record_type, refers_to,
    payload (null for revisits) and intact: whether digest and lengths fit.
    """
    near = F.floor(F.col("start") / range_bytes)
    spans = places.groupBy("path", near.alias("near")).agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("parts"))
    first, last = F.element_at("parts", 1), F.element_at("parts", -1)
    ranges = spans.select("path", first["start"].alias("start"), (last["start"] + last["length"] - first["start"]).alias("length"), F.col("parts.start").alias("starts"), F.col("parts.length").alias("lengths"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, start, length, starts, lengths in batch.itertuples(index=False):
                with source(path) as file:
                    raw = read_range(file, start, length)
                rows, held = [], 0
                for a, n in zip(starts, lengths):
                    rows.append(parsed(zlib.decompress(raw[a - start : a - start + n], 31)))
                    held += len(rows[-1][6] or b"")
                    if held > range_bytes:
                        yield pd.DataFrame(rows, columns=RECORD_NAMES)
                        rows, held = [], 0
                yield pd.DataFrame(rows, columns=RECORD_NAMES)

    found = ranges.mapInPandas(run, RECORDS)  # ids as text: pandas would turn long columns with nulls into doubles
    return found.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Every page written to packages and read back from them: what the archives say of it."""
    spark: SparkSession = pages.sparkSession
    folder = folder or f"{checkpoint_dir(spark)}/packages-{uuid.uuid4().hex}"
    packages = write_packages(pages, folder if "://" in folder else f"file://{folder}" if folder.startswith("/") else folder)
    return read_records(read_index(packages)).drop("payload")


ORACLE_SQL = """
WITH payloads AS (
    SELECT page_id, url, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), heads AS (
    SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS head FROM payloads
)
SELECT page_id, url, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN head END AS refers_to, true AS intact
FROM (SELECT *, payload_bytes >= 100 AND head IS NOT NULL AND page_id IS DISTINCT FROM head AS again FROM heads)
"""

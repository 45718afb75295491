"""WARC archives, index first.

Writing gives, per record, its archive, offset, length, URL and digest. Reading
takes any selection of index rows, sorts them by place and fetches neighbours
in one byte range. Archives are gzip-compressed record by record.

Of records with equal payloads one is the response, the others revisit it; the
choice is made on digests, and per task at most one payload of a digest is moved.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize, scratch_path

#: An archive is closed when it is longer than this.
ARCHIVE_BYTES = 1 << 30
#: Records closer than this are fetched together, up to so much at once.
GAP, RANGE = 64 << 10, 8 << 20
#: The tables hold no fetch time.
DATE = "1970-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

INDEX = "archive string, offset bigint, length bigint, page_id bigint, url string, digest string, payload_bytes bigint, record_type string"
RECORDS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload string"


def _open(path: str):
    """File system and path of a shared folder's URI or plain path."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _header_text(value: str) -> str:
    """Characters that could end a header line are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" and c != "%" else f"%{ord(c):02X}" for c in value)


def _record_id(page_id, url, digest: str, number: int) -> str:
    name = hashlib.sha1(repr((page_id, url, digest, number)).encode()).digest()[:16]
    return f"<urn:uuid:{uuid.UUID(bytes=name)}>"


def record(kind: str, page_id, url, digest: str, size: int, payload: bytes = b"", number: int = 0, refers=None) -> bytes:
    """One record. ``digest`` is the payload's SHA-1 in hex, ``refers`` the (page_id, url) of a revisit's response."""
    bare = base64.b32encode(bytes.fromhex(digest)).decode()
    block = HTTP + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Date: {DATE}",
        f"WARC-Record-ID: {_record_id(page_id, url, digest, number)}",
        f"WARC-Payload-Digest: sha1:{bare}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Payload-Length: {size}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_text(url)}")
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {_record_id(*refers, digest, 0)}"]
        if refers[1] is not None:
            lines.append(f"WARC-Refers-To-Target-URI: {_header_text(refers[1])}")
        if refers[0] is not None:
            lines.append(f"X-Refers-To-Page-Id: {refers[0]}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-cased names) and payload of an unpacked record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.decode().partition(": ")
        headers[name.lower()] = value
    block = rest[: int(headers["content-length"])]
    return headers, block[len(HTTP) :]


class _Archive:
    """Appends records to archives of bounded size; names are new for every attempt of a task."""

    def __init__(self, folder: str):
        self.files, self.folder = _open(folder)
        self.uri = folder
        self.out = None

    def add(self, raw: bytes) -> tuple[str, int, int]:
        if self.out is not None and self.at > ARCHIVE_BYTES:
            self.close()
        if self.out is None:
            self.name, self.at = f"{uuid.uuid4().hex}.warc.gz", 0
            self.files.create_dir(self.folder, recursive=True)
            self.out = self.files.open_output_stream(f"{self.folder}/{self.name}", compression=None)
        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
        packed = packer.compress(raw) + packer.flush()
        self.out.write(packed)
        place = (f"{self.uri}/{self.name}", self.at, len(packed))
        self.at += len(packed)
        return place

    def close(self):
        if self.out is not None:
            self.out.close()
            self.out = None


def _writer(folder: str, revisits: bool):
    def run(batches):
        archive = _Archive(folder)
        for batch in batches:
            places, rows = [], batch.to_pydict()
            kind = "revisit" if revisits else "response"
            for i in range(batch.num_rows):
                page, url, digest, size = (rows[c][i] for c in ("page_id", "url", "digest", "payload_bytes"))
                if revisits:
                    raw = record(kind, page, url, digest, size, number=rows["number"][i], refers=(rows["to_page"][i], rows["to_url"][i]))
                else:
                    raw = record(kind, page, url, digest, size, (rows["html"][i] or "").encode())
                places.append(archive.add(raw))
            names = ["archive", "offset", "length"]
            yield pa.RecordBatch.from_arrays(
                [
                    *[pa.array([p[j] for p in places], t) for j, t in enumerate((pa.string(), pa.int64(), pa.int64()))],
                    *[batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url", "digest", "payload_bytes")],
                    pa.array([kind] * batch.num_rows, pa.string()),
                ],
                [*names, "page_id", "url", "digest", "payload_bytes", "record_type"],
            )
        archive.close()

    return run


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write one record per row of ``pages`` (``page_id``, ``url``, ``html``) below ``folder``; return the index.

    The payload is the html in UTF-8, null as empty. Of rows with equal payloads
    the one with the largest page_id (null smallest, then the larger url) is the
    response; of rows equal in everything, one. All others are revisits. The
    index names only archives of tasks that ended well.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        "html",
        F.sha1(F.coalesce("html", F.lit(""))).alias("digest"),
        F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("payload_bytes"),
    )
    best = W.partitionBy("digest").orderBy(F.col("page_id").desc_nulls_last(), F.col("url").desc_nulls_last())
    chosen = rows.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
    responses = materialize(chosen.mapInArrow(_writer(folder, False), INDEX), "responses")

    first = responses.select(F.col("digest").alias("_d"), F.col("page_id").alias("to_page"), F.col("url").alias("to_url"))
    same = F.col("page_id").eqNullSafe(F.col("to_page")) & F.col("url").eqNullSafe(F.col("to_url"))
    counted = rows.groupBy("page_id", "url", "digest", "payload_bytes").agg(F.count(F.lit(1)).alias("_n"))
    others = counted.join(first, F.col("digest") == F.col("_d")).withColumn("_n", F.col("_n") - F.when(same, 1).otherwise(0))
    others = others.where("_n > 0").withColumn("number", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    revisits = others.select("page_id", "url", "digest", "payload_bytes", "number", "to_page", "to_url")
    return responses.unionByName(materialize(revisits.mapInArrow(_writer(folder, True), INDEX), "revisits"))


def _ranges(places):
    """Neighbouring places of one archive as lists that are fetched together."""
    run = []
    for p in places:
        if run and (p[0] != run[0][0] or p[1] > run[-1][1] + run[-1][2] + GAP or p[1] + p[2] - run[0][1] > RANGE):
            yield run
            run = []
        run.append(p)
    if run:
        yield run


def _read(payloads: bool):
    def run(batches):
        name, source = None, None
        for batch in batches:
            out = []
            for group in _ranges(list(zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True))):
                if group[0][0] != name:
                    name = group[0][0]
                    files, path = _open(name)
                    source = files.open_input_file(path)
                start = group[0][1]
                data = source.read_at(group[-1][1] + group[-1][2] - start, start)
                for _, offset, length, url in group:
                    raw = zlib.decompress(data[offset - start : offset - start + length], 31)
                    h, payload = parse(raw)
                    bare = h["warc-payload-digest"].removeprefix("sha1:")
                    if h["warc-type"] == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != bare:
                        raise ValueError(f"record at {offset} of {name} is damaged")
                    page, to = h.get("x-page-id"), h.get("x-refers-to-page-id")
                    out.append((
                        int(page) if page else None, url, int(h["x-payload-length"]), bare, h["warc-type"],
                        int(to) if to else None, payload.decode("utf-8", "replace") if payloads and h["warc-type"] == "response" else None,
                    ))
            types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
            names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names)

    return run


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that rows of ``index`` name. A revisit has no payload of its own; ``payload_bytes`` and digest are the full one's."""
    places = index.select("archive", "offset", "length", "url")
    places = places.repartitionByRange("archive", "offset").sortWithinPartitions("archive", "offset")
    return places.mapInArrow(_read(payloads), RECORDS)


def archive_folder(spark) -> str:
    return scratch_path(spark, "warc")

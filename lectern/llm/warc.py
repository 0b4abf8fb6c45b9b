"""WARC archives with an index first: write records, then read selected ones by coalesced byte ranges.

Every task writes one archive of gzip members (one for each record) to the shared folder and returns the
index rows: file, offset, length, URL and digest. The index is a table; only what committed tasks
wrote is in it, so files of lost or repeated attempts are never read. Reading sorts the selected
index rows by file and offset, joins neighbouring ranges to reads of bounded size, and parses and
verifies the records. Records with equal payloads of at least ``least`` bytes are stored once; the others revisit it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import common

#: Gap that is read over, and the most that is read at once unless one record is larger.
GAP, READ = 1 << 16, 1 << 23
#: Bytes of an archive whose records are read by one group of rows.
CELL = 1 << 26
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _name(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def _clean(url: str) -> str:
    """A URL on one header line: control characters are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, target: int | None, date: str) -> bytes:
    """One WARC record; ``target`` is the page_id that it revisits, or None for a response."""
    head = ["WARC/1.1", f"WARC-Type: {'response' if target is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    head.append(f"X-Payload-Bytes: {len(payload)}")
    block = (_HTTP % len(payload)).encode()
    if target is None:
        block += payload
    else:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_name(target, digest)}", f"X-Refers-To-Page: {target}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields of RECORD of one uncompressed record; raises ValueError when it is damaged."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    field = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(field["Content-Length"])]
    if len(rest) != len(block) + 4:
        raise ValueError("record of a wrong length")
    _, _, payload = block.partition(b"\r\n\r\n")
    digest = base64.b32decode(field["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind, size = field["WARC-Type"], int(field["X-Payload-Bytes"])
    if kind == "response":
        size = len(payload)
        if hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"digest of record {field['WARC-Record-ID']} doesn't match")
    number = lambda k: int(field[k]) if k in field else None
    return {
        "page_id": number("X-Page-Id"), "url": field.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest, "record_type": kind,
        "refers_to": number("X-Refers-To-Page"), "payload": payload if kind == "response" else None,
    }


def write(pages: DataFrame, least: int = 1000, date: str = "2024-01-01T00:00:00Z", level: int = 3, folder: str | None = None) -> DataFrame:
    """Write a record for each row of pages(page_id, url, html); the index as a table with the columns of INDEX.

    Of rows with equal payloads of at least ``least`` bytes those with the largest page_id are
    responses, the others revisits of it; shorter payloads are always responses. A null html is an
    empty payload, a null url has no target; a null page_id counts as smallest and is never revisited.
    Repeated rows have a record each. An empty table gives an empty index; other columns are
    ignored. ``folder`` must be shared; by default it is a new one in spark.checkpoint.dir."""
    spark = pages.sparkSession
    folder = folder or common.workspace(spark) + "/archives"
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), body.alias("payload"), F.sha1(body).alias("digest"), F.octet_length(body).alias("n"))
    long = rows.where(F.col("n") >= least).select("page_id", "digest")
    heads = long.groupBy("digest").agg(F.max("page_id").alias("target"), F.count("*").alias("count")).where("count > 1 and target is not null").select("digest", "target")
    heads = common.materialise(heads, "heads")  # written, so that the join on a payload of very many copies can be split
    revisits = long.join(heads, "digest").where("page_id is null or page_id <> target").distinct()
    r = revisits.select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), "target")
    both = rows.join(r, (F.col("digest") == F.col("r_digest")) & F.col("page_id").eqNullSafe(F.col("r_id")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs = out = path = None
        at = 0
        try:
            for b in batches:
                rows = []
                for page_id, url, payload, digest, target in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if out is None:
                        fs, base = FileSystem.from_uri(folder)
                        fs.create_dir(base, recursive=True)
                        path = f"{uuid.uuid4().hex}.warc.gz"
                        out = fs.open_output_stream(f"{base}/{path}", compression=None)
                    z = zlib.compressobj(level, zlib.DEFLATED, 31)
                    member = z.compress(record(page_id, url, payload, digest, target, date)) + z.flush()
                    out.write(member)
                    rows.append((f"{folder}/{path}", at, len(member), url, digest, page_id, "response" if target is None else "revisit"))
                    at += len(member)
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [x.split()[0] for x in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    return common.materialise(both.select("page_id", "url", "payload", "digest", "target").mapInArrow(common.trimmed(run), INDEX), "index")


def read(index: DataFrame, payloads: bool = True) -> DataFrame:
    """Records (columns of RECORD) of the selected index rows, by sorted and coalesced byte-range reads.

    Every record is parsed and the digest of every response is verified. Rows whose file, offset or
    length is null are no places and are left out. Without ``payloads`` that column is null."""
    rows = index.where("file is not null and offset is not null and length is not null").select("file", "offset", "length", F.floor(F.col("offset") / CELL).alias("cell"))
    dealt = rows.repartition(common.partitions(index.sparkSession), "file", "cell").sortWithinPartitions("file", "offset")
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[str, object] | None = None

        def fetch(file: str, places: list[tuple[int, int]]) -> pa.RecordBatch:
            nonlocal opened
            if opened is None or opened[0] != file:
                if opened is not None:
                    opened[1].close()
                fs, path = FileSystem.from_uri(file)
                opened = file, fs.open_input_file(path)
            first = places[0][0]
            opened[1].seek(first)
            raw = opened[1].read(max(a + n for a, n in places) - first)
            found = []
            for a, n in places:
                z = zlib.decompressobj(31)
                found.append(parse(z.decompress(raw[a - first : a - first + n]) + z.flush()))
            return pa.RecordBatch.from_arrays([pa.array([None if k == "payload" and not payloads else x[k] for x in found], t) for k, t in zip(names, kinds, strict=True)], names)

        file, places = None, []
        for b in batches:
            for f, a, n in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if places and (f != file or a > places[-1][0] + places[-1][1] + GAP or a + n - places[0][0] > READ):
                    yield fetch(file, places)
                    places = []
                file = f
                places.append((a, n))
        if places:
            yield fetch(file, places)
        if opened is not None:
            opened[1].close()

    return dealt.select("file", "offset", "length").mapInArrow(common.trimmed(run), RECORD)


def op3_warc(spark, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back by the index."""
    index = write(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

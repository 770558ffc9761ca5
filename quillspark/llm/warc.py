"""WARC archives compressed record by record with a Zstandard dictionary that the archive itself carries.

An archive (the .warc.zst layout) starts with a skippable frame, magic number 0x184D2A5D, that holds a dictionary;
each record that follows, a warcinfo record first, is a Zstandard frame of its own, compressed with that dictionary, so that any record can be
read from its offset. The dictionary is built from a bounded, hash-chosen sample of the records to be archived.

Archives are rows (archive, warc) of a table written by Spark into the shared folder: each is closed once it
holds ARCHIVE_BYTES of records and goes on in the next, so a row has a bounded size, and a lost task simply
writes its rows again. export() lays them out as files.

Of records with equal payloads of at least REVISIT_BYTES, the one with the smallest page_id keeps the payload; the
others are revisit records that name it. The groups are found by an aggregation that combines before the shuffle
and a join that Spark can split, so a payload that a third of all pages share is no hot task.

Defined cases: null html is an empty payload; a null url is written as an empty target; equal page_ids: each row has
its own record, and all rows with the smallest id of a group are responses;
line breaks in urls are percent-encoded; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored
from .common import SLICE_ROWS, hash_sample, map_batches

REVISIT_BYTES = 100
ARCHIVE_BYTES = 4 << 20
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES, LEVEL = 400, 1 << 15, 64 << 10, 3
#: Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
VERSION, REVISIT_PROFILE = b"WARC/1.1", b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records have no crawl time to tell; all carry this one, so that equal input gives equal archives.
DATE = b"2000-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
ID = "urn:page:"


class Record(NamedTuple):
    kind: str
    page_id: int | None
    refers_to: int | None
    url: str
    payload_bytes: int
    digest: str
    payload: bytes


def _id(page_id: int | None) -> bytes:
    return f"<{ID}{'' if page_id is None else page_id}>".encode()


def write_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """One record, uncompressed. A revisit record leaves the payload out but keeps its digest and length."""
    block = HTTP if revisit else HTTP + payload
    head = [
        VERSION,
        b"WARC-Type: " + (b"revisit" if revisit else b"response"),
        b"WARC-Record-ID: " + _id(page_id),
        b"WARC-Date: " + DATE,
        b"WARC-Target-URI: " + quote(url or "", safe="%/:=&?~#+!$,;'@()*[]").encode(),
        b"WARC-Payload-Digest: sha256:" + digest.encode(),
        b"X-Payload-Length: %d" % len(payload),
    ]
    if revisit:
        head += [b"WARC-Refers-To: " + _id(refers_to), b"WARC-Profile: " + REVISIT_PROFILE]
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def info_record(archive: str) -> bytes:
    """The record that tells what an archive is."""
    block = f"software: quillspark\r\nformat: WARC File Format 1.1\r\nfilename: {archive}.warc.zst\r\n".encode()
    head = [VERSION, b"WARC-Type: warcinfo", f"WARC-Record-ID: <urn:archive:{archive}>".encode(), b"WARC-Date: " + DATE, b"Content-Type: application/warc-fields", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_record(data: bytes) -> Record:
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if version != VERSION:
        raise ValueError(f"not a record of {VERSION.decode()}")
    field = dict(x.split(b": ", 1) if b": " in x else (x.rstrip(b":"), b"") for x in lines)
    length = int(field[b"Content-Length"])
    block = rest[:length]
    if len(block) != length or rest[length:] != b"\r\n\r\n":
        raise ValueError("the record's block doesn't have the length its header tells")
    if (kind := field[b"WARC-Type"].decode()) == "warcinfo":
        return Record(kind, None, None, "", length, "", block)
    digest = field[b"WARC-Payload-Digest"].removeprefix(b"sha256:").decode()
    payload = block.partition(b"\r\n\r\n")[2]
    of = lambda k: int(v) if (v := field.get(k, b"").decode()[1:-1].removeprefix(ID)) else None
    if kind == "response":
        if hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError("the payload doesn't have the digest its header tells")
        return Record(kind, of(b"WARC-Record-ID"), None, field[b"WARC-Target-URI"].decode(), len(payload), digest, payload)
    return Record(kind, of(b"WARC-Record-ID"), of(b"WARC-Refers-To"), field[b"WARC-Target-URI"].decode(), int(field[b"X-Payload-Length"]), digest, b"")


def dictionary_frame(dictionary: bytes) -> bytes:
    """The leading skippable frame; an empty dictionary gives no frame."""
    return DICTIONARY_MAGIC.to_bytes(4, "little") + len(dictionary).to_bytes(4, "little") + dictionary if dictionary else b""


def read_archive(data: bytes) -> Iterator[Record]:
    """The records of an archive but warcinfo, by nothing but its own bytes."""
    at, options = 0, {}
    if int.from_bytes(data[:4], "little") == DICTIONARY_MAGIC:
        at = 8 + int.from_bytes(data[4:8], "little")
        options = {"dict_data": zstandard.ZstdCompressionDict(data[8:at])}
    reader = zstandard.ZstdDecompressor(**options)
    while at < len(data):
        frame = reader.decompressobj()
        out = frame.decompress(data[at:] if at == 0 else memoryview(data)[at:])
        if not frame.eof:
            raise ValueError("the archive ends inside a frame")
        at = len(data) - len(frame.unused_data)
        if (record := read_record(out)).kind != "warcinfo":
            yield record


def build_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from sample records, or none if they are too few or too small to learn from."""
    if len(samples) < 8 or sum(map(len, samples)) < 4096:
        return b""
    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, samples)) // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def plan(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, refers_to and revisit of each row of pages."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.lit(b"")).alias("payload")).withColumn("digest", F.sha2("payload", 256))
    found = rows.filter(F.length("payload") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    shared = found.filter("n > 1").select("digest", "first")
    joined = rows.join(shared, "digest", "left")
    same = F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", "digest", F.when(~same, F.col("first")).alias("refers_to"), (F.col("first").isNotNull() & ~same).alias("revisit"))


def write(pages: DataFrame, level: int = LEVEL) -> DataFrame:
    """The archives (archive string, warc binary) of all rows of pages, written into the shared folder."""
    planned = plan(pages)
    few = hash_sample(pages.select("page_id", F.col("html").cast("string").alias("html")), F.col("page_id"), SAMPLE_RECORDS, pages.count())
    sample = few.filter(F.length("html") <= SAMPLE_BYTES).orderBy(F.xxhash64("page_id", "html"), "page_id").limit(SAMPLE_RECORDS).collect()
    dictionary = build_dictionary([write_record(r.page_id, "", d := (r.html or "").encode(), hashlib.sha256(d).hexdigest()) for r in sample])
    lead = dictionary_frame(dictionary)

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made, held, parts = 0, 0, []
        pressed = zstandard.ZstdCompressor(level=level, write_content_size=True, **({"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}))

        def row() -> pa.RecordBatch:
            name = f"{TaskContext.get().partitionId():06d}-{made:06d}"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join([lead, pressed.compress(info_record(name)), *parts])], pa.binary())], names=["archive", "warc"])

        for b in (batch.slice(at, SLICE_ROWS) for batch in batches for at in range(0, batch.num_rows, SLICE_ROWS)):
            for page_id, url, payload, digest, refers_to, revisit in zip(*(c.to_pylist() for c in b.columns), strict=True):
                record = write_record(page_id, url, payload, digest, refers_to, revisit)
                parts.append(pressed.compress(record))
                held += len(record)
                if held >= ARCHIVE_BYTES:
                    yield row()
                    made, held, parts = made + 1, 0, []
        if held:
            yield row()

    columns = planned.select("page_id", "url", "payload", "digest", "refers_to", "revisit")
    return stored(columns.mapInArrow(archive, "archive string, warc binary"), "warc", compression="none")


def read(archives: DataFrame) -> DataFrame:
    """The records of archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null in revisits)."""

    def records(data: bytes) -> Iterator[tuple]:
        for r in read_archive(data):
            yield r.page_id, r.url, r.payload_bytes, r.digest, r.kind, r.refers_to, r.payload if r.kind == "response" else None

    return map_batches(archives.select("warc"), "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary", lambda: records, lambda r: 128 + len(r[-1] or b""))


def export(archives: DataFrame, folder: str) -> list[str]:
    """Writes the archives as .warc.zst files into a folder of this machine, one at a time."""
    paths = []
    for r in archives.toLocalIterator():
        path = Path(folder, f"{r.archive}.warc.zst")
        path.write_bytes(r.warc)
        paths.append(str(path))
    return paths

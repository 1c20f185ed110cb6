"""WARC archives with Zstandard dictionaries.

A dictionary is trained on the first records of an archive, stored in a leading
skippable frame, and every record is a frame of its own, so that a record can be
read by its offset.  Archives roll over at a size, are written under names that
no other attempt uses and count once the manifest names them.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, as_batch, shared_path, table, written

SKIPPABLE = 0x184D2A5D
LEAST_REVISIT = 1000


def info(name: str, date: str) -> bytes:
    """The record that opens an archive and tells what wrote it."""
    block = b"software: spanloom\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", f"WARC-Date: {date}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    b32 = base64.b32encode(bytes.fromhex(digest)).decode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    head += [f"WARC-Target-URI: {''.join(c for c in url if c not in '\r\n')}", f"WARC-Payload-Digest: sha1:{b32}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Fields of a record; a response's digest and length are those of its payload, a revisit's those it declares."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, page = fields["WARC-Type"], fields["WARC-Record-ID"][10:-1]
    out = {"page_id": int(page) if page else None, "record_type": kind, "refers_to": None}
    if kind == "response":
        return out | {"payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest()}
    declared = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length"))
    return out | {"payload_bytes": declared, "payload_digest": base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex(), "refers_to": int(fields["WARC-Refers-To"][10:-1])}


def train(samples: list[bytes], size: int) -> zstandard.ZstdCompressionDict:
    """A trained dictionary, or the samples' end as a raw one where there are too few to train on."""
    try:
        if sum(map(len, samples)) >= 8 * size:
            return zstandard.train_dictionary(size, samples, k=256, d=8)
    except zstandard.ZstdError:
        pass
    return zstandard.ZstdCompressionDict(b"".join(samples)[-size:] or b"\0" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes], dictionary_size: int = 1 << 14, sample_bytes: int = 1 << 20, level: int = 3) -> bytes:
    """The bytes of an archive: the dictionary's frame and one frame for each record."""
    samples, held = [], 0
    for r in records:
        if held >= sample_bytes:
            break
        samples.append(r[: 1 << 17])
        held += len(samples[-1])
    d = train(samples, dictionary_size)
    raw = d.as_bytes()
    z = zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=True)
    return b"".join([struct.pack("<II", SKIPPABLE, len(raw)), raw, *(z.compress(r) for r in records)])


def unarchive(data: bytes) -> Iterator[bytes]:
    """The records of an archive, in order."""
    magic, n = struct.unpack_from("<II", data)
    if magic != SKIPPABLE:
        raise ValueError("the archive has no dictionary frame")
    d = zstandard.ZstdCompressionDict(data[8 : 8 + n], dict_type=zstandard.DICT_TYPE_AUTO)
    z, at = zstandard.ZstdDecompressor(dict_data=d), 8 + n
    view = memoryview(data)
    while at < len(data):
        o = z.decompressobj()
        parts = [o.decompress(view[at : at + (1 << 16)])]
        at += 1 << 16
        while not o.eof and at < len(data):
            parts.append(o.decompress(view[at : at + (1 << 16)]))
            at += 1 << 16
        if not o.eof:
            raise ValueError("the archive ends inside a record")
        at = min(at, len(data)) - len(o.unused_data)
        yield b"".join(parts)


def _write(directory: str, archive_bytes: int, date: str):
    schema = "path string, records long, bytes long"
    to = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = fs.FileSystem.from_uri(directory)
        where.create_dir(base, recursive=True)

        def close(held: list[bytes]) -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.warc.zst"
            data = archive([info(name, date), *held])
            with where.open_output_stream(f"{base}/{name}") as f:
                f.write(data)
            return as_batch({"path": [f"{directory}/{name}"], "records": [len(held)], "bytes": [len(data)]}, to)

        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                page, url, html, digest, refers = row
                held.append(record(page, url or "", (html or "").encode(), digest, refers, date))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield close(held)
                    held, size = [], 0
        if held:
            yield close(held)

    return run, schema


def write_archives(pages: DataFrame, directory: str, archive_bytes: int = 16 << 20, salts: int = 16, date: str | None = None) -> DataFrame:
    """Write every row of ``pages`` (page_id, url, html) as a record under ``directory``; the manifest (path, records, bytes).

    Each archive opens with a warcinfo record; all records bear ``date``, the time
    of this call unless given.

    Of equal payloads of 1000 bytes or more the one with the largest page_id is
    a response and the others revisit it; of rows that repeat that page_id each
    is a response.  Shorter payloads are all responses; a null html is empty;
    a null page_id has no number and is a response only if no equal has one.
    Only digests are grouped, and the join is salted, so a payload that many
    pages share is spread.
    """
    html = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    p = pages.select("page_id", "url", "html", F.sha1(html).alias("digest"), (F.octet_length(html) >= LEAST_REVISIT).alias("large"))
    first = p.where("large").groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    first = first.select(F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.col("digest").alias("d"), "first")
    p = p.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")).withColumn("d", F.when(F.col("large"), F.col("digest")).otherwise(F.concat(F.lit("small "), F.xxhash64("page_id", "url", "html").cast("string"))))
    p = p.join(first, ["salt", "d"], "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    run, schema = _write(directory, archive_bytes, date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"))
    return written(p.select("page_id", "url", "html", "digest", refers.alias("refers_to")).mapInArrow(run, schema), "manifest")


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row per record of the archives that ``manifest`` names; the digest and length of a response are recomputed."""
    to = arrow_schema(RECORD)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                where, at = fs.FileSystem.from_uri(path)
                with where.open_input_stream(at) as f:
                    rows = [parse(r) for r in unarchive(f.read()) if not r.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")]
                yield as_batch({c: [r[c] for r in rows] for c in to.names}, to)

    spread = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path").repartition(spread, "path").mapInArrow(run, RECORD)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back."""
    return read_archives(write_archives(table(spark, sf_dir, "pages"), shared_path(spark, "warc")))

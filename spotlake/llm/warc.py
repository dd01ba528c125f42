"""Web archives that are indexed as they are written and read back by coalesced byte ranges."""

from __future__ import annotations

import datetime
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, materialize

INDEX = "page_id long, url string, digest string, record_type string, refers_to long, file string, offset long, length long"
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
CRLF = b"\r\n"


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in map(str.split, ddl.split(","))])


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One gzip member holding a WARC record. A revisit has no block; its digest and length are those of the payload. A
    record without a page id is named at random."""
    digest = hashlib.sha256(payload).hexdigest()
    block = payload if refers_to is None else b""
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>" if page_id is None else f"<urn:page:{page_id}>",
        "WARC-Date": date,
        "Content-Type": "text/html",
        "WARC-Target-URI": "".join(" " if ord(c) < 32 else c for c in url or ""),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "X-Payload-Length": len(payload),
        "Content-Length": len(block),
    }
    if refers_to is not None:
        head |= {"WARC-Refers-To": f"<urn:page:{refers_to}>", "WARC-Profile": "identical-payload-digest"}
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in head.items())]
    text = "\r\n".join(lines).encode("utf-8", "surrogatepass")
    return gzip.compress(text + CRLF * 2 + block + CRLF * 2, 6, mtime=0)


def info_record(date: str) -> bytes:
    """The record that opens each archive."""
    block = b"format: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}"
    return gzip.compress(head.encode() + CRLF * 2 + block + CRLF * 2, 6, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a record."""
    head, _, rest = gzip.decompress(member).partition(CRLF * 2)
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def mark_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100, salts: int = 64) -> DataFrame:
    """(page_id, url, payload, refers_to): of equal payloads of at least `least` bytes all but the smallest page_id
    refer to that page. Only digests are grouped, with partial aggregates; the table of digests that repeat is broadcast
    while it is small, and else joined by digest and one of `salts` numbers, so that a frequent payload is not one task. Rows
    without such a digest are spread by their own hash."""
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("_digest", F.when(F.octet_length("payload") >= least, F.sha2("payload", 256)))
    seen = rows.where("_digest is not null").groupBy("_digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n"))
    seen = materialize(seen.where("_n > 1 and _first is not null").select("_digest", "_first"), "repeated-digests")
    if seen.limit(200_001).count() <= 200_000:
        rows = rows.join(F.broadcast(seen), "_digest", "left")
    else:
        salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")
        rows = rows.withColumn("_salt", salt).withColumn("_digest", F.coalesce("_digest", F.xxhash64("page_id", "url").cast("string")))
        rows = rows.join(seen.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["_digest", "_salt"], "left")
    return rows.select("page_id", "url", "payload", F.when(F.col("page_id") != F.col("_first"), F.col("_first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str | None = None, least: int = 100, roll: int = 64_000_000, **columns: str) -> DataFrame:
    """Write a record for each page into archives in `folder` and return the index, itself a table in the shared folder.

    Each task writes files of its own, named at random and closed at `roll` bytes; the index holds offset, length, url
    and digest of each record. It is committed by Spark, so files of lost or repeated tasks are never referred to.
    A null html is an empty payload, a null url an empty one; a page with a null id is always a response.
    Pages that repeat an id with the same payload: each is a response, as it would refer to itself. Each archive opens
    with a warcinfo record. A payload of any length is one record, held whole by its task; an empty table gives no rows.
    """
    folder = folder or fresh_path(pages.sparkSession, "warc")
    schema, date = _arrow(INDEX), datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None:
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{top}/{name}", compression=None)
                        at = out.write(info_record(date))
                    data = record(page_id, url, payload, refers_to, date)
                    out.write(data)
                    kind = "response" if refers_to is None else "revisit"
                    rows.append((page_id, url, hashlib.sha256(payload).hexdigest(), kind, refers_to, name, at, len(data)))
                    at += len(data)
                    if at >= roll:
                        out.close()
                        out = None
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        finally:
            if out is not None:
                out.close()

    index = mark_revisits(pages, least=least, **columns).mapInArrow(write, INDEX)
    return materialize(index.withColumn("folder", F.lit(folder)), "warc-index")


def read_archives(index: DataFrame, gap: int = 65_536, span: int = 16_000_000, payloads: bool = True) -> DataFrame:
    """Read the records that the index rows select.

    Rows are dealt by file and sorted by offset; neighbours at most `gap` bytes apart are fetched by one read, of at
    most `span` bytes where no single record is longer. payload_bytes and payload_digest are those of the full payload: of a response they
    are taken from the bytes read, of a revisit from its header. payloads=False leaves payload null.
    """
    schema = _arrow(READ)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stores: dict = {}

        def fetch(run: list[tuple]) -> pa.RecordBatch:
            folder, name, start = run[0][:3]
            if folder not in stores:
                stores[folder] = fs.FileSystem.from_uri(folder)
            store, top = stores[folder]
            with store.open_input_file(f"{top}/{name}") as file:
                data = file.read_at(max(o + n for _, _, o, n, *_ in run) - start, start)
            rows = []
            for _, _, offset, length, page_id, url in run:
                fields, block = parse(data[offset - start : offset - start + length])
                revisit = fields["WARC-Type"] == "revisit"
                digest = fields["WARC-Payload-Digest"].removeprefix("sha256:") if revisit else hashlib.sha256(block).hexdigest()
                first = int(fields["WARC-Refers-To"][10:-1]) if revisit else None
                size = int(fields["X-Payload-Length"]) if revisit else len(block)
                rows.append((page_id, url, size, digest, fields["WARC-Type"], first, block if payloads and not revisit else None))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        run: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if run and (row[:2] != run[0][:2] or row[2] > run[-1][2] + run[-1][3] + gap or row[2] + row[3] - run[0][2] > span):
                    yield fetch(run)
                    run = []
                run.append(row)
        if run:
            yield fetch(run)

    wanted = index.select("folder", "file", "offset", "length", "page_id", "url")
    dealt = wanted.repartition("folder", "file", F.expr(f"offset div {span}")).sortWithinPartitions("folder", "file", "offset")
    return dealt.mapInArrow(read, READ)

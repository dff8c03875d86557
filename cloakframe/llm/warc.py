"""WARC archives of pages, written and read back record by record.

Archives are ordinary files in the shared folder, written by Spark: every
record is one gzip member, and Spark's line separator at the end of a file is
an empty gzip member, so a whole file is a plain chain of members that any
WARC reader accepts.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import lookup_join, staging_path
from .common import table

# --- fixed values of the contract and the format ------------------------------
LEAST_REVISIT = 100  # bytes of payload below which equal payloads are stored again
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # pages carry no date; a fixed one keeps reruns equal
# --------------------------------------------------------------------------------
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
CHUNK = 1 << 16
# Bytes per archive at most, unless one record alone is longer: a file is read by one task, as one value.
ARCHIVE = 32 << 20
_VISIBLE = "".join(map(chr, range(33, 127)))

READ = ("record_type string, record_id string, target_uri string, refers_to string, "
        "payload_digest string, payload_bytes bigint, payload binary")


def roles(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """``_id, _uri, _payload, _digest, _first``: pages with the response that a revisit refers to (null: a response).

    Of records with equal payloads of at least ``LEAST_REVISIT`` bytes the one
    with the smallest id is the response, with every row that repeats its id.
    A null payload is empty; a row without id refers to the smallest id of its
    payload, or is a response if there is none.  Only digests are grouped; the
    lookup is broadcast below a checked size and salted above it, so a payload
    that many pages share is spread over tasks.
    """
    uri = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("_id"), uri.alias("_uri"), payload.alias("_payload"),
                        F.sha2(payload, 256).alias("_digest"))
    firsts = (
        rows.filter(F.octet_length("_payload") >= LEAST_REVISIT)
        .groupBy("_digest").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
        .filter((F.col("_n") > 1) & F.col("_first").isNotNull()).select("_digest", "_first")
    )
    return lookup_join(rows, firsts, ["_digest"], F.xxhash64("_id", "_uri"), "left", 128).withColumn(
        "_first", F.when(~F.col("_id").eqNullSafe(F.col("_first")), F.col("_first")))


def _member(kind: str, record_id: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as one gzip member."""
    head = [VERSION, f"WARC-Type: {kind}".encode(), f"WARC-Record-ID: {record_id}".encode(), f"WARC-Date: {DATE}".encode()]
    head += [f"{name}: {value}".encode() for name, value in fields]
    head += [b"WARC-Block-Digest: sha256:" + hashlib.sha256(block).hexdigest().encode(),
             f"Content-Length: {len(block)}".encode()]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return b"".join([packer.compress(b"\r\n".join(head) + b"\r\n\r\n"), packer.compress(block),
                     packer.compress(b"\r\n\r\n"), packer.flush()])


def _record_id(page: object) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def _page_member(page, uri: str | None, payload: bytes, digest: str, first) -> bytes:
    fields = [] if uri is None else [("WARC-Target-URI", quote(uri, safe=_VISIBLE))]
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    # A revisit keeps the response's own header, so it still tells the length of the payload.
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if first is None:
        return _member("response", _record_id(page), fields, block + payload)
    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(first))]
    return _member("revisit", _record_id(page), fields, block)


def write_warc(planned: DataFrame, path: str) -> None:
    """Write pages with their roles as archives below ``path``, each with a warcinfo record first.

    An archive holds up to ``ARCHIVE`` bytes, or one record that is longer.
    """
    most = ARCHIVE
    info = _member("warcinfo", "<urn:warcinfo>", [("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")

    def pack(batches):
        def archive():
            return pa.RecordBatch.from_arrays([pa.array([b"".join(own)], pa.binary())], ["archive"])

        own, held = [info], len(info)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                for row in zip(*(part.column(c).to_pylist() for c in ("_id", "_uri", "_payload", "_digest", "_first"))):
                    member = _page_member(*row)
                    if held + len(member) > most and len(own) > 1:
                        yield archive()
                        own, held = [info], len(info)
                    own.append(member)
                    held += len(member)
        if len(own) > 1:
            yield archive()

    planned.mapInArrow(pack, "archive binary").select(F.col("archive").cast("string").alias("value")).write.options(
        lineSep=EMPTY_MEMBER.decode("latin-1"), encoding="ISO-8859-1", compression="none", maxRecordsPerFile=1).text(path)


def members(data: memoryview) -> Iterator[bytes]:
    """Contents of the gzip members of a file, one at a time; a broken or cut-off member raises."""
    at = 0
    while at < len(data):
        unpacker = zlib.decompressobj(31)
        parts = []
        while not unpacker.eof:
            if at >= len(data):
                raise ValueError("the archive ends inside a member")
            piece = data[at:at + CHUNK]
            parts.append(unpacker.decompress(piece))
            at += len(piece) - len(unpacker.unused_data)
        yield b"".join(parts)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.split(b"\r\n")[1:]
    return {name.strip().lower().decode(): value.strip().decode() for name, _, value in (x.partition(b":") for x in lines)}


def _check(told: str | None, data: bytes, what: str) -> None:
    if told is not None and told != "sha256:" + hashlib.sha256(data).hexdigest():
        raise ValueError(f"{what} digest differs")


def parse(record: bytes) -> tuple:
    """One record by its content length, with its digests verified: the columns of ``READ``."""
    head, blank, rest = record.partition(b"\r\n\r\n")
    if not blank or not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = _fields(head)
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("the content length does not frame the record")
    block = rest[:size]
    _check(fields.get("warc-block-digest"), block, "block")
    told = fields.get("warc-payload-digest")
    payload, length = None, None
    if fields.get("content-type", "").startswith("application/http"):
        http, _, body = block.partition(b"\r\n\r\n")
        length = int(_fields(http).get("content-length", len(body)))
        if fields["warc-type"] != "revisit":
            if len(body) != length:
                raise ValueError("the payload is not as long as its header says")
            payload = body
            _check(told, body, "payload")
    return (fields["warc-type"], fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-refers-to"),
            told.removeprefix("sha256:") if told else None, length, payload)


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All records below ``path``, without warcinfo; payloads of revisits are null, and all if ``payloads`` is false.

    One file is one value of a task, so archives written elsewhere must be below
    2 GB; inside, members are unpacked one after another in small steps, so a
    single unpacked record is held at a time.
    """
    names = [c.split()[0] for c in READ.split(", ")]
    types = pa.schema([pa.field(n, pa.binary() if n == "payload" else pa.int64() if n == "payload_bytes" else pa.string()) for n in names])

    def unpack(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                for record in members(memoryview(content.as_buffer())):
                    if not record:
                        continue
                    row = parse(record)
                    if row[0] == "warcinfo":
                        continue
                    rows.append(row if payloads else (*row[:-1], None))
                    held += len(record) if payloads else 200
                    if held > 1 << 21:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), types)], schema=types)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), types)], schema=types)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(unpack, READ)


def op7_warc_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """All pages written as archives in the shared folder and read back."""
    path = staging_path(spark, "warc")
    write_warc(roles(table(spark, folder, "pages")), path)

    return read_warc(spark, path, payloads=False).select(
        F.expr("try_cast(nullif(regexp_extract(record_id, '^<urn:page:(-?[0-9]+)>$', 1), '') as bigint)").alias("page_id"),
        "payload_bytes", "payload_digest", "record_type",
        F.expr("try_cast(nullif(regexp_extract(refers_to, '^<urn:page:(-?[0-9]+)>$', 1), '') as bigint)").alias("refers_to"))


OP7_SQL = """
with p as (
  select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest
  from pages),
f as (select payload_digest, min(page_id) as first_id from p where payload_bytes >= 100 group by 1)
select page_id, payload_bytes, p.payload_digest,
       case when first_id is null or first_id = page_id then 'response' else 'revisit' end as record_type,
       case when first_id = page_id then null else first_id end as refers_to
from p left join f on p.payload_digest = f.payload_digest
"""

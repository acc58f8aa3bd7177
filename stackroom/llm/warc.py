"""WARC archives: a writer, a normaliser of monolithic gzip, and a reader by offset index.

``write_archives`` writes rows as WARC files whose whole content is one gzip stream, as
some tools leave them. ``normalise`` inflates each such stream once, in pieces, and
writes every record as a gzip member of its own, with a sidecar index of offsets
beside the file: one tab-separated line for each record (offset, length, type, record
id). ``read_archives`` reads records back member by member through that index.

Records with equal payloads are written once as ``response`` (the largest page id); the
others are ``revisit`` records that name it and carry the payload's digest and length.

Files are written to the shared folder under names that no other attempt has; only
those that a written manifest names count, so tasks may run again. Bytes in memory are
those of one record, one piece of a stream and the index of one file.

Cases: null html counts as empty; payloads shorter than ``min_bytes`` are all
responses; rows with a null id are never what others refer to, and are responses
themselves if no row with an id has their payload; repeated rows with the largest id are
all responses; control characters of URLs are percent-encoded in headers; other columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackroom.shared import deal_files, materialize, open_store, scratch, wide_rows

#: Payload bytes after which a new archive is begun.
ARCHIVE_BYTES = 64 << 20
#: Bytes of a stream that are inflated at a time.
PIECE = 1 << 20
LEVEL = 1
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "part long, number long, path string, index string, records long, bytes long"
_BREAK = b"\r\n\r\n"


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """(id, url, payload, refers_to): refers_to is the id of the response, null for responses.

    Payloads are not shuffled unless very many are repeated: only digests of payloads that
    come more than once are joined to the rows, and Spark broadcasts them if they are few.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    digest = F.when(F.octet_length("payload") >= min_bytes, F.sha1("payload"))
    seen = rows.select("id", digest.alias("digest")).where("digest IS NOT NULL").groupBy("digest")
    first = seen.agg(F.max("id").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "response")
    joined = rows.withColumn("digest", digest).join(materialize(first, "repeated"), "digest", "left")
    refers = F.when(F.col("response").isNotNull() & ~F.col("id").eqNullSafe(F.col("response")), F.col("response"))
    return joined.select("id", "url", "payload", refers.alias("refers_to"))


def _header_text(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f-\xff]|[^\x00-\xff]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), value)


def build_record(page, url: str | None, payload: bytes, refers_to) -> bytes:
    """One record in full, with the two line breaks that end it."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    body = http if refers_to is not None else http + payload
    name = f"urn:page:{page}" if page is not None else f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, digest)}"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{name}>",
        f"WARC-Target-URI: {_header_text(url or '')}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + _BREAK + body + _BREAK


def parse_headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def split_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, whole record) of each record of an inflated stream."""
    held = bytearray()

    def fill() -> bool:
        piece = next(pieces, None)
        held.extend(piece or b"")
        return piece is not None

    while True:
        while (end := held.find(_BREAK)) < 0 and fill():
            pass
        if end < 0:
            if held.strip(b"\r\n"):
                raise ValueError("the stream ends within a record's headers")
            return
        headers = parse_headers(bytes(held[:end]))
        size = end + 4 + int(headers["content-length"]) + 4
        while len(held) < size and fill():
            pass
        if len(held) < size or held[size - 4 : size] != _BREAK:
            raise ValueError("the stream ends within a record, or a length is wrong")
        yield headers, bytes(held[:size])
        del held[:size]


def inflate(file) -> Iterator[bytes]:
    """The content of a gzip file of one or more members, in pieces."""
    unzip, data = None, b""
    while data := data or file.read(PIECE):
        unzip = unzip or zlib.decompressobj(31)
        if piece := unzip.decompress(data, PIECE):
            yield piece
        data = unzip.unconsumed_tail
        if unzip.eof:
            data, unzip = unzip.unused_data, None
    if unzip is not None:
        raise ValueError("the gzip stream is cut off")


def write_archives(records: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes planned records as monolithic ``.warc.gz`` files; returns the written manifest."""
    wide_rows(records.sparkSession)
    folder = folder or scratch(records.sparkSession, "warc")
    source = records.select("id", "url", "payload", "refers_to")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        fs, root = open_store(folder)
        rows = (row for batch in batches for row in zip(*(_cells(c) for c in batch.columns), strict=True))
        done: list[dict] = []
        row = next(rows, None)
        if row is not None:
            fs.create_dir(root, recursive=True)
        while row is not None:
            name = f"mono-{part:06d}-{number:04d}-{uuid.uuid4().hex}.warc.gz"
            zipper, held, count = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0, 0
            with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
                while row is not None and held < archive_bytes:
                    record = build_record(*row)
                    out.write(zipper.compress(record))
                    held, count = held + len(record), count + 1
                    row = next(rows, None)
                out.write(zipper.flush())
            done.append({"part": part, "number": number, "path": f"{folder}/{name}", "index": None, "records": count, "bytes": held})
            number += 1
        if done:
            yield _manifest_batch(pa, done)

    return materialize(source.mapInArrow(run, _MANIFEST), "warc-manifest")


def _cells(column):
    """A column's values as Python objects, one at a time."""
    return (cell.as_py() for cell in column)


def _manifest_batch(pa, rows: list[dict]):
    kinds = [("part", pa.int64()), ("number", pa.int64()), ("path", pa.string()), ("index", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))


def normalise(manifest: DataFrame, folder: str | None = None) -> DataFrame:
    """Rewrites the archives of a manifest with one gzip member for each record and a sidecar index."""
    folder = folder or scratch(manifest.sparkSession, "warc-members")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                name = f"warc-{row['part']:06d}-{row['number']:04d}-{uuid.uuid4().hex}.warc.gz"
                fs, root = open_store(folder)
                fs.create_dir(root, recursive=True)
                source, where = open_store(row["path"])
                at, lines = 0, []
                with source.open_input_stream(where, compression=None) as file, fs.open_output_stream(f"{root}/{name}", compression=None) as out:
                    for headers, record in split_records(inflate(file)):
                        zipper = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = zipper.compress(record) + zipper.flush()
                        out.write(member)
                        lines.append(f"{at}\t{len(member)}\t{headers['warc-type']}\t{headers['warc-record-id']}\n")
                        at += len(member)
                index = f"{name.removesuffix('.warc.gz')}.idx"
                with fs.open_output_stream(f"{root}/{index}", compression=None) as out:
                    out.write("".join(lines).encode())
                done = row | {"path": f"{folder}/{name}", "index": f"{folder}/{index}", "records": len(lines), "bytes": at}
                yield _manifest_batch(pa, [done])

    return materialize(deal_files(manifest.select("part", "number", "path", "index", "records", "bytes"), manifest).mapInArrow(run, _MANIFEST), "warc-manifest")


def read_member(file, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """(headers, content block) of the record at an offset of a normalised archive."""
    file.seek(offset)
    record = zlib.decompress(file.read(length), 31)
    head, _, rest = record.partition(_BREAK)
    headers = parse_headers(head)
    return headers, rest[: int(headers["content-length"])]


READ_SCHEMA = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
    ]
)


def read_archives(manifest: DataFrame) -> DataFrame:
    """The records of normalised archives, found through their indexes.

    A response's payload is checked against its digest. A revisit has no payload; its
    length and digest are those of the full payload, from its headers.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(READ_SCHEMA)
        page = re.compile(r"<urn:page:(-?\d+)>")
        for batch in batches:
            for path, index in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, where = open_store(index)
                with fs.open_input_stream(where, compression=None) as file:
                    entries = [line.split("\t") for line in file.read().decode().splitlines()]
                fs, where = open_store(path)
                rows = []
                with fs.open_input_file(where) as file:
                    for offset, length, *_ in entries:
                        rows.append(_read_row(*read_member(file, int(offset), int(length)), page))
                        if len(rows) == 256:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return deal_files(manifest.select("path", "index"), manifest).mapInArrow(run, READ_SCHEMA)


def _read_row(headers: dict[str, str], block: bytes, page) -> dict:
    head, _, payload = block.partition(_BREAK)
    http = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    revisit = headers["warc-type"] == "revisit"
    if not revisit:
        made = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if made != digest or len(payload) != int(http["content-length"]):
            raise ValueError(f"{headers['warc-record-id']}: the payload doesn't match its digest")
    own, other = page.fullmatch(headers["warc-record-id"]), page.fullmatch(headers.get("warc-refers-to", ""))
    return {
        "page_id": int(own[1]) if own else None,
        "url": headers["warc-target-uri"],
        "record_type": headers["warc-type"],
        "refers_to": int(other[1]) if other else None,
        "payload": None if revisit else payload,
        "payload_bytes": int(http["content-length"]),
        "payload_digest": digest,
    }


def archive_pages(pages: DataFrame, **columns: str) -> DataFrame:
    """pages through a monolithic archive, its normalised form and back: the rows of READ_SCHEMA."""
    return read_archives(normalise(write_archives(plan_records(pages, **columns))))

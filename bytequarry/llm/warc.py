"""Web archives (WARC): writing captures, reading records, and transaction assembly.

A capture is written as a request, a response (or a revisit of an earlier
response with the same payload) and a metadata record; request and metadata name
the response by WARC-Concurrent-To. Reading gives one row a record. Assembly
joins the records of a capture through these identifiers into one nested row.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytequarry.session import materialize, scratch_path

#: Payloads of at least so many bytes are written once; equal ones revisit it.
REVISIT_BYTES = 0
#: Compressed size at which a writer starts the next archive file.
FILE_BYTES = 16 << 20
LEVEL = 3
#: Longest header of a record that is read.
MOST_HEADER_BYTES = 1 << 20
DATE = "2024-01-01T00:00:00Z"
#: Revisited digests (20 bytes each) up to this number are broadcast, more are joined by a shuffle.
BROADCAST_DIGESTS = 500_000
#: Folder, hidden from readers, in which files wait for their place.
ASIDE = "_aside"
#: Captures that refer to one response, above which its page id is broadcast: there are at most rows over this number of such responses.
HOT_REFERS = 100_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(kind: str, page_id: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{kind}|{page_id}|{digest}'.encode()).digest())}>"


def _uri(url: str) -> str:
    """No blanks or control characters, which would end the header."""
    return "".join(c if "!" <= c and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def _member(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))] if v is not None)
    return gzip.compress(f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n", LEVEL, mtime=0)


def capture_records(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> list[bytes]:
    """The three compressed records of a capture."""
    digest = payload_digest(payload)
    own, uri = _record_id("response", page_id, digest), None if url is None else _uri(url)
    scheme_rest = (uri or "").split("://", 1)[-1]
    host, _, path = scheme_rest.partition("/")
    common = [("WARC-Date", DATE), ("WARC-Target-URI", uri)]
    request = f"GET /{path.partition('#')[0]} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = "" if page_id is None else f"page-id: {page_id}\r\n"
    kind = "revisit" if revisit else "response"
    main = [("WARC-Type", kind), ("WARC-Record-ID", own), *common, ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if revisit:
        main += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id("response", refers_to, digest))]
    side = [("WARC-Concurrent-To", own), *common]
    return [
        _member([("WARC-Type", "request"), ("WARC-Record-ID", _record_id("request", page_id, digest)), *side, ("Content-Type", "application/http; msgtype=request")], request),
        _member(main, http if revisit else http + payload),
        _member([("WARC-Type", "metadata"), ("WARC-Record-ID", _record_id("metadata", page_id, digest)), *side, ("Content-Type", "application/warc-fields")], fields.encode()),
    ]


def write_captures(
    pages: DataFrame,
    folder: str | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    revisit_bytes: int = REVISIT_BYTES,
    file_bytes: int = FILE_BYTES,
) -> str:
    """Writes three records for every row as .warc.gz files (a gzip member a record); returns their folder.

    Of rows with equal payloads of at least ``revisit_bytes`` bytes those with the
    largest id are responses, the others revisit it; smaller ones are all
    responses. The payload is the text in UTF-8 (null: empty). A null url has no
    target; a null id is never the largest unless all are null, and has no field
    in its metadata. Repeated rows are written again. An empty table gives an
    empty folder.

    Files are written aside, under a name of the task's attempt. The manifest, a
    table that Spark commits, tells which of them belong to the attempts that
    count; these alone then get their place and what is left aside is deleted.
    So tasks that die, run twice or again in another order neither lose nor
    repeat a record. ``folder`` is a URI of a file system that Arrow knows
    (file, hdfs, s3, gs, abfs; s3a and abfss are taken as s3 and abfs).
    """
    folder = folder or scratch_path(pages.sparkSession, "warc")
    _file_system(folder)  # an unknown scheme fails here, not in a task
    data = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), data.alias("payload"))
    digest = F.unhex(F.sha1("payload")).alias("digest")
    big = F.octet_length("payload") >= revisit_bytes
    again = rows.where(big).select("page_id", digest).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    again = materialize(again.where("n > 1").select("digest", "first"), "warc-digests")
    if again.count() <= BROADCAST_DIGESTS:
        again = F.broadcast(again)
    # Rows too small to revisit anything have keys of their own (none is 20 bytes long), lest they meet in one task.
    alone = F.concat(F.lit(b"\0"), F.xxhash64("page_id", "url").cast("string").cast("binary"), F.lit(b"|" * 20))
    rows = rows.select("*", F.when(big, F.unhex(F.sha1("payload"))).otherwise(alone).alias("digest")).join(again, "digest", "left")
    rows = rows.select("page_id", "url", "payload", "first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, path = _file_system(folder)
        system.create_dir(f"{path}/{ASIDE}", recursive=True)
        context = TaskContext.get()
        part, count, held, inside = context.partitionId(), 0, io.BytesIO(), 0

        def flush() -> pa.RecordBatch:
            name = f"{part:08d}-{count:05d}.warc.gz"
            aside = f"{ASIDE}/{name}-{context.taskAttemptId()}"
            with system.open_output_stream(f"{path}/{aside}", compression=None) as out:
                out.write(held.getvalue())
            columns = [pa.array([name]), pa.array([aside]), pa.array([inside], pa.int64()), pa.array([held.tell()], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["file", "aside", "records", "bytes"])

        for batch in batches:
            for page_id, url, payload, first in zip(*(batch.column(i) for i in range(4))):
                page_id, first = page_id.as_py(), first.as_py()
                for member in capture_records(page_id, url.as_py(), payload.as_py(), first, first is not None and first != page_id):
                    held.write(member)
                    inside += 1
                if held.tell() >= file_bytes:
                    yield flush()
                    count, held, inside = count + 1, io.BytesIO(), 0
        if inside:
            yield flush()

    spark = pages.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    hadoop = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    hadoop.mkdirs(place)  # there is none if no task runs
    manifest = materialize(rows.mapInArrow(write, "file string, aside string, records long, bytes long"), "warc-manifest")
    publish(manifest, folder)
    hadoop.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{ASIDE}"), True)
    return folder


def _file_system(folder: str):
    from pyarrow import fs

    scheme, colon, rest = folder.partition("://")
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3", "abfss": "abfs"}.get(scheme, scheme) + colon + rest)


def publish(manifest: DataFrame, folder: str) -> None:
    """Moves the files that the manifest names to their places; a file that is there already stays, so this can run again."""

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, path = _file_system(folder)
        for batch in batches:
            for name, aside in zip(batch.column("file").to_pylist(), batch.column("aside").to_pylist()):
                try:
                    system.move(f"{path}/{aside}", f"{path}/{name}")
                except OSError:  # a task that ran before this one has moved it
                    if system.get_file_info(f"{path}/{name}").type != fs.FileType.File:
                        raise
            yield pa.RecordBatch.from_arrays([batch.column("file")], ["file"])

    manifest.mapInArrow(move, "file string").write.format("noop").mode("overwrite").save()


_FIELDS = ("record_id", "record_type", "concurrent_to", "refers_to_id", "target_uri", "date", "content_type", "block_bytes", "http_status", "payload_bytes", "payload_digest", "page_id", "error")
RECORD_SCHEMA = (
    "record_id string, record_type string, concurrent_to string, refers_to_id string, target_uri string, date string, content_type string, "
    "block_bytes long, http_status string, payload_bytes long, payload_digest string, page_id long, error string"
)


#: Fixed value: the first bytes of a gzip member.
_MEMBER = b"\x1f\x8b\x08"
_CHUNK = 1 << 16


def parse_archive(content: bytes) -> Iterator[tuple]:
    """(fields..., payload) of each record of a compressed archive, whether it has a gzip member a record or not.

    What can't be read (a damaged member, a malformed or cut record) is told by a
    row with nothing but ``error``, one for each run of damage; reading resumes at
    the next member.
    """
    at, held, need, broken, decoder = 0, bytearray(), 0, False, None
    while at < len(content):
        start, decoder, lost, first = at, zlib.decompressobj(31), False, True
        while not decoder.eof and at < len(content):
            chunk = content[at : at + _CHUNK]
            try:
                data = decoder.decompress(chunk)
            except zlib.error as error:
                if not broken:
                    yield _error(error)
                broken, held, need = True, bytearray(), 0
                at = content.find(_MEMBER, start + 1)
                at = len(content) if at < 0 else at
                break
            at += len(chunk) - len(decoder.unused_data)
            if first and held.strip(b"\r\n") and data.startswith(b"WARC/"):
                yield _error("a record is cut")
                held, need = bytearray(), 0
            first = first and not data
            if lost:  # the rest of a member behind a malformed record
                continue
            held += data
            try:
                while len(held) >= need:
                    row, used, need = _take(held)
                    if row is None:
                        break
                    del held[:used]
                    broken = False
                    yield row
            except ValueError as error:
                if not broken:
                    yield _error(error)
                broken, lost, held, need = True, True, bytearray(), 0
    if (held.strip(b"\r\n") or decoder and not decoder.eof) and not broken:
        yield _error("a record is cut")


def _error(error: object) -> tuple:
    return (*[None] * (len(_FIELDS) - 1), str(error), None)


def _take(held: bytearray) -> tuple[tuple | None, int, int]:
    """(row, bytes used, 0) of the first record of the buffer, or (None, 0, bytes needed to try again)."""
    start = 0
    while held.startswith(b"\r\n", start):
        start += 2
    if len(held) < start + 5:
        return None, 0, len(held) + 1
    if not held.startswith(b"WARC/", start):
        raise ValueError(f"no record begins with {bytes(held[start : start + 20])!r}")
    end = held.find(b"\r\n\r\n", start)
    if end < 0:
        if len(held) - start > MOST_HEADER_BYTES:
            raise ValueError("a header has no end")
        return None, 0, 2 * len(held)
    headers = {}
    for line in bytes(held[start:end]).split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        headers[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not re.fullmatch("[0-9]{1,18}", length):
        raise ValueError(f"a record has the length {length[:20]!r}")
    stop = end + 4 + int(length)
    if len(held) < stop:
        return None, 0, stop
    return _row(headers, bytes(held[end + 4 : stop])), stop, 0


def _row(headers: dict[str, str], block: bytes) -> tuple:
    kind, status, size, digest, page_id, payload = headers.get("warc-type"), None, None, None, None, None
    if headers.get("content-type", "").startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        first, *lines = head.decode("utf-8", "replace").split("\r\n")
        if kind in ("response", "revisit"):
            status = first.partition(" ")[2]
        if kind == "response":
            size, digest = len(payload), payload_digest(payload)
        elif kind == "revisit":
            named = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            size = int(named["content-length"]) if named.get("content-length", "").isdigit() else None
            digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
    elif headers.get("content-type") == "application/warc-fields":
        for line in block.decode("utf-8", "replace").split("\r\n"):
            name, _, value = line.partition(":")
            if name == "page-id" and value.strip().lstrip("-").isdigit():
                page_id = int(value)
    return (
        headers.get("warc-record-id"), kind, headers.get("warc-concurrent-to"), headers.get("warc-refers-to"), headers.get("warc-target-uri"),
        headers.get("warc-date"), headers.get("content-type"), len(block), status, size, digest, page_id, None, payload,
    )


def read_records(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """One row a record of all .warc.gz files in ``folder``, with the payload if asked for.

    A row with an ``error`` stands for what could not be read. Digests and sizes of responses are those of the payload as read; those of
    revisits come from their headers.
    """
    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.warc.gz").load(folder)
    names = [*_FIELDS, *["payload"] * with_payload]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64() if n in ("block_bytes", "payload_bytes", "page_id") else pa.binary() if n == "payload" else pa.string() for n in names]

        def pack(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for content in batch.column(0):
                held, size = [], 0
                for row in parse_archive(content.as_py()):
                    held.append(row[: len(names)])
                    size += 200 + with_payload * len(row[-1] or b"")
                    if size > 4 << 20:
                        yield pack(held)
                        held, size = [], 0
                if held:
                    yield pack(held)

    return files.select("content").mapInArrow(read, RECORD_SCHEMA + ", payload binary" * with_payload)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row a capture: record_id, record_type, page_id, target_uri, payload_bytes, payload_digest, refers_to, request, response, metadata.

    Captures are the response and revisit records. The request and the metadata
    record that are concurrent to it are joined to it (those with the smallest
    record id if there are several, with their number); without one the struct is
    null. ``refers_to`` is the page id of the response that a revisit names, null
    if there is none. Records whose concurrent record is missing give no row.
    """
    core = F.struct("record_id", "target_uri", "date", "content_type", "block_bytes", "page_id")

    def beside(kind: str) -> DataFrame:
        rows = records.where((F.col("record_type") == kind) & F.col("concurrent_to").isNotNull())
        return rows.groupBy("concurrent_to").agg(F.min_by(core, "record_id").alias(kind), F.count("*").alias(f"n_{kind}")).withColumnRenamed("concurrent_to", "record_id")

    main = records.where(F.col("record_type").isin("response", "revisit"))
    main = main.select(
        "record_id", "record_type", "target_uri", "payload_bytes", "payload_digest", "refers_to_id",
        F.struct("record_id", "date", "content_type", "block_bytes", "http_status").alias("response"),
    )
    whole = main.join(beside("request"), "record_id", "left").join(beside("metadata"), "record_id", "left")
    # Responses refer to nothing; a key of their own keeps them from meeting in one task.
    refers = F.coalesce("refers_to_id", F.concat(F.lit("none "), F.coalesce("record_id", F.lit(""))))
    whole = whole.withColumn("page_id", F.col("metadata.page_id")).withColumn("refers_to_id", refers)
    named = beside("metadata").select(F.col("record_id").alias("refers_to_id"), F.col("metadata.page_id").alias("refers_to"))
    answered = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id")).distinct()
    asked = main.groupBy("refers_to_id").agg(F.count("*").alias("__n")).where(F.col("refers_to_id").isNotNull())
    named = asked.join(named.join(answered, "refers_to_id", "left_semi"), "refers_to_id")
    # A response that very many captures refer to is looked up without a shuffle of these.
    hot = named.where(F.col("__n") >= HOT_REFERS).select(F.col("refers_to_id").alias("__hot"), F.col("refers_to").alias("__hot_to"))
    whole = whole.join(F.broadcast(hot), F.col("refers_to_id") == F.col("__hot"), "left")
    whole = whole.withColumn("refers_to_id", F.when(F.col("__hot").isNotNull(), F.concat(F.lit("none "), F.coalesce("record_id", F.lit("")))).otherwise(F.col("refers_to_id")))
    return whole.join(named.where(F.col("__n") < HOT_REFERS).drop("__n"), "refers_to_id", "left").select(
        "record_id", "record_type", "page_id", "target_uri", "payload_bytes", "payload_digest",
        F.coalesce("__hot_to", "refers_to").alias("refers_to"), "request", "response", "metadata",
    )


#: DuckDB SQL for what comes back of pages.
ROUND_TRIP_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS x FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY x) AS first FROM d)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(((('0x' || substr(x, CAST(5 * (i // 4) + 1 AS INT), 5))::INT >> CAST(5 * (3 - i % 4) AS INT)) & 31) + 1 AS INT), 1)), '') AS payload_digest,
       CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first IS NULL OR page_id = first THEN NULL ELSE first END AS refers_to FROM m
"""

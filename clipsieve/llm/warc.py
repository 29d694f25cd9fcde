"""WARC archives: writing them, reading them back, and assembling the records of each capture.

A capture is a request, a response (or a revisit of an equal payload) and a metadata record. The request and
the metadata name the response in WARC-Concurrent-To; assembly brings the three together by that identifier.
Each record is a gzip member of its own, as readers of such archives expect, and each file begins with warcinfo.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clipsieve.llm.common import broadcast_if_small, bytes_column, new_path, small_batches, stored

CRLF = b"\r\n"
#: Compressed bytes from which on a file is full; a file exceeds it by one capture at most.
FILE_BYTES = 32_000_000
#: Bytes of payload that one Arrow batch of read records holds, but for a single record.
READ_BYTES = 8_000_000
LEVEL = 4
#: A gzip member ends in the high byte of its length, which is zero for less than this. Longer records are cut into
#: several members.
MEMBER_BYTES = 1 << 23
RECORD_SCHEMA = "warc_type string, record_id string, concurrent_to string, refers_to string, target_uri string, digest string, payload_bytes long, fields map<string,string>, payload binary"
KINDS = {"request": ("request",), "response": ("response", "resource"), "revisit": ("revisit",), "metadata": ("metadata",)}


def gzip_members(record: bytes) -> bytes:
    """A record as a gzip member, or several if it is very long."""
    out = []
    for k in range(0, max(1, len(record)), MEMBER_BYTES):
        z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        out += [z.compress(record[k : k + MEMBER_BYTES]), z.flush()]
    return b"".join(out)


def record_id(kind: str, key: str) -> str:
    h = hashlib.md5(f"{kind}{key}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def record(kind: str, identifier: str, headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A record's bytes; headers without value are left out."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {identifier}", *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + CRLF * 2 + block + CRLF * 2


def capture_records(page: str | None, url: str | None, payload: bytes, sha1: str, copy: int, first: str | None, date: str) -> list[bytes]:
    """The request, response or revisit, and metadata of a page; first is the key of the response a revisit names."""
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    key = f"{'null' if page is None else page}|{digest}|{copy}"
    main = record_id("response", key)
    common = [("WARC-Date", date), ("WARC-Target-URI", None if url is None else url.replace("\r", "%0D").replace("\n", "%0A"))]
    status = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    profile = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id("response", f"{first}|{digest}|1"))] if first is not None else []
    headers = [*common, ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}"), *profile]
    response = record("response" if first is None else "revisit", main, headers, status if first is not None else status + payload)
    uri = common[1][1] or ""
    host = uri.partition("://")[2]
    for mark in "/?#":
        host = host.partition(mark)[0]
    request = record("request", record_id("request", key), [*common, ("Content-Type", "application/http; msgtype=request"), ("WARC-Concurrent-To", main)], f"GET {uri} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode())
    about = f"pageId: {'' if page is None else page}\r\npayloadBytes: {len(payload)}\r\n".encode()
    metadata = record("metadata", record_id("metadata", key), [*common, ("Content-Type", "application/warc-fields"), ("WARC-Concurrent-To", main)], about)
    return [request, response, metadata]


def write(pages: DataFrame, path: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2024-01-01T00:00:00Z", suffix: str | None = ".warc.gz") -> None:
    """Archives of all pages, three records each, as files that Spark's task commit makes safe to retry.

    Of records with equal payloads of min_bytes at least, that with the smallest id is a response and the others
    are revisits without payload. A null payload is empty. Line breaks in a URL are percent-encoded; a null URL
    has no WARC-Target-URI. Rows with the same id are captures of their own, null ids too; a null id comes last. The
    files are renamed to the suffix when all are written (None: they keep Spark's names).
    """
    spark = pages.sparkSession
    base = pages.select(F.col(id_col).alias("n"), F.col(url_col).alias("u"), bytes_column(payload_col).alias("payload"))
    base = base.withColumns({"k": F.coalesce(F.col("n").cast("string"), F.lit("null")), "sha": F.sha1("payload")})
    # Which row comes first is settled on narrow rows; payloads stay where they are unless many are equal.
    each = stored(base.groupBy("k", "sha").agg(F.min("n").alias("n"), F.count("*").alias("copies")), "warc-keys")
    first = stored(each.groupBy("sha").agg(F.coalesce(F.min("n").cast("string"), F.lit("null")).alias("first"), F.sum("copies").alias("equal")).where("equal > 1").drop("equal"), "warc-first")
    rows = base.join(broadcast_if_small(first, 80), "sha", "left").withColumn("copy", F.lit(1))
    again = stored(each.where("copies > 1").select("k", "sha"), "warc-again")
    if not again.isEmpty():
        small = broadcast_if_small(again, 80)
        numbered = rows.join(small, ["k", "sha"], "left_semi").withColumn("copy", F.row_number().over(Window.partitionBy("k", "sha").orderBy("u")))
        rows = rows.join(small, ["k", "sha"], "left_anti").unionByName(numbered)
    is_first = F.col("first").isNull() | ((F.col("k") == F.col("first")) & (F.col("copy") == 1)) | (F.octet_length("payload") < min_bytes)
    rows = rows.select("n", "u", "payload", "sha", "copy", F.when(~is_first, F.col("first")).alias("first"))

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, 0

        def file() -> pa.RecordBatch:
            # The last byte, a zero, is the line separator that the writer of text files adds.
            return pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], ["value"])

        for b in batches:
            for n, u, payload, sha, copy, to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not held:
                    info = b"software: clipsieve\r\nformat: WARC File Format 1.1\r\n"
                    held.append(gzip_members(record("warcinfo", record_id("warcinfo", f"{n}|{sha}|{number}"), [("WARC-Date", date), ("Content-Type", "application/warc-fields")], info)))
                    number += 1
                new = [gzip_members(r) for r in capture_records(None if n is None else str(n), u, payload, sha, copy, to, date)]
                held += new
                size += sum(map(len, new))
                if size > FILE_BYTES:
                    yield file()
                    held, size = [], 0
        if held:
            yield file()

    small_batches(spark, 100)
    files = rows.mapInArrow(pack, "value binary").select(F.col("value").cast("string"))
    files.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)
    if suffix:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for status in system.listStatus(folder):
            name = status.getPath().getName()
            if not status.getLen():
                system.delete(status.getPath(), False)  # of a task without pages
            elif name.startswith("part-") and name.endswith(".txt"):
                system.rename(status.getPath(), spark._jvm.org.apache.hadoop.fs.Path(folder, name.removesuffix(".txt") + suffix))


def _inflated(data: bytes) -> Iterator[bytes]:
    """The pieces of a file, member by member if it is compressed."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    view, at = memoryview(data), 0
    while at < len(data):
        z = zlib.decompressobj(31)
        while not z.eof:
            if at >= len(data):
                raise ValueError("the file ends within a gzip member")
            piece = view[at : at + (1 << 16)]
            out = z.decompress(piece)
            at += len(piece) - len(z.unused_data)
            if out:
                yield out


def parse(data: bytes) -> Iterator[dict]:
    """The records of an archive file, compressed or not, one by one. A broken record ends the reading with an error."""
    pieces, buffer = _inflated(data), bytearray()

    def more(what: str) -> None:
        try:
            buffer.extend(next(pieces))
        except StopIteration:
            raise ValueError(f"the file ends within {what}") from None

    while True:
        while buffer[:2] == CRLF:
            del buffer[:2]
        if len(buffer) < 5:
            try:
                buffer.extend(next(pieces))
                continue
            except StopIteration:
                if buffer:
                    raise ValueError("the file ends within a record") from None
                return
        if buffer[:5] != b"WARC/":
            raise ValueError("no WARC record where one should begin")
        while (end := buffer.find(CRLF * 2)) < 0:
            more("a record's header")
        headers = {}
        for line in bytes(buffer[:end]).split(CRLF)[1:]:
            name, _, value = line.partition(b":")
            headers[name.strip().lower().decode()] = value.strip().decode()
        size = int(headers["content-length"])
        while len(buffer) < end + 4 + size:
            more("a record's block")
        block = bytes(buffer[end + 4 : end + 4 + size])
        del buffer[: end + 4 + size]
        kind, fields, payload = headers.get("warc-type"), {}, None
        if kind == "metadata":
            fields = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in block.decode().splitlines()) if k}
        elif kind in ("response", "resource"):
            payload = block[block.index(CRLF * 2) + 4 :] if kind == "response" else block
        claimed = headers.get("warc-payload-digest")
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if payload is not None else (claimed or "").removeprefix("sha1:") or None
        if payload is not None and claimed and claimed != f"sha1:{digest}":
            raise ValueError("a record has another digest than its payload")
        yield {"warc_type": kind, "record_id": headers.get("warc-record-id"), "concurrent_to": headers.get("warc-concurrent-to"), "refers_to": headers.get("warc-refers-to"), "target_uri": headers.get("warc-target-uri"), "digest": digest, "payload_bytes": None if payload is None else len(payload), "fields": list(fields.items()), "payload": payload}


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of all archives under path, files read by Spark and parsed record by record."""
    small_batches(spark, 1)
    text, kinds = pa.string(), [("payload_bytes", pa.int64()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())]
    schema = pa.schema([*((n, text) for n in ("warc_type", "record_id", "concurrent_to", "refers_to", "target_uri", "digest")), *kinds])

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch[0].to_pylist():
                columns: dict[str, list] = {n: [] for n in schema.names}
                size = 0
                for r in parse(data):
                    if not with_payload:
                        r["payload"] = None
                    size += len(r["payload"] or b"") + 500
                    for n, column in columns.items():
                        column.append(r[n])
                    if size > READ_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
                        columns, size = {n: [] for n in schema.names}, 0
                if columns["warc_type"]:
                    yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(each, RECORD_SCHEMA)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: its id and the structs request, response, revisit and metadata (null if missing).

    Records meet under the identifier that their WARC-Concurrent-To names, or else their own. A record without
    either, and warcinfo, is left out; of several of one kind in a capture that with the smallest record id stays.
    """
    r = records.where(F.col("warc_type").isin(*(t for of in KINDS.values() for t in of)))
    r = r.withColumn("capture_id", F.coalesce("concurrent_to", "record_id")).where("capture_id IS NOT NULL")
    body = F.struct("record_id", "target_uri", "digest", "payload_bytes", "refers_to", F.map_entries("fields").alias("fields"), "payload")
    return r.groupBy("capture_id").agg(*(F.min(F.when(F.col("warc_type").isin(*of), body)).alias(name) for name, of in KINDS.items()))


def round_trip(pages: DataFrame, min_bytes: int = 0, with_payload: bool = False) -> DataFrame:
    """Writes pages as archives into the shared folder, reads them back, and returns a row per capture.

    page_id, payload_bytes, payload_digest, record_type, refers_to (page of the response that a revisit names),
    and the nested capture: the structs request, response, revisit and metadata, null where a capture has no such record.
    Payloads come with it only if asked for. Pages that are alike in all columns are captures of their own, the first of
    which is the response; a very long page is several gzip members; columns besides page_id, url and html are ignored,
    whatever their names. An empty table gives no rows. The archives go once they are read.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(pages, path, min_bytes)
    records = stored(read(spark, path, with_payload), "warc-records")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    small_batches(spark)
    got = captures(records)
    got = got.withColumn("page_id", F.element_at(F.map_from_entries("metadata.fields"), "pageId"))
    got = got.withColumn("page_id", F.when(F.col("page_id") != "", F.col("page_id").cast("long")))
    got = got.withColumn("main", F.coalesce("response", "revisit"))
    # What a revisit names is found on narrow rows.
    meta = records.where("warc_type = 'metadata'").select(F.col("concurrent_to").alias("to"), F.col("fields")["pageId"].alias("to_page"))
    named = records.where("warc_type = 'response'").select(F.col("record_id").alias("to"), F.col("payload_bytes").alias("to_bytes"))
    named = named.join(records.where("warc_type = 'revisit'").select(F.col("refers_to").alias("to")).distinct(), "to", "left_semi").join(meta, "to", "left")
    named = named.withColumn("to_page", F.when(F.col("to_page") != "", F.col("to_page").cast("long")))
    # Responses name nothing: keys of their own, which match no record id, keep them apart.
    got = got.withColumn("names", F.coalesce("revisit.refers_to", F.concat(F.lit("none "), "capture_id")))
    got = got.join(broadcast_if_small(stored(named, "warc-named"), 150), F.col("names") == F.col("to"), "left")
    return got.select(
        "page_id", F.coalesce("main.payload_bytes", "to_bytes").alias("payload_bytes"), F.col("main.digest").alias("payload_digest"),
        F.when(F.col("response").isNotNull(), "response").otherwise("revisit").alias("record_type"), F.col("to_page").alias("refers_to"), "request", "response", "revisit", "metadata",
    )

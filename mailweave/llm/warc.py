"""Zstandard WARC archives: one frame per record behind a shared dictionary.

An archive starts with a skippable frame that holds the dictionary; every
record is one Zstandard frame made with it. Reading loads the dictionary from
that leading frame, decodes frame after frame, and validates the version line,
the header fields, the declared lengths, the closing blank lines and, for
whole payloads, the digest.

Defined cases: a null payload is empty; a null uri leaves out the target
field; rows with equal payloads and the same smallest id are all responses, as
is every row whose group has no id at all, and a row without id in a group
that has one revisits it; an empty table writes no archive and reads back no
rows; an archive without a record is valid; other columns of the input are
ignored. A frame that breaks a rule raises ``WarcError`` naming file and
offset; nothing is skipped silently.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailweave.session import scratch_path

from .common import staged

#: Skippable frame that carries the dictionary, and the frame of a record (fixed values of the format).
DICT_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
#: Compressed bytes after which a task starts its next archive; bounds what one reader row holds.
ARCHIVE_BYTES = 32_000_000
#: The dictionary is trained on at most so many payloads of at most so many bytes in all.
DICT_SAMPLES, DICT_SAMPLE_BYTES, DICT_BYTES = 2000, 8_000_000, 32_768

READ_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()),
    T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()),
    T.StructField("payload", T.BinaryType())])


class WarcError(ValueError):
    """An archive that breaks the format."""


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _utf8(value) -> bytes:
    return b"" if value is None else value.encode()


def digests(pages: DataFrame) -> DataFrame:
    """Adds ``_digest`` and ``_bytes`` of the payload (``html`` in UTF-8)."""
    schema = T.StructType([*pages.select("page_id", "url", "html").schema.fields,
                           T.StructField("_digest", T.StringType()), T.StructField("_bytes", T.LongType())])

    def run(batches):
        for b in batches:
            data = [_utf8(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([payload_digest(x) for x in data], pa.string()),
                 pa.array([len(x) for x in data], pa.int64())], names=[*b.schema.names, "_digest", "_bytes"])
    return pages.select("page_id", "url", "html").mapInArrow(run, schema)


def plan_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages with ``_digest``, ``_bytes`` and ``_refers`` (the page that holds the
    payload, for revisits; null for responses). The smallest id of a payload is
    found by a partial aggregate and joined back, so a hot payload only means a
    skewed join side, which adaptive execution splits."""
    d = digests(pages)
    first = staged(digests(pages).where(F.col("_bytes") >= min_bytes).groupBy("_digest", "_bytes")
                   .agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
                   .select(F.col("_digest").alias("_d"), F.col("_bytes").alias("_b"), "_first"), "warc_first")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first"))
    return (d.join(first, (F.col("_digest") == F.col("_d")) & (F.col("_bytes") == F.col("_b")), "left")
            .select("page_id", "url", "html", "_digest", "_bytes", refers.alias("_refers")))


def train_dictionary(pages: DataFrame) -> bytes:
    """Dictionary from a bounded sample of payloads; empty if there are too few to train one."""
    size = F.octet_length("html")
    few = pages.where(size.between(200, 4 * (DICT_SAMPLE_BYTES // DICT_SAMPLES))).select("page_id", "html")
    share = min(1.0, DICT_SAMPLES / max(1, few.count()))
    drawn = F.pmod(F.xxhash64("page_id", "html"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1
    rows = sorted(few.where(drawn).collect(), key=lambda r: (r.page_id is None, r.page_id, r.html))
    samples, used = [], 0
    for r in rows:
        x = r.html.encode()
        if used + len(x) > DICT_SAMPLE_BYTES:
            break
        samples.append(x)
        used += len(x)
    if len(samples) < 20:
        return b""
    return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()


def record(page_id, url, payload: bytes, digest: str, n_bytes: int, refers) -> bytes:
    """One WARC/1.1 record; a revisit has an empty block and names the page it refers to."""
    name = f"{page_id}|{digest}|{url}"
    head = [b"WARC/1.1", b"WARC-Type: " + (b"response" if refers is None else b"revisit"),
            b"WARC-Record-ID: <urn:uuid:%s>" % str(uuid.uuid5(uuid.NAMESPACE_URL, name)).encode(),
            b"WARC-Date: 1970-01-01T00:00:00Z",
            b"WARC-Payload-Digest: sha1:" + digest.encode(), b"X-Payload-Length: %d" % n_bytes]
    if page_id is not None:
        head.append(b"X-Page-Id: %d" % page_id)
    if url is not None:
        head.append(b"WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A").encode())
    if refers is not None:
        head += [b"X-Refers-To-Page: %d" % refers,
                 b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    head += [b"Content-Type: application/octet-stream", b"Content-Length: %d" % len(payload)]
    return b"\r\n".join(head) + b"\r\n\r\n" + payload + b"\r\n\r\n"


def write_archives(records: DataFrame, folder: str, dictionary: bytes) -> DataFrame:
    """Write the planned records as archives under ``folder``; returns (path,
    records), one row per archive. An archive's name holds the task's partition,
    and it appears by a rename after its last byte, so a repeated task replaces
    what a lost one left."""
    def run(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root)
        zdict = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(level=3, dict_data=zdict, write_content_size=True)
        lead = struct.pack("<II", DICT_MAGIC, len(dictionary)) + dictionary
        out, size, count, done = None, 0, 0, []

        def close():
            out.close()
            fs.move(f"{root}/{name}.{attempt}", f"{root}/{name}")
            done.append((name, count))
        attempt = f"tmp{TaskContext.get().taskAttemptId()}"
        for b in batches:
            for page_id, url, html, digest, n_bytes, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    name = f"part-{part:06d}-{len(done):05d}.warc.zst"
                    out, size, count = fs.open_output_stream(f"{root}/{name}.{attempt}"), len(lead), 0
                    out.write(lead)
                frame = packer.compress(record(page_id, url, _utf8(html), digest, n_bytes, refers))
                out.write(frame)
                size, count = size + len(frame), count + 1
                if size >= ARCHIVE_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()),
                                          pa.array([x[1] for x in done], pa.int64())], names=["path", "records"])
    return records.mapInArrow(run, "path string, records long")


def frames(data: memoryview, where: str):
    """(offset, content) of each record; the dictionary comes from the leading frame."""
    if len(data) < 8:
        raise WarcError(f"{where}: shorter than a frame header")
    magic, n = struct.unpack_from("<II", data, 0)
    if magic != DICT_MAGIC or 8 + n > len(data):
        raise WarcError(f"{where}: no whole dictionary frame at the start")
    zdict = bytes(data[8:8 + n])
    if zdict[:4] == struct.pack("<I", FRAME_MAGIC):
        zdict = zstandard.ZstdDecompressor().decompress(zdict)
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(zdict)) if zdict \
        else zstandard.ZstdDecompressor()
    at, step = 8 + n, 1 << 15
    while at < len(data):
        if len(data) - at < 4 or struct.unpack_from("<I", data, at)[0] != FRAME_MAGIC:
            raise WarcError(f"{where}: no record frame at byte {at}")
        one, parts, to = unpacker.decompressobj(), [], at
        try:
            while not one.eof:
                if to >= len(data):
                    raise WarcError(f"{where}: the frame at byte {at} is cut off")
                parts.append(one.decompress(data[to:to + step]))
                to = min(to + step, len(data))
        except zstandard.ZstdError as e:
            raise WarcError(f"{where}: the frame at byte {at} can't be decoded: {e}") from e
        yield at, b"".join(parts)
        at = to - len(one.unused_data)


def parse_record(content: bytes, where: str) -> tuple:
    """Row of READ_SCHEMA from a record, after checking headers, lengths and digest."""
    end = content.find(b"\r\n\r\n")
    lines = content[:max(end, 0)].split(b"\r\n")
    if end < 0 or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise WarcError(f"{where}: no WARC version line or header end")
    head = {}
    for line in lines[1:]:
        key, colon, value = line.partition(b":")
        if not colon or not key.strip():
            raise WarcError(f"{where}: malformed header line {line[:60]!r}")
        head[key.strip().lower()] = value.strip()
    for need in (b"warc-type", b"warc-record-id", b"warc-date", b"content-length", b"warc-payload-digest"):
        if need not in head:
            raise WarcError(f"{where}: header {need.decode()} is missing")
    kind, length = head[b"warc-type"].decode(), head[b"content-length"]
    if kind not in ("response", "revisit"):
        raise WarcError(f"{where}: record type {kind!r}")
    if not length.isdigit() or len(content) != end + 4 + int(length) + 4 or content[-4:] != b"\r\n\r\n":
        raise WarcError(f"{where}: Content-Length {length!r} does not match the record")
    payload = content[end + 4:len(content) - 4]
    digest = head[b"warc-payload-digest"].removeprefix(b"sha1:").decode()
    if kind == "response" and digest != payload_digest(payload):
        raise WarcError(f"{where}: payload digest does not match")
    number = lambda k: int(head[k]) if k in head else None
    uri = head.get(b"warc-target-uri")
    size = len(payload) if kind == "response" else number(b"x-payload-length")
    return (number(b"x-page-id"), None if uri is None else uri.decode(), size, digest, kind,
            number(b"x-refers-to-page"), payload if kind == "response" else None)


def read_archives(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """Rows of READ_SCHEMA from every archive in ``folder``; ``payload=False``
    still checks, but does not return, the payloads."""
    names = [f.name for f in READ_SCHEMA if payload or f.name != "payload"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][:len(names)]

    def run(batches):
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows, held = [], 0
                for at, content in frames(memoryview(data.as_buffer()), path):
                    rows.append(parse_record(content, f"{path}, byte {at}")[:len(names)])
                    held += len(content) if payload else 0
                    if len(rows) >= 5000 or held > 16_000_000:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
    files = (spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
             .option("pathGlobFilter", "*.warc.zst").load(folder))
    return files.select("path", "content").mapInArrow(run, T.StructType(list(READ_SCHEMA)[:len(names)]))


def round_trip(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> tuple[DataFrame, str]:
    """Write all pages as archives (in a fresh shared folder by default) and
    return the rows read back from them, and the folder."""
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "llm", "warc")
    if "://" not in folder and not folder.startswith("/"):
        folder = folder.replace("file:", "file://", 1)
    dictionary = train_dictionary(pages)
    written = staged(write_archives(plan_records(pages, min_bytes), folder, dictionary), "warc_written")
    if not written.head(1):
        return spark.createDataFrame([], READ_SCHEMA), folder
    return read_archives(spark, folder), folder


#: DuckDB: the rows from the definition; SHA-1 bits taken five at a time give base32.
SQL = r"""
WITH p AS (SELECT page_id, COALESCE(html, '') AS html, sha1(COALESCE(html, '')) AS hex FROM pages),
d AS (
  SELECT page_id, strlen(html) AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
             + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT)
             + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT)
             + CAST(substr(bits, 5 * i + 5, 1) AS INT), 1)), '') AS payload_digest
  FROM (SELECT *, CAST(CAST(unhex(hex) AS BIT) AS VARCHAR) AS bits FROM p)),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""

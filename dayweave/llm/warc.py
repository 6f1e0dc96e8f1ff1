"""WARC archives with Zstandard: one frame per record, the dictionary in a leading skippable frame.

Archives are written by the tasks that hold the rows, to the shared folder, under names that a repeated
task writes again with the same records; a list of the finished files is the result, so files of a lost
attempt are never read. Equal payloads are stored once: the row with the smallest key is the response, the
others are revisits that name it. The reader loads the dictionary, decodes frame by frame and checks version,
required headers, lengths and digests of every record; what fails is reported in the row, not dropped.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayweave.llm.common import hash_share, stored
from dayweave.session import ensure_checkpoint_dir

# Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
#: Names the ids of records: the key's decimal text under this namespace.
NAMESPACE = uuid.UUID("7b0f5e0c-5a52-4c6e-9a3f-3f4d6b1f8a10")
#: Bytes after which a task starts another archive.
ARCHIVE = 16 << 20
DATE = "2000-01-01T00:00:00Z"

FILES = "path string, records long, size long"
RECORDS = "file string, offset long, record_id string, type string, url string, key long, digest string, refers_id string, payload binary, problem string"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, str(key))}>"


def record(key: int, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record: a resource with its payload, or a revisit that names the record with the same payload."""
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(key)), ("WARC-Date", DATE), ("X-Row-Key", str(key))]
    if url is not None:
        headers.append(("WARC-Target-URI", quote(url, safe="%/:?#[]@!$&'()*+,;=~-._")))
    headers.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    body = payload
    if refers_to is not None:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to))]
        body = b""
    headers += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(body)))]
    head = "".join(f"{name}: {value}\r\n" for name, value in headers)
    return f"{VERSION}\r\n{head}\r\n".encode() + body + b"\r\n\r\n"


def train(pages: DataFrame, key_col: str, payload_col: str, *, samples: int = 400, longest: int = 1 << 16, size: int = 1 << 15) -> bytes:
    """A dictionary from about ``samples`` payloads of at most ``longest`` characters; empty if they are too few."""
    rows = pages.select(F.col(key_col).alias("key"), F.col(payload_col).alias("payload")).where("key is not null and length(payload) between 1 and " + str(longest))
    n = rows.count()
    some = rows.where(hash_share(F.col("key"), F.lit(samples / max(1, n)))).toPandas().sort_values(["key", "payload"])
    try:
        return zstandard.train_dictionary(size, [p.encode() for p in some["payload"]]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def open_folder(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The store that holds ``uri`` and the path in it; a path without a scheme is a shared mount."""
    return pyarrow.fs.FileSystem.from_uri(uri if ":/" in uri else f"file://{uri}")


def write(rows: DataFrame, folder: str, dictionary: bytes, key: str, url: str, payload: str, refers: str) -> DataFrame:
    """Archive ``rows``; ``(path, records, size)`` of the files. Nothing is written before an action runs."""

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, base = open_folder(folder)
        compressor = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True)
        lead = struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary if dictionary else b""
        frames, held, count, part = [], 0, 0, 0

        def close() -> pa.RecordBatch:
            nonlocal frames, held, count, part
            name = f"{base}/part-{task.partitionId():06d}-{part:04d}-{task.taskAttemptId()}.warc.zst"
            with store.open_output_stream(name, compression=None) as out:
                out.write(lead)
                for frame in frames:
                    out.write(frame)
            made = pa.RecordBatch.from_pydict({"path": [name], "records": pa.array([count], pa.int64()), "size": pa.array([held + len(lead)], pa.int64())})
            frames, held, count, part = [], 0, 0, part + 1
            return made

        for batch in batches:
            for k, u, p, r in zip(*(batch.column(n) for n in range(4))):
                raw = (p.as_py() or "").encode()
                frames.append(compressor.compress(record(k.as_py(), u.as_py(), raw, base32_sha1(raw), r.as_py())))
                held, count = held + len(frames[-1]), count + 1
                if held >= ARCHIVE:
                    yield close()
        if frames:
            yield close()

    return rows.select(key, url, payload, refers).mapInArrow(archive, FILES)


def frames(content: bytes) -> Iterator[tuple[int, bytes | None, str | None]]:
    """``(offset, record bytes, problem)`` of every frame of an archive."""
    at, dictionary = 0, None
    if len(content) >= 8 and struct.unpack_from("<I", content)[0] == DICTIONARY_FRAME:
        size = struct.unpack_from("<I", content, 4)[0]
        raw = content[8 : 8 + size]
        # The format allows the dictionary to be compressed itself.
        raw = zstandard.ZstdDecompressor().decompress(raw) if raw[:4] == FRAME_MAGIC else raw
        dictionary, at = zstandard.ZstdCompressionDict(raw), 8 + size
    decoder = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    view = memoryview(content)
    while at < len(content):
        if len(content) - at >= 8 and struct.unpack_from("<I", content, at)[0] & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + struct.unpack_from("<I", content, at + 4)[0]
            continue
        one = decoder.decompressobj()
        try:
            # A frame that says its size is cut exactly; the rest of the file is not copied.
            parts, end = [], at
            while not one.eof:
                if end >= len(content):
                    raise zstandard.ZstdError("the frame does not end")
                parts.append(one.decompress(view[end : end + (1 << 16)]))
                end += 1 << 16
            end = min(end, len(content)) - len(one.unused_data)
            yield at, b"".join(parts), None
            at = end
        except zstandard.ZstdError as error:
            yield at, None, f"frame: {error}"
            # The next frame's magic is the only way on.
            found = content.find(FRAME_MAGIC, at + 4)
            at = found if found >= 0 else len(content)


def parse(raw: bytes) -> tuple[dict[str, str], bytes, str | None]:
    """Headers with lower-case names, block, and what is wrong with the record."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            return headers, b"", f"header line without a colon: {line[:60]}"
        headers[name.strip().lower()] = value.strip()
    if not gap:
        return headers, b"", "headers do not end"
    if lines[0] not in ("WARC/1.0", "WARC/1.1"):
        return headers, b"", f"version: {lines[0][:60]}"
    for name in REQUIRED:
        if name not in headers:
            return headers, b"", f"missing {name}"
    if not headers["content-length"].isdigit():
        return headers, b"", "content-length is no number"
    size = int(headers["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        return headers, rest[:size], f"content-length {size}, record has {max(0, len(rest) - 4)}"
    return headers, rest[:size], None


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of the archives under ``folder``: ids, type, digest, payload and ``problem``.

    ``problem`` is null for a sound record; an empty folder gives no rows.
    """

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RECORDS.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()]
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                rows, size = [], 0
                for at, raw, problem in frames(content.as_py()):
                    headers, block = {}, b""
                    if raw is not None:
                        headers, block, problem = parse(raw)
                    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    kind = headers.get("warc-type")
                    if problem is None and kind != "revisit" and digest and digest != base32_sha1(block):
                        problem = "payload digest differs"
                    if problem is None and kind == "revisit" and "warc-refers-to" not in headers:
                        problem = "revisit names no record"
                    key = headers.get("x-row-key", "")
                    rows.append((path.as_py(), at, headers.get("warc-record-id"), kind, headers.get("warc-target-uri"), int(key) if key.lstrip("-").isdigit() else None, digest, headers.get("warc-refers-to"), block, problem))
                    size += len(block)
                    if size >= ARCHIVE:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path", "content")
    return files.mapInArrow(records, RECORDS)


def first_of_equals(pages: DataFrame, key_col: str, payload_col: str, smallest: int = 0) -> DataFrame:
    """``pages`` with ``refers_to``: the smallest key among equal payloads of at least ``smallest`` bytes.

    Null for the row that has it and for payloads no other row has. Payloads are compared by SHA-1 and
    length; only digests that occur twice are joined back.
    """
    raw = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.withColumn("_sha", F.sha1(raw)).withColumn("_size", F.octet_length(raw))
    twice = rows.where(F.col("_size") >= smallest).groupBy(F.col("_sha").alias("_s"), F.col("_size").alias("_z")).agg(F.min(key_col).alias("_first"), F.count("*").alias("_n")).where("_n > 1 and _first is not null")
    met = rows.join(twice, (F.col("_sha") == F.col("_s")) & (F.col("_size") == F.col("_z")), "left")
    return met.withColumn("refers_to", F.when(F.col("_first") != F.col(key_col), F.col("_first"))).drop("_sha", "_size", "_s", "_z", "_first", "_n")


def archive(pages: DataFrame, key_col: str = "page_id", url_col: str = "url", payload_col: str = "html", *, smallest: int = 0) -> DataFrame:
    """Write ``pages`` to archives in a new shared folder and read them back, one row per page.

    Returns ``(key_col, url, payload_bytes, payload_digest, record_type, refers_to, problem)``, all from the
    archives; for a revisit the length is that of the record it names. A null payload counts as empty. Rows
    without a key cannot be named in an archive and are left out; rows that repeat a key have a record each,
    and the first of equal ones by payload is the response. Other columns are not read.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(key_col).cast("long").alias("key"), F.col(url_col).alias("url"), F.col(payload_col).alias("payload")).where("key is not null")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(folder))
    dictionary = train(rows, "key", "payload")
    made = stored(write(first_of_equals(rows, "key", "payload", smallest), folder, dictionary, "key", "url", "payload", "refers_to"), "warc-files")
    found = read(spark, folder).withColumn("payload_bytes", F.octet_length("payload").cast("long")).drop("payload")
    names = made.select(F.element_at(F.split("path", "/"), -1).alias("name"))
    found = stored(found.join(names, F.element_at(F.split("file", "/"), -1) == F.col("name"), "left_semi"), "warc-records")
    owners = found.where("type = 'response'").groupBy(F.col("record_id").alias("named")).agg(F.min("key").alias("named_key"), F.max("payload_bytes").alias("named_bytes"))
    visits = found.where("type = 'revisit'").join(owners, F.col("refers_id") == F.col("named"), "left")
    columns = [F.col("key").alias(key_col), "url"]
    plain = found.where("type is distinct from 'revisit'").select(*columns, "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "problem")
    problem = F.coalesce("problem", F.when(F.col("named").isNull(), F.lit("revisit names no response")))
    return plain.unionByName(
        visits.select(*columns, F.col("named_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("named_key").alias("refers_to"), problem.alias("problem"))
    )

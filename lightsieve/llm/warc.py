"""Web archives whose records are compressed one by one with a dictionary of their own.

A task gathers the records of an archive up to a bound, builds a Zstandard dictionary from a sample of them, and writes
the dictionary into a leading skippable frame and each record into a frame of its own, so that any record can be read
alone. Where payloads are equal, one record is the response and the others revisit it.

Archives go to a folder of any file system that Arrow opens by its URI. Each attempt of a task writes files of its
own; the index, one row a record, is written by Spark and names those of the attempts that succeeded, so lost
executors leave files that nothing refers to.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lightsieve.llm.textmodel import pieces as slices
from lightsieve.operators.skew import splittable_join
from lightsieve.session import materialize, shared_path

#: fixed values of the formats: the frame that holds a dictionary, a compressed frame, the profile of a revisit
DICTIONARY_FRAME = 0x184D2A5D
COMPRESSED_FRAME = b"\x28\xb5\x2f\xfd"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARCHIVE_BYTES = 16 << 20
DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 2 << 20
_SAMPLE_PART = 256
_LEAST_PARTS = 8
_READ_BYTES = 1 << 16
INDEX_SCHEMA = "archive string, offset long, length long, record_id string, record_type string, payload_digest string"
RECORD_SCHEMA = "archive string, offset long, length long, record_id string, record_type string, page_id string, url string, payload_digest string, refers_to_record string, payload binary"


def _plain(value: str) -> str:
    """A header value without line ends, other control characters and spaces; those become %XX."""
    return "".join(c if c > " " and c != "\x7f" and c != "%" else f"%{ord(c):02X}" for c in value)


def _value(header: str | None) -> str | None:
    """What _plain was given."""
    if header is None or "%" not in header:
        return header
    first, *rest = header.split("%")
    return first + "".join(chr(int(part[:2], 16)) + part[2:] for part in rest)


def record(kind: str, headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{name}: {value}" for name, value in headers if value is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def http_head(payload_bytes: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()


def page_record(row: dict, date: str) -> bytes:
    """A response with its payload, or a revisit, which holds the payload's digest and the response's record instead."""
    headers = [
        ("WARC-Record-ID", f"<urn:uuid:{row['record_id']}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", None if row["url"] is None else _plain(row["url"])),
        ("WARC-Page-ID", None if row["page_id"] is None else _plain(row["page_id"])),
        ("WARC-Payload-Digest", f"sha256:{row['digest']}"),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    head = http_head(len(row["payload"]))
    if row["refers_to_record"] is None:
        return record("response", headers, head + row["payload"])
    return record("revisit", [*headers, ("WARC-Refers-To", f"<urn:uuid:{row['refers_to_record']}>"), ("WARC-Profile", REVISIT_PROFILE)], head)


def build_dictionary(records: list[bytes]):
    """A dictionary from records spread evenly over those of an archive, SAMPLE_BYTES of them at most; None for a few hundred bytes."""
    import zstandard

    total = sum(map(len, records))
    every, sample, so_far = max(1, -(-total // SAMPLE_BYTES)), [], 0
    for r in records[::every]:
        if so_far + len(r) <= SAMPLE_BYTES:  # of very large records those that fit
            sample.append(r)
            so_far += len(r)
    parts = [r[at : at + _SAMPLE_PART] for r in sample for at in range(0, len(r), _SAMPLE_PART)]  # few records are enough so
    if len(parts) < _LEAST_PARTS:
        return None
    try:
        return zstandard.train_dictionary(max(256, min(DICTIONARY_BYTES, so_far // 8)), parts, k=200, d=8)
    except zstandard.ZstdError:  # nothing repeats in them
        return None


def archive(records: list[bytes], level: int = 3) -> Iterator[bytes]:
    """The frames of an archive: the dictionary's (empty where there is none), then one for each record."""
    import zstandard

    dictionary = build_dictionary(records)
    if dictionary is None:
        yield b""
        compressor = zstandard.ZstdCompressor(level=level, write_checksum=True)
    else:
        content = zstandard.ZstdCompressor(level=level).compress(dictionary.as_bytes())
        yield struct.pack("<II", DICTIONARY_FRAME, len(content)) + content
        dictionary.precompute_compress(level=level)
        compressor = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_checksum=True)
    for r in records:
        yield compressor.compress(r)


class Found(NamedTuple):
    offset: int
    length: int
    kind: str
    headers: dict[str, str]
    block: bytes


def read_dictionary(stream: BinaryIO):
    """(dictionary or None, offset of the first record, bytes read beyond it)."""
    import zstandard

    start = stream.read(8)
    if len(start) < 8 or struct.unpack("<I", start[:4])[0] != DICTIONARY_FRAME:
        return None, 0, start
    size = struct.unpack("<I", start[4:])[0]
    content = stream.read(size)
    if content.startswith(COMPRESSED_FRAME):
        content = zstandard.ZstdDecompressor().decompress(content)
    return zstandard.ZstdCompressionDict(content), 8 + size, b""


def scan(stream: BinaryIO) -> Iterator[Found]:
    """The records of an archive in order. No more than one record is held at a time."""
    import zstandard

    dictionary, offset, rest = read_dictionary(stream)
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    rest = rest or stream.read(_READ_BYTES)
    while rest:
        frame, out, read = decompressor.decompressobj(), [], 0
        while True:
            out.append(frame.decompress(rest))
            read += len(rest)
            if frame.eof:
                rest = frame.unused_data
                break
            rest = stream.read(_READ_BYTES)
            if not rest:
                raise ValueError(f"the archive ends within the record at {offset}")
        length = read - len(rest)
        yield parse(b"".join(out), offset, length)
        offset += length
        rest = rest or stream.read(_READ_BYTES)


def parse(raw: bytes, offset: int = 0, length: int = 0) -> Found:
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(headers["Content-Length"])]
    if not version.startswith("WARC/") or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"no record at {offset}")
    return Found(offset, length, headers["WARC-Type"], headers, block)


def _bare(name: str | None) -> str | None:
    return name and name.removeprefix("<urn:uuid:").removesuffix(">")


def _uri(spark: SparkSession, folder: str) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 100, archive_bytes: int = ARCHIVE_BYTES, date: str = "2000-01-01T00:00:00Z"
) -> DataFrame:
    """Writes one record for each row to archives in folder, and returns their index (INDEX_SCHEMA).

    Of rows whose payloads are equal and have least_bytes or more, the one of the smallest id is the response, null
    being the last and equal ids deciding by their order in the table; the others revisit it. A null payload is the
    empty one, a null id or address is left out of its record. Each archive holds about archive_bytes of records, or
    one record that is longer. An empty table gives an empty index and no archive.
    """
    spark, root = pages.sparkSession, _uri(pages.sparkSession, folder)
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = materialize(rows.withColumn("digest", F.sha2("payload", 256)), "pages", "zstd")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    large = F.octet_length("payload") >= least_bytes
    repeated = rows.filter(large).groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", F.col("first.row").alias("first"))
    run = uuid.uuid4().hex
    name = lambda row: F.md5(F.concat(F.lit(f"{run}:"), row.cast("string")))
    refers = F.when(large & F.col("first").isNotNull() & (F.col("first") != F.col("row")), name(F.col("first")))
    dealt = splittable_join(rows, repeated, ["digest"], "left").select(name(F.col("row")).alias("record_id"), F.col("id").cast("string").alias("page_id"), "url", "digest", "payload", refers.alias("refers_to_record"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        context, part = TaskContext.get(), 0
        store, path = fs.FileSystem.from_uri(root)
        store.create_dir(path, recursive=True)
        waiting: list[tuple[bytes, tuple]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            file = f"{context.partitionId():05d}-{context.taskAttemptId()}-{part:05d}-{run[:8]}.warc.zst"
            info = record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{hashlib.md5(file.encode()).hexdigest()}>"), ("WARC-Date", date), ("WARC-Filename", file), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
            frames, at, found = archive([info, *(raw for raw, _ in waiting)]), 0, []
            with store.open_output_stream(f"{path}/{file}", compression=None) as out:
                for k, frame in enumerate(frames):
                    out.write(frame)
                    if k > 1:  # after the dictionary and the archive's own record
                        found.append((file, at, len(frame), *waiting[k - 2][1]))
                    at += len(frame)
            return pa.RecordBatch.from_arrays([pa.array(column) for column in zip(*found)], names=["archive", "offset", "length", "record_id", "record_type", "payload_digest"])

        for batch in batches:
            for piece in slices(batch["payload"], archive_bytes):
                for row in batch.slice(piece.start, piece.stop - piece.start).to_pylist():
                    raw = page_record(row, date)
                    waiting.append((raw, (row["record_id"], "revisit" if row["refers_to_record"] else "response", row["digest"])))
                    size += len(raw)
                    if size >= archive_bytes:
                        yield flush()
                        waiting, size, part = [], 0, part + 1
        if waiting:
            yield flush()

    return materialize(dealt.mapInArrow(write, INDEX_SCHEMA), "archive-index")


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """The records (RECORD_SCHEMA) of the archives that the index names, each read from its start to its end.

    page_id is text, null where the record has none; payload is the body of the HTTP message, null for revisits.
    """
    root = _uri(index.sparkSession, folder)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(root)
        names = [field.split(" ")[0] for field in RECORD_SCHEMA.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 6, pa.binary()]
        for batch in batches:
            for file in batch["archive"].to_pylist():
                rows, size = [], 0
                with store.open_input_stream(f"{path}/{file}", compression=None) as stream:
                    for found in scan(stream):
                        if found.kind not in ("response", "revisit"):
                            continue
                        h = found.headers
                        payload = found.block.partition(b"\r\n\r\n")[2] if found.kind == "response" else None
                        digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
                        rows.append((file, found.offset, found.length, _bare(h["WARC-Record-ID"]), found.kind, _value(h.get("WARC-Page-ID")), _value(h.get("WARC-Target-URI")), digest, _bare(h.get("WARC-Refers-To")), payload))
                        size += len(payload or b"")
                        if size >= ARCHIVE_BYTES or len(rows) >= 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return index.select("archive").distinct().mapInArrow(read, RECORD_SCHEMA)


def archive_pages(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 100, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(id_col, payload_bytes, payload_digest, record_type, refers_to), one row for each input row, as the archives give them back.

    Pages are written to archives in folder, a new one in the shared folder if none is given, and read again. Length
    and digest of a response are those of the payload that was read; those of a revisit, and refers_to, are its
    response's. A record whose payload is not what its header declares, or whose response is missing, is an error.
    Rows that repeat are records of their own. An empty table gives no rows. Other columns are ignored.
    """
    spark, kind = pages.sparkSession, pages.schema[id_col].dataType
    folder = folder or shared_path(spark, "archives")
    index = write_archives(pages, folder, id_col, url_col, payload_col, least_bytes, archive_bytes)
    records = read_archives(index, folder)
    records = materialize(records.select("record_id", "record_type", "page_id", "refers_to_record", "payload_digest", F.octet_length("payload").cast("long").alias("bytes"), F.sha2("payload", 256).alias("digest")), "records")
    responses = records.filter("record_type = 'response'")
    revisits = splittable_join(
        records.filter("record_type = 'revisit'").drop("bytes", "digest").withColumnRenamed("refers_to_record", "response"),
        responses.select(F.col("record_id").alias("response"), "bytes", "digest", F.col("page_id").alias("refers_to")),
        ["response"],
        "left",
    )
    both = responses.withColumn("refers_to", F.lit(None).cast("string")).unionByName(revisits, allowMissingColumns=True)
    sound = F.when(F.col("payload_digest").eqNullSafe(F.col("digest")), F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("record is not what it declares: "), "record_id")))
    return both.select(F.col("page_id").cast(kind).alias(id_col), F.col("bytes").alias("payload_bytes"), sound.alias("payload_digest"), "record_type", F.col("refers_to").cast(kind).alias("refers_to"))

"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame.

``write_archives`` gives every row a record: a ``response`` with the payload, or, for a copy of a payload that another
row stores, a ``revisit`` without one.  Each task writes archives of bounded size into the shared folder and returns
a row for each finished file; that list is kept as a table, so files that a failed task attempt left are never read.
``read_archives`` reads one frame at a time, checks record headers and lengths and recomputes payload digests.

Cases: a null payload is the empty payload.  A null key is written as ``null``; such a row is only the response if
its payload has no row with a key.  Repeated rows get a record each; one of them at most is the response.  An empty
table writes no archive and reads as no rows.  A broken archive raises ``ValueError`` with its name.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspan.store import held_bytes, new_path, staged

#: Format values of WARC-in-Zstandard: magic of the dictionary's skippable frame, and of a Zstandard frame.
DICTIONARY_MAGIC = 0x184D2A5D
ZSTD_MAGIC = 0xFD2FB528

MANIFEST = "path string, records long, bytes long"
RECORDS = "key long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string"


def base32_sha1(raw: Column) -> Column:
    """Upper-case base32 of the SHA-1, as a column: five hex digits are four base-32 digits."""
    hexed = F.sha1(raw)
    digits = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def deduplicated(rows: DataFrame, least_bytes: int = 0, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """(key, url, payload) -> the same with digest, record_type and refers_to.

    Among rows with equal payloads of at least ``least_bytes`` bytes the one with the largest key is the response.
    Digests that occur twice or more are broadcast up to ``broadcast_bytes``.  Beyond, rows without payloads find their
    response by digest, and payloads meet what was found by their row, so no digest brings its payloads together.
    """
    rows = rows.select("key", "url", F.coalesce(F.col("payload"), F.lit(b"")).alias("payload"))
    # Rows are told apart by their key.  Only where keys repeat they get a number, which must not change: written first.
    if rows.groupBy("key").count().where("count > 1").limit(1).count():
        rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "numbered")
    else:
        rows = rows.withColumn("row", F.coalesce("key", F.lit(-(1 << 63))))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload")))
    first = F.struct(F.coalesce("key", F.lit(-(1 << 63))).alias("k"), "row", "key")
    shared = (
        rows.where(F.octet_length("payload") >= least_bytes)
        .groupBy("digest")
        .agg(F.max(first).alias("kept"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "kept.key", F.col("kept.row").alias("kept_row"))
        .withColumnRenamed("key", "kept_key")
    )
    shared = staged(shared, "shared-digests")
    if held_bytes(shared) <= broadcast_bytes:
        found = rows.join(F.broadcast(shared), "digest", "left")
    else:
        named = rows.select("row", "digest").join(shared.hint("merge"), "digest").drop("digest")
        found = rows.join(named.hint("merge"), "row", "left")
    copy = F.col("kept_row").isNotNull() & (F.col("kept_row") != F.col("row"))
    return found.select(
        "key",
        "url",
        "payload",
        "digest",
        F.when(copy, "revisit").otherwise("response").alias("record_type"),
        F.when(copy, F.col("kept_key")).alias("refers_to"),
    )


def record_id(key: int | None) -> str:
    return f"<urn:page:{'null' if key is None else key}>"


def record_bytes(key, url, payload, digest, kind, refers_to) -> bytes:
    block = payload if kind == "response" else b""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(key)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: text/html; charset=utf-8",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(refers_to)}",
        ]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict[str, str | bytes]:
    """Headers (lower-cased names) and ``block`` of one record; raises ValueError where it isn't one."""
    cut = data.find(b"\r\n\r\n")
    if cut < 0:
        raise ValueError("no end of the header")
    lines = data[:cut].decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError(f"unknown version {lines[0][:20]!r}")
    head: dict[str, str | bytes] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"header line without a colon: {line[:40]!r}")
        head[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "content-length", "warc-payload-digest"):
        if name not in head:
            raise ValueError(f"no header {name}")
    length = int(head["content-length"])
    block = data[cut + 4 : cut + 4 + length]
    if len(block) != length or data[cut + 4 + length :] != b"\r\n\r\n":
        raise ValueError("the block's length differs from Content-Length")
    head["block"] = block
    return head


def _open(path: str):
    fs, at = pafs.FileSystem.from_uri(path)
    return fs, at


def _trained(samples: list[bytes], size: int) -> zstandard.ZstdCompressionDict | None:
    try:
        return zstandard.train_dictionary(size, samples)
    except zstandard.ZstdError:  # too few or too small samples to train from
        return None


class _Archive:
    """One archive file; the first records wait until the dictionary is trained from them."""

    def __init__(self, folder: str, dictionary_bytes: int, sample_bytes: int):
        self.path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        self.size, self.sample = dictionary_bytes, sample_bytes
        self.waiting: list[bytes] = []
        self.waits = self.raw = self.bytes = self.records = 0
        self.stream = self.packer = None

    def add(self, record: bytes) -> None:
        self.records += 1
        self.raw += len(record)
        if self.packer is None:
            self.waiting.append(record)
            self.waits += len(record)
            if self.waits >= self.sample:
                self._begin()
        else:
            self._write(self.packer.compress(record))

    def _write(self, data: bytes) -> None:
        self.bytes += len(data)
        self.stream.write(data)

    def _begin(self) -> None:
        fs, at = _open(self.path)
        self.stream = fs.open_output_stream(at, compression=None)
        trained = _trained([r[: 1 << 16] for r in self.waiting], self.size)
        if trained is not None:
            data = trained.as_bytes()
            self._write(struct.pack("<II", DICTIONARY_MAGIC, len(data)) + data)
        self.packer = zstandard.ZstdCompressor(level=3, dict_data=trained, write_content_size=True, write_checksum=True)
        for record in self.waiting:
            self._write(self.packer.compress(record))
        self.waiting = []

    def close(self) -> tuple[str, int, int]:
        if self.packer is None:
            self._begin()
        self.stream.close()
        return self.path, self.records, self.bytes


def write_archives(
    rows: DataFrame, archive_bytes: int = 32 << 20, dictionary_bytes: int = 16 << 10, sample_bytes: int = 1 << 20
) -> DataFrame:
    """Writes ``rows`` (of ``deduplicated``) as archives of about ``archive_bytes`` before compression.

    Returns the table of archives.  Each archive's dictionary is trained from its first ``sample_bytes``.
    """
    folder = new_path(rows.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, done = None, []
        fs, at = _open(folder)
        fs.create_dir(at, recursive=True)
        for batch in batches:
            columns = [batch.column(c) for c in ("key", "url", "payload", "digest", "record_type", "refers_to")]
            for i in range(batch.num_rows):
                archive = archive or _Archive(folder, dictionary_bytes, sample_bytes)
                archive.add(record_bytes(*(c[i].as_py() for c in columns)))
                if archive.raw >= archive_bytes:
                    done.append(archive.close())
                    archive = None
        if archive:
            done.append(archive.close())
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))],
            ["path", "records", "bytes"],
        )

    return staged(rows.mapInArrow(write, MANIFEST), "warc-files")


def frames(stream) -> Iterator[bytes]:
    """The decoded frames of an archive, one at a time; the leading skippable frame gives the dictionary."""
    data = stream.read(8)
    dictionary = None
    if len(data) == 8 and struct.unpack("<I", data[:4])[0] == DICTIONARY_MAGIC:
        raw = stream.read(struct.unpack("<I", data[4:])[0])
        if raw[:4] == struct.pack("<I", ZSTD_MAGIC):  # the dictionary itself may be compressed
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        dictionary = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT)
        data = b""
    unpacker = zstandard.ZstdDecompressor(dict_data=dictionary)
    while True:
        data = data or stream.read(1 << 16)
        if not data:
            return
        frame, parts = unpacker.decompressobj(), []
        while True:
            parts.append(frame.decompress(data))
            if frame.eof:
                data = frame.unused_data
                break
            data = stream.read(1 << 16)
            if not data:
                raise ValueError("the last frame is cut off")
        yield b"".join(parts)


def _key(value: str | None) -> int | None:
    if value is None:
        return None
    number = value[len("<urn:page:") : -1]
    return None if number == "null" else int(number)


def _checked(data: bytes) -> tuple:
    head = parse_record(data)
    digest = str(head["warc-payload-digest"]).removeprefix("sha1:")
    kind, block = head["warc-type"], head["block"]
    if kind not in ("response", "revisit"):
        raise ValueError(f"record type {kind!r}")
    if kind == "response":
        if base64.b32encode(hashlib.sha1(block).digest()).decode() != digest:
            raise ValueError("the payload's digest differs from the header")
        if len(block) != int(head["x-payload-length"]):
            raise ValueError("the payload's length differs from the header")
    elif "warc-refers-to" not in head:
        raise ValueError("a revisit without WARC-Refers-To")
    return (
        _key(head["warc-record-id"]),
        head.get("warc-target-uri"),
        int(head["x-payload-length"]),
        digest,
        kind,
        _key(head.get("warc-refers-to")),
    )


def read_archives(archives: DataFrame) -> DataFrame:
    """The checked records of the archives that the table lists."""
    types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
    names = [c.split()[0] for c in RECORDS.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, count in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist(), strict=True):
                out, seen = [], 0
                fs, at = _open(path)
                with fs.open_input_stream(at, compression=None) as stream:
                    try:
                        for data in frames(stream):
                            out.append((*_checked(data), path))
                            seen += 1
                            if len(out) == 5_000:
                                yield _batch(out, types, names)
                                out = []
                    except (ValueError, zstandard.ZstdError) as e:
                        raise ValueError(f"{path}, record {seen}: {e}") from e
                if seen != count:
                    raise ValueError(f"{path} has {seen} records; {count} were written")
                yield _batch(out, types, names)

    # A task for each few archives; the list is short and holds no payloads.
    return archives.repartition(archives.sparkSession.sparkContext.defaultParallelism * 2).mapInArrow(read, RECORDS)


def _batch(rows: list[tuple], types, names) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def archived_pages(spark: SparkSession, pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as archives and returns what reading them gives."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("key"), "url", F.encode("html", "UTF-8").alias("payload")
    )
    return read_archives(write_archives(deduplicated(rows, least_bytes)))

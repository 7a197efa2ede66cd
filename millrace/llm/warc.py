"""WARC archives compressed by Zstandard with a dictionary of their own.

An archive is a skippable frame (magic 0x184D2A5D) that holds a Zstandard dictionary, then one Zstandard frame for each
record, compressed with it, so that every record can be read alone.  The dictionary is built from the archive's own
records: an archive is held until it has ARCHIVE_BYTES of payload or its task ends, and records evenly spread over it,
SAMPLE_BYTES in all, are trained on.  Fewer than SAMPLES records are cut into pieces.  Where that is too little or too
uniform to train on (under LEAST_BYTES, or one byte repeated) FILLER, fixed strings of no meaning, is added, so that
every archive has a dictionary.

Of the records with equal payloads (by SHA-1 and length) of at least `least` bytes that with the smallest page id is a
`response`; the others are `revisit` records that name it and keep the HTTP header only.  Smaller payloads are all
responses.  The digest groups are counted by partial aggregation and joined back as a plain equi-join.

Archives are written by the executors to a folder that driver and executors share, under a name of the task's own, and
renamed when complete; only names that a finished task returned are read, so a lost executor leaves nothing but
an unread file.

Defined results: null html is an empty payload, null url an empty target; rows that share the smallest page id of their
payload are all responses; a null page id never is the smallest, and is a response if its payload has no other id; an
empty table gives no archives; other columns are not looked at."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm._shared import scratch, slices, table, written

#: Fixed values of the formats.
DICTIONARY_MAGIC, FRAME_MAGIC, RAW_DICTIONARY_MAGIC = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

SAMPLE_BYTES, DICTIONARY_BYTES, ARCHIVE_BYTES, LEVEL = 4 << 20, 64 << 10, 32 << 20, 3
SAMPLES, LEAST_BYTES = 16, 8 << 10
FILLER = [2 * hashlib.sha256(str(i).encode()).hexdigest().encode() for i in range(64)]
DATE = "1970-01-01T00:00:00Z"
LEAST = 0


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None) -> str:
    return f"<urn:x-page:{'' if page is None else page}>"


def page_of(urn: str) -> int | None:
    text = urn.removeprefix("<urn:x-page:").removesuffix(">")
    return int(text) if text else None


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC/1.1 record; with refers_to a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    target = "".join(c for c in url or "" if c >= " ").strip()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    body = http if refers_to is not None else http + payload
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """A record's header, its HTTP header, its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8").split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"no WARC record: {first[:40]!r}")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    body = rest[: int(fields["Content-Length"])]
    if len(body) != int(fields["Content-Length"]) or rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("a WARC record has another length than its header says")
    http, _, payload = body.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def _spread(records: list[bytes]) -> list[bytes]:
    """Records from all over the archive, about SAMPLE_BYTES in all; of very long ones the beginnings."""
    step = -(-sum(map(len, records)) // SAMPLE_BYTES) or 1
    some = records[::step]
    most = max(1, 2 * SAMPLE_BYTES // len(some))
    return [x[:most] for x in some] if sum(map(len, some)) > 2 * SAMPLE_BYTES else some


def _dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    total = sum(map(len, samples))
    if len(samples) < SAMPLES:
        size = max(64, min(16 << 10, total // (2 * SAMPLES)))
        samples = [x[i : i + size] for x in samples for i in range(0, len(x), size)]
    made = lambda some: zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, total // 16)), some, level=LEVEL, threads=0, k=256, d=8)
    if total < LEAST_BYTES:
        return made(samples + FILLER)
    try:
        return made(samples)
    except zstandard.ZstdError:  # too uniform
        return made(samples + FILLER)


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI as Spark writes it."""
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1) if uri.startswith("s3a://") else uri)


class Writer:
    """Writes records to the archives of one task; close() returns (path, records) of each."""

    def __init__(self, folder: str):
        self.fs, self.folder = _place(folder)
        self.made: list[tuple[str, int]] = []
        self.held: list[bytes] = []
        self.size = 0

    def add(self, raw: bytes) -> None:
        self.size += len(raw)
        self.held.append(raw)
        if self.size >= ARCHIVE_BYTES:
            self._finish()

    def _finish(self) -> None:
        path = f"{self.folder}/{uuid.uuid4().hex}.warc.zst"
        made = _dictionary(_spread(self.held))
        raw, packer = made.as_bytes(), zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_checksum=True)
        with self.fs.open_output_stream(path + ".part", compression=None) as out:
            out.write(struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw)
            for x in self.held:
                out.write(packer.compress(x))
        self.fs.move(path + ".part", path)
        self.made.append((path, len(self.held)))
        self.held, self.size = [], 0

    def close(self) -> list[tuple[str, int]]:
        if self.held:
            self._finish()
        return self.made


def read(folder: str, path: str) -> Iterator[bytes]:
    """The records of an archive, one frame at a time."""
    with _place(folder)[0].open_input_stream(path, compression=None) as f:
        magic, n = struct.unpack("<II", f.read(8))
        if magic != DICTIONARY_MAGIC:
            raise ValueError(f"{path}: no dictionary frame")
        raw = f.read(n)
        unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
        left = b""
        while True:
            frame, parts = unpacker.decompressobj(), []
            while not frame.eof:
                left = left or f.read(1 << 20)
                if not left:
                    if parts:
                        raise ValueError(f"{path}: it ends within a frame")
                    return
                parts.append(frame.decompress(left))
                left = frame.unused_data if frame.eof else b""
            yield b"".join(parts)


def write_archives(pages: DataFrame, folder: str, least: int = LEAST) -> DataFrame:
    """pages(page_id, url, html) -> (path, records) of the archives, which lie in `folder` (a URI)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("size", F.octet_length("html")).withColumn("sha", F.sha1(F.col("html").cast("binary")))
    many = rows.filter(F.col("size") >= least).groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    many = written(many.filter("n > 1 and first is not null").select("sha", "size", "first"), "payloads")
    rows = rows.join(many, ["sha", "size"], "left")
    rows = rows.select("page_id", "url", "html", F.when(F.coalesce(F.col("page_id") != F.col("first"), F.col("first").isNotNull()), F.col("first")).alias("refers_to"))
    uri = folder

    def run(batches):
        place, at = _place(uri)
        place.create_dir(at)
        writer = Writer(uri)
        for batch in slices(batches, "html", 8 << 20):
            for page, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                writer.add(record(page, url, html.encode(), refers_to))
        if made := writer.close():
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in made]), pa.array([n for _, n in made], pa.int64())], names=["path", "records"])

    return written(rows.mapInArrow(run, "path string, records long"), "archives")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """(path, ...) -> a row for each record, from its headers and, for responses, from the payload itself, whose digest
    and length must agree with them."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                some = []
                for raw in read(folder, path):
                    fields, http, payload = parse(raw)
                    kind, named = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and (digest(payload) != named or len(payload) != int(http["Content-Length"])):
                        raise ValueError(f"{path}: a payload differs from its header")
                    some.append((page_of(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], int(http["Content-Length"]), named, kind, page_of(fields["WARC-Refers-To"]) if kind == "revisit" else None))
                    if len(some) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*some), schema)], schema=schema)
                        some = []
                if some:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*some), schema)], schema=schema)

    tasks = max(1, archives.sparkSession.sparkContext.defaultParallelism)
    spread = archives.select("path").repartition(max(tasks, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return spread.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    found = read_archives(write_archives(table(spark, sf_dir, "pages"), folder), folder)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

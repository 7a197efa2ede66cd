"""Landing of log records: accepted, duplicate or quarantined evidence, each coordinate once.

The landing is a parquet table of entries, appended to by batches: <dir>/entries/batch=<id>.  A batch is written to a
staging folder and renamed, so that a crash leaves either all of it or nothing; a batch that is delivered again finds
its coordinates known and writes nothing.  As a stream, offsets are the source's, `land` runs in foreachBatch, and the
checkpoint moves on after it returned."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.expr import record_fingerprint
from millrace.streaming.contract import EVENT_SCHEMA, canonical, judged

RECORD_SCHEMA = "topic string, partition int, offset bigint, key string, value binary, timestamp_ms bigint"
ENTRY_SCHEMA = (
    "topic string, partition int, offset bigint, key string, timestamp_ms bigint, fingerprint string, status string, event_id string, "
    f"duplicate_of struct<topic:string,partition:int,offset:bigint>, validation_error string, event struct<{EVENT_SCHEMA.replace(' ', ':').replace(',:', ',')}>, raw_value string, batch string"
)
COORDINATE = ["topic", "partition", "offset"]
#: Folder of a batch's manifest beside its entries; readers of the entries pass over names that begin with `_`.
MANIFEST = "_manifest"
_TOPIC = re.compile(r"[A-Za-z0-9._-]+")


class LandingConsistencyError(RuntimeError):
    """What was landed and what arrives contradict each other."""


class CrashAfterLanding(RuntimeError):
    """Failure injection between the durable write and the progress commit."""


@dataclass(frozen=True)
class LandingResult:
    status: str  # landed or reused
    input_record_count: int
    accepted_count: int
    duplicate_event_count: int
    quarantine_count: int
    reused_coordinate_count: int
    accepted_total: int
    batch_id: str | None
    committable_offsets: tuple[dict[str, Any], ...]


def fingerprinted(records: DataFrame) -> DataFrame:
    return records.withColumn("fingerprint", record_fingerprint(*[F.col(c) for c in ("topic", "partition", "offset", "key", "value")]))


def classified(records: DataFrame, accepted: DataFrame | None = None) -> DataFrame:
    """Entries of new records.  The first valid record of an event id, by coordinate, is accepted unless `accepted`
    (event_id, topic, partition, offset) has the id; later ones are kept as duplicates that point to it."""
    j = judged(fingerprinted(records)).withColumn("event_id", F.col("event.event_id"))
    here = F.struct(*COORDINATE)
    bad = F.col("error").isNotNull()
    of_event = lambda c: F.concat(F.lit("event "), c)
    key = F.when(bad, F.concat_ws(" ", F.lit("record"), *COORDINATE)).otherwise(of_event(F.col("event_id")))  # refused records stay apart
    j = j.withColumn("_key", key).withColumn("_first", F.min(here).over(Window.partitionBy("_key")))
    if accepted is not None:
        known = accepted.select(of_event(F.col("event_id")).alias("_key"), F.struct(*COORDINATE).alias("_known"))
        j = j.join(known, "_key", "left").withColumn("_first", F.coalesce("_known", "_first"))
    own = F.col("_first") == here
    return j.select(
        *COORDINATE, "key", "timestamp_ms", "fingerprint",
        F.when(bad, F.lit("quarantined")).when(own, F.lit("accepted")).otherwise(F.lit("duplicate_event_id")).alias("status"),
        "event_id",
        F.when(~bad & ~own, F.col("_first")).alias("duplicate_of"),
        F.col("error").alias("validation_error"),
        "event",
        F.when(bad, F.expr("make_valid_utf8(cast(value as string))")).alias("raw_value"),
    )


_DECLARED = ["key", "timestamp_ms", "fingerprint", "status", "event_id", "event_digest"]
MANIFEST_SCHEMA = "batch string, topic string, partition int, offset bigint, key string, timestamp_ms bigint, fingerprint string, status string, event_id string, event_digest string"


def manifest_of(entries: DataFrame) -> DataFrame:
    """What a batch declares of each of its entries: coordinate, key, timestamp, fingerprint, status, event id and the
    digest of the normalised event."""
    return entries.withColumn("event_digest", F.sha2(F.to_json("event"), 256)).select("batch", *COORDINATE, *_DECLARED)


def tampered(entries: DataFrame, manifest: DataFrame) -> DataFrame:
    """batch, coordinate and problem of each entry that is not as its batch declares it: `missing`, `undeclared`, or the
    names of the fields that differ.  One join on the coordinate, whatever was changed."""
    here, there = (F.struct(*_DECLARED).alias(c) for c in ("here", "there"))
    both = manifest_of(entries).select("batch", *COORDINATE, here).join(manifest.select("batch", *COORDINATE, there), ["batch", *COORDINATE], "full")
    differ = F.array_compact(F.array(*[F.when(~F.col(f"here.{c}").eqNullSafe(F.col(f"there.{c}")), F.lit(c)) for c in _DECLARED]))
    problem = F.when(F.col("here").isNull(), "missing").when(F.col("there").isNull(), "undeclared").when(F.size(differ) > 0, F.array_join(differ, ", "))
    return both.select("batch", *COORDINATE, problem.alias("problem")).filter("problem is not null")


def next_offsets(records: DataFrame) -> DataFrame:
    """Where to go on: one beyond the last delivered offset, gaps or not."""
    return records.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("next_offset"))


def batch_scope(records: DataFrame) -> None:
    """One topic and partition, a safe name, offsets that don't repeat."""
    scope = records.groupBy("topic", "partition").agg(F.count("*").alias("n"), F.min("offset").alias("low"), F.count_distinct("offset").alias("distinct")).limit(2).collect()
    if not scope:
        raise ValueError("a landing batch needs at least one record")
    if len(scope) > 1:
        raise ValueError("a landing batch holds one topic and partition")
    row = scope[0]
    if not _TOPIC.fullmatch(row["topic"] or ""):
        raise ValueError(f"unsafe topic name {row['topic']!r}")
    if row["partition"] < 0 or row["low"] < 0:
        raise ValueError("partition and offset must be >= 0")
    if row["distinct"] != row["n"]:
        prints = fingerprinted(records).groupBy(*COORDINATE).agg(F.count_distinct("fingerprint").alias("p")).filter("p > 1")
        if not prints.isEmpty():
            raise LandingConsistencyError("the input has one coordinate with two payloads")
        raise ValueError("the input repeats a coordinate")


_ORDER = "offsets must increase strictly in poll order"


def poll_order(offsets: list[int]) -> None:
    if any(b <= a for a, b in zip(offsets, offsets[1:])):
        raise ValueError(_ORDER)


class Landing:
    """A landing folder.  One writer at a time."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, str(folder).rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def entries(self) -> DataFrame:
        at = self._path(f"{self.folder}/entries")
        if not self._fs.exists(at) or not self._fs.listStatus(at):
            return self.spark.createDataFrame([], ENTRY_SCHEMA)
        return self.spark.read.schema(ENTRY_SCHEMA).option("basePath", f"{self.folder}/entries").parquet(f"{self.folder}/entries")

    def manifests(self) -> DataFrame:
        """What the batches declare of their entries."""
        found = self._fs.globStatus(self._path(f"{self.folder}/entries/batch=*/{MANIFEST}"))
        if not found:
            return self.spark.createDataFrame([], MANIFEST_SCHEMA)
        return self.spark.read.schema(MANIFEST_SCHEMA).parquet(*[x.getPath().toString() for x in found])

    def tampered(self) -> DataFrame:
        return tampered(self.entries(), self.manifests())

    def accepted(self) -> DataFrame:
        return self.entries().filter("status = 'accepted'")

    def verify(self) -> None:
        """No coordinate has two payloads, no event is accepted twice."""
        e = self.entries()
        if not e.groupBy(*COORDINATE).agg(F.count_distinct("fingerprint").alias("p")).filter("p > 1").isEmpty():
            raise LandingConsistencyError("a coordinate was landed with two payloads")
        if not e.filter("status = 'accepted'").groupBy("event_id").agg(F.count_distinct(F.struct(*COORDINATE)).alias("n")).filter("n > 1").isEmpty():
            raise LandingConsistencyError("an event id was accepted at several coordinates")

    def land(self, records: DataFrame, crash: bool = False) -> LandingResult:
        """Lands one batch.  A column `seq`, if there is one, is the order in which records were polled."""
        if "seq" in records.columns:
            if not lag_violations(records).isEmpty():
                raise ValueError(_ORDER)
            records = records.drop("seq")
        batch_scope(records)
        prints = fingerprinted(records)
        known = self.entries().select(*COORDINATE, F.col("fingerprint").alias("_known"))
        joined = prints.join(known, COORDINATE, "left").persist()
        try:
            seen = joined.agg(F.count("*").alias("n"), F.count("_known").alias("reused"), F.count_if(F.col("_known") != F.col("fingerprint")).alias("changed")).first()
            if seen["changed"]:
                raise LandingConsistencyError("a landed coordinate changed its payload or key")
            offsets = tuple(r.asDict() for r in next_offsets(records).collect())  # one topic and partition
            old = self.accepted().count()
            if seen["reused"] == seen["n"]:
                return LandingResult("reused", seen["n"], 0, 0, 0, seen["reused"], old, None, offsets)
            fresh = joined.filter("_known is null").select(*records.columns)
            accepted = self.accepted().select("event_id", *COORDINATE)
            made = classified(fresh, accepted)
            batch, counts = self._write(made)
        finally:
            joined.unpersist()
        if crash:
            raise CrashAfterLanding(batch)
        return LandingResult("landed", seen["n"], counts.get("accepted", 0), counts.get("duplicate_event_id", 0), counts.get("quarantined", 0), seen["reused"], old + counts.get("accepted", 0), batch, offsets)

    def _write(self, made: DataFrame) -> tuple[str, dict[str, int]]:
        staging = f"{self.folder}/.staging/{uuid.uuid4().hex}"
        made.write.parquet(staging)
        written = self.spark.read.schema(made.schema).parquet(staging)
        facts = written.agg(F.min("offset").alias("low"), F.max("offset").alias("high"), F.sum(F.xxhash64("fingerprint").cast("decimal(38,0)")).alias("sum")).first()
        digest = format(abs(int(facts["sum"])) % (1 << 48), "012x")
        batch = f"{facts['low']:020d}-{facts['high']:020d}-{digest}"
        final = self._path(f"{self.folder}/entries/batch={batch}")
        if self._fs.exists(final):
            raise LandingConsistencyError(f"batch {batch} exists already")
        manifest_of(written.withColumn("batch", F.lit(batch))).write.parquet(f"{staging}/{MANIFEST}")
        counts = {r["status"]: r["count"] for r in written.groupBy("status").count().collect()}
        self._fs.mkdirs(final.getParent())
        if not self._fs.rename(self._path(staging), final):
            raise OSError(f"could not rename {staging}")
        return batch, counts

    def stream(self, records: DataFrame, checkpoint: str, crash_once: list | None = None):
        """Structured Streaming: land every available micro-batch, then stop.  `crash_once`, if it has an item, makes
        the next batch fail after its durable write."""

        def each(batch: DataFrame, _: int) -> None:
            if not batch.isEmpty():
                self.land(batch, crash=bool(crash_once) and bool(crash_once.pop()))

        return records.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Log:
    """A log in a folder: one JSON file by produce call, partitions as a column; the local stand-in for a broker."""

    def __init__(self, spark: SparkSession, folder: str, topic: str):
        if not _TOPIC.fullmatch(topic):
            raise ValueError(f"unsafe topic name {topic!r}")
        self.spark, self.folder, self.topic = spark, str(folder).rstrip("/"), topic
        self.path = f"{self.folder}/{topic}"

    def _rows(self) -> DataFrame:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], RECORD_SCHEMA)
        return self.spark.read.schema(RECORD_SCHEMA).parquet(self.path)

    def create(self) -> dict[str, Any]:
        """The topic's folder, if it isn't there; one that holds other than partition 0 is refused."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(p)
        if not self._rows().filter(F.col("partition") != 0).isEmpty():
            raise ValueError(f"topic {self.topic} has more than one partition")
        return {"topic": self.topic, "partition_count": 1}

    def produce_events(self, events: list[dict[str, Any]], at_ms: int | None = None) -> list[dict[str, Any]]:
        """Appends events under their machine's key, none if one breaks the contract; event ids with coordinates."""
        rows = [(str(e.get("machine_id", "")).strip().lower(), canonical(e).encode()) for e in events]
        sent = self.spark.createDataFrame([(bytearray(v),) for _, v in rows], "value binary")
        if bad := judged(sent).filter("error is not null").select("error").first():
            raise ValueError(bad["error"])
        return [{"event_id": e["event_id"].strip(), "topic": self.topic, "partition": 0, "offset": o} for e, o in zip(events, self.produce(rows, at_ms), strict=True)]

    def produce(self, events: list[tuple[str | None, bytes]], at_ms: int | None = None) -> list[int]:
        """Appends (key, value) records in order; all or none.  Returns their offsets."""
        top = self._rows().agg(F.max("offset").alias("m")).first()["m"]
        first = 0 if top is None else top + 1
        rows = [(self.topic, 0, first + i, k, bytearray(v), at_ms) for i, (k, v) in enumerate(events)]
        self.spark.createDataFrame(rows, RECORD_SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
        return [r[2] for r in rows]

    def poll(self, start: int = 0, max_messages: int | None = None) -> DataFrame:
        """Bounded read from an offset; a replay moves no progress.  With max_messages exactly so many, else TimeoutError."""
        got = self._rows().filter(F.col("offset") >= start)
        if max_messages is None:
            return got
        got = got.orderBy("partition", "offset").limit(max_messages)
        if (n := got.count()) != max_messages:
            raise TimeoutError(f"{n} of {max_messages} messages")
        return got

    def stream(self) -> DataFrame:
        return self.spark.readStream.schema(RECORD_SCHEMA).option("maxFilesPerTrigger", 1).parquet(self.path)


def lag_violations(records: DataFrame) -> DataFrame:
    """Records whose offset doesn't exceed the one before in poll order (column `seq`)."""
    before = F.lag("offset").over(Window.partitionBy("topic", "partition").orderBy("seq"))
    return records.withColumn("previous", before).filter("previous is not null and offset <= previous")

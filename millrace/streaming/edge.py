"""Edge sessions: an immutable spool by sequence number, its seal, and the gate before anything downstream."""

from __future__ import annotations

import os
import re
import shutil
import uuid
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.recovery import coverage, missing_sequences
from millrace.sources.files import hash_text, read_json, sync_folder, write_bytes_atomic, write_json
from millrace.streaming.contract import EVENT_SCHEMA, canonical, judged
from millrace.streaming.landing import Landing

_NAME = re.compile(r"[A-Za-z0-9._-]+")
ENTRY_NAME, SEAL_NAME, VERSION = "entry.json", "seal.json", 1


class EdgeError(RuntimeError):
    pass


class EdgeIdentifierError(EdgeError):
    pass


class EdgeConflictError(EdgeError):
    """Another entry is there already."""


class EdgeSealError(EdgeError):
    pass


class EdgeScopeError(EdgeError):
    """More than one machine or date, or not the date asked for."""


class RecoveryIncompleteError(EdgeError):
    pass


@dataclass(frozen=True)
class SealedSession:
    source: str
    session: str
    last: int
    machine_id: str
    business_date: str
    entries: DataFrame  # sequence_no, event_id, fingerprint, event


class Spool:
    """One session's entries: <root>/edge_source_id=S/boot_session_id=B/seq=N/entry.json."""

    def __init__(self, spark: SparkSession, root: str | Path, source: str, session: str):
        for value, what in ((source, "edge_source_id"), (session, "boot_session_id")):
            if not isinstance(value, str) or not _NAME.fullmatch(value):
                raise EdgeIdentifierError(f"unsafe {what}: {value!r}")
        self.spark, self.source, self.session = spark, source, session
        self.path = Path(root) / f"edge_source_id={source}" / f"boot_session_id={session}"
        self.seal_path = self.path / SEAL_NAME

    def _normal(self, event: dict[str, Any]) -> dict[str, Any]:
        row = self.spark.createDataFrame([(bytearray(canonical(event).encode()),)], "value binary")
        row = judged(row).select("event", "error").first()
        if row["error"]:
            raise EdgeError(row["error"])
        return row["event"].asDict()

    def append(self, sequence_no: int, event: dict[str, Any]) -> tuple[str, str]:
        """("appended" or "reused", fingerprint).  The same bytes may come again; anything else at a sequence, the
        same event at another sequence, or any entry after sealing is refused."""
        if isinstance(sequence_no, bool) or not isinstance(sequence_no, int) or sequence_no < 1:
            raise EdgeError("sequence_no must be an integer >= 1")
        doc = {"format_version": VERSION, "edge_source_id": self.source, "boot_session_id": self.session, "sequence_no": sequence_no, "event": self._normal(event)}
        text = canonical(doc)
        if self.seal_path.exists():
            raise EdgeSealError("the session is sealed")
        target = self.path / f"seq={sequence_no:020d}"
        if (target / ENTRY_NAME).exists():
            if (target / ENTRY_NAME).read_text() == text:
                return "reused", hash_text(text)
            raise EdgeConflictError(f"sequence {sequence_no} holds other bytes")
        own = doc["event"]["event_id"]
        if self.path.exists() and (twice := self.entries().filter(F.col("event_id") == own).limit(1).collect()):
            raise EdgeConflictError(f"event {own!r} stands at sequence {twice[0]['sequence_no']}")
        staging = self.path / ".staging" / uuid.uuid4().hex
        try:
            write_bytes_atomic(staging / ENTRY_NAME, text.encode())
            os.replace(staging, target)
            sync_folder(self.path)
        except Exception:
            shutil.rmtree(staging, ignore_errors=True)
            raise
        return "appended", hash_text(text)

    def entries(self) -> DataFrame:
        """sequence_no, event_id, fingerprint, event of every entry.  An entry whose bytes aren't canonical, whose folder
        names another coordinate, or whose event breaks the contract is an error."""
        if not any(self.path.glob("seq=*")):
            return self.spark.createDataFrame([], f"sequence_no bigint, event_id string, fingerprint string, event struct<{EVENT_SCHEMA.replace(' ', ':').replace(',:', ',')}>")
        files = self.spark.read.format("binaryFile").load(str(self.path / "seq=*" / ENTRY_NAME)).select(F.col("path"), F.col("content"))
        text = files.withColumn("text", F.col("content").cast("string"))
        outer = f"struct<boot_session_id:string,edge_source_id:string,event:struct<{', '.join(sorted(EVENT_SCHEMA.split(', '))).replace(' ', ':').replace(',:', ',')}>,format_version:int,sequence_no:bigint>"
        doc = text.withColumn("d", F.from_json("text", outer))
        own = F.regexp_extract("path", r"/edge_source_id=([^/]+)/boot_session_id=([^/]+)/seq=(\d+)/", 3).cast("bigint")
        good = (F.to_json("d") == F.col("text")) & (F.col("d.sequence_no") == own) & (F.col("d.edge_source_id") == self.source) & (F.col("d.boot_session_id") == self.session) & (F.col("d.format_version") == VERSION)
        checked = judged(doc.withColumn("value", F.to_json("d.event").cast("binary")))
        bad = checked.filter(~F.coalesce(good, F.lit(False)) | F.col("error").isNotNull()).select("path").limit(1).collect()
        if bad:
            raise EdgeSealError(f"{bad[0]['path']}: the entry is not what its bytes and place say")
        return checked.select(F.col("d.sequence_no").alias("sequence_no"), F.col("event.event_id").alias("event_id"), F.sha2("content", 256).alias("fingerprint"), "event")

    def _scope(self, entries: DataFrame) -> tuple[str, str]:
        out = []
        for c in ("machine_id", "business_date"):
            found = sorted(r[0] for r in entries.select(F.col(f"event.{c}").alias("v")).distinct().limit(3).collect())
            if len(found) != 1:
                raise EdgeScopeError(f"a session holds exactly one {c}; found {found}")
            out.append(found[0])
        return out[0], out[1]

    def seal(self, last: int) -> dict[str, Any]:
        """Close the session as exactly 1..last."""
        if isinstance(last, bool) or not isinstance(last, int) or last < 1:
            raise EdgeSealError("the last sequence must be an integer >= 1")
        if self.seal_path.exists():
            doc = read_json(self.seal_path)
            if not isinstance(doc, dict) or doc.get("expected_last_sequence") != last:
                raise EdgeSealError("the session is sealed with another last sequence")
            self._validate(doc)
            return doc
        entries = self.entries()
        self._range(entries, last)
        machine, day = self._scope(entries)
        listed = [r.asDict() for r in entries.select("sequence_no", "event_id", "fingerprint").orderBy("sequence_no").collect()]  # one session
        doc = {
            "format_version": VERSION, "edge_source_id": self.source, "boot_session_id": self.session, "expected_last_sequence": last,
            "machine_id": machine, "business_date": day, "sealed_event_count": len(listed), "entries": listed,
        }
        write_json(self.seal_path, doc)
        return doc

    def _range(self, entries: DataFrame, last: int) -> None:
        own = entries.select(F.lit(self.session).alias("session"), "sequence_no")
        gaps = missing_sequences(own, self.spark.createDataFrame([(self.session, last)], "session string, expected_last_sequence bigint"))
        if missing := sorted(r["sequence_no"] for r in gaps.collect()):
            raise EdgeSealError(f"sequences {missing} are absent from the spool")
        if extra := sorted(r["sequence_no"] for r in own.filter(F.col("sequence_no") > last).collect()):
            raise EdgeSealError(f"the spool also holds sequences {extra}")

    def _validate(self, doc: Any) -> DataFrame:
        """The seal against itself and, by a full join, against the spool."""
        if not isinstance(doc, dict) or doc.get("format_version") != VERSION:
            raise EdgeSealError("unusable seal")
        if (doc.get("edge_source_id"), doc.get("boot_session_id")) != (self.source, self.session):
            raise EdgeSealError("the seal is of another session")
        last, listed = doc.get("expected_last_sequence"), doc.get("entries")
        if isinstance(last, bool) or not isinstance(last, int) or last < 1 or not isinstance(listed, list):
            raise EdgeSealError("the seal has no usable range or entries")
        rows = []
        for x in listed:
            if not isinstance(x, dict) or isinstance(x.get("sequence_no"), bool) or not isinstance(x.get("sequence_no"), int) or not isinstance(x.get("event_id"), str) or not isinstance(x.get("fingerprint"), str):
                raise EdgeSealError("a seal entry is unusable")
            rows.append((x["sequence_no"], x["event_id"], x["fingerprint"]))
        if sorted(r[0] for r in rows) != list(range(1, last + 1)):
            raise EdgeSealError(f"a seal declares exactly 1..{last}")
        if doc.get("sealed_event_count") != len(rows):
            raise EdgeSealError("the seal's count is not that of its entries")
        entries = self.entries()
        said = self.spark.createDataFrame(rows, "sequence_no bigint, _event string, _print string")
        both = entries.join(said, "sequence_no", "full").filter("event_id is null or _event is null or event_id != _event or fingerprint != _print")
        if wrong := sorted(r["sequence_no"] for r in both.select("sequence_no").limit(10).collect()):
            raise EdgeSealError(f"seal and spool differ at sequences {wrong}")
        if self._scope(entries) != (doc.get("machine_id"), doc.get("business_date")):
            raise EdgeSealError("the seal's machine or date is not the spool's")
        return entries

    def load(self) -> SealedSession:
        doc = read_json(self.seal_path)
        if doc is None:
            raise EdgeSealError("the session is not sealed")
        entries = self._validate(doc)
        return SealedSession(self.source, self.session, doc["expected_last_sequence"], doc["machine_id"], doc["business_date"], entries)


def session_coverage(sealed: SealedSession, landing: Landing) -> dict[str, Any]:
    """Which sealed events the landing has accepted, by event id."""
    rows = coverage(sealed.entries.select(F.lit(sealed.session).alias("session"), "sequence_no", "event_id"), landing.accepted()).orderBy("sequence_no").collect()  # one session
    found = [r for r in rows if r["covered"]]
    return {
        "edge_source_id": sealed.source, "boot_session_id": sealed.session, "expected_last_sequence": sealed.last,
        "central_accepted_total": landing.accepted().count(),
        "recovered_sequences": [r["sequence_no"] for r in found],
        "missing_sequences": [r["sequence_no"] for r in rows if not r["covered"]],
        "recovery_complete": len(found) == len(rows),
        "sealed_event_ids": [r["event_id"] for r in rows],
        "recovered_coordinates": [{"sequence_no": r["sequence_no"], "event_id": r["event_id"], "kafka_topic": r["topic"], "kafka_partition": r["partition"], "kafka_offset": r["offset"]} for r in found],
    }


def require_recovered(spool: Spool, landing: Landing, business_date: str) -> tuple[SealedSession, dict[str, Any]]:
    """The gate: seal, then date, then coverage; whatever fails does so before any output."""
    sealed = spool.load()
    if business_date != sealed.business_date:
        raise EdgeScopeError(f"the session is of {sealed.business_date}, not {business_date}")
    found = session_coverage(sealed, landing)
    if not found["recovery_complete"]:
        raise RecoveryIncompleteError(f"sequences {found['missing_sequences']} of 1..{sealed.last} are missing")
    return sealed, found

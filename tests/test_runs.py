"""State machines: runs, landing, adapter, edge sessions, snapshots."""

import csv
import json
import random
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from samples import sample_event

from millrace.domain import SOURCE_COLUMNS
from millrace.plans import runs
from millrace.plans.catalog import Catalog, report
from millrace.plans.snapshots import SnapshotTable, check_name, decide
from millrace.sources.files import MissingColumns, csv_bytes, read_csv, read_events_csv, read_json_lines
from millrace.streaming.adapter import AdapterConsistencyError, LandingIntegrityError, NoEligibleEventsError, adapt
from millrace.streaming.contract import canonical
from millrace.streaming.edge import EdgeConflictError, EdgeError, EdgeScopeError, EdgeSealError, RecoveryIncompleteError, Spool
from millrace.streaming.landing import RECORD_SCHEMA, CrashAfterLanding, Landing, LandingConsistencyError, Log, batch_scope, poll_order

DAY = "2026-06-29"


def source_row(i, **over):
    e = sample_event(i)
    return {c: str(e[c]) for c in SOURCE_COLUMNS} | over


def write_csv(path, rows, columns=SOURCE_COLUMNS):
    path.write_bytes(csv_bytes(list(columns), rows))
    return path


def records(spark, events, start=0, topic="machine-events"):
    rows = [(topic, 0, start + i, "k", bytearray(e if isinstance(e, bytes) else canonical(e).encode()), None) for i, e in enumerate(events)]
    return spark.createDataFrame(rows, RECORD_SCHEMA)


def test_medallion_run_and_reuse(spark, tmp_path):
    raw = write_csv(tmp_path / "e.csv", [source_row(1), source_row(2), source_row(2), source_row(3), source_row(4, business_date="2026-06-28")])
    first = runs.medallion(spark, raw, tmp_path / "lake", DAY)
    assert first.status == "processed" and first.passed and first.run["stats"] == {"source_rows": 5, "silver_rows": 3, "gold_rows": 1}
    again = runs.medallion(spark, raw, tmp_path / "lake", DAY)
    assert again.status == "skipped" and again.run["run_id"] == first.run["run_id"] and again.run["reuse_count"] == 1
    told = report(first.run)
    assert [x["name"] for x in told["lineage"]] == ["gold", "silver", "bronze", "source"] and told["quality"]["fail_count"] == 0
    more = write_csv(tmp_path / "f.csv", [source_row(1) | {"note": "x"}], [*SOURCE_COLUMNS, "note"])
    drift = runs.medallion(spark, more, tmp_path / "lake", DAY)
    assert drift.passed and drift.run["schema_drift"]["status"] == "warn"
    bad = runs.medallion(spark, write_csv(tmp_path / "g.csv", [source_row(1, operation="teleport")]), tmp_path / "lake", DAY)
    assert not bad.passed and Catalog(tmp_path / "lake/_catalog").successful(runs.MEDALLION, DAY, bad.run["source"]["hash"]) is None


def test_missing_input_and_columns_are_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        runs.medallion(spark, tmp_path / "absent.csv", tmp_path / "lake", DAY)
    (tmp_path / "x.csv").write_text("a,b\n1,2\n")
    with pytest.raises(MissingColumns, match="business_date"):
        read_events_csv(spark, tmp_path / "x.csv")


def test_file_order_decides(spark, tmp_path):
    rows = [source_row(1, units_produced=str(i)) for i in range(200)]
    got = runs.silver(read_events_csv(spark, write_csv(tmp_path / "e.csv", rows)), "h", DAY).collect()
    assert [r.units_produced for r in got] == [0]


def test_harmonise(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "maps").mkdir()
    for name, unit, t in (("a", "50", "55"), ("b", "130", "131")):
        (tmp_path / f"raw/{name}.csv").write_text(f"day,m,u,d,t,p\n{DAY},e-{name},{unit},1,{t},1.0\n")
        attributes = {"u": {"standard": "units_produced", "type": "int"}, "d": {"standard": "defect_count", "type": "int"}, "t": {"standard": "temperature_c", "type": "float"} | ({"convert": "f_to_c"} if name == "b" else {}), "p": {"standard": "pressure_kpa", "type": "float", "convert": "bar_to_kpa"}}
        (tmp_path / f"maps/{name}.json").write_text(json.dumps({"source_id": name, "source_file": f"{name}.csv", "entity_field": "m", "business_date_field": "day", "attributes": attributes}))
    run = runs.harmonise(spark, tmp_path / "raw", tmp_path / "maps", tmp_path / "lake")
    assert run.passed and [x["name"] for x in run.run["layers"]] == ["bronze", "silver_eav", "gold"]
    gold = spark.read.parquet(run.run["layers"][-1]["path"]).orderBy("entity_id").collect()
    assert [(r.units_produced, r.temperature_c, r.pressure_kpa) for r in gold] == [(50, 55.0, 100.0), (130, 55.0, 100.0)]
    assert runs.harmonise(spark, tmp_path / "raw", tmp_path / "maps", tmp_path / "lake").status == "skipped"


def test_catalog_versions(spark, tmp_path):
    c = Catalog(tmp_path / "cat")
    p = write_csv(tmp_path / "e.csv", [source_row(1)])
    assert c.register(spark, "d", p, "what")["version"] == c.register(spark, "d", p)["version"] == "v1"
    write_csv(p, [])
    assert c.register(spark, "d", p)["version"] == "v2" and c.dataset("d")["description"] == "what"
    assert {s["type"] for s in c.dataset("d")["versions"][1]["schema"]} == {"unknown"} and c.dataset("none") is None


def refused(**over):
    return sample_event(1) | over


@pytest.mark.parametrize(
    ("event", "error"),
    [
        (refused(schema_version=2), "unsupported schema_version=2; expected 1"),
        (refused(event_time="2026-06-29T08:00:00"), "event_time must include a timezone"),
        (refused(event_time="soon"), "event_time must be an ISO timestamp"),
        (refused(business_date="2026-02-30"), "business_date must be an ISO date"),
        (refused(defect_count=11), "defect_count must be <= units_produced"),
        (refused(operation="teleport"), "operation must be one of ['assembly', 'calibration', 'inspection', 'machining', 'packaging', 'welding']"),
        (refused(units_produced=True), "units_produced must be an integer"),
        (refused(units_produced=1.0), "units_produced must be an integer"),
        (refused(plant_id=" "), "plant_id must be a non-empty string"),
        (refused(plant_id=None), "plant_id must be a non-empty string"),
        (refused(more=1), "unknown fields for schema v1: more"),
        (b'{"event_id":"broken"}', "missing required fields: business_date, cycle_time_ms"),
        (b"[1]", "event payload must be a JSON object"),
        (b"{", "value is not JSON"),
        (b"\xff\xfe", "value is not UTF-8"),
    ],
)
def test_contract(spark, event, error):
    from millrace.streaming.contract import judged

    row = judged(records(spark, [event])).first()
    assert row.error.startswith(error) and row.event is None


def test_contract_normalises(spark):
    from millrace.streaming.contract import judged

    row = judged(records(spark, [refused(machine_id=" MC-101 ", event_id=" Evt ")])).first()
    assert row.error is None and row.event.machine_id == "mc-101" and row.event.event_id == "Evt"


def test_landing(spark, tmp_path):
    land = Landing(spark, tmp_path / "landing")
    two = records(spark, [sample_event(1), sample_event(2)])
    r = land.land(two)
    assert (r.status, r.accepted_count, r.committable_offsets[0]["next_offset"]) == ("landed", 2, 2)
    r = land.land(two)
    assert (r.status, r.reused_coordinate_count, r.accepted_total, r.batch_id) == ("reused", 2, 2, None)
    r = land.land(records(spark, [sample_event(1), b'{"event_id":"broken"}'], 5))
    assert (r.duplicate_event_count, r.quarantine_count, r.accepted_total, r.committable_offsets[0]["next_offset"]) == (1, 1, 2, 7)
    dup = land.entries().filter("status = 'duplicate_event_id'").first()
    assert dup.duplicate_of.offset == 0
    with pytest.raises(LandingConsistencyError):
        land.land(records(spark, [sample_event(9)], 0))
    with pytest.raises(CrashAfterLanding):
        land.land(records(spark, [sample_event(3)], 7), crash=True)
    assert land.land(records(spark, [sample_event(3)], 7)).status == "reused"
    land.verify()


def test_batch_scope(spark):
    with pytest.raises(ValueError, match="at least one"):
        batch_scope(records(spark, []))
    with pytest.raises(ValueError, match="one topic"):
        batch_scope(records(spark, [sample_event(1)]).unionByName(records(spark, [sample_event(2)], topic="other")))
    with pytest.raises(ValueError, match="unsafe"):
        batch_scope(records(spark, [sample_event(1)], topic="a/b"))
    with pytest.raises(ValueError, match="repeats"):
        batch_scope(records(spark, [sample_event(1)]).unionByName(records(spark, [sample_event(1)])))
    with pytest.raises(LandingConsistencyError):
        batch_scope(records(spark, [sample_event(1)]).unionByName(records(spark, [sample_event(2)])))
    with pytest.raises(ValueError):
        poll_order([1, 0])
    poll_order([1, 5, 9])


def test_stream_survives_a_crash(spark, tmp_path):
    log, land = Log(spark, tmp_path / "log", "machine-events"), Landing(spark, tmp_path / "landing")
    log.produce([("k", canonical(sample_event(i)).encode()) for i in (1, 2)])
    log.produce([("k", canonical(sample_event(i)).encode()) for i in (2, 3)])
    with pytest.raises(Exception, match="CrashAfterLanding"):
        land.stream(log.stream(), str(tmp_path / "cp"), [True]).awaitTermination()
    land.stream(log.stream(), str(tmp_path / "cp")).awaitTermination()
    assert land.accepted().count() == 3 and land.entries().count() == 4
    land.verify()
    assert log.poll(1).count() == 3
    with pytest.raises(TimeoutError):
        log.poll(0, 9)


def test_adapter(spark, tmp_path):
    land = Landing(spark, tmp_path / "landing")
    land.land(records(spark, [sample_event(2), sample_event(1), sample_event(3) | {"business_date": "2026-06-30"}]))
    a = adapt(land, DAY, tmp_path / "out")
    assert a.status == "created" and a.selected_event_count == 2
    lines = a.csv_path.read_text().split("\n")
    assert lines[0].startswith("event_time,plant_id") and lines[1].split(",")[7] == "20" and len(lines) == 4
    assert adapt(land, DAY, tmp_path / "out").status == "reused"
    with pytest.raises(NoEligibleEventsError):
        adapt(land, "2026-01-01", tmp_path / "out")
    with pytest.raises(ValueError):
        adapt(land, "20260629", tmp_path / "out")
    a.csv_path.write_text("tampered")
    with pytest.raises(AdapterConsistencyError):
        adapt(land, DAY, tmp_path / "out")
    other = Landing(spark, tmp_path / "two")
    other.land(records(spark, [sample_event(1)]))
    other.land(records(spark, [sample_event(2)], topic="second"))
    with pytest.raises(LandingIntegrityError):
        adapt(other, DAY, tmp_path / "out2")


def test_batch_grouping_does_not_change_the_hash(spark, tmp_path):
    one, two = Landing(spark, tmp_path / "l1"), Landing(spark, tmp_path / "l2")
    one.land(records(spark, [sample_event(1), sample_event(2)]))
    two.land(records(spark, [sample_event(1)]))
    two.land(records(spark, [sample_event(2)], 1))
    assert adapt(one, DAY, tmp_path / "o1").source_hash == adapt(two, DAY, tmp_path / "o2").source_hash
    with pytest.raises(AdapterConsistencyError):
        adapt(two, DAY, tmp_path / "o1")


def test_publish_states(spark, tmp_path):
    table = SnapshotTable(spark, tmp_path / "wh", "local.gold.metrics").create()

    def csv_of(name, events):
        land = Landing(spark, tmp_path / name)
        land.land(records(spark, events))
        return adapt(land, events[0]["business_date"], tmp_path / f"{name}-out").csv_path

    other = [sample_event(9) | {"business_date": "2026-06-28"}]
    assert runs.publish_batch(spark, csv_of("o", other), "2026-06-28", table)["status"] == "published"
    a = csv_of("a", [sample_event(1), sample_event(2), sample_event(3)])
    first = runs.publish_batch(spark, a, DAY, table)
    row = table.read().filter(f"business_date = '{DAY}'").first()
    assert first["status"] == "published" and (row.units_produced, row.defect_count, row.defect_rate, row.avg_cycle_time_ms) == (60, 3, 0.05, 820.0)
    retry = runs.publish_batch(spark, a, DAY, table)
    assert retry["status"] == "skipped" and retry["gold_snapshot_id"] == first["gold_snapshot_id"] and len(table.history()) == 2
    b = csv_of("b", [sample_event(1) | {"units_produced": 150, "defect_count": 6, "cycle_time_ms": 850}])
    assert runs.publish_batch(spark, b, DAY, table)["snapshot_count"] == 3
    rows = {r.business_date: r for r in table.read().collect()}
    assert (rows[DAY].units_produced, rows[DAY].defect_rate, rows[DAY].avg_cycle_time_ms) == (150, 0.04, 850.0) and rows["2026-06-28"].units_produced == 90
    assert table.read(first["gold_snapshot_id"]).filter(f"business_date = '{DAY}'").first().units_produced == 60
    before = len(table.history())
    bad = write_csv(tmp_path / "bad.csv", [source_row(1, defect_count="99")])
    with pytest.raises(Exception):
        runs.publish_batch(spark, bad, DAY, table)  # no canonical columns
    assert len(table.history()) == before
    with pytest.raises(runs.BusinessDateMismatchError):
        runs.publish_batch(spark, a, "2026-06-28", table)
    wiped = SnapshotTable(spark, tmp_path / "wh2", "local.gold.metrics").create()
    assert runs.publish_batch(spark, a, DAY, wiped)["status"] == "published"
    table.overwrite_partitions(table.read().limit(0))
    assert table.read().count() == 2


def test_decisions_and_names():
    assert decide({"source_hash": "h", "snapshot_id": 1}, "h", [1, 2]) == "skip"
    assert {decide(None, "h", []), decide({"source_hash": "h", "snapshot_id": 3}, "h", [1]), decide({"source_hash": "x", "snapshot_id": 1}, "h", [1])} == {"write"}
    for bad in ("a.b", "a.b.c;", ""):
        with pytest.raises(ValueError):
            check_name(bad)
    assert [runs.relation_of(s) for s in ("published", "skipped", "quality_failed")] == ["created_by_current_attempt", "reused_from_prior_attempt", "no_snapshot"]
    with pytest.raises(runs.UnexpectedStatusError):
        runs.relation_of("other")


def test_edge_session_to_publish(spark, tmp_path):
    spool = Spool(spark, tmp_path / "spool", "edge-1", "boot-1")
    for i in (1, 3):
        assert spool.append(i, sample_event(i))[0] == "appended"
    assert spool.append(1, sample_event(1))[0] == "reused"
    with pytest.raises(EdgeConflictError):
        spool.append(1, sample_event(7))
    with pytest.raises(EdgeConflictError):
        spool.append(5, sample_event(3))
    with pytest.raises(EdgeError):
        spool.append(0, sample_event(1))
    with pytest.raises(EdgeSealError, match=r"\[2\]"):
        spool.seal(3)
    spool.append(2, sample_event(2))
    doc = spool.seal(3)
    assert (doc["machine_id"], doc["business_date"], doc["sealed_event_count"]) == ("mc-101", DAY, 3) and spool.seal(3) == doc
    with pytest.raises(EdgeSealError):
        spool.append(4, sample_event(4))
    land, table = Landing(spark, tmp_path / "landing"), SnapshotTable(spark, tmp_path / "wh", "local.gold.metrics").create()
    land.land(records(spark, [sample_event(1), sample_event(2)]))
    with pytest.raises(RecoveryIncompleteError, match=r"\[3\]"):
        runs.publish_recovered(spark, spool, land, DAY, tmp_path / "ad", table)
    with pytest.raises(EdgeScopeError):
        runs.publish_recovered(spark, spool, land, "2026-06-30", tmp_path / "ad", table)
    assert not (tmp_path / "ad").exists() and not table.history()
    land.land(records(spark, [sample_event(1), sample_event(2), sample_event(3)], 2))
    told = runs.publish_recovered(spark, spool, land, DAY, tmp_path / "ad", table)
    assert told["status"] == "published" and [c["kafka_offset"] for c in told["log"]["recovered_coordinates"]] == [0, 1, 4]
    assert runs.publish_recovered(spark, spool, land, DAY, tmp_path / "ad", table)["table"]["snapshot_relation"] == "reused_from_prior_attempt"
    land.land(records(spark, [sample_event(8)], 9))
    with pytest.raises(runs.SessionInputMismatchError, match="extra"):
        runs.publish_recovered(spark, spool, land, DAY, tmp_path / "ad2", table)
    text = json.loads(spool.seal_path.read_text())
    spool.seal_path.write_text(json.dumps(text | {"machine_id": "mc-9"}))
    with pytest.raises(EdgeSealError):
        spool.load()


def test_mixed_session_is_refused(spark, tmp_path):
    spool = Spool(spark, tmp_path, "e", "b")
    spool.append(1, sample_event(1))
    spool.append(2, sample_event(2) | {"machine_id": "mc-2"})
    with pytest.raises(EdgeScopeError):
        spool.seal(2)
    with pytest.raises(EdgeError):
        Spool(spark, tmp_path, "../e", "b")


def test_json_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\nnope\n[2]\n{"a": 3}\n')
    good, bad = read_json_lines(spark, tmp_path / "x.jsonl", "a int")
    assert sorted(r.a for r in good.collect()) == [1, 3] and sorted((r.line, r.value) for r in bad.collect()) == [(3, "nope"), (4, "[2]")]


def test_csv_equals_the_csv_module(spark, tmp_path):
    rng = random.Random(5)
    for k, pieces in enumerate((["a", '"', '""', ",", "\\", " ", "é", '\\"', "'", ""], ["a", '"', "\n", "\r\n", ",", "\\", " "])):
        rows = [["".join(rng.choice(pieces) for _ in range(rng.randrange(6))) for _ in range(3)] for _ in range(120)]
        rows = [["id", *r] for r in rows]  # no row is a blank line
        path = tmp_path / f"{k}.csv"
        with open(path, "w", newline="", encoding="utf-8") as f:
            csv.writer(f, lineterminator="\n").writerows([["i", "x", "y", "z"], *rows])
        with open(path, newline="", encoding="utf-8") as f:
            want = [tuple(r) for r in csv.reader(f)][1:]
        got = [tuple(r)[:4] for r in read_csv(spark, path, ordinal=True).orderBy("_ordinal").collect()]
        assert got == want


def _tamper(spark, land, change):
    """Rewrites the entries of the only batch, not its manifest."""
    batch = next((land_dir := Path(land.folder) / "entries").glob("batch=*"))
    made = change(land.entries().drop("batch"))
    made.coalesce(1).write.parquet(str(land_dir.parent / "changed"))
    for f in batch.glob("*part-*"):
        f.unlink()
    for f in batch.glob(".part-*"):
        f.unlink()
    for f in (land_dir.parent / "changed").glob("part-*"):
        shutil.copy(f, batch / f.name)


@pytest.mark.parametrize(
    ("sql", "problem"),
    [
        ("update event.event_id", "event_id"), ("key", "key"), ("timestamp_ms", "timestamp_ms"), ("offset", "missing|undeclared"), ("drop", "missing"), ("units", "event_digest"),
    ],
)
def test_a_changed_landing_is_refused(spark, tmp_path, sql, problem):
    from pyspark.sql import functions as F

    land = Landing(spark, tmp_path / "landing")
    land.land(records(spark, [sample_event(1), sample_event(2)]))
    first = F.col("offset") == 0
    change = {
        "update event.event_id": lambda d: d.withColumn("event_id", F.when(first, "evt-x").otherwise(F.col("event_id"))).withColumn("event", F.col("event").withField("event_id", F.col("event_id"))),
        "key": lambda d: d.withColumn("key", F.when(first, "other").otherwise(F.col("key"))),
        "timestamp_ms": lambda d: d.withColumn("timestamp_ms", F.when(first, F.lit(7)).otherwise(F.col("timestamp_ms"))),
        "offset": lambda d: d.withColumn("offset", F.when(first, F.lit(9)).otherwise(F.col("offset"))),
        "drop": lambda d: d.filter(~first),
        "units": lambda d: d.withColumn("event", F.col("event").withField("units_produced", F.lit(99).cast("bigint"))),
    }[sql]
    assert land.tampered().isEmpty()
    _tamper(spark, land, change)
    with pytest.raises(LandingIntegrityError, match=problem):
        adapt(land, DAY, tmp_path / "out")


def test_offsets_follow_the_poll_order(spark, tmp_path):
    from pyspark.sql import functions as F

    land = Landing(spark, tmp_path / "landing")
    two = records(spark, [sample_event(1), sample_event(2)])
    with pytest.raises(ValueError, match="poll order"):
        land.land(two.withColumn("seq", -F.col("offset")))
    assert land.land(two.withColumn("seq", F.col("offset"))).accepted_count == 2


def test_topic_and_keys(spark, tmp_path):
    log = Log(spark, tmp_path, "machine-events")
    assert log.create() == log.create() == {"topic": "machine-events", "partition_count": 1}
    assert [x["offset"] for x in log.produce_events([sample_event(1), sample_event(2)])] == [0, 1]
    assert {r.key for r in log.poll().collect()} == {"mc-101"}
    with pytest.raises(ValueError, match="schema_version"):
        log.produce_events([sample_event(3), sample_event(4) | {"schema_version": 2}])
    assert log.poll().count() == 2


def test_failed_quality_leaves_the_table_alone(spark, tmp_path):
    table = SnapshotTable(spark, tmp_path / "wh", "local.gold.metrics").create()
    land = Landing(spark, tmp_path / "l")
    land.land(records(spark, [sample_event(1)]))
    good = adapt(land, DAY, tmp_path / "out").csv_path
    runs.publish_batch(spark, good, DAY, table)
    bad = tmp_path / "bad.csv"
    head, row = good.read_text().split("\n")[:2]
    at = head.split(",").index("defect_count")
    bad.write_text(head + "\n" + ",".join("99" if i == at else x for i, x in enumerate(row.split(","))) + "\n")
    before = table.history()
    told = runs.publish_batch(spark, bad, DAY, table)
    assert told["status"] == "quality_failed" and table.history() == before and table.read().first().defect_count == 0


def test_command_line(spark, tmp_path, capsys):
    from millrace import cli

    raw = write_csv(tmp_path / "e.csv", [source_row(1), source_row(2)])
    assert cli.main(["medallion", "--input", str(raw), "--output", str(tmp_path / "lake"), "--business-date", DAY], spark) == 0
    run = json.loads(capsys.readouterr().out)
    assert run["status"] == "processed" and run["passed"]
    assert cli.main(["report", "--output", str(tmp_path / "lake")], spark) == 0
    assert json.loads(capsys.readouterr().out)["run_id"] == run["run_id"]
    bad = write_csv(tmp_path / "f.csv", [source_row(1, operation="teleport")])
    assert cli.main(["medallion", "--input", str(bad), "--output", str(tmp_path / "lake"), "--business-date", DAY], spark) == 1
    assert cli.main(["medallion", "--input", str(tmp_path / "none.csv"), "--output", str(tmp_path / "lake")], spark) == 2


def test_entry_without_llm():
    """Without the subpackage the other queries are there; a module that the subpackage lacks is an error."""
    code = """
import sys
from pathlib import Path
class Absent:
    def find_spec(self, name, *_):
        if name == sys.argv[1]:
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Absent())
import __spark_entry__ as e
print(sum(n.startswith("op") or n == "pipeline" for n in e.queries()), "gold_daily_line_metrics" in e.queries(), set(e.oracle_sql()) <= set(e.queries()))
"""
    run = lambda name: subprocess.run([sys.executable, "-c", code, name], capture_output=True, text=True)
    assert run("corpus_pipeline").stdout.split() == ["0", "True", "True"]
    assert run("numpy").returncode == 0 or "numpy" in run("numpy").stderr

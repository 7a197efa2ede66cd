"""Operators against literal results and small models written here."""

import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.domain import SOURCE_COLUMNS
from millrace.functions import expr as X
from millrace.operators import eav as E
from millrace.operators import medallion as M
from millrace.operators import profile as P
from millrace.operators import quality as Q
from millrace.operators import recovery as R
from millrace.sources.files import ORDINAL

DAY = "2026-06-29"


def event(i=1, **over):
    row = {
        "event_time": f"{DAY}T08:{i:02d}:00Z", "plant_id": "Plant-A ", "line_id": "L1", "work_order_id": f"WO-{i}", "machine_id": "MC-1", "product_code": "Gear",
        "operation": "assembly", "units_produced": str(10 * i), "defect_count": str(i - 1), "cycle_time_ms": str(800 + 10 * i), "business_date": DAY,
    }
    return row | over


def frame(spark, rows):
    data = [tuple(r[c] for c in SOURCE_COLUMNS) + (i,) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, ", ".join(f"{c} string" for c in SOURCE_COLUMNS) + f", {ORDINAL} int")


def by_name(checks):
    return {c["name"]: c for c in checks}


def test_rounding_is_that_of_exact_binary_values(spark):
    rng = random.Random(5)
    pairs = [(32107, 40, 2)] + [(rng.randrange(2000), rng.randrange(1, 800), rng.choice([2, 4, 6])) for _ in range(3000)]
    df = spark.createDataFrame(pairs, "a int, b int, d int")
    for d in (2, 4, 6):
        for r in df.filter(f"d = {d}").withColumn("x", X.py_round(F.col("a") / F.col("b"), d)).collect():
            assert r.x == round(r.a / r.b, d)
    special = spark.createDataFrame([(float("inf"),), (float("nan"),), (None,)], "v double").select(X.py_round(F.col("v"), 2)).collect()
    assert math.isinf(special[0][0]) and math.isnan(special[1][0]) and special[2][0] is None


def test_strip_knows_unicode_blanks(spark):
    df = spark.createDataFrame([("\t a ",), ("",)], "v string").select(X.py_strip(F.col("v")))
    assert [r[0] for r in df.collect()] == ["a", ""]


def test_silver_filters_dedups_and_normalises(spark):
    rows = [event(1), event(1, units_produced="99"), event(2), event(3, business_date="2026-06-28")]
    got = M.silver(frame(spark, rows), "h", DAY).orderBy("work_order_id").collect()
    assert [(r.work_order_id, r.units_produced, r.plant_id, r.source_hash) for r in got] == [("wo-1", 10, "plant-a", "h"), ("wo-2", 20, "plant-a", "h")]


def test_strict_integers_fail(spark):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|invalid"):
        M.silver(frame(spark, [event(1, units_produced="12.7")]), "h", DAY).collect()


def test_gold_metrics(spark):
    got = M.gold(M.silver(frame(spark, [event(1), event(2), event(3)]), "h", DAY)).collect()
    assert [(r.units_produced, r.defect_count, r.defect_rate, r.avg_cycle_time_ms, r.closing_status) for r in got] == [(60, 3, 0.05, 820.0, "provisional")]
    none = M.gold_or_sentinel(M.silver(frame(spark, []), "h", DAY), DAY).collect()
    assert len(none) == 1 and (none[0].business_date, none[0].plant_id, none[0].units_produced, none[0].defect_rate) == (DAY, "", 0, 0.0)
    assert len(M.gold_or_sentinel(M.silver(frame(spark, [event(1)]), "h", DAY), DAY).collect()) == 1


def test_zero_units_give_rate_zero(spark):
    assert M.gold(M.silver(frame(spark, [event(1, units_produced="0", defect_count="0")]), "", DAY)).first().defect_rate == 0.0


@pytest.mark.parametrize(
    ("over", "name"),
    [
        ({"operation": "teleport"}, "accepted_values_operation"),
        ({"defect_count": "99"}, "numeric_range_within_bounds"),
        ({"plant_id": ""}, "not_null_required_columns"),
        ({"cycle_time_ms": "0"}, "numeric_range_within_bounds"),
    ],
)
def test_each_check_fails_for_its_reason(spark, over, name):
    src = frame(spark, [event(1, **over), event(2)])
    s = M.silver(src, "", DAY)
    checks = by_name(Q.medallion_checks(src, s, M.gold(s), DAY))
    assert checks[name]["status"] == "fail" and not Q.passed(list(checks.values()))
    assert all(c["status"] == "pass" for n, c in checks.items() if n != name)


def test_checks_pass_and_reconcile(spark):
    src = frame(spark, [event(1), event(1), event(2), event(3), event(4, business_date="2026-06-28")])
    s = M.silver(src, "", DAY)
    checks = by_name(Q.medallion_checks(src, s, M.gold(s), DAY))
    assert Q.passed(list(checks.values()))
    assert checks["row_count_source_to_silver"]["expected"] == checks["row_count_source_to_silver"]["actual"] == 3


def test_uniqueness_is_judged_on_normalised_keys(spark):
    src = frame(spark, [event(1), event(1, work_order_id="wo-1")])
    s = M.silver(src, "", DAY)
    assert s.count() == 2
    assert by_name(Q.medallion_checks(src, s, M.gold(s), DAY))["unique_natural_key"]["actual"] == 1


def test_bad_date_and_drift():
    assert not Q.valid_date("not-a-date") and not Q.valid_date("2026-02-30") and Q.valid_date(DAY)
    assert [Q.drift_check(*a)["status"] for a in ((None, "a"), ("a", "a"), ("b", "a"))] == ["pass", "pass", "warn"]
    assert Q.drift_check("b", "a", "fail")["status"] == "fail"


def test_column_types(spark):
    df = spark.createDataFrame([("1", "1.5", "2026-06-29T08:00:00Z", "x", ""), ("-2", "nan", "2026-06-29", "1", "")], "i string, f string, d string, s string, e string")
    assert P.infer_schema(df) == [{"name": n, "type": t} for n, t in zip("ifdse", ["integer", "float", "datetime", "string", "string"])]
    assert P.null_counts(df) == {"e": 2}
    assert {c["type"] for c in P.infer_schema(df.limit(0))} == {"unknown"}


MAPPING = {"source_id": "b", "source_file": "b.csv", "entity_field": "m", "business_date_field": "d", "attributes": {"u": {"standard": "units_produced", "type": "int"}, "q": {"standard": "defect_count", "type": "int"}, "t": {"standard": "temperature_c", "type": "float", "convert": "f_to_c"}, "p": {"standard": "pressure_kpa", "type": "float", "convert": "bar_to_kpa"}}}


def test_eav_converts_and_keeps_errors(spark):
    wide = spark.createDataFrame([(" e1 ", DAY, "100", "1", "131", "1.0"), ("e1", DAY, "not-a-number", "", "134.6", "nan"), ("e1", DAY, "80.5", "5d", "1_0", "inf")], "m string, d string, u string, q string, t string, p string")
    rows = E.to_eav(wide, MAPPING).collect()
    value = {(r.attribute, r.raw): (r.value, r.type_error) for r in rows}
    assert value[("temperature_c", "131")] == (55.0, False) and value[("pressure_kpa", "1.0")] == (100.0, False)
    assert value[("units_produced", "not-a-number")] == (None, True) and value[("defect_count", "")] == (None, False)
    assert value[("units_produced", "80.5")] == (80.0, False) and value[("defect_count", "5d")] == (None, True)
    assert value[("pressure_kpa", "nan")] == (None, True) and value[("pressure_kpa", "inf")] == (None, True)
    assert value[("temperature_c", "1_0")] == (round((10 - 32) * 5 / 9, 4), False)
    assert {r.entity_id for r in rows} == {"e1"}


def test_eav_gold_and_checks(spark):
    wide = spark.createDataFrame([("e1", DAY, "100", "1", "131", "1.0", "x"), ("e1", DAY, "120", "2", "134.6", "1.0", "x"), ("e2", "2026-06-28", "1", "0", "100", "1", "x")], "m string, d string, u string, q string, t string, p string, extra string")
    eav = E.to_eav(wide, MAPPING)
    gold = E.eav_gold_or_sentinel(eav, DAY)
    r = gold.collect()
    assert [(x.entity_id, x.units_produced, x.defect_count, x.temperature_c, x.pressure_kpa, x.reading_count) for x in r] == [("e1", 220, 3, 56.0, 100.0, 2)]
    checks = by_name(Q.eav_checks([(wide, MAPPING)], eav, gold, DAY))
    assert Q.passed(list(checks.values())) and checks["unmapped_source_columns"]["status"] == "warn"
    assert checks["freshness_business_date"]["actual"]["other_dates_in_eav"] == ["2026-06-28"]
    less = MAPPING | {"attributes": {k: v for k, v in MAPPING["attributes"].items() if k != "p"}}
    assert by_name(Q.eav_checks([(wide, less)], eav, gold, DAY))["mapping_coverage"]["status"] == "fail"
    assert E.eav_gold_or_sentinel(eav, "2020-01-01").collect()[0].entity_id == ""


def test_recovery_operators(spark):
    present = spark.createDataFrame([("s", 1), ("s", 3)], "session string, sequence_no bigint")
    last = spark.createDataFrame([("s", 4)], "session string, expected_last_sequence bigint")
    assert sorted(r.sequence_no for r in R.missing_sequences(present, last).collect()) == [2, 4]
    a, b = (spark.createDataFrame([(x,) for x in v], "event_id string") for v in ("ab", "bc"))
    assert sorted(map(tuple, R.set_mismatch(a, b).collect())) == [("a", "missing"), ("c", "extra")]
    ask = spark.createDataFrame([("d1", "h"), ("d2", "h"), ("d3", "h")], "business_date string, source_hash string")
    state = spark.createDataFrame([("d1", "h", 1), ("d2", "h", 2), ("d3", "x", 1)], "business_date string, source_hash string, snapshot_id bigint")
    known = spark.createDataFrame([(1,)], "snapshot_id bigint")
    assert sorted((r.business_date, r.action) for r in R.publish_decision(ask, state, known).collect()) == [("d1", "skip"), ("d2", "write"), ("d3", "write")]


def test_versions_number_beyond_nine(spark):
    df = spark.createDataFrame([("d", f"h{i}", i) for i in range(12)] + [("d", "h0", 99)], "dataset_id string, source_hash string, at int")
    got = {r.source_hash: (r.version, r.registrations) for r in P.dataset_versions(df).collect()}
    assert got["h0"] == ("v1", 2) and got["h10"] == ("v11", 1)

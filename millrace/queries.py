"""Queries over the driver's tables, one for each operator, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.domain import ACCEPTED_OPERATIONS, NATURAL_KEY, STANDARD_ATTRIBUTES
from millrace.functions.expr import is_iso_date, record_fingerprint
from millrace.operators import eav as E
from millrace.operators import medallion as M
from millrace.operators import profile as P
from millrace.operators import quality as Q
from millrace.operators import recovery as R
from millrace.sources import star
from millrace.streaming import landing as L

Query = Callable[[SparkSession, str], DataFrame]
_found: dict[str, tuple[Query, str]] = {}

SILVER_SQL = (
    star.SOURCE_SQL
    + """,
silver AS (
  SELECT event_time, business_date, lower(trim(plant_id)) AS plant_id, lower(trim(line_id)) AS line_id, lower(trim(work_order_id)) AS work_order_id,
    lower(trim(machine_id)) AS machine_id, lower(trim(product_code)) AS product_code, lower(trim(operation)) AS operation, units_produced, defect_count, cycle_time_ms
  FROM (SELECT *, row_number() OVER (PARTITION BY business_date, work_order_id, machine_id, event_time
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn FROM src) WHERE rn = 1
)"""
)
GOLD_SQL = (
    SILVER_SQL
    + """,
gold AS (
  SELECT business_date, plant_id, line_id, product_code, sum(units_produced)::BIGINT AS units_produced, sum(defect_count)::BIGINT AS defect_count,
    CASE WHEN sum(units_produced) = 0 THEN 0.0 ELSE printf('%.6f', sum(defect_count)::DOUBLE / sum(units_produced)::DOUBLE)::DOUBLE END AS defect_rate,
    printf('%.2f', sum(cycle_time_ms)::DOUBLE / count(*)::DOUBLE)::DOUBLE AS avg_cycle_time_ms, 'provisional' AS closing_status
  FROM silver GROUP BY ALL
)"""
)
EAV_GOLD_SQL = (
    star.WIDE_SQL
    + """,
eav_gold AS (
  SELECT business_date, entity_id, units_produced, defect_count, temperature_c, pressure_kpa,
    CASE WHEN units_produced = 0 THEN 0.0 ELSE printf('%.6f', defect_count::DOUBLE / units_produced::DOUBLE)::DOUBLE END AS defect_rate, reading_count
  FROM (
    SELECT business_date, entity_id, coalesce(sum(value) FILTER (attribute = 'units_produced'), 0)::BIGINT AS units_produced,
      coalesce(sum(value) FILTER (attribute = 'defect_count'), 0)::BIGINT AS defect_count,
      coalesce(printf('%.4f', sum(value) FILTER (attribute = 'temperature_c') / count(*) FILTER (attribute = 'temperature_c'))::DOUBLE, 0.0) AS temperature_c,
      coalesce(printf('%.4f', sum(value) FILTER (attribute = 'pressure_kpa') / count(*) FILTER (attribute = 'pressure_kpa'))::DOUBLE, 0.0) AS pressure_kpa,
      greatest(count(*) FILTER (attribute = 'units_produced'), count(*) FILTER (attribute = 'defect_count'),
        count(*) FILTER (attribute = 'temperature_c'), count(*) FILTER (attribute = 'pressure_kpa')) AS reading_count
    FROM eav WHERE value IS NOT NULL GROUP BY business_date, entity_id
  )
)"""
)


def query(sql: str):
    def keep(f: Query) -> Query:
        _found[f.__name__] = (f, sql)
        return f

    return keep


def _silver(spark: SparkSession, sf: str) -> DataFrame:
    return M.silver(star.source_events(spark, sf), "").drop("source_hash")


def _text(c: str):
    return F.col(c).cast("string")


@query(f"WITH {GOLD_SQL} SELECT * FROM gold")
def gold_daily_line_metrics(spark, sf):
    return M.gold(_silver(spark, sf))


@query(f"WITH {SILVER_SQL} SELECT * FROM silver")
def silver_events(spark, sf):
    return _silver(spark, sf)


@query(f"""WITH {star.SOURCE_SQL}, k AS (SELECT business_date, count(*) AS n FROM src GROUP BY business_date, work_order_id, machine_id, event_time)
SELECT business_date, sum(n - 1)::BIGINT AS dropped_rows, count(*) FILTER (n > 1) AS repeated_keys FROM k GROUP BY 1 HAVING sum(n - 1) > 0""")
def natural_key_duplicates(spark, sf):
    return M.duplicates(star.source_events(spark, sf))


@query(f"""WITH {SILVER_SQL}, a AS (SELECT business_date, count(DISTINCT (work_order_id, machine_id, event_time)) AS expected FROM src GROUP BY 1),
b AS (SELECT business_date, count(*) AS actual FROM silver GROUP BY 1)
SELECT business_date, expected, actual, CASE WHEN expected = actual THEN 'pass' ELSE 'fail' END AS status FROM a JOIN b USING (business_date)""")
def recon_source_to_silver(spark, sf):
    src = star.source_events(spark, sf)
    a = src.groupBy("business_date").agg(F.count_distinct(F.struct(*NATURAL_KEY)).alias("expected"))
    b = _silver(spark, sf).groupBy("business_date").agg(F.count("*").alias("actual"))
    return a.join(b, "business_date").withColumn("status", F.when(F.col("expected") == F.col("actual"), "pass").otherwise("fail"))


@query(f"""WITH {GOLD_SQL}, a AS (SELECT business_date, sum(units_produced)::BIGINT AS silver_units, sum(defect_count)::BIGINT AS silver_defects FROM silver GROUP BY 1),
b AS (SELECT business_date, sum(units_produced)::BIGINT AS gold_units, sum(defect_count)::BIGINT AS gold_defects FROM gold GROUP BY 1)
SELECT *, silver_units = gold_units AND silver_defects = gold_defects AS conserved FROM a JOIN b USING (business_date)""")
def unit_conservation(spark, sf):
    s = _silver(spark, sf)
    total = lambda df, n: df.groupBy("business_date").agg(F.sum("units_produced").alias(f"{n}_units"), F.sum("defect_count").alias(f"{n}_defects"))
    both = total(s, "silver").join(total(M.gold(s), "gold"), "business_date")
    return both.withColumn("conserved", (F.col("silver_units") == F.col("gold_units")) & (F.col("silver_defects") == F.col("gold_defects")))


@query("WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE o_orderstatus END AS s, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderpriority END AS p FROM orders)"
       " SELECT 'o_orderkey' AS column_name, count(*) FILTER (o_orderkey IS NULL) AS null_count FROM t"
       " UNION ALL SELECT 's', count(*) FILTER (coalesce(s, '') = '') FROM t UNION ALL SELECT 'p', count(*) FILTER (coalesce(p, '') = '') FROM t")
def required_null_counts(spark, sf):
    o = star.table(spark, sf, "orders")
    t = o.select("o_orderkey", F.when(F.col("o_orderkey") % 11 == 0, "").otherwise(F.col("o_orderstatus")).alias("s"), F.when(F.col("o_orderkey") % 17 != 0, F.col("o_orderpriority")).alias("p"))
    return P.column_types(t).select("column_name", "null_count")


@query(f"""WITH {SILVER_SQL} SELECT work_order_id, machine_id, event_time, count(*) - 1 AS extra FROM silver GROUP BY ALL HAVING count(*) > 1""")
def unique_key_violations(spark, sf):
    return Q.unique_violations(_silver(spark, sf), NATURAL_KEY)


@query(f"""WITH {SILVER_SQL} SELECT business_date, operation, count(*) AS events FROM silver
WHERE operation NOT IN ('assembly', 'inspection', 'packaging', 'welding', 'machining', 'calibration') GROUP BY ALL""")
def unexpected_operations(spark, sf):
    return _silver(spark, sf).filter(~F.col("operation").isin(ACCEPTED_OPERATIONS)).groupBy("business_date", "operation").agg(F.count("*").alias("events"))


@query(f"""WITH {SILVER_SQL}, v AS (
  SELECT work_order_id, machine_id, event_time, 'units_produced<0' AS rule FROM silver WHERE units_produced < 0
  UNION ALL SELECT work_order_id, machine_id, event_time, 'defect_count<0' FROM silver WHERE defect_count < 0
  UNION ALL SELECT work_order_id, machine_id, event_time, 'cycle_time_ms<=0' FROM silver WHERE cycle_time_ms <= 0
  UNION ALL SELECT work_order_id, machine_id, event_time, 'defect_count>units_produced' FROM silver WHERE defect_count > units_produced
) SELECT * FROM v""")
def range_violations(spark, sf):
    return Q.violations(_silver(spark, sf), NATURAL_KEY, Q.range_rules())


@query("""WITH d AS (SELECT CASE WHEN o_orderkey % 13 = 0 THEN 'not-a-date' WHEN o_orderkey % 29 = 0 THEN '1997-02-30' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS business_date FROM orders)
SELECT business_date, count(*) AS events, regexp_full_match(business_date, '\\d{4}-\\d{2}-\\d{2}') AND try_cast(business_date AS DATE) IS NOT NULL AS parseable FROM d GROUP BY ALL""")
def freshness_partitions(spark, sf):
    k = F.col("o_orderkey")
    d = F.when(k % 13 == 0, "not-a-date").when(k % 29 == 0, "1997-02-30").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return star.table(spark, sf, "orders").select(d.alias("business_date")).groupBy("business_date").agg(F.count("*").alias("events")).withColumn("parseable", is_iso_date(F.col("business_date")))


_PROFILED = ["event_time", "plant_id", "units_produced", "business_date"]


@query(f"""WITH {star.SOURCE_SQL}, cells AS (
  SELECT 'event_time' AS column_name, event_time AS v FROM src UNION ALL SELECT 'plant_id', plant_id FROM src
  UNION ALL SELECT 'units_produced', units_produced::VARCHAR FROM src UNION ALL SELECT 'business_date', business_date FROM src)
SELECT column_name, count(*) FILTER (v = '') AS null_count, count(*) FILTER (v <> '') AS n_values,
  CASE WHEN bool_and(try_cast(v AS BIGINT) IS NOT NULL) THEN 'integer' WHEN bool_and(try_cast(v AS DOUBLE) IS NOT NULL) THEN 'float'
    WHEN bool_and(try_cast(v AS TIMESTAMPTZ) IS NOT NULL) THEN 'datetime' ELSE 'string' END AS type FROM cells GROUP BY 1""")
def column_type_profile(spark, sf):
    return P.column_types(star.source_events(spark, sf).select(*_PROFILED))


@query("""WITH r AS (SELECT 'ds-' || (o_custkey % 7) AS dataset_id, sha256((o_orderkey % 40)::VARCHAR) AS source_hash, o_orderkey AS nr FROM orders),
f AS (SELECT dataset_id, source_hash, min(nr) AS first_at, count(*) AS registrations FROM r GROUP BY ALL)
SELECT dataset_id, source_hash, 'v' || row_number() OVER (PARTITION BY dataset_id ORDER BY first_at, source_hash) AS version, registrations FROM f""")
def dataset_versions(spark, sf):
    o = star.table(spark, sf, "orders")
    r = o.select(F.concat(F.lit("ds-"), (F.col("o_custkey") % 7).cast("string")).alias("dataset_id"), F.sha2((F.col("o_orderkey") % 40).cast("string"), 256).alias("source_hash"), F.col("o_orderkey").alias("at"))
    return P.dataset_versions(r)


@query("""WITH r AS (SELECT 'ds-' || (o_custkey % 7) AS dataset_id, o_orderkey AS run_no, sha256((o_orderkey // 500)::VARCHAR) AS schema_hash FROM orders WHERE o_orderstatus <> 'P'),
l AS (SELECT *, lag(schema_hash) OVER (PARTITION BY dataset_id ORDER BY run_no) AS previous FROM r)
SELECT dataset_id, run_no, substr(previous, 1, 12) AS expected, substr(schema_hash, 1, 12) AS actual,
  CASE WHEN previous IS NULL OR previous = schema_hash THEN 'pass' ELSE 'warn' END AS status FROM l""")
def schema_drift_history(spark, sf):
    o = star.table(spark, sf, "orders").filter("o_orderstatus <> 'P'")
    r = o.select(F.concat(F.lit("ds-"), (F.col("o_custkey") % 7).cast("string")).alias("dataset_id"), F.col("o_orderkey").alias("run_no"), F.sha2(F.floor(F.col("o_orderkey") / 500).cast("string"), 256).alias("schema_hash"))
    return P.schema_drift(r)


def _eav(spark, sf) -> DataFrame:
    return E.union_sources(star.wide_sources(spark, sf))


@query(f"WITH {star.WIDE_SQL} SELECT entity_id, business_date, attribute, value, value_type, source_id FROM eav")
def eav_long(spark, sf):
    return _eav(spark, sf).select("entity_id", "business_date", "attribute", "value", "value_type", "source_id")


@query(f"WITH {star.WIDE_SQL} SELECT source_id, attribute, raw, count(*) AS errors FROM eav WHERE trim(raw) <> '' AND value IS NULL GROUP BY ALL")
def eav_type_errors(spark, sf):
    return _eav(spark, sf).filter("type_error").groupBy("source_id", "attribute", "raw").agg(F.count("*").alias("errors"))


@query(f"WITH {EAV_GOLD_SQL} SELECT * FROM eav_gold")
def eav_entity_daily(spark, sf):
    return E.eav_gold(_eav(spark, sf))


@query(f"""WITH {star.WIDE_SQL}, s AS (SELECT DISTINCT source_id FROM wide), mapped AS (SELECT DISTINCT source_id, attribute FROM long WHERE NOT (source_id = 'line_c' AND attribute = 'pressure_kpa'))
SELECT source_id, a.attribute FROM s, (VALUES ('units_produced'), ('defect_count'), ('temperature_c'), ('pressure_kpa')) a(attribute)
EXCEPT SELECT source_id, attribute FROM mapped""")
def eav_mapping_coverage(spark, sf):
    mapped = _eav(spark, sf).filter("not (source_id = 'line_c' and attribute = 'pressure_kpa')").select("source_id", "attribute").distinct()
    needed = _eav(spark, sf).select("source_id").distinct().select("source_id", F.explode(F.array(*map(F.lit, STANDARD_ATTRIBUTES))).alias("attribute"))
    return needed.join(mapped, ["source_id", "attribute"], "left_anti")


@query(f"""WITH {EAV_GOLD_SQL}, a AS (SELECT business_date, coalesce(sum(value) FILTER (attribute = 'units_produced'), 0)::BIGINT AS eav_units,
  coalesce(sum(value) FILTER (attribute = 'defect_count'), 0)::BIGINT AS eav_defects FROM eav GROUP BY 1),
b AS (SELECT business_date, sum(units_produced)::BIGINT AS gold_units, sum(defect_count)::BIGINT AS gold_defects FROM eav_gold GROUP BY 1)
SELECT *, eav_units = gold_units AND eav_defects = gold_defects AS conserved FROM a JOIN b USING (business_date)""")
def eav_conservation(spark, sf):
    eav = _eav(spark, sf)
    s = lambda a: F.coalesce(F.sum(F.when(F.col("attribute") == a, F.col("value"))), F.lit(0.0)).cast("bigint")
    a = eav.groupBy("business_date").agg(s("units_produced").alias("eav_units"), s("defect_count").alias("eav_defects"))
    b = E.eav_gold(eav).groupBy("business_date").agg(F.sum("units_produced").alias("gold_units"), F.sum("defect_count").alias("gold_defects"))
    return a.join(b, "business_date").withColumn("conserved", (F.col("eav_units") == F.col("gold_units")) & (F.col("eav_defects") == F.col("gold_defects")))


@query(f"""WITH {EAV_GOLD_SQL} SELECT entity_id, business_date, 'temperature_c_out_of_range' AS rule FROM eav_gold WHERE NOT temperature_c BETWEEN -50 AND 500
UNION ALL SELECT entity_id, business_date, 'units_produced<0' FROM eav_gold WHERE units_produced < 0 UNION ALL SELECT entity_id, business_date, 'defect_count<0' FROM eav_gold WHERE defect_count < 0
UNION ALL SELECT entity_id, business_date, 'defect_count>units_produced' FROM eav_gold WHERE defect_count > units_produced UNION ALL SELECT entity_id, business_date, 'pressure_kpa<0' FROM eav_gold WHERE pressure_kpa < 0""")
def eav_range_violations(spark, sf):
    return Q.violations(E.eav_gold(_eav(spark, sf)), ["entity_id", "business_date"], Q.eav_range_rules())


def _entries(spark, sf) -> DataFrame:
    return L.classified(star.log_records(spark, sf))


@query(f"""WITH {star.RECORDS_SQL} SELECT topic, part AS partition, off AS "offset", status, event_id, error AS validation_error FROM landed""")
def landing_classification(spark, sf):
    return _entries(spark, sf).select("topic", "partition", "offset", "status", "event_id", "validation_error")


@query(f"""WITH {star.RECORDS_SQL} SELECT off AS "offset", event_id, first_off AS first_offset FROM landed WHERE status = 'duplicate_event_id'""")
def duplicate_of(spark, sf):
    return _entries(spark, sf).filter("status = 'duplicate_event_id'").select("offset", "event_id", F.col("duplicate_of.offset").alias("first_offset"))


@query("""WITH r AS (SELECT event_id AS off, user_id::VARCHAR AS key, event_type AS v FROM events),
known AS (SELECT off, sha256(encode(key || chr(1) || v)) AS f FROM r WHERE off % 3 = 0),
again AS (SELECT off, sha256(encode(key || chr(1) || CASE WHEN off % 30 = 0 THEN v || '!' ELSE v END)) AS f FROM r)
SELECT CASE WHEN k.off IS NULL THEN 'new' WHEN k.f = a.f THEN 'reused' ELSE 'changed' END AS outcome, count(*) AS records
FROM again a LEFT JOIN known k USING (off) GROUP BY 1""")
def redelivery_reuse(spark, sf):
    e = star.table(spark, sf, "events").select(F.col("event_id").alias("off"), _text("user_id").alias("key"), F.col("event_type").alias("v"))
    print_ = lambda v: F.sha2(F.concat("key", F.lit("\x01"), v), 256)
    known = e.filter("off % 3 = 0").select("off", print_(F.col("v")).alias("k"))
    again = e.select("off", print_(F.when(F.col("off") % 30 == 0, F.concat("v", F.lit("!"))).otherwise(F.col("v"))).alias("f"))
    outcome = F.when(F.col("k").isNull(), "new").when(F.col("k") == F.col("f"), "reused").otherwise("changed")
    return again.join(known, "off", "left").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("records"))


@query("SELECT 'machine-events' AS topic, (user_id % 4)::INTEGER AS partition, max(event_id) + 1 AS next_offset FROM events GROUP BY ALL")
def committable_offsets(spark, sf):
    return L.next_offsets(star.log_records(spark, sf).withColumn("partition", (F.col("key").cast("bigint") % 4).cast("int")))


@query(f"""WITH {star.RECORDS_SQL}, m AS (SELECT min(day) AS day FROM landed WHERE status = 'accepted')
SELECT off AS "offset", event_id, landed.day AS business_date, units AS units_produced, timestamp_ms FROM landed JOIN m USING (day) WHERE status = 'accepted'""")
def accepted_on_date(spark, sf):
    rows = _entries(spark, sf).filter("status = 'accepted'")
    day = rows.agg(F.min("event.business_date").alias("day"))
    return rows.join(day, F.col("event.business_date") == F.col("day")).select("offset", "event_id", F.col("day").alias("business_date"), F.col("event.units_produced").alias("units_produced"), "timestamp_ms")


@query("""SELECT event_id AS "offset", CASE WHEN event_id % 7 = 0 THEN 'missing' WHEN event_id % 11 = 0 THEN 'key' WHEN event_id % 13 = 0 THEN 'timestamp_ms' END AS problem
FROM events WHERE event_id % 7 = 0 OR event_id % 11 = 0 OR event_id % 13 = 0 UNION ALL SELECT -event_id - 1, 'undeclared' FROM events WHERE event_id % 7 = 0 AND event_id % 2 = 0""")
def tampered_entries(spark, sf):
    """Entries of a batch of which some were dropped, moved to another offset, or given another key or time."""
    entries = _entries(spark, sf).withColumn("batch", F.lit("b"))
    i = F.col("offset")
    moved = entries.filter((i % 7 != 0) | (i % 2 == 0)).withColumn("offset", F.when(i % 7 == 0, -i - 1).otherwise(i))
    other = F.col("offset") >= 0
    changed = moved.withColumn("key", F.when(other & (i % 11 == 0), F.lit("other")).otherwise(F.col("key")))
    changed = changed.withColumn("timestamp_ms", F.when(other & (i % 11 != 0) & (i % 13 == 0), F.lit(-1)).otherwise(F.col("timestamp_ms")))
    return L.tampered(changed, L.manifest_of(entries)).select("offset", "problem")


@query(f"""WITH {star.RECORDS_SQL}, accepted AS (SELECT event_id, off FROM landed WHERE status = 'accepted'),
sealed AS (SELECT 's-' || (event_id % 50) AS session, event_id // 50 + 1 AS sequence_no, 'evt-' || event_id AS event_id FROM events)
SELECT session, count(*) AS expected, count(off) AS covered, count(*) = count(off) AS recovery_complete FROM sealed LEFT JOIN accepted USING (event_id) GROUP BY 1""")
def recovery_coverage(spark, sf):
    i = F.col("event_id")
    sealed = star.table(spark, sf, "events").select(F.concat(F.lit("s-"), (i % 50).cast("string")).alias("session"), (F.floor(i / 50) + 1).alias("sequence_no"), F.concat(F.lit("evt-"), i.cast("string")).alias("event_id"))
    found = R.coverage(sealed, _entries(spark, sf).filter("status = 'accepted'"))
    return found.groupBy("session").agg(F.count("*").alias("expected"), F.count_if("covered").alias("covered")).withColumn("recovery_complete", F.col("expected") == F.col("covered"))


@query("""WITH p AS (SELECT 's-' || (event_id % 50) AS session, event_id // 50 + 1 AS sequence_no FROM events WHERE event_id % 7 <> 3),
l AS (SELECT session, max(sequence_no) AS last FROM p GROUP BY 1), w AS (SELECT session, unnest(generate_series(1, last)) AS sequence_no FROM l)
SELECT session, sequence_no FROM w ANTI JOIN p USING (session, sequence_no)""")
def missing_sequences(spark, sf):
    i = F.col("event_id")
    present = star.table(spark, sf, "events").filter(i % 7 != 3).select(F.concat(F.lit("s-"), (i % 50).cast("string")).alias("session"), (F.floor(i / 50) + 1).alias("sequence_no"))
    return R.missing_sequences(present, present.groupBy("session").agg(F.max("sequence_no").alias("expected_last_sequence")))


@query("""WITH a AS (SELECT 'evt-' || event_id AS event_id FROM events WHERE event_id % 5 <> 1), b AS (SELECT 'evt-' || event_id AS event_id FROM events WHERE event_id % 6 <> 2)
SELECT event_id, 'missing' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT event_id, 'extra' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def session_set_mismatch(spark, sf):
    e = star.table(spark, sf, "events").select(F.col("event_id").alias("i"), F.concat(F.lit("evt-"), _text("event_id")).alias("event_id"))
    return R.set_mismatch(e.filter("i % 5 <> 1"), e.filter("i % 6 <> 2"))


@query(f"""WITH {GOLD_SQL}, fixed AS (SELECT * REPLACE (units_produced + 1 AS units_produced) FROM gold WHERE business_date LIKE '%-06-01')
SELECT * FROM gold WHERE business_date NOT IN (SELECT business_date FROM fixed) UNION ALL SELECT * FROM fixed""")
def partition_overwrite_result(spark, sf):
    g = gold_daily_line_metrics(spark, sf)
    fixed = g.filter(F.col("business_date").like("%-06-01")).withColumn("units_produced", F.col("units_produced") + 1)
    return g.join(fixed.select("business_date").distinct(), "business_date", "left_anti").select(*g.columns).unionByName(fixed)


@query(f"""WITH {GOLD_SQL}, d AS (SELECT business_date, sha256(sum(units_produced)::BIGINT::VARCHAR) AS source_hash, sum(defect_count)::BIGINT AS n FROM gold GROUP BY 1),
states AS (SELECT business_date, CASE WHEN n % 3 = 0 THEN 'other' ELSE source_hash END AS source_hash, n AS snapshot_id FROM d), snaps AS (SELECT n AS snapshot_id FROM d WHERE n % 5 <> 0)
SELECT business_date, source_hash, CASE WHEN EXISTS (SELECT 1 FROM states s WHERE s.business_date = d.business_date AND s.source_hash = d.source_hash AND s.snapshot_id IN (SELECT snapshot_id FROM snaps))
  THEN 'skip' ELSE 'write' END AS action FROM d""")
def publish_decision(spark, sf):
    d = gold_daily_line_metrics(spark, sf).groupBy("business_date").agg(F.sha2(F.sum("units_produced").cast("string"), 256).alias("source_hash"), F.sum("defect_count").alias("n"))
    states = d.select("business_date", F.when(F.col("n") % 3 == 0, "other").otherwise(F.col("source_hash")).alias("source_hash"), F.col("n").alias("snapshot_id"))
    return R.publish_decision(d.select("business_date", "source_hash"), states, d.filter("n % 5 <> 0").select(F.col("n").alias("snapshot_id")))


@query(f"""WITH {SILVER_SQL}, c AS (SELECT business_date, 'accepted_values_operation' AS name, CASE WHEN count(*) FILTER (operation = 'rework') > 0 THEN 'fail' ELSE 'pass' END AS status FROM silver GROUP BY 1
UNION ALL SELECT business_date, 'numeric_range_within_bounds', CASE WHEN count(*) FILTER (units_produced < 0 OR defect_count < 0 OR cycle_time_ms <= 0 OR defect_count > units_produced) > 0 THEN 'fail' ELSE 'pass' END FROM silver GROUP BY 1)
SELECT name, status, count(*) AS checks FROM c GROUP BY ALL""")
def quality_summary(spark, sf):
    from functools import reduce

    any_rule = reduce(lambda a, b: a | b, Q.range_rules().values())
    by_date = _silver(spark, sf).groupBy("business_date").agg(F.count_if(~F.col("operation").isin(ACCEPTED_OPERATIONS)).alias("accepted_values_operation"), F.count_if(any_rule).alias("numeric_range_within_bounds"))
    names = ["accepted_values_operation", "numeric_range_within_bounds"]
    rows = by_date.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.when(F.col(n) > 0, "fail").otherwise("pass").alias("status")) for n in names])).alias("c")).select("c.*")
    return rows.groupBy("name", "status").agg(F.count("*").alias("checks"))


@query("""WITH r AS (SELECT DISTINCT 'run-' || n_nationkey AS run_id FROM nation)
SELECT run_id, l.name, '/' || run_id || '/' || l.name AS path, l.parent, l.step FROM r, (VALUES ('gold', 'silver', 1), ('silver', 'bronze', 2), ('bronze', 'source', 3)) l(name, parent, step)""")
def lineage_trace(spark, sf):
    run = F.concat(F.lit("run-"), _text("n_nationkey"))
    layer = lambda n, p: F.struct(F.lit(n).alias("name"), F.concat(F.lit("/"), run, F.lit(f"/{n}")).alias("path"), F.array(F.lit(p)).alias("parents"))
    runs = star.table(spark, sf, "nation").select(run.alias("run_id"), F.array(layer("bronze", "source"), layer("silver", "bronze"), layer("gold", "silver")).alias("layers"))
    return R.lineage_trace(runs).select("run_id", "name", "path", F.get("parents", F.lit(0)).alias("parent"), F.col("step").cast("int").alias("step"))


@query(f"""WITH {star.RECORDS_SQL} SELECT off AS "offset", sha256(encode(topic) || '\\x00'::BLOB || encode(part::VARCHAR) || '\\x00'::BLOB || encode(off::VARCHAR) || '\\x00'::BLOB
  || encode(coalesce(key, '')) || '\\x00'::BLOB || encode(value)) AS fingerprint FROM rec""")
def record_fingerprints(spark, sf):
    r = star.log_records(spark, sf)
    return r.select("offset", record_fingerprint(*[F.col(c) for c in ("topic", "partition", "offset", "key", "value")]).alias("fingerprint"))


@query(f"""WITH {star.SOURCE_SQL}, h AS (SELECT business_date, sha256(string_agg(work_order_id || '|' || machine_id, ',' ORDER BY work_order_id, machine_id)) AS part FROM
  (SELECT DISTINCT business_date, work_order_id, machine_id FROM src) GROUP BY 1) SELECT sha256(string_agg(part, '' ORDER BY part)) AS combined, count(*) AS parts FROM h""")
def combined_source_hash(spark, sf):
    keys = star.source_events(spark, sf).select("business_date", "work_order_id", "machine_id").distinct()
    own = F.transform(F.array_sort(F.collect_list(F.struct("work_order_id", "machine_id"))), lambda x: F.concat(x["work_order_id"], F.lit("|"), x["machine_id"]))
    parts = keys.groupBy("business_date").agg(F.sha2(F.array_join(own, ","), 256).alias("part"))
    return parts.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("part")), ""), 256).alias("combined"), F.count("*").alias("parts"))


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in _found.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _found.items()}

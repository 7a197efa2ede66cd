"""Projections of the star-schema tables onto the event model: source events, log records and wide sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.domain import ACCEPTED_OPERATIONS
from millrace.sources.files import ORDINAL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with part as source events, all text, with an ordinal.  Deliberately dirty: padding, case, an operation
    that isn't accepted, repeated natural keys, defects beyond units."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    text = lambda c: c.cast("string")
    month = F.date_format(F.trunc("l_shipdate", "month"), "yyyy-MM-dd")
    operations = F.array(*map(F.lit, [*ACCEPTED_OPERATIONS, "rework"]))
    return rows.select(
        F.concat(month, F.lit("T00:00:00Z")).alias("event_time"),
        F.concat(F.lit(" Plant-"), text(F.col("l_suppkey") % 5), F.lit(" ")).alias("plant_id"),
        F.concat(F.lit("LINE-"), "l_returnflag", "l_linestatus").alias("line_id"),
        F.concat(F.lit("WO-"), text(F.col("l_orderkey"))).alias("work_order_id"),
        F.concat(F.lit("MC-"), text(F.col("l_suppkey") % 3)).alias("machine_id"),
        F.col("p_type").alias("product_code"),
        F.element_at(operations, F.col("l_linenumber")).alias("operation"),
        text(F.floor("l_quantity")).alias("units_produced"),
        text(F.floor(F.col("l_tax") * 100 + 0.5)).alias("defect_count"),
        text(F.floor("l_extendedprice")).alias("cycle_time_ms"),
        month.alias("business_date"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias(ORDINAL),
    )


SOURCE_SQL = """
src AS (
  SELECT strftime(date_trunc('month', l_shipdate), '%Y-%m-%d') AS business_date,
    strftime(date_trunc('month', l_shipdate), '%Y-%m-%d') || 'T00:00:00Z' AS event_time,
    ' Plant-' || (l_suppkey % 5) || ' ' AS plant_id, 'LINE-' || l_returnflag || l_linestatus AS line_id,
    'WO-' || l_orderkey AS work_order_id, 'MC-' || (l_suppkey % 3) AS machine_id, p_type AS product_code,
    ['assembly','inspection','packaging','welding','machining','calibration','rework'][l_linenumber] AS operation,
    floor(l_quantity)::BIGINT AS units_produced, floor(l_tax * 100 + 0.5)::BIGINT AS defect_count,
    floor(l_extendedprice)::BIGINT AS cycle_time_ms, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice
  FROM lineitem JOIN part ON l_partkey = p_partkey
)"""


def log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as log records (topic, partition, offset, key, value, timestamp_ms).  Some repeat the event before them,
    some break the contract."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    own = F.when(i % 10 == 7, i - 1).otherwise(i)
    text = lambda c: c.cast("string")
    units = F.floor("value")
    value = F.concat(
        F.lit('{"event_id":"evt-'), text(own), F.lit('","schema_version":'), F.when(i % 23 == 6, F.lit("2")).otherwise(F.lit("1")),
        F.lit(',"event_time":"'), F.date_format("ts", "yyyy-MM-dd"), F.lit('T00:00:00Z","business_date":"'), F.date_format("ts", "yyyy-MM-dd"),
        F.lit('","plant_id":" Plant-'), text(F.col("user_id") % 5), F.lit('","line_id":"LINE-1","work_order_id":"WO-'), text(own),
        F.lit('","machine_id":"MC-'), text(F.col("user_id") % 3), F.lit('"'),
        F.when(i % 17 == 3, F.lit("")).otherwise(F.concat(F.lit(',"product_code":"'), F.col("event_type"), F.lit('"'))),
        F.lit(',"operation":"'), F.when(i % 13 == 5, F.lit("rework")).otherwise(F.lit("Assembly")),
        F.lit('","units_produced":'), F.when(i % 19 == 4, F.concat(F.lit('"'), text(units), F.lit('"'))).otherwise(text(units)),
        F.lit(',"defect_count":0,"cycle_time_ms":'), text(100 + i % 50), F.lit("}"),
    )
    return e.select(
        F.lit("machine-events").alias("topic"), F.lit(0).alias("partition"), i.alias("offset"), text(F.col("user_id")).alias("key"),
        value.cast("binary").alias("value"), F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) * 1000").alias("timestamp_ms"),
    )


RECORDS_SQL = """
raw AS (
  SELECT event_id AS i, CASE WHEN event_id % 10 = 7 THEN event_id - 1 ELSE event_id END AS own, strftime(ts, '%Y-%m-%d') AS day,
    floor(value)::BIGINT AS units, user_id, event_type, floor(epoch(ts))::BIGINT * 1000 AS timestamp_ms FROM events
),
rec AS (
  SELECT 'machine-events' AS topic, 0 AS part, i AS off, user_id::VARCHAR AS key, timestamp_ms, own, day, units, i,
    '{"event_id":"evt-' || own || '","schema_version":' || CASE WHEN i % 23 = 6 THEN '2' ELSE '1' END
    || ',"event_time":"' || day || 'T00:00:00Z","business_date":"' || day || '","plant_id":" Plant-' || (user_id % 5)
    || '","line_id":"LINE-1","work_order_id":"WO-' || own || '","machine_id":"MC-' || (user_id % 3) || '"'
    || CASE WHEN i % 17 = 3 THEN '' ELSE ',"product_code":"' || event_type || '"' END
    || ',"operation":"' || CASE WHEN i % 13 = 5 THEN 'rework' ELSE 'Assembly' END || '","units_produced":'
    || CASE WHEN i % 19 = 4 THEN '"' || units || '"' ELSE units::VARCHAR END
    || ',"defect_count":0,"cycle_time_ms":' || (100 + i % 50) || '}' AS value
  FROM raw
),
judged AS (
  SELECT *, CASE WHEN i % 17 = 3 THEN 'missing required fields: product_code'
    WHEN i % 19 = 4 THEN 'units_produced must be an integer'
    WHEN i % 23 = 6 THEN 'unsupported schema_version=2; expected 1'
    WHEN i % 13 = 5 THEN 'operation must be one of [''assembly'', ''calibration'', ''inspection'', ''machining'', ''packaging'', ''welding'']'
    END AS error FROM rec
),
classified AS (
  SELECT *, CASE WHEN error IS NULL THEN 'evt-' || own END AS event_id,
    CASE WHEN error IS NULL THEN min(off) OVER (PARTITION BY error IS NULL, own) END AS first_off FROM judged
),
landed AS (
  SELECT *, CASE WHEN error IS NOT NULL THEN 'quarantined' WHEN off = first_off THEN 'accepted' ELSE 'duplicate_event_id' END AS status
  FROM classified
)"""


def wide_sources(spark: SparkSession, sf_dir: str) -> list[tuple[DataFrame, dict]]:
    """orders, customer and supplier as three wide sources of different layout, with their mappings."""
    text = lambda c: c.cast("string")

    def messy(i, value, bad: int, blank: int):
        return F.when(i % bad == 0, F.lit("not-a-number")).when(i % blank == 0, F.lit(" ")).otherwise(value)

    i = F.col("o_orderkey")
    a = table(spark, sf_dir, "orders").select(
        F.date_format(F.trunc("o_orderdate", "month"), "yyyy-MM-dd").alias("생산일자"), F.concat(F.lit(" EQ-"), text(F.col("o_custkey") % 20)).alias("설비"),
        messy(i, text(i % 400), 97, 89).alias("생산수량"), text(i % 7).alias("불량수량"), text(20 + i % 60).alias("온도_C"), text(90 + i % 30).alias("압력_kPa"),
    )
    i = F.col("c_custkey")
    b = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("1996-0"), text(1 + i % 6), F.lit("-01")).alias("date"), F.concat(F.lit("EQ-"), text(i % 20)).alias("machine_id"),
        text(i % 300).alias("output_units"), text(i % 5).alias("reject_count"), messy(i, text(60 + i % 150), 83, 79).alias("temp_f"),
        F.concat(F.lit("1."), text(i % 10)).alias("pressure_bar"), F.col("c_mktsegment").alias("note"),
    )
    i = F.col("s_suppkey")
    c = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("1996-0"), text(1 + i % 6), F.lit("-01")).alias("business_date"), F.concat(F.lit("EQ-"), text(i % 20)).alias("asset"),
        text(i % 200).alias("qty_produced"), text(i % 3).alias("qty_defective"), text(15 + i % 70).alias("temperature_celsius"), text(95 + i % 10).alias("pressure_kpa"),
    )
    number = lambda standard, kind, convert=None: {"standard": standard, "type": kind} | ({"convert": convert} if convert else {})
    return [
        (a, {"source_id": "plant_a", "source_file": "plant_a.csv", "entity_field": "설비", "business_date_field": "생산일자", "attributes": {"생산수량": number("units_produced", "int"), "불량수량": number("defect_count", "int"), "온도_C": number("temperature_c", "float"), "압력_kPa": number("pressure_kpa", "float")}}),
        (b, {"source_id": "plant_b", "source_file": "plant_b.csv", "entity_field": "machine_id", "business_date_field": "date", "attributes": {"output_units": number("units_produced", "int"), "reject_count": number("defect_count", "int"), "temp_f": number("temperature_c", "float", "f_to_c"), "pressure_bar": number("pressure_kpa", "float", "bar_to_kpa")}}),
        (c, {"source_id": "line_c", "source_file": "line_c.csv", "entity_field": "asset", "business_date_field": "business_date", "attributes": {"qty_produced": number("units_produced", "int"), "qty_defective": number("defect_count", "int"), "temperature_celsius": number("temperature_c", "float"), "pressure_kpa": number("pressure_kpa", "float")}}),
    ]


WIDE_SQL = """
wide AS (
  SELECT 'plant_a' AS source_id, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS business_date, 'EQ-' || (o_custkey % 20) AS entity_id,
    CASE WHEN o_orderkey % 97 = 0 THEN 'not-a-number' WHEN o_orderkey % 89 = 0 THEN ' ' ELSE (o_orderkey % 400)::VARCHAR END AS u,
    (o_orderkey % 7)::VARCHAR AS d, (20 + o_orderkey % 60)::VARCHAR AS t, (90 + o_orderkey % 30)::VARCHAR AS p FROM orders
  UNION ALL
  SELECT 'plant_b', '1996-0' || (1 + c_custkey % 6) || '-01', 'EQ-' || (c_custkey % 20), (c_custkey % 300)::VARCHAR, (c_custkey % 5)::VARCHAR,
    CASE WHEN c_custkey % 83 = 0 THEN 'not-a-number' WHEN c_custkey % 79 = 0 THEN ' ' ELSE (60 + c_custkey % 150)::VARCHAR END, '1.' || (c_custkey % 10) FROM customer
  UNION ALL
  SELECT 'line_c', '1996-0' || (1 + s_suppkey % 6) || '-01', 'EQ-' || (s_suppkey % 20), (s_suppkey % 200)::VARCHAR, (s_suppkey % 3)::VARCHAR,
    (15 + s_suppkey % 70)::VARCHAR, (95 + s_suppkey % 10)::VARCHAR FROM supplier
),
long AS (
  SELECT source_id, business_date, entity_id, 'units_produced' AS attribute, u AS raw, 'int' AS value_type FROM wide
  UNION ALL SELECT source_id, business_date, entity_id, 'defect_count', d, 'int' FROM wide
  UNION ALL SELECT source_id, business_date, entity_id, 'temperature_c', t, 'float' FROM wide
  UNION ALL SELECT source_id, business_date, entity_id, 'pressure_kpa', p, 'float' FROM wide
),
eav AS (
  SELECT source_id, business_date, entity_id, attribute, value_type, raw,
    CASE WHEN value_type = 'int' THEN round_even(try_cast(raw AS DOUBLE), 0)
      WHEN source_id = 'plant_b' AND attribute = 'temperature_c' THEN printf('%.4f', (try_cast(raw AS DOUBLE) - 32) * 5 / 9)::DOUBLE
      WHEN source_id = 'plant_b' THEN printf('%.4f', try_cast(raw AS DOUBLE) * 100)::DOUBLE
      ELSE printf('%.4f', try_cast(raw AS DOUBLE))::DOUBLE END AS value
  FROM long
)"""

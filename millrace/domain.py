"""Fixed values of the data model."""

from __future__ import annotations

ACCEPTED_OPERATIONS = ["assembly", "inspection", "packaging", "welding", "machining", "calibration"]

SOURCE_COLUMNS = [
    "event_time",
    "plant_id",
    "line_id",
    "work_order_id",
    "machine_id",
    "product_code",
    "operation",
    "units_produced",
    "defect_count",
    "cycle_time_ms",
    "business_date",
]
NATURAL_KEY = ["work_order_id", "machine_id", "event_time"]
IDENTIFIERS = ["plant_id", "line_id", "work_order_id", "machine_id", "product_code", "operation"]
MEASURES = ["units_produced", "defect_count", "cycle_time_ms"]
GRAIN = ["business_date", "plant_id", "line_id", "product_code"]

CANONICAL_EXTRA = [
    "event_id",
    "schema_version",
    "kafka_topic",
    "kafka_partition",
    "kafka_offset",
    "kafka_key",
    "kafka_timestamp_ms",
    "kafka_record_fingerprint",
]

GOLD_DDL = (
    "business_date STRING, plant_id STRING, line_id STRING, product_code STRING, units_produced BIGINT, "
    "defect_count BIGINT, defect_rate DOUBLE, avg_cycle_time_ms DOUBLE, closing_status STRING"
)
CLOSING_STATUS = "provisional"

EVENT_STRINGS = ["event_id", "event_time", "business_date", *IDENTIFIERS]
EVENT_INTEGERS = ["schema_version", "units_produced", "defect_count", "cycle_time_ms"]
EVENT_VERSION = 1

STANDARD_ATTRIBUTES = ["units_produced", "defect_count", "temperature_c", "pressure_kpa"]
SUMMED_ATTRIBUTES = ["units_produced", "defect_count"]

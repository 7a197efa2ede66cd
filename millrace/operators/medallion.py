"""Silver and gold of machine events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.domain import CLOSING_STATUS, GRAIN, IDENTIFIERS, MEASURES, NATURAL_KEY
from millrace.functions.expr import py_round, py_strip, ratio, strict_long
from millrace.sources.files import ORDINAL


def coordinate_order() -> list[Column]:
    """The order of rows that came from the event log."""
    return [F.col("kafka_topic"), F.col("kafka_partition").cast("bigint"), F.col("kafka_offset").cast("bigint")]


def on_date(events: DataFrame, business_date: str) -> DataFrame:
    """Exact text equality; the date is never parsed here."""
    return events.filter(F.col("business_date") == business_date)


def first_wins(events: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """The first row, in file or given order, of each raw natural key of a date.  A window of rank 1 lets Spark keep
    one row of a key per task before the shuffle."""
    w = Window.partitionBy("business_date", *NATURAL_KEY).orderBy(*(order or [F.col(ORDINAL)]))
    return events.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def silver(events: DataFrame, source_hash: str = "", business_date: str | None = None, order: list[Column] | None = None) -> DataFrame:
    """Filter, first-wins dedup on raw keys, stripped and lower-cased identifiers, strict integers."""
    rows = on_date(events, business_date) if business_date is not None else events
    rows = first_wins(rows, order)
    return rows.select(
        "event_time",
        "business_date",
        *[F.lower(py_strip(F.col(c))).alias(c) for c in IDENTIFIERS],
        *[strict_long(F.col(c)).alias(c) for c in MEASURES],
        F.lit(source_hash).alias("source_hash"),
    )


def gold(rows: DataFrame) -> DataFrame:
    """Daily metrics by line and product."""
    sums = rows.groupBy(*GRAIN).agg(F.sum("units_produced").alias("units_produced"), F.sum("defect_count").alias("defect_count"), F.sum("cycle_time_ms").alias("_cycle"), F.count("*").alias("_events"))
    return sums.select(
        *GRAIN,
        "units_produced",
        "defect_count",
        ratio(F.col("defect_count"), F.col("units_produced"), 6).alias("defect_rate"),
        py_round(F.col("_cycle") / F.col("_events"), 2).alias("avg_cycle_time_ms"),
        F.lit(CLOSING_STATUS).alias("closing_status"),
    )


def gold_or_sentinel(rows: DataFrame, business_date: str) -> DataFrame:
    """gold, or one zero row with empty keys where there is nothing."""
    made = gold(rows)
    zero = made.sparkSession.range(1).select(
        F.lit(business_date).alias("business_date"),
        *[F.lit("").alias(c) for c in GRAIN[1:]],
        *[F.lit(0).cast("bigint").alias(c) for c in ("units_produced", "defect_count")],
        *[F.lit(0.0).alias(c) for c in ("defect_rate", "avg_cycle_time_ms")],
        F.lit(CLOSING_STATUS).alias("closing_status"),
    )
    any_row = rows.select(F.lit(1).alias("_one")).limit(1)
    return made.unionByName(zero.join(any_row, F.lit(True), "left_anti"))


def duplicates(events: DataFrame) -> DataFrame:
    """Rows that first_wins drops, by date."""
    keys = events.groupBy("business_date", *NATURAL_KEY).agg(F.count("*").alias("n"))
    return keys.groupBy("business_date").agg(F.sum(F.col("n") - 1).alias("dropped_rows"), F.count_if(F.col("n") > 1).alias("repeated_keys")).filter("dropped_rows > 0")

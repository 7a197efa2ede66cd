"""Set operators over sequences, sessions and the accepted events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def coverage(sealed: DataFrame, accepted: DataFrame) -> DataFrame:
    """sealed(session, sequence_no, event_id) against accepted(event_id, topic, partition, offset): the coordinate of
    each, or nulls where the event is missing.  Completeness is judged by event_id, never by offsets."""
    found = accepted.select("event_id", "topic", "partition", "offset")
    return sealed.join(found, "event_id", "left").withColumn("covered", F.col("offset").isNotNull())


def missing_sequences(present: DataFrame, last: DataFrame) -> DataFrame:
    """present(session, sequence_no), last(session, expected_last_sequence) -> the numbers of 1..last that are absent.
    Only gaps are unfolded: between a number and the one before it, with 0 and last + 1 as the ends."""
    known = present.join(last, "session").filter(F.col("sequence_no").between(1, F.col("expected_last_sequence")))
    ends = last.select("session", F.explode(F.array(F.lit(0).cast("bigint"), F.col("expected_last_sequence").cast("bigint") + 1)).alias("sequence_no"))
    every = known.select("session", F.col("sequence_no").cast("bigint").alias("sequence_no")).unionByName(ends).distinct()
    before = F.lag("sequence_no").over(Window.partitionBy("session").orderBy("sequence_no"))
    gaps = every.withColumn("before", before).filter(F.col("sequence_no") > F.col("before") + 1)
    return gaps.select("session", F.explode(F.sequence(F.col("before") + 1, F.col("sequence_no") - 1)).alias("sequence_no"))


def set_mismatch(sealed: DataFrame, selected: DataFrame) -> DataFrame:
    """event_id with side `missing` (sealed, not selected) or `extra` (selected, not sealed)."""
    a, b = sealed.select("event_id").distinct(), selected.select("event_id").distinct()
    one = lambda x, y, side: x.join(y, "event_id", "left_anti").withColumn("side", F.lit(side))
    return one(a, b, "missing").unionByName(one(b, a, "extra"))


def publish_decision(requests: DataFrame, states: DataFrame, snapshots: DataFrame) -> DataFrame:
    """requests(business_date, source_hash), states(business_date, source_hash, snapshot_id), snapshots(snapshot_id):
    `skip` if the same content was published and its snapshot is still in the history, else `write`."""
    known = states.join(snapshots.select("snapshot_id").distinct(), "snapshot_id", "left_semi").select("business_date", "source_hash", F.lit(True).alias("_known"))
    return requests.join(known, ["business_date", "source_hash"], "left").select("business_date", "source_hash", F.when(F.col("_known"), F.lit("skip")).otherwise(F.lit("write")).alias("action"))


def lineage_trace(runs: DataFrame) -> DataFrame:
    """runs(run_id, layers array<struct<name, path, parents array<string>>>) -> gold, silver, bronze, source in order."""
    order = F.array(*map(F.lit, ["gold", "silver", "bronze", "source"]))
    rows = runs.select("run_id", F.explode("layers").alias("l")).select("run_id", "l.name", "l.path", "l.parents")
    return rows.withColumn("step", F.array_position(order, F.col("name"))).filter("step > 0")

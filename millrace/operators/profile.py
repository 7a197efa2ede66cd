"""Schema inference and profiling, each in one pass over all columns."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.expr import is_float, is_integer, is_iso_datetime


def column_types(df: DataFrame) -> DataFrame:
    """column_name, n_values (non-empty), type: the first of integer, float, datetime that all non-empty values fit,
    else string; `unknown` without any row.  Columns are unpivoted as constants, so one aggregation serves all."""
    every = lambda p: F.coalesce(F.bool_and(F.when(F.col("v") != "", p)), F.lit(False))
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias("v")) for c in df.columns])).alias("x")).select("x.*")
    facts = cells.groupBy("column_name").agg(
        F.count("*").alias("rows"), F.count_if(F.col("v") != "").alias("n_values"), every(is_integer(F.col("v"))).alias("i"), every(is_float(F.col("v"))).alias("f"), every(is_iso_datetime(F.col("v"))).alias("d")
    )
    kind = F.when(F.col("n_values") == 0, "string").when(F.col("i"), "integer").when(F.col("f"), "float").when(F.col("d"), "datetime").otherwise("string")
    return facts.select("column_name", (F.col("rows") - F.col("n_values")).alias("null_count"), "n_values", kind.alias("type"))


def null_counts(df: DataFrame) -> dict[str, int]:
    """Columns with empty or null values only."""
    row = df.agg(*[F.count_if(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) == "").alias(str(i)) for i, c in enumerate(df.columns)]).first()
    return {c: row[str(i)] for i, c in enumerate(df.columns) if row[str(i)]}


def infer_schema(df: DataFrame) -> list[dict[str, str]]:
    """[{name, type}] in the order of the columns."""
    found = {r["column_name"]: r["type"] for r in column_types(df).collect()}  # a row for each column
    return [{"name": c, "type": found.get(c, "unknown")} for c in df.columns]


def schema_hash(schema: list[dict[str, str]]) -> str:
    return hashlib.sha256(json.dumps(schema, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def dataset_versions(registered: DataFrame) -> DataFrame:
    """registered(dataset_id, source_hash, at) -> one row for each distinct content of a dataset, numbered v1, v2, ...
    by first appearance.  Versions sort by number, so v10 comes after v2."""
    from pyspark.sql import Window

    first = registered.groupBy("dataset_id", "source_hash").agg(F.min("at").alias("first_at"), F.count("*").alias("registrations"))
    n = F.row_number().over(Window.partitionBy("dataset_id").orderBy("first_at", "source_hash"))
    return first.select("dataset_id", "source_hash", F.concat(F.lit("v"), n.cast("string")).alias("version"), "registrations")


def schema_drift(runs: DataFrame, policy: str = "warn") -> DataFrame:
    """runs(dataset_id, run_no, schema_hash), successful ones in order -> the status of each against the one before."""
    from pyspark.sql import Window

    before = F.lag("schema_hash").over(Window.partitionBy("dataset_id").orderBy("run_no"))
    return runs.withColumn("previous", before).select(
        "dataset_id", "run_no", F.substring("previous", 1, 12).alias("expected"), F.substring("schema_hash", 1, 12).alias("actual"),
        F.when(F.col("previous").isNull() | (F.col("previous") == F.col("schema_hash")), F.lit("pass")).otherwise(F.lit(policy)).alias("status"),
    )

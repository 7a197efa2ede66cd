"""Wide sources to entity-attribute-value rows, and back to one wide row by entity and day."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.domain import STANDARD_ATTRIBUTES, SUMMED_ATTRIBUTES
from millrace.functions.expr import py_round, py_strip, ratio, with_graceful_number


def raw_cells(rows: DataFrame, mapping: dict, source_file_id: str = "") -> DataFrame:
    """A row for each mapped attribute of each source row: its text, and type and converter of the mapping."""
    own = lambda c: F.col(f"`{c}`") if c in rows.columns else F.lit("")
    blank = lambda c: F.coalesce(py_strip(own(c)), F.lit(""))
    cells = [
        F.struct(F.lit(spec["standard"]).alias("attribute"), own(column).alias("raw"), F.lit(spec["type"]).alias("value_type"), F.lit(spec.get("convert") or None).cast("string").alias("convert"))
        for column, spec in mapping["attributes"].items()
    ]
    wide = rows.select(blank(mapping["entity_field"]).alias("entity_id"), blank(mapping["business_date_field"]).alias("business_date"), F.explode(F.array(*cells)).alias("c"))
    return wide.select("entity_id", "business_date", "c.*", F.lit(mapping["source_id"]).alias("source_id"), F.lit(source_file_id).alias("source_file_id"))


def parsed(cells: DataFrame) -> DataFrame:
    """raw_cells() with `value`, or value_text for other types than int and float, and type_error."""
    number = F.col("value_type").isin("int", "float")
    text = F.when(~number, F.nullif(py_strip(F.col("raw")), F.lit(""))).alias("value_text")
    return with_graceful_number(cells).select("entity_id", "business_date", "attribute", "value", text, "value_type", "raw", "type_error", "source_id", "source_file_id")


def to_eav(rows: DataFrame, mapping: dict, source_file_id: str = "") -> DataFrame:
    """A row for each mapped attribute of each source row, of all dates, nulls kept.  `raw` and `type_error` go to the
    quality checks."""
    return parsed(raw_cells(rows, mapping, source_file_id))


def union_sources(sources: list[tuple[DataFrame, dict]], file_ids: list[str] | None = None) -> DataFrame:
    """to_eav() of all sources; texts are parsed after the union, by one expression for all."""
    ids = file_ids or [""] * len(sources)
    return parsed(reduce(DataFrame.unionByName, [raw_cells(df, m, i) for (df, m), i in zip(sources, ids, strict=True)]))


def eav_gold(eav: DataFrame, business_date: str | None = None) -> DataFrame:
    """Sums of counts, means of sensors (0 where there are none) by entity and day, in one aggregation."""
    rows = eav.filter(F.col("value").isNotNull())
    if business_date is not None:
        rows = rows.filter(F.col("business_date") == business_date)
    is_ = lambda a: F.col("attribute") == a
    each = [F.count_if(is_(a)).alias(f"_n_{a}") for a in STANDARD_ATTRIBUTES]
    sums = [F.sum(F.when(is_(a), F.col("value"))).alias(f"_s_{a}") for a in STANDARD_ATTRIBUTES]
    made = rows.groupBy("business_date", "entity_id").agg(*each, *sums)
    value = {a: F.coalesce(F.col(f"_s_{a}"), F.lit(0.0)) for a in STANDARD_ATTRIBUTES}
    for a in STANDARD_ATTRIBUTES:
        if a in SUMMED_ATTRIBUTES:
            value[a] = value[a].cast("bigint")
        else:
            value[a] = F.when(F.col(f"_n_{a}") == 0, F.lit(0.0)).otherwise(py_round(F.col(f"_s_{a}") / F.nullif(F.col(f"_n_{a}"), F.lit(0)), 4))
    return made.select(
        "business_date",
        "entity_id",
        *[value[a].alias(a) for a in STANDARD_ATTRIBUTES],
        ratio(value["defect_count"], value["units_produced"], 6).alias("defect_rate"),
        F.greatest(*[F.col(f"_n_{a}") for a in STANDARD_ATTRIBUTES]).alias("reading_count"),
    )


def eav_gold_or_sentinel(eav: DataFrame, business_date: str) -> DataFrame:
    made = eav_gold(eav, business_date)
    if not made.isEmpty():
        return made
    return made.sparkSession.range(1).select(
        F.lit(business_date).alias("business_date"),
        F.lit("").alias("entity_id"),
        *[F.lit(0).cast(made.schema[c].dataType).alias(c) for c in made.columns[2:]],
    )

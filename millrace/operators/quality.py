"""Quality checks as Spark aggregates: each suite is evaluated in a few jobs, whatever the number of rows."""

from __future__ import annotations

from datetime import date
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.domain import ACCEPTED_OPERATIONS, NATURAL_KEY, SOURCE_COLUMNS, STANDARD_ATTRIBUTES

SAMPLES = 5
DRIFT_POLICY = "warn"


def check(name: str, status: bool | str, expected: Any, actual: Any, detail: str) -> dict[str, Any]:
    return {"name": name, "status": status if isinstance(status, str) else "pass" if status else "fail", "expected": expected, "actual": actual, "detail": detail}


def passed(checks: list[dict[str, Any]]) -> bool:
    """A run passes unless a check fails; warnings don't count."""
    return all(c["status"] != "fail" for c in checks)


def valid_date(text: str) -> bool:
    try:
        return date.fromisoformat(text).isoformat() == text
    except ValueError:
        return False


def range_rules() -> dict[str, Any]:
    u, d, c = F.col("units_produced"), F.col("defect_count"), F.col("cycle_time_ms")
    return {"units_produced<0": u < 0, "defect_count<0": d < 0, "cycle_time_ms<=0": c <= 0, "defect_count>units_produced": d > u}


def eav_range_rules() -> dict[str, Any]:
    u, d, t, p = (F.col(c) for c in STANDARD_ATTRIBUTES)
    return {"units_produced<0": u < 0, "defect_count<0": d < 0, "defect_count>units_produced": d > u, "temperature_c_out_of_range": ~t.between(-50, 500), "pressure_kpa<0": p < 0}


def violations(rows: DataFrame, key: list[str], rules: dict[str, Any]) -> DataFrame:
    """A row for each rule that a row breaks."""
    broken = F.filter(F.array(*[F.when(p, F.lit(n)) for n, p in rules.items()]), lambda x: x.isNotNull())
    return rows.select(*key, F.explode(broken).alias("rule"))


def unique_violations(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg((F.count("*") - 1).alias("extra")).filter("extra > 0")


def conservation(before: DataFrame, after: DataFrame, measures: list[str]) -> tuple[dict[str, int], dict[str, int]]:
    total = lambda df: df.agg(*[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in measures]).first().asDict()
    return total(before), total(after)


def drift_check(previous: str | None, current: str, policy: str = DRIFT_POLICY) -> dict[str, Any]:
    if previous is None:
        return check("schema_drift", "pass", None, current[:12], "first successful run: this schema is the baseline")
    if previous == current:
        return check("schema_drift", "pass", previous[:12], current[:12], "same schema as the last successful run")
    return check("schema_drift", policy, previous[:12], current[:12], f"another schema than the last successful run (policy {policy})")


def medallion_checks(source: DataFrame, silver: DataFrame, gold: DataFrame, business_date: str) -> list[dict[str, Any]]:
    """The suite of a medallion run: one pass over the source, one over silver, one over gold, and samples only of
    what failed.  Uniqueness is judged on silver's normalised keys, deduplication on raw ones."""
    dated = F.col("business_date") == business_date
    raw_key = F.struct(*NATURAL_KEY)
    src = source.agg(
        F.count("*").alias("total"), F.count_if(dated).alias("dated"), F.count_distinct(F.when(dated, raw_key)).alias("keys"),
        *[F.count_if(dated & (F.coalesce(F.col(c), F.lit("")) == "")).alias(f"null_{c}") for c in SOURCE_COLUMNS],
    ).first()
    rules = range_rules()
    known = F.col("operation").isin(ACCEPTED_OPERATIONS)
    s = silver.agg(
        F.count("*").alias("n"), F.count_distinct(F.struct(*NATURAL_KEY)).alias("keys"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("units_produced", "defect_count")],
        *[F.count_if(p).alias(f"rule_{i}") for i, p in enumerate(rules.values())],
        F.count_if(~known).alias("odd"), F.count_if(~dated).alias("off"),
    ).first()
    g = gold.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("units_produced", "defect_count")]).first()
    nulls = {c: src[f"null_{c}"] for c in SOURCE_COLUMNS if src[f"null_{c}"]}
    before, after = ({c: r[c] for c in ("units_produced", "defect_count")} for r in (s, g))
    broken = sum(s[f"rule_{i}"] for i in range(len(rules)))
    some = [[*r] for r in violations(silver, NATURAL_KEY, rules).limit(SAMPLES).collect()] if broken else "none"
    distinct = lambda p, c: _first_values(silver.filter(p), c)
    odd = distinct(~known, "operation") if s["odd"] else []
    off = distinct(~dated, "business_date") if s["off"] else []
    iso = valid_date(business_date)
    return [
        check("row_count_source_to_silver", s["n"] == src["keys"], src["keys"], s["n"], f"source rows {src['total']}, on the date {src['dated']}, repeated keys {src['dated'] - src['keys']}"),
        check("unit_conservation_silver_to_gold", before == after, before, after, "totals of units and defects stay the same"),
        check("not_null_required_columns", not nulls, 0, sum(nulls.values()), f"empty values by column: {nulls or 'none'}"),
        check("unique_natural_key", s["n"] == s["keys"], 0, s["n"] - s["keys"], f"normalised {', '.join(NATURAL_KEY)}"),
        check("accepted_values_operation", not odd, sorted(ACCEPTED_OPERATIONS), odd, "operations beyond the accepted ones"),
        check("numeric_range_within_bounds", not broken, 0, broken, f"rules {', '.join(rules)}; first: {some}"),
        check("freshness_business_date", not off and iso, business_date, {"off_partition_dates": off, "business_date_parseable": iso}, "silver holds the active date only"),
    ]


def _first_values(rows: DataFrame, column: str) -> list:
    """The first distinct values, SAMPLES at most: what a report names of any number of them."""
    return [r[0] for r in rows.select(column).distinct().orderBy(column).limit(SAMPLES).collect()]


def eav_checks(sources: list[tuple[DataFrame, dict]], eav: DataFrame, gold: DataFrame, business_date: str) -> list[dict[str, Any]]:
    """The suite of a harmonisation run."""
    needed = set(STANDARD_ATTRIBUTES)
    missing = {m["source_id"]: gap for _, m in sources if (gap := sorted(needed - {a["standard"] for a in m["attributes"].values()}))}
    extra = {m["source_id"]: more for df, m in sources if (more := sorted(set(df.columns) - set(m["attributes"]) - {m["entity_field"], m["business_date_field"]}))}
    active = F.col("business_date") == business_date
    is_ = lambda a: active & (F.col("attribute") == a)
    e = eav.agg(
        F.count_if(active & F.col("value").isNull() & F.col("value_text").isNull()).alias("nulls"), F.count_if("type_error").alias("errors"), F.count_if(~F.col("attribute").isin(STANDARD_ATTRIBUTES)).alias("odd"),
        *[F.coalesce(F.sum(F.when(is_(a), F.col("value"))), F.lit(0.0)).alias(a) for a in ("units_produced", "defect_count")],
        F.count_if(~active).alias("others"),
    ).first()
    rules = eav_range_rules()
    g = gold.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("units_produced", "defect_count")], *[F.count_if(p).alias(f"rule_{i}") for i, p in enumerate(rules.values())]).first()
    broken = sum(g[f"rule_{i}"] for i in range(len(rules)))
    before, after = ({c: int(r[c]) for c in ("units_produced", "defect_count")} for r in (e, g))
    odd = _first_values(eav.filter(~F.col("attribute").isin(STANDARD_ATTRIBUTES)), "attribute") if e["odd"] else []
    others = _first_values(eav.filter(~active), "business_date") if e["others"] else []
    errors = [r.asDict() for r in eav.filter("type_error").select("source_id", "attribute", "raw").limit(SAMPLES).collect()] if e["errors"] else "none"
    some = [[*r] for r in violations(gold, ["entity_id"], rules).limit(SAMPLES).collect()] if broken else "none"
    iso = valid_date(business_date)
    return [
        check("mapping_coverage", not missing, sorted(needed), missing or "complete", "every source maps all required attributes"),
        check("unmapped_source_columns", "warn" if extra else "pass", [], extra or "none", "columns that no mapping names"),
        check("not_null_value", not e["nulls"], 0, e["nulls"], "no null on the active date"),
        check("accepted_values_attribute", not odd, sorted(needed), odd or "none", "standard attributes only, on all dates"),
        check("value_type_valid", not e["errors"], 0, e["errors"], f"values of another type, on all dates; first: {errors}"),
        check("numeric_range_within_bounds", not broken, 0, broken, f"rules {', '.join(rules)}; first: {some}"),
        check("eav_to_gold_conservation", before == after, before, after, "totals of units and defects stay the same"),
        check("freshness_business_date", iso, business_date, {"business_date_parseable": iso, "other_dates_in_eav": others}, "other dates are kept, gold has the active one"),
    ]


def summary(checks: DataFrame) -> DataFrame:
    """checks(..., status) -> counts by status."""
    return checks.groupBy("status").agg(F.count("*").alias("checks"))

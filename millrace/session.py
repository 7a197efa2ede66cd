"""Sessions with the settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "millrace", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, ANSI casts and UTC; cluster settings come from the submit command."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    return builder.config(map=settings | conf).getOrCreate()


def environment_gate(spark: SparkSession) -> dict:
    """Smoke check of a session: its versions, and that a tiny aggregate shuffles and returns."""
    total = spark.range(10).selectExpr("id % 2 AS k", "id").groupBy("k").sum("id").count()
    return {"spark": spark.version, "ansi": spark.conf.get("spark.sql.ansi.enabled"), "groups": total}

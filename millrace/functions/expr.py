"""Exact rounding, stripping, casts, labels and digests as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def py_round(value: Column, digits: int) -> Column:
    """Correctly rounded decimal of a double's exact binary value, ties to even, as IEEE languages print it.

    Spark's round, bround and decimal casts work on the shortest decimal text and differ in about one ratio in fifty;
    format_number works on the exact value.  Non-finite values come back as they are."""
    value = value.cast("double")
    finite = (~F.isnan(value)) & (F.abs(value) != F.lit(float("inf")))
    return F.when(finite, F.replace(F.format_number(F.when(finite, value), digits), F.lit(","), F.lit("")).cast("double")).otherwise(value)


def ratio(numerator: Column, denominator: Column, digits: int) -> Column:
    """Rounded quotient, 0 where the denominator is 0."""
    return F.when(denominator == 0, F.lit(0.0)).otherwise(py_round(numerator / F.nullif(denominator.cast("double"), F.lit(0.0)), digits))


def py_strip(text: Column) -> Column:
    """Without white space, as Unicode has it, at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def empty_as_text(text: Column) -> Column:
    """CSV readers give null for an empty cell, the data model has the empty string."""
    return F.coalesce(text, F.lit(""))


_INTEGER = r"^\s*[+-]?[0-9]+(_[0-9]+)*\s*$"
_FLOAT = r"(?i)^\s*[+-]?(([0-9]+(_[0-9]+)*)(\.([0-9]+(_[0-9]+)*)?)?|\.[0-9]+(_[0-9]+)*)(e[+-]?[0-9]+(_[0-9]+)*)?\s*$"
_SPECIAL = r"(?i)^\s*[+-]?(inf|infinity|nan)\s*$"
_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
_DATETIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}(:[0-9]{2}(:[0-9]{2}([.,][0-9]{1,6})?)?)?(Z|[+-][0-9]{2}:?[0-9]{2}(:[0-9]{2})?)?)?$"
_ZONE = r"(Z|[+-][0-9]{2}:?[0-9]{2}(:[0-9]{2})?)$"


def is_integer(text: Column) -> Column:
    return text.rlike(_INTEGER)


def is_float(text: Column) -> Column:
    return text.rlike(_FLOAT) | text.rlike(_SPECIAL)


def is_iso_date(text: Column) -> Column:
    """YYYY-MM-DD and a day that exists; null counts as no."""
    return F.coalesce(text.rlike(_DATE) & F.try_to_date(text, "yyyy-MM-dd").isNotNull(), F.lit(False))


def is_iso_datetime(text: Column) -> Column:
    """ISO date, or date and time with or without a zone, of a moment that exists."""
    stamp = F.concat(F.substring(text, 1, 10), F.lit(" "), F.rpad(F.regexp_replace(F.substring(F.regexp_replace(text, _ZONE, ""), 12, 8), "^$", "00:00:00"), 8, ":00:00"))
    whole = F.when(F.length(F.regexp_replace(text, _ZONE, "")) <= 10, F.concat(F.substring(text, 1, 10), F.lit(" 00:00:00"))).otherwise(stamp)
    return F.coalesce(text.rlike(_DATETIME) & F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd").isNotNull() & F.try_to_timestamp(whole, F.lit("yyyy-MM-dd HH:mm:ss")).isNotNull(), F.lit(False))


def has_zone(text: Column) -> Column:
    return (F.length(text) > 10) & F.substring(text, 11, 40).rlike(_ZONE)


def strict_long(text: Column) -> Column:
    """ANSI cast: text that is no integer fails the run."""
    return text.cast("bigint")


def with_graceful_number(rows: DataFrame) -> DataFrame:
    """rows(raw, value_type, convert, ...) and value (double) and type_error.  Blank text is null without error; nan and
    infinity, an unknown converter and text that is no number are errors.  `int` rounds half to even, `float` to four
    digits; other types have no value.  Each step is a column of its own, so that a cell is parsed once."""
    number, done = F.col("_number"), F.col("_converted")
    kind, convert = F.col("value_type"), F.col("convert")
    out = rows.withColumn("_text", py_strip(F.col("raw")))
    out = out.withColumn("_number", F.when(F.col("raw").rlike(_FLOAT), F.replace("_text", F.lit("_"), F.lit("")).try_cast("double")))
    out = out.withColumn("_converted", F.when(convert.isNull(), number).when(convert == "f_to_c", (number - 32) * 5 / 9).when(convert == "bar_to_kpa", number * 100))
    out = out.withColumn("_converted", F.when(F.abs(done) != F.lit(float("inf")), done))
    out = out.withColumn("value", F.when(kind == "int", F.rint(done)).when(kind == "float", py_round(done, 4)))
    error = kind.isin("int", "float") & F.col("value").isNull() & (F.coalesce("_text", F.lit("")) != "")
    return out.withColumn("type_error", error).drop("_text", "_number", "_converted")


def sha256_text(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def record_fingerprint(topic: Column, partition: Column, offset: Column, key: Column, value: Column) -> Column:
    """SHA-256 of topic, partition, offset, key (null: empty) and value bytes with zero bytes between."""
    zero = F.lit(bytearray(b"\0"))
    text = lambda c: c.cast("string").cast("binary")
    return F.sha2(F.concat(text(topic), zero, text(partition), zero, text(offset), zero, F.coalesce(key, F.lit("")).cast("binary"), zero, value), 256)

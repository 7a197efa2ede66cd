"""File scans and sinks: CSV as text, JSON lines with errors by line, typed gold, byte-exact copies and documents."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import os
import uuid
from collections.abc import Iterable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from millrace.domain import CANONICAL_EXTRA, GOLD_DDL, SOURCE_COLUMNS
from millrace.functions.expr import empty_as_text

ORDINAL = "_ordinal"


class MissingColumns(ValueError):
    pass


def csv_header(path: str | Path) -> list[str]:
    """Names of the columns; a missing file is an error, never a sample."""
    with open(path, newline="", encoding="utf-8") as f:
        return next(csv.reader(f), [])


def _breaks_in_quotes(spark: SparkSession, path: str | Path) -> bool:
    """Whether a line has an odd number of quotes, as both ends of a cell with a line break do."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(str(path)).filter(quotes % 2 == 1).isEmpty()


def read_csv(spark: SparkSession, path: str | Path, columns: list[str] | None = None, ordinal: bool = False) -> DataFrame:
    """All columns as text, empty cells as empty text, columns as the header has them.  With `ordinal`, the order of
    the rows in the file as a column.  Quotes within quoted cells are doubled, a backslash is a character like others;
    only a file with a line break within quotes is read as a whole by one task."""
    names = columns or csv_header(path)
    schema = StructType([StructField(n, StringType()) for n in names])
    read = spark.read.option("header", True).option("enforceSchema", False).option("quote", '"').option("escape", '"').option("multiLine", _breaks_in_quotes(spark, path))
    df = read.schema(schema).csv(str(path))
    out = [empty_as_text(F.col(f"`{n}`")).alias(n) for n in names]
    if ordinal:
        out.append(F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias(ORDINAL))
    return df.select(*out)


def require_columns(df: DataFrame, needed: Iterable[str] = SOURCE_COLUMNS) -> DataFrame:
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise MissingColumns(f"missing required columns: {', '.join(missing)}")
    return df


def read_events_csv(spark: SparkSession, path: str | Path) -> DataFrame:
    """Source events with their order; further columns stay."""
    return require_columns(read_csv(spark, path, ordinal=True))


def read_canonical_csv(spark: SparkSession, path: str | Path) -> DataFrame:
    return read_csv(spark, path, [*SOURCE_COLUMNS, *CANONICAL_EXTRA])


def read_gold_csv(spark: SparkSession, path: str | Path) -> DataFrame:
    df = spark.read.option("header", True).schema(GOLD_DDL).csv(str(path))
    if df.isEmpty():
        raise ValueError(f"no gold rows in {path}")
    return df


def read_json_lines(spark: SparkSession, path: str | Path, schema: str) -> tuple[DataFrame, DataFrame]:
    """(parsed rows, lines that are no such object as file, line, value); blank lines are skipped, but counted.  A line's
    number comes from its place in its block and the lines of the blocks before, one row for each block."""
    every = spark.read.text(str(path)).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    blocks = every.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("file", "block", (before - F.col("first") + 1).alias("shift"))
    lines = every.filter(F.trim("value") != "")
    parsed = lines.withColumn("doc", F.from_json("value", schema, {"mode": "PERMISSIVE"}))
    good = F.coalesce(F.expr("schema_of_variant(try_parse_json(value))").startswith("OBJECT"), F.lit(False))
    bad = parsed.filter(~good).join(blocks, ["file", "block"]).select("file", (F.col("at") + F.col("shift")).alias("line"), "value")
    return parsed.filter(good).select("doc.*"), bad


def read_json(path: str | Path) -> Any | None:
    try:
        return json.loads(Path(path).read_text(encoding="utf-8"))
    except FileNotFoundError:
        return None


def write_bytes_atomic(path: str | Path, data: bytes) -> None:
    """Temporary file, fsync, rename, fsync of the folder."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    with open(part, "wb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)
    sync_folder(path.parent)


def sync_folder(path: str | Path) -> None:
    fd = os.open(path, os.O_RDONLY)
    try:
        os.fsync(fd)
    finally:
        os.close(fd)


def write_json(path: str | Path, doc: Any) -> None:
    write_bytes_atomic(path, (json.dumps(doc, ensure_ascii=False, indent=2, sort_keys=True, default=str) + "\n").encode())


def compact(doc: Any) -> str:
    return json.dumps(doc, sort_keys=True, separators=(",", ":"))


def hash_file(path: str | Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def hash_text(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def csv_bytes(columns: list[str], rows: Iterable[dict[str, Any]]) -> bytes:
    """CSV with fixed columns and \\n line ends; a row with another column is refused."""
    out = io.StringIO(newline="")
    w = csv.DictWriter(out, columns, extrasaction="raise", lineterminator="\n")
    w.writeheader()
    w.writerows(rows)
    return out.getvalue().encode()

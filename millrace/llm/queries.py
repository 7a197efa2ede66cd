"""The queries of this subpackage for __spark_entry__.py, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.bpe import op2_bpe
from millrace.llm.chat import op4_chat
from millrace.llm.decontaminate import op9_decontaminate
from millrace.llm.fingerprint import op1_fingerprints
from millrace.llm.language_id import op7_language_id
from millrace.llm.line_dedup import op5_line_dedup
from millrace.llm.near_duplicates import op8_near_duplicates
from millrace.llm.oracle import oracle_sql
from millrace.llm.quality import op10_quality
from millrace.llm.substring_dedup import op3_substring_dedup
from millrace.llm.warc import op6_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_fingerprints": op1_fingerprints,
        "op2_bpe": op2_bpe,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_chat": op4_chat,
        "op5_line_dedup": op5_line_dedup,
        "op6_warc": op6_warc,
        "op7_language_id": op7_language_id,
        "op8_near_duplicates": op8_near_duplicates,
        "op9_decontaminate": op9_decontaminate,
        "op10_quality": op10_quality,
    }


__all__ = ["oracle_sql", "queries"]

"""The corpus pipeline: each stage applies one operator of millrace.llm to all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bpe, decontaminate, language_id, line_dedup, near_duplicates
from millrace.llm._shared import table, written

STAGES = [
    ("language ID", language_id.accepted),
    ("line dedup", line_dedup.without_boilerplate),
    ("MinHash near-dedup", near_duplicates.one_of_each),
    ("benchmark decontamination", decontaminate.clean),
    ("BPE encoding and decoding", bpe.tokens),
]

#: SQL cannot express the stages; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

"""The corpus pipeline: quality rules, near-duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir), works on all documents that the stage
before kept, and returns the columns of documents; the last returns the packed
pieces. run() writes each stage's result to the shared folder and reads it back.

Edge cases: a null or empty text fails the quality rules; an empty table gives no pieces; rows that repeat a doc_id and its text become
one, and of different texts of one doc_id one stands for it where documents are compared; columns other than doc_id and text, of any
names, ride along to the last stage (n_chars follows the text); very long texts are whole in each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gradewell.llm._store import store, table
from gradewell.llm.decontaminate import decontamination_stage
from gradewell.llm.minhash import near_duplicate_stage
from gradewell.llm.packing import packing_stage
from gradewell.llm.quality_rules import quality_stage
from gradewell.llm.suffix_dedup import repeat_stage

STAGES = [
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("suffix_dedup", repeat_stage),
    ("decontaminate", decontamination_stage),
    ("packing", packing_stage),
]

#: Near-duplicate components, repeated passages and token ids are beyond SQL; a test holds the stages and run() against the same work in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
    return docs

"""A corpus pipeline of five stages. Each reads what the one before it has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wattloom.llm import language_id, mixing, ngram_join, personal_data, pieces
from wattloom.llm.common import read, written

STAGES = [
    ("language_id", language_id.stage),
    ("ngram_join", ngram_join.stage),
    ("personal_data", personal_data.stage),
    ("mixing", mixing.stage),
    ("sentencepiece", pieces.stage),
]
#: SQL has no compression, no trained span classifier and no tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; all but the last are written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs

"""A corpus pipeline of five operators: documents in, encoded training documents out.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet in the shared
folder and reads it again as the next stage's docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barspark.llm.jaccard import duplicates_stage
from barspark.llm.mixing import mixing_stage
from barspark.llm.pieces import pieces_stage
from barspark.llm.quality import quality_stage
from barspark.llm.secrets import secrets_stage
from barspark.llm.storage import discard, documents, saved

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("near_duplicates", duplicates_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("pieces", pieces_stage),
]

#: A trained network, a similarity join and a tokenizer are beyond SQL; tests/llm holds them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES[:-1]):
        older, docs = docs, saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if k:
            discard(older)
    return STAGES[-1][1](spark, docs, sf_dir)

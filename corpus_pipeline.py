"""The corpus pipeline: quality rules, near duplicates, decontamination, personal data, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from corpuslab.llm import decontaminate, jaccard, packing, pii, quality
from corpuslab.llm.batches import remove, scratch, shared_folder

#: (name, function of the session, the documents so far and the folder of tables).
STAGES = [
    ("quality_rules", quality.stage),
    ("ngram_jaccard_join", jaccard.stage),
    ("decontamination", decontaminate.stage),
    ("personal_data", pii.stage),
    ("best_fit_packing", packing.stage),
]

#: Tokens cannot be counted in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written and read again before the next, and what it alone needed is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if k:
            remove(spark, [f"{folder}/{k - 1}-{STAGES[k - 1][0]}"])
        docs = spark.read.parquet(path)
    return docs

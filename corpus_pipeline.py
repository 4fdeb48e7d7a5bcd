"""The corpus pipeline: rejects poor documents, drops recurring lines and near copies, mixes sources, and encodes the rest.

Each stage gets the rows that its predecessor kept and all but the last return the columns of ``documents``. ``run`` writes each
stage's result to the shared folder and reads it back, so a lost executor repeats tasks of one stage only.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from roadlens.llm import bpe_codec, jaccard_join, line_templates, mixing, quality_cotraining
from roadlens.llm.common import stored


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, ids`` of each document."""
    return bpe_codec.encode(docs, public_tokenizers.path("word_bpe_49k.json"), keep=("lang", "source"))


STAGES = [
    ("quality", quality_cotraining.stage),
    ("lines", line_templates.stage),
    ("near_copies", jaccard_join.stage),
    ("mixing", mixing.stage),
    ("encode", encode),
]

#: The quality classifier is fitted iteratively and the last stage merges by a vocabulary file: neither is an SQL expression.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

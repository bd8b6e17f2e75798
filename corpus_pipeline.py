"""A corpus pipeline of five stages; each works on all that the one before it kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame with the columns of
``documents``, the last one the encoded documents. ``run`` applies them to the table ``documents``, writing each stage's
rows as Parquet to the shared checkpoint folder and reading them again.

Edge cases are those of the stages: NULL texts aren't toxic and have no language, so the second stage drops them; of
near-duplicates the smallest ``doc_id`` stays; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from weftline.llm.bpe import bpe_stage
from weftline.llm.common import shared_folder
from weftline.llm.decontaminate import decontaminate_stage
from weftline.llm.language import language_stage
from weftline.llm.simhash import simhash_stage
from weftline.llm.toxicity import toxicity_stage

STAGES = [
    ("toxicity", toxicity_stage),
    ("language", language_stage),
    ("near_duplicates", simhash_stage),
    ("decontaminate", decontaminate_stage),
    ("bpe", bpe_stage),
]

#: The stages are trained models, a fixpoint and a tokenizer: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

"""The corpus pipeline over ``documents``: each stage is one operator, written and read again before the next.

quality      documents that the quality rules reject go
near_dedup   one document of each group of near copies (SimHash, then five-word shingles, Jaccard 0.8 or more) stays
secrets      secrets in texts are replaced by a mark, and n_chars is counted anew
mixing       documents are repeated or left out, so that sources meet their targets
packing      texts are packed into sequences: the rows of packing.PIECES

Edge cases are those of the operators. Null and short texts go in the first stage; a null doc_id, lang or
source stays null; of repeated rows the first stays; copies that the mix makes have places of their own in
the pieces (``row``); long texts are processed whole; further columns, of any names, are carried up to the
last stage; an empty table gives an empty result at every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import mixing, packing, quality, secrets, similar
from pathloom.llm.common import checkpoint_folder


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_quality(docs)


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar.drop_similar(docs)


def _secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality", _quality), ("near_dedup", _near_dedup), ("secrets", _secrets), ("mixing", _mixing), ("packing", _packing)]

#: Components and sequences can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stages make of ``documents``. Between stages, rows are written to the shared checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    checkpoint_folder(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
    return docs

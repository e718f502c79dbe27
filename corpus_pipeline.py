"""Training corpus pipeline over ``documents``: toxic texts go, near-duplicates go, repeated passages go, the rest is packed.

Each stage takes what its predecessor kept, written as Parquet and read again, and returns the columns of
``documents``; the last returns the packed pieces. A null id or text is handled as the stages' operators say.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from evispan.llm import bagminhash, packing, suffix_dedup, toxicity
from evispan.llm._common import shared_dir
from evispan.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated score stays under the threshold, unchanged."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.score(docs, labels).where(F.col("predicted") == 0).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the least id, unchanged."""
    return bagminhash.keep_one(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 100 bytes or more that occur before; those of which nothing is left go."""
    left = suffix_dedup.dedup(docs, as_text=True).where((F.col("n_removed") == 0) | (F.length("kept") > 0))
    text = F.col("kept")
    new = {"text": text, "n_chars": F.char_length(text).cast("long")}
    return left.select(*[new[c].alias(c) if c in new else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, packed into sequences of 4096 tokens: a row a piece."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("passage_dedup", drop_repeated_passages), ("packing", pack)]
#: SQL expresses none of these stages; tests/llm/test_pipeline.py holds run() against a plain version of them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

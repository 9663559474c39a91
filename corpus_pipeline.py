"""The corpus pipeline: quality rules, toxicity, exact copies, near copies, packing.

Each stage is a function of (spark, docs, sf_dir); it is written as Parquet and read again as the next stage's
docs. All but the last return the columns of documents. Quality rules and toxicity drop the documents they
reject; of exact copies the smallest doc_id stays; of near copies one document of each group stays; packing
gives a row for each piece. Rows are told by file and place, so to drop some no stage writes docs again or moves their
texts; near copies move the texts of candidates only. Null, empty and repeated rows are what each operator's docstring says.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.common import placed, shared_dir, spare_name, table
from plumbline.llm.exact_dedup import drop_exact_copies
from plumbline.llm.near_dedup import keep_one_of_each
from plumbline.llm.packing import pack
from plumbline.llm.quality import keep_good
from plumbline.llm.toxicity import drop_toxic


def by_rows(drop: Callable[..., DataFrame], docs: DataFrame) -> DataFrame:
    row = spare_name(docs, "row_number_here")
    return drop(placed(docs, row), row_col=row).drop(row)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return by_rows(keep_good, docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return by_rows(drop_exact_copies, docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return by_rows(keep_one_of_each, docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("packing", packing_stage),
]

#: Votes, a trained network and alignments are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}_{name}")
        docs = spark.read.parquet(f"{folder}/{number}_{name}")
    return docs

"""A training corpus from raw documents: five stages, each written and read again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from groundswell.llm.common import delete_folder, is_written, shared_folder, table
from groundswell.llm.line_dedup import drop_repeated_lines
from groundswell.llm.mixing import mix_documents
from groundswell.llm.near_dup import drop_near_duplicates
from groundswell.llm.packing import pack
from groundswell.llm.quality import keep_quality
from groundswell.llm.queries import vocabulary

#: Documents whose five-word shingle sets share this much of their union are near-duplicates.
NEAR_PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return keep_quality(docs, table(spark, folder, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without the lines they repeat from each other."""
    return drop_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return drop_near_duplicates(docs, NEAR_PERCENT)


def mixing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents repeated so that the domains' tokens match the target weights."""
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The documents' tokens packed into sequences."""
    return pack(docs, vocabulary("word_bpe_49k.json"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL cannot train the classifiers of two stages; a brute-force version tests the rows.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str, work: str | None = None) -> DataFrame:
    """The rows of the last stage over all documents of the folder.

    Stages are written to ``work``, a shared folder. With a folder of the caller's, stages that
    an earlier run finished there are not done again; otherwise the folder is a new one, and
    what a stage has read is deleted as soon as the stage is written.
    """
    docs = table(spark, sf_dir, "documents")
    own = work or f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        path = f"{own}/{name}"
        if not work or not is_written(spark, path):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        if before and not work:
            delete_folder(spark, before)
        before = path
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}

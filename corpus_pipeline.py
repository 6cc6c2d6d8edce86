"""Cleaning a corpus, from documents to packed training sequences, stage by stage."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from gridcast.llm import decontam, language_id, line_dedup, neardup, packing
from gridcast.llm.common import delete_folder, shared_folder, table


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which most is in no known language go; so do null, empty and letterless texts.

    All other rows stay as they are: null ids, repeated rows, very long texts and further columns among them. An
    empty table stays empty.
    """
    return language_id.drop_rejected(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines are deleted, and documents of which no word is left.

    The earliest copy, by id, stays, so of equal texts the one of lowest id. Rows with null ids or texts and
    empty texts stay as they are; rows equal in id and text are treated alike, and texts of any length to their end.
    Columns other than text and its length aren't touched; an empty table stays empty.
    """
    return line_dedup.delete_repeats(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one of least id; of rows equal in id and text one.

    Rows with null ids, and null or empty texts, belong to no group and stay. Texts of any length are compared as
    wholes. Further columns go along; an empty table stays empty.
    """
    return neardup.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go, with all rows that repeat them.

    Rows with null ids, null or empty texts stay, as do all if the benchmark is empty. Texts of any length are
    searched to their end. Further columns go along; an empty table stays empty.
    """
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where in which training sequence each piece of each document lies.

    Texts that are null or have no token have no piece; long ones have several. Null ids are packed under a
    null id, repeated rows as often as they occur. Pieces of equal length are interchangeable. Further columns are
    ignored; an empty table gives no row.
    """
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_languages),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("decontamination", decontaminate),
    ("packing", pack_sequences),
]

#: SQL can't put the stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again.

    What a stage read is deleted once its result is written; the last result stays, as it is what is returned.
    """
    folder = os.path.join(shared_folder(spark), f"pipeline-{uuid.uuid4().hex}")
    docs, last = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            delete_folder(spark, last)
        last = path
    return docs

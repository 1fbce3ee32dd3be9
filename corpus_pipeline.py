"""The corpus pipeline: documents to packed training sequences.

Five stages, each one operator of ``quillmesh.llm`` with its production parameters; what a stage
returns is written as Parquet and read as the next one's documents.

1. language: rows in none of the languages learned from the labelled rows go: those without letters, and those
   whose text needs more bits a character than max(4.8, 1.4 times the need of its language) + 200 / length;
2. exact: of texts that are equal apart from white space one stays, the longest original;
3. near: of each class of five-word-shingle near duplicates (0.8) the row with the smallest id stays;
4. mix: sources are brought to their target weights; a row per copy taken, in training order;
5. pack: the copies are packed into sequences of 2048 words. A row per piece.

All but the last return the columns of ``documents``. Of rows that repeat id and text the one whose other columns
are first as JSON stands for all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmesh.llm import exact, langid, mixing, packing, similarity
from quillmesh.llm.common import written
from quillmesh.session import ship


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return langid.accept(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return exact.keep_first(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return similarity.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack(docs)


STAGES = [("language", language), ("exact", exact_duplicates), ("near", near_duplicates), ("mix", mix), ("pack", pack)]

#: SQL expresses neither the language model nor best-fit packing; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

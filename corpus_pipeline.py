"""Documents to packed training sequences: language, toxicity, near duplicates, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bandloom.llm.common import discard, stored
from bandloom.llm.language import keep_identified
from bandloom.llm.neardup import keep_one_of_each
from bandloom.llm.packing import pack
from bandloom.llm.toxicity import keep_clean


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language the random field does not know.

    So go null and empty texts and texts without a letter; where no lang teaches, nothing goes. Rows without a
    doc_id and repeated rows are judged each on its own text; no rows give no rows.
    """
    return keep_identified(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score as toxic; the labels of documents that are left teach.

    Null and empty texts have the score of the bias; without labels all rows stay; repeated rows and rows without a
    doc_id are judged each on its own text; no rows give no rows.
    """
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates (five words, 0.8): the one of the least doc_id.

    Repeated rows are copies, so one stays, and so are equal texts without a doc_id; texts without words all stay; no
    rows give no rows.
    """
    return keep_one_of_each(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences: one row per piece.

    A null or empty text is its end token alone; repeated rows are packed each on its own; a null doc_id stays null; no
    rows give no rows.
    """
    return pack(docs)


STAGES = [("language", language), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("packing", packing)]

#: SQL can express neither the models nor the encoder; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each result written to the shared folder and read again; a stage's input goes once its result is there."""
    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs, read = stored(docs), kept
            kept = docs
            if read is not None:
                discard(read)
    return docs

"""A training-data pipeline over ``documents``: five operators of ``occugrid.llm`` in a row.

Each stage takes ``(spark, docs, sf_dir)`` and returns the columns of ``documents``, the last
one the packed pieces. ``run`` writes every stage's result as Parquet in the shared folder and
reads it back as the next stage's input, so that a lost executor never costs more than a stage.

Any rows will do: a null text counts as an empty one, null ids, repeated ids and repeated rows are
documents each, very long texts are read whole, and no rows give no rows. Columns beside those of
``documents`` pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from occugrid.llm import line_dedup, lsh_forest, mixture, packing, weak_supervision
from occugrid.storage import written_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules reject go, those without text among them."""
    return weak_supervision.keep_good(docs)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents repeat stay in one of them; every document stays.

    Repeated rows of one id are one document here, whose lines go or stay together.
    """
    return line_dedup.drop_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies, repeated rows included, the document with the least id stays."""
    return lsh_forest.keep_one(docs)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken, in part or several times, to meet the sources' target weights.

    A null source is a source of its own; documents without words are not taken.
    """
    return mixture.mixed_documents(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their token ids; an empty text is one closing id."""
    pieces = packing.pack(docs, added_tokens=True)
    return pieces.withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_deduplication),
    ("near duplicates", near_duplicates),
    ("source mixture", source_mixture),
    ("packing", packed_sequences),
]

#: Expectation-maximisation, a forest of hashes and token ids are beyond SQL; the stages are
#: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

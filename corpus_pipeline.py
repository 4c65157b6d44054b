"""From raw documents to packed training sequences: five stages, each written and read again before the next.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns the columns of
`documents`, but for the last, which returns where each piece of each document goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarn.llm import decontam, ngram_join, packing, pii, quality
from tarn.llm._store import table, written


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """Of each group of copies and near copies the first document stays."""
    return ngram_join.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """Personal data becomes the name of its kind in square brackets; n_chars follows."""
    return pii.redact(docs, "n_chars")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """Pieces of documents and their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality", drop_low_quality),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]

#: SQL has no classifier and no tokenizer; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
